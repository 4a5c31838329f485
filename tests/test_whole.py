"""Queries and operators over whole tables, against brute force."""

from sparkassay.queries import Q, table

DIR = "/root/testdata/sf0.001"


def test_tanimoto_and_butina_cover_all_embeddings(spark):
    rows = table(spark, DIR, "embeddings").collect()
    bits = {r["vec_id"]: {i for i, x in enumerate(r["embedding"]) if x > 0} for r in rows}
    want = {(a, b) for a in bits for b in bits if a < b and len(bits[a] & bits[b]) >= 0.6 * len(bits[a] | bits[b])}
    assert max(bits) >= 300 and any(63 in b for b in bits.values())
    assert {(r["a"], r["b"]) for r in Q["spl_tanimoto_all"](spark, DIR).collect()} == want
    near = {a: {a} for a in bits}
    for a, b in want:
        near[a].add(b)
        near[b].add(a)
    cluster, number = {}, 0
    for a in sorted(near, key=lambda x: (-len(near[x]), x)):
        if a not in cluster:
            number += 1
            for m in near[a]:
                cluster.setdefault(m, number)
    assert {r["vec_id"]: r["cluster"] for r in Q["spl_butina"](spark, DIR).collect()} == cluster


def test_estimators_get_whole_embeddings(spark, monkeypatch):
    from sparkassay import queries

    widths = []

    class Seen(Exception):
        pass

    def fit(self, df, *_, **__):
        widths.append(df.selectExpr("min(size(features)) AS n").first()["n"])
        raise Seen

    monkeypatch.setattr(queries.Estimator, "fit", fit)
    for name in ("est_rf", "est_logreg", "est_prf"):
        try:
            Q[name](spark, DIR)
        except Seen:
            pass
    assert widths == [64, 64, 64]


def test_venn_abers_keeps_every_score(spark):
    import random

    from sparkassay.operators.calibrate import VennAbers

    rng = random.Random(2)
    data = [(rng.choice([1e-5, 1.0]) * rng.random(), rng.randrange(2)) for _ in range(60)]
    data += [(data[0][0], 1), (data[1][0], 0)]
    fitted = VennAbers().fit(spark.createDataFrame(data, "score double, y int"))
    scores = sorted({s for s, _ in data})
    assert fitted.scores == scores

    def slow(at, label):
        rows = [*data, (at, label)]
        mean = lambda a, b: (lambda ys: sum(ys) / len(ys))([y for s, y in rows if a <= s <= b])
        return max(min(mean(a, b) for b in scores if b >= at) for a in scores if a <= at)

    for s, low, high in zip(scores, fitted.low, fitted.high, strict=True):
        assert abs(low - slow(s, 0)) < 1e-12 and abs(high - slow(s, 1)) < 1e-12
    got = fitted.transform(spark.createDataFrame([(s,) for s in scores], "score double")).orderBy("score").collect()
    assert [r["p0"] for r in got] == fitted.low


def test_full_join_of_whole_tables(spark):
    docs = {r["doc_id"]: r["n_chars"] for r in table(spark, DIR, "documents").collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, DIR, "labels").collect()}
    got = Q["join_full_all"](spark, DIR).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs.keys() | labels.keys())
    assert all((r["n_chars"], r["quality"]) == (docs.get(r["doc_id"]), labels.get(r["doc_id"])) for r in got)


def test_ptr_inverse_holds_in_the_tail(spark):
    values = {r["event_id"]: r["value"] for r in table(spark, "/root/testdata/sf0.01", "events").collect()}
    got = {r["event_id"]: r["y"] for r in Q["trf_ptr_inverse_all"](spark, "/root/testdata/sf0.01").collect()}
    assert max(values.values()) > 400 and got.keys() == values.keys()
    assert all(abs(got[i] - v) < 2e-4 for i, v in values.items())


def test_quantile_in_bounded_parts_is_exact(spark):
    import math
    import random

    from pyspark.sql import functions as F

    from sparkassay.functions.ranking import quantile

    rng, inf, nan = random.Random(5), math.inf, math.nan
    wide = [rng.choice([-1, 1]) * 10 ** rng.uniform(-300, 300) for _ in range(40)] + [1.7e308, -1.7e308, 0.0, -0.0, 5e-324]
    cases = [[rng.gauss(0, 1) for _ in range(400)], wide, [7.0] * 50 + [7.0000000000000009] * 50 + [None] * 9, [-inf, -inf, 1.0, 2.0, inf, nan, nan], [3.0], [nan], [None]]
    for values in cases:
        df = spark.createDataFrame([(x,) for x in values], "x double")
        for share in (0.05, 1 / 3, 1.0):
            want = df.agg(F.percentile("x", F.lit(share))).first()[0]
            got = quantile(df, F.col("x"), share, bins=64, few=2)
            assert got == want or math.isnan(got) and math.isnan(want), (values[:5], share)


def test_conformal_width_holds_no_aggregate_of_all_values(spark, monkeypatch):
    from sparkassay.operators import calibrate

    residuals = spark.range(1001).selectExpr("CAST(CASE WHEN id % 2 = 0 THEN id ELSE -id END AS DOUBLE) AS residual")
    monkeypatch.setattr(calibrate.F, "percentile", lambda *_: 1 / 0)
    assert [r["width"] for r in calibrate.conformal_width(residuals, alpha=0.1).collect()] == [1800.0]
    assert [r["width"] for r in calibrate.conformal_width(residuals.limit(0)).collect()] == [None]
