"""Configurations from end to end: descriptors, splits, wrapped estimators, stored models, the command line."""

import json
import math

import pytest
from pyspark.sql import functions as F

from sparkassay import cli
from sparkassay.operators import metrics, select, split
from sparkassay.operators.models import Estimator
from sparkassay.plans import artifact
from sparkassay.plans import config as C
from sparkassay.plans import descriptors as D
from sparkassay.plans import pipeline as P
from sparkassay.plans import search as S

CHAINS = [("C" * n + tail, float(n)) for n in range(1, 13) for tail in ("O", "N", "Cl", "c1ccccc1", "C(=O)O")]


@pytest.fixture(scope="module")
def molecules(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("d") / "m.csv")
    with open(path, "w") as f:
        f.write("smiles,len,aux,flag\n" + "".join(f"{s},{v},{i % 3},{-1 if i % 4 else 1}\n" for i, (s, v) in enumerate(CHAINS)) + "not(a,3.0,1,1\nOC,1.0,0,1\n")
    return path


def data(path, **more):
    return C.Dataset("smiles", "len", path, molecules=True, **({"split": "Random"} | more))


def test_invalid_rows_go_and_equal_molecules_meet(spark, molecules):
    rows = P.prepared(spark, data(molecules))
    assert rows.count() == 60  # CO and OC are one molecule
    assert rows.filter(F.col("key").contains("(a")).count() == 0


@pytest.mark.parametrize("kind,params,test_rows", [("Temporal", {"fraction": 0.25}, 15), ("KFold", {"n_splits": 4}, 15), ("Predefined", {"column_name": "flag"}, 15), ("ScaffoldSplit", {"butina_cluster": 0.0}, None), ("ScaffoldSplit", {}, None), ("Stratified", {"fraction": 0.2, "leave_out": 0.3}, 12)])
def test_splits(spark, molecules, kind, params, test_rows):
    rows = P.prepared(spark, data(molecules, split=kind, split_params=params, deduplication="KeepFirst")).collect()
    n = sum(r["_split"] == "test" for r in rows)
    assert len(rows) == 60 and 0 < n < 60 and (test_rows is None or n == test_rows)
    if kind == "Temporal":
        assert {r["key"] for r in rows if r["_split"] == "test"} == {s for s, _ in CHAINS[45:]}
    if kind == "ScaffoldSplit":
        assert len({r["_split"] for r in rows if "c1" in r["key"]}) == 1
    if kind == "Stratified":
        assert sum(r["_split"] == "unused" for r in rows) == 18


def test_descriptors_by_name(spark, molecules):
    rows = P.prepared(spark, data(molecules))
    made = {"name": "CompositeDescriptor", "parameters": {"descriptors": [{"name": "ECFP", "parameters": {"nBits": 128}}, {"name": "PhyschemDescriptors"}]}}
    out = D.featurised(rows, made)
    assert {r[0] for r in out.select(F.size("features")).distinct().collect()} == {128 + 12}
    scaled = D.featurised(rows, {"name": "PhyschemDescriptors"})
    assert abs(scaled.agg(F.avg(F.get("features", F.lit(0)))).first()[0]) < 1e-9
    with pytest.raises(D.NoVectors):
        D.featurised(rows, {"name": "SmilesFromFile"})


@pytest.mark.parametrize(
    "algorithm,params",
    [("Ridge", {}), ("PLSRegression", {"n_components": 3}), ("KNeighborsRegressor", {"n_neighbors": 3, "weights": "distance"}), ("SVR", {"gamma": 0.01}), ("Mapie", {"estimator": {"name": "Ridge", "params": {"alpha": 0.1}}}), ("RandomForestRegressor", {"n_estimators": 5})],
)
def test_stored_models_answer_alike(spark, molecules, tmp_path, algorithm, params):
    built = P.build(P.prepared(spark, data(molecules)), C.Build(data(molecules), algorithm, params, {"name": "PhyschemDescriptors"}))
    assert set(metrics.REGRESSION) <= set(built.scores["test"])
    asked = spark.createDataFrame([(s,) for s, _ in CHAINS[:8]] + [("no(",), (None,)], "smiles string")
    want = sorted(map(str, built.predict_keys(asked, "smiles").collect()))
    assert sum("prediction=None" in w for w in want) == 2
    artifact.save(built, str(tmp_path / "m"))
    assert sorted(map(str, artifact.load(spark, str(tmp_path / "m")).predict_keys(asked, "smiles").collect())) == want
    if algorithm == "Mapie":
        pool = P.uncertain(built, asked, "smiles", quantile=0.0)
        assert pool.count() == 0  # all widths are the same, none is above


@pytest.mark.parametrize("algorithm,params", [("KNeighborsClassifier", {"n_neighbors": 3}), ("AdaBoostClassifier", {"n_estimators": 3}), ("CalibratedClassifierCVWithVA", {"estimator": {"name": "LogisticRegression"}, "method": "vennabers", "n_folds": 2}), ("CalibratedClassifierCVWithVA", {"estimator": {"name": "KNeighborsClassifier"}, "method": "sigmoid", "n_folds": 2, "ensemble": False})])
def test_classifiers_stored_and_scored(spark, tmp_path, algorithm, params):
    x = spark.range(80).select(F.concat(F.lit("k"), "id").alias("key"), F.array(F.sin("id"), F.cos("id")).alias("v"), (F.sin("id") > 0).alias("m"))
    own = C.Dataset("key", "m", vector_column="v", classification=True, split="Random", deduplication="KeepFirst")
    built = P.build(P.prepared(spark, own, x), C.Build(own, algorithm, params))
    assert set(metrics.CLASSIFICATION) <= set(built.scores["test"]) and built.scores["train"]["roc_auc"] > 0.8
    rows = x.withColumn("features", F.col("v"))
    want = sorted(map(str, built.predict(rows).collect()))
    artifact.save(built, str(tmp_path / "m"))
    assert sorted(map(str, artifact.load(spark, str(tmp_path / "m")).predict(rows).collect())) == want


def test_search_over_descriptors_and_scores(spark, molecules):
    settings = C.Settings(cross_validation=2, n_trials=6, n_startup_trials=6, random_seed=2, scoring="r2")
    chosen = C.Optimization(data(molecules), ["Ridge", "KNeighborsRegressor"], settings, descriptors=[{"name": "PhyschemDescriptors"}, {"name": "SmilesFromFile"}])
    trials = S.optimize(P.prepared(spark, chosen.data), chosen)
    assert any(t.value == -math.inf for t in trials) and S.best(trials).descriptor["name"] == "PhyschemDescriptors"
    assert S.metric_rows(spark, trials).filter("metric = 'r2'").count() == 2 * sum(bool(t.found) for t in trials)
    assert [t.number for t in S.merged_trials([trials, trials])] == list(range(len(trials)))
    assert not chosen.classification
    with pytest.raises(ValueError):
        _ = C.Optimization(data(molecules), ["Ridge", "SVC"]).classification


def test_command_line(spark, molecules, tmp_path, capsys):
    import dataclasses

    given = C.Optimization(data(molecules), ["Ridge"], C.Settings(cross_validation=2, n_trials=2, random_seed=1), descriptors=[{"name": "PhyschemDescriptors"}])
    file, model = tmp_path / "c.json", str(tmp_path / "model")
    file.write_text(json.dumps(dataclasses.asdict(given)))
    cli.main(["optimize", "--config", str(file), "--best-model", model, "--best-config", str(tmp_path / "best"), "--trials", str(tmp_path / "trials")])
    capsys.readouterr()
    cli.main(["predict", "--model", model, "--input-column", "smiles", "CCO", "CCCCO", "x("])
    lines = capsys.readouterr().out.strip().split("\n")
    assert len(lines) == 3 and lines[2].endswith(",") and abs(float(lines[0].split(",")[1]) - 2) < 2
    cli.main(["schemagen", "--kind", "Build"])
    assert json.loads(capsys.readouterr().out)["title"] == "Build"
    assert spark.read.parquet(str(tmp_path / "trials")).count() >= 1


def test_neighbour_votes_by_hand(spark):
    train = spark.createDataFrame([([0.0], 1.0), ([1.0], 0.0), ([1.0], 1.0), ([5.0], 0.0)], "features array<double>, y double")
    asked = spark.createDataFrame([([0.1],), ([1.0],), ([4.0],), (None,), ([1.0, 2.0],)], "features array<double>")
    votes = Estimator("KNeighborsClassifier", {"n_neighbors": 3}).fit(train).transform(asked).collect()
    assert sorted(((r["features"] or [None])[0], len(r["features"] or []), r["prediction"], r["probability"]) for r in votes if r["prediction"] is not None) == [(0.1, 1, 1.0, 2 / 3), (1.0, 1, 1.0, 2 / 3), (4.0, 1, 0.0, 1 / 3)]
    means = Estimator("KNeighborsRegressor", {"n_neighbors": 2, "weights": "distance", "metric": "manhattan"}).fit(train).transform(asked).filter("prediction IS NOT NULL").collect()
    got = {tuple(r["features"]): r["prediction"] for r in means}
    assert got[(1.0,)] == 0.5 and abs(got[(4.0,)] - 0.0) < 1e-12


def test_strata_join_the_bin_before(spark):
    values = [float(i % 20) for i in range(200)] + [100.0, 101.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    edges = split.stratum_edges(df, "v", bins=10)
    assert all(e < 25 for e in edges)  # the outliers' bins have too few rows
    out = split.stratified_split(df, "id", "v", 0.2)
    assert out.filter("_split = 'test'").count() == 41


def test_scores_of_one_class_are_null(spark):
    one = spark.createDataFrame([(1, 0.5, 1), (1, 0.7, 2)], "y int, score double, id int")
    assert metrics.bedroc(one).first()["bedroc"] is None and metrics.ranking(one).first()["roc_auc"] is None
    assert metrics.bedroc(one.limit(0)).first()["bedroc"] is None


def test_cumulative_curve(spark):
    df = spark.createDataFrame([(float(i), i + 0.25) for i in range(31)], "y double, p double")
    rows = metrics.calibration_points(df).orderBy("bin").collect()
    assert len(rows) == 15 and rows[-1]["share_true"] == 1.0 and abs(rows[0]["share_true"] - 2 / 31) < 1e-12 and abs(rows[-1]["share_predicted"] - 30 / 31) < 1e-12


def test_small_selections(spark):
    df = spark.createDataFrame([(i, float(i % 7), float((i * 5) % 11), "ab"[i % 2]) for i in range(60)], "id int, gain double, cost double, task string")
    rows = [r.asDict() for r in df.collect()]
    front = [r["id"] for r in rows if not any(o["gain"] >= r["gain"] and o["cost"] <= r["cost"] and (o["gain"] > r["gain"] or o["cost"] < r["cost"]) for o in rows)]
    assert sorted(r["id"] for r in select.undominated(df, "gain", "cost").collect()) == sorted(front)
    assert [r["task"] for r in select.task_ids(df, "task").collect()] == ["a", "b"] and select.task_slice(df, "task", "a").count() == 30
    h = select.histogram(df, "gain", [0, 2, 4, 6]).orderBy("bin").collect()
    assert [r["n"] for r in h] == [sum(lo <= r["gain"] < hi or (hi == 6 and r["gain"] == 6) for r in rows) for lo, hi in ((0, 2), (2, 4), (4, 6))]
    assert select.first_rows(df, ["gain", "id"]).first()["id"] == 0
    assert select.best(df, F.col("gain"), "id", direction="minimize").first()["best"] == 0
