"""Train/test splits and folds.

Random choices are orders of a seeded MD5 of the row's key: the same rows are chosen on any cluster.  Ranks over the
whole table go through functions.ranking, so no window runs in a single partition.  Results carry ``_split``
(train, test, unused) or ``_fold``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.functions.mathx import hashed
from sparkassay.functions.ranking import hash_bucket, ranked, value_bucket
from sparkassay.operators import select


def _labelled(test: Column, train: Column) -> Column:
    return F.when(test, "test").when(train, "train").otherwise("unused")


def random_split(df: DataFrame, key: str, fraction: float = 0.2, seed: int = 1, leave_out: float = 0.0) -> DataFrame:
    """ceil(n * fraction) rows test, floor(n * (1 - fraction - leave_out)) train, the others unused.  Keys are unique."""
    n = df.count()
    test, train = _ceil(n * fraction), _floor(n * (1 - fraction - leave_out)) if leave_out else n
    rows = df.withColumn("__h", hashed(seed, F.col(key)))
    rows = ranked(rows, hash_bucket(F.col("__h")), [F.col("__h"), F.col(key)], "__rank")
    return rows.withColumn("_split", _labelled(F.col("__rank") <= test, F.col("__rank") <= test + train)).drop("__h", "__rank")


def _ceil(x: float) -> int:
    import math

    return math.ceil(x - 1e-9)


def _floor(x: float) -> int:
    import math

    return math.floor(x + 1e-9)


def temporal_split(df: DataFrame, time: str, tie: str, fraction: float = 0.2) -> DataFrame:
    """The first floor(n * (1 - fraction)) rows by time train, later ones test."""
    n = df.count()
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    rows = ranked(df, value_bucket(df, seconds), [F.col(time), F.col(tie)], "__rank")
    return rows.withColumn("_split", F.when(F.col("__rank") <= _floor(n * (1 - fraction)), "train").otherwise("test")).drop("__rank")


def no_split(df: DataFrame) -> DataFrame:
    return df.withColumn("_split", F.lit("train"))


def k_folds(df: DataFrame, key: str, folds: int = 5, seed: int = 1) -> DataFrame:
    """Fold numbers from 0; the first n mod k folds have one row more."""
    n = df.count()
    small, more = divmod(n, folds)
    rows = df.withColumn("__h", hashed(seed, F.col(key)))
    rows = ranked(rows, hash_bucket(F.col("__h")), [F.col("__h"), F.col(key)], "__rank")
    at = F.col("__rank") - 1
    fold = F.when(at < more * (small + 1), F.floor(at / (small + 1))).otherwise(more + F.floor((at - more * (small + 1)) / max(small, 1)))
    return rows.withColumn("_fold", fold.cast("int")).drop("__h", "__rank")


def cv_folds(df: DataFrame, key: str, splits: int = 5, fraction: float = 0.2, seed: int = 1) -> list[DataFrame]:
    """Independent random splits for cross-validation."""
    return [random_split(df, key, fraction, seed + i) for i in range(splits)]


def class_folds(df: DataFrame, key: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Stratified folds: each class dealt out in hashed order.  Ranks run in (class, hash bucket) windows."""
    rows = df.withColumn("__h", hashed(seed, F.col(key)))
    rows = _ranked_within(rows, F.col(label), "__rank", key)
    return rows.withColumn("_fold", ((F.col("__rank") - 1) % folds).cast("int")).drop("__h", "__rank")


def _ranked_within(rows: DataFrame, stratum: Column, name: str, key: str) -> DataFrame:
    """Rank by ``__h`` within a stratum, through hash buckets, so that a large stratum fills many tasks."""
    rows = rows.withColumns({"__s": stratum, "__b": hash_bucket(F.col("__h"))})
    counts = rows.groupBy("__s", "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("__s").alias("s"), F.col("__b").alias("b"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    rows = rows.join(counts, rows["__s"].eqNullSafe(F.col("s")) & (rows["__b"] == F.col("b")))
    inside = Window.partitionBy("__s", "__b").orderBy("__h", key)
    return rows.withColumn(name, F.row_number().over(inside) + F.col("__o")).drop("__s", "__b", "s", "b", "__o")


def width_fd(df: DataFrame, value: str) -> float:
    """Freedman-Diaconis bin width: 2 * IQR / n^(1/3)."""
    x = df.agg(F.percentile(value, F.lit(0.75)).alias("u"), F.percentile(value, F.lit(0.25)).alias("l"), F.count(value).alias("n")).first()
    return 2 * (x["u"] - x["l"]) / x["n"] ** (1 / 3) if x["n"] else 0.0


def fd_edges(df: DataFrame, value: str) -> list[float]:
    """Edges of Freedman-Diaconis bins, both edges of each bin that has rows: runs of empty bins are one bin.

    Only distinct bins come to the driver, at most as many as the value's range has widths.
    """
    width = width_fd(df, value)
    ends = df.agg(F.min(value).cast("double").alias("a"), F.max(value).cast("double").alias("b")).first()
    if not width or ends["a"] is None:
        return []
    at = F.floor((F.col(value) - F.lit(ends["a"])) / F.lit(width))
    bins = sorted(r["b"] for r in df.filter(F.col(value).isNotNull()).select(at.alias("b")).distinct().collect())
    return [ends["a"] + b * width for b in sorted({x for b in bins for x in (b, b + 1)})] + [ends["b"] + width]


def uniform_edges(df: DataFrame, value: str, bins: int) -> list[float]:
    ends = df.agg(F.min(value).cast("double").alias("a"), F.max(value).cast("double").alias("b")).first()
    if ends["a"] is None:
        return []
    return [ends["a"] + (ends["b"] - ends["a"]) * i / bins for i in range(bins)] + [ends["b"]]


def stratum_edges(df: DataFrame, value: str, least: int = 10, bins: str | int = "fd_merge") -> list[float]:
    """Edges between strata: of histogram bins with fewer than ``least`` rows the left edge goes, so that they join the
    bin before; if the first bin has at most ``least``, so does the first edge left."""
    edges = uniform_edges(df, value, bins) if isinstance(bins, int) else fd_edges(df, value)
    if len(edges) < 2 or edges[0] == edges[-1]:
        return []
    filled = {r["bin"]: r["n"] for r in select.histogram(df.select(value), value, edges).collect()}  # one row per bin
    kept = [e for i, e in enumerate(edges[:-1]) if filled[i] >= least] + edges[-1:]
    if filled[0] <= least:
        kept = kept[1:]
    # The outermost edges take in the least and the greatest value.
    return [e if e != edges[0] else float("-inf") for e in kept if e != edges[-1]]


def stratum(value: Column, edges: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= value)) if edges else F.lit(0)


def stratified_split(df: DataFrame, key: str, value: str, fraction: float = 0.2, seed: int = 1, binned: bool = True, leave_out: float = 0.0, bins: str | int = "fd_merge") -> DataFrame:
    """ceil(n * fraction) test rows, shared out over the strata by largest remainder; with ``leave_out`` then
    floor(n * (1 - fraction - leave_out)) train rows, shared out likewise, and the others unused."""
    rows = df.withColumn("__g", stratum(F.col(value), stratum_edges(df, value, bins=bins)) if binned else F.col(value))
    counts = {r["__g"]: r["n"] for r in rows.groupBy("__g").agg(F.count("*").alias("n")).collect()}  # one row per stratum
    n = sum(counts.values())
    test = _shared(counts, counts, _ceil(n * fraction))
    left = {g: counts[g] - test[g] for g in counts}
    train = _shared(counts, left, _floor(n * (1 - fraction - leave_out))) if leave_out else left
    rows = _ranked_within(rows.withColumn("__h", hashed(seed, F.col(key))), F.col("__g"), "__rank", key)
    quota = lambda given: F.element_at(F.create_map(*[F.lit(x) for g, k in given.items() for x in (g, k)]), F.col("__g"))
    if not counts:
        return df.withColumn("_split", F.lit("train"))
    return rows.withColumn("_split", _labelled(F.col("__rank") <= quota(test), F.col("__rank") <= quota({g: test[g] + train[g] for g in counts}))).drop("__g", "__h", "__rank")


def _shared(counts: dict, room: dict, wanted: int) -> dict:
    """``wanted`` rows over strata in proportion to their size, by largest remainder, none beyond its room."""
    n = max(1, sum(counts.values()))
    given = {g: min(room[g], _floor(c * wanted / n)) for g, c in counts.items()}
    order = sorted(counts, key=lambda g: (-(counts[g] * wanted / n - given[g]), g))
    while (rest := wanted - sum(given.values())) > 0 and (open_ := [g for g in order if given[g] < room[g]]):
        for g in open_[:rest]:
            given[g] += 1
    return given


def predefined_split(df: DataFrame, column: str) -> DataFrame:
    """Numbered folds in a column: the least non-negative is the test set, -1 always trains, null goes."""
    first = df.agg(F.min(F.when(F.col(column) >= 0, F.col(column)))).scalar()
    return df.filter(F.col(column).isNotNull()).withColumn("_split", F.when(F.col(column) == first, "test").otherwise("train"))


def prospective_flags(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows -1 (train only), new rows 1 (to predict)."""
    return old.withColumn("_flag", F.lit(-1)).unionByName(new.withColumn("_flag", F.lit(1)))


def group_folds(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Stratified group folds: whole groups, so placed that classes stay even.

    Group counts are aggregated first; the greedy placement, sequential by nature, sees one row per group.
    """
    import pandas as pd

    counts = df.groupBy(group, label).count().groupBy(group).agg(F.collect_list(F.struct(F.col(label).cast("string").alias("y"), "count")).alias("c"))
    counts = counts.withColumn("__h", hashed(seed, F.col(group)))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        labels = sorted({x["y"] for c in rows["c"] for x in c}, key=str)
        table = [[next((x["count"] for x in c if x["y"] == y), 0) for y in labels] for c in rows["c"]]
        totals = [max(1, sum(t[j] for t in table)) for j in range(len(labels))]
        order = sorted(range(len(table)), key=lambda i: (-_spread(table[i]), rows["__h"].iloc[i]))
        filled = [[0] * len(labels) for _ in range(folds)]
        fold = [0] * len(table)
        for i in order:

            def uneven(f: int, i=i) -> tuple:
                shares = [[(filled[k][j] + (table[i][j] if k == f else 0)) / totals[j] for k in range(folds)] for j in range(len(labels))]
                return sum(_spread(s) for s in shares), sum(filled[f]), f

            fold[i] = min(range(folds), key=uneven)
            filled[fold[i]] = [a + b for a, b in zip(filled[fold[i]], table[i], strict=True)]
        return pd.DataFrame({group: rows[group], "_fold": fold})

    kind = dict(df.dtypes)[group]
    placed = counts.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(place, f"`{group}` {kind}, _fold int")
    return df.join(placed, group)


def _spread(x: list[float]) -> float:
    mean = sum(x) / len(x)
    return (sum((v - mean) ** 2 for v in x) / len(x)) ** 0.5


def group_split(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """First of the stratified group folds is the test set."""
    return group_folds(df, group, label, folds, seed).withColumn("_split", F.when(F.col("_fold") == 0, "test").otherwise("train")).drop("_fold")


def scaffold_split(df: DataFrame, key: str, value: str, scaffold: str, classification: bool = False, cluster: float = 0.4, bits: str | None = None, bins: str | int = "fd_merge", folds: int = 5, seed: int = 42) -> DataFrame:
    """Whole scaffolds to one side: the first of the stratified group folds over scaffolds is the test set.

    With ``cluster`` above zero, scaffolds whose fingerprints (packed in ``bits``, one per scaffold) are at most so far
    apart share a group: those of their Butina cluster.  Rows without a scaffold are of one group.  Strata are the
    classes, or histogram bins of a continuous response.
    """
    rows = df.withColumn("__scaffold", F.coalesce(F.col(scaffold), F.lit("")))
    if cluster > 0 and bits:
        each = rows.groupBy("__scaffold").agg(F.first(bits).alias("__bits"))
        near = tanimoto_pairs(each.filter(F.col("__bits").isNotNull()), "__scaffold", "__bits", 1 - cluster)
        rows = rows.join(butina(near, each.select("__scaffold"), "__scaffold"), "__scaffold").withColumnRenamed("cluster", "__group")
    else:
        rows = rows.withColumn("__group", F.col("__scaffold"))
    rows = rows.withColumn("__stratum", F.col(value) if classification else stratum(F.col(value), stratum_edges(df, value, bins=bins)))
    return group_split(rows, "__group", "__stratum", folds, seed).select(*df.columns, "_split")


def popcount(bits: Column) -> Column:
    return F.aggregate(bits, F.lit(0), lambda a, x: a + F.bit_count(x))


def tanimoto_pairs(df: DataFrame, key: str, bits: str, least: float = 0.0) -> DataFrame:
    """(a, b, similarity) of packed bit strings (arrays of long), a < b: comparison in blocks of hashed keys: each row is dealt to the block pairs it belongs to."""
    import math

    blocks = max(1, math.ceil(df.count() / 4096))
    rows = df.select(F.col(key).alias("k"), F.col(bits).alias("v"), F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("b"))
    pairs = F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(o, F.col("b")).alias("p"), F.greatest(o, F.col("b")).alias("q"))))
    dealt = rows.select("k", "v", "b", pairs.alias("c")).select("k", "v", "b", "c.p", "c.q")
    left, right = (dealt.select("p", "q", F.col("b").alias(f"b{n}"), F.col("k").alias(n), F.col("v").alias(f"v{n}")) for n in "ab")
    # Within a block pair only pairs across the two blocks (or inside a block met with itself) count.
    met = left.join(right, ["p", "q"]).filter((F.col("a") < F.col("b")) & ((F.col("p") == F.col("q")) | (F.col("ba") != F.col("bb"))))
    both = popcount(F.zip_with("va", "vb", lambda x, y: x.bitwiseAND(y)))
    some = popcount(F.zip_with("va", "vb", lambda x, y: x.bitwiseOR(y)))
    return met.select("a", "b", F.when(some == 0, F.lit(0.0)).otherwise(both / some).alias("similarity")).filter(F.col("similarity") >= least)


def butina(pairs: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Clusters from neighbour pairs (a, b): the row with most unassigned neighbours leads, repeatedly; numbered from 1.

    Neighbour lists go to one task, as the greedy order is sequential: the caller bounds them by the cutoff.
    """
    import pandas as pd

    both = pairs.select("a", "b").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lists = keys.select(F.col(key).alias("a")).join(both.groupBy("a").agg(F.collect_set("b").alias("n")), "a", "left")

    def lead(rows: pd.DataFrame) -> pd.DataFrame:
        near = {a: set(n) if n is not None else set() for a, n in zip(rows["a"], rows["n"], strict=True)}
        out, number = {}, 0
        for a in sorted(near, key=lambda x: (-len(near[x]), x)):
            if a in out:
                continue
            number += 1
            for m in [a, *near[a]]:
                out.setdefault(m, number)
        return pd.DataFrame({key: list(out), "cluster": list(out.values())})

    return lists.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(lead, f"`{key}` {dict(keys.dtypes)[key]}, cluster int")
