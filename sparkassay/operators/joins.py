"""Lookups as joins, unions and incremental merges, quorum and replicate statistics, side information."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.operators.dedup import keep_first


def lookup(df: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Left join with a table of unique keys; the engine broadcasts it where its size allows."""
    return df.join(table, key, "left")


def first_match(df: DataFrame, table: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Left join in which the first matching row, in ``order``, wins."""
    return df.join(keep_first(table, [key], order), key, "left")


def vectors_or_nan(df: DataFrame, table: DataFrame, key: str, vector: str, width: int, order: Sequence[str]) -> DataFrame:
    """As first_match; keys without a row get a vector of NaN."""
    return first_match(df, table.select(key, vector, *order), key, order).withColumn(vector, F.coalesce(vector, F.array_repeat(F.lit(float("nan")), width))).drop(*order)


def outer_merge(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "full")


def unseen(df: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    return df.join(ledger.select(key), key, "left_anti")


def merge_sets(train: DataFrame, test: DataFrame) -> DataFrame:
    return train.unionByName(test)


def merge_incremental(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows and those new ones whose keys the old rows lack, one per key."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"))


def with_originals(df: DataFrame, canonical: DataFrame, subset: Sequence[str]) -> DataFrame:
    """Original and canonicalised rows, distinct on ``subset``."""
    return df.unionByName(canonical).dropDuplicates(list(subset))


def quorum(df: DataFrame, task: str, key: str, value: str, least: int = 25) -> DataFrame:
    """Tasks with enough keys whose mean values differ: n, mad (mean absolute deviation of the means), met."""
    means = df.groupBy(task, key).agg(F.avg(value).alias("m"))
    centre = means.groupBy(task).agg(F.count("*").alias("n"), F.avg("m").alias("c"))
    mad = means.join(centre, task).groupBy(task, "n").agg(F.avg(F.abs(F.col("m") - F.col("c"))).alias("mad"))
    return mad.withColumn("met", (F.col("n") >= least) & (F.col("mad") > 0))


def replicates(df: DataFrame, key: str, value: str) -> DataFrame:
    """Spread and middle of repeated measurements per key."""
    return df.groupBy(key).agg(F.stddev_samp(value).alias("std"), F.median(value).alias("median"), F.count("*").alias("n"))


def unpivoted(df: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    return df.select(key, F.posexplode(F.array(*[F.col(c).cast("double") for c in names])).alias("col", "value"))


def scaler(df: DataFrame, vector: str) -> DataFrame:
    """Per dimension: mean and population standard deviation."""
    return df.select(F.posexplode(vector).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))


def scaled(df: DataFrame, vector: str, fitted: DataFrame) -> DataFrame:
    """Standardised vectors by fitted dimensions (one row per dimension); constant ones are only centred."""
    rows = sorted(fitted.collect(), key=lambda r: r["dim"])
    mean, std = F.array(*[F.lit(r["mean"]) for r in rows]), F.array(*[F.lit(r["std"] or 1.0) for r in rows])
    return df.withColumn(vector, F.zip_with(F.zip_with(vector, mean, lambda x, m: x - m), std, lambda x, s: x / s))


def correlated(df: DataFrame, names: Sequence[str], limit: float = 0.9) -> list[str]:
    """Columns to drop: each whose |r| with an earlier one exceeds the limit.  All pairs in one pass."""
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    x = df.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    return [c for c in names if any(b == c and abs(x[str(i)] or 0) > limit for i, (a, b) in enumerate(pairs))]


def side_information(df: DataFrame, names: Sequence[str], low: float, high: float, least_mad: float = 0.1, limit: float = 0.9) -> list[str]:
    """Auxiliary task columns worth keeping: some variance, spread enough after scaling to [low, high], not redundant."""
    s = df.agg(*[f(c).alias(f"{n}_{c}") for c in names for n, f in (("v", F.var_pop), ("a", F.min), ("b", F.max))]).first()
    names = [c for c in names if (s[f"v_{c}"] or 0) > 0]
    scale = {c: (F.col(c) - s[f"a_{c}"]) / (s[f"b_{c}"] - s[f"a_{c}"]) * (high - low) + low for c in names}
    if not names:
        return []
    means = df.agg(*[F.avg(scale[c]).alias(c) for c in names]).first()
    mad = df.agg(*[F.avg(F.abs(scale[c] - means[c])).alias(c) for c in names]).first()
    names = [c for c in names if mad[c] > least_mad]
    gone = correlated(df, names, limit) if len(names) > 1 else []
    return [c for c in names if c not in gone]


def binarised(df: DataFrame, names: Sequence[str], classification: bool) -> DataFrame:
    """Strings to codes in alphabetical order; for classification each column to whether it exceeds its mean; nulls stay."""
    kinds = dict(df.dtypes)
    for c in names:
        if kinds[c] == "string":
            codes = df.select(F.col(c).alias("__c")).filter(F.col(c).isNotNull()).distinct()
            codes = codes.withColumn("__code", (F.row_number().over(Window.orderBy("__c")) - 1).cast("double"))  # a window over categories, not rows
            df = df.join(codes, F.col(c) == F.col("__c"), "left").withColumn(c, F.col("__code")).drop("__c", "__code")
        else:
            df = df.withColumn(c, F.col(c).cast("double"))
    if classification:
        means = df.agg(*[F.avg(c).alias(c) for c in names]).first()
        df = df.withColumns({c: (F.col(c) > means[c]).cast("double") for c in names})
    return df


def eliminated(df: DataFrame, names: Sequence[str], response: str, share: float = 0.1) -> list[str]:
    """Recursive elimination: the columns left when a ridge model's least weights have gone, a tenth at a time, down to ``share``."""
    from sparkassay.operators.models import Estimator

    names, least = list(names), max(1, round(len(names) * share))
    spread = df.agg(*[F.stddev_pop(c).alias(c) for c in names]).first()
    while len(names) > least:
        m = Estimator("Ridge", {"alpha": 1.0}).fit(df.select(F.array(*[F.col(c).cast("double") for c in names]).alias("features"), F.col(response).cast("double").alias("y")).na.drop())
        weight = {c: abs(float(w)) * (spread[c] or 0.0) for c, w in zip(names, m.model.coefficients, strict=True)}
        gone = sorted(names, key=lambda c: (weight[c], c))[: max(1, min(len(names) - least, len(names) // 10))]
        names = [c for c in names if c not in gone]
    return names
