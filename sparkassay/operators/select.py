"""Rows chosen by flag, task or order, and small aggregates that stand alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkassay.functions.ranking import value_bucket


def task_slice(df: DataFrame, task: str, code) -> DataFrame:
    """Rows of one task; on a table partitioned by task only its files are read."""
    return df.filter(F.col(task) == F.lit(code))


def flagged(df: DataFrame, flag: str, value: int = 1) -> DataFrame:
    """Rows whose split flag is ``value``: 1 marks those to predict."""
    return df.filter(F.col(flag) == value)


def task_ids(df: DataFrame, task: str) -> DataFrame:
    """Distinct tasks in order; null is none."""
    return df.select(task).filter(F.col(task).isNotNull()).distinct().orderBy(task)


def first_rows(df: DataFrame, order: Sequence[str], n: int = 1) -> DataFrame:
    """The first n rows in a total order, as background for an explanation: a top-n, not a sort of all rows."""
    return df.orderBy(*order).limit(n)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.distinct()


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """Explanations of several models or descriptors below each other; columns that one lacks are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def representative_key(original: Column, canonical: Column, kept: bool) -> Column:
    """The key as it was read where the strategy keeps a row as it is, else its canonical form (or, without one, as read)."""
    return original if kept else F.coalesce(canonical, original)


def value_counts(df: DataFrame, name: str) -> DataFrame:
    """(value, n), nulls counted too."""
    return df.groupBy(name).agg(F.count("*").alias("n"))


def quantile(df: DataFrame, value: str, share: float, by: Sequence[str] = ()) -> DataFrame:
    """Exact quantile with linear interpolation, per group if ``by`` names columns."""
    return df.groupBy(*by).agg(F.percentile(value, F.lit(share)).alias("q"))


def correlation(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(a, b, r) for pairs of columns, in one pass."""
    x = df.agg(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("r")) for a, b in pairs]).alias("x"))
    return x.select(F.explode("x").alias("x")).select("x.*")


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """Number of the interval [edge, next edge) from 0, the last one closed; null outside."""
    at = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e <= value)) - 1
    last = len(edges) - 2
    return F.when((value >= edges[0]) & (value <= edges[-1]), F.least(at, F.lit(last)))


def histogram(df: DataFrame, value: str, edges: Sequence[float], weight: str | None = None) -> DataFrame:
    """(bin, low, high, n) of every interval, empty ones too; n is the sum of weights where these are given."""
    low, high = (F.array(*[F.lit(float(e)) for e in part]) for part in (edges[:-1], edges[1:]))
    n = F.sum(weight) if weight else F.count("*")
    found = df.groupBy(bin_of(F.col(value), edges).alias("bin")).agg(n.alias("n")).filter(F.col("bin").isNotNull())
    bins = df.sparkSession.range(len(edges) - 1).select(F.col("id").cast("int").alias("bin"))
    out = bins.join(found, "bin", "left")
    return out.select("bin", F.element_at(low, F.col("bin") + 1).alias("low"), F.element_at(high, F.col("bin") + 1).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def best(df: DataFrame, value: Column, name: str, by: Sequence[str] = (), direction: str = "maximize") -> DataFrame:
    """``name`` of the row with the best value, per group if ``by`` names columns; ties to the smallest name."""
    sign = 1 if direction == "maximize" else -1
    return df.groupBy(*by).agg(F.min(F.struct((-sign * value).alias("v"), F.col(name).alias("n"))).alias("__b")).select(*by, F.col("__b.n").alias("best"))


def undominated(df: DataFrame, gain: str, cost: str) -> DataFrame:
    """Rows that no other row dominates: none has as much gain for as little cost, and one of them better.

    The best gain of each cost, then its running maximum over rising cost, in buckets of costs: no window spans the table.
    """
    tops = df.groupBy(F.col(cost).alias("__c")).agg(F.max(gain).alias("__top"))
    tops = tops.withColumn("__b", value_bucket(tops, F.col("__c")))
    earlier = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # over one row per bucket
    buckets = tops.groupBy(F.col("__b").alias("b")).agg(F.max("__top").alias("m")).select("b", F.max("m").over(earlier).alias("__before"))
    inside = Window.partitionBy("__b").orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.join(F.broadcast(buckets), F.col("__b") == F.col("b"))  # as many rows as buckets
    tops = tops.withColumn("__best", F.greatest(F.max("__top").over(inside), F.col("__before")))
    front = tops.filter(F.col("__best").isNull() | (F.col("__top") > F.col("__best"))).select("__c", "__top")
    return df.join(front, (F.col(cost) == F.col("__c")) & (F.col(gain) == F.col("__top"))).select(*df.columns)
