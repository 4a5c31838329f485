"""Ranks and running totals over a whole table without a single-partition window.

Rows are cut into buckets that follow the order; bucket totals (a bounded table) give each bucket's offset, and
windows run inside buckets only.  Buckets are digits of a hash, or intervals between approximate quantiles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_bucket(digest: Column, digits: int = 2) -> Column:
    """Bucket number from the first hexadecimal digits of a digest; follows its order."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")


def value_bucket(df: DataFrame, value: Column, buckets: int = 64) -> Column:
    """Bucket number by approximate quantiles of a numeric column (at most ``buckets`` edges come to the driver)."""
    wanted = [i / buckets for i in range(1, buckets)]
    edges = df.agg(F.percentile_approx(value.cast("double"), wanted, 2000).alias("e")).first()["e"] or []
    edges = sorted(set(edges))
    if not edges:
        return F.lit(0)
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= value.cast("double")))


def running(df: DataFrame, bucket: Column, order: Sequence[Column], totals: dict[str, Column]) -> DataFrame:
    """Adds columns: sums of ``totals`` over all rows up to and including each, in the given total order."""
    rows = df.withColumn("__b", bucket).withColumns({f"__{n}": c for n, c in totals.items()})
    before = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col("__b").alias("b")).agg(*[F.sum(f"__{n}").alias(n) for n in totals])
    offsets = sums.select("b", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"__o_{n}") for n in totals])
    inside = Window.partitionBy("__b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(F.broadcast(offsets), F.col("__b") == F.col("b"))  # one row per bucket: of bounded size
    return rows.select(*df.columns, *[(F.sum(f"__{n}").over(inside) + F.col(f"__o_{n}")).alias(n) for n in totals])


def ranked(df: DataFrame, bucket: Column, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Adds the 1-based rank in the given total order."""
    return running(df, bucket, order, {name: F.lit(1).cast("long")})


def quantile(df: DataFrame, value: Column, share: float, bins: int = 4096, few: int = 100_000) -> float | None:
    """Exact quantile with linear interpolation over all rows; nulls are left out, NaN is largest, None if there is no row.

    Counts of equal intervals tell which one holds the wanted ranks; that one is cut again, from its least to its largest
    value, until it has one value or at most ``few`` rows.  No task holds more than ``bins`` counts or ``few`` values.
    """
    v, infinite = F.col("v"), float("inf")
    rows = df.select(value.cast("double").alias("v")).filter(v.isNotNull())
    finite = F.when(~F.isnan(v) & (F.abs(v) < infinite), v)
    whole = rows.agg(F.count("*").alias("n"), F.min(finite).alias("low"), F.max(finite).alias("high")).first()
    if not whole["n"]:
        return None
    at = share * (whole["n"] - 1)
    first, second = math.floor(at), math.ceil(at)
    low, high, before = whole["low"], whole["high"], 0
    while True:
        part = F.lit(0)
        if low is not None and low < high:
            half = 0.5 if math.isinf(high - low) else 1.0
            part = F.least(F.floor((v * half - low * half) / (high * half - low * half) * bins), F.lit(bins - 1))
        part = F.when(F.isnan(v), bins + 1).when(v == infinite, bins).when(v == -infinite, -1).otherwise(part)
        counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("part").collect()
        # The bin of the first rank; the second rank is in it, too, or is the least value of the next one.
        i = 0
        while before + counts[i]["n"] <= first:
            before, i = before + counts[i]["n"], i + 1
        n, low, high = counts[i]["n"], counts[i]["low"], counts[i]["high"]
        if before + n <= second:
            a, b = high, counts[i + 1]["low"]
            break
        if low == high or math.isnan(low):
            return low
        rows = rows.filter((v >= low) & (v <= high))
        if n <= few:
            values = sorted(r["v"] for r in rows.collect())
            a, b = values[first - before], values[second - before]
            break
    return a if a == b else (second - at) * a + (at - first) * b
