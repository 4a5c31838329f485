"""Collapsing replicate rows of one key.

Aggregating strategies are one hash aggregate with map-side combination.  The keeping ones take the least or
greatest row as a struct, which combines map-side too, where a ranking window would send all rows of a hot key
to one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.functions.mathx import hashed


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that comes first in ``order``, which must be total among its rows."""
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.min(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("r"))).alias("t"))
    return top.select(*keys, *[F.col(f"t.r.{c}") for c in rest]).select(*df.columns)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    top = df.groupBy(*keys).agg(F.max(F.struct(*[F.col(o).alias(f"o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("r"))).alias("t"))
    return top.select(*keys, *[F.col(f"t.r.{c}") for c in rest]).select(*df.columns)


def keep_random(df: DataFrame, keys: Sequence[str], order: Sequence[str], seed: int = 42) -> DataFrame:
    """A row of each key chosen by a seeded hash of its ``order`` columns, which tell its rows apart."""
    marked = df.withColumn("__h", hashed(seed, *[F.col(o) for o in order]))
    return keep_first(marked, keys, ["__h", *order]).drop("__h")


def _aggregated(df: DataFrame, keys: Sequence[str], value: str, how) -> DataFrame:
    return df.groupBy(*keys).agg(how(value).alias(value))


def keep_min(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return _aggregated(df, keys, value, F.min)


def keep_max(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return _aggregated(df, keys, value, F.max)


def keep_avg(df: DataFrame, keys: Sequence[str], value: str, scale: int | None = None) -> DataFrame:
    """Mean; with ``scale`` the sum is exact in decimals of so many places, so it does not depend on row order."""
    if scale is None:
        return _aggregated(df, keys, value, F.avg)
    return _aggregated(df, keys, value, lambda v: F.sum(F.col(v).cast(f"decimal(18,{scale})")).cast("double") / F.count(v))


def keep_median(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    return _aggregated(df, keys, value, F.median)


def keep_all(df: DataFrame) -> DataFrame:
    return df


def vote(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Majority class of 0/1 responses; a tie is 1."""
    return df.groupBy(*keys).agg((F.avg(F.col(value).cast("double")) >= 0.5).cast("int").alias(value))


def with_last_group(df: DataFrame, source: DataFrame, key: str, group: str, order: str) -> DataFrame:
    """Attach to each key the group of its last row in ``source``."""
    return df.join(source.groupBy(key).agg(F.max_by(group, order).alias(group)), key, "left")


STRATEGIES = {"KeepFirst": keep_first, "KeepLast": keep_last, "KeepRandom": keep_random, "KeepMin": keep_min, "KeepMax": keep_max, "KeepAvg": keep_avg, "KeepMedian": keep_median, "KeepAllNoDeduplication": keep_all}
