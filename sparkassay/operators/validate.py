"""Projection, missing values, row issues, gates and assertions on data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.functions.mathx import boolean
from sparkassay.roles import Roles


class NoData(ValueError):
    """Nothing is left to work on."""


class RowIssues(ValueError):
    def __init__(self, message: str, rows: DataFrame) -> None:
        super().__init__(message)
        self.rows = rows


def project(df: DataFrame, roles: Roles) -> DataFrame:
    return df.select(*roles.columns())


def missing(df: DataFrame, name: str) -> Column:
    """Null, or not a number in a floating column."""
    c = F.col(name)
    return c.isNull() | F.isnan(c) if dict(df.dtypes)[name] in ("double", "float") else c.isNull()


def drop_missing(df: DataFrame, names: list[str]) -> DataFrame:
    for n in names:
        df = df.filter(~missing(df, n))
    return df


def require_rows(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise NoData(f"no rows left: {what}")
    return df


def coerced(response: Column, classification: bool) -> Column:
    return boolean(response).cast("double") if classification else response.try_cast("double")


def row_issues(df: DataFrame, response: str, classification: bool, line: str) -> DataFrame:
    """Rows whose response is present but cannot be read; ``line`` is their 1-based number."""
    c = F.col(response)
    return df.filter(c.isNotNull() & coerced(c, classification).isNull()).select(F.col(line).alias("line_number"), *[x for x in df.columns if x != line])


def read_response(df: DataFrame, response: str, classification: bool, line: str) -> DataFrame:
    bad = row_issues(df, response, classification, line)
    if not bad.isEmpty():
        raise RowIssues("responses that cannot be read", bad)
    return df.withColumn(response, coerced(F.col(response), classification))


def with_groups(df: DataFrame, groups: DataFrame, key: str, group: str) -> DataFrame:
    """Rows whose key has a group, with it; the groups table has unique keys."""
    return df.join(groups.select(key, group).filter(F.col(group).isNotNull()), key)


def finite(df: DataFrame, name: str) -> DataFrame:
    c = F.col(name)
    return df.filter(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))


def with_features(df: DataFrame, features: str = "features") -> DataFrame:
    """Rows whose features could be computed."""
    return df.filter(F.col(features).isNotNull() & ~F.exists(features, lambda x: x.isNull() | F.isnan(x)))


def within(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """Gate on properties: each named column at most its limit."""
    for name, top in limits.items():
        df = df.filter(F.col(name) <= top)
    return df


def select_uncertain(df: DataFrame, uncertainty: str, quantile: float = 0.5) -> DataFrame:
    """Rows strictly above the quantile of uncertainty, most uncertain first (candidates for measurement)."""
    level = df.agg(F.percentile(uncertainty, F.lit(quantile))).scalar()
    return df.filter(F.col(uncertainty) > level).orderBy(F.desc(uncertainty))


def set_problems(df: DataFrame, response: str, classification: bool) -> DataFrame:
    """One row: n, distinct responses, and what is wrong with the set (null if nothing)."""
    x = df.agg(F.count("*").alias("n"), F.count_distinct(response).alias("values"))
    wrong = F.when(F.col("n") == 0, "empty").when(F.lit(classification) & (F.col("values") != 2), "not two classes").when(F.lit(not classification) & (F.col("values") < 5), "fewer than five values")
    return x.withColumn("problem", wrong)


def check_set(df: DataFrame, response: str, classification: bool) -> DataFrame:
    problem = set_problems(df, response, classification).first()["problem"]
    if problem:
        raise NoData(problem)
    return df
