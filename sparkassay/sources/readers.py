"""Scans.  Only named columns survive; schemas are explicit where given and strings are cast afterwards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UnsupportedFormat(ValueError):
    pass


class MissingColumns(ValueError):
    def __init__(self, names: list[str]) -> None:
        super().__init__("missing columns: " + ", ".join(names))
        self.names = names


def read_table(spark: SparkSession, path: str | None, schema: T.StructType | None = None) -> DataFrame:
    """CSV, SDF or Parquet by suffix; no path gives an empty table of ``schema``."""
    if path is None:
        return spark.createDataFrame([], schema or T.StructType([]))
    lower = path.lower().rstrip("/")
    if lower.endswith((".csv", ".csv.gz")):
        return read_csv(spark, path, schema)
    if lower.endswith(".sdf"):
        return read_sdf(spark, path)
    if lower.endswith(".parquet"):
        return spark.read.parquet(path)
    raise UnsupportedFormat(f"neither CSV, SDF nor Parquet: {path}")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, multi_line: bool = False) -> DataFrame:
    """UTF-8, or Latin-1 where a line is no valid UTF-8; blanks before values are dropped.

    Lines are read apart, so large files are split; ``multi_line`` reads values that hold line breaks, a file per task.
    """
    options = {"header": True, "ignoreLeadingWhiteSpace": True, "multiLine": multi_line, "escape": '"'}
    bad = spark.read.text(path).filter(~F.is_valid_utf8("value")).limit(1)
    encoding = "UTF-8" if bad.isEmpty() else "ISO-8859-1"
    reader = spark.read.options(**options, encoding=encoding)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_columns(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Named columns as strings; malformed lines and rows with missing values are dropped."""
    header = spark.read.option("header", True).csv(path).columns
    require_columns(header, names)
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(schema).options(header=True, mode="DROPMALFORMED", encoding="ISO-8859-1").csv(path).select(*names).na.drop()


def require_columns(header: Sequence[str], names: Sequence[str]) -> None:
    lacking = [n for n in names if n not in header]
    if lacking:
        raise MissingColumns(lacking)


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """Structure-data records: name, molblock and a map of their properties, split by the record mark."""
    rows = spark.read.option("lineSep", "$$$$\n").text(path).filter(F.trim("value") != "")
    text = F.regexp_replace("value", "\r", "")
    pairs = F.regexp_extract_all(text, F.lit(r"> *<([^>]+)>[^\n]*\n((?:[^\n]+\n?)*)"), F.lit(1))
    values = F.transform(F.regexp_extract_all(text, F.lit(r"> *<([^>]+)>[^\n]*\n((?:[^\n]+\n?)*)"), F.lit(2)), lambda x: F.rtrim(F.regexp_replace(x, "\n$", "")))
    return rows.select(F.trim(F.substring_index(text, "\n", 1)).alias("name"), F.regexp_extract(text, r"(?s)^(.*?M  END)", 1).alias("molblock"), F.map_from_arrays(pairs, values).alias("properties"))


def dated(name: Column) -> Column:
    """Date from any dot-separated part of a file name that is one (yyyy-MM-dd); null if none is."""
    stem = F.element_at(F.split(name, "/"), -1)
    found = F.filter(F.split(stem, r"\."), lambda p: p.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(p, F.lit("yyyy-MM-dd")).isNotNull())
    return F.to_date(F.get(found, F.lit(0)))


def dated_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bucket date) of the files a pattern names, in date order; undated files go by modification time."""
    files = spark.read.format("binaryFile").load(pattern).select("path", "modificationTime")
    out = files.select("path", F.coalesce(dated(F.col("path")), F.to_date("modificationTime")).alias("bucket")).orderBy("bucket", "path")
    if out.isEmpty():
        raise FileNotFoundError(pattern)
    return out


def inline(spark: SparkSession, values: Sequence[str], name: str = "key") -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"`{name}` string")


def numbered(df: DataFrame, name: str = "_line") -> DataFrame:
    """Rows with their 1-based place in the scan: counts per partition give each one's offset."""
    from sparkassay.functions.ranking import ranked

    rows = df.withColumn("__m", F.monotonically_increasing_id())
    return ranked(rows, F.shiftright("__m", 33).cast("int"), [F.col("__m")], name).drop("__m")


def side_information_file(df: DataFrame, key: str, canonical: Column | None = None) -> DataFrame:
    """(key, one column per task): all columns but the key are tasks; rows under the key as given and as canonicalised, no row twice."""
    tasks = [F.col(c).alias(c) for c in df.columns if c != key]
    rows = df.select(F.col(key).alias("key"), *tasks)
    if canonical is not None:
        rows = rows.unionByName(df.select(canonical.alias("key"), *tasks))
    return rows.filter(F.col("key").isNotNull()).distinct()


def vector_file(df: DataFrame, key: str, vector: str, canonical: Column | None = None, delimiter: str = ",") -> DataFrame:
    """(key, features): parsed vectors under the key as given and, if another, as canonicalised; nulls and repeats go."""
    from sparkassay.functions.mathx import vector as parsed

    rows = df.select(F.col(key).alias("key"), parsed(F.col(vector), delimiter).alias("features"))
    if canonical is not None:
        rows = rows.unionByName(df.select(canonical.alias("key"), parsed(F.col(vector), delimiter).alias("features")))
    return rows.na.drop().dropDuplicates(["key"])
