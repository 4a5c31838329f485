"""What several corpus operators share: the shared folder, staged tables, and connected components.

Staged tables cut lineage and survive the loss of executors: they are plain Parquet below the folder
that ``spark.checkpoint.dir`` names.  Only where that setting is absent and the master is local (tests) is a
temporary folder made.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors can read and write."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="sparkassay-")
    return _LOCAL["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sparkassay/{uuid.uuid4().hex}/{name}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, path: str) -> None:
    """Delete files below the shared folder that no later plan reads."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def dropped(df: DataFrame) -> None:
    """Delete the files of a staged table that no later plan reads."""
    for file in df.inputFiles()[:1]:
        deleted(df.sparkSession, file.rpartition("/")[0])


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Only (doc_id, text, row) under fixed names, so other columns of any name cannot clash; null text is empty.

    ``row`` tells rows apart that repeat an id: ``row_col``, or the place in the scan.
    """
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), row.alias("row"))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in parts of about ``most`` bytes of text, one row at least: what a worker makes of a
    part stays small, however many rows come at once."""
    for batch in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), np.int64) + 64)
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


#: Rows of a few numbers that a broadcast may hold: some 50 MB on each executor.
FEW = 500_000


def few_or_joined(large: DataFrame, small: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join ``large`` with a staged table of numbered rows: by broadcast if these are at most FEW, else by a merge join.

    Both give the same rows; the first moves none of ``large``.
    """
    return large.join(F.broadcast(small) if small.count() <= FEW else small.hint("merge"), key, how)


def without_rows(docs: DataFrame, gone: DataFrame, row_col: str) -> DataFrame:
    """``docs`` without the rows whose ``row_col`` is in ``gone``'s column row, and without that column."""
    gone = staged(gone.select(F.col("row").alias(row_col)), "gone")
    return few_or_joined(docs, gone, row_col, "left_anti").drop(row_col)


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(a, b) links between longs -> (node, root), root being the least node reachable.

    Alternating large-star and small-star rounds: each node's neighbours are hung below the least of
    them.  Rounds needed grow with the logarithm of the longest chain; every round is two aggregates
    with map-side combination and two joins that adaptive execution can split, so a hub is no
    bottleneck.  Each step is staged.  No node outside ``edges`` is returned.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # Minima are staged so that the joins, free of their partitioning, can be split at a hub.
        least = staged(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = staged(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct(), "large")
        least = staged(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        hung = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = staged(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        mark, before = _mark(after), mark
        dropped(now)
        now = after
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame) -> tuple:
    x = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return x["n"], x["h"]
