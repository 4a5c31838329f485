"""Keeping models current: dated buckets, their ledger, per-task merges, gates and states.

Files arrive as a stream of names; each one's rows are merged into the history of its tasks by an anti-join (rows seen
first win), so replaying a batch changes nothing.  The stream's checkpoint knows the files, a ledger table what became
of each, and the files of one batch are taken in date order.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkassay.functions.mathx import qualified_number
from sparkassay.operators.joins import merge_incremental, quorum
from sparkassay.operators.metrics import all_scores
from sparkassay.sources.readers import dated


def next_bucket(buckets: DataFrame, done: DataFrame) -> DataFrame:
    """The earliest bucket that the ledger lacks (no row if none)."""
    return buckets.join(done, "bucket", "left_anti").agg(F.min("bucket").alias("bucket")).filter(F.col("bucket").isNotNull())


def status(processed: Column, locked: Column, fresh: Column, met: Column) -> Column:
    """State of a task in this round."""
    return F.when(processed, "processed").when(locked, "locked").when(~met, "skipped").when(~fresh, "no new data").otherwise("working")


def retry(attempts: Column, most: int = 5, memory: int = 20, minutes: int = 720, cpus: int = 4, caps: tuple[int, int, int] | None = None) -> Column:
    """Resources added for another attempt, none beyond its cap; null when attempts are used up."""
    top = caps or (most * memory, most * minutes, most * cpus)
    more = [F.least(attempts * step, F.lit(cap)) for step, cap in zip((memory, minutes, cpus), top, strict=True)]
    return F.when(attempts < most, F.struct(*[m.alias(n) for m, n in zip(more, ("memory_gb", "minutes", "cpus"), strict=True)]))


def memory_class(rows: Column) -> Column:
    """30 without rows, 60 up to 60,000 of them, 30 more for each further 20,000 begun."""
    more = F.greatest(F.lit(0), F.ceil((rows - 60_000) / F.lit(20_000.0)).cast("int"))
    return F.when(rows == 0, 30).otherwise(60 + 30 * more).cast("int")


def clean(batch: DataFrame, task: str, key: str, value: str) -> DataFrame:
    """Named columns with the qualifier stripped; rows that lack any are dropped."""
    return batch.select(task, key, qualified_number(F.col(value)).alias(value), *[c for c in batch.columns if c == "bucket"]).na.drop(subset=[task, key, value])


def buckets(spark: SparkSession, path: str) -> DataFrame:
    """Files of a folder as a stream of (path, bucket): their names alone, contents are read bucket by bucket."""
    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.csv").load(path)
    return names.select("path", F.coalesce(dated(F.col("path")), F.to_date("modificationTime")).alias("bucket"))


_LEDGER = "path string, bucket date, state string, rows long"


class History:
    """History tables in a folder, one per merged bucket set; ``merge`` is idempotent per bucket."""

    def __init__(self, spark: SparkSession, path: str, task: str, key: str, value: str) -> None:
        self.spark, self.path, self.task, self.key, self.value = spark, path, task, key, value
        self.schema = f"`{task}` string, `{key}` string, `{value}` double, bucket date"

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:  # noqa: BLE001 - the folder does not exist before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def merge(self, batch: DataFrame) -> int:
        """Appends rows whose (task, key, value) is new; returns how many."""
        rows = clean(batch, self.task, self.key, self.value)
        old = self.read()
        names = [self.task, self.key, self.value]
        new = rows.dropDuplicates(names).join(old.select(*names), names, "left_anti").select(*old.columns)
        new = new.persist()
        n = new.count()
        if n:
            new.write.mode("append").parquet(self.path)
        new.unpersist()
        return n

    def note(self, path: str, bucket, state: str, rows: int) -> None:
        """A line of the ledger of buckets."""
        line = self.spark.createDataFrame([(path, bucket, state, rows)], _LEDGER)
        line.withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}_ledger")

    def ledger(self) -> DataFrame:
        """(path, bucket, state, rows, at), the last line of each file."""
        schema = f"{_LEDGER}, at timestamp"
        try:
            lines = self.spark.read.schema(schema).parquet(f"{self.path}_ledger")
        except Exception as e:  # noqa: BLE001 - no bucket has been taken yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)
        return lines.groupBy("path").agg(F.max(F.struct("at", "bucket", "state", "rows")).alias("x")).select("path", "x.bucket", "x.state", "x.rows", "x.at")

    def ready(self, least: int = 25) -> DataFrame:
        """Tasks that meet the quorum."""
        return quorum(self.read(), self.task, self.key, self.value, least)


def run(spark: SparkSession, source: str, history: History, checkpoint: str, on_batch: Callable[[DataFrame, DataFrame], None] | None = None) -> None:
    """Take all waiting buckets, in date order, and stop.

    Each file's own header decides: one that lacks a column is booked as done and adds nothing, whatever stands in it;
    columns may come in any order.  A file that a stopped run has merged but not booked adds nothing again.
    ``on_batch(batch, history before)`` may score the last model on new rows first.
    """
    wanted = [history.task, history.key, history.value]

    def step(batch: DataFrame, _: int) -> None:
        for file in sorted(batch.collect(), key=lambda r: (r["bucket"], r["path"])):  # names of new files alone
            header = spark.read.option("header", True).csv(file["path"]).columns
            if not set(wanted) <= set(header):
                history.note(file["path"], file["bucket"], "bad header", 0)
                continue
            schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
            rows = spark.read.schema(schema).option("header", True).csv(file["path"]).select(*wanted).withColumn("bucket", F.lit(file["bucket"]))
            if on_batch:
                on_batch(rows, history.read())
            n = history.merge(rows)
            history.note(file["path"], file["bucket"], "processed" if n else "no new data", n)

    buckets(spark, source).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def scored_ahead(model, batch: DataFrame, history: DataFrame, task: str, key: str, value: str) -> DataFrame:
    """The last model's scores on rows that it has not seen: those of the batch whose (task, key, value) is new."""
    rows = clean(batch, task, key, value)
    new = rows.dropDuplicates([task, key, value]).join(history.select(task, key, value), [task, key, value], "left_anti")
    out = model.predict_keys(new, key).withColumn("y", F.col(value).cast("double"))
    return all_scores(out, model.model.classification, tie=key)


def fan_out(tasks: list[str], work: Callable[[str], str], threads: int = 4) -> dict[str, str]:
    """``work`` for every task, in order of their names, a few at a time: their jobs share the cluster.  task -> state, an
    error as ``failed: ...``; the other tasks go on."""

    def one(task: str) -> str:
        try:
            return work(task)
        except Exception as e:  # noqa: BLE001 - booked as the task's state
            return f"failed: {e}"

    tasks = sorted(tasks)
    with ThreadPoolExecutor(max(1, threads)) as pool:
        return dict(zip(tasks, pool.map(inheritable_thread_target(SparkSession.active())(one), tasks), strict=True))


def merged(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return merge_incremental(old, new, keys)
