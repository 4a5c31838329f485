"""Tables and metadata written out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_sets(df: DataFrame, path: str) -> None:
    """Train and test rows, one folder per split."""
    df.write.mode("overwrite").partitionBy("_split").csv(path, header=True)


def write_tasks(df: DataFrame, path: str, task: str) -> None:
    """One partition per task; only the tasks present are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(task).parquet(path)


def prospective_input(df: DataFrame, key: str, value: str) -> DataFrame:
    """Median measurement per key, as input for predictions ahead of time."""
    return df.groupBy(key).agg(F.median(value).alias(value))


def write_model(model, metadata: dict, path: str) -> None:
    """A Spark ML model with its metadata beside it, both through the cluster's file system."""
    model.write().overwrite().save(f"{path}/model")
    write_json(metadata, f"{path}/metadata")


def write_json(value: dict, path: str) -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(path: str) -> dict:
    from pyspark.sql import SparkSession

    return json.loads(SparkSession.active().read.text(path).first()["value"])


def append_trials(trials: DataFrame, path: str) -> None:
    """Trial log: one row per trial, scores per fold as a map; names cut to 100 characters by the caller's choice."""
    trials.write.mode("append").parquet(path)
