"""Exact nearest neighbours in blocks, and predictions from them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(queries: DataFrame, train: DataFrame, key: str, vector: str, k: int = 5, metric: str = "euclidean", block: int = 8192) -> DataFrame:
    """(query, neighbour, distance, rank): a query's own key is no neighbour; ties to the smaller key.

    A grid of query and train blocks, each compared in one task with vector operations; only k rows per query
    leave a cell.
    """
    down, over = (max(1, math.ceil(x.count() / block)) for x in (queries, train))
    side = lambda df, own, other, n, m: df.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other)).groupBy("q", "t")
    kind = dict(queries.dtypes)[key]

    def cell(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("id")
            x, y = np.stack(a["v"]), np.stack(b["v"])
            ids = b["id"].to_numpy()
            for q, row in zip(a["id"], x, strict=True):
                gap = y - row
                d = np.sqrt(np.add.accumulate(gap * gap, axis=1)[:, -1]) if metric == "euclidean" else np.abs(gap).sum(1)
                d[ids == q] = np.inf
                take = np.argsort(d, kind="stable")[:k]
                out += [(q, ids[i], d[i]) for i in take if np.isfinite(d[i])]
        return pd.DataFrame(out, columns=["query", "neighbour", "distance"])

    found = side(queries, "q", "t", down, over).cogroup(side(train, "t", "q", over, down)).applyInPandas(cell, f"query {kind}, neighbour {kind}, distance double")
    order = Window.partitionBy("query").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def predicted(queries: DataFrame, train: DataFrame, vector: str, response: str, k: int = 5, metric: str = "euclidean", weights: str = "uniform", classification: bool = False, block: int = 8192) -> DataFrame:
    """(vector, prediction) for each distinct query vector, for classification also the share of class 1.

    Neighbours are rows of ``train``, repeated vectors included; ties in distance go by the vector and the response, so
    they do not depend on row order.  The grid of blocks is that of ``nearest``.  The class with most votes wins, of
    equal ones the least; an exact match decides alone where votes are weighted by inverse distance.
    """
    down, over = (max(1, math.ceil(x.count() / block)) for x in (queries, train))
    mark = F.md5(F.col("v").cast("string"))
    q = queries.select(F.col(vector).cast("array<double>").alias("v")).filter(F.col("v").isNotNull()).distinct().withColumn("m", mark)
    t = train.select(F.col(vector).cast("array<double>").alias("v"), F.col(response).cast("double").alias("y")).na.drop().withColumn("m", mark)
    dealt = lambda df, salt, own, n, other, m: df.withColumn(own, F.pmod(F.xxhash64(*salt), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).groupBy("a", "b")

    def cell(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(x) and len(y):
            y = y.sort_values(["m", "y"])
            points, values, marks = np.stack(y["v"]), y["y"].to_numpy(), y["m"].to_numpy()
            for at, row in zip(x["m"], np.stack(x["v"]), strict=True):
                gap = points - row
                d = np.abs(gap).sum(1) if metric == "manhattan" else np.sqrt((gap * gap).sum(1))
                out += [(at, marks[i], d[i], values[i]) for i in np.argsort(d, kind="stable")[:k]]
        return pd.DataFrame(out, columns=["q", "m", "distance", "y"])

    found = dealt(q, ["m"], "a", down, "b", over).cogroup(dealt(t, ["m", "y"], "b", over, "a", down)).applyInPandas(cell, "q string, m string, distance double, y double")
    order = Window.partitionBy("q").orderBy("distance", "m", "y")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if weights == "uniform":
        found = found.withColumn("w", F.lit(1.0))
    else:
        zero = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("q"))
        found = found.withColumn("w", F.when(zero == 1, (F.col("distance") == 0).cast("double")).otherwise(1 / F.col("distance")))
    if classification:
        votes = found.groupBy("q", "y").agg(F.sum("w").alias("w"))
        out = votes.groupBy("q").agg(F.min(F.struct((-F.col("w")).alias("w"), "y"))["y"].alias("prediction"), (F.sum(F.when(F.col("y") == 1, F.col("w")).otherwise(0.0)) / F.sum("w")).alias("share"))
    else:
        out = found.groupBy("q").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("prediction"))
    return q.join(out, q["m"] == out["q"]).select(F.col("v").alias(vector), *[c for c in out.columns if c != "q"])


def knn_regression(found: DataFrame, train: DataFrame, key: str, response: str, weights: str = "uniform") -> DataFrame:
    """(query, prediction) from neighbours: mean, or weighted by inverse distance (an exact match decides alone)."""
    rows = found.join(train.select(F.col(key).alias("neighbour"), F.col(response).cast("double").alias("y")), "neighbour")
    if weights == "uniform":
        return rows.groupBy("query").agg(F.avg("y").alias("prediction"))
    exact, w = F.avg(F.when(F.col("distance") == 0, F.col("y"))), F.when(F.col("distance") > 0, 1 / F.col("distance"))
    return rows.groupBy("query").agg(F.coalesce(exact, F.sum(w * F.col("y")) / F.sum(w)).alias("prediction"))
