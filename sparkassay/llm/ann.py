"""Nearest neighbours by cosine over randomly rotated one-bit codes.

Vectors are scaled to length one, the nearest of a few centres is subtracted (fitted on a bounded sample), and
the residual, scaled to length one, is turned by a fixed random rotation.  Its code is the signs, packed into bits;
two correction scalars are kept: the residual's length, and f, the inner product of the turned residual with its
code scaled to length one.  For a query's turned residual q, <code, q> / f estimates <residual, q> without bias, with an
error of at most EPSILON * sqrt((1 - f^2) / f^2) / sqrt(d - 1) in all but a vanishing share of cases.

Searching: the queries (rows whose id is divisible by ``every``) are compared with all rows in a grid of blocks.
Within a cell of the grid the estimates give each pair a lower and an upper bound.  The candidates best by lower
bound are scored exactly first, and every candidate whose upper bound reaches the k-th of those scores is scored
exactly on the original vectors.  The k best of each cell are then ranked over all cells.  Bounds choose what is scored; no bucket, probe or candidate limit drops a row.

Blocks are dealt by a hash of the row's position, so no key or copied vector can fill one.  Copies of one vector
within a block share one estimate, and only as many of the smallest ids as can appear in a result are scored.  A
task holds one block of queries and one of candidates whatever the table's size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CANDIDATES = 16_384  # rows of a block
QUERIES = 4_096
STEP = 128  # queries estimated at once
EPSILON = 3.0
FIRST = 32  # candidates scored to set the bar
PAIRS = 100_000  # pairs scored at once
SAMPLE = 4_096  # vectors that the centres are fitted on, at most
CENTRES = 16
SEED = 7


def rotation(d: int, seed: int = SEED) -> np.ndarray:
    """A fixed random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def fit_centres(sample: np.ndarray, centres: int = CENTRES, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Means of unit vectors by a few rounds of nearest-centre averaging."""
    if len(sample) < centres * 4:
        return np.zeros((1, sample.shape[1]))
    out = sample[np.random.default_rng(seed).choice(len(sample), centres, replace=False)]
    for _ in range(rounds):
        own = np.argmax(sample @ out.T - 0.5 * (out**2).sum(1), axis=1)
        out = np.stack([sample[own == c].mean(0) if (own == c).any() else out[c] for c in range(centres)])
    return out


class Codes:
    """One block's vectors as bits and correction scalars."""

    def __init__(self, unit: np.ndarray, centres: np.ndarray, turn: np.ndarray) -> None:
        self.own = np.argmax(unit @ centres.T - 0.5 * (centres**2).sum(1), axis=1)
        rest = unit - centres[self.own]
        self.length = np.sqrt((rest**2).sum(1))
        turned = (rest / np.where(self.length > 0, self.length, 1)[:, None]) @ turn
        self.bits = np.packbits(turned > 0, axis=1)
        d = unit.shape[1]
        self.f = np.where(self.length > 0, np.abs(turned).sum(1) / math.sqrt(d), 1.0)
        self.error = EPSILON * np.sqrt(np.maximum(0, 1 - self.f**2)) / self.f / math.sqrt(max(d - 1, 1))

    def bounds(self, unit: np.ndarray, centres: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of <query, vector>: arrays (queries, vectors)."""
        d = unit.shape[1]
        signs = np.unpackbits(self.bits, axis=1, count=d).astype(np.float32) * 2 - 1
        # <q, v> = <q, centre> + |v - centre| * <q, direction>, the last estimated from the code.
        dots = (unit @ turn).astype(np.float32) @ signs.T / math.sqrt(d) / self.f.astype(np.float32)
        middle = (unit @ centres.T).astype(np.float32)[:, self.own] + dots * self.length.astype(np.float32)
        # The query has length one, so its part off the code's direction is at most that.
        slack = (self.length * self.error).astype(np.float32) + np.float32(1e-5)
        return middle - slack, middle + slack


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, terms added from first to last."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


def cosine(a: np.ndarray, b: np.ndarray, a_length: np.ndarray, b_length: np.ndarray) -> np.ndarray:
    return dots(a, b) / (a_length * b_length)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x**2).sum(axis=1, keepdims=True))


def search_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, centres: np.ndarray) -> pd.DataFrame:
    """The k nearest of one block's candidates to each query, by bounds and exact scores."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], vectors[order]
    # Copies: each distinct vector once, with its k + 1 smallest distinct ids.
    _, first, own = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
    by = np.argsort(own, kind="stable")
    fresh = np.concatenate(([True], (own[by][1:] != own[by][:-1]) | (ids[by][1:] != ids[by][:-1])))
    by = by[fresh]
    start = np.searchsorted(own[by], np.arange(len(first)))
    place = np.arange(len(by)) - start[own[by]]
    by = by[place <= k]
    members = np.split(ids[by], np.searchsorted(own[by], np.arange(1, len(first))))
    distinct, turn = vectors[first], rotation(vectors.shape[1])
    counts, leads = np.array([len(m) for m in members]), np.array([m[0] for m in members])
    codes = Codes(_unit(distinct), centres, turn)
    unit, asked, lengths = _unit(queries), np.sqrt(dots(queries, queries)), np.sqrt(dots(distinct, distinct))
    out = []
    for at in range(0, len(queries), STEP):
        low, high = codes.bounds(unit[at : at + STEP], centres, turn)
        # At most k + 1 distinct vectors are needed: the query's own id may be one of them.  The best few by
        # estimate are scored first; the (k + 1)-th of their scores is the bar that upper bounds must reach.
        need, few = min(k + 1, low.shape[1]), min(FIRST, low.shape[1])
        tried = np.argpartition(low, low.shape[1] - few, axis=1)[:, low.shape[1] - few :]
        row = np.repeat(np.arange(len(low)), few)
        score = cosine(queries[at + row], distinct[tried.ravel()], asked[at + row], lengths[tried.ravel()]).reshape(len(low), few)
        bar = np.partition(score, few - need, axis=1)[:, few - need]
        row, col = np.nonzero(high >= (bar - 1e-6)[:, None].astype(np.float32))
        for b in range(0, len(row), PAIRS):
            r, c = row[b : b + PAIRS], col[b : b + PAIRS]
            score = cosine(queries[at + r], distinct[c], asked[at + r], lengths[c])
            keep = score >= bar[r]
            r, c, score = r[keep], c[keep], score[keep]
            # Vectors rank by score, then smallest id; only the first k + 1 of a query can give a result.
            order = np.lexsort((leads[c], -score, r))
            r, c, score = r[order], c[order], score[order]
            start = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else r
            place = np.arange(len(r)) - np.repeat(start, np.diff(np.append(start, len(r))))
            r, c, score = (x[place <= k] for x in (r, c, score))
            n = counts[c]
            if len(c):
                out.append((np.repeat(query_ids[at + r], n), np.concatenate([members[x] for x in c]), np.repeat(score, n)))
    found = pd.DataFrame({"query_id": np.concatenate([o[0] for o in out]), "vec_id": np.concatenate([o[1] for o in out]), "score": np.concatenate([o[2] for o in out])})
    found = found[found.query_id != found.vec_id].sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True]).drop_duplicates(["query_id", "vec_id"])
    return found[found.groupby("query_id").cumcount() < k]


def _searched(k: int, centres: np.ndarray):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        stack = lambda s: np.stack(s.to_list()).astype(np.float64)
        return search_block(left["id"].to_numpy(), stack(left["v"]), right["id"].to_numpy(), stack(right["v"]), k, centres)

    return run


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per query (id divisible by ``every``) its k nearest by cosine: query_id, rank (from 1), vec_id, score.

    Nearest first, ties to the smaller id; all candidates, if fewer than k.  Vectors null, zero, or holding null
    or non-finite components take no part, nor do rows without an id; vectors of another length than most take
    part among their equals only.  Rows that share an id are one candidate, scored by the nearest of them, and
    never answer a query of that id.  Without vectors the result is empty.
    """
    spark = vectors.sparkSession
    v = F.col(vector_col)
    sound = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.filter(F.col(id_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.xxhash64(F.monotonically_increasing_id()).alias("h"))
    sizes = {r["d"]: (r["n"], r["q"]) for r in rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q")).collect()}
    parts = []
    for d, (n, q) in sizes.items():  # one length, as a rule
        own = rows if len(sizes) == 1 else rows.filter(F.size("v") == d)
        sample = own.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()
        centres = fit_centres(_unit(np.stack(sample["v"].to_list()).astype(np.float64)))
        down, over = math.ceil(max(q, 1) / QUERIES), math.ceil(n / CANDIDATES)
        asked = own.filter(F.col("id") % every == 0).withColumn("qb", F.pmod(F.col("h"), F.lit(down))).withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(over - 1))))
        there = own.withColumn("cb", F.pmod(F.col("h"), F.lit(over)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
        cell = lambda x: x.select(F.col("qb").cast("int").alias("qb"), F.col("cb").cast("int").alias("cb"), "id", "v").groupBy("qb", "cb")
        parts.append(cell(asked).cogroup(cell(there)).applyInPandas(_searched(k, centres), "query_id long, vec_id long, score double"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


NEAREST_SQL = """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM e),
p AS (SELECT a.vec_id AS query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) / (a.l * b.l) AS score
      FROM n a JOIN n b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
