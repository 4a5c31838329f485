"""Quality scores from supervised subword embeddings.

A document is the average of the learned vectors of its words and of its words' character n-grams (word ends
count as characters; a word that repeats its predecessor adds marks of its own), all hashed into a fixed number of buckets; a softmax over two labels follows.  Vectors and
output weights are trained together by stochastic gradient descent in numpy, on a bounded sample of labelled rows
(``SAMPLE``, the first by hash of the id).  Hashing and averaging are vector operations over whole texts.

For scoring, vectors and output weights are folded into one number per bucket (the difference of the two labels'
logits), so what travels to the executors is one array of fixed size; scoring is a scan and one Arrow stage.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import documents, slices

BITS = 17
DIMENSIONS = 8
GRAMS = (3, 4, 5)
SAMPLE = 2500
EPOCHS = 12
RATE = 0.5
REPEAT = 4  # marks of a repeated word, so that they weigh as much as its n-grams
SEED = 11
HELD_OUT = 2
THRESHOLD = 0.7
_SPACES = np.array([9, 10, 11, 12, 13, 32])
_M = np.uint64(0x9E3779B97F4A7C15)


def _bucket(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return (h * _M >> np.uint64(64 - BITS)).astype(np.int64)


def features(text: str) -> np.ndarray:
    """Buckets of all words and n-grams of a whole text, repeats included."""
    points = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    space = (points <= 32) & np.isin(points, _SPACES)
    points[space] = 32
    gaps = np.concatenate(([0], np.cumsum(space)))
    ends = np.flatnonzero(space)
    begin, end = ends[:-1] + 1, ends[1:]
    begin, end = begin[end > begin], end[end > begin]
    if not len(begin):
        return np.array([], np.int64)
    total = np.zeros(len(begin), np.uint64)
    length = end - begin
    # Words: one pass per character place, over the words that reach it; long words fold in blocks.
    at, alive = 0, np.arange(len(begin))
    while len(alive) and at < 64:
        total[alive] = total[alive] * _M + points[begin[alive] + at]
        at += 1
        alive = alive[length[alive] > at]
    for w in alive.tolist():
        rest = points[begin[w] + at : end[w]]
        total[w] += (rest * np.arange(1, 2 * len(rest), 2, dtype=np.uint64)).sum(dtype=np.uint64)
    again = np.zeros(int((total[1:] == total[:-1]).sum()), np.uint64)  # a word that repeats the one before it
    out = [_bucket(total, 1), np.repeat(_bucket(again, 2), REPEAT)]
    for n in GRAMS:
        count = len(points) - n + 1
        if count <= 0:
            continue
        h = points[:count].copy()
        for j in range(1, n):
            h *= _M
            h += points[j : j + count]
        inside = gaps[n - 1 : n - 1 + count] == gaps[1 : 1 + count]  # no space but at the two ends
        out.append(_bucket(h[inside], n))
    return np.concatenate(out)


class Classifier:
    """Embeddings and a two-label softmax."""

    def __init__(self, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / DIMENSIONS, 1 / DIMENSIONS, (1 << BITS, DIMENSIONS)).astype(np.float32)
        self.weights = np.zeros((DIMENSIONS, 2), np.float32)
        self.bias = np.zeros(2, np.float32)
        self.seed = seed

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> None:
        """rows: (buckets, shares adding up to 1) of each document."""
        rng = np.random.default_rng(self.seed)
        steps, step = max(1, epochs * len(rows)), 0
        for _ in range(epochs):
            for i in rng.permutation(len(rows)):
                ids, share = rows[i]
                now = rate * (1 - step / steps)
                step += 1
                if not len(ids):
                    continue
                mean = share @ self.vectors[ids]
                z = mean @ self.weights + self.bias
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = self.weights @ p
                self.weights -= now * np.outer(mean, p)
                self.bias -= now * p
                # The averaged gradient reaches a vector by its share; scaled up as documents share few buckets.
                self.vectors[ids] -= (now * 30 * share)[:, None] * back

    def folded(self) -> tuple[np.ndarray, float]:
        return (self.vectors.astype(np.float64) @ (self.weights[:, 1] - self.weights[:, 0])), float(self.bias[1] - self.bias[0])


def score(text: str, table: np.ndarray, bias: float) -> float:
    ids = features(text)
    z = bias + (float(table[ids].sum()) / len(ids) if len(ids) else 0.0)
    return float(1 / (1 + np.exp(-z)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found = [np.unique(features(t), return_counts=True) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([f[0].astype(np.int32) for f in found], pa.list_(pa.int32())), pa.array([f[1].astype(np.int32) for f in found], pa.list_(pa.int32()))], names=["doc_id", "label", "ids", "counts"])


def _scored(table: np.ndarray, bias: float, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = table.astype(np.float64)
        for batch in slices(batches, "text"):
            s = [score(t, wide, bias) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "score", "predicted"])

    return run


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Folded model from at most ``sample`` labelled rows that are not held out.

    Rows with null ids or labels teach nothing; without any labels every score is one half.  Of clashing labels of one
    id the greater counts; of rows that repeat an id one teaches, that with the least text hash.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(~held_out())
    chosen = known.groupBy("doc_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = documents(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id")
    once = texts.groupBy("doc_id").agg(F.min_by(F.struct("text", "label"), F.xxhash64("text")).alias("one")).select("doc_id", "one.text", "one.label")
    rows = once.mapInArrow(_counted, "doc_id long, label int, ids array<int>, counts array<int>").toArrow()
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")[: 2 * sample]
    model = Classifier()
    ids, counts = (rows.column(c).combine_chunks() for c in ("ids", "counts"))
    given = []
    for i in order.tolist():
        n = counts[i].values.to_numpy().astype(np.float32)
        given.append((ids[i].values.to_numpy(), n / max(1.0, float(n.sum()))))
    model.fit(given, rows.column("label").to_numpy()[order])
    table, bias = model.folded()
    return table.astype(np.float32), bias


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document row: doc_id, held_out, score (0 to 1), predicted (score >= threshold).

    Only the text decides a score; null text counts as empty and gets the score of no features, which is the
    labels' share as the bias has learned it.  Repeated rows and null ids each keep their row (a null id is not
    held out).  An empty table gives an empty result.
    """
    table, bias = train(docs, labels, id_col, text_col, label_col)
    plain = documents(docs, id_col, text_col).drop("row")
    return plain.mapInArrow(_scored(table, bias, threshold), "doc_id long, score double, predicted int").select("doc_id", held_out().alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns.

    Null and empty texts have the score of no features; repeated rows share one fate; an empty table stays empty.
    """
    table, bias = train(docs, labels, id_col, text_col, label_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = table.astype(np.float64)
        for batch in slices(batches, text_col):
            yield batch.filter(pa.array([score(t or "", wide, bias) >= threshold for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
