"""Exact duplicates by composable polynomial fingerprints, confirmed by comparing the texts.

A text (A-Z lower-cased, as UTF-8) is hashed in chunks: each chunk's polynomial in a fixed base modulo two
31-bit primes is one vector product, and hash(xy) = hash(x) * base^|y| + hash(y) combines them, so a huge
document needs no more memory than a chunk.  Fingerprint and length group the documents; of each group with
more than one member every member's text is compared, chunk after chunk, with that of the row to keep: each
chunk is a row of its own, joined with the kept row's chunk of the same number, so no task holds two whole texts.
Texts that turn out different (a collision) are grouped again by their SHA-256.

Only texts of groups with more than one member are moved.  Their rows are found by a broadcast of row numbers if
these are at most ``FEW``, else by a join; both give the same rows.  Large groups: the kept row's chunks are dealt
to one salt per 256 members, and members to salts by hash of their row, so a group is compared by as many tasks as
it fills.  Counting groups moves no texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import documents, few_or_joined, slices, staged, without_rows

PRIMES = (2147483647, 2147483629)
BASES = (1000003, 918273645)
CHUNK = 1 << 16
SALT = 256


def _powers(base: int, prime: int) -> np.ndarray:
    """base^(CHUNK-1) ... base^0 modulo the prime, by doubling."""
    out = np.ones(1, np.int64)
    while len(out) < CHUNK:
        out = np.concatenate((out * pow(base, len(out), prime) % prime, out))
    return out


_POWERS: list[np.ndarray] = []


def chunk_hash(data: bytes) -> tuple[int, int]:
    """Both hashes of one chunk of at most CHUNK bytes."""
    if not _POWERS:
        _POWERS.extend(_powers(b, p) for b, p in zip(BASES, PRIMES, strict=True))
    values = np.frombuffer(data, np.uint8).astype(np.int64) + 1
    return tuple(int(values @ w[CHUNK - len(data) :]) % p for w, p in zip(_POWERS, PRIMES, strict=True))


def combine(left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
    return tuple((x * pow(b, right_length, p) + y) % p for x, y, b, p in zip(left, right, BASES, PRIMES, strict=True))


def polynomial(data: bytes) -> int:
    """62-bit fingerprint of any number of bytes."""
    whole = (0, 0)
    for at in range(0, len(data), CHUNK):
        part = data[at : at + CHUNK]
        whole = combine(whole, chunk_hash(part), len(part))
    return whole[0] << 31 | whole[1]


def _normal(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").lower()  # on bytes: A-Z only


def _marks(mark: Callable[[bytes], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data = [_normal(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("row"), pa.array([mark(d) for d in data], pa.int64()), pa.array([len(d) for d in data], pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in data])],
                names=["doc_id", "row", "fp", "n_bytes", "sha"],
            )

    return run


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with their text -> a row for each chunk of it."""
    for batch in slices(batches, "text"):
        at, number, data = [], [], []
        for i, text in enumerate(batch.column("text").to_pylist()):
            whole = _normal(text)
            for n, begin in enumerate(range(0, max(1, len(whole)), CHUNK)):
                at.append(i)
                number.append(n)
                data.append(whole[begin : begin + CHUNK])
        kept = batch.drop_columns(["text"]).take(pa.array(at, pa.int64()))
        yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(number, pa.int32()), pa.array(data, pa.binary())], names=[*kept.schema.names, "number", "data"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, mark: Callable[[bytes], int] = polynomial) -> DataFrame:
    """One row per document row: doc_id, keep_id, group_size, kept, text_sha256, row.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and empty texts equal each
    other.  Of equal texts the row with the largest doc_id is kept (a null id counts as smallest; of rows
    that repeat the id, one).  An empty table gives an empty result.  ``mark`` is the fingerprint of a text's bytes;
    whatever collides in it is told apart by the comparison.
    """
    key = ["fp", "n_bytes"]
    plain = documents(docs, id_col, text_col, row_col)
    rows = staged(plain.mapInArrow(_marks(mark), "doc_id long, row long, fp long, n_bytes long, sha string"), "marks")
    size = [F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("top")]
    # Staged tables have no partitioning of their own: joins with them can be split where a key is hot.
    groups = staged(rows.groupBy(*key).agg(*size), "groups")
    several = groups.filter("group_size > 1").select(*key, F.col("top.row").alias("keep_row"), F.ceil(F.col("group_size") / SALT).cast("int").alias("salts"))
    members = staged(rows.select("row", *key).join(several, key), "members")
    texts = few_or_joined(plain.select("row", "text"), members, "row")
    texts = texts.select(*key, "row", "salts", (F.col("row") == F.col("keep_row")).alias("keeper"), "text")
    texts = staged(texts.mapInArrow(_chunks, "fp long, n_bytes long, row long, salts int, keeper boolean, number int, data binary"), "chunks")
    top = texts.filter("keeper").select(*key, "number", F.col("data").alias("kept_data"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    others = texts.filter("NOT keeper").select(*key, "number", "data", "row", F.pmod(F.xxhash64("row"), F.col("salts")).cast("int").alias("salt"))
    odd = staged(others.join(top, [*key, "number", "salt"]).filter("data <> kept_data").select("row").distinct(), "different")
    if not odd.isEmpty():
        key = [*key, "odd"]
        rows = staged(rows.join(odd.withColumn("other", F.lit(True)), "row", "left").withColumn("odd", F.when(F.col("other"), F.col("sha")).otherwise("")).drop("other"), "marks")
        groups = staged(rows.groupBy(*key).agg(*size), "groups")
    return rows.join(groups, key).select("doc_id", F.col("top.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("top.row")).alias("kept"), F.col("sha").alias("text_sha256"), "row")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that exact_duplicates keeps, with all their columns.

    Null and empty texts are equal, so one row of them stays; an empty table stays empty; of repeated rows one stays.
    """
    numbered = docs.withColumn("__exact_row", F.monotonically_increasing_id())
    found = exact_duplicates(numbered, id_col, text_col, "__exact_row")
    return without_rows(numbered, found.filter("NOT kept"), "__exact_row")
