"""SimHash near-duplicates found through Golay-code fuzzy hashing.

A document's fingerprint has one bit per bit of its shingles' XXH64 values: set where more than half of
the shingles have it.  Fingerprints within ``MAX_BITS`` differing bits are linked, and components of links
are the groups.

Candidate search.  The 64 bits are cut into three segments of 23, 23 and 18 bits (the last padded with
zeros).  In the perfect binary Golay code (23, 12, 7) each word lies within 3 bits of exactly one codeword;
a word at distance 3 also has five codewords at distance 4.  A segment's keys are all codewords within 4
bits, one or six of them.  Two words that differ in at most two bits always share a key (a weight-3 error
with two more flips stays within 4 of one of the blocks through four of its points).  With at most four
errors over three segments, the two segments with the fewest hold at most two together, so fingerprints
within 4 bits share a key pair for at least one of the three segment pairs: no link is missed.  Every
fingerprint is thus emitted under at most 3 x 36 keys of 24 bits.

Only distinct fingerprints enter the search, so copies cost nothing.  Sharers of a key are compared in
sorted runs; a run gives the links of a spanning forest, not all its pairs, and of those only the ones whose
smallest shared key is the run's own.  Nothing gets disconnected: the ends of a link left out meet under a
smaller key and are connected there, by links given there or, again, under keys smaller still.  A run longer than
``RUN`` is passed on in blocks, and pairs of blocks are compared as separate groups, so no task holds an unbounded
group and no pair is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import connected_components, documents, few_or_joined, slices, staged, without_rows

MAX_BITS = 4
RUN = 4096
SEED = 42
_GENERATOR = 0b101011100011  # fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
_LANES = np.uint64(0x0101010101010101)


def fingerprint(text: str, words: int = 4) -> int:
    """64-bit SimHash of one whole text; 0 if it has no words."""
    return fingerprints(text, words, 1)[0]


def fingerprints(text: str, words: int, tables: int) -> list[int]:
    """The SimHash, and further ones over the same hashes mixed anew."""
    return _tables(_shingle_hashes(text, words), tables)


def _shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of every shingle, repeats included; none if the text has no words."""
    import xxhash

    parts = text.encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.array([], np.uint64)
    joined = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(parts) > words:
        starts, ends = starts[: len(parts) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.uint64)


def _tables(hashes: np.ndarray, tables: int) -> list[int]:
    if not len(hashes):
        return [0] * tables
    out = [_majority(hashes)]
    for _ in range(tables - 1):
        hashes = (hashes ^ hashes >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
        hashes ^= hashes >> np.uint64(29)
        out.append(_majority(hashes))
    return out


def _majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    n = len(hashes)
    # Bit counts: eight byte lanes at a time, summed in rows of 255 so that no lane overflows.
    padded = np.zeros(-(-n // 255) * 255, np.uint64)
    padded[:n] = hashes
    out = 0
    for shift in range(8):
        lanes = ((padded >> np.uint64(shift)) & _LANES).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        counts = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
        for lane in np.flatnonzero(2 * counts > n).tolist():
            out |= 1 << (8 * lane + shift)
    return out


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= _GENERATOR << (bit - 11)
    return word


class Golay:
    """Keys of 23-bit words: indices (the 12 message bits) of all codewords within 4 bits."""

    def __init__(self) -> None:
        self.low = np.array([_remainder(x) for x in range(1 << 12)], np.int64)
        self.high = np.array([_remainder(x << 12) for x in range(1 << 11)], np.int64)
        blocks = [m << 11 ^ _remainder(m << 11) for m in range(1 << 12)]
        blocks = [c for c in blocks if c.bit_count() == 7]
        self.error = np.zeros(1 << 11, np.int64)
        self.delta = np.full((1 << 11, 6), -1, np.int64)  # from the nearest codeword to each key; -1: none
        for weight in range(4):
            for at in combinations(range(23), weight):
                e = sum(1 << i for i in at)
                s = _remainder(e)
                self.error[s] = e
                self.delta[s, 0] = 0
                if weight == 3:
                    self.delta[s, 1:] = [c for c in blocks if c & e == e]

    def keys(self, words: np.ndarray) -> np.ndarray:
        """(n,) words -> (n, 6) codeword indices, -1 where there is no further key."""
        s = self.low[words & 0xFFF] ^ self.high[words >> 12]
        nearest, delta = words ^ self.error[s], self.delta[s]
        return np.where(delta < 0, -1, (nearest[:, None] ^ delta) >> 11)


_GOLAY: list[Golay] = []


def golay() -> Golay:
    if not _GOLAY:
        _GOLAY.append(Golay())
    return _GOLAY[0]


def _codewords(fingerprints: np.ndarray) -> list[np.ndarray]:
    """The keys of each of the three segments."""
    f = fingerprints.view(np.uint64)
    return [golay().keys(((f >> np.uint64(at)) & np.uint64((1 << bits) - 1)).astype(np.int64)) for at, bits in ((0, 23), (23, 23), (46, 18))]


def segment_keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row of the fingerprint, key) for every key pair of every segment pair."""
    f, cut = fingerprints, _codewords(fingerprints)
    rows, keys = [], []
    for number, (i, j) in enumerate(combinations(range(3), 2)):
        a, b = cut[i][:, :, None], cut[j][:, None, :]
        key = np.where((a < 0) | (b < 0), -1, number << 24 | a << 12 | b).reshape(len(f), -1)
        row, col = np.nonzero(key >= 0)
        rows.append(row)
        keys.append(key[row, col])
    return np.concatenate(rows), np.concatenate(keys)


def smallest_shared_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the keys that two fingerprints share, for each pair; -1 if they share none."""
    none = 1 << 12
    least = []
    for x, y in zip(_codewords(a), _codewords(b), strict=True):
        both = (x[:, :, None] == y[:, None, :]).any(axis=2) & (x >= 0)
        least.append(np.where(both, x, none).min(axis=1))
    out = np.full(len(a), -1, np.int64)
    for number, (i, j) in reversed(list(enumerate(combinations(range(3), 2)))):
        out = np.where((least[i] < none) & (least[j] < none), number << 24 | least[i] << 12 | least[j], out)
    return out


def _fingerprints(words: int, tables: int = 1):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprints(t, words, tables) for t in batch.column("text").to_pylist()], np.uint64).view(np.int64).reshape(-1, tables)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *(pa.array(np.ascontiguousarray(found[:, t])) for t in range(tables))], names=["doc_id", "row", *(f"fp{t or ''}" for t in range(tables))])

    return run


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = batch.column("fp").to_numpy(zero_copy_only=False)
        for at in range(0, len(values), 2048):
            part = values[at : at + 2048]
            row, key = segment_keys(part)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], names=["key", "fp"])


def _close(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64)) <= bits


def forest(values: np.ndarray, bits: int = MAX_BITS) -> tuple[list, list]:
    """Links that connect exactly what all links within one run connect."""
    left, right = [], []
    rest = np.unique(values)
    while len(rest) > 1:
        todo, rest = [rest[0]], rest[1:]
        while todo and len(rest):
            node = todo.pop()
            near = _close(rest, node, bits)
            if near.any():
                found = rest[near]
                left.append(np.full(len(found), node))
                right.append(found)
                todo.extend(found)
                rest = rest[~near]
    return left, right


def shortest_tree(values: np.ndarray, bits: int) -> tuple[list, list]:
    """The spanning forest of least distances within one run, links over ``bits`` left out.

    Ties are broken by the two values, so a link of the whole group's tree is also one of each run's that holds
    both ends: runs of one group give mostly the same links.
    """
    rest = np.unique(values)
    left, right = [], []
    node, rest = rest[0], rest[1:]
    far = np.full(len(rest), 65, np.int64)
    low, high = np.zeros(len(rest), np.int64), np.zeros(len(rest), np.int64)
    while len(rest):
        d = np.bitwise_count((rest ^ node).view(np.uint64)).astype(np.int64)
        a, b = np.minimum(rest, node), np.maximum(rest, node)
        nearer = (d < far) | (d == far) & ((a < low) | (a == low) & (b < high))
        far, low, high = np.where(nearer, d, far), np.where(nearer, a, low), np.where(nearer, b, high)
        at = np.flatnonzero(far == far.min())
        at = at[low[at] == low[at].min()]
        i = int(at[np.argmin(high[at])])
        if far[i] <= bits:
            left.append(low[i : i + 1])
            right.append(high[i : i + 1])
        node, keep = rest[i], np.arange(len(rest)) != i
        rest, far, low, high = rest[keep], far[keep], low[keep], high[keep]
    return left, right


def _links(key: np.ndarray, fp: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (key, a, b) among whole runs of equal keys (sorted): a forest in long runs, all in short ones."""
    keys, left, right = [], [], []
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    length = np.diff(np.concatenate((first, [len(key)])))
    short = 16 if bits <= MAX_BITS else 2  # longer ones get a tree
    for at, n in zip(first[length > short].tolist(), length[length > short].tolist(), strict=True):
        # Up to MAX_BITS any links that connect will do; beyond, those are wanted that a later check may pass.
        a, b = forest(fp[at : at + n], bits) if bits <= MAX_BITS else shortest_tree(fp[at : at + n], bits)
        left += a
        right += b
        keys.append(np.full(sum(map(len, a)), key[at]))
    small = np.repeat(length <= short, length)
    end = np.repeat(first + length, length)
    at = np.flatnonzero(small)
    for apart in range(1, short):
        at = at[at + apart < end[at]]
        if not len(at):
            break
        near = _close(fp[at], fp[at + apart], bits)
        left.append(fp[at[near]])
        right.append(fp[at[near] + apart])
        keys.append(key[at[near]])
    none = np.array([], np.int64)
    return (np.concatenate(keys), np.concatenate(left), np.concatenate(right)) if left else (none, none, none)


def _nulls(n: int) -> np.ma.MaskedArray:
    return np.ma.masked_all(n, np.int64)


def _comparer(bits: int, longest: int):
    return lambda batches: _compare(batches, bits, longest)


def _block_comparer(bits: int):
    return lambda batches: _compare_all(batches, bits)


def _compare(batches: Iterator[pa.RecordBatch], bits: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, fp) -> links (a, b), or members of over-long runs with the number of their block."""

    def out(key, a, b, block):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key, a, b)] + [pa.array(block, pa.int32())], names=["key", "a", "b", "block"])

    def links(key, fp):
        if len(key):
            run, a, b = _links(key, fp, bits)
            own = smallest_shared_key(a, b) == run
            a, b = a[own], b[own]
            if len(a):
                yield out(np.zeros(len(a), np.int64), a, b, np.full(len(a), -1))

    held_key = held_fp = np.array([], np.int64)
    long_key, passed = None, 0
    for batch in batches:
        key = np.concatenate((held_key, batch.column("key").to_numpy(zero_copy_only=False)))
        fp = np.concatenate((held_fp, batch.column("fp").to_numpy(zero_copy_only=False)))
        if long_key is not None:
            n = int(np.searchsorted(key, long_key, "right"))
            if n:
                yield out(key[:n], fp[:n], _nulls(n), (passed + np.arange(n)) // longest)
            passed, key, fp = passed + n, key[n:], fp[n:]
            if len(key):
                long_key = None
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.array([], np.int64)
        length = np.diff(np.concatenate((first, [len(key)])))
        for at, n in zip(first[length > longest].tolist(), length[length > longest].tolist(), strict=True):
            yield out(key[at : at + n], fp[at : at + n], _nulls(n), np.arange(n) // longest)
            if at + n == len(key):
                long_key, passed = int(key[at]), n
        keep = np.repeat(length <= longest, length)
        last = int(first[-1]) if len(first) and length[-1] <= longest else len(key)
        done = keep.copy()
        done[last:] = False
        yield from links(key[done], fp[done])
        held_key, held_fp = key[last:], fp[last:]
    yield from links(held_key, held_fp)


_FOUND = "key long, a long, b long, block int"


def links(fingerprints: DataFrame, bits: int = MAX_BITS) -> DataFrame:
    """(fp) distinct fingerprints -> (a, b) links that connect all fingerprints within MAX_BITS.

    With ``bits`` above MAX_BITS, also links of up to so many among those that happen to share a key.
    """
    keyed = fingerprints.select("fp").mapInArrow(_keys, "key long, fp long")
    found = staged(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_comparer(bits, RUN), _FOUND), "links")
    near = found.filter("block < 0").select("a", "b")
    heavy = found.filter("block >= 0").select("key", F.col("a").alias("fp"), "block")
    if not heavy.isEmpty():
        # Each block meets each other block of its run (and itself) in a group of its own.
        blocks = heavy.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
        pairs = heavy.join(blocks, "key").select("key", "fp", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        pairs = pairs.select(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("key"), "fp").distinct()
        near = near.unionByName(staged(pairs.repartition("key").sortWithinPartitions("key").mapInArrow(_block_comparer(bits), _FOUND), "links").select("a", "b"))
    return near.distinct()


def _compare_all(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """As _compare for groups known to hold two blocks at most."""
    key = fp = np.array([], np.int64)

    def out(k, f):
        _, a, b = _links(k, f, bits)
        return pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int64)), pa.array(a), pa.array(b), pa.array(np.full(len(a), -1, np.int32))], names=["key", "a", "b", "block"])

    for batch in batches:
        key = np.concatenate((key, batch.column("key").to_numpy(zero_copy_only=False)))
        fp = np.concatenate((fp, batch.column("fp").to_numpy(zero_copy_only=False)))
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0
        if last:
            yield out(key[:last], fp[:last])
            key, fp = key[last:], fp[last:]
    if len(key):
        yield out(key, fp)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, kept, row.

    Text is lower-cased A-Z, words are runs of anything but space and tab to carriage return, shingles are
    ``words`` words (all words, if fewer); texts without words, empty or null, have fingerprint zero and are
    linked like any other.  ``component_id`` is the smallest doc_id reachable over links, null ids apart, and
    the row that has it is kept (of rows that repeat it, one).  An empty table gives an empty result.
    """
    marked = staged(documents(docs, id_col, text_col, row_col).mapInArrow(_fingerprints(words), "doc_id long, row long, fp long"), "fingerprints")
    distinct = marked.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("least"))
    parts = staged(connected_components(links(distinct)), "components")
    rooted = distinct.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = staged(rooted, "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("top"))
    named = staged(named, "named")
    by_fp = rooted.join(named, "root").select("fp", "top")
    return marked.join(by_fp, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("top.doc_id").alias("component_id"), (F.col("row") == F.col("top.row")).alias("kept"), "row")


def shingle_set(text: str, words: int) -> set[bytes]:
    parts = text.encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))}


def _similar(words: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text_a"), "text_b"):
            a, b, rows = [], [], zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True)
            for x, y, s, t in rows:
                s, t = shingle_set(s, words), shingle_set(t, words)
                both = len(s & t)
                if both >= least * (len(s) + len(t) - both):
                    a.append(x)
                    b.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


#: Candidates for a similarity of 0.8 are up to NEAR of 64 bits apart in one table, and up to BOTH of 128 in it and the
#: next one together; such texts are 10 and 19 apart on average, unrelated ones 32 and 64.
NEAR, BOTH = 13, 28
TABLES = 3  # independent fingerprints searched, so that a pair missed by one can be met by another


def _set_fingerprints(words: int, tables: int):
    """Per text: a digest of its shingle set, and fingerprints over the distinct shingles, as Jaccard is over sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches, "text"):
            digests, found = [], []
            for text in batch.column("text").to_pylist():
                hashes = np.unique(_shingle_hashes(text, words))
                digests.append(xxhash.xxh64_intdigest(hashes.tobytes(), SEED))
                found.append(_tables(hashes, tables))
            found = np.array(found, np.uint64).view(np.int64).reshape(-1, tables)
            columns = [pa.array(np.array(digests, np.uint64).view(np.int64)), *(pa.array(np.ascontiguousarray(found[:, t])) for t in range(tables))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *columns], names=["doc_id", "row", "set", *(f"fp{t or ''}" for t in range(tables))])

    return run


_ENTRY = ["key", "fp", "other", "comp", "row"]
_ENTRIES = ", ".join(f"{c} long" for c in _ENTRY)
_MET = f"{_ENTRIES}, block int, a long, b long"
_CELLS = 1 << 20  # pairs compared at once
DENSE = 1  # candidates per entry that has any, above which a run gives what they connect: its entries are then the fewer rows
HELD = 48 << 20  # bytes of shingle sets that meet in one task
FEWEST, PARTS = 256, 16  # a cluster is cut into PARTS blocks, unless these have fewer than FEWEST rows or HELD asks for more


def _entry_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in _ENTRY[1:]]
        for at in range(0, batch.num_rows, 2048):
            part = [v[at : at + 2048] for v in values]
            row, key = segment_keys(part[0])
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(v[row]) for v in part)], names=_ENTRY)


def _candidates(x: np.ndarray, i: np.ndarray, j: np.ndarray, places: bool = False) -> tuple[np.ndarray, ...]:
    """Of the pairs i, j of entries, the rows of those near in both tables, not of one component and met under their own key
    (and their places)."""
    keep = _close(x[i, 1], x[j, 1], NEAR) & (x[i, 3] != x[j, 3])
    i, j = i[keep], j[keep]
    keep = np.bitwise_count((x[i, 1] ^ x[j, 1]).view(np.uint64)).astype(np.int64) + np.bitwise_count((x[i, 2] ^ x[j, 2]).view(np.uint64)) <= BOTH
    i, j = i[keep], j[keep]
    keep = smallest_shared_key(x[i, 1], x[j, 1]) == x[i, 0]
    i, j = i[keep], j[keep]
    a, b = x[i, 4], x[j, 4]
    return np.minimum(a, b), np.maximum(a, b), *((i, j) if places else ())


def _joined(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least place that each place is connected to by the pairs i, j and by what ``root`` has connected before."""
    while True:
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        if not len(i):
            return root
        np.minimum.at(root, np.maximum(root[i], root[j]), np.minimum(root[i], root[j]))
        while (root[root] != root).any():
            root = root[root]


def _all_pairs(x: np.ndarray, group: np.ndarray, block: np.ndarray | None = None, many: int = DENSE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidates among all pairs within whole runs of equal ``group`` (sorted); with two blocks in a run, only pairs across.

    A run with more than ``many`` candidates per entry that is in any gives, instead of its pairs, these entries' places
    in ``x``, each with the first place that candidates connect it to.
    """
    none = np.array([], np.int64)
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    length = np.diff(np.concatenate((first, [len(group)])))
    short = 16
    if block is None:
        at, end = np.flatnonzero(np.repeat(length <= short, length)), np.repeat(first + length, length)
        met = []
        for apart in range(1, short):
            at = at[at + apart < end[at]]
            for part in range(0, len(at), _CELLS):
                met.append(_candidates(x, at[part : part + _CELLS], at[part : part + _CELLS] + apart, True))
        if met:
            a, b, i, j = map(np.concatenate, zip(*met, strict=True))
            run = np.repeat(np.arange(len(first)), length)
            inside = np.unique(np.concatenate((i, j)))
            many_here = np.bincount(run[i], minlength=len(first)) > many * np.bincount(run[inside], minlength=len(first))
            listed = ~many_here[run[i]]
            yield a[listed], b[listed], none
            inside, root = inside[many_here[run[inside]]], _joined(np.arange(len(x)), i[~listed], j[~listed])
            yield none, none, np.stack([inside, root[inside]], axis=1)
    for start, n in zip(first.tolist(), length.tolist(), strict=True):
        if n < 2 or (block is None and n <= short):
            continue
        run = x[start : start + n]
        if run[:, 3].min() == run[:, 3].max():
            continue
        blocks = np.unique(block[start : start + n]) if block is not None else []
        if len(blocks) == 2:
            left, right = (np.flatnonzero(block[start : start + n] == v) for v in blocks)
        else:
            left = right = np.arange(n)
        step, found, dense = max(1, _CELLS // len(right)), [], 0
        inside, root = np.zeros(n, bool), np.arange(n)
        for at in range(0, len(left), step):
            i = left[at : at + step]
            near = (np.bitwise_count((run[i, 1][:, None] ^ run[right, 1]).view(np.uint64)) <= NEAR) & (run[i, 3][:, None] != run[right, 3])
            if len(blocks) != 2:
                near &= i[:, None] < right
            p, q = np.nonzero(near)
            a, b, i, j = _candidates(run, i[p], right[q], True)
            inside[i] = inside[j] = True
            root = _joined(root, i, j)
            dense += len(a)
            if dense <= many * n:
                found.append((a, b))
            else:
                found = []
        if dense > many * inside.sum():
            yield none, none, start + np.stack([np.flatnonzero(inside), root[inside]], axis=1)
            found = []
        for a, b in found:
            yield a, b, none


def _met(x: np.ndarray, block: np.ndarray | None, a: np.ndarray | None = None, b: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of the schema _MET: entries with their block, or pairs with block -1."""
    n = len(x) if a is None else len(a)
    columns = [x[:, c] if a is None else _nulls(n) for c in range(len(_ENTRY))]
    pair = [_nulls(n), _nulls(n)] if a is None else [a, b]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(np.full(n, -1) if block is None else block, pa.int32()), *(pa.array(c, pa.int64()) for c in pair)], names=[*_ENTRY, "block", "a", "b"])


def _parts(x: np.ndarray, dense: np.ndarray) -> pa.RecordBatch:
    """Entries of dense runs, under the row of the first place that candidates connect them to."""
    found = x[dense[:, 0]]
    found[:, 0] = x[dense[:, 1], 4]
    return _met(found, np.full(len(found), -2))


def _meeting(longest: int, many: int):
    return lambda batches: _meet(batches, longest, many)


def _meeting_blocks(many: int):
    return lambda batches: _meet_blocks(batches, many)


def _meet(batches: Iterator[pa.RecordBatch], longest: int, many: int) -> Iterator[pa.RecordBatch]:
    """Entries sorted by key -> all candidate pairs of each run, the parts of dense runs (block -2), or the entries of
    over-long runs with the number of their block."""

    def found(x):
        for a, b, dense in _all_pairs(x, x[:, 0], many=many) if len(x) else ():
            if len(a):
                yield _met(x, None, a, b)
            if len(dense):
                yield _parts(x, dense)

    held = np.empty((0, len(_ENTRY)), np.int64)
    long_key, passed = None, 0
    for batch in batches:
        x = np.concatenate((held, np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _ENTRY], axis=1)))
        if long_key is not None:
            n = int(np.searchsorted(x[:, 0], long_key, "right"))
            if n:
                yield _met(x[:n], (passed + np.arange(n)) // longest)
            passed, x = passed + n, x[n:]
            if len(x):
                long_key = None
        if not len(x):
            held = x
            continue
        last = int(np.searchsorted(x[:, 0], x[-1, 0]))
        first = np.flatnonzero(np.concatenate(([True], x[1:, 0] != x[:-1, 0])))
        length = np.diff(np.concatenate((first, [len(x)])))
        for at, n in zip(first[length > longest].tolist(), length[length > longest].tolist(), strict=True):
            yield _met(x[at : at + n], np.arange(n) // longest)
            if at == last:
                long_key, passed = int(x[at, 0]), n
        done = np.repeat(length <= longest, length)
        done[last:] = False
        yield from found(x[done])
        held = x[last:] if long_key is None else x[:0]
    yield from found(held)


def _meet_blocks(batches: Iterator[pa.RecordBatch], many: int) -> Iterator[pa.RecordBatch]:
    """As _meet for groups known to hold two blocks at most; within one block, pairs come from its own group."""
    held = np.empty((0, len(_ENTRY) + 2), np.int64)

    def found(x):
        for a, b, dense in _all_pairs(x[:, : len(_ENTRY)], x[:, -1], x[:, -2], many):
            if len(a):
                yield _met(x, None, a, b)
            if len(dense):
                yield _parts(x, dense)

    for batch in batches:
        held = np.concatenate((held, np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (*_ENTRY, "block", "group")], axis=1)))
        last = int(np.searchsorted(held[:, -1], held[-1, -1])) if len(held) else 0
        if last:
            yield from found(held[:last])
            held = held[last:]
    if len(held):
        yield from found(held)


def candidate_pairs(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fp, other, comp, row) -> (a, b): every pair of rows that share a key, up to NEAR bits apart in fp and up to BOTH in
    fp and other together, unless of one comp.  Each pair comes once, under the smallest key it shares.

    Pairs of dense runs are not listed: second come (key, row) of these runs' entries, key being one of the rows that
    candidates connect the entry's row to.
    """
    keyed = entries.select(*_ENTRY[1:]).mapInArrow(_entry_keys, _ENTRIES)
    found = staged(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_meeting(RUN, DENSE), _MET), "met")
    near, dense = found.filter("block = -1").select("a", "b"), found.filter("block = -2").select("key", "row")
    heavy = found.filter("block >= 0").select(*_ENTRY, "block")
    if not heavy.isEmpty():
        # Each block meets each other block of its run (and itself) in a group of its own.
        blocks = heavy.groupBy("key").agg((F.max("block") + 1).alias("blocks"))
        pairs = heavy.join(blocks, "key").select(*_ENTRY, "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
        pairs = pairs.select(*_ENTRY, "block", F.xxhash64("key", F.least("block", "with"), F.greatest("block", "with")).alias("group"))
        found = staged(pairs.repartition("group").sortWithinPartitions("group").mapInArrow(_meeting_blocks(DENSE), _MET), "met")
        near, dense = near.unionByName(found.filter("block = -1").select("a", "b")), dense.unionByName(found.filter("block = -2").select("key", "row"))
    return near, dense


def _hash_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            sets = [np.unique(_shingle_hashes(t, words)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("cluster", "row", "comp")), pa.array(sets, pa.binary())], names=["cluster", "row", "comp", "shingles"])

    return run


def linked_within(sets: list[np.ndarray], comps: list[int], similarity: float) -> list[tuple[int, int]]:
    """Links (places) that join whatever sets of at least the similarity would join, beyond what ``comps`` joins already.

    Overlaps of one set with all others are counts over the lists of its elements' holders.
    """
    n, out = len(sets), []
    size = np.array([len(s) for s in sets])
    _, element = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(n), size)
    order = np.argsort(element, kind="stable")
    holders, begin = holder[order], np.concatenate(([0], np.cumsum(np.bincount(element))))
    edge = np.concatenate(([0], np.cumsum(size)))
    _, root = np.unique(np.array(comps), return_inverse=True)
    waiting = np.ones(n, bool)
    while True:
        # What stands outside the largest part is compared with all; the largest part's members need not be.
        largest = np.bincount(root).argmax() if n else 0
        left = np.flatnonzero(waiting & (root != largest))
        if not len(left):
            return out
        i = int(left[0])
        waiting[i] = False
        other = root != root[i]
        if size[i]:
            e = element[edge[i] : edge[i + 1]]
            both = np.bincount(np.concatenate([holders[begin[x] : begin[x + 1]] for x in e]), minlength=n)
            alike = both >= similarity * (size + size[i] - both)
        else:
            alike = size == 0
        for j in np.flatnonzero(alike & other).tolist():
            if root[j] != root[i]:
                out.append((i, j))
                root[root == root[j]] = root[i]


def _within(similarity: float):
    """Rows sorted by group -> links of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows):
            links = linked_within([np.frombuffer(r[2], np.uint64) for r in rows], [r[1] for r in rows], similarity)
            a, b = (np.array([rows[link[side]][0] for link in links], np.int64) for side in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held, group = [], None
        for batch in batches:
            for g, *row in zip(*(batch.column(c).to_pylist() for c in ("group", "row", "comp", "shingles")), strict=True):
                if g != group and held:
                    yield solved(held)
                    held = []
                group = g
                held.append(row)
        if held:
            yield solved(held)

    return run


def cluster_links(members: DataFrame, plain: DataFrame, words: int, similarity: float) -> DataFrame:
    """(cluster, row, comp), a row in one cluster -> links (a, b) that connect all that are alike in a cluster.

    Each row's shingle set goes to every pair of its cluster's blocks that has its own, so no pair of a cluster is left
    out, and a group gives a spanning forest at most.  Blocks are PARTS at most as long as two of them are within HELD:
    up to there, rows grow with the cluster and not with its square.
    """
    members = staged(members.select("cluster", "row", "comp"), "members")
    sets = staged(few_or_joined(plain.select("row", "text"), members, "row").select("cluster", "row", "comp", "text").mapInArrow(_hash_sets(words), "cluster long, row long, comp long, shingles binary"), "sets")
    size = F.sum(F.octet_length("shingles").cast("long") + 64)
    held = F.when(size <= HELD, 1).otherwise(F.ceil(2 * size / F.lit(HELD)))
    cuts = sets.groupBy("cluster").agg(F.greatest(held, F.least(F.lit(PARTS), F.ceil(F.count("*") / F.lit(FEWEST)))).cast("int").alias("blocks"), F.min("comp").alias("one"), F.max("comp").alias("other"))
    cuts = staged(cuts.filter("one <> other").select("cluster", "blocks"), "cuts")
    rows = few_or_joined(sets, cuts, "cluster").withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))
    rows = rows.select("cluster", "row", "comp", "shingles", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("with"))
    rows = rows.select(F.xxhash64("cluster", F.least("block", "with"), F.greatest("block", "with")).alias("group"), "row", "comp", "shingles")
    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(_within(similarity), "a long, b long")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, row_col: str | None = None) -> DataFrame:
    """One row per document: doc_id, component_id, kept, row, with links verified on the texts.

    Documents of one shingle set are linked to the first of them, which stands for the set.  Candidates are all sets whose
    fingerprints are up to NEAR bits apart and share a key (always, up to four bits; beyond that with falling chance).  A
    candidate is a link if the Jaccard similarity of its shingle sets reaches ``similarity``; texts without words are alike.
    A first pass verifies the least-distance trees of one table only, a second all its candidates, a third those of the
    other tables; none tries pairs that verified links connect already.  Of what is left, runs with many candidates per
    member do not list them: what these candidates connect, with the components it touches, is a cluster, and of clusters
    all pairs are compared, each row once and not under each of its keys.  Later tables leave out pairs of one cluster.
    Every candidate is thus verified, as a pair or in its cluster.  Of each component the row with the smallest doc_id is
    kept.
    Null and empty texts are alike; rows with null ids take part and come last.  An empty table gives an empty result.
    """
    plain = documents(docs, id_col, text_col, row_col)
    names = [f"fp{t or ''}" for t in range(TABLES)]
    marked = staged(plain.mapInArrow(_set_fingerprints(words, TABLES), "doc_id long, row long, set long" + "".join(f", {n} long" for n in names)), "fingerprints")
    sets = marked.groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", *names)).alias("least"))
    sets = staged(sets.select("set", F.col("least.row").alias("first"), *(F.col(f"least.{n}").alias(n) for n in names)), "sets")

    def linked(pairs: DataFrame) -> DataFrame:
        nodes = staged(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct(), "nodes")
        texts = staged(plain.select("row", "text").join(nodes.hint("merge"), "row"), "texts")
        text = lambda name: texts.select(F.col("row").alias(name), F.col("text").alias(f"text_{name}"))
        return staged(pairs.join(text("a"), "a").join(text("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_similar(words, similarity), "a long, b long"), "linked")

    same = marked.select("set", "row").join(sets.select("set", "first"), "set").filter("row <> first").select(F.least("first", "row").alias("a"), F.greatest("first", "row").alias("b"))
    shown = staged(sets.groupBy("fp").agg(F.min("first").alias("row")), "shown")
    side = lambda name: shown.select(F.col("fp").alias(name), F.col("row").alias(f"row_{name}"))
    trees = staged(links(shown, NEAR), "near").join(side("a"), "a").join(side("b"), "b").select(F.least("row_a", "row_b").alias("a"), F.greatest("row_a", "row_b").alias("b"))
    alike = sets.join(shown, "fp").filter("row <> first").select(F.least("first", "row").alias("a"), F.greatest("first", "row").alias("b"))
    known = staged(connected_components(linked(staged(same.unionByName(trees).unionByName(alike).distinct(), "pairs"))), "components")

    # What the first table links or compares need not be tried again by the others.
    edges = lambda parts: parts.select(F.col("node").alias("a"), F.col("root").alias("b"))
    settled = known
    for tables in ([0], range(1, TABLES)):
        placed = staged(sets.join(settled.withColumnRenamed("node", "first"), "first", "left").select(F.col("first").alias("row"), F.coalesce("root", "first").alias("comp"), *names), "placed")
        pairs = dense = None
        for t in tables:
            met, many = candidate_pairs(placed.select(F.col(names[t]).alias("fp"), F.col(names[(t + 1) % TABLES]).alias("other"), "comp", "row"))
            pairs, dense = (met, many) if pairs is None else (pairs.unionByName(met), dense.unionByName(many))
        more, dense = edges(known).unionByName(linked(staged(pairs.distinct(), "pairs"))), staged(dense.distinct(), "dense")
        if not dense.isEmpty():
            # Whole components are in a cluster or outside, so links within clusters leave each component in one of them.
            settled = staged(connected_components(more.unionByName(dense.select(F.col("key").alias("a"), F.col("row").alias("b")))), "clusters")
            touched = staged(settled.join(dense.select(F.col("row").alias("node")).distinct(), "node", "left_semi").select("root").distinct(), "touched")
            members = few_or_joined(settled, touched, "root", "left_semi").select(F.col("node").alias("row"), F.col("root").alias("cluster")).join(placed.select("row"), "row", "left_semi")
            members = members.join(known.withColumnRenamed("node", "row"), "row", "left").select("cluster", "row", F.coalesce("root", "row").alias("comp"))
            found = staged(cluster_links(members, plain, words, similarity), "linked")
            more = more.unionByName(found)
        known = staged(connected_components(more), "components")
        settled = known if dense.isEmpty() else settled
    rooted = staged(marked.select("doc_id", "row").join(known.withColumnRenamed("node", "row"), "row", "left").select("doc_id", "row", F.coalesce("root", "row").alias("root")), "rooted")
    top = staged(rooted.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("top")), "top")
    return rooted.join(top, "root").select("doc_id", F.col("top.doc_id").alias("component_id"), (F.col("row") == F.col("top.row")).alias("kept"), "row")


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each group of similar documents, with all its columns."""
    numbered = docs.withColumn("__near_row", F.monotonically_increasing_id())
    found = similar_groups(numbered, id_col, text_col, words, similarity, "__near_row")
    return without_rows(numbered, found.filter("NOT kept"), "__near_row")
