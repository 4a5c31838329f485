"""Removing repeated substrings with suffix arrays built by induced sorting.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts anywhere else in the table.

1.  Equal texts are gathered into one row with a number of copies, and kept in a table bucketed by the text's
    hash, so that texts are dealt out once and later joins move only small rows.
2.  Every LENGTH-byte string is named by its anchor, the leftmost ``GRAM``-byte string with the least hash in it.
    Equal strings have equal anchors.  Consecutive starts of one anchor make a row (anchor, text, first, last): about
    one per 180 bytes.  Anchors that occur once name no repeated string and end here.
3.  Equal strings also have their anchor at the same offset.  The starts of the other rows are cut into ranges of
    ``WIDTH`` offsets: all strings of a range hold the same LENGTH - WIDTH + 1 bytes around their anchor, so these
    bytes' hash names a group.  Groups of one range end here.  The bytes that a range's strings cover are its context;
    equal contexts of a group are repeated without further search and go on as one.
4.  Groups of more than ``HOT`` different contexts are halved by offset, and each half is grouped anew by the bytes that
    its strings must share, which are more: at a single offset these are the whole string.  So what very many texts
    embed in different surroundings is dealt to many groups, and nothing is left out.
5.  Contexts are dealt to shards by group; each shard of about ``SHARD`` bytes gets a suffix array: suffixes are
    classified, leftmost-smaller (LMS) substrings are sorted by induction and named, the string of names is
    sorted the same way, and the whole array is induced from it.  Permuted common
    prefixes are computed at irreducible places and carried on to the others.  Owned starts whose neighbours
    share LENGTH bytes are repeated.  Each start is owned by one context, so nothing matches itself.
6.  Repeated starts are brought back to their texts; what they cover is removed, judged on the input alone.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import deleted, documents, new_path, slices, staged

LENGTH = 400
GRAM = 32
WIDTH = 64  # offsets that a range has at first
HOT = 500
SHARD = 1 << 20
BUCKET = 48 << 20
_ODD = 0x9E3779B97F4A7C15
_INVERSE = pow(_ODD, -1, 1 << 64)


# ---------------------------------------------------------------- suffix array of one shard


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last symbol is a unique least one."""
    step = np.sign(s[1:].astype(np.int64) - s[:-1])
    at = np.where(step != 0, np.arange(len(step)), len(step))
    following = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 1)[following] > 0, True)


def _induce(s: np.ndarray, small: np.ndarray, marks: np.ndarray, symbols: int) -> np.ndarray:
    """Suffix array from LMS positions ``marks``, given in order within each first symbol's bucket.

    Large buckets are dealt as vectors, small ones entry by entry: the same induction either way.
    """
    return _induce_buckets(s, small, marks, symbols) if len(s) >= 100 * symbols else _induce_entries(s, small, marks, symbols)


def _induce_entries(s: np.ndarray, small: np.ndarray, marks: np.ndarray, symbols: int) -> np.ndarray:
    """One place after the other, as a bucket's next free one is found by its head or tail."""
    n = len(s)
    ends = np.cumsum(np.bincount(s, minlength=symbols))
    own = np.argsort(s[marks], kind="stable")
    marks = marks[own]
    first = s[marks]
    behind = np.searchsorted(first, first, "right") - np.arange(len(marks))  # marks of the bucket from this one on
    array = np.full(n, n, np.int64)  # n: free
    array[ends[first] - behind] = marks
    before = np.arange(-1, n)  # of each place the suffix before it; at n none
    before[n] = -1
    symbol, places = s.tolist(), array.tolist()
    larger = before.copy()
    larger[1:n][small[:-1]] = -1
    left, head = larger.tolist(), [0, *ends[:-1].tolist()]
    for j in places:  # larger suffixes, from left to right
        p = left[j]
        if p >= 0:
            c = symbol[p]
            places[head[c]] = p
            head[c] += 1
    before[1:n][~small[:-1]] = -1
    left, tail = before.tolist(), (ends - 1).tolist()
    for j in reversed(places):  # smaller suffixes, from right to left
        p = left[j]
        if p >= 0:
            c = symbol[p]
            places[tail[c]] = p
            tail[c] -= 1
    return np.array(places, np.int64)


def _induce_buckets(s: np.ndarray, small: np.ndarray, marks: np.ndarray, symbols: int) -> np.ndarray:
    """A bucket's entries at once."""
    own = np.argsort(s[marks], kind="stable")
    marks = marks[own]
    edge = np.searchsorted(s[marks], np.arange(symbols + 1))
    large: list[np.ndarray] = [marks[:0]] * symbols

    def dealt(found: np.ndarray, to: list[list[np.ndarray]]) -> None:
        first = s[found]
        order = np.argsort(first, kind="stable")
        found, first = found[order], first[order]
        cut = np.flatnonzero(first[1:] != first[:-1]) + 1
        for part in np.split(found, cut):
            to[s[part[0]]].append(part)

    waiting: list[list[np.ndarray]] = [[] for _ in range(symbols)]
    for c in range(symbols):  # larger suffixes, from left to right
        front = np.concatenate(waiting[c]) if waiting[c] else marks[:0]
        got = []
        while len(front):
            got.append(front)
            before = front[front > 0] - 1
            before = before[~small[before]]
            inside = s[before] == c
            if not inside.all():
                dealt(before[~inside], waiting)
            front = before[inside]
        large[c] = np.concatenate(got) if got else marks[:0]
        mine = marks[edge[c] : edge[c + 1]]
        before = mine[mine > 0] - 1
        if len(before):
            dealt(before, waiting)
    waiting = [[] for _ in range(symbols)]
    parts: list[np.ndarray] = []
    for c in range(symbols - 1, -1, -1):  # smaller suffixes, from right to left
        front = np.concatenate(waiting[c]) if waiting[c] else marks[:0]
        got = []
        while len(front):
            got.append(front)
            before = front[front > 0] - 1
            before = before[small[before]]
            inside = s[before] == c
            if not inside.all():
                dealt(before[~inside], waiting)
            front = before[inside]
        if c == s[-1]:
            got = [marks[-1:] * 0 + len(s) - 1]
        before = large[c][::-1]
        before = before[before > 0] - 1
        before = before[small[before]]
        if len(before):
            dealt(before, waiting)
        parts.append(np.concatenate(got)[::-1] if got else marks[:0])
        parts.append(large[c])
    return np.concatenate(parts[::-1])


def _names(s: np.ndarray, marks: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings, in text order; equal substrings have equal ranks."""
    length = np.zeros(len(s), np.int64)
    length[marks[:-1]] = np.diff(marks) + 1
    length[marks[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    differs = length[a] != length[b]
    active = np.flatnonzero(~differs)
    off = 0
    while len(active):
        unequal = s[a[active] + off] != s[b[active] + off]
        differs[active[unequal]] = True
        off += 1
        active = active[~unequal]
        active = active[length[a[active]] > off]
    rank = np.zeros(len(s), np.int64)
    rank[ordered] = np.concatenate(([0], np.cumsum(differs)))
    return rank[marks]


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Of integers from 0 on whose last is a unique 0: the string of LMS names is sorted the same way, at every level."""
    if len(s) < 3:
        return np.argsort(s, kind="stable")
    symbols = int(s.max()) + 1
    small = _types(s)
    marks = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    array = _induce(s, small, marks, symbols)
    is_mark = np.zeros(len(s), bool)
    is_mark[marks] = True
    ordered = array[is_mark[array]]
    names = _names(s, marks, ordered)
    if names.max() + 1 < len(marks):
        ordered = marks[suffix_array(names)]
    return _induce(s, small, ordered, symbols)


def common_prefixes(s: np.ndarray, array: np.ndarray) -> np.ndarray:
    """Permuted: for each position, the symbols shared with the suffix before it in the array."""
    n = len(s)
    before = np.full(n, -1, np.int64)
    before[array[1:]] = array[:-1]
    at = np.arange(n)
    reducible = (at > 0) & (before > 0)
    reducible[1:] &= s[at[1:] - 1] == s[before[1:] - 1]
    first = np.flatnonzero(~reducible)
    shared = np.zeros(n, np.int64)
    padded = np.concatenate((s.astype(np.uint16), np.zeros(8, np.uint16)))
    words = np.lib.stride_tricks.sliding_window_view(padded, 4)
    active = first[before[first] >= 0]
    off = 0
    while len(active):
        a, b = active + off, before[active] + off
        inside = np.maximum(a, b) + 4 <= n
        x, y = np.minimum(a, n), np.minimum(b, n)
        equal = inside & (np.ascontiguousarray(words[x]).view(np.uint64) == np.ascontiguousarray(words[y]).view(np.uint64)).ravel()
        done = active[~equal]
        if len(done):
            count = np.full(len(done), off)
            going = np.ones(len(done), bool)
            for _ in range(4):
                p, q = np.minimum(done + count, n - 1), np.minimum(before[done] + count, n - 1)
                going &= (np.maximum(done, before[done]) + count < n) & (s[p] == s[q])
                count += going
            shared[done] = count
        active = active[equal]
        off += 4
    origin = np.maximum.accumulate(np.where(reducible, 0, at))
    return np.maximum(shared[origin] - (at - origin), 0)


def repeated_starts(contexts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Of each context, which owned starts (all with ``length`` bytes from them on) begin a repeated string."""
    pieces = []
    for c in contexts:
        pieces += [np.frombuffer(c, np.uint8).astype(np.int64) + 2, np.ones(1, np.int64)]
    s = np.concatenate([*pieces, np.zeros(1, np.int64)])
    array = suffix_array(s)
    shared = common_prefixes(s, array)
    owned = np.zeros(len(s), bool)
    at = 0
    for c in contexts:
        owned[at : at + len(c) - length + 1] = True
        at += len(c) + 1
    family = np.cumsum(shared[array] < length)
    mine = owned[array]
    members = np.bincount(family[mine], minlength=family[-1] + 1)
    hit = np.zeros(len(s), bool)
    hit[array[mine]] = members[family[mine]] > 1
    out, at = [], 0
    for c in contexts:
        out.append(hit[at : at + len(c) - length + 1])
        at += len(c) + 1
    return out


# ---------------------------------------------------------------- anchors and coverage of one text


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every window: block-wise running minima from both sides."""
    n = len(x) - width + 1
    padded = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


_POWERS: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_POWERS["up"]) < n:
        k = len(_POWERS["up"])
        for name, base in (("up", _ODD), ("down", _INVERSE)):
            _POWERS[name] = np.concatenate((_POWERS[name], _POWERS[name] * np.uint64(pow(base, k, 1 << 64))))
    return _POWERS["up"][:n], _POWERS["down"][:n]


def _totals(data: np.ndarray) -> np.ndarray:
    """Of each beginning of the data the sum of its bytes times powers of an odd number."""
    up, _ = _powers(len(data))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))


def _hashes(total: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Mixed hash of each string [begin, end)."""
    _, down = _powers(len(total))
    h = (total[end] - total[begin]) * down[begin]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def grams(total: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """Hash of every ``gram``-byte string."""
    at = np.arange(len(total) - gram)
    return _hashes(total, at, at + gram)


def _places(total: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every start the hash of its anchor and where that begins."""
    h = grams(total, gram)
    place = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
    at = (_least(place, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return h[at].view(np.int64), at


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first start, last start, occurrences) of each run of starts with one anchor."""
    if len(text) < length:
        none = np.array([], np.int64)
        return none, none, none, none
    anchor, at = _places(_totals(np.frombuffer(text, np.uint8)), length, gram)
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.append(first[1:], len(at)) - 1
    moves = np.concatenate(([0], np.cumsum(at[1:] != at[:-1])))
    return anchor[first], first, last, moves[last] - moves[first] + 1


def ranges(text: bytes, runs: list[tuple[int, int]], length: int = LENGTH, gram: int = GRAM, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(group, first start, last start, place of the anchor, least offset) of each range among the runs of starts."""
    total = _totals(np.frombuffer(text, np.uint8))
    anchor, at = _places(total, length, gram)
    wanted = np.zeros(len(at) + 1, np.int64)
    np.add.at(wanted, [a for a, _ in runs], 1)
    np.add.at(wanted, [b + 1 for _, b in runs], -1)
    start = np.flatnonzero(np.cumsum(wanted[:-1]) > 0)
    low = (at[start] - start) // width * width
    cut = np.flatnonzero((at[start[1:]] != at[start[:-1]]) | (low[1:] != low[:-1]) | (start[1:] != start[:-1] + 1)) + 1
    first, last = start[np.concatenate(([0], cut))], start[np.append(cut, len(start)) - 1]
    place, low = at[first], (at[first] - first) // width * width
    # Strings whose offset is from low to low + width - 1 all hold the bytes from place - low to place - low - width + 1 + length.
    group = _hashes(total, place - low, np.minimum(place - low - width + 1 + length, len(text)))
    group = (group ^ anchor[first].view(np.uint64)) * np.uint64(_ODD) + low.astype(np.uint64)
    return group.view(np.int64), first, last, place, low


def halves(context: bytes, place: int, low: int, width: int, length: int = LENGTH) -> Iterator[tuple[bytes, int, int, int, int]]:
    """(shared bytes, first start, last start, least offset, width) of either half of a context's range of offsets.

    Starts of the context with an offset from ``low`` to ``low + width - 1`` before ``place``, in two parts.
    """
    half = width // 2
    for least, wide in ((low, half), (low + half, width - half)):
        first, last = max(0, place - least - wide + 1), min(len(context) - length, place - least)
        if wide and first <= last:
            yield context[max(0, place - least) : place - least - wide + 1 + length], first, last, least, wide


def removed(size: int, starts: list[tuple[int, int]], length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal byte ranges [begin, end) covered by strings at the inclusive ranges of starts."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b + length))
        else:
            out.append((a, b + length))
    return out


# ---------------------------------------------------------------- Arrow stages


def _bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def _anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols: list[list] = [[], [], [], []]
        keys = []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            found = anchors(_bytes(text))
            for c, x in zip(cols, found, strict=True):
                c.append(x)
            keys += [key] * len(found[0])
        joined = [np.concatenate(c) if c else np.array([], np.int64) for c in cols]
        yield pa.RecordBatch.from_arrays([pa.array(joined[0], pa.int64()), pa.array(keys, pa.binary()), *(pa.array(x, pa.int64()) for x in joined[1:])], names=["anchor", "key", "first", "last", "times"])


def _id(group: int, context: bytes) -> bytes:
    return hashlib.blake2b(context, digest_size=16, key=group.to_bytes(8, "little", signed=True)).digest()


def _ranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        found, ids, keys = [], [], []
        for key, text, hits in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "hits")), strict=True):
            data = _bytes(text)
            rows = ranges(data, [(h["first"], h["last"]) for h in hits])
            found.append(rows)
            ids += [_id(g, data[a : b + LENGTH]) for g, a, b in zip(*(x.tolist() for x in rows[:3]), strict=True)]
            keys += [key] * len(rows[0])
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [np.array([], np.int64)] * 5
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(ids, pa.binary()), pa.array(keys, pa.binary())], names=["g", "first", "last", "place", "low", "cid", "key"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        rows = []
        for text, hits in zip(*(batch.column(c).to_pylist() for c in ("text", "hits")), strict=True):
            data = _bytes(text)
            rows += [(h["g"], h["cid"], h["place"] - h["first"], h["low"], WIDTH, data[h["first"] : h["last"] + LENGTH]) for h in hits]
        yield pa.RecordBatch.from_pylist([dict(zip(_CONTEXT.names, r, strict=True)) for r in rows], _CONTEXT)


def _halved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "context", 1 << 20):
        rows = []
        for g, cid, place, low, width, context in zip(*(batch.column(c).to_pylist() for c in _CONTEXT.names), strict=True):
            for shared, first, last, least, wide in halves(context, place, low, width):
                group = int.from_bytes(hashlib.blake2b(shared, digest_size=8, key=g.to_bytes(8, "little", signed=True), salt=least.to_bytes(8, "little")).digest(), "little", signed=True)
                part = context[first : last + LENGTH]
                rows.append((group, _id(group, part), place - first, least, wide, part, cid, first))
        yield pa.RecordBatch.from_pylist([dict(zip(_PART.names, r, strict=True)) for r in rows], _PART)


_CONTEXT = pa.schema([("g", pa.int64()), ("cid", pa.binary()), ("place", pa.int64()), ("low", pa.int64()), ("width", pa.int64()), ("context", pa.binary())])
_PART = _CONTEXT.append(pa.field("parent", pa.binary())).append(pa.field("shift", pa.int64()))
_CONTEXT_SQL = "g long, cid binary, place long, low long, width long, context binary"


def _sharded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group -> per context the inclusive ranges of its starts that are repeated."""

    def solved(ids, contexts):
        spans = []
        for hit in repeated_starts(contexts):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
            spans.append([{"a": int(a), "b": int(b) - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))], names=["cid", "spans"])

    ids, contexts, size, group = [], [], 0, None
    for batch in batches:
        for g, cid, context in zip(*(batch.column(c).to_pylist() for c in ("g", "cid", "context")), strict=True):
            if g != group and size >= SHARD:
                yield solved(ids, contexts)
                ids, contexts, size = [], [], 0
            group = g
            ids.append(cid)
            contexts.append(context)
            size += len(context) + 1
    if ids:
        yield solved(ids, contexts)


def _judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, text, copies, starts in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "copies", "starts")), strict=True):
            data = _bytes(text)
            if copies > 1 and len(data) >= LENGTH:
                gone = [(0, len(data))]
            else:
                gone = removed(len(data), [(s["a"], s["b"]) for s in starts or []])
            digest, at = hashlib.sha256(), 0
            for a, b in gone:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            rows.append((key, len(data), sum(b - a for a, b in gone), len(gone), digest.hexdigest(), [{"a": a, "b": b} for a, b in gone]))
        if rows:
            kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])


_SPANS = "array<struct<a:bigint,b:bigint>>"


def _solved(contexts: DataFrame) -> DataFrame:
    """Staged contexts of groups -> (cid, spans): the inclusive ranges of each one's starts that are repeated.

    Groups of more than HOT contexts are halved until none is left; what the halves find is brought back.
    """
    spans = f"cid binary, spans {_SPANS}"
    dealt = lambda rows: rows.select("g", "cid", "context").repartition("g").sortWithinPartitions("g").mapInArrow(_sharded, spans)
    hot = staged(contexts.groupBy("g").agg(F.count("*").alias("n"), F.max("width").alias("w")).filter((F.col("n") > HOT) & (F.col("w") > 1)).select("g"), "hot")
    if hot.isEmpty():
        return dealt(contexts)
    parts = staged(contexts.join(hot, "g", "left_semi").select(*_CONTEXT.names).mapInArrow(_halved, _CONTEXT_SQL + ", parent binary, shift long"), "parts")
    once = staged(parts.groupBy("cid").agg(F.count("*").alias("n"), F.first(F.struct("g", "place", "low", "width", "context")).alias("one")).select("cid", "n", "one.*"), "once")
    several = staged(once.groupBy("g").agg(F.count("*").alias("contexts")).filter("contexts > 1").select("g"), "several")
    last = F.octet_length("context").cast("long") - LENGTH
    twice = once.filter("n > 1").select("cid", F.array(F.struct(F.lit(0).cast("long").alias("a"), last.alias("b"))).alias("spans"))
    below = staged(_solved(staged(once.join(several, "g", "left_semi").select(*_CONTEXT.names), "contexts")).join(twice, "cid", "left_anti").unionByName(twice), "solved")
    back = parts.select("cid", "parent", "shift").join(below, "cid").select(F.col("parent").alias("cid"), F.transform("spans", lambda s: F.struct((s["a"] + F.col("shift")).alias("a"), (s["b"] + F.col("shift")).alias("b"))).alias("s"))
    back = back.groupBy("cid").agg(F.flatten(F.collect_list("s")).alias("spans"))
    return dealt(contexts.join(hot, "g", "left_anti")).unionByName(back)


def repeated_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges [a, b)).

    Texts are UTF-8 bytes, null is empty; matches never cross documents; texts under LENGTH bytes keep all.
    Repeated rows count as documents of their own, so each removes the other's bytes.  An empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    rows = documents(docs, id_col, text_col).drop("row").withColumn("key", F.unhex(F.substring(F.sha2("text", 256), 1, 32)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(min(20_000, max(8, -(-size // BUCKET))))
    name = f"sparkassay_texts_{uuid.uuid4().hex}"
    texts = rows.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    texts.write.bucketBy(buckets, "key").option("path", where := new_path(spark, "texts")).saveAsTable(name)
    texts = spark.table(name)
    marked = staged(texts.select("key", "text").mapInArrow(_anchored, "anchor long, key binary, first long, last long, times long"), "anchors")
    # Staged tables have no partitioning of their own: joins with them can be split where a key is hot.
    several = staged(marked.groupBy("anchor").agg(F.sum("times").alias("n")).filter("n > 1").select("anchor"), "several")
    hits = marked.join(several, "anchor", "left_semi").groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("hits"))
    cut = staged(texts.select("key", "text").join(hits, "key").mapInArrow(_ranged, "g long, first long, last long, place long, low long, cid binary, key binary"), "ranges")
    once = staged(cut.groupBy("cid").agg(F.count("*").alias("n"), F.min(F.struct("g", "key", "first", "last", "place", "low")).alias("one")), "once")
    groups = staged(once.groupBy("one.g").agg(F.count("*").alias("contexts")).filter("contexts > 1").select("g"), "groups")
    open_ = once.select("cid", "one.*").join(groups, "g", "left_semi")
    hits = open_.groupBy("key").agg(F.collect_list(F.struct("g", "cid", "first", "last", "place", "low")).alias("hits"))
    contexts = staged(texts.select("key", "text").join(hits, "key").select("text", "hits").mapInArrow(_cut, _CONTEXT_SQL), "contexts")
    whole = lambda last: F.array(F.struct(F.lit(0).cast("long").alias("a"), last.alias("b")))
    twice = once.filter("n > 1").select("cid", whole(F.col("one.last") - F.col("one.first")).alias("spans"))
    solved = staged(_solved(contexts).join(twice, "cid", "left_anti").unionByName(twice), "solved")
    found = cut.select("cid", "key", "first").join(solved, "cid")
    shifted = F.transform("spans", lambda s: F.struct((s["a"] + F.col("first")).alias("a"), (s["b"] + F.col("first")).alias("b")))
    starts = found.select("key", shifted.alias("s"))
    starts = starts.filter(F.size("s") > 0).groupBy("key").agg(F.flatten(F.collect_list("s")).alias("starts"))
    judged = texts.join(starts, "key", "left").select("key", "text", "copies", "starts").mapInArrow(_judged, f"key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {_SPANS}")
    judged = staged(judged, "judged")
    spark.sql(f"DROP TABLE {name}")
    deleted(spark, where)
    return rows.select("doc_id", "key").join(judged, "key").drop("key")
