"""Exact merge-type subword encoding by backtracking, and decoding.

The result of merging is the one token sequence in which every two neighbours are compatible: merging their
joined text gives just these two again.  So a word is encoded from the left by longest matches in an
Aho-Corasick automaton over the vocabulary; a candidate that is incompatible with its left neighbour gives way
to the next shorter one, a position from which nothing fits is marked in a bitfield and never tried again, and
the last token is then shortened.  Compatibility is found by merging the two tokens' text again, and kept.

Characters outside the vocabulary never merge: they cut the text and become byte tokens.  No vocabulary entry
continues past other text into the white-space mark (checked when the model is read), so words are encoded one by
one and kept; runs of the mark alone, whose merges all rank alike, are merged outright.

Rows are independent: a scan and one Arrow stage, no shuffle.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkassay.llm.common import documents, slices

MARK = "▁"
_KEPT = 200_000  # words and pairs kept in a worker; what goes is found anew when it comes again
_NORMAL, _CONTROL, _USER, _BYTE = 1, 3, 4, 6  # fixed values: piece types of the model file


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of one protocol-buffer message: (number, integer or bytes)."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            n = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield tag >> 3, data[at : at + n]
            at += n


class Model:
    """A merge-type model with byte fallback, identity normalisation and a mark before the text."""

    def __init__(self, data: bytes) -> None:
        import struct

        self.pieces: list[tuple[str, float, int]] = []
        self.prefix, self.squeeze, rules, kind = True, True, b"", 1
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, _NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
            elif number == 3:
                f = dict(_fields(value))
                rules, self.prefix, self.squeeze = f.get(2, b""), bool(f.get(3, 1)), bool(f.get(4, 1))
        if kind != 2 or rules or self.squeeze or any(t == _USER for _, _, t in self.pieces):
            raise ValueError("only merge-type models without normalisation rules or user pieces are supported")
        self.ids = {p: i for i, (p, _, t) in enumerate(self.pieces) if t == _NORMAL}
        self.bytes = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(self.pieces) if t == _BYTE}
        self.score = {p: s for p, s, t in self.pieces if t == _NORMAL}
        self.end = next(i for i, (p, _, t) in enumerate(self.pieces) if t == _CONTROL and p == "</s>")
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("an entry holds the mark after other text")

    def merged(self, text: str) -> list[str]:
        """Plain merging: the best-scored adjacent pair first, leftmost among equals."""
        symbols = list(text)
        n, score = len(symbols), self.score
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-score[p], i, p) for i in range(n - 1) if (p := symbols[i] + symbols[i + 1]) in score]
        heapq.heapify(heap)
        while heap:
            _, i, p = heapq.heappop(heap)
            j = after[i]
            if not symbols[i] or j < 0 or symbols[i] + symbols[j] != p:
                continue
            symbols[i], symbols[j] = p, ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (q := p + symbols[k]) in score:
                    heapq.heappush(heap, (-score[q], i, q))
            h = before[i]
            if h >= 0 and (q := symbols[h] + p) in score:
                heapq.heappush(heap, (-score[q], h, q))
        return [s for s in symbols if s]


class Codec:
    def __init__(self, data: bytes) -> None:
        import ahocorasick

        self.model = m = Model(data)
        self.automaton = ahocorasick.Automaton()
        for p in m.ids:
            self.automaton.add_word(p, len(p))
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        #: words met of late, and those of the time before: what comes often stays, what came once goes
        self.known: dict[str, str] = {}
        self.older: dict[str, str] = {}
        #: words whose ids decode to other bytes than theirs
        self.odd: dict[str, bytes] = {}
        self.names, self.end = {p: str(i) for p, i in m.ids.items()}, str(m.end)
        self.surfaces = {str(i): p.replace(MARK, " ").encode() if t == _NORMAL else bytes([int(p[3:5], 16)]) if t == _BYTE else b"" for i, (p, _, t) in enumerate(m.pieces)}
        self.chars = {p for p in m.ids if len(p) == 1}
        one = "".join(map(re.escape, sorted(self.chars)))
        self.split = re.compile(f"([{one}]+)|([^{one}]+)")
        #: the longest entry that a path from the automaton's root has passed, by its text
        self.reach: dict[str, str | None] = {"": None}
        #: the longest entry that is a shorter beginning of an entry
        self.shorter: dict[str, str | None] = {}
        self.longest = max(map(len, m.ids), default=1)
        for p in sorted(m.ids, key=len):
            passed = None
            for k in range(1, len(p) + 1):
                passed = self.reach.setdefault(p[:k], passed)
            self.shorter[p], self.reach[p] = passed, p
        self.chunks = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")

    def compatible(self, a: str, b: str) -> bool:
        ok = self.pairs.get((a, b))
        if ok is None:
            ok = self.model.merged(a + b) == [a, b]
            if len(self.pairs) >= _KEPT:
                self.pairs.clear()
            self.pairs[a, b] = ok
        return ok

    def _word(self, word: str) -> list[str]:
        """Backtracking over one word all of whose characters are entries."""
        walk, reach, longest = self.automaton.longest_prefix, self.reach, self.longest
        pairs, shorter = self.pairs, self.shorter
        n, at, failed, left, out = len(word), 0, 0, "", []
        token = reach[word[: walk(word[:longest])]]
        while True:
            to = at + len(token)
            if not failed >> to & 1 and (not left or (pairs[left, token] if (left, token) in pairs else self.compatible(left, token))):
                out.append(token)
                if to == n:
                    return out
                at, left = to, token
                rest = word[at : at + longest]
                token = reach[rest[: walk(rest)]]
                continue
            token = shorter[token]
            while token is None:  # nothing fits here after what stands to the left
                failed |= 1 << at
                if not out:
                    raise ValueError(f"no encoding of {word!r}")
                token = out.pop()
                at -= len(token)
                left = out[-1] if out else ""
                token = shorter[token]

    def _chunk(self, chunk: str) -> list[str]:
        if self.chars.issuperset(chunk):
            return list(map(self.names.__getitem__, self._word(chunk) if chunk[-1] != MARK else self.model.merged(chunk)))
        ids: list[str] = []
        for known, other in self.split.findall(chunk):
            if other:
                ids += [str(self.model.bytes[b]) for b in other.encode("utf-8", "surrogatepass")]
            else:
                ids += [self.names[t] for t in (self._word(known) if known[-1] != MARK else self.model.merged(known))]
        return ids

    def _new(self, word: str) -> str:
        """The ids of a word after one space, joined by spaces; what they decode to is kept if it is not that again."""
        found = self.older.get(word)
        if found is None:
            ids = self._chunk(MARK + word)
            if (data := self.surface(ids)) != (" " + word).encode("utf-8", "surrogatepass"):
                self.odd[word] = data
            found = " ".join(ids)
        if len(word) <= 64:
            if len(self.known) >= _KEPT:
                self.known, self.older = {}, self.known
            self.known[word] = found
        return found

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """Of a whole text: the number of ids with the end id, the ids joined by spaces, and the text that they decode to."""
        if not text:
            return 1, self.end, ""
        words = text.split(" ")
        if not self.model.prefix or MARK in text or "" in words:  # marks in other places than one before each word
            chunks = self.chunks.findall((MARK if self.model.prefix else "") + text.replace(" ", MARK))
            parts = [(self.known.get(w) or self._new(w)) if c[0] == MARK and (w := c[1:]) and MARK not in w else " ".join(self._chunk(c)) for c in chunks]
            ids = " ".join(parts)
            return ids.count(" ") + 2, f"{ids} {self.end}", self._text(self.surface(ids.split(" ")))
        parts = list(map(self.known.get, words))
        if None in parts:
            parts = [self.known.get(w) or self._new(w) if p is None else p for p, w in zip(parts, words, strict=True)]
        if self.odd and not self.odd.keys().isdisjoint(words):
            data = b"".join([self.odd[w] if w in self.odd else (" " + w).encode("utf-8", "surrogatepass") for w in words])
        else:
            data = (" " + text).encode("utf-8", "surrogatepass")
        parts.append(self.end)
        joined = " ".join(parts)
        return joined.count(" ") + 1, joined, self._text(data)

    def encode(self, text: str) -> tuple[int, str]:
        """Ids of a whole text with the end id, joined by spaces, and their number."""
        n, ids, _ = self.round_trip(text)
        return n, ids

    def surface(self, ids: list[str]) -> bytes:
        """Bytes that ids stand for, before the mark ahead of the text goes."""
        return b"".join([self.surfaces[i] for i in ids])

    def _text(self, data: bytes) -> str:
        if self.model.prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")

    def decode(self, ids: str) -> str:
        """Text of ids joined by spaces."""
        return self._text(self.surface(ids.split(" ")))


_CODECS: dict[bytes, Codec] = {}


def codec_of(data: bytes) -> Codec:
    """One codec per worker process and model, so that tasks go on with what earlier ones have found."""
    if data not in _CODECS:
        _CODECS.clear()
        _CODECS[data] = Codec(data)
    return _CODECS[data]


def _encoded(data: bytes, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(data)
        for batch in slices(batches, "text"):
            n, ids_sha, text_sha, ids, texts = [], [], [], [], []
            for text in batch.column("text").to_pylist():
                count, joined, back = codec.round_trip(text)
                n.append(count)
                ids_sha.append(hashlib.sha256(joined.encode()).hexdigest())
                text_sha.append(hashlib.sha256(back.encode("utf-8", "surrogatepass")).hexdigest())
                if keep:
                    ids.append([int(i) for i in joined.split(" ")])
                    texts.append(back)
            cols = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                cols, names = cols + [pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], [*names, "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def encoded(docs: DataFrame, model_path: str, keep: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_tokens, ids_sha256, decoded_sha256; with ``keep`` also ids and decoded.

    Whole texts, an end id and no begin id; null and empty texts have the end id alone and decode to "".
    Repeated rows and null ids each keep their row.  The model file (of fixed size, read on the driver)
    travels with the function.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if keep else "")
    return documents(docs, id_col, text_col).mapInArrow(_encoded(data, keep), schema)
