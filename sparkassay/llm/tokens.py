"""Token counts by byte-pair merging on a heap and a linked list; no identifiers are produced.

A word starts as its bytes.  Adjacent pairs wait in a heap by merge rank, leftmost first among equals; the
lowest is popped, and if both symbols still stand as they did, they become one and the new neighbours' pairs
are pushed.  The number of tokens is the number of bytes less the number of merges.

Words repeat, so each Python worker keeps counts of the words seen (bounded, then dropped and begun anew);
that changes speed alone.  A text is one task's work from beginning to end and rows are independent: the plan
is a scan and one Arrow stage, with no shuffle.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkassay.llm.common import documents

# Fixed value: the published pre-tokenisation pattern, with white space spelled out by code point.
_SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_EDGE = "\t\n\v\f\r \x85\xa0                　"
_KEPT = 400_000
_UNSAFE = -(1 << 60)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself if printable in Latin-1, else the next free code above 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Counter:
    """Counts tokens of texts under the merges of a byte-level vocabulary file (its JSON text)."""

    def __init__(self, vocabulary: str) -> None:
        import regex

        spec = json.loads(vocabulary)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.ranks = {(a, b): rank for rank, (a, b) in enumerate(pairs)}
        self.specials = [x["content"] for x in spec["added_tokens"]]
        self.cut = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.words = regex.compile(PATTERN)
        self.bytes = byte_symbols()
        self.word_counts: dict[str, int] = {}
        self.piece_counts: dict[str, int] = {}

    def merged(self, word: str) -> int:
        """Tokens of one word: its bytes less the merges made."""
        symbols = [self.bytes[b] for b in word.encode("utf-8", "surrogatepass")]
        n, ranks = len(symbols), self.ranks
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i, symbols[i], symbols[i + 1]) for i in range(n - 1) if (r := ranks.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j < 0 or symbols[j] != b:
                continue
            merges += 1
            joined = a + b
            symbols[i], symbols[j] = joined, ""
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get((joined, symbols[k]))) is not None:
                    heapq.heappush(heap, (r, i, joined, symbols[k]))
            h = before[i]
            if h >= 0 and (r := ranks.get((symbols[h], joined))) is not None:
                heapq.heappush(heap, (r, h, symbols[h], joined))
        return n - merges

    def _word(self, word: str) -> int:
        n = self.word_counts.get(word)
        if n is None:
            n = self.merged(word)
            if len(word) <= 64:
                if len(self.word_counts) >= _KEPT:
                    self.word_counts.clear()
                self.word_counts[word] = n
        return n

    def _plain(self, text: str) -> int:
        return sum(map(self._word, self.words.findall(text)))

    def _piece(self, piece: str) -> int:
        """Tokens of a space and what follows it up to the next space; unsafe if white space touches an end."""
        if piece == "" or piece[0] in _EDGE or piece[-1] in _EDGE:
            n = _UNSAFE
        else:
            n = self._plain(" " + piece)
        if len(piece) <= 64:
            if len(self.piece_counts) >= _KEPT:
                self.piece_counts.clear()
            self.piece_counts[piece] = n
        return n

    def _segment(self, text: str) -> int:
        # A single space always starts a new word with what follows it, so counts add up over spaces.
        first, *rest = text.split(" ")
        if first and first[-1] not in _EDGE:
            get, total = self.piece_counts.get, self._plain(first)
            for piece in rest:
                n = get(piece)
                total += self._piece(piece) if n is None else n
            if total >= 0:
                return total
        return self._plain(text)

    def count(self, text: str) -> int:
        if not self.cut or not any(s in text for s in self.specials):
            return self._segment(text) if text else 0
        parts = self.cut.split(text)
        return len(parts) - 1 + sum(self._segment(p) for p in parts if p)


def _counts(vocabulary: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            n = [counter.count(t) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens.  Special strings inside a text count as one token each
    and cut it; nothing is added, truncated or padded.  Repeated rows and null ids each keep their row.
    The vocabulary file (of fixed size, read on the driver) travels with the function.
    """
    with open(vocabulary_path, encoding="utf-8") as f:
        vocabulary = f.read()
    return documents(docs, id_col, text_col).mapInArrow(_counts(vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
