"""Secret scans over an incremental ledger of blobs, in DataFrame operations alone.

Every text, whatever its path or version, is addressed by the SHA-256 of its content.  The ledger holds one
row per (blob, rule, version) ever scanned, with the spans found.  A scan takes each distinct blob once, runs
only those rules whose pair is not in the ledger, appends the new rows, and joins the findings of the current
rule versions back to all documents that hold the blob.

Spans come from expressions: splitting a text at a rule's matches and extracting the matches gives alternating
pieces, whose running lengths are the code-point offsets.  Running sums are taken over blocks of 256 matches,
so their cost stays near linear.  Distinct texts are gathered with map-side combination, so copies of one blob
do not meet in one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkassay.llm.common import documents, staged

_BLOCK = 256


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0


def _either(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run of at least so many characters is the same as a maximal run, kept if long enough.
BASE = (Rule("assign", 1, ASSIGN, 2, 8), Rule("access", 1, "AKIA[A-Z0-9]{12,}"), Rule("hex", 1, "[0-9a-f]{32,}"))
MORE = (Rule("pem", 1, "-----BEGIN [A-Z ]*PRIVATE KEY-----"),)
_SPANS = "array<struct<start:int,end:int>>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0), lambda a, b: a + b)


def spans(text: Column, rule: Rule) -> Column:
    """Array of (start, end) code-point spans of a rule's findings, in order."""

    def placed(x: Column) -> Column:
        steps = F.transform(x["m"], lambda m, i: F.length(F.get(x["p"], i)) + F.length(m))
        return _let(F.struct(x["m"].alias("m"), x["g"].alias("g"), steps.alias("s"), F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _BLOCK).cast("int")), lambda b: _total(F.slice(steps, b * _BLOCK + 1, _BLOCK))).alias("t")), summed)

    def summed(y: Column) -> Column:
        before = F.transform(y["t"], lambda _, b: _total(F.slice(y["t"], F.lit(1), b)))
        return _let(F.struct(y["m"].alias("m"), y["g"].alias("g"), y["s"].alias("s"), before.alias("b")), ended)

    def ended(z: Column) -> Column:
        def span(m: Column, i: Column) -> Column:
            block = F.floor(i / _BLOCK).cast("int")
            end = F.get(z["b"], block) + _total(F.slice(z["s"], block * _BLOCK + 1, i - block * _BLOCK + 1))
            return F.struct((end - F.length(m)).cast("int").alias("start"), end.cast("int").alias("end"), F.length(F.get(z["g"], i)).alias("n"))

        kept = F.filter(F.transform(z["m"], span), lambda s: s["n"] >= rule.least)
        return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))

    pattern = F.lit(rule.pattern)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    found = _let(F.struct(F.split(text, rule.pattern, -1).alias("p"), matches.alias("m"), groups.alias("g")), placed)
    return F.when(F.rlike(text, pattern), found).otherwise(F.array().cast(_SPANS))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows).

    findings: doc_id, blob, found (array of kind, place, start, end in order of start, then rule), one row per document
    row; null text is the empty blob.  New rows: blob, rule, version, spans; appended to the ledger by the
    caller, they make the next scan skip these pairs.  Repeated rows each get the findings; an empty table gives
    empty results.
    """
    rows = documents(docs, id_col, text_col).withColumn("blob", F.sha2("text", 256))
    blobs = rows.groupBy("blob").agg(F.first("text").alias("text"))
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    if ledger is None:
        todo = blobs.withColumn("unseen", wanted)
    else:
        done = ledger.groupBy("blob").agg(F.collect_set(F.struct("rule", "version")).alias("seen"))
        unseen = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<struct<rule:string,version:int>>")))
        todo = blobs.join(done, "blob", "left").select("blob", "text", unseen.alias("unseen")).filter(F.size("unseen") > 0)
    each = [F.when(F.array_contains(F.transform("unseen", lambda x: x["rule"]), r.kind), F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), spans(F.col("text"), r).alias("spans"))) for r in rules]
    new = staged(todo.select("blob", F.explode(F.filter(F.array(*each), lambda x: x.isNotNull())).alias("x")).select("blob", "x.*"), "ledger")
    known = new if ledger is None else ledger.select(*new.columns).unionByName(new)
    order = F.create_map(*[F.lit(x) for i, r in enumerate(rules) for x in (f"{r.kind}:{r.version}", i)])
    known = known.withColumn("place", F.element_at(order, F.concat_ws(":", "rule", "version"))).filter(F.col("place").isNotNull() & (F.size("spans") > 0))
    hits = known.select("blob", "rule", "place", F.explode("spans").alias("s")).groupBy("blob").agg(F.collect_list(F.struct(F.col("s.start").alias("start"), "place", F.col("s.end").alias("end"), F.col("rule").alias("kind"))).alias("found"))
    hits = staged(hits.select("blob", F.array_sort("found").alias("found")), "hits")  # so that the join can be split at a hot blob
    found = rows.select("doc_id", "blob").join(hits, "blob", "left")
    return found.select("doc_id", "blob", F.coalesce("found", F.array().cast("array<struct<start:int,place:int,end:int,kind:string>>")).alias("found")), new


def _is(kind: str):
    return lambda span: span["kind"] == kind


def digest(findings: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, SHA-256 of their spans, and all spans."""

    def listed(x: Column) -> Column:
        return F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("found", lambda s: s["kind"].isin([r.kind for r in BASE]))
    counts = [F.size(F.filter("found", _is(r.kind))).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return findings.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))
