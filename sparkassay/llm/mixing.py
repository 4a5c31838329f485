"""Mixing sources to target weights by Poisson replication, in DataFrame operations alone.

A source of n_s documents whose target share is w_s should give w_s * N * epochs documents, so each of its
documents should appear rate = w_s * N * epochs / n_s times on average.  A document's number of copies is the
inverse, at a uniform number hashed from seed and id, of the Poisson distribution with that mean.  Rows are
exploded by their copies and dealt to partitions, and ordered within them, by a second hash.

Counting sources is an aggregate with map-side combination; the distribution tables have a few rows per
source, and are broadcast only below ``SOURCES`` sources (counted first); beyond, they are joined on salted
keys so that a hot source is no bottleneck.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SOURCES = 10_000
SALTS = 64
_BITS = 13  # hexadecimal digits of the hash: 52 bits, exact as a double


def uniform(key):
    """Uniform number in (0, 1) from a string column."""
    return (F.conv(F.substring(F.md5(key), 1, _BITS), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(16**_BITS))


def rates(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5, epochs: float = 1.0, source_col: str = "source") -> DataFrame:
    """(source, n, rate).  Without ``weights``, shares follow n_s ** temper.  A source without weight gets 0.

    Null is a source of its own and matches a weight under the key ``None``.
    """
    counts = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n"))
    if weights is None:
        share = F.pow(F.col("n").cast("double"), F.lit(float(temper)))
    else:
        share = F.lit(0.0)
        for name, w in weights.items():
            share = F.when(F.col("source").eqNullSafe(F.lit(name).cast("string")), F.lit(float(w))).otherwise(share)
    weighed = counts.withColumn("share", share)
    shares, everything = (weighed.agg(F.sum(c)).scalar() for c in ("share", "n"))
    return weighed.select("source", "n", F.coalesce(F.col("share") / F.nullif(shares, F.lit(0.0)) * everything * F.lit(float(epochs)) / F.col("n"), F.lit(0.0)).alias("rate"))


def distributions(rates: DataFrame) -> DataFrame:
    """(source, rate, cdf): Poisson probabilities added up from 0 copies on, to beyond the last that matters."""
    top = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20).cast("int")
    rows = rates.select("source", "rate", F.explode(F.sequence(F.lit(0), top)).alias("k"))
    upto = Window.partitionBy("source").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("lf", F.sum(F.ln(F.greatest(F.col("k"), F.lit(1)).cast("double"))).over(upto))
    p = F.when(F.col("rate") > 0, F.exp(F.col("k") * F.ln("rate") - F.col("rate") - F.col("lf"))).when(F.col("k") == 0, 1.0).otherwise(0.0)
    rows = rows.withColumn("p", p).withColumn("cdf", F.sum("p").over(upto))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("k", "cdf"))), lambda x: x["cdf"])
    return rows.groupBy("source", "rate").agg(listed.alias("cdf"))


def mixed(docs: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.5, epochs: float = 1.0, seed: int = 42, id_col: str = "doc_id", source_col: str = "source", details: bool = False) -> DataFrame:
    """Every row as many times as its Poisson number says (none, for many), in a hashed order.

    Returns the input's columns; with ``details`` also copies and copy (from 1).  Repeated rows, and rows with
    null ids, share the number of their id.  Other columns are carried along whatever their names.  An empty
    table gives an empty result.
    """
    tables = distributions(rates(docs, weights, temper, epochs, source_col)).select(F.col("source").alias("__mix_source"), F.col("cdf").alias("__mix_cdf"))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.withColumn("__mix_u", uniform(F.concat(F.lit(f"{seed}:"), name)))
    same = F.col(source_col).cast("string").eqNullSafe(F.col("__mix_source"))
    if len(tables.select("__mix_source").take(SOURCES + 1)) <= SOURCES:
        rows = rows.join(F.broadcast(tables), same)
    else:
        rows = rows.withColumn("__mix_salt", F.pmod(F.xxhash64(name), F.lit(SALTS)).cast("int"))
        tables = tables.withColumn("__mix_other", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.join(tables, same & (F.col("__mix_salt") == F.col("__mix_other")))
    rows = rows.withColumn("__mix_n", F.size(F.filter("__mix_cdf", lambda c: c < F.col("__mix_u")))).filter("__mix_n > 0")
    rows = rows.select(*docs.columns, "__mix_n", F.explode(F.sequence(F.lit(1), F.col("__mix_n"))).alias("__mix_copy"))
    rows = rows.withColumn("__mix_at", F.md5(F.concat(F.lit(f"{seed}:"), name, F.lit(":"), F.col("__mix_copy").cast("string"))))
    rows = rows.repartition("__mix_at").sortWithinPartitions("__mix_at")
    more = [F.col("__mix_n").alias("copies"), F.col("__mix_copy").alias("copy")] if details else []
    return rows.select(*docs.columns, *more)


MIXING_SQL = """
WITH counts AS (SELECT source, count(*) AS n, pow(CAST(count(*) AS DOUBLE), CAST(0.5 AS DOUBLE)) AS share FROM documents GROUP BY source),
rates AS (SELECT source, share / (SELECT sum(share) FROM counts) * (SELECT sum(n) FROM counts) / n AS rate FROM counts),
ks AS (SELECT source, rate, k FROM rates, LATERAL (SELECT unnest(generate_series(0, CAST(ceil(rate + 12 * sqrt(rate) + 20) AS INTEGER))) AS k)),
logs AS (SELECT *, sum(ln(CAST(greatest(k, 1) AS DOUBLE))) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS lf FROM ks),
cdfs AS (SELECT source, k, sum(exp(k * ln(rate) - rate - lf)) OVER (PARTITION BY source ORDER BY k ROWS UNBOUNDED PRECEDING) AS cdf FROM logs),
us AS (SELECT doc_id, source, (CAST(CAST('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u FROM documents),
n AS (SELECT doc_id, us.source, CAST(count(*) FILTER (cdf < u) AS INTEGER) AS copies FROM us JOIN cdfs ON us.source = cdfs.source GROUP BY doc_id, us.source)
SELECT doc_id, source, copies, CAST(copy AS INTEGER) AS copy FROM n, LATERAL (SELECT unnest(generate_series(1, copies)) AS copy)
"""
