"""The operators' registered queries, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkassay.llm import ann, exact, html, mixing, pieces, quality, secrets, simhash, suffix, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.repeated_substrings(_table(spark, sf_dir, "documents")).drop("spans")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents")).drop("row")


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(_table(spark, sf_dir, "documents"), details=True).select("doc_id", "source", "copies", "copy")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    findings, _ = secrets.scan(_table(spark, sf_dir, "documents"))
    return secrets.digest(findings)


# Only A-Z are lower-cased: lower() would also change other letters.
EXACT_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


def _kind_sql(kind: str, pattern: str, group: int, least: int, place: int) -> str:
    p = pattern.replace("'", "''")
    return f"""
{kind}_m AS (SELECT doc_id, i, p, m, g FROM (SELECT doc_id, unnest(generate_series(1, len(ms))) AS i, unnest(ps[1:len(ms)]) AS p, unnest(ms) AS m, unnest(gs) AS g
  FROM (SELECT doc_id, string_split_regex(text, '{p}') AS ps, regexp_extract_all(text, '{p}') AS ms, regexp_extract_all(text, '{p}', {group}) AS gs FROM d WHERE regexp_matches(text, '{p}')))),
{kind}_s AS (SELECT doc_id, '{kind}' AS kind, {place} AS place, e - length(m) AS s, e FROM
  (SELECT doc_id, m, g, sum(length(p) + length(m)) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS e FROM {kind}_m) WHERE length(g) >= {least})"""


SECRETS_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),"
    + ",".join(_kind_sql(r.kind, r.pattern, r.group, r.least, i) for i, r in enumerate(secrets.BASE + secrets.MORE))
    + ",\nfound AS ("
    + " UNION ALL ".join(f"SELECT * FROM {r.kind}_s" for r in secrets.BASE + secrets.MORE)
    + """), joined AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, place) FILTER (place < 3) AS base, string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, place) AS spans FROM found GROUP BY doc_id)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN joined USING (doc_id)"""
)


def queries() -> dict:
    return {f.__name__: f for f in (op1_nearest, op2_token_counts, op3_quality, op4_html_text, op5_simhash, op6_repeated_substrings, op7_exact_dedup, op8_sentencepiece, op9_mix_sources, op10_secret_scan)}


def oracle_sql() -> dict[str, str]:
    return {"op1_nearest": ann.NEAREST_SQL, "op7_exact_dedup": EXACT_SQL, "op9_mix_sources": mixing.MIXING_SQL, "op10_secret_scan": SECRETS_SQL}
