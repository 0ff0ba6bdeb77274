"""One query an operator, over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, licenses, line_dedup, quality_model, quality_rules, secret_scan, sentencepieces, sharding, simhash, toxicity
from .common import crc_fold, table

#: Byte limit of a shard.
SHARD_BYTES = 8 << 20
#: Least words of a span that the line query returns: every repeat, of a single line too.
SPAN_WORDS = 1
#: Vocabulary file of the token query.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

Query = Callable[[SparkSession, str], DataFrame]


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("__id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = line_dedup.repeated_spans(table(spark, sf_dir, "documents"), span_words=SPAN_WORDS)
    return spans.select(F.col("__id").alias("doc_id"), F.col("span").alias("unit"), "start", "end", "n_words", "n_units", F.col("first_id").alias("kept_doc_id"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents")).withColumnRenamed("__id", "doc_id")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select(F.col("__id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=4, radius=4)
    return groups.select(F.col("__id").alias("doc_id"), simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op6_sentencepieces(spark: SparkSession, sf_dir: str, vocabulary: str = VOCABULARY) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"), sentencepieces.load(vocabulary)).withColumnRenamed("__id", "doc_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("__id").alias("doc_id"), (crc_fold("__id") == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("__id").alias("doc_id"), F.col("item").alias("item_id"), "start", "end", "edits")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES).withColumnRenamed("__id", "doc_id")


def op10_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality_model.score(docs, quality_model.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("__id").alias("doc_id"), (crc_fold("__id") == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    own = [op1_licenses, op2_line_dedup, op3_secret_scan, op4_quality_rules, op5_simhash, op6_sentencepieces, op7_toxicity, op8_decontaminate, op9_sharding, op10_quality_model, pipeline]
    return {f.__name__: f for f in own}


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lower(coalesce(nullif(regexp_extract(source, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1), ''), source)) AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d
), win AS (
  SELECT rid, i, list_aggregate(ws[i:i + 7], 'string_agg', chr(0)) AS g
  FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), twice AS (
  SELECT rid, unnest(range(i, i + 8)) AS spot FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
), rep AS (
  SELECT rid, count(DISTINCT spot) AS n FROM twice GROUP BY rid
), lines AS (
  SELECT rid, l, count(*) AS c FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
  WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid, l
), dup AS (
  SELECT rid, sum(c - 1) AS n FROM lines GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.rid = w.rid LEFT JOIN dup ON dup.rid = w.rid
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
), f AS (
  SELECT host, rule, count(*) AS n, sum(CAST(bad AS INT)) AS k FROM (
    SELECT host, unnest(['base', 'symbols', 'long_words', 'dup_lines']) AS rule,
      unnest([base_failed, 5 * n_symbols > word_chars, word_chars > 20 * n_words, 2 * n_dup_lines > n_words]) AS bad
    FROM b WHERE host IS NOT NULL) GROUP BY host, rule
), g AS (
  SELECT rule, count(*) - 1.0::DOUBLE AS free, sum(n)::DOUBLE AS n_all, sum(n * n)::DOUBLE AS squares, sum(k)::DOUBLE AS k_all,
    sum(CAST(k AS DOUBLE) * k / n) AS q FROM f GROUP BY rule
), p AS (
  SELECT rule, mean, mixed, CASE WHEN beyond > 0 AND room > 0 THEN least(beyond / room, 1.0::DOUBLE) ELSE 0.0::DOUBLE END AS alike FROM (
    SELECT rule, k_all / n_all AS mean, mean * (1 - mean) AS mixed, q - k_all * mean - mixed * free AS beyond,
      mixed * (n_all - squares / n_all - free) AS room FROM g)
), v AS (
  SELECT host, bool_or((k + mean * s) / (n + s) > least(0.5::DOUBLE, greatest(0.25::DOUBLE, mean + 2 * sqrt(mixed * alike)))) AS rejected FROM (
    SELECT f.*, mean, mixed, alike, CASE WHEN alike > 0 THEN 1 / alike - 1 ELSE 1e9::DOUBLE END AS s
    FROM f JOIN p ON f.rule = p.rule) GROUP BY host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(rejected, false) AS kept
FROM b LEFT JOIN v ON v.host = b.host
"""

OP9_SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents
), s AS (
  SELECT depth, h >> (60 - depth) AS bits, sum(n_bytes) AS shard_bytes
  FROM d, (SELECT unnest(range(0, 31)) AS depth) GROUP BY 1, 2
), leaf AS (
  SELECT rid, min(s.depth) AS depth FROM d JOIN s ON d.h >> (60 - s.depth) = s.bits WHERE shard_bytes <= {SHARD_BYTES} GROUP BY rid
)
SELECT d.doc_id, d.n_bytes, CASE WHEN s.depth = 0 THEN '' ELSE right(lpad(bin(s.bits), 64, '0'), CAST(s.depth AS INT)) END AS shard,
  CAST(s.depth AS INT) AS depth, CAST(s.shard_bytes AS BIGINT) AS shard_bytes, false AS oversized
FROM d JOIN leaf ON d.rid = leaf.rid JOIN s ON s.depth = leaf.depth AND s.bits = d.h >> (60 - leaf.depth)
"""


def oracle_sql() -> dict[str, str]:
    """The others are tested against brute force, exact round trips or held-out labels."""
    return {"op4_quality_rules": OP4_SQL, "op9_sharding": OP9_SQL}
