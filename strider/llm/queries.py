"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, decontam, hard_negatives, licenses, line_dedup, media, packing, quality, sharding, simhash, token_counts, toxicity
from .common import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup(docs, exact=True).select("doc_id", "text", F.col("__lines").alias("n_lines"), F.col("__gone").alias("n_dropped"))


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.budgets(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), 1024)


@query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard(docs, 40).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = quality.fit(docs, read_table(spark, sf_dir, "labels"))
    return quality.scores(docs, model).select("doc_id", (quality.held_out("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


def _license_sql() -> str:
    """The same scan over word strings instead of hashes."""
    k, drift, coverage = licenses.K, licenses.DRIFT, licenses.COVERAGE
    templates = ", ".join(f"('{a}', {n}, {q}, {against}, '{g}')" for a, n, q, against, g in licenses.template_grams(licenses.TEMPLATES, k))
    bases = ", ".join(f"('{label}', '{phrase}', {len(phrase.split())})" for phrase, label in licenses.BASE.items())
    between = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{between}') AS w FROM documents
), p AS (
  SELECT r, doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d
), base AS (
  SELECT r, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list_sort(list(DISTINCT label)) AS base
  FROM p JOIN (VALUES {bases}) b(label, phrase, n) ON array_to_string(w[i : i + n - 1], ' ') = phrase GROUP BY r
), hits AS (
  SELECT r, label, size, q, against, i AS p, i - q AS line
  FROM p JOIN (VALUES {templates}) t(label, size, q, against, gram) ON array_to_string(w[i : i + {k - 1}], ' ') = gram
), steps AS (
  SELECT *, CASE WHEN line - lag(line) OVER (PARTITION BY r, label ORDER BY line) <= {drift} THEN 0 ELSE 1 END AS new FROM hits
), groups AS (
  SELECT *, sum(new) OVER (PARTITION BY r, label ORDER BY line) AS span FROM steps
), spans AS (
  SELECT r, label, coalesce(len(list_distinct(flatten(list(range(q, q + {k})) FILTER (NOT against)))), 0) / max(size)::DOUBLE AS share, max(p) - min(p) + {k} <= 2 * max(size) AND NOT bool_or(against) AS fits FROM groups GROUP BY r, label, span
), per AS (
  SELECT r, max(share) AS share, list(DISTINCT label) FILTER (share >= {coverage} AND fits) AS more, count(*) FILTER (share >= {coverage} AND fits) AS n_spans FROM spans GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0)::DOUBLE END AS score, coalesce(n_spans, 0)::BIGINT AS n_spans
FROM d LEFT JOIN base USING (r) LEFT JOIN per USING (r)"""


ORACLES["op6_licenses"] = _license_sql()


@query
def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    return toxicity.scores(docs, model).select("doc_id", (quality.held_out("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.tensors(media.store(read_table(spark, sf_dir, "documents"))))


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


ORACLES["op11_hard_negatives"] = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id AS id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= {hard_negatives.POSITIVES}
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {hard_negatives.LOW} * positive_score <= 100 * score AND 100 * score <= {hard_negatives.HIGH} * positive_score QUALIFY rank <= {hard_negatives.NEGATIVES}"""


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)


@query
def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.aligned(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), digest=True)
    return found.withColumnRenamed("groups", "groups_sha256")
