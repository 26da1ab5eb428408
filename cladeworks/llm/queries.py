"""The text operators' queries over the test tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import adaptive_rules, attention_mil, crf_pii, filter_audit, fm_index, hilbert, jaccard_join, language_mix, license_index, merkle, packing, suffix_dedup, warc
from .runtime import table

#: The vocabulary that packing counts tokens by.
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def op1_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages")))


def op2_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_index.scan_licenses(table(spark, sf_dir, "documents")).drop("places")


def op3_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = hilbert.shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def op4_adaptive_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adaptive_rules.judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_index.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents")).drop("intervals")


def op7_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crf_pii.personal_data(table(spark, sf_dir, "documents"))
    join = lambda c: F.array_join(c, ",")
    listed = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")))
    return found.select("doc_id", *[F.col("n_base")[i].alias(f"n_{k}") for i, k in enumerate(crf_pii.KINDS[:4])], F.sha2(F.encode(join(F.col("base")), "UTF-8"), 256).alias("base_sha256"), join(listed).alias("spans"))


def op8_attention_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = attention_mil.score_documents(docs, attention_mil.train(docs, table(spark, sf_dir, "labels")))
    score = F.col("quality_score")
    return scored.select("doc_id", attention_mil.held_out("doc_id").alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), VOCABULARY))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = F.transform("languages", lambda x: F.concat_ws(":", x["lang"], F.format_number(x["share"], 4)))
    return language_mix.identify(docs, language_mix.train(docs)).withColumn("languages", F.array_join(said, ","))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_warc_derivatives, op2_license_index, op3_hilbert_shards, op4_adaptive_thresholds, op5_fm_decontamination, op6_suffix_dedup, op7_crf_pii, op8_attention_quality, op9_ngram_jaccard, op10_best_fit_packing, op11_filter_audit, op12_language_mixture, op13_merkle_manifest)}


#: A-Z to a-z alone, then words: the same in both engines.
ORACLE_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_OP5 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {ORACLE_WORDS} AS w FROM documents),
b AS (SELECT item_id, {ORACLE_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(i)),
found AS (SELECT r, i, n, item_id FROM places JOIN windows USING (n, phrase)),
hit AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
item AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::varchar, ',' ORDER BY item_id::varchar) AS names FROM found GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN item USING (r)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc_derivatives": warc.oracle_derivatives(), "op4_adaptive_thresholds": adaptive_rules.oracle_sql(), "op5_fm_decontamination": ORACLE_OP5, "op11_filter_audit": filter_audit.oracle_sql(), "op13_merkle_manifest": merkle.oracle_sql()}
