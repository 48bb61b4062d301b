"""The registered query of each operator, over whole tables, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critiq.llm import audit, decontam, language, licenses, lm, mixing, neardup, neighbours, prefixes, quality, secrets, tokens, toxicity
from critiq.llm.oracles import CONVERSATION_TRIE, DECONTAMINATION, FILTER_AUDIT, NEAR_DUPLICATES
from critiq.llm.shared import fold, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan_secrets(docs, secrets.train_secrets(docs))
    base = "filter(spans, s -> s.kind != 'model')"
    joined = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in secrets.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(F.expr(joined.format(base)), 256).alias("base_sha256"), F.expr(joined.format("spans")).alias("spans"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classifier = language.train_language(docs, fold("doc_id", 5) != 0)
    found = language.identify_language(docs, classifier)
    return found.withColumn("held_out", fold("doc_id", 5) == 0)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagger = toxicity.train_toxicity(docs, table(spark, sf_dir, "labels"), fold("doc_id", 3) != 1)
    scored = toxicity.score_toxicity(docs, tagger, 0.7)
    return scored.withColumn("held_out", fold("doc_id", 3) == 1)


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.filter("vec_id % 20 = 0"), k=20)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality.train_quality(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    scored = quality.score_quality(docs, machine, 0.3)
    return scored.withColumn("held_out", fold("doc_id", 5) == 0)


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.withColumns({name: F.array_join(name, ",") for name in ("base_labels", "labels")})


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).drop("copies")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_filters(*audit.failure_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return prefixes.conversation_trie(prefixes.rebuilt(prefixes.conversation_paths(turns)))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(fold("doc_id", 5) == 1, F.lit(False))
    scored = lm.score_texts(table(spark, sf_dir, "documents"), fold("doc_id", 5) != 1)
    return scored.withColumn("held_out", held_out).drop("train")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_secrets, op2_language, op3_near_duplicates, op4_toxicity, op5_neighbours, op6_decontamination, op7_quality, op8_license_scans, op9_token_output, op10_source_mixing,
    op11_filter_audit, op12_conversation_trie, op13_lm_scoring,
)}

ORACLES: dict[str, str] = {
    "op3_near_duplicates": NEAR_DUPLICATES,
    "op6_decontamination": DECONTAMINATION,
    "op11_filter_audit": FILTER_AUDIT,
    "op12_conversation_trie": CONVERSATION_TRIE,
    "op10_source_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS key
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
placed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight,
         source_size * 2.0::DOUBLE AS cap, row_number() OVER (ORDER BY source IS NULL, source) AS place
  FROM sizes),
levels AS (
  SELECT *, ((SELECT CAST(sum(source_size) AS DOUBLE) FROM sizes) * 1.5::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM placed),
common AS (SELECT level FROM levels WHERE level * weight < cap ORDER BY cap / weight, place LIMIT 1),
targets AS (SELECT source, source_size, least(cap, coalesce((SELECT level FROM common) * weight, cap)) AS target FROM levels),
line AS (
  SELECT d.*, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END AS whole,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN ahead + size / 2 < target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM line""",
}
