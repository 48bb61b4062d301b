"""Corpus pipeline: quality, near-duplicates, decontamination, mixing, token output, each on what the last one kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next one's docs. All but the last return the columns of documents.

Odd input: a null text counts as empty everywhere; rows without doc_id are scored, never near-duplicates or contaminated,
and mixed and written like others; rows that repeat a doc_id are one document for near-duplicates and decontamination (all of
them go or stay) and rows of their own elsewhere. Without labels all quality scores are equal and above the threshold, so
nothing goes. Empty documents give no rows at every stage. Further columns are kept by all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from critiq.llm import decontam, mixing, neardup, quality, tokens
from critiq.llm.shared import run_dir, saved, table

#: Documents whose quality score is below this go.
QUALITY_THRESHOLD = 0.3
#: Near-duplicates: words per shingle, and the similarity in per cent that links two documents.
SHINGLE_WORDS, SIMILARITY = 5, 80
#: Share of an item's template windows that makes a document contaminated.
LEAK_SHARE = 0.5


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine, learnt from the labels, does not reject."""
    machine = quality.train_quality(docs, table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, machine, QUALITY_THRESHOLD)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest doc_id."""
    return neardup.drop_near_duplicates(docs, SHINGLE_WORDS, SIMILARITY)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), LEAK_SHARE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.repeat_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token ids, as written to files and read back: doc_id, start, n_tokens, ids."""
    import public_tokenizers

    path = f"{run_dir(spark)}/pipeline-tokens-{uuid.uuid4().hex}"
    tokens.write_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), path)
    return tokens.read_tokens(spark, path)


STAGES = [
    ("quality_classifier", quality_filter),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix),
    ("token_output", token_output),
]

#: The first stage is a trained model, which SQL cannot express; tests compare the other stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from documents on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
