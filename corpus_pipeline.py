"""A corpus pipeline of the training-data operators: documents in, token digests of the mixed corpus out.

Every stage but the last returns the columns of documents; each works on all that the one before kept.

Defined cases: a null text counts as empty and is rejected by the quality rules; rows without a doc_id are documents like others
(of equal or similar texts one row stays, ids before null ids) and draw their copies by their text; repeated rows are copies; an
empty table gives no rows; columns besides those of documents pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sandglass.llm import bpe_stream, exact_dedup, fingerprints, mixing, quality, token_files
from sandglass.llm.common import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that are rejected."""
    return quality.clean_documents(docs)


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.keep_largest(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts with a similarity of 0.8 or more on shingles of five words, and what such pairs connect, the smallest doc_id stays."""
    return fingerprints.keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text, a row per document taken."""
    return bpe_stream.bpe_digest(docs, token_files.tokenizer_path(spark, "word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_duplicates),
    ("simhash_near_dedup", near_duplicates),
    ("mix_sources", source_mix),
    ("bpe_round_trip", bpe),
]

#: SQL can express neither XXH64 fingerprints nor BPE; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
