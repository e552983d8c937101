"""The queries of this subpackage, each over its whole table, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe_stream, chat_format, exact_dedup, fingerprints, hard_negatives, language, licenses, line_dedup, mixing, quality, secrets, time_partitions, token_files
from .common import documents
from .oracles import ORACLES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": lambda s, d: quality.score_documents(documents(s, d)),
        "op2_simhash_near_dedup": lambda s, d: fingerprints.near_duplicates(documents(s, d)),
        "op3_license_scan": lambda s, d: licenses.scan_licenses(documents(s, d)),
        "op4_mix_sources": lambda s, d: mixing.mix_digest(documents(s, d)),
        "op5_token_files": lambda s, d: token_files.token_digest(documents(s, d), token_files.tokenizer_path(s, "byte_bpe_50k.json")),
        "op6_language_id": lambda s, d: language.identify(documents(s, d)),
        "op7_exact_dedup": lambda s, d: exact_dedup.exact_groups(documents(s, d)),
        "op8_bpe_round_trip": lambda s, d: bpe_stream.bpe_digest(documents(s, d), token_files.tokenizer_path(s, "word_bpe_49k.json")),
        "op9_line_dedup": lambda s, d: line_dedup.dedup_digest(documents(s, d)),
        "op10_secret_scan": lambda s, d: secrets.scan_secrets(documents(s, d)),
        "op11_time_partitions": lambda s, d: time_partitions.partition_clicks(s.read.parquet(f"{d}/clicks.parquet")),
        "op12_hard_negatives": lambda s, d: hard_negatives.hard_negatives(s.read.parquet(f"{d}/embeddings.parquet")),
        "op13_chat_format": lambda s, d: chat_format.chat_digest(chat_format.with_case(s.read.parquet(f"{d}/conversations.parquet"))),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
