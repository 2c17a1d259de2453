"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from barlab.llm import (
    chat_windows,
    dart_minhash,
    disclosure,
    license_scan,
    merge_queue,
    packing,
    piece_counts,
    quality_rules,
    ranked_search,
    secrets,
    token_files,
    vector_forest,
    word_runs,
)
from barlab.llm.common import table
from barlab.llm.twins import LICENSES, QUALITY, RANKED

Query = Callable[[SparkSession, str], DataFrame]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"))


def op2_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_windows.format_digest(table(spark, sf_dir, "conversations"))


def op3_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disclosure.span_digest(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.shard_digest(table(spark, sf_dir, "documents"))


def op6_merge_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_queue.round_trip_digest(table(spark, sf_dir, "documents"))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_piece_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_counts.token_counts(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces_digest(table(spark, sf_dir, "documents"))


def op10_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_forest.nearest(table(spark, sf_dir, "embeddings"))


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def folded(doc_id: int | None, n: int) -> np.ndarray | None:
    """The fixed rule of op13 that makes every tenth document periodic from some word on; null ids are left alone."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([np.arange(a), a + np.arange(n - a) % p])


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_runs.run_digest(table(spark, sf_dir, "documents"), order=folded)


QUERIES: dict[str, Query] = {
    "op1_secrets": op1_secrets,
    "op2_chat_windows": op2_chat_windows,
    "op3_disclosure": op3_disclosure,
    "op4_quality_rules": op4_quality_rules,
    "op5_token_files": op5_token_files,
    "op6_merge_queue": op6_merge_queue,
    "op7_dart_minhash": op7_dart_minhash,
    "op8_piece_counts": op8_piece_counts,
    "op9_packing": op9_packing,
    "op10_vector_forest": op10_vector_forest,
    "op11_license_scan": op11_license_scan,
    "op12_ranked_search": op12_ranked_search,
    "op13_word_runs": op13_word_runs,
}

# The other operators' models, hashes and token ids are beyond SQL; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op4_quality_rules": QUALITY,
    "op11_license_scan": LICENSES,
    "op12_ranked_search": RANKED,
}
