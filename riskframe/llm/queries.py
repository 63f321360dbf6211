"""Thin queries over the operators: each applies one to its whole table and returns the columns agreed for it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import (
    hamming_join,
    longest_factor,
    pairwise_quality,
    prefix_trie,
    quality_rules,
    rank_merge,
    recurrent,
    schedule,
    spectrum,
    tiling,
    token_files,
    warc_index,
    weak_toxicity,
)


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    """A vocabulary file that the token queries use."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base verdict and final verdict of every document."""
    out = quality_rules.quality_rules(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op2_greedy_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, reordered or not; no other document."""
    return tiling.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_longest_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document."""
    found = longest_factor.deduplicated(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the token files, read back from them."""
    return token_files.read(*token_files.write(_table(spark, sf_dir, "documents"), tokenizer_file()))


def op5_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    return weak_toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    return schedule.taken(_table(spark, sf_dir, "documents"))


def op7_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    return pairwise_quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_minhash_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: shingles, class id, and whether it is its class's first."""
    return hamming_join.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives."""
    found = warc_index.read(*warc_index.write(_table(spark, sf_dir, "pages")), payloads=False)
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op10_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log10 probability under the recurrent model and the base."""
    return recurrent.language_scores(_table(spark, sf_dir, "documents"))


def op11_rank_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens."""
    return rank_merge.token_counts(_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op12_spectrum_slicing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's 16 leading components, whitened."""
    return spectrum.whiten(_table(spark, sf_dir, "embeddings"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.trie(_table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_greedy_tiling": op2_greedy_tiling,
    "op3_longest_factor": op3_longest_factor,
    "op4_token_files": op4_token_files,
    "op5_weak_toxicity": op5_weak_toxicity,
    "op6_low_discrepancy_mix": op6_low_discrepancy_mix,
    "op7_pairwise_quality": op7_pairwise_quality,
    "op8_minhash_hamming": op8_minhash_hamming,
    "op9_warc_index": op9_warc_index,
    "op10_recurrent_scores": op10_recurrent_scores,
    "op11_rank_merge": op11_rank_merge,
    "op12_spectrum_slicing": op12_spectrum_slicing,
    "op13_prefix_trie": op13_prefix_trie,
}
