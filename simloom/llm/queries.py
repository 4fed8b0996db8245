"""The registered queries of this subpackage, and their SQL where there is any."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from simloom.llm.conversations import damaged, repair
from simloom.llm.decontam import leaks
from simloom.llm.htmltext import extract
from simloom.llm.langid import identify
from simloom.llm.licenses import licenses, oracle
from simloom.llm.minhash import near_duplicates
from simloom.llm.packing import pack
from simloom.llm.pii import TEST_KEY, pseudonymise
from simloom.llm.pivots import near_vectors
from simloom.llm.runs import periodic_runs
from simloom.llm.secrets import secrets
from simloom.llm.simhash import fingerprints
from simloom.llm.toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The public vocabulary that the packing query counts in."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license, n_text, n_paragraph, n_line for each document and licence."""
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, spans and counts for each document; the key is that of SIMLOOM_PII_KEY, or the test key."""
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), os.environ.get("SIMLOOM_PII_KEY", "").encode() or TEST_KEY)


def op9_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_pivot_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept for each vector."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op2_cross_parsing_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each document."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op3_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and verdict counts for each document."""
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("found")


def op4_tag_path_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for each page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_id, start, end, edits, coverage for each leak; clean documents have no row."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op6_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path(), with_ids=False)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, counts of faults, cost, audit and repaired_sha256 for each conversation, damaged first."""
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


def op12_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited, near_next and n_within for each document."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_lyndon_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the longest run and two digests for each document, every tenth with a repetition put in."""
    return periodic_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"), plant=True)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_pivot_near_dedup, op2_cross_parsing_language, op3_secret_ownership, op4_tag_path_text, op5_benchmark_leaks, op6_bin_slack_packing, op7_license_digests, op8_feistel_pseudonyms, op9_noisy_channel_toxicity, op10_minhash_near_dedup, op11_conversation_repair, op12_simhash_fingerprints, op13_lyndon_runs)}
SQL: dict[str, str] = {"op7_license_digests": oracle()}
