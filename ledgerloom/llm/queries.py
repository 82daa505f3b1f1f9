"""One query per operator over its whole table, and SQL where it can express the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.bestfit import pack_documents
from ledgerloom.llm.feistel_shards import shard_rows
from ledgerloom.llm.host_rules import quality_rules
from ledgerloom.llm.html_main import extract_pages
from ledgerloom.llm.langid import fit_languages, predict_languages
from ledgerloom.llm.license_dice import scan_licenses
from ledgerloom.llm.odd_sketch_dedup import near_duplicates
from ledgerloom.llm.oph_fingerprint import fingerprint_edits
from ledgerloom.llm.phrase_automata import mine_phrases
from ledgerloom.llm.piece_sampling import segmentation_digests
from ledgerloom.llm.token_alignment import align_tokens
from ledgerloom.llm.token_counts import count_tokens
from ledgerloom.llm.toxicity import fit_toxicity, score_toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, fit_toxicity(docs, _table(spark, sf_dir, "labels")))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return predict_languages(docs, fit_languages(docs))


def op4_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation_digests(_table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(_table(spark, sf_dir, "documents"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return quality_rules(_table(spark, sf_dir, "documents")).select(*kept)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(_table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(_table(spark, sf_dir, "documents"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(_table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokens(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_html_extraction, op3_language_id, op4_piece_sampling, op5_sharding, op6_best_fit_packing,
        op7_quality_rules, op8_license_scan, op9_near_dedup, op10_fingerprints,
        op11_token_counts, op12_phrase_collocations, op13_token_alignment,
    )
}
