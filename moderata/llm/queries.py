"""The registered queries of the corpus operators, and DuckDB text for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, chunk_bpe, fingerprint, fuzzy_lines, mixing, near_dedup, quality_rules, rans, ranked_search, repeats, toxicity, url_filter, warc
from .common import table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(spark, table(spark, sf_dir, "pages"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op3_chunk_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_bpe.encoded_documents(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.grouped(table(spark, sf_dir, "documents"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.concat_ws(",", "failed_rules").alias("failed_rules"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_sizes(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(table(spark, sf_dir, "pages"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", F.col("__held_out").alias("held_out"), F.col("__score").alias("score"), F.col("__predicted").alias("predicted"))


def op9_rans_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rans.round_trip(spark, table(spark, sf_dir, "documents")).drop("ids")


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fuzzy_lines.deduplicated(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), "text")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.scored(table(spark, sf_dir, "documents"))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {f.__name__: f for f in (op1_warc, op2_fingerprints, op3_chunk_bpe, op4_near_dedup, op5_quality_rules, op6_mixing, op7_url_filter, op8_toxicity, op9_rans_files, op10_fuzzy_lines, op11_ranked_search, op12_alignment, op13_repeats)}
ORACLE = {"op1_warc": warc.SQL, "op6_mixing": mixing.SQL, "op11_ranked_search": ranked_search.SQL}
