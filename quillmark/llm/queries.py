"""Queries of the corpus operators: op1 to op13."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html, language, lines, lm, search, urls
from .alignment import alignment
from .bpe import digests, round_trip
from .common import table
from .heapbpe import heap_digests, heap_round_trip
from .licenses import license_summary
from .simhash import simhash_components
from .vectors import near_vectors

Query = Callable[[SparkSession, str], DataFrame]


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip(table(spark, sf_dir, "documents")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_summary(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("item").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def op13_heap_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_digests(heap_round_trip(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_simhash_near_dedup, op2_url_filters, op3_line_dedup, op4_byte_bpe, op5_html_extraction, op6_embedding_near_dedup, op7_benchmark_decontamination, op8_license_scans, op9_lm_scoring, op10_language_id, op11_tokenizer_alignment, op12_ranked_search, op13_heap_bpe)}
ORACLES: dict[str, str] = {"op2_url_filters": urls.oracle_sql(), "op3_line_dedup": lines.oracle_sql(), "op7_benchmark_decontamination": decontaminate.oracle_sql(), "op12_ranked_search": search.oracle_sql()}
