"""Queries of the training-data operators over the tables of one folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from curbsight.functions.lineage import new_table_path
from curbsight.llm import (decontaminate, jaccard, language, lexical, line_dedup, neighbours, packing, prefix_trie,
                           quality, repeats, secrets, token_index, voronoi)
from curbsight.llm.common import read


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack(read(spark, sf_dir, "documents")))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find(read(spark, sf_dir, "documents")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(line_dedup.clean_lines(read(spark, sf_dir, "documents")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.without_repeats(read(spark, sf_dir, "documents")))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(read(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).select(
        "doc_id", (F.col("_coverage") > 0).alias("contaminated"),
        F.col("_coverage").alias("coverage"), F.col("_items").alias("items"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(read(spark, sf_dir, "documents"))


def op9_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_duplicates(read(spark, sf_dir, "embeddings"))


def op10_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_index.digests(token_index.stored_documents(
        spark, read(spark, sf_dir, "documents"), new_table_path(spark, "token-index")))


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voronoi.top_scores(read(spark, sf_dir, "embeddings"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_secret_scan, op3_line_dedup, op4_quality_classifier, op5_suffix_dedup, op6_language_id,
    op7_benchmark_decontamination, op8_ngram_jaccard_join,
    op9_embedding_near_dedup, op10_token_index, op11_exact_topk, op12_lexical_search, op13_prefix_trie)}

ORACLES = {"op3_line_dedup": line_dedup.SQL, "op11_exact_topk": voronoi.SQL,
           "op12_lexical_search": lexical.SQL, "op13_prefix_trie": prefix_trie.SQL}
