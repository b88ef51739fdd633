"""Registered queries of the corpus operators, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from punctuality.llm import (
    byte_cnn,
    chosen_paths,
    conversations,
    fertility,
    latent,
    licenses,
    main_text,
    packing,
    substrings,
    token_alignment,
    toxic_chain,
    vantage,
    word_counts,
)
from punctuality.llm.texts import table

Run = Callable[[SparkSession, str], DataFrame]


def op1_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("a", "b")


def op2_tokeniser_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.fertility_rules(table(spark, sf_dir, "documents"))


def op3_chosen_path_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_paths.near_duplicates(table(spark, sf_dir, "documents"), k=2).select(
        "doc_id", "n_shingles", "component_id", "kept"
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_counts.token_counts(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.substring_digest(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op8_byte_cnn_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return byte_cnn.score(docs, byte_cnn.fit(docs, table(spark, sf_dir, "labels")))


def op9_flat_block_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages"))


def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxic_chain.fit(toxic_chain.toxic_labels(docs, table(spark, sf_dir, "labels")))
    return toxic_chain.score(docs, chain)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.alignment_digest(table(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair_digest(table(spark, sf_dir, "conversations"))


def op13_vantage_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vantage.nearest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Run] = {
    f.__name__: f
    for f in (
        op1_latent_decontamination,
        op2_tokeniser_fertility,
        op3_chosen_path_near_dedup,
        op4_token_counts,
        op5_best_fit_packing,
        op6_substring_dedup,
        op7_license_scan,
        op8_byte_cnn_quality,
        op9_flat_block_main_text,
        op10_toxicity_chain,
        op11_token_alignment,
        op12_conversation_repair,
        op13_vantage_neighbours,
    )
}
#: SQL of the queries that DuckDB can express.
ORACLES: dict[str, str] = {}
