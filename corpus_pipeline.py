"""Documents to training sequences: toxicity, near-dedup, repeats, decontamination, packing.

Every stage takes the rows its predecessor kept, with the columns of ``documents``; the last one
gives pieces of packed sequences. Near duplicates here are word shingles of five at 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctuality.llm import chosen_paths, latent, packing, substrings, toxic_chain
from punctuality.llm.texts import shared, table, without

#: No SQL engine can say what a fitted model rejects; the stages are tested one by one.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    chain = toxic_chain.fit(toxic_chain.toxic_labels(docs, table(spark, sf_dir, "labels")))
    return toxic_chain.clean(docs, chain)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return chosen_paths.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that repeat; ``n_chars`` follows the text."""
    cut = substrings.cut_repeats(docs)
    if "n_chars" in cut.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(dict(cut.dtypes)["n_chars"]))
    return cut


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without(docs, latent.leaks(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts that are left, with their places in packed sequences."""
    return packing.packed(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("MinHash near-dedup", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
