"""From raw documents to packed training sequences: one operator after the other.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read
again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import dart_minhash, line_rules, packing, prefix_free, toxicity
from seqloom.llm.common import written
from seqloom.session import ship_package


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what a classifier fitted on these documents' labels finds toxic."""
    ship_package(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def clean_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the rules and cuts boilerplate lines out of the others."""
    ship_package(spark)
    return line_rules.clean(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    ship_package(spark)
    return dart_minhash.without_near_duplicates(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts long passages that still stand in several places."""
    ship_package(spark)
    return prefix_free.without_repeats(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: a row per piece."""
    ship_package(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("quality_rules", clean_lines),
    ("near_duplicates", one_of_near_duplicates),
    ("repeats", without_repeats),
    ("best_fit_packing", packed_sequences),
]

#: A learned classifier, hashed signatures and the packing plan have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
