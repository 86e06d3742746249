"""The corpus pipeline: stages over `documents`, each written and read again by the next.

The stages before the last return the columns of `documents`; the last returns one row per
packed piece with its token ids, from which windows are built without the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import adaptive_quality, kk_packing, simhash_bk, suffix_dedup, water_filling
from plumbline.session import durable

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the thresholds of their language and source."""
    return adaptive_quality.keep_good(docs).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    return simhash_bk.keep_one(docs).select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier document has; `n_chars` follows the text."""
    kept = suffix_dedup.remove_repeats(docs, carry=("lang", "source"))
    return kept.select(
        F.col("id").alias("doc_id"), F.col("kept_text").alias("text"), "carry.lang", "carry.source",
        F.length("kept_text").cast("long").alias("n_chars"),
    )


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources come near their target weights."""
    return water_filling.expand(docs).select(*COLUMNS)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents, with their token ids, in training windows of near-equal fill."""
    return kk_packing.pack(docs, with_ids=True).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix_sources", mix_sources),
    ("pack_windows", pack_windows),
]

# Tokenising, Hamming distances and byte strings are beyond SQL; tests hold stages to brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what a stage returns is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
