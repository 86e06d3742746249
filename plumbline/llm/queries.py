"""Registered queries of the pipeline operators and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import lookup_join
from . import (
    adaptive_quality, captures, chat_prefix, hard_negatives, kk_packing, licence_rules, lm_difference, pstable_lsh, revisits,
    shard_propagation, simhash_bk, source_divergence, sql, suffix_dedup, water_filling,
)

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(oracle: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if oracle is not None:
            ORACLE[fn.__name__] = oracle
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query()
def op4_simhash_bk_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_bk.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


@_query(sql.adaptive_quality())
def op8_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = adaptive_quality.quality(_table(spark, sf_dir, "documents"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


@_query(sql.water_filling())
def op9_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = water_filling.mix(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@_query()
def op7_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kk_packing.pack(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


@_query()
def op6_bwt_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.withColumnRenamed("id", "doc_id").drop("kept_text", "carry")


@_query(sql.chat_prefix())
def op5_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-1, 0, "user", marked), (-1, 1, "assistant", marked)], "conv_id long, turn long, role string, text string"
    )
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_prefix.digests(chat_prefix.examples(turns))


@_query(sql.near_vectors())
def op2_pstable_lsh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pstable_lsh.near_duplicates(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


@_query(sql.licence_rules())
def op10_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licence_rules.licences(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), F.array_join("licences", ",").alias("licences"), "sentences", "unmatched"
    )


@_query()
def op3_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id", F.lit(True).alias("good")).distinct()
    # Eight bytes a row; beyond the row limit the join is shuffled.
    docs = lookup_join(_table(spark, sf_dir, "documents"), good, ["doc_id"], "left", max_rows=500_000)
    return lm_difference.scores(docs, "doc_id", "text", "good").withColumnRenamed("id", "doc_id")


@_query(sql.revisits())
def op1_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = revisits.resolve_revisits(captures.captures(_table(spark, sf_dir, "pages")))
    return resolved.withColumn("headers", revisits.header_lines(F.col("headers")))


@_query(sql.source_divergence())
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.divergence(_table(spark, sf_dir, "documents"))


@_query(sql.hard_negatives())
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(_table(spark, sf_dir, "embeddings"), label=label)


@_query()
def op11_shard_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_propagation.shards(_table(spark, sf_dir, "documents"))
    return placed.withColumnRenamed("id", "doc_id").withColumn("grown_shard", F.lit(None).cast("int"))
