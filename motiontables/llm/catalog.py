"""Queries of this folder and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat_tree, decontamination, divergence, licenses, lm_scores, middle_filling, near_duplicates, neighbours, packing,
               quality, sharding, suffix_dedup, toxicity)

HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 5) = 0"


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, base: str) -> DataFrame:
    """Target: documents labelled good and not toxic."""
    target = table(spark, base, "labels").where("quality = 1 AND toxic = 0")
    return lm_scores.cross_entropy_difference(table(spark, base, "documents"), target)


def op2_best_fit_packing(spark: SparkSession, base: str) -> DataFrame:
    return packing.best_fit_packed(table(spark, base, "documents"))


def op3_toxicity(spark: SparkSession, base: str) -> DataFrame:
    scored = toxicity.toxic_documents(table(spark, base, "documents"), table(spark, base, "labels"), f"NOT ({HELD_OUT})")
    return scored.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted", "spans")


def op4_license_scan(spark: SparkSession, base: str) -> DataFrame:
    return licenses.license_blocks(table(spark, base, "documents"))


def op5_near_duplicates(spark: SparkSession, base: str) -> DataFrame:
    return near_duplicates.near_duplicates(table(spark, base, "documents"), shingle=2, percent=80)


def op6_suffix_dedup(spark: SparkSession, base: str) -> DataFrame:
    return suffix_dedup.repeats(table(spark, base, "documents")).drop("spans")


def op7_nearest_neighbours(spark: SparkSession, base: str) -> DataFrame:
    return neighbours.nearest(table(spark, base, "embeddings"), every=50, k=5)


def op8_quality(spark: SparkSession, base: str) -> DataFrame:
    return quality.quality_scores(table(spark, base, "documents"), table(spark, base, "labels"))


def op9_chat_tree(spark: SparkSession, base: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = table(spark, base, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat_tree.read_back(*chat_tree.prefix_tree(rows))


def op10_decontamination(spark: SparkSession, base: str) -> DataFrame:
    hits = decontamination.matched(table(spark, base, "documents"), table(spark, base, "benchmark"), window=10)
    names = F.concat_ws(",", F.array_sort(F.col("item_ids").cast("array<string>")))
    return hits.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
                       F.sha2(names.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op11_source_divergence(spark: SparkSession, base: str) -> DataFrame:
    return divergence.divergence_audit(table(spark, base, "documents"))


def op12_sharding(spark: SparkSession, base: str) -> DataFrame:
    rows = sharding.sharded(table(spark, base, "documents"), shards=16, columns=["doc_id"])
    return rows.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op13_fill_in_middle(spark: SparkSession, base: str) -> DataFrame:
    return middle_filling.digests(middle_filling.fill_in_middle(table(spark, base, "documents")))


QUERIES = {f.__name__: f for f in (
    op1_lm_scoring, op2_best_fit_packing, op3_toxicity, op4_license_scan, op5_near_duplicates, op6_suffix_dedup,
    op7_nearest_neighbours, op8_quality, op9_chat_tree, op10_decontamination, op11_source_divergence, op12_sharding,
    op13_fill_in_middle)}

# The other operators are compared with direct implementations in tests/llm.
SQL: dict[str, str] = {"op11_source_divergence": divergence.SQL, "op13_fill_in_middle": middle_filling.SQL}
