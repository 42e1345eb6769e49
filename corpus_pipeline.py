"""From raw documents to packed training sequences: five stages, each reading what the one before has kept.

Defined cases: null and empty texts are documents without words; the classifier judges them like others, no stage links,
cuts or drops them for their text, and packing gives them their end id. Rows with a null doc_id are in no group and stay.
Of rows that repeat a doc_id near-duplicate removal keeps all or none. Empty tables give empty results. Further columns
stay with their rows under their own names, also where a stage uses such a name itself.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from motiontables.llm import decontamination, near_duplicates, packing, quality, suffix_dedup
from motiontables.llm.shared import shared_folder


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def in_small_batches(spark: SparkSession) -> None:
    """Texts pass between the JVM and Python in batches that each side holds several times over, so these are kept small:
    by default ten thousand texts go at once. Every row still goes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def keeping_names(stage: Callable) -> Callable:
    """The stage on columns of neutral names: only those of the documents table are known to it."""
    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        in_small_batches(spark)
        neutral = [c if c in COLUMNS else f"further_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*neutral), sf_dir).toDF(*docs.columns)
    return run


@keeping_names
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier accepts."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@keeping_names
def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each near-duplicate group: five-word shingles, similarity 0.8."""
    return near_duplicates.first_of_near_duplicates(docs, shingle=5, percent=80)


@keeping_names
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has."""
    return suffix_dedup.deduplicated(docs)


@keeping_names
def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without benchmark passages; documents that are little else go."""
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences and where each lies."""
    in_small_batches(spark)
    return packing.best_fit_packed(docs)


STAGES = [
    ("quality classifier", good_quality),
    ("near-duplicate removal", one_of_near_copies),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmarks),
    ("best-fit packing", packed),
]

ORACLE_SQL = None  # classifiers, automata and packing have no SQL; tests/llm compares the stages with direct implementations


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
