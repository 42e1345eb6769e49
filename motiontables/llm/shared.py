"""Helpers of this folder: shared intermediates, fixed-size row filters, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILTER_WORDS = 1 << 17  # 64-bit words of a row filter: 1 MiB, whatever the input


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where it is absent on one machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """Write an intermediate to the shared folder and read it back: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit numbers."""
    with np.errstate(over="ignore"):
        return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


def table_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)],
        schema=schema)


def binary_views(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    """Arrow binary column from byte offsets and one byte buffer."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [
        None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def slots_of(ids: np.ndarray) -> np.ndarray:
    return mix64(ids.astype(np.int64).view(np.uint64)) & np.uint64(FILTER_WORDS * 64 - 1)


def id_filter(ids: DataFrame, column: str) -> np.ndarray:
    """A bit set of fixed size that holds every id of ``column``; others pass by chance only.

    It spares shuffling rows that cannot matter. Always follow it with an exact join: when ids
    are many, the set fills up, and the join then does all the work.
    """
    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(FILTER_WORDS, np.uint64)
        for batch in batches:
            slot = slots_of(batch.column(0).drop_null().to_numpy(zero_copy_only=False))
            np.bitwise_or.at(own, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(own[at].view(np.int64))], ["at", "bits"])

    parts = ids.select(F.col(column).cast("long")).mapInArrow(bits, "at int, bits long")
    found = parts.groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(FILTER_WORDS, np.uint64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    slot = slots_of(ids)
    return (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) != 0


def having(df: DataFrame, column: str, shared, inside: bool) -> DataFrame:
    """The rows whose id a broadcast row filter lets through, or the others."""
    place = df.columns.index(column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(place)
            found = passes(shared.value, own.cast("int64").fill_null(0).to_numpy(zero_copy_only=False)) & own.is_valid().to_numpy(
                zero_copy_only=False)
            yield batch.filter(pa.array(found == inside))

    return df.mapInArrow(keep, df.schema)


def parted(df: DataFrame, column: str, ids: DataFrame, ids_column: str) -> tuple[DataFrame, DataFrame]:
    """(rows of ``df`` whose id is not in ``ids``, the others and a few more): the row filter runs next to the scan."""
    shared = df.sparkSession.sparkContext.broadcast(id_filter(ids, ids_column))
    return having(df, column, shared, False), having(df, column, shared, True)


def narrowed(df: DataFrame, column: str, ids: DataFrame, ids_column: str) -> DataFrame:
    """The rows of ``df`` whose id is in ``ids``, and a few others."""
    return parted(df, column, ids, ids_column)[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b), for every node of an edge.

    Alternates large and small stars until the edges stay as they are. Every step is a minimum per
    node, pre-aggregated, and a join with it, so a node with very many neighbours is no single task's.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    sign = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = written(small)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if seen == sign or seen[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        sign = seen
