"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096


def clip_bucket(buckets: int = BUCKETS, frame: str | None = None, frames_per_part: int = 1 << 20):
    """Directory bucket of a row. With ``frame``, a very long clip spreads over several buckets."""
    parts = [F.col("clip_id")]
    if frame:
        parts.append(F.floor(F.col(frame) / frames_per_part))
    return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")


def write_facts(df: DataFrame, path: str, buckets: int = BUCKETS, order: tuple[str, ...] = ("clip_id", "frame"),
                frame: str | None = "frame") -> None:
    """Write a fact table partitioned by clip bucket and sorted inside; refuse an existing target.

    The bucket and a row-range slice are the shuffle key, so one directory may be written
    by several tasks when a clip is hot.
    """
    tagged = df.withColumn("clip_bucket", clip_bucket(buckets, frame))
    (tagged.repartition("clip_bucket").sortWithinPartitions("clip_bucket", *order)
     .write.mode("errorifexists").partitionBy("clip_bucket").parquet(path))


def write_documents(documents: DataFrame, path: str) -> None:
    documents.select("document").write.mode("errorifexists").text(path)
