"""Windowed and running aggregates on streams, and exactly-once publishing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_event_time(milliseconds: Column) -> Column:
    return F.timestamp_millis(milliseconds)


def sessions(events: DataFrame, keys: list[str], time: str, gap: str = "1200 milliseconds", delay: str = "10 seconds") -> DataFrame:
    """Track sessions: a gap above the limit closes one. ``time`` is a timestamp column."""
    return (events.withWatermark(time, delay).groupBy(*keys, F.session_window(time, gap).alias("session"))
            .agg(F.count(F.lit(1)).alias("rows"), F.min(time).alias("started"), F.max(time).alias("ended")))


def hopping_quality(frames: DataFrame, keys: list[str], fps: float, size: int = 15, stride: int = 5,
                    delay: str = "10 seconds") -> DataFrame:
    """Quality over hopping windows of frames, on the frame clock."""
    ms = 1000.0 / fps
    timed = frames.withColumn("__t", as_event_time(F.bround(F.col("frame") * ms).cast("long")))
    window = F.window("__t", f"{round(size * ms * 1000)} microseconds", f"{round(stride * ms * 1000)} microseconds")
    return (timed.withWatermark("__t", delay).groupBy(*keys, window.alias("window")).agg(
        F.count(F.lit(1)).alias("frames"), F.avg("score").alias("mean_score"),
        F.avg(F.col("blur_flag").cast("double")).alias("blur_share")))


def running_progress(frames: DataFrame, totals: DataFrame) -> DataFrame:
    """Completed fraction per clip; ``totals`` is a static table joined before the aggregate."""
    joined = frames.join(totals, "clip_id")
    return joined.groupBy("clip_id", "frames_total").agg((F.max("frame") + 1).alias("frames_completed")).withColumn(
        "fraction", F.least(F.try_divide("frames_completed", "frames_total"), F.lit(1.0)))


def publisher(path: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df, batch: str = "batch_id"):
    """A ``foreachBatch`` function that replaces its own batch partition.

    A replayed batch overwrites what it wrote before, so each batch appears exactly once.
    """
    def write(df: DataFrame, batch_id: int) -> None:
        (transform(df).withColumn(batch, F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(batch).parquet(path))

    return write
