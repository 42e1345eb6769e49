"""Motion-shaped views over warehouse tables (events, lineitem, embeddings, ...).

They let every operator run on whole tables: users act as clips, six-hour slots as
frames, event kinds as hand sides, order lines as pixel runs. Each view only projects
columns, so scans stay pruned and rows are never dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEFT_KINDS = ("click", "view")
SCORE_UNIT = 500.0


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def event_day(ts: Column) -> Column:
    return F.date_diff(ts.cast("date"), F.lit("2024-01-01").cast("date"))


def event_ms(ts: Column) -> Column:
    """Milliseconds since 2024-01-01, free of any session time zone."""
    micros = (F.extract(F.lit("SECOND"), ts) * 1000000).cast("long")
    seconds = (event_day(ts).cast("long") * 24 + F.hour(ts)) * 3600 + F.minute(ts) * 60
    return seconds * 1000 + F.floor(micros / 1000)


def first_day(spark: SparkSession, base: str) -> Column:
    """The day of the earliest event, as a subquery: the timeline that all clips share begins there."""
    return table(spark, base, "events").agg(F.min(F.col("ts").cast("date"))).scalar()


def frame_count(spark: SparkSession, base: str) -> int:
    """Frames of the timeline that all clips share: four a day from the first to the last day of the events."""
    days = F.date_diff(F.max(F.col("ts").cast("date")), F.min(F.col("ts").cast("date")))
    last = table(spark, base, "events").agg(days).first()[0]
    return 0 if last is None else 4 * (last + 1)


def observations(spark: SparkSession, base: str) -> DataFrame:
    """Hand observations: clip, frame, side, detection id, score, position, rotation."""
    e = table(spark, base, "events")
    k = F.regexp_extract("props", r'"k": *(-?[0-9.]+)', 1).cast("double")
    half = F.col("value") * (F.pi() / SCORE_UNIT) / 2
    return e.select(
        F.col("user_id").alias("clip_id"),
        (F.date_diff(F.col("ts").cast("date"), first_day(spark, base)) * 4 + F.floor(F.hour("ts") / 6)).cast("long").alias("frame"),
        F.when(F.col("event_type").isin(*LEFT_KINDS), "left").otherwise("right").alias("side"),
        F.col("event_id").alias("det_idx"),
        F.col("event_type").alias("kind"),
        (F.col("value") / SCORE_UNIT).alias("score"),
        (F.col("event_type") == "error").alias("ambiguous"),
        F.array(F.col("value"), F.col("value") / 2, k).alias("trans"),
        F.array(F.lit(0.0), F.lit(0.0), F.sin(half), F.cos(half)).alias("quat"),
        event_ms(F.col("ts")).alias("timestamp_ms"))


def states(spark: SparkSession, base: str) -> DataFrame:
    """Per-user state timeline; an error is an unknown state."""
    o = table(spark, base, "events")
    return o.select(F.col("user_id").alias("clip_id"), event_ms(F.col("ts")).alias("at_ms"),
                    F.col("event_id").alias("seq"),
                    F.when(F.col("event_type") != "error", F.col("event_type")).alias("state"))


def boxes(spark: SparkSession, base: str) -> DataFrame:
    """Pixel runs: one order line is a run ``[x0, x1)`` on row ``l_linenumber`` of an order."""
    li = table(spark, base, "lineitem")
    return li.select(F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").cast("long").alias("y"),
                     F.col("l_suppkey").alias("object_id"), F.col("l_partkey").alias("part_id"),
                     F.col("l_returnflag").alias("flag"),
                     F.col("l_linenumber").cast("long").alias("x0"),
                     (F.col("l_linenumber") + F.col("l_quantity")).cast("long").alias("x1"))
