"""Frame runs: gaps and islands, interval order, union length, interval difference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import FRAME_BLOCK, Scan, block_scan
from .lineage_cut import cut


def frame_ranges(df: DataFrame, keys: Sequence[str], frame: str = "frame",
                 width: int = FRAME_BLOCK) -> DataFrame:
    """Distinct frames as inclusive runs ``start..end``.

    Within a run ``frame - row_number`` is constant, so runs are a plain group-by on it;
    the row number is a block scan and the group-by combines before its shuffle.
    """
    distinct = df.select(*keys, F.col(frame).cast("long").alias("__f")).distinct()
    numbered = block_scan(distinct, keys, ["__f"], [Scan("sum", F.lit(1).cast("long"), "__rn")], width)
    return (numbered.groupBy(*keys, (F.col("__f") - F.col("__rn")).alias("__island"))
            .agg(F.min("__f").alias("start"), F.max("__f").alias("end"))
            .drop("__island"))


def flagged_ranges(df: DataFrame, keys: Sequence[str], flag: Column, frame: str = "frame",
                   width: int = FRAME_BLOCK) -> DataFrame:
    return frame_ranges(df.filter(flag), keys, frame, width)


def interval_order_issues(df: DataFrame, keys: Sequence[str], order: Sequence[str], start: str = "start",
                          end: str = "end", width: int = FRAME_BLOCK) -> DataFrame:
    """Intervals that are reversed or not strictly after the one listed before them."""
    scanned = block_scan(df, keys, order, [Scan("max_before", F.col(end), "__prev_end")], width)
    return (scanned.withColumn("issue", F.when(F.col(end) < F.col(start), "reversed")
                               .when(F.col(start) <= F.col("__prev_end"), "not_ordered_or_overlapping"))
            .filter(F.col("issue").isNotNull()).drop("__prev_end"))


def overlapping_windows(df: DataFrame, keys: Sequence[str], start: str = "start", end: str = "end",
                        width: int = FRAME_BLOCK) -> DataFrame:
    """Inclusive windows that overlap one that begins earlier (ties: any earlier row)."""
    scanned = block_scan(df, keys, [start, end], [Scan("max_before", F.col(end), "__prev_end")], width)
    return scanned.filter(F.col(start) <= F.col("__prev_end")).drop("__prev_end")


def union_length(df: DataFrame, keys: Sequence[str], low: str, high: str, width=FRAME_BLOCK) -> DataFrame:
    """Total length covered by half-open intervals; empty intervals are ignored.

    Each interval adds the part beyond the furthest end seen before it, so the union
    length is one running maximum and one sum, with no interval pairs at all.
    """
    valid = df.filter(F.col(high) > F.col(low)).select(*keys, low, high)
    scanned = block_scan(valid, keys, [low, high], [Scan("max_before", F.col(high), "__reach")], width)
    beyond = F.col(high) - F.greatest(F.col(low), F.coalesce(F.col("__reach"), F.col(low)))
    return scanned.groupBy(*keys).agg(F.sum(F.greatest(beyond, F.lit(0))).alias("covered"))


def merged_intervals(df: DataFrame, keys: Sequence[str], low: str, high: str, width=FRAME_BLOCK) -> DataFrame:
    """Maximal half-open intervals of the union (touching intervals join).

    With ``width`` None a key is scanned by one task: for keys that are bounded by nature, like a row of pixels.
    Nothing moves then if ``df`` is dealt out by some of the keys.
    """
    valid = df.filter(F.col(high) > F.col(low)).select(*keys, low, high)
    begins = F.when(F.col("__reach").isNull() | (F.col(low) > F.col("__reach")), 1).otherwise(0).cast("long")
    if width is None:
        w = Window.partitionBy(*keys).orderBy(low, high)
        reach = valid.withColumn("__reach", F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1)))
        grouped = reach.withColumn("__new", begins).withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        reach = block_scan(valid, keys, [low, high], [Scan("max_before", F.col(high), "__reach")], width)
        opens = reach.withColumn("__new", begins)
        grouped = block_scan(cut(opens), keys, [low, high], [Scan("sum", F.col("__new"), "__island")], width)
    return (grouped.groupBy(*keys, "__island").agg(F.min(low).alias(low), F.max(high).alias(high))
            .drop("__island"))


def coverage_points(df: DataFrame, keys: Sequence[str], low: str, high: str, side: Column,
                    width=FRAME_BLOCK) -> DataFrame:
    """Positions at which an interval begins or ends: ``in_a`` and ``in_b``, how many 'a' and 'b' intervals
    cover what follows, and ``da`` and ``db``, by how much these differ from what goes before.

    ``side`` is true for set a. Boundary events are summed per position first, so a
    position shared by many intervals is one row before the scan.
    """
    valid = df.filter(F.col(high) > F.col(low)).select(*keys, F.col(low).alias("__lo"),
                                                       F.col(high).alias("__hi"), side.alias("__a"))
    events = valid.select(*keys, "__a", F.inline(F.array(
        F.struct(F.col("__lo").alias("pos"), F.lit(1).alias("step")),
        F.struct(F.col("__hi").alias("pos"), F.lit(-1).alias("step")))))
    points = events.groupBy(*keys, "pos").agg(
        F.sum(F.when(F.col("__a"), F.col("step")).otherwise(0)).alias("da"),
        F.sum(F.when(~F.col("__a"), F.col("step")).otherwise(0)).alias("db"))
    return block_scan(points, keys, ["pos"], [Scan("sum", F.col("da"), "in_a"), Scan("sum", F.col("db"), "in_b")], width)


def interval_difference(df: DataFrame, keys: Sequence[str], low: str, high: str, side: Column,
                        width=FRAME_BLOCK) -> DataFrame:
    """Pixels of a without b (``part`` 'a_only') and of b without a ('b_only').

    Only positions at which the part changes go on; each part ends at the next of them.
    """
    def part(a: Column, b: Column) -> Column:
        return F.when((a > 0) & (b == 0), "a_only").when((b > 0) & (a == 0), "b_only")

    points = coverage_points(df, keys, low, high, side, width)
    after, before = part(F.col("in_a"), F.col("in_b")), part(F.col("in_a") - F.col("da"), F.col("in_b") - F.col("db"))
    turns = cut(points.filter(~before.eqNullSafe(after)).select(*keys, "pos", after.alias("part")))
    spans = block_scan(turns, keys, ["pos"], [Scan("next", F.col("pos"), "until")], width)
    return spans.filter(F.col("part").isNotNull()).select(*keys, "part", F.col("pos").alias(low), F.col("until").alias(high))
