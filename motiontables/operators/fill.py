"""Dense timelines from sparse observations, every filled value labelled.

Observations are scanned while still sparse: each one learns its next observation, then
*expands to the right* over the gap it opens. No dense grid is shuffled or joined, and
interpolation has both endpoints in the same row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rotation import PARALLEL_DOT
from ..functions.vectors import dot, lerp_any, norm, scaled
from .blocks import FRAME_BLOCK, Scan, block_scan, count_changes
from .lineage_cut import cut

OBSERVED, INTERPOLATED, HOLD = "observed", "interpolated", "endpoint_hold"


def outside_frames(df: DataFrame, frame_count: Column | int, frame: str = "frame") -> DataFrame:
    """Observations that ``expand_gaps`` leaves out: no frame, or one outside 0..frame_count-1."""
    inside = (F.col(frame) >= 0) & (F.col(frame) < F.lit(frame_count))
    return df.filter(~F.coalesce(inside, F.lit(False)))


def expand_gaps(df: DataFrame, keys: Sequence[str], values: Sequence[str], frame_count: Column | int,
                frame: str = "frame", width: int = FRAME_BLOCK) -> DataFrame:
    """One row per (key, frame) in 0..frame_count-1. Observations outside these frames are left out
    (``outside_frames`` reports them); a repeated frame keeps its rows but fills no gap twice.

    Adds ``at`` (the output frame), ``left``/``right`` (structs of the neighbouring
    observations, ``right`` null when there is none), ``sample_kind``, ``source_frames``
    and ``alpha`` (null unless interpolated).
    """
    own = F.struct(F.col(frame).alias("frame"), *values)
    sparse = df.select(*keys, frame, *values, F.lit(frame_count).cast("long").alias("__n")).filter(
        (F.col(frame) >= 0) & (F.col(frame) < F.col("__n")))
    linked = block_scan(sparse, keys, [frame], [
        Scan("next", F.col(frame), "right_frame"), Scan("next", own, "right"),
        Scan("prev", F.col(frame), "__prev")], width)
    here = F.col(frame).cast("long")
    begin = F.when(F.col("__prev").isNull(), F.lit(0)).otherwise(here).cast("long")
    stop = F.greatest(F.coalesce(F.col("right_frame") - 1, F.col("__n") - 1).cast("long"), here)
    rows = linked.select(*keys, here.alias("left_frame"), "right_frame", own.alias("left"), "right",
                         F.explode(F.sequence(begin, stop)).alias("at"))
    seen = F.col("at") == F.col("left_frame")
    inside = F.col("right_frame").isNotNull() & (F.col("at") > F.col("left_frame"))
    return rows.select(
        "*",
        F.when(seen, OBSERVED).when(inside, INTERPOLATED).otherwise(HOLD).alias("sample_kind"),
        F.when(inside, F.array(F.col("left_frame"), F.col("right_frame")))
        .otherwise(F.array(F.col("left_frame"))).alias("source_frames"),
        F.when(inside, (F.col("at") - F.col("left_frame")) / (F.col("right_frame") - F.col("left_frame")))
        .alias("alpha"))


def fill_vectors(df: DataFrame, keys: Sequence[str], values: Sequence[str], frame_count: Column | int,
                 frame: str = "frame", width: int = FRAME_BLOCK) -> DataFrame:
    """Linear fill of array columns, endpoint hold outside the observed span."""
    rows = expand_gaps(df, keys, values, frame_count, frame, width)
    filled = [F.when(F.col("alpha").isNull(), F.col(f"left.{v}"))
              .otherwise(lerp_any(F.col(f"left.{v}"), F.col(f"right.{v}"), F.col("alpha"))).alias(v)
              for v in values]
    return rows.select(*keys, F.col("at").alias(frame), "sample_kind", "source_frames", "alpha", *filled)


def continuous_signs(df: DataFrame, keys: Sequence[str], quat: str, frame: str = "frame",
                     width: int = FRAME_BLOCK) -> DataFrame:
    """Choose q or -q so adjacent samples never point apart; the first has w >= 0.

    A flip happens exactly where neighbouring raw samples have a negative dot product, so
    the sign is the parity of a running count. A block contributes its first and last
    sample and its inner parity; a dot product of zero does not flip.
    """
    counted = count_changes(df, keys, [frame], F.col(quat), lambda a, b: dot(a, b, 4) < 0,
                            lambda q: q.getItem(3) < 0, "__flips", width)
    sign = F.when(F.col("__flips") % 2 == 0, 1.0).otherwise(-1.0)
    return counted.withColumn(quat, scaled(F.col(quat), sign, 4)).drop("__flips")


def fill_rotations(df: DataFrame, keys: Sequence[str], quat: str, frame_count: Column | int,
                   frame: str = "frame", width: int = FRAME_BLOCK) -> DataFrame:
    """SLERP fill with continuous signs.

    Interpolated samples keep the sign of their left endpoint and never point away from
    either endpoint, so signs are settled on the sparse observations before expanding.
    """
    # The gap scan reads its input twice; the sparse signed observations are materialised once.
    signed = cut(continuous_signs(df.select(*keys, frame, quat), keys, quat, frame, width))
    rows = expand_gaps(signed, keys, [quat], frame_count, frame, width)
    return slerp_rows(rows, F.col(f"left.{quat}"), F.col(f"right.{quat}"), F.col("alpha"), quat).select(
        *keys, F.col("at").alias(frame), "sample_kind", "source_frames", "alpha", quat)


def slerp_rows(rows: DataFrame, first: Column, second: Column, alpha: Column, name: str) -> DataFrame:
    """SLERP of whole rows in named steps, which the code generator compiles as plain arithmetic.

    Rows without ``alpha`` keep the first value.
    """
    present = alpha.isNotNull()
    sizes = rows.withColumn("__na", norm(first, 4)).withColumn("__nb", F.when(present, norm(second, 4)))
    cosine = sizes.withColumn("__c", dot(first, second, 4) / (F.col("__na") * F.col("__nb")))
    angles = cosine.withColumn("__near", F.abs("__c") > PARALLEL_DOT).withColumn(
        "__t", F.acos(F.least(F.abs("__c"), F.lit(1.0))))
    sine = F.sin("__t")
    wa = F.when(F.col("__near"), 1 - alpha).otherwise(F.sin((1 - alpha) * F.col("__t")) / sine) / F.col("__na")
    wb = F.when(F.col("__near"), alpha).otherwise(F.sin(alpha * F.col("__t")) / sine) / F.col("__nb")
    weights = angles.withColumn("__wa", wa).withColumn("__wb", F.when(F.col("__c") < 0, -wb).otherwise(wb))
    mixed = weights.withColumn("__m", F.array(*[
        F.col("__wa") * first.getItem(i) + F.col("__wb") * second.getItem(i) for i in range(4)]))
    scale = mixed.withColumn("__n", norm(F.col("__m"), 4))
    return scale.withColumn(name, F.when(present, scaled(F.col("__m"), 1 / F.col("__n"), 4)).otherwise(first)).drop(
        "__na", "__nb", "__c", "__near", "__t", "__wa", "__wb", "__m", "__n")


def nearest_anchors(df: DataFrame, keys: Sequence[str], value: Column, frame: str = "frame",
                    width: int = FRAME_BLOCK) -> DataFrame:
    """Previous and next known value of every row of an already dense timeline."""
    return block_scan(df, keys, [frame], [
        Scan("last_known", F.when(value.isNotNull(), F.struct(F.col(frame).alias("frame"), value.alias("value"))),
             "previous"),
        Scan("next_known", F.when(value.isNotNull(), F.struct(F.col(frame).alias("frame"), value.alias("value"))),
             "following")], width)


def quaternion_diagnostics(df: DataFrame, keys: Sequence[str], quat: str, frame: str = "frame",
                           width: int = FRAME_BLOCK) -> DataFrame:
    """Largest unit-length error and smallest adjacent dot product per key."""
    scanned = block_scan(df, keys, [frame], [Scan("prev", F.col(quat), "__q")], width)
    return scanned.groupBy(*keys).agg(
        F.max(F.abs(norm(F.col(quat), 4) - 1)).alias("max_unit_error"),
        F.coalesce(F.min(dot(F.col(quat), F.col("__q"), 4)), F.lit(1.0)).alias("min_adjacent_dot"))


def second_difference(df: DataFrame, keys: Sequence[str], value: str, frame: str = "frame",
                      weights: Sequence[float] = (1.0, 1.0, 3.0), width: int = FRAME_BLOCK) -> DataFrame:
    """Weighted acceleration ``x[f-1] - 2 x[f] + x[f+1]`` on three consecutive frames, else null."""
    own = F.struct(F.col(frame).alias("f"), F.col(value).alias("v"))
    s = block_scan(df, keys, [frame], [Scan("prev", own, "__a"), Scan("next", own, "__b")], width)
    adjacent = (F.col("__a.f") == F.col(frame) - 1) & (F.col("__b.f") == F.col(frame) + 1)
    acc = F.array(*[(F.col("__a.v").getItem(i) - 2 * F.col(value).getItem(i) + F.col("__b.v").getItem(i)) * wgt
                    for i, wgt in enumerate(weights)])
    return s.withColumn("acceleration", F.when(adjacent, acc)).drop("__a", "__b")
