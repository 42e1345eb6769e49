"""Three-valued gates and robust residual statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import is_number, let, norm, sub
from .quantiles import exact_quantiles
from .ranges import frame_ranges

PASSED, FAILED, UNASSESSABLE = "passed", "failed", "unassessable"


@dataclass(frozen=True)
class GeometryCriteria:
    """Review limits over hand length; distance and depth difference are strict upper bounds."""

    wrist_distance_max: float = 1.5
    depth_min: float = 2.0
    depth_max: float = 10.0
    depth_difference_max: float = 2.0
    long_edge_min_px: float = 24.0
    foreground_min_px: float = 64.0


CHECKS = ("wrist_distance", "left_depth", "right_depth", "depth_difference")


def gate_state(value: Column, valid: Column, lower=None, upper=None, strict_upper: bool = False) -> Column:
    """State of one value: unknown or non-finite values are unassessable, never passed."""
    known = F.coalesce(valid, F.lit(False)) & is_number(value)
    bad = F.lit(False)
    if lower is not None:
        bad = bad | (value < lower)
    if upper is not None:
        bad = bad | ((value >= upper) if strict_upper else (value > upper))
    return F.when(~known, UNASSESSABLE).when(bad, FAILED).otherwise(PASSED)


def fold(states: Column) -> Column:
    """Aggregate of states: any failure fails, else any unknown (or nothing) is unassessable."""
    return (F.when(F.bool_or(states == FAILED), FAILED)
            .when(F.coalesce(F.bool_or(states != PASSED), F.lit(True)), UNASSESSABLE)
            .otherwise(PASSED))


def gate_summary(df: DataFrame, keys: Sequence[str], state: str = "state", value: str = "value",
                 frame: str = "frame") -> DataFrame:
    """Status, counts and min/median/max of the assessable values per key.

    Failed frames stay rows; see :func:`failed_ranges`.
    """
    known = F.when(F.col(state) != UNASSESSABLE, F.col(value))
    base = df.groupBy(*keys).agg(
        fold(F.col(state)).alias("status"), F.count(F.lit(1)).alias("frames"),
        F.count_if(F.col(state) == FAILED).alias("failed_frames"),
        F.count_if(F.col(state) == UNASSESSABLE).alias("unassessable_frames"),
        F.min(known).alias("minimum"), F.max(known).alias("maximum"))
    median = exact_quantiles(df, keys, known, {"median": 0.5}).drop("n")
    return base.join(median, list(keys), "left")


def failed_ranges(df: DataFrame, keys: Sequence[str], state: str = "state", frame: str = "frame") -> DataFrame:
    return frame_ranges(df.filter(F.col(state) == FAILED), keys, frame)


def geometry_ratios(left: Column, right: Column, hand_length: Column) -> dict[str, Column]:
    """The four scale-free ratios of a two-hand frame."""
    return {
        "wrist_distance": let(sub(left, right), norm) / hand_length,
        "left_depth": left.getItem(2) / hand_length,
        "right_depth": right.getItem(2) / hand_length,
        "depth_difference": F.abs(left.getItem(2) - right.getItem(2)) / hand_length}


def geometry_states(df: DataFrame, keys: Sequence[str], hand_length: Column,
                    criteria: GeometryCriteria = GeometryCriteria(), known: Column | None = None) -> DataFrame:
    """Long form (keys, frame, check, value, state) of the four geometry gates.

    ``df`` has ``left``/``right`` positions and ``left_valid``/``right_valid``. Without
    ``known`` geometry or a positive hand length every check is unassessable.
    """
    c = criteria
    usable = F.coalesce((hand_length > 0) & is_number(hand_length), F.lit(False)) & (
        F.lit(True) if known is None else F.coalesce(known, F.lit(False)))
    left_ok, right_ok = usable & F.col("left_valid"), usable & F.col("right_valid")
    both = left_ok & right_ok
    limits = {"wrist_distance": (both, None, c.wrist_distance_max, True),
              "left_depth": (left_ok, c.depth_min, c.depth_max, False),
              "right_depth": (right_ok, c.depth_min, c.depth_max, False),
              "depth_difference": (both, None, c.depth_difference_max, True)}
    ratios = geometry_ratios(F.col("left"), F.col("right"), hand_length)
    checks = F.array(*[
        F.struct(F.lit(name).alias("check"),
                 F.when(F.coalesce(valid, F.lit(False)) & is_number(ratios[name]), ratios[name]).alias("value"),
                 gate_state(ratios[name], valid, lo, hi, strict).alias("state"))
        for name, (valid, lo, hi, strict) in limits.items()])
    return df.select(*keys, "frame", F.inline(checks))


def overall(summary: DataFrame, keys: Sequence[str], known: Column | None = None) -> DataFrame:
    """Fold the checks of a clip. A hypothesis that passes is still only unassessable."""
    folded = summary.groupBy(*keys).agg(fold(F.col("status")).alias("numeric_status"))
    if known is None:
        return folded.withColumn("status", F.col("numeric_status"))
    return folded.withColumn("status", F.when(known | (F.col("numeric_status") == FAILED), F.col("numeric_status"))
                             .otherwise(UNASSESSABLE))


def two_sides(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per frame with ``left``/``right`` values and their validity."""
    is_left = F.col("side") == "left"
    wide = df.groupBy(*keys, "frame").agg(F.max(F.when(is_left, F.col(value))).alias("left"),
                                          F.max(F.when(~is_left, F.col(value))).alias("right"))
    return wide.withColumn("left_valid", F.col("left").isNotNull()) \
        .withColumn("right_valid", F.col("right").isNotNull())


def display_support_states(df: DataFrame, keys: Sequence[str],
                           criteria: GeometryCriteria = GeometryCriteria()) -> DataFrame:
    """Visible-pixel gates per hand sample (long form)."""
    rows = F.array(
        F.struct(F.lit("long_edge").alias("check"), F.col("long_edge_px").cast("double").alias("value"),
                 gate_state(F.col("long_edge_px").cast("double"), F.col("assessable"),
                            lower=criteria.long_edge_min_px).alias("state")),
        F.struct(F.lit("foreground").alias("check"), F.col("foreground_pixels").cast("double").alias("value"),
                 gate_state(F.col("foreground_pixels").cast("double"), F.col("assessable"),
                            lower=criteria.foreground_min_px).alias("state")))
    return df.select(*keys, "frame", F.inline(rows))


def residual_stats(df: DataFrame, keys: Sequence[str], value: Column) -> DataFrame:
    """n, mean, RMS, median, p95 and max of residuals; exact order statistics."""
    v = F.when(is_number(value), value)
    base = df.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.sqrt(F.avg(v * v)).alias("rms"), F.max(v).alias("maximum"))
    order = exact_quantiles(df, keys, v, {"median": 0.5, "p95": 0.95})
    return base.join(order, list(keys))


def vector_median(df: DataFrame, keys: Sequence[str], vector: str) -> DataFrame:
    """Component-wise median in long form (keys, i, median)."""
    long = df.select(*keys, F.posexplode(vector).alias("i", "v"))
    return exact_quantiles(long, [*keys, "i"], F.col("v").cast("double"), {"median": 0.5})


def category_counts(df: DataFrame, keys: Sequence[str], reasons: str) -> DataFrame:
    return df.select(*keys, F.explode(reasons).alias("reason")).groupBy(*keys, "reason").agg(
        F.count(F.lit(1)).alias("count"))
