"""Timelines: alignment of views, completeness, sampling, hopping windows, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.camera import source_frame
from .blocks import FRAME_BLOCK, Scan, block_scan
from .ranges import frame_ranges


def align_views(timeline: DataFrame, views: DataFrame, frames: DataFrame) -> DataFrame:
    """Nearest source frame of each view for each timeline frame.

    ``timeline(clip_id, frame, time_seconds)``, ``views(clip_id, view_id, fps,
    offset_seconds, frame_count)``, ``frames(clip_id, view_id, source_frame, ...)``.
    The nearest frame is arithmetic, so the as-of join becomes an equi join. A frame
    outside the view stays in the result as unavailable.
    """
    target = timeline.join(views, "clip_id").withColumn(
        "source_frame", source_frame(F.col("time_seconds"), F.col("fps"), F.col("offset_seconds")))
    inside = F.col("source_frame").between(0, F.col("frame_count") - 1)
    joined = target.join(frames.withColumn("__hit", F.lit(True)), ["clip_id", "view_id", "source_frame"], "left")
    return joined.withColumn("available", inside & F.col("__hit").isNotNull()).drop("__hit")


def reused_source_frames(df: DataFrame, keys: Sequence[str], width: int = FRAME_BLOCK) -> DataFrame:
    """Flag rows that map to the same source frame as the row before them."""
    s = block_scan(df, keys, ["frame"], [Scan("prev", F.col("source_frame"), "__p")], width)
    return s.withColumn("reused_source_frame", F.coalesce(F.col("source_frame") == F.col("__p"), F.lit(False))) \
        .drop("__p")


def sequence_check(df: DataFrame, keys: Sequence[str], frame: str = "frame", timestamp: str | None = None,
                   width: int = FRAME_BLOCK) -> DataFrame:
    """Per key: row count, span, gaps, repeats, non-increasing timestamps, completeness."""
    scans = [Scan("prev", F.col(frame), "__f")]
    order = [frame]
    if timestamp:
        scans.append(Scan("prev", F.col(timestamp), "__t"))
        order.append(timestamp)
    s = block_scan(df, keys, order, scans, width)
    step = F.col(frame) - F.col("__f")
    late = (F.col(timestamp) <= F.col("__t")) if timestamp else F.lit(False)
    out = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"),
        F.count_if(step > 1).alias("gaps"), F.count_if(step == 0).alias("repeats"),
        F.count_if(late).alias("not_increasing"))
    complete = ((F.col("first_frame") == 0) & (F.col("last_frame") == F.col("rows") - 1)
                & (F.col("gaps") == 0) & (F.col("repeats") == 0))
    return out.withColumn("complete", complete)


def late_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], timestamp: str,
              width=FRAME_BLOCK) -> DataFrame:
    """Rows whose timestamp does not exceed every earlier one (in arrival order)."""
    s = block_scan(df, keys, order, [Scan("max_before", F.col(timestamp), "__m")], width)
    return s.filter(F.col(timestamp) <= F.col("__m")).drop("__m")


def first_frames(df: DataFrame, limit: int, frame: str = "frame") -> DataFrame:
    """Keep the first ``limit`` frames of every clip; a filter the scan can use."""
    return df.filter(F.col(frame) < limit)


def sample_indices(frame_count: Column, samples: int = 12) -> Column:
    """Evenly spaced distinct frame indices, ends included, ties to even."""
    k = F.least(F.lit(samples), frame_count).cast("int")
    span = (frame_count - 1).cast("double")
    step = F.when(k > 1, span / (k - 1)).otherwise(F.lit(0.0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.bround(i * step).cast("long")))


def sampled_rows(df: DataFrame, clips: DataFrame, samples: int = 12) -> DataFrame:
    """Rows of the sampled frames; ``clips`` holds (clip_id, frame_count)."""
    wanted = clips.select("clip_id", F.explode(sample_indices(F.col("frame_count"), samples)).alias("frame"))
    return df.join(wanted, ["clip_id", "frame"], "left_semi")


def hopping_windows(df: DataFrame, frame_count: Column | int, size: int = 15, stride: int = 5,
                    frame: str = "frame") -> DataFrame:
    """Add one row per window a frame belongs to; the last window is right-aligned.

    Window starts are the multiples of ``stride`` that fit, plus ``n - size``. A frame
    computes its own few starts, so nothing is joined.
    """
    n = F.lit(frame_count).cast("long")
    span = F.least(F.lit(size), n)
    last = n - span
    f = F.col(frame).cast("long")
    first_k = F.greatest(F.ceil((f - span + 1) / stride), F.lit(0)).cast("long")
    last_k = F.floor(F.least(f, last) / stride).cast("long")
    inside = (f >= 0) & (f < n)  # a frame outside the clip is in no window
    regular = F.when(inside & (first_k <= last_k), F.transform(F.sequence(first_k, last_k), lambda k: k * stride)) \
        .otherwise(F.array().cast("array<bigint>"))
    tail = F.when(inside & (f >= last), F.array(last)).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("window_start", F.explode(F.array_distinct(F.concat(regular, tail))))


def view_frames(hands: DataFrame, keys: Sequence[str], low_score: float) -> DataFrame:
    """One row per (view, frame) with the counts and flags a summary needs.

    ``hands`` has one row per detection; a frame without detections is one row whose
    ``side`` is null. Everything combines before the shuffle.
    """
    has = F.col("side").isNotNull() & F.col("available")
    left, right = has & (F.col("side") == "left"), has & (F.col("side") == "right")
    per = hands.groupBy(*keys, "frame").agg(
        F.bool_or("available").alias("available"),
        F.count_if(has).alias("hands"), F.count_if(left).alias("left_hands"),
        F.count_if(right).alias("right_hands"),
        F.sum(F.when(has, F.col("score"))).alias("score_sum"),
        F.count_if(has & ((F.col("score") < low_score) | F.coalesce(F.col("outside"), F.lit(False))))
        .alias("weak_hands"),
        F.bool_or(has & F.coalesce(F.col("has_parameters"), F.lit(False))).alias("has_parameters"),
        F.bool_or(F.coalesce(F.col("blur_flag"), F.lit(False)) & F.col("available")).alias("blur"))
    sides = (F.col("left_hands") > 0).cast("int") + (F.col("right_hands") > 0).cast("int")
    ambiguous = sides < F.col("hands")
    return (per.withColumn("ambiguous", ambiguous)
            .withColumn("both", (F.col("left_hands") > 0) & (F.col("right_hands") > 0))
            .withColumn("review", F.col("available")
                        & ((F.col("hands") < 2) | (F.col("weak_hands") > 0) | ambiguous)))


def view_summary(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Summary per view from :func:`view_frames`; unknown rates stay null."""
    available = F.count_if(F.col("available"))
    valid = F.count_if(F.col("available") & (F.col("hands") > 0))
    hands = F.sum("hands")
    return frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("timeline_frames"), available.alias("available_frames"),
        valid.alias("valid_frames"), F.try_divide(valid, available).alias("valid_frame_rate"),
        F.count_if("both").alias("both_sides_frames"),
        F.count_if(F.col("hands") == 2).alias("two_observation_frames"),
        hands.alias("hand_observations"), F.try_divide(F.sum("score_sum"), hands).alias("mean_score"),
        F.sum("left_hands").alias("left_observations"), F.sum("right_hands").alias("right_observations"),
        F.count_if(F.col("left_hands") > 0).alias("left_frames"),
        F.count_if(F.col("right_hands") > 0).alias("right_frames"),
        F.count_if("has_parameters").alias("parameter_frames"))


def review_ranges(frames: DataFrame, keys: Sequence[str], width: int = FRAME_BLOCK) -> DataFrame:
    """Runs of frames to review, by reason: ``review``, ``ambiguous`` or ``blur``."""
    reasons = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in ("review", "ambiguous", "blur")]))
    tagged = frames.select(*keys, "frame", F.explode(reasons).alias("reason"))
    return frame_ranges(tagged, [*keys, "reason"], "frame", width)


def run_rejections(frames: DataFrame, keys: Sequence[str], max_blur_share: float = 0.8) -> DataFrame:
    """Runs without any hand, or with too many blurred frames."""
    out = frames.groupBy(*keys).agg(
        F.avg(F.col("blur").cast("double")).alias("blur_share"),
        F.count_if(F.col("available") & (F.col("hands") > 0)).alias("valid_frames"))
    reason = (F.when(F.col("valid_frames") == 0, "no_hand_detected")
              .when(F.col("blur_share") > max_blur_share, "blurred_majority"))
    return out.withColumn("rejection", reason)


def usability_summary(samples: DataFrame, keys: Sequence[str], score: str = "confidence") -> DataFrame:
    """Mean usability over all samples, filled ones counting as zero."""
    effective = F.when(F.col("sample_kind") == "observed", F.col(score)).otherwise(0.0)
    return samples.groupBy(*keys).agg(F.avg(effective).alias("mean_confidence"),
                                      F.count_if(effective < 0.5).alias("low_frames"))


def low_confidence_ranges(samples: DataFrame, keys: Sequence[str], score: str = "confidence",
                          limit: float = 0.5, width: int = FRAME_BLOCK) -> DataFrame:
    effective = F.when(F.col("sample_kind") == "observed", F.col(score)).otherwise(0.0)
    return frame_ranges(samples.filter(effective < limit), keys, "frame", width)
