"""Job logs, run progress, views manifests and container metadata."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import camera_category
from ..functions.vectors import is_number
from ..schemas import FRAME_LOG, JOB_EVENT, METADATA_RECORD, VIEW_MANIFEST
from .blocks import Scan, block_scan

# Terminal states, strongest first. A cancel wins over a failure.
TERMINAL = ("cancelled", "failed", "succeeded")
BASE_PROGRESS = (("preflight", 0.0), ("reconstruct", 0.02), ("import", 0.46), ("bake", 0.5), ("verify", 0.76),
                 ("preview", 0.85), ("complete", 1.0))
STAGE_SPAN = (("reconstruct", 0.44), ("bake", 0.26))


def read_job_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(JOB_EVENT).json(path)


def read_frame_log(spark: SparkSession, path: str) -> DataFrame:
    """Append-only frame log; a torn last line is kept as ``_corrupt_record``, not lost."""
    return spark.read.schema(FRAME_LOG + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def stream_frame_log(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return (spark.readStream.schema(FRAME_LOG).option("maxFilesPerTrigger", files_per_trigger).json(path))


def explode_views(log: DataFrame) -> DataFrame:
    """(clip, view, frame) rows of a frame log."""
    return log.select("clip_id", "frame", "timestamp_ms", "time_seconds", F.explode("views").alias("view_id", "v")) \
        .select("clip_id", "view_id", "frame", "timestamp_ms", "time_seconds", "v.*")


def explode_hands(views: DataFrame) -> DataFrame:
    """One row per detection; a frame without any keeps one row with a null side."""
    h = views.select("clip_id", "view_id", "frame", "timestamp_ms", "available", "source_frame", "blur_flag",
                     F.posexplode_outer("hands").alias("det_idx", "h"))
    return h.select(
        "clip_id", "view_id", "frame", "timestamp_ms", "available", "source_frame", "blur_flag", "det_idx",
        F.col("h.side").alias("side"), F.col("h.handedness_confidence").alias("score"),
        (F.size("h.outside_image_joints") > 0).alias("outside"), F.col("h.mano").isNotNull().alias("has_parameters"),
        F.coalesce(F.col("h.diagnostics.ambiguous"), F.lit(False)).alias("ambiguous"),
        F.col("h.image_landmarks").alias("landmarks"), F.col("h.mano.shape").alias("shape"), F.col("h.diagnostics").alias("diagnostics"))


def serialise_landmarks(hands: DataFrame, width: Column, height: Column, image: str = "image_landmarks",
                        world: str = "world_landmarks") -> DataFrame:
    """Pixel landmarks, wrist-relative landmarks and the joints outside the image."""
    wrist = F.col(world).getItem(0)
    outside = F.filter(F.transform(image, lambda p, i: F.when(
        (p.getItem(0) < 0) | (p.getItem(0) > 1) | (p.getItem(1) < 0) | (p.getItem(1) > 1), i)), lambda i: i.isNotNull())
    return hands.select(
        "*", F.transform(image, lambda p: F.array(p.getItem(0) * width, p.getItem(1) * height)).alias("landmarks_px"),
        F.transform(world, lambda p: F.array(*[p.getItem(i) - wrist.getItem(i) for i in range(3)])).alias("wrist_relative"),
        outside.alias("outside_joints"))


def read_view_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(VIEW_MANIFEST).option("multiLine", True).json(path)


def manifest_views(manifest: DataFrame) -> DataFrame:
    return manifest.select("clip_id", "primary_view", F.posexplode("views").alias("position", "v")).select(
        "clip_id", "primary_view", "position", F.col("v.id").alias("view_id"), F.col("v.video").alias("video"),
        F.coalesce("v.offset_seconds", F.lit(0.0)).alias("offset_seconds"), F.col("v.calibration").alias("calibration"))


def manifest_violations(views: DataFrame) -> DataFrame:
    """Manifests with repeated ids, no single primary, blank names or a non-finite offset."""
    per = views.groupBy("clip_id", "view_id").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.col("view_id") == F.col("primary_view")).alias("primary"),
        F.bool_or(F.coalesce(F.length("view_id"), F.lit(0)) == 0).alias("blank"),
        F.bool_or(F.coalesce(F.length("video"), F.lit(0)) == 0).alias("no_video"),
        F.bool_or(~F.coalesce(is_number(F.col("offset_seconds")), F.lit(False))).alias("bad_offset"))
    clip = per.groupBy("clip_id").agg(
        F.bool_or(F.col("n") > 1).alias("repeat"), F.count_if("primary").alias("primaries"),
        F.bool_or("blank").alias("blank"), F.bool_or("no_video").alias("no_video"), F.bool_or("bad_offset").alias("bad_offset"))
    issue = F.array_compact(F.array(
        F.when(F.col("repeat"), "view ids must be unique"), F.when(F.col("primaries") != 1, "primary view must identify one"),
        F.when(F.col("blank"), "view id is empty"), F.when(F.col("no_video"), "video path is empty"),
        F.when(F.col("bad_offset"), "offset must be finite")))
    return clip.select("clip_id", F.explode(issue).alias("message"))


# ---- job state ----------------------------------------------------------

def latest_state(log: DataFrame, keys: Sequence[str], order: Column, stage: Column, status: Column) -> DataFrame:
    """Latest stage and final status: cancel beats failure beats success, else running."""
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, TERMINAL)), status), F.lit(0))
    best = F.min(F.when(rank > 0, rank))
    final = F.element_at(F.array(*map(F.lit, TERMINAL)), best.cast("int"))
    return log.groupBy(*keys).agg(
        F.max_by(stage, order).alias("stage"), F.max(order).alias("latest"), F.count(F.lit(1)).alias("events"),
        F.when(best.isNotNull(), final).otherwise("running").alias("status"))


def stage_durations(log: DataFrame, keys: Sequence[str], order: Sequence[str], stage: str, width) -> DataFrame:
    """Time from each log row to the next one of the same job; the last row has none."""
    s = block_scan(log, keys, order, [Scan("next", F.col(order[0]), "__next")], width)
    return s.withColumn("duration", F.col("__next") - F.col(order[0])).drop("__next")


def progress(frames: DataFrame, totals: DataFrame, keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Completed frames over the declared total; a zero total gives zero."""
    done = frames.groupBy(*keys).agg((F.max("frame") + 1).alias("frames_completed"))
    fraction = F.least(F.coalesce(F.try_divide("frames_completed", "frames_total"), F.lit(0.0)), F.lit(1.0))
    return totals.join(done, list(keys), "left").withColumn(
        "frames_completed", F.coalesce("frames_completed", F.lit(0))).withColumn("fraction", fraction)


def stage_progress(stage: Column, fraction: Column) -> Column:
    """Overall progress of a job from its stage and the stage's own fraction."""
    base = F.create_map(*[F.lit(x) for pair in BASE_PROGRESS for x in pair])
    span = F.create_map(*[F.lit(x) for pair in STAGE_SPAN for x in pair])
    return F.try_element_at(base, stage) + F.coalesce(F.try_element_at(span, stage), F.lit(0.0)) * fraction


# ---- container metadata -------------------------------------------------

def read_metadata_records(spark: SparkSession, path: str) -> DataFrame:
    schema = f"clip_id string, metadata_records array<struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in METADATA_RECORD.split(','))}>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select("clip_id", F.inline("metadata_records"))


def declared_without_value(keys: DataFrame, records: DataFrame, by: Sequence[str]) -> DataFrame:
    """Declared camera keys without a stored value: kept as evidence, not as absence."""
    cams = keys.withColumn("category", camera_category(F.col("key"))).filter(F.col("category").isNotNull())
    return cams.join(records.select(*by).distinct(), list(by), "left_anti")


def category_status(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status per clip: camera fields present (never sufficient on their own) or absent."""
    c = records.withColumn("category", camera_category(F.col("key")))
    return c.groupBy(*keys).agg(F.count(F.lit(1)).alias("records"), F.count("category").alias("camera_fields")).withColumn(
        "status", F.when(F.col("camera_fields") > 0, "fields_present_insufficient").otherwise("fields_absent"))


def reuse_inference(frames: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One representative per source frame, so expensive work runs once and is joined back."""
    return frames.dropDuplicates([*keys, "source_frame"])


