"""Text helpers: ASCII folding, captions, range text, canonical hashing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The only letters the contract folds.
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"

SHA256_PATTERN = "^[0-9a-fA-F]{64}$"
SAFE_ID_PATTERN = "^[A-Za-z0-9_-]+$"


def ascii_fold(c: Column) -> Column:
    """Lower-case A-Z only; every other code point is left alone."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike(SHA256_PATTERN), F.lit(False))


def is_safe_id(c: Column) -> Column:
    return F.coalesce(c.rlike(SAFE_ID_PATTERN), F.lit(False))


def is_text(c: Column) -> Column:
    """Present and not blank."""
    return F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))


def range_text(start: Column, end: Column) -> Column:
    """``3`` for a single frame, ``3–7`` for a run."""
    return F.when(start == end, start.cast("string")).otherwise(
        F.concat_ws("–", start.cast("string"), end.cast("string")))


def frame_caption(frame: Column, time_seconds: Column, state: Column) -> Column:
    return F.format_string("frame %06d | %.3f s | %s", frame, time_seconds, state)


def digest(*columns: Column) -> Column:
    """SHA-256 over typed leaves; null is kept apart from the empty string."""
    leaves = [F.coalesce(F.concat(F.lit("v"), c.cast("string")), F.lit("n")) for c in columns]
    return F.sha2(F.concat_ws("\u001f", *leaves), 256)


# Camera metadata categories and the fragments that name them.
CATEGORY_35MM = "focal_length_35mm_equivalent"
CATEGORY_FOCAL = "focal_length_or_focal_metadata"
CATEGORY_SENSOR = "sensor_geometry"
CATEGORY_CAMERA = "camera_geometry"
FRAGMENTS_35MM = ("35mm", "35milli", "35film")
FRAGMENTS_SENSOR = ("width", "height", "size", "dimension", "crop")
FRAGMENTS_CAMERA = ("intrinsic", "cameramatrix", "principalpoint", "lensdistortion")


def _mentions(text: Column, fragments) -> Column:
    return text.rlike("|".join(fragments))


def camera_category(key: Column) -> Column:
    """Which camera fact a metadata key talks about, or null for none."""
    flat = F.regexp_replace(F.lower(key), "[^a-z0-9]", "")
    focal, sensor = flat.contains("focal"), flat.contains("sensor")
    return (F.when(focal & _mentions(flat, FRAGMENTS_35MM), CATEGORY_35MM)
            .when(focal, CATEGORY_FOCAL)
            .when(sensor & _mentions(flat, FRAGMENTS_SENSOR), CATEGORY_SENSOR)
            .when(_mentions(flat, FRAGMENTS_CAMERA), CATEGORY_CAMERA))
