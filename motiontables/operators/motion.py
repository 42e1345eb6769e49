"""Feature correspondences between adjacent frames and image-motion verdicts."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.camera import homography_error
from ..functions.scoring import MotionLimits, coverage_reasons, feature_reasons, is_separable, motion_verdict
from ..functions.vectors import norm, sub
from .blocks import Scan, block_scan, row_numbers
from .quantiles import bounded_quantiles

TRACK_KEYS = ("clip_id", "frame", "object_id")


def frame_pairs(df: DataFrame, keys: Sequence[str], values: Sequence[str], frame: str = "frame",
                width: int = 4096) -> DataFrame:
    """Rows with their successor at exactly ``frame + 1`` as ``following``."""
    own = F.struct(F.col(frame).alias("f"), *values)
    s = block_scan(df, keys, [frame], [Scan("next", own, "following")], width)
    return s.filter(F.col("following.f") == F.col(frame) + 1)


def accept_features(features: DataFrame, limits: MotionLimits = MotionLimits()) -> DataFrame:
    """Adds round-trip error, reasons and acceptance to feature rows."""
    trip = F.when(F.col("src").isNotNull() & F.col("back").isNotNull(), norm(sub(F.col("back"), F.col("src"), 2), 2))
    reasons = feature_reasons(F.col("forward_ok"), F.col("backward_ok"), trip, F.col("inside"), limits)
    return (features.withColumn("round_trip_px", trip).withColumn("reasons", reasons)
            .withColumn("accepted", F.size("reasons") == 0))


def rejection_counts(features: DataFrame, keys: Sequence[str]) -> DataFrame:
    return features.select(*keys, F.explode("reasons").alias("reason")).groupBy(*keys, "reason").agg(
        F.count(F.lit(1)).alias("count"))


def displacement(features: DataFrame, keys: Sequence[str] = TRACK_KEYS) -> DataFrame:
    """Median displacement and round-trip statistics of accepted features of one track."""
    ok = features.filter("accepted")
    parts = None
    for name, value in (("dx", F.col("dst").getItem(0) - F.col("src").getItem(0)),
                        ("dy", F.col("dst").getItem(1) - F.col("src").getItem(1)),
                        ("trip", F.col("round_trip_px"))):
        q = bounded_quantiles(ok, keys, value, {f"median_{name}": 0.5, f"p95_{name}": 0.95})
        parts = q if parts is None else parts.join(q.drop("n"), list(keys))
    return parts.drop("p95_dx", "p95_dy")


def hull(points: np.ndarray) -> np.ndarray:
    """Convex hull vertices, counter-clockwise, by sorted sweep."""
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(seq):
        chain = []
        for p in seq:
            while len(chain) > 1 and ((chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1])
                                      - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])) <= 0:
                chain.pop()
            chain.append(p)
        return chain[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def _hulls(points: DataFrame, keys: Sequence[str], x: str, y: str, schema: str, result) -> DataFrame:
    """``result(key values, hull vertices)`` of each group, given as columns.

    On one x only the lowest and the highest point can be a vertex, and these two are a plain aggregate that combines
    before its shuffle. A group then comes to Python once, with two points for each of its x.
    """
    keys = list(keys)
    ends = points.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).groupBy(*keys, "x").agg(
        F.min("y").alias("low"), F.max("y").alias("high"))

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        xs = frame["x"].to_numpy(float)
        found = np.concatenate([np.stack([xs, frame[c].to_numpy(float)], axis=1) for c in ("low", "high")])
        columns = result(hull(found[np.isfinite(found).all(axis=1)].reshape(-1, 2)))
        size = len(next(iter(columns.values())))
        return pd.DataFrame({**{k: [frame[k].iat[0]] * size for k in keys}, **columns})

    types = dict(points.dtypes)
    return ends.groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {types[k]}" for k in keys) + f", {schema}")


def hull_vertices(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    """Hull vertices of each group."""
    return _hulls(points, keys, x, y, "x double, y double", lambda v: {"x": v[:, 0], "y": v[:, 1]})


def hull_area(points: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y") -> DataFrame:
    def area(v: np.ndarray) -> dict:
        return {"hull_area": [0.0 if len(v) < 3 else abs(np.dot(v[:, 0], np.roll(v[:, 1], -1)) - np.dot(v[:, 1], np.roll(v[:, 0], -1))) / 2]}

    return _hulls(points, keys, x, y, "hull_area double", area)


def point_spread(points: DataFrame, keys: Sequence[str], x: Column, y: Column, low_x: Column, low_y: Column,
                 size_x: Column, size_y: Column) -> DataFrame:
    """Occupied cells of a 3x3 grid over the mask box, and the minor axis spread."""
    def cell(v, low, size):
        return F.least(F.greatest(F.floor((v - low) / size * 3), F.lit(0)), F.lit(2))

    code = cell(x, low_x, size_x) * 3 + cell(y, low_y, size_y)
    c = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("points"), F.count_distinct(code).alias("cells"),
        F.var_pop(x).alias("__xx"), F.var_pop(y).alias("__yy"), F.covar_pop(x, y).alias("__xy"))
    half = (F.col("__xx") + F.col("__yy")) / 2
    root = F.sqrt(((F.col("__xx") - F.col("__yy")) / 2) ** 2 + F.col("__xy") ** 2)
    spread = F.when(F.col("points") >= 3, F.sqrt(F.greatest(half - root, F.lit(0.0)))).otherwise(0.0)
    cells = F.when(F.col("points") >= 3, F.col("cells")).otherwise(0)
    return c.select(*keys, "points", cells.alias("cells"), spread.alias("minor_spread"))


def eligibility(coverage: DataFrame, limits: MotionLimits = MotionLimits()) -> DataFrame:
    """Reasons against a track; ``coverage`` has points, hull_share, cells and minor_spread."""
    return coverage.withColumn("reasons", coverage_reasons(
        F.col("points"), F.col("hull_share"), F.col("cells"), F.col("minor_spread"), limits)) \
        .withColumn("eligible", F.size("reasons") == 0)


def holdout_split(points: DataFrame, keys: Sequence[str], order: Sequence[str], width=1.0, every: int = 3) -> DataFrame:
    """Every third row in (x, y) order is held out; the rest trains."""
    n = row_numbers(points, keys, order, "__rn", width)
    return n.withColumn("holdout", (F.col("__rn") - 1) % every == 0).drop("__rn")


def grid_holdout(row: Column, col: Column) -> Column:
    return (row + col) % 3 == 0


def model_errors(points: DataFrame, keys: Sequence[str], model: str) -> DataFrame:
    """Error statistics of a supplied 3x3 model on held-out points of each track.

    One point at infinity makes the whole projection unavailable.
    """
    e = points.withColumn("__e", homography_error(F.col(model), F.col("src"), F.col("dst")))
    stats = bounded_quantiles(e, keys, F.col("__e"), {"median": 0.5, "p95": 0.95})
    rms = e.groupBy(*keys).agg(F.sqrt(F.avg(F.col("__e") ** 2)).alias("rms"),
                               F.bool_and(F.col("__e").isNotNull()).alias("available"))
    return stats.join(rms, list(keys))


def motion_verdicts(errors: DataFrame, keys: Sequence[str], limits: MotionLimits = MotionLimits()) -> DataFrame:
    """Verdict per pair from one row per track with independent and common p95/rms."""
    per = errors.groupBy(*keys).agg(
        F.bool_and(F.col("independent_p95") <= limits.compatible_p95_px).alias("independent_ok"),
        F.bool_and(F.col("common_p95") <= limits.compatible_p95_px).alias("common_ok"),
        F.bool_or(is_separable(F.col("common_p95"), F.col("common_rms"), F.col("independent_rms"), limits)).alias("separable"))
    return per.select(*keys, motion_verdict(F.col("independent_ok"), F.col("common_ok"), F.col("separable")).alias("verdict"))
