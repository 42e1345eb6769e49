"""Pixel masks as run-length rows ``(clip_id, frame, object_id, y, x0, x1)``, x1 exclusive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import object_mask_status, pair_mask_status
from .blocks import FRAME_BLOCK
from .ranges import coverage_points, interval_difference, merged_intervals, union_length

FRAME_KEYS = ("clip_id", "frame")
CELL = 64


def mask_areas(runs: DataFrame, keys: Sequence[str] = (*FRAME_KEYS, "object_id")) -> DataFrame:
    """Area and bounds of each mask (runs of one mask do not overlap)."""
    return runs.groupBy(*keys).agg(
        F.sum(F.col("x1") - F.col("x0")).alias("area_px"), F.min("x0").alias("x_min"), F.max("x1").alias("x_max"),
        F.min("y").alias("y_min"), (F.max("y") + 1).alias("y_max"))


def normalise_runs(runs: DataFrame, keys: Sequence[str] = (*FRAME_KEYS, "object_id"), width=FRAME_BLOCK) -> DataFrame:
    """Merge overlapping or touching runs of one mask."""
    return merged_intervals(runs, [*keys, "y"], "x0", "x1", width)


def pixel_support(runs: DataFrame, keys: Sequence[str], pane_scale: Column | float = 1.0, min_edge: float = 24.0,
                  min_area: float = 64.0) -> DataFrame:
    """Bounds, long edge and area at pane scale with the display gate."""
    s = F.lit(pane_scale)
    a = mask_areas(runs, keys)
    edge = F.greatest(F.col("x_max") - F.col("x_min"), F.col("y_max") - F.col("y_min")) * s
    area = F.col("area_px") * s * s
    return a.withColumn("long_edge_px", edge).withColumn("foreground_px", area).withColumn(
        "passed", (edge >= min_edge) & (area >= min_area))


def intersections(runs: DataFrame, frame_keys: Sequence[str] = FRAME_KEYS, cell: int = CELL) -> DataFrame:
    """Pixels shared by each pair of masks that overlaps at all.

    Runs meet through the (row, cell) they occupy, so only runs that are near each other
    on one row are compared and disjoint objects never form a pair. Each run is cut at
    cell borders, which makes every shared pixel counted in exactly one cell.
    """
    keys = list(frame_keys)
    first, last = F.floor(F.col("x0") / cell), F.floor((F.col("x1") - 1) / cell)
    pieces = (runs.filter(F.col("x1") > F.col("x0"))
              .select(*keys, "object_id", "y", "x0", "x1", F.explode(F.sequence(first, last)).alias("cell"))
              .select(*keys, "object_id", "y", "cell",
                      F.greatest("x0", F.col("cell") * cell).alias("x0"),
                      F.least("x1", (F.col("cell") + 1) * cell).alias("x1")))
    a = pieces.select(*keys, "y", "cell", F.col("object_id").alias("first_id"), F.col("x0").alias("a0"), F.col("x1").alias("a1"))
    b = pieces.select(*keys, "y", "cell", F.col("object_id").alias("second_id"), F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    meet = a.join(b, [*keys, "y", "cell"]).filter(
        (F.col("first_id") < F.col("second_id")) & (F.col("a0") < F.col("b1")) & (F.col("b0") < F.col("a1")))
    shared = F.least("a1", "b1") - F.greatest("a0", "b0")
    return meet.groupBy(*keys, "first_id", "second_id").agg(F.sum(shared).alias("intersection_px"))


def pair_overlaps(runs: DataFrame, frame_keys: Sequence[str] = FRAME_KEYS, minimum_area: int = 64,
                  containment: float = 0.8) -> DataFrame:
    """Intersection, union, IoU, coverage of the smaller mask and status of touching pairs.

    Pairs that share no pixel have intersection zero and no containment; they follow from
    the areas alone (see :func:`object_status`) and are not emitted.
    """
    keys = list(frame_keys)
    areas = mask_areas(runs, [*keys, "object_id"]).select(*keys, "object_id", "area_px")
    inter = intersections(runs, keys)
    joined = (inter.join(areas.select(*keys, F.col("object_id").alias("first_id"), F.col("area_px").alias("area_a")),
                         [*keys, "first_id"])
              .join(areas.select(*keys, F.col("object_id").alias("second_id"), F.col("area_px").alias("area_b")),
                    [*keys, "second_id"]))
    i, smaller = F.col("intersection_px"), F.least("area_a", "area_b")
    union = F.col("area_a") + F.col("area_b") - i
    return joined.select(
        *keys, "first_id", "second_id", "intersection_px", union.alias("union_px"),
        F.try_divide(i, union).alias("mask_iou"), F.try_divide(i, smaller).alias("coverage"),
        pair_mask_status(i, smaller, minimum_area, containment).alias("status"))


def object_status(areas: DataFrame, minimum_area: int = 64) -> DataFrame:
    return areas.withColumn("status", object_mask_status(F.col("area_px"), minimum_area))


def exclusive_pair(runs: DataFrame, first: Column, frame_keys: Sequence[str] = FRAME_KEYS, width=FRAME_BLOCK) -> DataFrame:
    """Two masks without their shared pixels: runs of ``a_only`` and ``b_only``."""
    return interval_difference(runs, [*frame_keys, "y"], "x0", "x1", first, width)


def interior_support(base_runs: DataFrame, lit_runs: DataFrame, keys: Sequence[str] = FRAME_KEYS,
                     min_interior: int = 64, min_share: float = 0.99) -> DataFrame:
    """Lit share of interior pixels: those whose four neighbours are set too.

    Everything stays in runs: the interior of a row is the row eroded by one pixel,
    intersected with the rows above and below; dark pixels are interior minus lit. A frame is the
    work of one task, so its runs are dealt out once and all steps happen where they are.
    """
    keys = list(keys)
    k = [*keys, "y"]
    runs = base_runs.select(*k, "x0", "x1", F.lit(False).alias("lit")).unionByName(lit_runs.select(*k, "x0", "x1", F.lit(True).alias("lit")))
    merged = merged_intervals(runs.repartition(*keys), [*k, "lit"], "x0", "x1", None)
    x0, x1, y, lit = (F.col(c) for c in ("x0", "x1", "y", "lit"))

    def ends(own: Column, layer: int, row: Column, start: Column, stop: Column) -> list[Column]:
        """Where a layer begins and ends on a row; nothing if it is empty there."""
        return [F.when(own & (stop > start), F.struct(row.alias("y"), pos.alias("pos"), F.lit(layer).alias("layer"), F.lit(step).alias("step")))
                for pos, step in ((start, 1), (stop, -1))]

    borders = F.array(*ends(~lit, 1, y, x0 + 1, x1 - 1), *ends(~lit, 2, y + 1, x0, x1), *ends(~lit, 3, y - 1, x0, x1), *ends(lit, 4, y, x0, x1))
    # Borders at one position need not be summed first: only the last of them has a length.
    points = merged.select(*keys, F.inline(F.array_compact(borders)))
    w = Window.partitionBy(*k).orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    swept = points.select(*keys, *[F.sum(F.when(F.col("layer") == i, F.col("step")).otherwise(0)).over(upto).alias(f"n{i}") for i in range(1, 5)],
                          (F.lead("pos").over(w) - F.col("pos")).alias("__length"))
    length = F.coalesce("__length", F.lit(0))
    inner = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    totals = swept.groupBy(*keys).agg(
        F.sum(F.when(inner, length).otherwise(0)).alias("interior_px"),
        F.sum(F.when(inner & (F.col("n4") == 0), length).otherwise(0)).alias("dark_px"))
    share = F.coalesce(1 - F.try_divide("dark_px", "interior_px"), F.lit(0.0))
    return totals.withColumn("lit_share", share).withColumn(
        "passed", (F.col("interior_px") >= min_interior) & (share >= min_share))


def merge_directions(samples: DataFrame, seed_frame: Column) -> DataFrame:
    """Reverse samples before the seed frame and forward samples from it on."""
    reverse = (F.col("direction") == "reverse") & (F.col("frame") < seed_frame)
    forward = (F.col("direction") == "forward") & (F.col("frame") >= seed_frame)
    return samples.filter(reverse | forward)


def seed_consistency(runs: DataFrame, seeds: DataFrame, width=FRAME_BLOCK) -> DataFrame:
    """Forward against reverse mask at the seed frame of each object: overlap and different pixels."""
    at_seed = runs.join(seeds.select("clip_id", "object_id", F.col("frame").alias("frame")), ["clip_id", "object_id", "frame"])
    keys = ["clip_id", "object_id"]
    points = coverage_points(at_seed, [*keys, "y"], "x0", "x1", F.col("direction") == "forward", width)
    after = F.col("in_a"), F.col("in_b")
    before = F.col("in_a") - F.col("da"), F.col("in_b") - F.col("db")

    def length(covered) -> Column:
        """Ends minus beginnings of what is covered; no position has to know the next one."""
        return F.sum(F.col("pos") * (covered(*before).cast("int") - covered(*after).cast("int")))

    counts = points.groupBy(*keys).agg(
        length(lambda a, b: (a > 0) & (b > 0)).alias("intersection_px"),
        length(lambda a, b: (a > 0) | (b > 0)).alias("union_px"))
    directions = at_seed.groupBy(*keys).agg(F.count_distinct("direction").alias("directions"))
    return counts.join(directions, keys).withColumn(
        "different_px", F.col("union_px") - F.col("intersection_px")).withColumn(
        "iou", F.try_divide("intersection_px", "union_px"))


def mask_union_area(runs: DataFrame, keys: Sequence[str] = FRAME_KEYS) -> DataFrame:
    """Pixels covered by any object of a frame."""
    rows = union_length(runs, [*keys, "y"], "x0", "x1")
    return rows.groupBy(*keys).agg(F.sum("covered").alias("area_px"))


def ranked_components(components: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Component lists by falling area, ties by box; components of one mask are few."""
    item = F.struct((-F.col("area_px")).alias("__r"), "x0", "y0", "x1", "y1", "area_px")
    return components.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("component_count"), F.sort_array(F.collect_list(item)).alias("components"))


def bundle_counters(samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counters of a surface-observation bundle."""
    return samples.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(F.col("area_px") == 0).alias("empty_masks"),
        F.count_if("quad_accepted").alias("quads_accepted"), F.count_if("pose_accepted").alias("poses_accepted"),
        F.sum("candidates").alias("pose_candidates"), F.count_if("face_verified").alias("faces_verified"),
        F.count_if(F.col("component_count") > 1).alias("multi_component"))
