"""Analytic threshold sweep: the display focal that fails the fewest frames.

A wrist is ``constant + f * (0, 0, slope)``, so each geometry gate passes on one interval
of f, and a frame passes on the intersection. Counting failures for *every* candidate is
then an interval-stabbing count: boundary events are summed per position and scanned
once. Cost grows with frames, not with candidates times frames.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rotation import camera_to_engine
from ..functions.vectors import let
from .blocks import Scan, block_scan
from .gates import CHECKS, GeometryCriteria
from .lineage_cut import cut
from .quantiles import exact_quantiles

INF = float("inf")
LN2 = 0.6931471805599453
LOG_BLOCKS = 16  # to a factor of e


def _interval(lo: Column, hi: Column, is_open: bool) -> Column:
    return F.struct(lo.cast("double").alias("lo"), hi.cast("double").alias("hi"), F.lit(is_open).alias("open"))


def _always(passes: Column) -> Column:
    """All of (0, inf) when it passes, else an empty interval."""
    return _interval(F.when(passes, 0.0).otherwise(INF), F.when(passes, INF).otherwise(0.0), True)


def pass_intervals(length: float, criteria: GeometryCriteria) -> tuple[Column, Column]:
    """(array of the four gate intervals, array of raw boundary values) of one frame row.

    Columns: ``lc``, ``rc`` (constants, 3-vectors) and ``ls``, ``rs`` (depth slopes > 0).
    """
    c = criteria
    lc, rc, ls, rs = (F.col(n) for n in ("lc", "rc", "ls", "rs"))
    dz, ds = lc.getItem(2) - rc.getItem(2), ls - rs
    dx, dy = lc.getItem(0) - rc.getItem(0), lc.getItem(1) - rc.getItem(1)
    remaining = (c.wrist_distance_max * length) ** 2 - (dx * dx + dy * dy)
    limit = c.depth_difference_max * length

    def depth(constant, slope):
        return [(t * length - constant.getItem(2)) / slope for t in (c.depth_min, c.depth_max)]

    def between(half):
        a, b = (-half - dz) / ds, (half - dz) / ds
        return a, b, F.least(a, b), F.greatest(a, b)

    l_lo, l_hi = depth(lc, ls)
    r_lo, r_hi = depth(rc, rs)
    d_a, d_b, d_lo, d_hi = between(F.lit(limit))
    root = F.when(remaining >= 0, F.sqrt(F.greatest(remaining, F.lit(0.0))))
    w_a, w_b, w_lo, w_hi = between(root)
    moves = ds != 0
    wrist = F.when(moves & (remaining > 0), _interval(w_lo, w_hi, True)).otherwise(
        _always(~moves & (remaining - dz * dz > 0)))
    gap = F.when(moves, _interval(d_lo, d_hi, True)).otherwise(_always(~moves & (F.abs(dz) < limit)))
    gates = F.array(wrist, _interval(l_lo, l_hi, False), _interval(r_lo, r_hi, False), gap)
    bounds = F.array(l_lo, l_hi, r_lo, r_hi, *[F.when(moves, b) for b in (d_a, d_b, w_a, w_b)])
    return gates, bounds


def _intersection(gates: Column) -> Column:
    """Common interval; an end is open when any gate that sets it is open."""
    def ends(g):
        lo = F.array_max(F.transform(g, lambda i: i.getField("lo")))
        hi = F.array_min(F.transform(g, lambda i: i.getField("hi")))
        return F.struct(lo.alias("lo"), hi.alias("hi"),
                        F.exists(g, lambda i: i.getField("open") & (i.getField("lo") == lo)).alias("lo_open"),
                        F.exists(g, lambda i: i.getField("open") & (i.getField("hi") == hi)).alias("hi_open"))

    return let(gates, ends)


def _events(interval: Column, weight: str) -> Column:
    """Start and end events of a nonempty interval clipped to f > 0."""
    lo, hi = F.greatest(interval.getField("lo"), F.lit(0.0)), interval.getField("hi")
    lo_open, hi_open = interval.getField("lo_open"), interval.getField("hi_open")
    alive = (hi > 0) & ((lo < hi) | ((lo == hi) & ~lo_open & ~hi_open))

    def event(pos, right, at):
        return F.struct(pos.alias("pos"), F.lit(weight).alias("what"),
                        F.lit(right).alias("right"), at.cast("int").alias("at"))

    return F.when(alive, F.array(event(lo, 1, F.when(lo_open, 0).otherwise(1)),
                                 event(hi, -1, F.when(hi_open, -1).otherwise(0))))


def select_focal(frames: DataFrame, keys: Sequence[str], hand_length: float,
                 criteria: GeometryCriteria = GeometryCriteria()) -> DataFrame:
    """Best focal per clip by: failing frames, failing gates, interior before boundary,
    largest log clearance, nearest log focal to the preferred one, smaller focal."""
    keys = list(keys)
    rows = cut(frames.select(*keys, "lc", "rc", "ls", "rs"))
    clips = cut(clip_totals(rows, keys, hand_length, criteria))
    gates, bounds = pass_intervals(hand_length, criteria)
    single = F.transform("gates", lambda g: F.struct(
        g.getField("lo").alias("lo"), g.getField("hi").alias("hi"),
        g.getField("open").alias("lo_open"), g.getField("open").alias("hi_open")))
    whole = rows.select(*keys, gates.alias("gates"), bounds.alias("bounds")).select(
        *keys, "bounds", single.alias("single"), _intersection(F.col("gates")).alias("all"))
    marks = F.transform(F.filter("bounds", lambda b: b.isNotNull() & (b > 0) & (b < INF)), lambda b: F.struct(
        b.alias("pos"), F.lit("mark").alias("what"), F.lit(0).alias("right"), F.lit(0).alias("at")))
    empty = F.filter(marks, lambda m: F.lit(False))
    events = whole.select(*keys, F.inline(F.concat(
        marks, F.coalesce(_events(F.col("all"), "frame"), empty),
        F.flatten(F.transform("single", lambda s: F.coalesce(_events(s, "gate"), empty))))))
    is_frame, is_gate = F.col("what") == "frame", F.col("what") == "gate"
    points = cut(events.filter(F.col("pos") < INF).groupBy(*keys, "pos").agg(
        F.bool_or(F.col("what") == "mark").alias("is_mark"),
        F.sum(F.when(is_frame, F.col("right")).otherwise(0)).alias("f_right"),
        F.sum(F.when(is_frame, F.col("at")).otherwise(0)).alias("f_at"),
        F.sum(F.when(is_gate, F.col("right")).otherwise(0)).alias("g_right"),
        F.sum(F.when(is_gate, F.col("at")).otherwise(0)).alias("g_at")))
    mark = F.when(F.col("is_mark"), F.col("pos"))
    log_block = F.when(F.col("pos") > 0, F.floor(F.log("pos") * LOG_BLOCKS)).otherwise(-(1 << 40))
    scanned = block_scan(points, keys, ["pos"], [
        Scan("sum", F.col("f_right"), "f_after"), Scan("sum", F.col("g_right"), "g_after"),
        Scan("next", F.col("pos"), "next_pos"), Scan("prev", mark, "prev_mark")], block=log_block, per_key=clips)
    # Every end of a passing interval with f > 0 is itself a mark, so neighbours suffice.
    n, preferred = F.col("frame_count"), F.col("preferred")
    before_f, before_g = F.col("f_after") - F.col("f_right"), F.col("g_after") - F.col("g_right")

    def candidate(f, boundary, clearance, passing, gates_passing):
        return F.struct((n - passing).alias("failed_frames"), (4 * n - gates_passing).alias("failed_gates"),
                        F.lit(boundary).alias("at_boundary"), (-clearance).alias("__c"),
                        F.abs(F.log(f / preferred)).alias("__d"), f.alias("focal"))

    pos, nxt = F.col("pos"), F.col("next_pos")
    centre = F.exp((F.log(pos) + F.log(nxt)) / 2)
    here = [candidate(pos, True, F.lit(0.0), before_f + F.col("f_at"), before_g + F.col("g_at")),
            F.when(nxt.isNotNull(), candidate(centre, False, F.least(F.log(centre / pos), F.log(nxt / centre)),
                                              F.col("f_after"), F.col("g_after"))),
            F.when(nxt.isNull(), candidate(pos * 2, False, F.lit(LN2), F.col("f_after"), F.col("g_after"))),
            F.when(F.col("prev_mark").isNull(),
                   candidate(pos / 2, False, F.lit(LN2), before_f, before_g))]
    # Of a position's candidates one can be the best: rows are sorted by clip for the minimum, so one of each goes there.
    candidates = scanned.filter((pos > 0) & n.isNotNull()).select(
        *keys, "frame_count", "preferred", F.array_compact(F.array(*here)).alias("here")).select(
        *keys, "frame_count", "preferred", F.array_min("here").alias("best"), F.size("here").alias("candidates"))
    fallback = (clips.join(points.filter("is_mark").select(*keys).distinct(), keys, "left_anti")
                .join(points.filter(F.col("pos") == 0).select(*keys, "f_right", "g_right"), keys, "left").select(
                    *keys, "frame_count", "preferred",
                    candidate(preferred, False, F.lit(0.0), F.coalesce("f_right", F.lit(0)),
                              F.coalesce("g_right", F.lit(0))).alias("best"), F.lit(1).alias("candidates")))
    best = (candidates.unionByName(fallback).groupBy(*keys, "frame_count", "preferred")
            .agg(F.min("best").alias("best"), F.sum("candidates").alias("candidate_count")))
    return best.select(*keys, "frame_count", "candidate_count", "preferred",
                       F.col("best.focal").alias("focal"), F.col("best.failed_frames").alias("failed_frames"),
                       F.col("best.failed_gates").alias("failed_gates"),
                       F.col("best.at_boundary").alias("at_boundary"),
                       (-F.col("best.__c")).alias("log_clearance"))


def clip_totals(rows: DataFrame, keys: Sequence[str], hand_length: float, criteria: GeometryCriteria) -> DataFrame:
    """``frame_count`` of each clip and ``preferred``, the tie reference: median depth-interval centre, else median
    boundary, else one length. Boundaries are looked at only in clips without a centre."""
    middle = (criteria.depth_min + criteria.depth_max) / 2 * hand_length
    centres = [(middle - F.col(c).getItem(2)) / F.col(s) for c, s in (("lc", "ls"), ("rc", "rs"))]

    def medians(own: DataFrame, values: Column, name: str) -> DataFrame:
        """The median of each clip's positive values; clips without any have no row."""
        long = own.select(*keys, F.explode(values).alias("__x"))
        return exact_quantiles(long, keys, F.when(F.col("__x") > 0, F.col("__x")), {name: 0.5}).drop("n")

    usual = [(v > 0) & ~F.isnan(v) for v in centres]
    totals = cut(rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("frame_count"), F.coalesce(F.bool_or(usual[0] | usual[1]), F.lit(False)).alias("__usual")))
    middles = medians(rows, F.array(*centres), "preferred")
    lacking = totals.filter(~F.col("__usual"))
    if not lacking.isEmpty():
        _, bounds = pass_intervals(hand_length, criteria)
        rest = rows.join(lacking.select(*keys), keys, "left_semi")
        others = medians(rest, F.array("ls", "rs"), "slope").join(medians(rest, bounds, "boundary"), keys, "left")
        middles = middles.unionByName(others.select(
            *keys, F.coalesce("boundary", F.lit(hand_length) / F.col("slope")).alias("preferred")))
    return totals.join(middles, keys).drop("__usual")


def failed_checks(left: Column, right: Column, length: float, criteria: GeometryCriteria) -> Column:
    """Names of the geometry checks a two-hand frame fails."""
    d = [left.getItem(i) - right.getItem(i) for i in range(3)]
    distance = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) / length
    lz, rz = left.getItem(2) / length, right.getItem(2) / length
    c = criteria
    flags = (distance >= c.wrist_distance_max, (lz < c.depth_min) | (lz > c.depth_max),
             (rz < c.depth_min) | (rz > c.depth_max), F.abs(d[2]) / length >= c.depth_difference_max)
    return F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in zip(CHECKS, flags)]))


def display_frames(frames: DataFrame, focal: DataFrame, keys: Sequence[str], hand_length: float,
                   criteria: GeometryCriteria = GeometryCriteria()) -> DataFrame:
    """Per-frame display positions at the chosen focal, in engine basis, with failed checks."""
    at = frames.join(focal.select(*keys, "focal"), list(keys))
    for s in ("l", "r"):
        c = F.col(f"{s}c")
        at = at.withColumn(f"{s}w", F.array(c.getItem(0), c.getItem(1),
                                            c.getItem(2) + F.col("focal") * F.col(f"{s}s")))
    distance = let(F.array(*[F.col("lw").getItem(i) - F.col("rw").getItem(i) for i in range(3)]),
                   lambda v: F.sqrt(sum((v.getItem(i) * v.getItem(i) for i in (1, 2)), v.getItem(0) * v.getItem(0))))
    return at.select(
        *keys, "frame", "focal", (distance / hand_length).alias("wrist_distance_over_hand_length"),
        failed_checks(F.col("lw"), F.col("rw"), hand_length, criteria).alias("failed_checks"),
        camera_to_engine(F.col("lw")).alias("left_translation"),
        camera_to_engine(F.col("rw")).alias("right_translation"),
        camera_to_engine(F.col("lc")).alias("left_constant"),
        camera_to_engine(F.col("rc")).alias("right_constant"))
