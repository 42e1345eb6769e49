"""Ranked candidates, evidence precedence, edge association and perturbation spread."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import huber, line_distance
from ..functions.vectors import dot, let
from .quantiles import bounded_quantiles
from .ranges import union_length


def best_candidate(df: DataFrame, keys: Sequence[str], order: Sequence, payload: Sequence[str]) -> DataFrame:
    """The least row per key in lexicographic order; a minimum of structs combines early."""
    ranked = F.struct(*[o if isinstance(o, Column) else F.col(o) for o in order])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*payload), ranked).alias("__b"),
                                 F.count(F.lit(1)).alias("candidates")).select(*keys, "candidates", "__b.*")


def near_best(df: DataFrame, keys: Sequence[str], error: str, depth: str, normal: Column | None = None,
              tolerance: float = 0.1, candidate: str = "candidate_id") -> DataFrame:
    """Candidates within a tolerance of the best error, their depth spread and normal angle.

    A candidate of null error is invalid: it is counted, but never best nor near. A key without valid candidates keeps
    its row. The best row is folded per key, then joined back.
    """
    payload = [F.col(error).alias("__e"), F.col(depth).alias("__d")]
    if normal is not None:
        payload.append(normal.alias("__n"))
    valid = F.col(error).isNotNull()
    best = df.groupBy(*keys).agg(F.min_by(F.when(valid, F.struct(*payload)), F.when(valid, F.struct(error, candidate))).alias("__best"),
                                 F.count_if(valid).alias("valid_candidates"), F.count_if(~valid).alias("invalid_candidates"))
    joined = df.join(best, list(keys))
    is_near = F.coalesce(F.col(error) <= F.col("__best.__e") + tolerance, F.lit(False))
    own = F.when(is_near, F.col(depth))
    spread = (F.max(own) - F.min(own)) / F.max("__best.__d")
    aggs = [F.count_if(is_near).alias("near_best"), spread.alias("depth_spread"), F.max("valid_candidates").alias("valid_candidates"),
            F.max("invalid_candidates").alias("invalid_candidates")]
    if normal is not None:
        cosine = F.least(F.abs(dot(normal, F.col("__best.__n"))), F.lit(1.0))
        aggs.append(F.max(F.when(is_near, F.acos(cosine))).alias("max_normal_angle"))
    return joined.groupBy(*keys).agg(*aggs)


def evidence_precedence(sources: Sequence[tuple[str, DataFrame]], keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """First available source wins, in the given order; the source name stays in the row."""
    stacked = None
    for rank, (name, df) in enumerate(sources):
        part = df.select(*keys, F.lit(rank).alias("__rank"), F.lit(name).alias("evidence"), *payload)
        stacked = part if stacked is None else stacked.unionByName(part)
    row = F.struct("evidence", *payload)
    return stacked.groupBy(*keys).agg(F.min_by(row, F.struct("__rank", *payload)).alias("__b")).select(*keys, "__b.*")


def best_supported_group(df: DataFrame, keys: Sequence[str], group: Sequence[str], view: str, size: Column) -> DataFrame:
    """Per key the group with most distinct views, then the largest size, then the least name."""
    # Two plain group-bys instead of a distinct count per group keep the state per view small.
    views = df.select(*keys, *group, size.alias("__size"), view).distinct()
    support = views.groupBy(*keys, *group).agg(F.count(F.lit(1)).alias("views"), F.max("__size").alias("size"))
    order = F.struct((-F.col("views")).alias("v"), (-F.col("size")).alias("s"), *group)
    return support.groupBy(*keys).agg(F.min_by(F.struct(*group, "views", "size"), order).alias("__b")).select(*keys, "__b.*")


def perturbation_spread(trials: DataFrame, keys: Sequence[str], accepted: Column, focal: Column,
                        min_share: float = 0.9, max_spread: float = 0.5) -> DataFrame:
    """Consistent share over all trials, spread of consistent focals and the stability flag."""
    ok = F.when(accepted, focal)
    base = trials.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trials"), F.count_if(focal > 0).alias("positive"),
        F.count_if(accepted).alias("consistent"), F.min(ok).alias("lowest"), F.max(ok).alias("highest"))
    median = bounded_quantiles(trials, keys, ok, {"median": 0.5}).drop("n")
    j = base.join(median, list(keys))
    share = F.col("consistent") / F.col("trials")
    spread = (F.col("highest") - F.col("lowest")) / F.col("median")
    reasons = F.array_compact(F.array(
        F.when(share < min_share, "consistent_share_below_threshold"),
        F.when(spread > max_spread, "relative_spread_above_threshold")))
    return j.withColumn("share", share).withColumn("spread", spread).withColumn("reasons", reasons).withColumn(
        "status", F.when(F.size("reasons") > 0, "unstable").otherwise("no_instability_flag"))


# ---- image segments against quad edges ----------------------------------

def edge_associations(segments: DataFrame, quads: DataFrame, keys: Sequence[str], max_angle: float = 5.0,
                      max_distance: float = 12.0, min_length: float = 0.0) -> DataFrame:
    """Segments that lie along one of the four edges of their quad.

    ``segments(keys, line_id, a, b)``, ``quads(keys, corners)``. Each segment meets the
    four edges of its own quad only, generated in the row.
    """
    def length(p, q):
        return F.sqrt((q.getItem(0) - p.getItem(0)) ** 2 + (q.getItem(1) - p.getItem(1)) ** 2)

    # What an edge alone decides is computed once for each quad, what a segment alone decides once for each segment;
    # in the rows of both, conditions that are moved below the columns they use would repeat it many times.
    corner = [F.col("corners").getItem(i) for i in range(4)]
    sides = F.transform(F.array(*[F.struct(F.lit(i).alias("edge"), corner[i].alias("p"), corner[(i + 1) % 4].alias("q")) for i in range(4)]),
                        lambda e: e.withField("edge_length", length(e["p"], e["q"])))
    edges = quads.select(*keys, F.transform(F.filter(sides, lambda e: e["edge_length"] > 0), lambda e: F.struct(
        e["edge"].alias("edge"), e["edge_length"].alias("edge_length"), e["p"].getItem(0).alias("px"), e["p"].getItem(1).alias("py"),
        e["p"].alias("p"), ((e["q"].getItem(0) - e["p"].getItem(0)) / e["edge_length"]).alias("ux"),
        ((e["q"].getItem(1) - e["p"].getItem(1)) / e["edge_length"]).alias("uy"))).alias("__edges"))
    ends = [F.col(p).getItem(i).alias(f"__{p}{i}") for p in ("a", "b") for i in range(2)]
    own = segments.select(*keys, "line_id", "a", "b", *ends, length(F.col("a"), F.col("b")).alias("length")).filter(
        (F.col("length") > 0) & (F.col("length") >= min_length))
    # Quads grow with the data and their arrays are many times the size of the file that a broadcast is judged by.
    rows = own.join(edges.hint("merge"), list(keys)).select(*own.columns, F.inline("__edges"))

    def along(p):
        return (F.col(f"__{p}0") - F.col("px")) * F.col("ux") + (F.col(f"__{p}1") - F.col("py")) * F.col("uy")

    def off(p):
        return F.abs((F.col(f"__{p}1") - F.col("py")) * F.col("ux") - (F.col(f"__{p}0") - F.col("px")) * F.col("uy"))

    cosine = F.abs((F.col("__b0") - F.col("__a0")) * F.col("ux") + (F.col("__b1") - F.col("__a1")) * F.col("uy")) / F.col("length")
    r = (rows.withColumn("angle", F.degrees(F.acos(F.least(cosine, F.lit(1.0)))))
         .withColumn("da", off("a")).withColumn("db", off("b"))
         .withColumn("low", F.greatest(F.least(along("a"), along("b")), F.lit(0.0)))
         .withColumn("high", F.least(F.greatest(along("a"), along("b")), F.col("edge_length"))))
    return r.filter((F.col("angle") <= max_angle) & (F.greatest("da", "db") <= max_distance) & (F.col("high") > F.col("low"))) \
        .select(*keys, "edge", "edge_length", "line_id", "a", "b", "length", "angle",
                ((F.col("da") + F.col("db")) / 2).alias("distance"), "low", "high",
                F.col("p").alias("origin"), "ux", "uy")


STRIPS = 4  # a seed is copied into each; more strips meet at most 1.8 times fewer segments


def collinear_members(associations: DataFrame, keys: Sequence[str], max_angle: float = 5.0, max_offset: float = 2.5,
                      edge_angle: float = 5.0) -> DataFrame:
    """(keys, edge, seed, line_id, low, high, distance, edge_length): the segments collinear with each seed of an edge.

    Segments meet through cells, not through the edge: the edge is cut into strips and each strip into bins of the
    offset from the seed. A collinear segment passes within ``max_offset`` of the seed's line at every place of its own
    extent, so it shows itself in the one bin of its middle, and a seed in the bins that its line crosses, widened by
    that much. Both lie within ``edge_angle`` of the edge, which bounds the bins of a strip. Equal segments are one class
    until the end, so copies of a segment never meet each other. ``line_id`` is unique on an edge.
    """
    k = [*keys, "edge"]
    shape = ["a", "b", "low", "high", "edge_length"]
    classes = associations.groupBy(*k, *shape).agg(
        F.min("line_id").alias("leader"), F.avg("distance").alias("distance"), F.first("length").alias("length"),
        F.first("origin").alias("p"), F.first("ux").alias("ux"), F.first("uy").alias("uy"))

    def beside(point):
        return (F.col(point).getItem(1) - F.col("p").getItem(1)) * F.col("ux") - (F.col(point).getItem(0) - F.col("p").getItem(0)) * F.col("uy")

    def along(point):
        return (F.col(point).getItem(0) - F.col("p").getItem(0)) * F.col("ux") + (F.col(point).getItem(1) - F.col("p").getItem(1)) * F.col("uy")

    # The line of a segment over the edge: offset = base + slope * place. Nothing is upright, as the angle is bounded.
    rows = (classes.withColumn("slope", (beside("b") - beside("a")) / (along("b") - along("a")))
            .withColumn("base", beside("a") - F.col("slope") * along("a"))
            .withColumn("wide", F.greatest(F.col("edge_length") / STRIPS, F.lit(1.0))))
    reach = max_offset / math.cos(math.radians(edge_angle)) * (1 + 1e-9) + 1e-9
    bin_height = 2 * reach

    def bin_of(offset: Column) -> Column:
        return F.floor(offset / bin_height).cast("long")

    middle = (F.col("low") + F.col("high")) / 2
    members = rows.select(*k, *shape, "length", F.floor(middle / F.col("wide")).cast("long").alias("strip"),
                          bin_of(F.col("base") + F.col("slope") * middle).alias("cell"))
    strips = F.sequence(F.lit(0), F.floor(F.col("edge_length") / F.col("wide")).cast("long"))
    left = F.col("base") + F.col("slope") * F.col("strip") * F.col("wide")
    right = left + F.col("slope") * F.col("wide")
    direction = [((F.col("b").getItem(i) - F.col("a").getItem(i)) / F.col("length")).alias(u) for i, u in ((0, "ux"), (1, "uy"))]
    start = [F.col("a").getItem(i).alias(s) for i, s in ((0, "sx"), (1, "sy"))]
    # The copies of a seed hold numbers only, no arrays: they are most of what is shuffled.
    seeds = rows.select(*k, F.col("leader").alias("seed"), *start, *direction, "base", "slope", "wide", F.explode(strips).alias("strip"))
    seeds = seeds.select(*k, "seed", "sx", "sy", "ux", "uy", "strip", F.explode(F.sequence(
        bin_of(F.least(left, right) - reach), bin_of(F.greatest(left, right) + reach))).alias("cell"))
    met = seeds.join(members, [*k, "strip", "cell"])

    def off(point):
        return F.abs((point.getItem(1) - F.col("sy")) * F.col("ux") - (point.getItem(0) - F.col("sx")) * F.col("uy"))

    cosine = F.abs((F.col("b").getItem(0) - F.col("a").getItem(0)) * F.col("ux")
                   + (F.col("b").getItem(1) - F.col("a").getItem(1)) * F.col("uy")) / F.col("length")
    same = met.filter((F.degrees(F.acos(F.least(cosine, F.lit(1.0)))) <= max_angle)
                      & (F.greatest(off(F.col("a")), off(F.col("b"))) <= max_offset))
    return same.select(*k, "seed", *shape).join(
        associations.select(*k, *shape, "line_id", "length", "distance"), [*k, *shape])


def collinear_clusters(members: DataFrame, keys: Sequence[str], min_coverage: float = 0.15,
                       distance_unit: float = 12.0) -> DataFrame:
    """Per edge the seed whose collinear members cover most of it: (keys, edge, seed, covered, score, members).

    The score falls with the mean distance from the edge. Seeds of one cluster score alike but for the order of sums,
    so scores count as equal to nine places and the smallest seed id decides; shares of the edge are taken to nine places too.
    """
    k = [*keys, "edge"]
    covered = union_length(members, [*k, "seed"], "low", "high", 4096)
    stats = members.groupBy(*k, "seed").agg(F.avg("distance").alias("mean_distance"), F.max("edge_length").alias("edge_length"),
                                            F.count(F.lit(1)).alias("members"))
    scored = covered.join(stats, [*k, "seed"]).withColumn("score", F.col("covered") / (1 + F.col("mean_distance") / distance_unit))
    good = scored.filter(F.round(F.col("covered") / F.col("edge_length"), 9) >= min_coverage)
    order = F.struct((-F.round("score", 9)).alias("s"), "seed")
    return good.groupBy(*k).agg(F.min_by(F.struct("seed", "covered", "score", "members"), order).alias("__b")).select(*k, "__b.*")


def selected_segments(members: DataFrame, clusters: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Member segments of the chosen clusters, weighted by length over covered length."""
    k = [*keys, "edge"]
    return members.join(clusters.select(*k, "seed", "covered"), [*k, "seed"]).select(
        *k, "line_id", "a", "b", (F.col("length") / F.col("covered")).alias("weight"))


def segment_cost(segments: DataFrame, keys: Sequence[str], delta: float = 3.0) -> DataFrame:
    """Robust cost of weighted segments against projected edges (start, end per row)."""
    def one(point):
        return let(line_distance(F.col(point), F.col("start"), F.col("end")), lambda r: huber(r, delta))

    return segments.groupBy(*keys).agg(F.sum(F.col("weight") * (one("a") + one("b"))).alias("cost"))


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """Stable order as an explicit rank column, for bounded candidate lists."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
