"""Motion evidence, view sets, candidates, skeletons and meshes."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import camera, rotation
from ..functions.vectors import let
from ..operators import candidates, geometry, motion, views
from ..operators.lineage_cut import cut
from ..rules import JOINT_PARENTS
from ..sources.warehouse import observations, table
from .base import OBS, Catalog

catalog = Catalog.empty()

FEATURES = OBS + """,
feat AS (SELECT clip_id, frame, det_idx, kind <> 'error' AS fwd, z >= 10 AS bwd, sqrt(score * score + (z / 40) * (z / 40)) AS trip,
                x < 200 AS inside FROM obs),
why AS (SELECT *, CASE WHEN NOT fwd THEN 'forward_invalid' END AS r1, CASE WHEN NOT bwd THEN 'backward_invalid' END AS r2,
        CASE WHEN trip > 1.5 THEN 'forward_backward_inconsistent' END AS r3, CASE WHEN NOT inside THEN 'outside_next_mask' END AS r4 FROM feat)"""


def _features(spark, base) -> DataFrame:
    o = observations(spark, base)
    x, z = F.col("trans").getItem(0), F.col("trans").getItem(2)
    rows = o.select("clip_id", "frame", "det_idx", "side", F.array(x, z).alias("src"), F.array(x + 3, z - 2).alias("dst"),
                    F.array(x + F.col("score"), z + z / 40).alias("back"), (F.col("kind") != "error").alias("forward_ok"),
                    (z >= 10).alias("backward_ok"), (x < 200).alias("inside"))
    return motion.accept_features(rows)


@catalog.add("feature_acceptance", f"""
WITH {FEATURES} SELECT clip_id, det_idx, round(trip, 8) AS round_trip_px, concat_ws(',', r1, r2, r3, r4) AS reasons,
  concat_ws(',', r1, r2, r3, r4) = '' AS accepted FROM why
""")
def feature_acceptance(spark, base) -> DataFrame:
    return _features(spark, base).select("clip_id", "det_idx", F.round("round_trip_px", 8).alias("round_trip_px"),
                                         F.concat_ws(",", "reasons").alias("reasons"), "accepted")


@catalog.add("rejection_counts", f"""
WITH {FEATURES} SELECT clip_id, reason, count(*) AS "count" FROM (SELECT clip_id, unnest([r1, r2, r3, r4]) AS reason FROM why) t
WHERE reason IS NOT NULL GROUP BY clip_id, reason
""")
def rejection_counts(spark, base) -> DataFrame:
    return motion.rejection_counts(_features(spark, base), ["clip_id"])


@catalog.add("displacement", f"""
WITH {FEATURES} SELECT clip_id, count(*) AS n, 3.0 AS median_dx, -2.0 AS median_dy, round(median(trip), 8) AS median_trip,
  round(quantile_cont(trip, 0.95), 8) AS p95_trip FROM why WHERE concat_ws(',', r1, r2, r3, r4) = '' GROUP BY clip_id
""")
def displacement(spark, base) -> DataFrame:
    d = motion.displacement(_features(spark, base), ["clip_id"])
    return d.select("clip_id", "n", *[F.round(c, 8).alias(c) for c in ("median_dx", "median_dy", "median_trip", "p95_trip")])


@catalog.add("motion_verdicts", f"""
WITH {OBS}, t AS (SELECT clip_id, frame, side, avg(z) / 30 AS ip, avg(z) / 60 AS ir, avg(x) / 40 AS cp, avg(x) / 60 AS cr FROM obs GROUP BY 1, 2, 3),
f AS (SELECT clip_id, frame, bool_and(ip <= 2) AS iok, bool_and(cp <= 2) AS cok, bool_or(cp > 3 AND cr - ir >= 1) AS sep FROM t GROUP BY 1, 2)
SELECT clip_id, frame, CASE WHEN iok AND cok THEN 'one_motion_suffices' WHEN iok AND sep THEN 'two_motions_fit_better' ELSE 'unknown' END AS verdict FROM f
""")
def motion_verdicts(spark, base) -> DataFrame:
    x, z = F.avg(F.col("trans").getItem(0)), F.avg(F.col("trans").getItem(2))
    errors = observations(spark, base).groupBy("clip_id", "frame", "side").agg(
        (z / 30).alias("independent_p95"), (z / 60).alias("independent_rms"), (x / 40).alias("common_p95"), (x / 60).alias("common_rms"))
    return motion.motion_verdicts(errors, ["clip_id", "frame"])


@catalog.add("adjacent_frames", f"""
WITH {OBS}, f AS (SELECT clip_id, frame, count(*) AS n FROM obs GROUP BY 1, 2)
SELECT a.clip_id, a.frame, a.n, b.n AS next_n FROM f a JOIN f b ON a.clip_id = b.clip_id AND b.frame = a.frame + 1
""")
def adjacent_frames(spark, base) -> DataFrame:
    f = observations(spark, base).groupBy("clip_id", "frame").agg(F.count(F.lit(1)).alias("n"))
    return motion.frame_pairs(f, ["clip_id"], ["n"], width=32).select("clip_id", "frame", "n", F.col("following.n").alias("next_n"))


@catalog.add("holdout_split", """
SELECT label, vec_id, (row_number() OVER (PARTITION BY label ORDER BY embedding[1]::DOUBLE, embedding[2]::DOUBLE, vec_id) - 1) % 3 = 0 AS holdout FROM embeddings
""")
def holdout_split(spark, base) -> DataFrame:
    e = table(spark, base, "embeddings").select("label", "vec_id", F.col("embedding").getItem(0).cast("double").alias("x"),
                                                F.col("embedding").getItem(1).cast("double").alias("y"))
    return motion.holdout_split(e, ["label"], ["x", "y", "vec_id"], width=0.05).select("label", "vec_id", "holdout")


def _points(spark, base) -> DataFrame:
    return table(spark, base, "lineitem").select(
        F.col("l_suppkey").alias("clip_id"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


@catalog.add("pair_coverage", """
WITH p AS (SELECT l_suppkey AS clip_id, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem),
c AS (SELECT clip_id, count(*) AS points, count(DISTINCT least(greatest(floor((x - 5) / 40 * 3), 0), 2) * 3 + least(greatest(floor((y - 10) / 60 * 3), 0), 2)) AS cells,
      var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM p GROUP BY clip_id)
SELECT clip_id, points, CASE WHEN points >= 3 THEN cells ELSE 0 END AS cells,
       round(CASE WHEN points >= 3 THEN sqrt(greatest((xx + yy) / 2 - sqrt(((xx - yy) / 2) * ((xx - yy) / 2) + xy * xy), 0)) ELSE 0 END, 6) AS minor_spread FROM c
""")
def pair_coverage(spark, base) -> DataFrame:
    s = motion.point_spread(_points(spark, base), ["clip_id"], F.col("x"), F.col("y"), F.lit(5.0), F.lit(10.0), F.lit(40.0), F.lit(60.0))
    return s.withColumn("minor_spread", F.round("minor_spread", 6))


@catalog.add("hull_area")
def hull_area(spark, base) -> DataFrame:
    """Convex hull area per supplier; no plain SQL form, tests compare with brute force."""
    return motion.hull_area(_points(spark, base), ["clip_id"]).withColumn("hull_area", F.round("hull_area", 6))


@catalog.add("centre_span", """
WITH p AS (SELECT c_nationkey AS k, c_acctbal / 100 AS x, c_custkey / 10.0 AS y FROM customer)
SELECT a.k, round(max(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y))), 8) AS span FROM p a JOIN p b ON a.k = b.k GROUP BY a.k
""")
def centre_span(spark, base) -> DataFrame:
    p = table(spark, base, "customer").select(F.col("c_nationkey").alias("k"), (F.col("c_acctbal") / 100).alias("x"),
                                              (F.col("c_custkey") / 10.0).alias("y"))
    return views.centre_span(p, ["k"]).withColumn("span", F.round("span", 8))


def _customers(spark, base) -> DataFrame:
    c = table(spark, base, "customer")
    segment = F.length("c_mktsegment").cast("double")
    return c.select(F.lit(0).alias("set"), "c_custkey", F.array(
        F.col("c_acctbal") / 100, F.col("c_nationkey").cast("double"), segment, segment).alias("v"))


NEAR = """
v AS (SELECT c_custkey, c_acctbal / 100 AS a, c_nationkey::DOUBLE AS b, length(c_mktsegment)::DOUBLE AS s FROM customer)"""


@catalog.add("near_duplicate_pairs", f"""
WITH {NEAR} SELECT p.c_custkey AS "first", q.c_custkey AS "second",
  round(sqrt(((p.a-q.a)*(p.a-q.a) + (p.b-q.b)*(p.b-q.b) + 2*(p.s-q.s)*(p.s-q.s)) / 2), 8) AS rms
FROM v p JOIN v q ON p.c_custkey < q.c_custkey
WHERE sqrt(((p.a-q.a)*(p.a-q.a) + (p.b-q.b)*(p.b-q.b) + 2*(p.s-q.s)*(p.s-q.s)) / 2) < 0.3001
""")
def near_duplicate_pairs(spark, base) -> DataFrame:
    """Customers as views of two 2-D points, near when their RMS point distance is small.

    Distances are taken between the first views of equal ones, then given to all copies. A view that is not at
    distance 0 from itself holds an unknown value and is near nothing.
    """
    known = _customers(spark, base).filter(views.squared_distance(F.col("v"), F.col("v")) == 0)
    firsts, copies = views.fold_equal(known, ["set"], "c_custkey", F.col("v"))
    p = views.near_pairs(firsts, ["set"], "c_custkey", "v", 4, 0.3001, points=2, projections=3)
    return views.unfold_pairs(p, firsts, copies, ["set"], "c_custkey").select("first", "second", F.round("rms", 8).alias("rms"))


@catalog.add("keep_first_views")
def keep_first_views(spark, base) -> DataFrame:
    """Greedy de-duplication in id order; inherently sequential in SQL, tested against a loop."""
    return views.keep_first_near(_customers(spark, base), ["set"], "c_custkey", "v", 4, 0.3001, points=2, projections=3).select("c_custkey", "kept")


@catalog.add("heldout_leakage", """
WITH t AS (SELECT DISTINCT trim(l) AS l FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents) d),
h AS (SELECT item_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line, unnest(string_split(text, chr(10))) AS l FROM benchmark)
SELECT item_id, CAST(line AS INTEGER) AS line FROM h WHERE EXISTS (SELECT 1 FROM t WHERE t.l = trim(h.l))
""")
def heldout_leakage(spark, base) -> DataFrame:
    """Benchmark lines that also occur as a line of some training document."""
    train = table(spark, base, "documents").select(F.explode(F.split("text", "\n")).alias("l")).select(F.trim("l").alias("content"))
    held = table(spark, base, "benchmark").select("item_id", F.posexplode(F.split("text", "\n")).alias("line", "l")).select(
        "item_id", "line", F.trim("l").alias("content"))
    return views.leakage(held, train, "content").select("item_id", "line")


@catalog.add("evidence_precedence", """
WITH a AS (SELECT l_partkey AS k, min(l_extendedprice) AS v FROM lineitem WHERE l_discount >= 0.1 AND l_quantity > 40 GROUP BY 1),
b AS (SELECT l_partkey AS k, min(l_tax) AS v FROM lineitem WHERE l_tax > 0.07 AND l_quantity < 10 GROUP BY 1),
c AS (SELECT p_partkey AS k, p_retailprice AS v FROM part WHERE p_size > 25), d AS (SELECT p_partkey AS k FROM part)
SELECT d.k, CASE WHEN a.k IS NOT NULL THEN 'explicit' WHEN b.k IS NOT NULL THEN 'adjacent' WHEN c.k IS NOT NULL THEN 'container' ELSE 'unobservable' END AS evidence,
       coalesce(a.v, b.v, c.v) AS v FROM d LEFT JOIN a USING (k) LEFT JOIN b USING (k) LEFT JOIN c USING (k)
""")
def evidence_precedence(spark, base) -> DataFrame:
    li, p = table(spark, base, "lineitem"), table(spark, base, "part")
    part = F.col("l_partkey").alias("k")
    return candidates.evidence_precedence([
        ("explicit", li.filter((F.col("l_discount") >= 0.1) & (F.col("l_quantity") > 40)).select(part, F.col("l_extendedprice").alias("v"))),
        ("adjacent", li.filter((F.col("l_tax") > 0.07) & (F.col("l_quantity") < 10)).select(part, F.col("l_tax").alias("v"))),
        ("container", p.filter(F.col("p_size") > 25).select(F.col("p_partkey").alias("k"), F.col("p_retailprice").alias("v"))),
        ("unobservable", p.select(F.col("p_partkey").alias("k"), F.lit(None).cast("double").alias("v")))], ["k"], ["v"])


@catalog.add("best_supported_group", """
WITH g AS (SELECT l_suppkey AS k, l_linenumber AS g, l_returnflag AS f, count(DISTINCT l_orderkey) AS views, max(l_linenumber * 7 % 5) AS size FROM lineitem GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY views DESC, size DESC, g, f) AS rn FROM g)
SELECT k, g, f, views, size FROM r WHERE rn = 1
""")
def best_supported_group(spark, base) -> DataFrame:
    li = table(spark, base, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_linenumber").alias("g"), F.col("l_returnflag").alias("f"), "l_orderkey")
    return candidates.best_supported_group(li, ["k"], ["g", "f"], "l_orderkey", F.col("g") * 7 % 5)


@catalog.add("best_candidate", """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_discount > 0.08, l_tax, l_quantity, l_orderkey, l_linenumber, l_suppkey) AS rn,
  count(*) OVER (PARTITION BY l_partkey) AS candidates FROM lineitem)
SELECT l_partkey, candidates, l_orderkey, l_linenumber, l_suppkey FROM r WHERE rn = 1
""")
def best_candidate(spark, base) -> DataFrame:
    return candidates.best_candidate(table(spark, base, "lineitem"), ["l_partkey"], [
        F.col("l_discount") > 0.08, "l_tax", "l_quantity", "l_orderkey", "l_linenumber", "l_suppkey"], ["l_orderkey", "l_linenumber", "l_suppkey"])


@catalog.add("near_best", """
WITH c AS (SELECT l_partkey, l_orderkey * 10 + l_linenumber AS id, l_suppkey, l_discount AS e, l_quantity AS d, l_tax * 10 AS a FROM lineitem WHERE l_discount <= 0.08),
keys AS (SELECT l_partkey, count(*) FILTER (WHERE l_discount > 0.08) AS invalid FROM lineitem GROUP BY l_partkey),
b AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY e, id, l_suppkey) AS rn, count(*) OVER (PARTITION BY l_partkey) AS valid FROM c),
n AS (SELECT c.l_partkey, c.d, c.a, b.d AS bd, b.a AS ba, b.valid FROM c JOIN b ON b.l_partkey = c.l_partkey AND b.rn = 1 AND c.e <= b.e + 0.015)
SELECT keys.l_partkey, count(n.d) AS near_best, round((max(d) - min(d)) / max(bd), 8) AS depth_spread, coalesce(max(valid), 0) AS valid_candidates,
       max(invalid) AS invalid_candidates, round(max(acos(least(abs(cos(a - ba)), 1))), 6) AS max_normal_angle
FROM keys LEFT JOIN n ON n.l_partkey = keys.l_partkey GROUP BY keys.l_partkey
""")
def near_best(spark, base) -> DataFrame:
    a = F.col("l_tax") * 10
    c = table(spark, base, "lineitem").select(
        "l_partkey", F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("a"), "l_suppkey").alias("candidate_id"),
        F.when(F.col("l_discount") <= 0.08, F.col("l_discount")).alias("e"), F.col("l_quantity").alias("d"), F.array(F.cos(a), F.sin(a), F.lit(0.0)).alias("normal"))
    n = candidates.near_best(c, ["l_partkey"], "e", "d", F.col("normal"), 0.015)
    return n.select("l_partkey", "near_best", F.round("depth_spread", 8).alias("depth_spread"), "valid_candidates",
                    "invalid_candidates", F.round("max_normal_angle", 6).alias("max_normal_angle"))


@catalog.add("perturbation_spread", """
WITH t AS (SELECT l_suppkey, l_discount < 0.1 AS ok, l_extendedprice AS f FROM lineitem),
g AS (SELECT l_suppkey, count(*) AS trials, count(*) FILTER (WHERE ok) AS consistent, min(f) FILTER (WHERE ok) AS lo, max(f) FILTER (WHERE ok) AS hi,
      median(f) FILTER (WHERE ok) AS med FROM t GROUP BY 1)
SELECT l_suppkey, trials, consistent, round(consistent / trials::DOUBLE, 9) AS share, round((hi - lo) / med, 9) AS spread,
  concat_ws(',', CASE WHEN consistent / trials::DOUBLE < 0.9 THEN 'consistent_share_below_threshold' END, CASE WHEN (hi - lo) / med > 2.0 THEN 'relative_spread_above_threshold' END) AS reasons FROM g
""")
def perturbation_spread(spark, base) -> DataFrame:
    s = candidates.perturbation_spread(table(spark, base, "lineitem"), ["l_suppkey"], F.col("l_discount") < 0.1, F.col("l_extendedprice"), max_spread=2.0)
    return s.select("l_suppkey", "trials", "consistent", F.round("share", 9).alias("share"), F.round("spread", 9).alias("spread"),
                    F.concat_ws(",", "reasons").alias("reasons"))


@catalog.add("quad_focal")
def quad_focal(spark, base) -> DataFrame:
    """Focal of one imaged rectangle per order line; the closed form is tested against a linear solve."""
    li = table(spark, base, "lineitem")
    w, tilt = F.col("l_quantity") + 200, F.col("l_discount") * 300
    corners = F.array(F.array(F.lit(-100.0), -w / 2), F.array(F.lit(140.0) + tilt, -w / 2 + tilt),
                      F.array(F.lit(160.0), w / 2 - tilt), F.array(F.lit(-120.0) - F.col("l_tax") * 100, w / 2))
    f = camera.quad_focal(corners, F.lit(6.35), F.lit(8.89), F.array(F.lit(1280.0), F.lit(720.0)), F.array(F.lit(0.0), F.lit(0.0)))
    return li.select("l_orderkey", "l_linenumber", f.alias("f")).select(
        "l_orderkey", "l_linenumber", F.round("f.focal_px", 6).alias("focal_px"), F.col("f.accepted").alias("accepted"),
        F.concat_ws(",", "f.reasons").alias("reasons"))


# ---- skeletons and meshes -----------------------------------------------

@catalog.add("top4_renormalised", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, l_quantity AS weight, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_suppkey, l_partkey) AS rank FROM lineitem),
k AS (SELECT * FROM r WHERE rank <= 4)
SELECT l_orderkey, l_linenumber AS joint, l_suppkey, l_partkey, weight, CAST(rank AS INTEGER) AS rank, sum(weight) OVER (PARTITION BY l_orderkey) AS kept_mass,
       round(weight / sum(weight) OVER (PARTITION BY l_orderkey), 9) AS renormalised FROM k
""")
def top4_renormalised(spark, base) -> DataFrame:
    w = table(spark, base, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("joint"), "l_suppkey", "l_partkey", F.col("l_quantity").alias("weight"))
    return geometry.top_weights(w, ["l_orderkey"], 4, ["l_suppkey", "l_partkey"]).withColumn("renormalised", F.round("renormalised", 9))


@catalog.add("retained_mass", """
WITH r AS (SELECT l_orderkey, l_quantity AS weight, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_suppkey, l_partkey) AS rank FROM lineitem),
v AS (SELECT l_orderkey, sum(weight) FILTER (WHERE rank <= 4) / sum(weight) AS share FROM r GROUP BY 1)
SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS side, round(min(share), 9) AS kept_min, round(avg(share), 9) AS kept_mean, round(max(1 - share), 9) AS dropped_max FROM v GROUP BY 1
""")
def retained_mass(spark, base) -> DataFrame:
    side = F.when(F.col("l_orderkey") % 2 == 0, "left").otherwise("right").alias("side")
    w = table(spark, base, "lineitem").select(side, "l_orderkey", F.col("l_linenumber").alias("joint"), "l_suppkey", "l_partkey", F.col("l_quantity").alias("weight"))
    totals = w.groupBy("side", "l_orderkey").agg(F.sum("weight").alias("total"))
    m = geometry.retained_mass(geometry.top_weights(w, ["side", "l_orderkey"], 4, ["l_suppkey", "l_partkey"]), totals, ["l_orderkey"], ["side"])
    return m.select("side", *[F.round(c, 9).alias(c) for c in ("kept_min", "kept_mean", "dropped_max")])


EDGES = """
WITH seg AS (
  SELECT l_partkey AS k, (l_orderkey * 8 + l_linenumber) * 1000000 + l_suppkey AS line_id, l_linenumber % 4 AS edge,
         CASE WHEN l_linenumber % 2 = 0 THEN 300.0 + p_size ELSE 200.0 + p_size END AS edge_length,
         l_suppkey % 10 / 12.0 AS s, CAST(l_quantity AS DOUBLE) / 60 AS f, CAST(l_discount AS DOUBLE) * 131 AS oa,
         CAST(l_discount AS DOUBLE) * 131 + (round(CAST(l_tax AS DOUBLE) * 100) - 4) * 1.73 AS ob
  FROM lineitem JOIN part ON l_partkey = p_partkey),
pts AS (SELECT *, edge_length * s - 10 AS xa, edge_length * (s + f) - 10 AS xb FROM seg),
ang AS (SELECT *, sqrt((xb - xa) * (xb - xa) + (ob - oa) * (ob - oa)) AS len FROM pts),
assoc AS (
  SELECT k, line_id, edge, edge_length, len, xa, xb, oa, ob, degrees(acos(least((xb - xa) / len, 1.0))) AS angle,
         (abs(oa) + abs(ob)) / 2 AS distance, greatest(xa, 0.0) AS low, least(xb, edge_length) AS high
  FROM ang WHERE degrees(acos(least((xb - xa) / len, 1.0))) <= 5 AND greatest(abs(oa), abs(ob)) <= 12
    AND least(xb, edge_length) > greatest(xa, 0.0))"""

CLUSTERS = EDGES + """,
mem AS (
  SELECT s.k, s.edge, s.line_id AS seed, m.line_id, m.low, m.high, m.distance, m.edge_length, m.len
  FROM assoc s JOIN assoc m USING (k, edge)
  WHERE degrees(acos(least(abs((m.xb - m.xa) * (s.xb - s.xa) + (m.ob - m.oa) * (s.ob - s.oa)) / m.len / s.len, 1.0))) <= 5
    AND greatest(abs((m.oa - s.oa) * (s.xb - s.xa) - (m.xa - s.xa) * (s.ob - s.oa)),
                 abs((m.ob - s.oa) * (s.xb - s.xa) - (m.xb - s.xa) * (s.ob - s.oa))) / s.len <= 2.5),
cov AS (
  SELECT k, edge, seed, line_id, low, high, distance, edge_length, high - greatest(low, coalesce(max(high) OVER (
    PARTITION BY k, edge, seed ORDER BY low, high, line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), low)) AS beyond FROM mem),
sco AS (
  SELECT k, edge, seed, sum(greatest(beyond, 0)) AS covered, count(*) AS members, max(edge_length) AS edge_length,
         sum(greatest(beyond, 0)) / (1 + avg(distance) / 12) AS score FROM cov GROUP BY 1, 2, 3),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, edge ORDER BY round(score, 9) DESC, seed) AS r FROM sco
                 WHERE round(covered / edge_length, 9) >= 0.15) WHERE r = 1)"""


def _edge_associations(spark, base) -> DataFrame:
    """Each part is a quad, its order lines are segments along one of its edges, more or less aslant."""
    w, h, zero = F.col("w"), F.col("h"), F.lit(0.0)
    size = F.col("p_size").cast("double")
    sizes = table(spark, base, "part").select(F.col("p_partkey").alias("k"), (size + 300).alias("w"), (size + 200).alias("h"))
    quads = sizes.select("k", F.array(F.array(zero, zero), F.array(w, zero), F.array(w, h), F.array(zero, h)).alias("corners"))
    li = table(spark, base, "lineitem").select(
        F.col("l_partkey").alias("k"), ((F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 1000000 + F.col("l_suppkey")).alias("line_id"), (F.col("l_linenumber") % 4).alias("e"),
        (F.col("l_suppkey") % 10 / 12.0).alias("s"), (F.col("l_quantity").cast("double") / 60).alias("f"), (F.col("l_discount").cast("double") * 131).alias("oa"),
        ((F.round(F.col("l_tax").cast("double") * 100) - 4) * 1.73).alias("turn")).join(sizes.hint("merge"), "k")
    length = F.when(F.col("e") % 2 == 0, w).otherwise(h)

    def point(x, o):
        return F.when(F.col("e") == 0, F.array(x, o)).when(F.col("e") == 1, F.array(w - o, x)).when(
            F.col("e") == 2, F.array(w - x, h - o)).otherwise(F.array(o, h - x))

    lines = li.select("k", "line_id", point(length * F.col("s") - 10, F.col("oa")).alias("a"),
                      point(length * (F.col("s") + F.col("f")) - 10, F.col("oa") + F.col("turn")).alias("b"))
    return candidates.edge_associations(lines, quads, ["k"])


@catalog.add("edge_associations", EDGES + """
SELECT k, line_id, CAST(edge AS INTEGER) AS edge, round(angle, 6) AS angle, round(distance, 6) AS distance, round(low, 6) AS low, round(high, 6) AS high FROM assoc
""")
def edge_associations(spark, base) -> DataFrame:
    return _edge_associations(spark, base).select("k", "line_id", "edge", *[F.round(c, 6).alias(c) for c in ("angle", "distance", "low", "high")])


def _near_segments(spark, base) -> DataFrame:
    """Members of every seed, without their points: this is kept on disk, as the clusters read it several times."""
    near = candidates.collinear_members(_edge_associations(spark, base), ["k"])
    return near.select("k", "edge", "seed", "line_id", "low", "high", "distance", "edge_length", "length")


@catalog.add("edge_clusters", CLUSTERS + """
SELECT k, CAST(edge AS INTEGER) AS edge, seed, round(covered, 6) AS covered, round(score, 6) AS score, members FROM best
""")
def edge_clusters(spark, base) -> DataFrame:
    """The collinear cluster of each edge that covers it best."""
    near = cut(_near_segments(spark, base))
    best = candidates.collinear_clusters(near, ["k"])
    return best.select("k", "edge", "seed", F.round("covered", 6).alias("covered"), F.round("score", 6).alias("score"), "members")


@catalog.add("edge_segments", CLUSTERS + """
SELECT k, CAST(edge AS INTEGER) AS edge, line_id, round(len / covered, 6) AS weight FROM mem JOIN best USING (k, edge, seed)
""")
def edge_segments(spark, base) -> DataFrame:
    """The segments of the best clusters and their weights."""
    near = cut(_near_segments(spark, base))
    best = candidates.collinear_clusters(near, ["k"]).select("k", "edge", "seed", "covered")
    picked = near.join(best, ["k", "edge", "seed"])
    return picked.select("k", "edge", "line_id", F.round(F.col("length") / F.col("covered"), 6).alias("weight"))


@catalog.add("kinematics_chain", f"""
WITH {OBS}, t AS (SELECT * FROM (VALUES (0, -1), (1, 0), (2, 1), (3, 2), (4, 0), (5, 4), (6, 5), (7, 0), (8, 7), (9, 8), (10, 0), (11, 10), (12, 11), (13, 0), (14, 13), (15, 14)) v(joint, parent)),
c AS (SELECT t.joint, (t.joint + 1) / 32.0 + coalesce((p.joint + 1) / 32.0, 0) + coalesce((g.joint + 1) / 32.0, 0) + coalesce((h.joint + 1) / 32.0, 0) AS share
      FROM t LEFT JOIN t p ON p.joint = t.parent LEFT JOIN t g ON g.joint = p.parent LEFT JOIN t h ON h.joint = g.parent)
SELECT clip_id, det_idx, joint, round(sin(angle * share / 2), 8) + 0.0 AS qz, round(cos(angle * share / 2), 8) + 0.0 AS qw FROM obs, c
""")
def kinematics_chain(spark, base) -> DataFrame:
    """Sixteen local turns about one axis; angles add along the chain."""
    o = observations(spark, base).select("clip_id", "det_idx", F.acos(F.least(F.col("quat").getItem(3), F.lit(1.0))).alias("half"))
    local = F.array(*[F.array(F.lit(0.0), F.lit(0.0), F.sin(F.col("half") * (j + 1) / 32.0), F.cos(F.col("half") * (j + 1) / 32.0))
                      for j in range(len(JOINT_PARENTS))])
    o = geometry.forward_kinematics(o.select("clip_id", "det_idx", local.alias("local")), "local")
    return o.select("clip_id", "det_idx", "joint", (F.round(F.col("world").getItem(2), 8) + 0.0).alias("qz"),
                    (F.round(F.col("world").getItem(3), 8) + 0.0).alias("qw"))


@catalog.add("bone_length_deviation", f"""
WITH {OBS}, f AS (SELECT clip_id, frame, avg(x) AS x, avg(z) AS z FROM obs GROUP BY 1, 2),
l AS (SELECT clip_id, frame, j AS joint, sqrt(x * x + z * z) / (j + 1) AS len FROM f, range(1, 4) r(j)),
b AS (SELECT clip_id, joint, arg_min(len, frame) AS first_len, min(len) AS lo, max(len) AS hi FROM l GROUP BY 1, 2)
SELECT clip_id, CAST(joint AS INTEGER) AS joint, round(greatest(hi - first_len, first_len - lo), 6) AS max_deviation FROM b
""")
def bone_length_deviation(spark, base) -> DataFrame:
    """A four-joint chain whose bone j has length r / (j + 1) in each frame."""
    f = observations(spark, base).groupBy("clip_id", "frame").agg(
        F.avg(F.col("trans").getItem(0)).alias("x"), F.avg(F.col("trans").getItem(2)).alias("z"))
    reach = [0.0, 1 / 2, 1 / 2 + 1 / 3, 1 / 2 + 1 / 3 + 1 / 4]
    joints = f.select("clip_id", "frame", F.posexplode(F.array(*[
        F.array(F.col("x") * r, F.lit(0.0), F.col("z") * r) for r in reach])).alias("joint", "p"))
    tree = spark.createDataFrame([(0, -1), (1, 0), (2, 1), (3, 2)], "joint int, parent int")
    d = geometry.bone_length_deviation(geometry.bone_lengths(joints, ["clip_id"], tree), ["clip_id"])
    return d.withColumn("max_deviation", F.round("max_deviation", 6))


@catalog.add("quat_axis_roundtrip", f"""
WITH {OBS}, h AS (SELECT clip_id, det_idx, sin(angle / 2) AS s, cos(angle / 2) AS c FROM obs),
v AS (SELECT clip_id, det_idx, CASE WHEN abs(s) < 1e-12 THEN 0.0 ELSE sign(s) * CASE WHEN c < 0 THEN -1 ELSE 1 END * 2 * atan2(abs(s), abs(c)) END AS angle FROM h)
SELECT clip_id, det_idx, round(angle, 8) AS angle, round(sin(angle / 2), 8) + 0.0 AS qz, round(cos(angle), 8) + 0.0 AS m00, round(-sin(angle), 8) + 0.0 AS m01 FROM v
""")
def quat_axis_roundtrip(spark, base) -> DataFrame:
    """Quaternion to rotation vector, back, to a matrix and back again. A turn beyond half a circle is the shorter one the other way."""
    o = observations(spark, base).select("clip_id", "det_idx", rotation.quat_to_axis_angle(F.col("quat")).alias("v"))
    q = o.select("clip_id", "det_idx", "v", rotation.axis_angle_to_quat(F.col("v")).alias("q"))
    m = q.select("clip_id", "det_idx", "v", rotation.quat_to_matrix(F.col("q")).alias("m"))
    b = m.select("clip_id", "det_idx", "v", "m", rotation.matrix_to_quat(F.col("m")).alias("q"))
    return b.select("clip_id", "det_idx", F.round(F.col("v").getItem(2), 8).alias("angle"), (F.round(F.col("q").getItem(2), 8) + 0.0).alias("qz"),
                    (F.round(F.col("m").getItem(0), 8) + 0.0).alias("m00"), (F.round(F.col("m").getItem(1), 8) + 0.0).alias("m01"))


@catalog.add("basis_change", f"""
WITH {OBS} SELECT clip_id, det_idx, round(z * 100, 6) AS ex, round(x * 100, 6) AS ey, round(-y * 100, 6) + 0.0 AS ez, round(x, 9) AS back_x,
  round(-sin(angle / 2), 8) + 0.0 AS qx, round(cos(angle / 2), 8) + 0.0 AS qw, round(sin(angle / 2), 8) + 0.0 AS back_qz FROM obs
""")
def basis_change(spark, base) -> DataFrame:
    o = observations(spark, base).select("clip_id", "det_idx", rotation.camera_to_engine(F.col("trans")).alias("e"),
                                         rotation.camera_rotation_to_engine(F.col("quat")).alias("r"))
    return o.select("clip_id", "det_idx", F.round(F.col("e").getItem(0), 6).alias("ex"), F.round(F.col("e").getItem(1), 6).alias("ey"),
                    (F.round(F.col("e").getItem(2), 6) + 0.0).alias("ez"), F.round(rotation.engine_to_camera(F.col("e")).getItem(0), 9).alias("back_x"),
                    (F.round(F.col("r").getItem(0), 8) + 0.0).alias("qx"), (F.round(F.col("r").getItem(3), 8) + 0.0).alias("qw"),
                    (F.round(rotation.engine_rotation_to_camera(F.col("r")).getItem(2), 8) + 0.0).alias("back_qz"))


FACES = """
f AS (SELECT l_returnflag AS k, l_partkey % 50 AS a, l_suppkey % 50 AS b, (l_linenumber * 7 + l_orderkey) % 50 AS c FROM lineitem),
p AS (SELECT *, a * 0.5 AS ax, (a * a % 7)::DOUBLE AS ay, (a % 3)::DOUBLE AS az, b * 0.5 AS bx, (b * b % 7)::DOUBLE AS by_, (b % 3)::DOUBLE AS bz,
             c * 0.5 AS cx, (c * c % 7)::DOUBLE AS cy, (c % 3)::DOUBLE AS cz FROM f)"""


def _faces(spark, base) -> DataFrame:
    li = table(spark, base, "lineitem")
    f = li.select(F.col("l_returnflag").alias("k"), (F.col("l_partkey") % 50).alias("a"), (F.col("l_suppkey") % 50).alias("b"),
                  ((F.col("l_linenumber") * 7 + F.col("l_orderkey")) % 50).alias("c"))

    def point(v):
        return F.array(F.col(v) * 0.5, (F.col(v) * F.col(v) % 7).cast("double"), (F.col(v) % 3).cast("double")).alias(f"p{v}")

    return f.select("*", *[point(v) for v in "abc"])


@catalog.add("mesh_normals", f"""
WITH {FACES}, n AS (SELECT k, a, b, c, (by_-ay)*(cz-az) - (bz-az)*(cy-ay) AS nx, (bz-az)*(cx-ax) - (bx-ax)*(cz-az) AS ny, (bx-ax)*(cy-ay) - (by_-ay)*(cx-ax) AS nz FROM p),
v AS (SELECT k, unnest([a, b, c]) AS vertex, nx, ny, nz FROM n), s AS (SELECT k, vertex, sum(nx) AS x, sum(ny) AS y, sum(nz) AS z FROM v GROUP BY 1, 2)
SELECT k, vertex, round(x / nullif(sqrt(x*x+y*y+z*z), 0), 8) + 0.0 AS nx, round(y / nullif(sqrt(x*x+y*y+z*z), 0), 8) + 0.0 AS ny, round(z / nullif(sqrt(x*x+y*y+z*z), 0), 8) + 0.0 AS nz FROM s
""")
def mesh_normals(spark, base) -> DataFrame:
    n = geometry.vertex_normals(_faces(spark, base), ["k"])
    return n.select("k", "vertex", *[(F.round(c, 8) + 0.0).alias(c) for c in ("nx", "ny", "nz")])


@catalog.add("mesh_audit", f"""
WITH {FACES}, e AS (SELECT k, least(a,b) AS u, greatest(a,b) AS v FROM p UNION ALL SELECT k, least(b,c), greatest(b,c) FROM p UNION ALL SELECT k, least(c,a), greatest(c,a) FROM p),
u AS (SELECT k, u, v, count(*) AS uses FROM e GROUP BY 1, 2, 3),
g AS (SELECT k, count(*) AS edges, count(*) FILTER (WHERE uses = 1) AS boundary_edges, count(*) FILTER (WHERE uses > 2) AS nonmanifold_edges FROM u GROUP BY k),
w AS (SELECT k, count(*) AS faces, sum((ax*(by_*cz-bz*cy) + ay*(bz*cx-bx*cz) + az*(bx*cy-by_*cx)) / 6) AS vol FROM p GROUP BY k)
SELECT k, edges, boundary_edges, nonmanifold_edges, faces, round(vol, 4) AS signed_volume FROM g JOIN w USING (k)
""")
def mesh_audit(spark, base) -> DataFrame:
    return geometry.mesh_audit(_faces(spark, base), ["k"]).withColumn("signed_volume", F.round("signed_volume", 4))


@catalog.add("vertex_bounds", f"""
WITH {OBS} SELECT clip_id, side, min(x) AS x_min, min(y) AS y_min, min(z) AS z_min, max(x) AS x_max, max(y) AS y_max, max(z) AS z_max FROM obs GROUP BY clip_id, side
""")
def vertex_bounds(spark, base) -> DataFrame:
    return geometry.bounds(observations(spark, base), ["clip_id", "side"], "trans")


@catalog.add("lsq_translation", """
WITH d AS (SELECT l_orderkey AS k, l_linenumber::BIGINT AS line, TRY_CAST(l_quantity AS DECIMAL(12,2)) AS q, TRY_CAST(l_discount AS DECIMAL(5,2)) AS d, TRY_CAST(l_tax AS DECIMAL(5,2)) AS t FROM lineitem),
r AS (SELECT k, q * 0.1 AS px, CAST(line AS DECIMAL(10,0)) AS py, d * 10 + 1 AS pz, t * 5 AS rx, d - 0.05 AS ry FROM d),
s AS (SELECT k, count(*)::DOUBLE AS n, sum(rx)::DOUBLE AS sx, sum(ry)::DOUBLE AS sy, sum(rx*rx + ry*ry)::DOUBLE AS sr, sum(rx*pz - px)::DOUBLE AS bx, sum(ry*pz - py)::DOUBLE AS by_,
       sum(-(rx*(rx*pz - px) + ry*(ry*pz - py)))::DOUBLE AS bz, min(pz)::DOUBLE AS nearest FROM r GROUP BY k),
t AS (SELECT *, CASE WHEN n >= 2 AND n*sr - sx*sx - sy*sy > 1e-4 THEN (n*bz + sx*bx + sy*by_) / (n*sr - sx*sx - sy*sy) END AS tz FROM s)
SELECT k, round(((bx + sx*tz) / n)::DECIMAL(30,11), 7)::DOUBLE AS tx, round(((by_ + sy*tz) / n)::DECIMAL(30,11), 7)::DOUBLE AS ty, round(tz::DECIMAL(30,11), 7)::DOUBLE AS tz, CASE WHEN tz IS NULL THEN 'degenerate' WHEN nearest + tz <= 0 THEN 'behind_camera' END AS reason FROM t
""")
def lsq_translation(spark, base) -> DataFrame:
    """Lines hold hundredths, which are added as such: a sum of doubles depends on the order of its rows. Halves in the
    eighth place are common then, and decided to eleven places, as the last bit of a division would decide them."""
    q, d, t = (F.col(c).try_cast(f"decimal({n},2)") for c, n in (("l_quantity", 12), ("l_discount", 5), ("l_tax", 5)))
    rays = table(spark, base, "lineitem").select(
        F.col("l_orderkey").alias("k"), (q * F.lit(Decimal("0.1"))).alias("px"), F.col("l_linenumber").cast("decimal(10,0)").alias("py"),
        (d * 10 + 1).alias("pz"), (t * 5).alias("rx"), (d - F.lit(Decimal("0.05"))).alias("ry"))
    s = geometry.least_squares_translation(rays, ["k"], 1e-4)
    return s.select("k", *[F.round(F.round(c, 11), 7).alias(c) for c in ("tx", "ty", "tz")], "reason")


@catalog.add("packet_pose", f"""
WITH {OBS} SELECT clip_id, det_idx, round((z + 200) / 100 * 100, 6) AS px, round(x / 100 * 100, 6) AS py, round(-y / 100 * 100, 6) + 0.0 AS pz, true AS same_corners FROM obs
""")
def packet_pose(spark, base) -> DataFrame:
    """Stored packet poses; the corner round trip must agree below 1e-6 pixels."""
    t = F.col("trans")
    o = observations(spark, base).select("clip_id", "det_idx", rotation.quat_to_matrix(F.col("quat")).alias("r"),
                                         F.array(t.getItem(0) / 100, t.getItem(1) / 100, (t.getItem(2) + 200) / 100).alias("t"))
    k = F.array(*[F.lit(v) for v in (600.0, 600.0, 320.0, 240.0)])
    d = F.array(*[F.lit(v) for v in (0.01, -0.02, 0.001, 0.0005)])
    p = geometry.packet_round_trip(o, F.col("r"), F.col("t"), F.lit(0.0635), F.lit(0.0889), k, d)
    pos = F.col("position_cm")
    return p.select("clip_id", "det_idx", F.round(pos.getItem(0), 6).alias("px"), F.round(pos.getItem(1), 6).alias("py"),
                    (F.round(pos.getItem(2), 6) + 0.0).alias("pz"), (F.col("corner_gap") < 1e-6).alias("same_corners"))
