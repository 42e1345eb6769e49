"""Identity, association and mask queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import identity, masks, ranges
from ..operators.blocks import Scan, block_scan
from ..sources.warehouse import boxes, event_ms, observations, table
from .base import BOXES, EVENT_MS, GROUPS, OBS, Catalog
from .timelines import retained

catalog = Catalog.empty()


@catalog.add("identity_tracks")
def identity_tracks(spark, base) -> DataFrame:
    """Two-hand tracking over every retained observation; one slot of a clip lasts 400 ms.

    Sequential state has no plain SQL form: tests compare it with a step-by-step run.
    """
    r = retained(spark, base)
    x, y = F.col("trans").getItem(0) / 500, F.col("trans").getItem(2) / 100
    offsets = [(i / 20 - 0.5) * 0.16 for i in range(21)]
    points = F.array(F.array(x, y, F.lit(0.0)), *[F.array(x + o, y + 0.08 * (1 if i % 2 else -1), F.lit(0.0))
                                                  for i, o in enumerate(offsets[1:])])
    rows = r.select("clip_id", F.lit("primary").alias("view_id"), (F.col("frame") * 400).alias("timestamp_ms"),
                    "det_idx", "side", F.least("score", F.lit(1.0)).alias("score"), points.alias("landmarks"))
    t = identity.track_identities(rows)
    return t.select("clip_id", "timestamp_ms", "det_idx", "native_side", "side", "track_id", "track_side", "corrected",
                    "ambiguous", "source", "gap_ms", F.round("association_score", 9).alias("association_score"))


@catalog.add("track_sessions", f"""
WITH e AS (SELECT user_id AS clip_id, {EVENT_MS} AS ms, event_id FROM events),
p AS (SELECT *, ms - lag(ms) OVER w AS gap FROM e WINDOW w AS (PARTITION BY clip_id ORDER BY ms, event_id)),
s AS (SELECT *, sum(CASE WHEN gap IS NULL OR gap > 43200000 THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY ms, event_id) AS session FROM p)
SELECT clip_id, CAST(session AS BIGINT) AS session, min(ms) AS started, max(ms) AS ended, count(*) AS rows FROM s GROUP BY clip_id, session
""")
def track_sessions(spark, base) -> DataFrame:
    e = table(spark, base, "events").select(F.col("user_id").alias("clip_id"), event_ms(F.col("ts")).alias("ms"), "event_id")
    s = identity.track_sessions(e, ["clip_id"], "ms", 43200000, width=86400000, tiebreak=["event_id"])
    return s.groupBy("clip_id", "session").agg(F.min("ms").alias("started"), F.max("ms").alias("ended"),
                                               F.count(F.lit(1)).alias("rows"))


ADJACENT = GROUPS + """,
b AS (SELECT clip_id, side, frame, x / 100 AS wx, z / 100 AS wy, x / 100 - 0.4 AS x0, z / 100 - 0.3 AS y0,
             x / 100 + 0.4 AS x1, z / 100 + 0.3 + score AS y1 FROM kept),
n AS (SELECT *, lag(frame) OVER w AS pf, lag(wx) OVER w AS pwx, lag(wy) OVER w AS pwy, lag(x0) OVER w AS px0,
             lag(y0) OVER w AS py0, lag(x1) OVER w AS px1, lag(y1) OVER w AS py1 FROM b
      WINDOW w AS (PARTITION BY clip_id, side ORDER BY frame)),
m AS (SELECT *, 0.1 * least((frame - pf) * 100 / 1000.0, 0.2) AS mx, -0.2 * least((frame - pf) * 100 / 1000.0, 0.2) AS my
      FROM n WHERE pf IS NOT NULL),
g AS (SELECT *, greatest(least(x1, px1) - greatest(x0, px0), 0) * greatest(least(y1, py1) - greatest(y0, py0), 0) AS i0,
       greatest(least(x1, px1 + mx) - greatest(x0, px0 + mx), 0) * greatest(least(y1, py1 + my) - greatest(y0, py0 + my), 0) AS im,
       (x1 - x0) * (y1 - y0) AS a, (px1 - px0) * (py1 - py0) AS pa,
       sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0)) AS d, sqrt((px1-px0)*(px1-px0) + (py1-py0)*(py1-py0)) AS pd FROM m),
c AS (SELECT *, sqrt((wx-pwx-mx)*(wx-pwx-mx) + (wy-pwy-my)*(wy-pwy-my)) / greatest((d + pd) / 2, 0.05) AS dw,
       sqrt(((x0+x1-px0-px1)/2-mx)*((x0+x1-px0-px1)/2-mx) + ((y0+y1-py0-py1)/2-my)*((y0+y1-py0-py1)/2-my)) / greatest((d + pd) / 2, 0.05) AS dc,
       greatest(d, 0.01) / greatest(pd, 0.01) AS ratio FROM g)"""


@catalog.add("association_costs", f"""
WITH {ADJACENT}
SELECT clip_id, side, frame, round(i0 / (a + pa - i0), 8) AS iou,
  round(CASE WHEN dw <= 1.6 AND dc <= 1.6 AND ratio BETWEEN 0.3 AND 3.3
        THEN 0.65 * dw + 0.25 * dc + 0.15 * (1 - im / (a + pa - im)) + 0.08 * abs(ln(ratio)) END, 8) AS cost FROM c
""")
def association_costs(spark, base) -> DataFrame:
    """Box overlap and association cost of each observation against the previous one of its side."""
    t = F.col("trans")
    b = retained(spark, base).select(
        "clip_id", "side", "frame", F.array(t.getItem(0) / 100, t.getItem(2) / 100).alias("wrist"),
        F.array(t.getItem(0) / 100 - 0.4, t.getItem(2) / 100 - 0.3, t.getItem(0) / 100 + 0.4,
                t.getItem(2) / 100 + 0.3 + F.col("score")).alias("box"))
    n = block_scan(b, ["clip_id", "side"], ["frame"], [
        Scan("prev", F.struct("frame", "wrist", "box"), "p")], 32).filter(F.col("p").isNotNull())
    velocity = F.array(F.lit(0.1), F.lit(-0.2))
    cost = scoring.association_cost(F.col("wrist"), F.col("box"), F.col("p.wrist"), F.col("p.box"), velocity,
                                    (F.col("frame") - F.col("p.frame")) * 100)
    return n.select("clip_id", "side", "frame", F.round(scoring.box_iou(F.col("box"), F.col("p.box")), 8).alias("iou"),
                    F.round(cost, 8).alias("cost"))


@catalog.add("best_assignment", """
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_discount < 0.09 THEN l_discount * 20 END AS c00,
  CASE WHEN l_tax < 0.07 THEN l_tax * 25 END AS c01, CASE WHEN l_quantity < 45 THEN l_quantity / 25 END AS c10,
  CASE WHEN l_linenumber < 6 THEN l_linenumber / 4.0 END AS c11 FROM lineitem),
o AS (
  SELECT *, 2.5 AS cost, 0 AS tie, -1 AS a, -1 AS b FROM c
  UNION ALL SELECT *, 1.25 + c10, 1, -1, 0 FROM c UNION ALL SELECT *, 1.25 + c11, 2, -1, 1 FROM c
  UNION ALL SELECT *, c00 + 1.25, 3, 0, -1 FROM c UNION ALL SELECT *, c00 + c11, 4, 0, 1 FROM c
  UNION ALL SELECT *, c01 + 1.25, 5, 1, -1 FROM c UNION ALL SELECT *, c01 + c10, 6, 1, 0 FROM c),
r AS (SELECT *, row_number() OVER w AS rn, lead(cost) OVER w - cost AS margin FROM o WHERE cost IS NOT NULL
      WINDOW w AS (PARTITION BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice ORDER BY cost, tie))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(cost, 8) AS cost, a AS "first", b AS "second", round(margin, 8) AS margin FROM r WHERE rn = 1
""")
def best_assignment(spark, base) -> DataFrame:
    li = table(spark, base, "lineitem")
    best = scoring.best_assignment(
        F.when(F.col("l_discount") < 0.09, F.col("l_discount") * 20), F.when(F.col("l_tax") < 0.07, F.col("l_tax") * 25),
        F.when(F.col("l_quantity") < 45, F.col("l_quantity") / 25), F.when(F.col("l_linenumber") < 6, F.col("l_linenumber") / 4.0))
    r = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", best.alias("b"))
    return r.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("b.cost", 8).alias("cost"),
                    F.col("b.first").alias("first"), F.col("b.second").alias("second"), F.round("b.margin", 8).alias("margin"))


# ---- masks --------------------------------------------------------------

RUNS = BOXES + """,
runs AS (SELECT clip_id, y, part_id * 1000 + object_id AS object_id, y AS x0, max(x1) AS x1 FROM boxes GROUP BY 1, 2, 3)"""


def _runs(spark, base) -> DataFrame:
    """Runs of one object on one row share their start, so the longest is their union."""
    b = boxes(spark, base)
    return b.groupBy("clip_id", "y", (F.col("part_id") * 1000 + F.col("object_id")).alias("object_id")).agg(
        F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@catalog.add("interval_overlap_pairs", f"""
WITH {RUNS}, area AS (SELECT clip_id, object_id, sum(x1 - x0) AS a FROM runs GROUP BY 1, 2),
i AS (SELECT a.clip_id, a.object_id AS first_id, b.object_id AS second_id, sum(least(a.x1, b.x1) - greatest(a.x0, b.x0)) AS n
      FROM runs a JOIN runs b ON a.clip_id = b.clip_id AND a.y = b.y AND a.object_id < b.object_id AND a.x0 < b.x1 AND b.x0 < a.x1
      GROUP BY 1, 2, 3)
SELECT i.clip_id, first_id, second_id, CAST(n AS BIGINT) AS intersection_px, CAST(p.a + q.a - n AS BIGINT) AS union_px,
       round(n / (p.a + q.a - n)::DOUBLE, 9) AS mask_iou, round(n / least(p.a, q.a)::DOUBLE, 9) AS coverage,
       CASE WHEN least(p.a, q.a) < 20 THEN 'visibility_insufficient' WHEN n / least(p.a, q.a)::DOUBLE >= 0.8
            THEN 'identity_ambiguous_containment' ELSE 'no_containment_flag' END AS status
FROM i JOIN area p ON p.clip_id = i.clip_id AND p.object_id = first_id JOIN area q ON q.clip_id = i.clip_id AND q.object_id = second_id
""")
def interval_overlap_pairs(spark, base) -> DataFrame:
    p = masks.pair_overlaps(_runs(spark, base), ["clip_id"], minimum_area=20)
    return p.withColumn("mask_iou", F.round("mask_iou", 9)).withColumn("coverage", F.round("coverage", 9))


@catalog.add("interval_union_length", f"""
WITH {BOXES}, s AS (SELECT *, max(x1) OVER (PARTITION BY clip_id ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM boxes)
SELECT clip_id, CAST(sum(greatest(x1 - greatest(x0, coalesce(reach, x0)), 0)) AS BIGINT) AS covered FROM s GROUP BY clip_id
""")
def interval_union_length(spark, base) -> DataFrame:
    return ranges.union_length(boxes(spark, base), ["clip_id"], "x0", "x1")


@catalog.add("interval_difference", f"""
WITH {BOXES}, px AS (SELECT DISTINCT clip_id, flag = 'A' AS a, unnest(range(x0, x1)) AS x FROM boxes),
own AS (SELECT clip_id, x, bool_and(a) AS only_a, bool_and(NOT a) AS only_b FROM px GROUP BY clip_id, x),
n AS (SELECT clip_id, CASE WHEN only_a THEN 'a_only' ELSE 'b_only' END AS part, x,
             x - row_number() OVER (PARTITION BY clip_id, only_a ORDER BY x) AS island FROM own WHERE only_a OR only_b)
SELECT clip_id, part, min(x) AS x0, max(x) + 1 AS x1 FROM n GROUP BY clip_id, part, island
""")
def interval_difference(spark, base) -> DataFrame:
    return ranges.interval_difference(boxes(spark, base), ["clip_id"], "x0", "x1", F.col("flag") == "A")


@catalog.add("mask_bounds", f"""
WITH {RUNS}, a AS (SELECT clip_id, object_id, sum(x1 - x0) AS area, min(x0) AS xa, max(x1) AS xb, min(y) AS ya, max(y) + 1 AS yb FROM runs GROUP BY 1, 2)
SELECT clip_id, object_id, CAST(area AS BIGINT) AS area_px, xa AS x_min, xb AS x_max, ya AS y_min, yb AS y_max,
       greatest(xb - xa, yb - ya) * 1.5 AS long_edge_px, CAST(area * 2.25 AS DOUBLE) AS foreground_px,
       greatest(xb - xa, yb - ya) * 1.5 >= 24 AND area * 2.25 >= 64 AS passed,
       CASE WHEN area < 20 THEN 'insufficient_area' ELSE 'observed_region' END AS status FROM a
""")
def mask_bounds(spark, base) -> DataFrame:
    return masks.object_status(masks.pixel_support(_runs(spark, base), ["clip_id", "object_id"], 1.5), 20)


@catalog.add("mask_union_area", f"""
WITH {RUNS} SELECT clip_id, CAST(sum(w) AS BIGINT) AS area_px FROM (SELECT clip_id, y, max(x1) - y AS w FROM runs GROUP BY clip_id, y) t GROUP BY clip_id
""")
def mask_union_area(spark, base) -> DataFrame:
    return masks.mask_union_area(_runs(spark, base), ["clip_id"])


@catalog.add("interior_share", f"""
WITH {BOXES}, base AS (SELECT DISTINCT clip_id, y, unnest(range(x0, x1)) AS x FROM boxes),
lit AS (SELECT DISTINCT l_orderkey AS clip_id, CAST(l_linenumber AS BIGINT) AS y, unnest(range(CAST(l_linenumber AS BIGINT), CAST(l_linenumber + l_quantity AS BIGINT))) AS x
        FROM lineitem WHERE l_discount > 0.02),
inner_px AS (SELECT b.* FROM base b JOIN base l ON l.clip_id = b.clip_id AND l.y = b.y AND l.x = b.x - 1
  JOIN base r ON r.clip_id = b.clip_id AND r.y = b.y AND r.x = b.x + 1 JOIN base u ON u.clip_id = b.clip_id AND u.y = b.y - 1 AND u.x = b.x
  JOIN base d ON d.clip_id = b.clip_id AND d.y = b.y + 1 AND d.x = b.x),
t AS (SELECT i.clip_id, count(*) AS n, count(*) FILTER (WHERE lit.x IS NULL) AS dark FROM inner_px i LEFT JOIN lit USING (clip_id, y, x) GROUP BY 1)
SELECT c.clip_id, coalesce(n, 0) AS interior_px, coalesce(dark, 0) AS dark_px, round(coalesce(1 - dark / n::DOUBLE, 0), 9) AS lit_share,
       coalesce(n, 0) >= 20 AND coalesce(1 - dark / n::DOUBLE, 0) >= 0.9 AS passed
FROM (SELECT DISTINCT clip_id FROM boxes) c LEFT JOIN t USING (clip_id)
""")
def interior_share(spark, base) -> DataFrame:
    b = boxes(spark, base)
    lit = table(spark, base, "lineitem").filter(F.col("l_discount") > 0.02).select(
        F.col("l_orderkey").alias("clip_id"), F.col("l_linenumber").cast("long").alias("y"),
        F.col("l_linenumber").cast("long").alias("x0"), (F.col("l_linenumber") + F.col("l_quantity")).cast("long").alias("x1"))
    s = masks.interior_support(b, lit, ["clip_id"], 20, 0.9)
    return s.withColumn("lit_share", F.round("lit_share", 9))


@catalog.add("seed_consistency", f"""
WITH {BOXES}, px AS (SELECT DISTINCT clip_id, object_id, y, flag = 'A' AS fwd, unnest(range(x0, x1)) AS x FROM boxes),
p AS (SELECT clip_id, object_id, y, x, count(*) AS n FROM px GROUP BY 1, 2, 3, 4),
d AS (SELECT clip_id, object_id, count(DISTINCT flag = 'A') AS directions FROM boxes GROUP BY 1, 2)
SELECT clip_id, object_id, count(*) FILTER (WHERE n = 2) AS intersection_px, count(*) AS union_px, max(directions) AS directions,
       count(*) FILTER (WHERE n = 1) AS different_px, round(count(*) FILTER (WHERE n = 2) / count(*)::DOUBLE, 9) AS iou
FROM p JOIN d USING (clip_id, object_id) GROUP BY clip_id, object_id
""")
def seed_consistency(spark, base) -> DataFrame:
    b = boxes(spark, base).withColumn("frame", F.lit(0)).withColumn(
        "direction", F.when(F.col("flag") == "A", "forward").otherwise("reverse"))
    seeds = b.select("clip_id", "object_id", "frame").distinct()
    return masks.seed_consistency(b, seeds).withColumn("iou", F.round("iou", 9))


@catalog.add("merge_directions", f"""
WITH {OBS}, d AS (SELECT *, CASE WHEN kind IN ('click', 'signup') THEN 'reverse' ELSE 'forward' END AS direction FROM obs)
SELECT clip_id, frame, det_idx, direction FROM d WHERE (direction = 'reverse' AND frame < 60) OR (direction = 'forward' AND frame >= 60)
""")
def merge_directions(spark, base) -> DataFrame:
    o = observations(spark, base).withColumn("direction", F.when(F.col("kind").isin("click", "signup"), "reverse").otherwise("forward"))
    return masks.merge_directions(o, F.lit(60)).select("clip_id", "frame", "det_idx", "direction")


@catalog.add("bundle_counters", """
SELECT l_returnflag, count(*) AS samples, count(*) FILTER (WHERE l_quantity < 3) AS empty_masks, count(*) FILTER (WHERE l_discount > 0.03) AS quads_accepted,
       count(*) FILTER (WHERE l_discount > 0.06) AS poses_accepted, CAST(sum(l_linenumber) AS BIGINT) AS pose_candidates,
       count(*) FILTER (WHERE l_tax > 0.05) AS faces_verified, count(*) FILTER (WHERE l_linenumber > 1) AS multi_component
FROM lineitem GROUP BY l_returnflag
""")
def bundle_counters(spark, base) -> DataFrame:
    s = table(spark, base, "lineitem").select(
        "l_returnflag", F.when(F.col("l_quantity") < 3, 0).otherwise(1).alias("area_px"), (F.col("l_discount") > 0.03).alias("quad_accepted"),
        (F.col("l_discount") > 0.06).alias("pose_accepted"), F.col("l_linenumber").alias("candidates"),
        (F.col("l_tax") > 0.05).alias("face_verified"), F.col("l_linenumber").alias("component_count"))
    return masks.bundle_counters(s, ["l_returnflag"])
