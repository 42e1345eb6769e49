"""Gates, residuals, medians, scale and the display sweep."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import usability
from ..operators import fill, gates, scale, selection, sweep
from ..operators.gates import GeometryCriteria
from ..sources.warehouse import frame_count, observations, table
from .base import GROUPS, OBS, Catalog
from .timelines import DENSE, retained

catalog = Catalog.empty()

# Hand length and limits chosen so that all three gate states occur on the event data.
LENGTH = 60.0
CRITERIA = GeometryCriteria(wrist_distance_max=1.5, depth_min=0.1, depth_max=1.5, depth_difference_max=1.2)

WIDE = GROUPS + """,
wide AS (
  SELECT clip_id, frame, max(x) FILTER (WHERE side = 'left') AS lx, max(y) FILTER (WHERE side = 'left') AS ly,
         max(z) FILTER (WHERE side = 'left') AS lz, max(x) FILTER (WHERE side = 'right') AS rx,
         max(y) FILTER (WHERE side = 'right') AS ry, max(z) FILTER (WHERE side = 'right') AS rz
  FROM kept GROUP BY clip_id, frame)"""

STATES_SQL = WIDE + f""",
ratios AS (
  SELECT clip_id, frame, 'wrist_distance' AS "check",
         sqrt((lx-rx)*(lx-rx) + (ly-ry)*(ly-ry) + (lz-rz)*(lz-rz)) / {LENGTH} AS v,
         NULL::DOUBLE AS lo, {CRITERIA.wrist_distance_max} AS hi, true AS strict FROM wide
  UNION ALL SELECT clip_id, frame, 'left_depth', lz / {LENGTH}, {CRITERIA.depth_min}, {CRITERIA.depth_max}, false FROM wide
  UNION ALL SELECT clip_id, frame, 'right_depth', rz / {LENGTH}, {CRITERIA.depth_min}, {CRITERIA.depth_max}, false FROM wide
  UNION ALL SELECT clip_id, frame, 'depth_difference', abs(lz - rz) / {LENGTH}, NULL, {CRITERIA.depth_difference_max}, true FROM wide),
gate AS (
  SELECT *, CASE WHEN v IS NULL THEN 'unassessable' WHEN v < lo OR v > hi OR (strict AND v >= hi) THEN 'failed'
                 ELSE 'passed' END AS state FROM ratios),
summary AS (
  SELECT clip_id, "check", count(*) AS frames,
         CASE WHEN bool_or(state = 'failed') THEN 'failed' WHEN bool_or(state = 'unassessable') THEN 'unassessable'
              ELSE 'passed' END AS status,
         count(*) FILTER (WHERE state = 'failed') AS failed_frames,
         count(*) FILTER (WHERE state = 'unassessable') AS unassessable_frames,
         round(min(v), 8) AS minimum, round(max(v), 8) AS maximum, round(median(v), 8) AS median
  FROM gate GROUP BY clip_id, "check")"""


def two_hand_states(spark, base) -> DataFrame:
    wide = gates.two_sides(retained(spark, base), ["clip_id"], "trans")
    return gates.geometry_states(wide, ["clip_id"], F.lit(LENGTH), CRITERIA, known=F.lit(True))


@catalog.add("numeric_gate", f"""
WITH {STATES_SQL}
SELECT clip_id, "check", frames, status, failed_frames, unassessable_frames, minimum, maximum, median FROM summary
""")
def numeric_gate(spark, base) -> DataFrame:
    s = gates.gate_summary(two_hand_states(spark, base), ["clip_id", "check"])
    return s.select("clip_id", "check", "frames", "status", "failed_frames", "unassessable_frames",
                    *[F.round(c, 8).alias(c) for c in ("minimum", "maximum", "median")])


@catalog.add("geometry_status", f"""
WITH {STATES_SQL}, f AS (
  SELECT clip_id, CASE WHEN bool_or(status = 'failed') THEN 'failed'
                       WHEN bool_or(status = 'unassessable') THEN 'unassessable' ELSE 'passed' END AS numeric_status
  FROM summary GROUP BY clip_id)
SELECT clip_id, numeric_status, CASE WHEN numeric_status = 'failed' THEN 'failed' ELSE 'unassessable' END AS status FROM f
""")
def geometry_status(spark, base) -> DataFrame:
    """Numbers without an established camera: a failure counts, a pass does not."""
    states = two_hand_states(spark, base)
    checks = states.groupBy("clip_id", "check").agg(gates.fold(F.col("state")).alias("status"))
    return gates.overall(checks, ["clip_id"], known=F.lit(False))


@catalog.add("failed_gate_ranges", f"""
WITH {STATES_SQL}, n AS (
  SELECT *, frame - row_number() OVER (PARTITION BY clip_id, "check" ORDER BY frame) AS island
  FROM gate WHERE state = 'failed')
SELECT clip_id, "check", min(frame) AS "start", max(frame) AS "end" FROM n GROUP BY clip_id, "check", island
""")
def failed_gate_ranges(spark, base) -> DataFrame:
    return gates.failed_ranges(two_hand_states(spark, base), ["clip_id", "check"])


@catalog.add("display_support", """
WITH s AS (
  SELECT l_orderkey AS clip_id, CASE WHEN l_returnflag = 'A' THEN 'left' ELSE 'right' END AS side,
         l_quantity AS edge, l_quantity * l_linenumber AS area, l_discount > 0 AS ok FROM lineitem),
c AS (
  SELECT clip_id, side, 'long_edge' AS "check", CASE WHEN NOT ok THEN 'unassessable' WHEN edge < 24 THEN 'failed' ELSE 'passed' END AS st FROM s
  UNION ALL
  SELECT clip_id, side, 'foreground', CASE WHEN NOT ok THEN 'unassessable' WHEN area < 64 THEN 'failed' ELSE 'passed' END FROM s)
SELECT clip_id, side, "check", CASE WHEN bool_or(st = 'failed') THEN 'failed' WHEN bool_or(st <> 'passed') THEN 'unassessable'
       ELSE 'passed' END AS status FROM c GROUP BY clip_id, side, "check"
""")
def display_support(spark, base) -> DataFrame:
    li = table(spark, base, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("clip_id"), F.lit(0).alias("frame"),
                     F.when(F.col("l_returnflag") == "A", "left").otherwise("right").alias("side"),
                     F.col("l_quantity").alias("long_edge_px"),
                     (F.col("l_quantity") * F.col("l_linenumber")).alias("foreground_pixels"),
                     (F.col("l_discount") > 0).alias("assessable"))
    states = gates.display_support_states(rows, ["clip_id", "side"])
    return states.groupBy("clip_id", "side", "check").agg(gates.fold(F.col("state")).alias("status"))


@catalog.add("residual_stats", """
SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity - 25.5), 6) AS mean,
       round(sqrt(avg((l_quantity - 25.5) * (l_quantity - 25.5))), 6) AS rms,
       max(l_quantity - 25.5) AS maximum, median(l_quantity - 25.5) AS median,
       round(quantile_cont(l_quantity - 25.5, 0.95), 6) AS p95
FROM lineitem GROUP BY l_returnflag, l_linestatus
""")
def residual_stats(spark, base) -> DataFrame:
    s = gates.residual_stats(table(spark, base, "lineitem"), ["l_returnflag", "l_linestatus"], F.col("l_quantity") - 25.5)
    return s.select("l_returnflag", "l_linestatus", "n", F.round("mean", 6).alias("mean"),
                    F.round("rms", 6).alias("rms"), "maximum", "median", F.round("p95", 6).alias("p95"))


@catalog.add("vector_median", """
WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)
SELECT label, CAST(i AS INTEGER) AS i, count(*) AS n, round(median(v), 9) AS median FROM e GROUP BY label, i
""")
def vector_median(spark, base) -> DataFrame:
    m = gates.vector_median(table(spark, base, "embeddings"), ["label"], "embedding")
    return m.select("label", "i", "n", F.round("median", 9).alias("median"))


ROBUST = """
per_frame AS (
  SELECT l_suppkey, l_orderkey, median(l_extendedprice / l_quantity) AS ratio, count(*) AS refs
  FROM lineitem GROUP BY l_suppkey, l_orderkey),
f AS (SELECT l_suppkey, median(ratio) AS factor, count(*) AS frames FROM per_frame GROUP BY l_suppkey),
m AS (SELECT l_suppkey, median(abs(ratio - factor)) AS mad FROM per_frame JOIN f USING (l_suppkey) GROUP BY l_suppkey),
s AS (SELECT *, greatest(0.05 * factor, 3 * 1.4826 * mad) AS threshold FROM f JOIN m USING (l_suppkey))"""


def _ratios(spark, base) -> DataFrame:
    return scale.frame_medians(table(spark, base, "lineitem"), ["l_suppkey"], ["l_orderkey"],
                               F.col("l_extendedprice") / F.col("l_quantity"))


@catalog.add("robust_scale", f"""
WITH {ROBUST}
SELECT l_suppkey, frames, round(factor, 8) AS factor, round(mad, 8) AS mad, round(threshold, 8) AS threshold FROM s
""")
def robust_scale(spark, base) -> DataFrame:
    s = scale.robust_scale(_ratios(spark, base), ["l_suppkey"])
    return s.select("l_suppkey", "frames", *[F.round(c, 8).alias(c) for c in ("factor", "mad", "threshold")])


@catalog.add("scale_outliers", f"""
WITH {ROBUST}
SELECT l_suppkey, l_orderkey, round(ratio, 8) AS ratio, refs AS "references"
FROM per_frame JOIN s USING (l_suppkey) WHERE abs(ratio - factor) > threshold
""")
def scale_outliers(spark, base) -> DataFrame:
    frames = _ratios(spark, base)
    out = scale.scale_outliers(frames, scale.robust_scale(frames, ["l_suppkey"]), ["l_suppkey"])
    return out.select("l_suppkey", "l_orderkey", F.round("ratio", 8).alias("ratio"), "references")


FALLBACK = """
a AS (SELECT l_suppkey AS k, median(l_extendedprice / l_quantity) AS factor FROM lineitem
      WHERE l_discount >= 0.1 AND l_tax >= 0.08 AND l_quantity > 40 GROUP BY 1),
m AS (SELECT l_suppkey AS k, median(l_extendedprice / l_quantity) AS factor FROM lineitem
      WHERE l_discount = 0 AND l_tax = 0 AND l_quantity > 48 GROUP BY 1),
scales AS (
  SELECT s_suppkey, coalesce(a.factor, m.factor) AS mpu,
         CASE WHEN a.factor IS NOT NULL THEN 'card_pnp' WHEN m.factor IS NOT NULL THEN 'user_measured' END AS anchor_method,
         CASE WHEN coalesce(a.factor, m.factor) IS NULL THEN 'unknown' ELSE 'medium' END AS confidence
  FROM supplier LEFT JOIN a ON a.k = s_suppkey LEFT JOIN m ON m.k = s_suppkey)"""


def _scales(spark, base) -> DataFrame:
    li = table(spark, base, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    anchors = scale.exact_quantiles(
        li.filter((F.col("l_discount") >= 0.1) & (F.col("l_tax") >= 0.08) & (F.col("l_quantity") > 40)),
        ["s_suppkey"], F.col("l_extendedprice") / F.col("l_quantity"), {"factor": 0.5})
    measured = li.filter((F.col("l_discount") == 0) & (F.col("l_tax") == 0) & (F.col("l_quantity") > 48)).select(
        "s_suppkey", F.col("l_extendedprice").alias("measured_length"), F.col("l_quantity").alias("neutral_length"))
    return scale.scale_fallback(table(spark, base, "supplier").select("s_suppkey"), ["s_suppkey"], anchors, measured)


@catalog.add("scale_fallback", f"""
WITH {FALLBACK}
SELECT s_suppkey, round(mpu, 8) AS meters_per_unit, anchor_method, confidence, round(coalesce(mpu, 1.0), 8) AS global_factor FROM scales
""")
def scale_fallback(spark, base) -> DataFrame:
    return _scales(spark, base).withColumn("meters_per_unit", F.round("meters_per_unit", 8)).withColumn(
        "global_factor", F.round("global_factor", 8))


@catalog.add("apply_scale", f"""
WITH {FALLBACK}
SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity * coalesce(mpu, 1.0), 8) AS x,
       round(l_linenumber * coalesce(mpu, 1.0), 8) AS y, mpu IS NOT NULL AS is_metric
FROM lineitem LEFT JOIN scales ON s_suppkey = l_suppkey
""")
def apply_scale(spark, base) -> DataFrame:
    geometry = table(spark, base, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("s_suppkey"),
        F.array(F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.lit(0.0)).alias("p"),
        F.lit(False).alias("is_metric"))
    out = scale.apply_scale(geometry, _scales(spark, base), ["p"], group="s_suppkey")
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("p").getItem(0), 8).alias("x"),
                      F.round(F.col("p").getItem(1), 8).alias("y"), "is_metric")


# ---- display sweep ------------------------------------------------------

SWEEP_LENGTH = 100.0
SWEEP = GeometryCriteria()


def sweep_frames(spark, base) -> DataFrame:
    """Dense affine coefficients of both hands: constant = position, slope from the score."""
    kept = retained(spark, base).withColumn("slope", F.array(F.col("score") + 0.5))
    dense = fill.fill_vectors(kept, ["clip_id", "side"], ["trans", "slope"], frame_count(spark, base))
    is_left = F.col("side") == "left"
    return dense.groupBy("clip_id", "frame").agg(
        F.max(F.when(is_left, F.col("trans"))).alias("lc"), F.max(F.when(~is_left, F.col("trans"))).alias("rc"),
        F.max(F.when(is_left, F.col("slope").getItem(0))).alias("ls"),
        F.max(F.when(~is_left, F.col("slope").getItem(0))).alias("rs")).filter(
            F.col("lc").isNotNull() & F.col("rc").isNotNull())


SWEEP_SQL = DENSE.replace("k.score, k.angle", "k.score + 0.5 AS score, k.angle").replace(
    "last_value(angle IGNORE NULLS) OVER b AS pa, first_value(angle IGNORE NULLS) OVER a AS qa",
    "last_value(score IGNORE NULLS) OVER b AS pa, first_value(score IGNORE NULLS) OVER a AS qa") + """,
pairs AS (
  SELECT l.clip_id, l.frame, l.x AS lx, l.y AS ly, l.z AS lz, l.angle AS ls, r.x AS rx, r.y AS ry, r.z AS rz, r.angle AS rs
  FROM dense l JOIN dense r ON l.clip_id = r.clip_id AND l.frame = r.frame AND l.side = 'left' AND r.side = 'right'),
diffs AS (SELECT *, lz - rz AS dz, ls - rs AS ds, 22500.0 - ((lx-rx)*(lx-rx) + (ly-ry)*(ly-ry)) AS remaining FROM pairs),
raw AS (
  SELECT clip_id, (200 - lz) / ls AS b FROM diffs UNION ALL SELECT clip_id, (1000 - lz) / ls FROM diffs
  UNION ALL SELECT clip_id, (200 - rz) / rs FROM diffs UNION ALL SELECT clip_id, (1000 - rz) / rs FROM diffs
  UNION ALL SELECT clip_id, (200 - dz) / ds FROM diffs WHERE ds <> 0
  UNION ALL SELECT clip_id, (-200 - dz) / ds FROM diffs WHERE ds <> 0
  UNION ALL SELECT clip_id, (sqrt(remaining) - dz) / ds FROM diffs WHERE ds <> 0 AND remaining >= 0
  UNION ALL SELECT clip_id, (-sqrt(remaining) - dz) / ds FROM diffs WHERE ds <> 0 AND remaining >= 0),
bounds AS (SELECT DISTINCT clip_id, b FROM raw WHERE b > 0 AND isfinite(b)),
ordered AS (SELECT *, lead(b) OVER w AS nb, lag(b) OVER w AS pb FROM bounds WINDOW w AS (PARTITION BY clip_id ORDER BY b)),
centres AS (
  SELECT clip_id, (600 - lz) / ls AS c FROM diffs UNION ALL SELECT clip_id, (600 - rz) / rs FROM diffs),
preferred AS (SELECT clip_id, median(c) AS preferred FROM centres WHERE c > 0 GROUP BY clip_id),
cands AS (
  SELECT clip_id, b AS f, true AS edge, 0.0 AS clearance FROM ordered
  UNION ALL SELECT clip_id, exp((ln(b) + ln(nb)) / 2), false,
    least(ln(exp((ln(b) + ln(nb)) / 2) / b), ln(nb / exp((ln(b) + ln(nb)) / 2))) FROM ordered WHERE nb IS NOT NULL
  UNION ALL SELECT clip_id, b * 2, false, ln(2) FROM ordered WHERE nb IS NULL
  UNION ALL SELECT clip_id, b / 2, false, ln(2) FROM ordered WHERE pb IS NULL),
checked AS (
  SELECT c.clip_id, c.f, c.edge, c.clearance,
    CASE WHEN sqrt((lx-rx)*(lx-rx) + (ly-ry)*(ly-ry) + (dz+f*ds)*(dz+f*ds)) / 100.0 >= 1.5 THEN 1 ELSE 0 END AS g1,
    CASE WHEN (lz+f*ls)/100.0 < 2 OR (lz+f*ls)/100.0 > 10 THEN 1 ELSE 0 END AS g2,
    CASE WHEN (rz+f*rs)/100.0 < 2 OR (rz+f*rs)/100.0 > 10 THEN 1 ELSE 0 END AS g3,
    CASE WHEN abs(dz+f*ds)/100.0 >= 2 THEN 1 ELSE 0 END AS g4
  FROM cands c JOIN diffs USING (clip_id)),
scored AS (
  SELECT clip_id, f, edge, clearance, sum(greatest(g1,g2,g3,g4)) AS ff, sum(g1+g2+g3+g4) AS fg, count(*) AS n
  FROM checked GROUP BY clip_id, f, edge, clearance),
best AS (
  SELECT s.*, preferred, count(*) OVER (PARTITION BY clip_id) AS candidate_count,
    row_number() OVER (PARTITION BY clip_id ORDER BY ff, fg, edge, -clearance, abs(ln(f / preferred)), f) AS rn
  FROM scored s JOIN preferred USING (clip_id))"""


@catalog.add("threshold_sweep", f"""
WITH {SWEEP_SQL}
SELECT clip_id, n AS frame_count, round(preferred, 6) AS preferred, round(f, 6) AS focal,
       CAST(ff AS BIGINT) AS failed_frames, CAST(fg AS BIGINT) AS failed_gates, edge AS at_boundary,
       round(clearance, 8) AS log_clearance FROM best WHERE rn = 1
""")
def threshold_sweep(spark, base) -> DataFrame:
    s = sweep.select_focal(sweep_frames(spark, base), ["clip_id"], SWEEP_LENGTH, SWEEP)
    return s.select("clip_id", "frame_count", F.round("preferred", 6).alias("preferred"),
                    F.round("focal", 6).alias("focal"), "failed_frames", "failed_gates", "at_boundary",
                    F.round("log_clearance", 8).alias("log_clearance"))


@catalog.add("display_frames", f"""
WITH {GROUPS.strip()}, wide AS (
  SELECT clip_id, frame, max(x) FILTER (WHERE side = 'left') AS lx, max(y) FILTER (WHERE side = 'left') AS ly,
         max(z) FILTER (WHERE side = 'left') AS lz, max(x) FILTER (WHERE side = 'right') AS rx,
         max(y) FILTER (WHERE side = 'right') AS ry, max(z) FILTER (WHERE side = 'right') AS rz
  FROM kept GROUP BY clip_id, frame),
m AS (SELECT *, 300.0 + clip_id % 7 * 100 AS f FROM wide WHERE lx IS NOT NULL AND rx IS NOT NULL),
w AS (SELECT *, lz + f AS lw, rz + f * 0.75 AS rw FROM m)
SELECT clip_id, frame, round(sqrt((lx-rx)*(lx-rx) + (ly-ry)*(ly-ry) + (lw-rw)*(lw-rw)) / 100.0, 6) AS wrist_distance,
       concat_ws(',', CASE WHEN sqrt((lx-rx)*(lx-rx) + (ly-ry)*(ly-ry) + (lw-rw)*(lw-rw)) / 100.0 >= 1.5 THEN 'wrist_distance' END,
         CASE WHEN lw / 100.0 < 2 OR lw / 100.0 > 10 THEN 'left_depth' END,
         CASE WHEN rw / 100.0 < 2 OR rw / 100.0 > 10 THEN 'right_depth' END,
         CASE WHEN abs(lw - rw) / 100.0 >= 2 THEN 'depth_difference' END) AS failed_checks,
       round(lw * 100, 4) AS left_forward, round(rx * 100, 4) AS right_side
FROM w
""")
def display_frames(spark, base) -> DataFrame:
    """Failure matrix and engine-basis positions at a given focal per clip."""
    wide = gates.two_sides(retained(spark, base), ["clip_id"], "trans").filter(
        F.col("left_valid") & F.col("right_valid"))
    frames = wide.select("clip_id", "frame", F.col("left").alias("lc"), F.col("right").alias("rc"),
                         F.lit(1.0).alias("ls"), F.lit(0.75).alias("rs"))
    focal = observations(spark, base).select("clip_id").distinct().select(
        "clip_id", (300.0 + F.col("clip_id") % 7 * 100).alias("focal"))
    d = sweep.display_frames(frames, focal, ["clip_id"], SWEEP_LENGTH, SWEEP)
    return d.select("clip_id", "frame", F.round("wrist_distance_over_hand_length", 6).alias("wrist_distance"),
                    F.concat_ws(",", "failed_checks").alias("failed_checks"),
                    F.round(F.col("left_translation").getItem(0), 4).alias("left_forward"),
                    F.round(F.col("right_translation").getItem(1), 4).alias("right_side"))


@catalog.add("usability_score", f"""
WITH {OBS}
SELECT clip_id, det_idx, round(0.6 * CASE WHEN kind = 'purchase' THEN 0.7 ELSE 1 END * CASE WHEN ambiguous THEN 0.5 ELSE 1 END
       * CASE WHEN kind = 'signup' THEN 0.75 ELSE 1 END * CASE WHEN score < 0.05 THEN 0.75 ELSE 1 END
       * CASE WHEN z > 90 THEN 0.8 ELSE 1 END, 9) AS score,
       1 + (kind = 'purchase')::INT + ambiguous::INT + (kind = 'signup')::INT + (score < 0.05)::INT + (z > 90)::INT AS factors
FROM obs
""")
def usability_score(spark, base) -> DataFrame:
    o = observations(spark, base)
    score, factors = usability({
        "side_corrected": F.col("kind") == "purchase", "identity_ambiguous": F.col("ambiguous"),
        "identity_reacquired": F.col("kind") == "signup", "image_blur_flag": F.col("score") < 0.05,
        "outside_image_joints": F.col("trans").getItem(2) > 90})
    return o.select("clip_id", "det_idx", F.round(score, 9).alias("score"), F.size(factors).alias("factors"))


@catalog.add("inter_hand_distance", f"""
WITH {WIDE}
SELECT clip_id, count(*) AS frames, round(median(sqrt((lx-rx)*(lx-rx) + (ly-ry)*(ly-ry) + (lz-rz)*(lz-rz))), 6) AS median,
       round(sqrt(avg((lx-rx)*(lx-rx) + (ly-ry)*(ly-ry) + (lz-rz)*(lz-rz))), 6) AS rms
FROM wide WHERE lx IS NOT NULL AND rx IS NOT NULL GROUP BY clip_id
""")
def inter_hand_distance(spark, base) -> DataFrame:
    wide = gates.two_sides(retained(spark, base), ["clip_id"], "trans")
    d = gates.geometry_ratios(F.col("left"), F.col("right"), F.lit(1.0))["wrist_distance"]
    s = gates.residual_stats(wide.filter("left_valid and right_valid"), ["clip_id"], d)
    return s.select("clip_id", F.col("n").alias("frames"), F.round("median", 6).alias("median"),
                    F.round("rms", 6).alias("rms"))
