"""Profiles, periodograms, job logs, metadata and single-row expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import camera, scoring
from ..functions.text import camera_category, frame_caption
from ..operators import candidates, jobs, profiles
from ..sources.warehouse import event_day, event_ms, observations, table
from .base import EVENT_MS, OBS, Catalog

catalog = Catalog.empty()


# ---- strips -------------------------------------------------------------

def _daily(spark, base) -> DataFrame:
    """Events per user and day, zero days included: one strip per user from the first day of all events to the last, row 0 being the first."""
    e = table(spark, base, "events").select(F.col("user_id").alias("clip_id"), event_day(F.col("ts")).alias("day"))
    counts = e.groupBy("clip_id", "day").agg(F.count(F.lit(1)).cast("double").alias("c"))
    span = e.agg(F.min("day").alias("first"), F.max("day").alias("last"))
    clips = e.select("clip_id").distinct().crossJoin(F.broadcast(span)).select("clip_id", "first", F.explode(F.sequence("first", "last")).alias("day"))
    return clips.join(counts, ["clip_id", "day"], "left").select(
        "clip_id", (F.col("day") - F.col("first")).alias("row"), F.coalesce("c", F.lit(0.0)).alias("profile"))


DAILY = """
d AS (SELECT user_id AS clip_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS "row", count(*)::DOUBLE AS c FROM events GROUP BY 1, 2),
g AS (SELECT clip_id, i AS "row" FROM (SELECT DISTINCT user_id AS clip_id FROM events) u, range(0, 30) r(i)),
daily AS (SELECT g.clip_id, g."row", coalesce(d.c, 0) AS profile FROM g LEFT JOIN d ON d.clip_id = g.clip_id AND d."row" = g."row"),
fit AS (SELECT clip_id, regr_slope(profile, "row") AS slope, regr_intercept(profile, "row") AS intercept FROM daily GROUP BY clip_id),
sig AS (SELECT d.clip_id, d."row", profile - (slope * d."row" + intercept) AS signal FROM daily d JOIN fit USING (clip_id))"""


@catalog.add("row_profile", f"""
WITH {OBS} SELECT clip_id, frame AS "row", round(median(x), 9) AS profile FROM obs GROUP BY clip_id, frame
""")
def row_profile(spark, base) -> DataFrame:
    px = observations(spark, base).select("clip_id", F.col("frame").alias("row"), F.col("trans").getItem(0).alias("v"))
    return profiles.row_profile(px, ["clip_id"]).withColumn("profile", F.round("profile", 9))


@catalog.add("profile_detrend", f"""
WITH {DAILY} SELECT clip_id, count(*) AS samples, round(quantile_cont(signal, 0.95) - quantile_cont(signal, 0.05), 8) AS contrast FROM sig GROUP BY clip_id
""")
def profile_detrend(spark, base) -> DataFrame:
    return profiles.contrast(profiles.detrend(_daily(spark, base), ["clip_id"]), ["clip_id"]).withColumn("contrast", F.round("contrast", 8))


@catalog.add("periodogram_peak", f"""
WITH {DAILY},
w AS (SELECT clip_id, f, sum(signal * (0.5 - 0.5 * cos(2*pi()*"row"/29.0)) * cos(2*pi()*f*"row"/30.0)) AS re,
        sum(signal * (0.5 - 0.5 * cos(2*pi()*"row"/29.0)) * sin(2*pi()*f*"row"/30.0)) AS im FROM sig, range(1, 16) r(f) GROUP BY clip_id, f),
p AS (SELECT clip_id, f, re*re + im*im AS power FROM w),
n AS (SELECT *, lag(power) OVER o AS l, lead(power) OVER o AS r, sum(power) OVER (PARTITION BY clip_id) AS total,
        row_number() OVER (PARTITION BY clip_id ORDER BY power DESC, f) AS rn FROM p WINDOW o AS (PARTITION BY clip_id ORDER BY f)),
k AS (SELECT *, ln(greatest(l, 1e-30)) AS a, ln(greatest(power, 1e-30)) AS b, ln(greatest(r, 1e-30)) AS c FROM n WHERE rn = 1 AND total > 1e-15)
SELECT clip_id, CAST(f AS INTEGER) AS peak, round((coalesce(l, 0) + power + coalesce(r, 0)) / total, 7) AS concentration,
  round(30.0 / (f + CASE WHEN f > 1 AND r IS NOT NULL AND abs(a - 2*b + c) > 1e-12 THEN least(greatest(0.5 * (a - c) / (a - 2*b + c), -0.5), 0.5) ELSE 0 END), 6) AS period FROM k
""")
def periodogram_peak(spark, base) -> DataFrame:
    s = profiles.detrend(_daily(spark, base), ["clip_id"])
    p = profiles.spectral_peak(profiles.periodogram(s, ["clip_id"], "row", F.col("samples")), ["clip_id"])
    return p.select("clip_id", "peak", F.round("concentration", 7).alias("concentration"), F.round("period", 6).alias("period"))


@catalog.add("lag_correlation", f"""
WITH {DAILY} SELECT a.clip_id, round(corr(a.signal, b.signal), 7) AS lag_correlation FROM sig a JOIN sig b ON a.clip_id = b.clip_id AND b."row" = a."row" + 7 GROUP BY a.clip_id
""")
def lag_correlation(spark, base) -> DataFrame:
    s = profiles.detrend(_daily(spark, base), ["clip_id"])
    return profiles.lag_correlation(s, ["clip_id"], "row", F.lit(7)).withColumn("lag_correlation", F.round("lag_correlation", 7))


# ---- jobs and metadata --------------------------------------------------

@catalog.add("job_latest", f"""
WITH e AS (SELECT user_id AS job_id, {EVENT_MS} * 1000000 + event_id % 1000000 AS pos, event_type AS stage, value FROM events)
SELECT job_id, arg_max(stage, pos) AS stage, max(pos) AS latest, count(*) AS events,
  CASE WHEN bool_or(stage = 'error' AND value > 150) THEN 'cancelled' WHEN bool_or(stage = 'error' AND value > 100) THEN 'failed'
       WHEN bool_or(stage = 'purchase') THEN 'succeeded' ELSE 'running' END AS status FROM e GROUP BY job_id
""")
def job_latest(spark, base) -> DataFrame:
    """Events as a job log: strong errors cancel, weaker ones fail, purchases succeed."""
    e = table(spark, base, "events").select(F.col("user_id").alias("job_id"), "event_type", "value", (
        event_ms(F.col("ts")) * 1000000 + F.col("event_id") % 1000000).alias("at"))
    error = F.col("event_type") == "error"
    status = (F.when(error & (F.col("value") > 150), "cancelled").when(error & (F.col("value") > 100), "failed")
              .when(F.col("event_type") == "purchase", "succeeded"))
    return jobs.latest_state(e, ["job_id"], F.col("at"), F.col("event_type"), status)


@catalog.add("stage_duration", f"""
WITH e AS (SELECT user_id AS job_id, {EVENT_MS} AS ms, event_id, event_type FROM events)
SELECT job_id, event_id, event_type, lead(ms) OVER (PARTITION BY job_id ORDER BY ms, event_id) - ms AS duration FROM e
""")
def stage_duration(spark, base) -> DataFrame:
    e = table(spark, base, "events").select(F.col("user_id").alias("job_id"), event_ms(F.col("ts")).alias("ms"), "event_id", "event_type")
    return jobs.stage_durations(e, ["job_id"], ["ms", "event_id"], "event_type", 86400000).select("job_id", "event_id", "event_type", "duration")


@catalog.add("run_progress", f"""
WITH {OBS}, p AS (SELECT clip_id, max(frame) + 1 AS done FROM obs WHERE kind = 'purchase' GROUP BY clip_id), t AS (SELECT clip_id, count(DISTINCT frame) AS frames_total FROM obs GROUP BY clip_id)
SELECT clip_id, frames_total, coalesce(done, 0) AS frames_completed, round(least(coalesce(done, 0) / frames_total::DOUBLE, 1.0), 9) AS fraction FROM t LEFT JOIN p USING (clip_id)
""")
def run_progress(spark, base) -> DataFrame:
    o = observations(spark, base)
    totals = o.select("clip_id", "frame").distinct().groupBy("clip_id").agg(F.count(F.lit(1)).alias("frames_total"))
    return jobs.progress(o.filter("kind = 'purchase'"), totals).withColumn("fraction", F.round("fraction", 9))


METADATA_KEY = """CASE WHEN regexp_matches(url, '[?]page') THEN 'com.example.camera.Focal-Length 35mm' WHEN url LIKE 'https%' THEN 'Sensor_Width' WHEN url LIKE '%#top' THEN 'x.camera.intrinsic.matrix'
       WHEN url LIKE '%fr%' THEN 'lens focal' ELSE url END"""


def _metadata(spark, base) -> DataFrame:
    u = F.col("url")
    key = (F.when(u.rlike("[?]page"), "com.example.camera.Focal-Length 35mm").when(u.like("https%"), "Sensor_Width")
           .when(u.like("%#top"), "x.camera.intrinsic.matrix").when(u.like("%fr%"), "lens focal").otherwise(u))
    return table(spark, base, "pages").select("page_id", F.regexp_extract("url", "//([^/]*)/", 1).alias("host"), key.alias("key"),
                                              F.length("html").alias("size"))


CATEGORY = """CASE WHEN n LIKE '%focal%' AND regexp_matches(n, '35mm|35milli|35film') THEN 'focal_length_35mm_equivalent'
  WHEN n LIKE '%focal%' THEN 'focal_length_or_focal_metadata' WHEN n LIKE '%sensor%' AND regexp_matches(n, 'width|height|size|dimension|crop') THEN 'sensor_geometry'
  WHEN regexp_matches(n, 'intrinsic|cameramatrix|principalpoint|lensdistortion') THEN 'camera_geometry' END"""
META = f"""
m AS (SELECT page_id, regexp_extract(url, '//([^/]*)/', 1) AS host, {METADATA_KEY} AS key, length(html) AS size FROM pages),
k AS (SELECT *, regexp_replace(lower(key), '[^a-z0-9]', '', 'g') AS n FROM m)"""


@catalog.add("metadata_categories", f"WITH {META} SELECT page_id, key, {CATEGORY} AS category FROM k")
def metadata_categories(spark, base) -> DataFrame:
    return _metadata(spark, base).select("page_id", "key", camera_category(F.col("key")).alias("category"))


@catalog.add("category_status", f"""
WITH {META} SELECT host, count(*) AS records, count({CATEGORY}) AS camera_fields,
  CASE WHEN count({CATEGORY}) > 0 THEN 'fields_present_insufficient' ELSE 'fields_absent' END AS status FROM k GROUP BY host
""")
def category_status(spark, base) -> DataFrame:
    return jobs.category_status(_metadata(spark, base), ["host"])


@catalog.add("declared_without_value", f"""
WITH {META}, d AS (SELECT *, {CATEGORY} AS category FROM k), big AS (SELECT DISTINCT host, key FROM k WHERE size > 6000)
SELECT host, key, category FROM d WHERE category IS NOT NULL AND NOT EXISTS (SELECT 1 FROM big b WHERE b.host = d.host AND b.key = d.key)
""")
def declared_without_value(spark, base) -> DataFrame:
    m = _metadata(spark, base)
    out = jobs.declared_without_value(m, m.filter("size > 6000"), ["host", "key"])
    return out.select("host", "key", "category")


# ---- single-row expressions ---------------------------------------------

def _lines(spark, base) -> DataFrame:
    return table(spark, base, "lineitem")


KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@catalog.add("projection", f"""
WITH p AS (SELECT {K}, l_linenumber / 10.0 AS x, l_discount - 0.05 AS y, l_quantity / 10 AS z FROM lineitem),
n AS (SELECT *, x / z AS u, y / z AS v, (x / z) * (x / z) + (y / z) * (y / z) AS r2 FROM p),
d AS (SELECT *, 1 + r2 * (0.1 + r2 * (-0.02 + r2 * 0.003)) AS rad FROM n)
SELECT {K}, round(600 * (u * rad + 2 * 0.001 * u * v + 0.0005 * (r2 + 2 * u * u)) + 320, 6) AS px,
       round(610 * (v * rad + 0.001 * (r2 + 2 * v * v) + 2 * 0.0005 * u * v) + 240, 6) AS py FROM d
""")
def projection(spark, base) -> DataFrame:
    p = F.array(F.col("l_linenumber") / 10.0, F.col("l_discount") - 0.05, F.col("l_quantity") / 10)
    k = F.array(*[F.lit(v) for v in (600.0, 610.0, 320.0, 240.0)])
    d = F.array(*[F.lit(v) for v in (0.1, -0.02, 0.001, 0.0005, 0.003)])
    r = _lines(spark, base).select(*KEYS, camera.project(p, k, d).alias("q"))
    return r.select(*KEYS, F.round(F.col("q").getItem(0), 6).alias("px"), F.round(F.col("q").getItem(1), 6).alias("py"))


@catalog.add("crop_affine", f"""
WITH c AS (SELECT {K}, l_quantity / 20 AS s, l_discount AS tx, l_tax - 0.04 AS ty, CASE WHEN l_returnflag = 'A' THEN -l_discount ELSE l_discount END AS sx,
  100.0 + l_linenumber AS bx, 200.0 + l_suppkey AS by_, 330.0 * (l_quantity / 20) AS span FROM lineitem)
SELECT {K}, round(0.1 + 2 * (bx - 640) / span + sx, 8) AS cx, round(0.2 + 2 * (by_ - 360) / span + ty, 8) AS cy, 0.3 AS cz, round(2 / span, 9) AS slope,
  round(2 * (bx - 600) / (span + 1e-9) + sx, 8) AS fx, round(2 * 900 / (span + 1e-9), 8) AS fz FROM c
""")
def crop_affine(spark, base) -> DataFrame:
    """Crop boxes 220 x 180 around a moving centre; display form and full-frame translation."""
    weak = F.array(F.col("l_quantity") / 20, F.col("l_discount"), F.col("l_tax") - 0.04)
    side = F.when(F.col("l_returnflag") == "A", "left").otherwise("right")
    cx, cy = 100.0 + F.col("l_linenumber"), 200.0 + F.col("l_suppkey")
    box = F.array(cx - 110, cy - 90, cx + 110, cy + 90)
    a = camera.crop_affine(weak, side, box, F.lit(330.0), F.array(F.lit(0.1), F.lit(0.2), F.lit(0.3)), F.lit(1280.0), F.lit(720.0))
    t = camera.crop_translation(weak, side, box, F.lit(330.0), F.array(*[F.lit(v) for v in (900.0, 900.0, 600.0, 350.0)]))
    r = _lines(spark, base).select(*KEYS, a.alias("a"), t.alias("t"))
    c = F.col("a.constant")
    return r.select(*KEYS, F.round(c.getItem(0), 8).alias("cx"), F.round(c.getItem(1), 8).alias("cy"), c.getItem(2).alias("cz"),
                    F.round("a.slope_z", 9).alias("slope"), F.round(F.col("t").getItem(0), 8).alias("fx"), F.round(F.col("t").getItem(2), 8).alias("fz"))


@catalog.add("homography_errors", f"""
WITH h AS (SELECT {K}, l_quantity AS x, l_linenumber * 1.0 AS y, l_quantity + 1 AS tx, l_linenumber * 1.0 AS ty, 0.001 * l_quantity - 0.002 * l_linenumber + 1 AS w FROM lineitem)
SELECT {K}, round(sqrt(((1.1 * x + 0.1 * y + 2) / w - tx) * ((1.1 * x + 0.1 * y + 2) / w - tx) + ((0.9 * y - 0.05 * x) / w - ty) * ((0.9 * y - 0.05 * x) / w - ty)), 8) AS error FROM h
""")
def homography_errors(spark, base) -> DataFrame:
    h = F.array(*[F.lit(v) for v in (1.1, 0.1, 2.0, -0.05, 0.9, 0.0, 0.001, -0.002, 1.0)])
    src = F.array(F.col("l_quantity"), F.col("l_linenumber").cast("double"))
    dst = F.array(F.col("l_quantity") + 1, F.col("l_linenumber").cast("double"))
    return _lines(spark, base).select(*KEYS, F.round(camera.homography_error(h, src, dst), 8).alias("error"))


@catalog.add("layer_counts", f"""
WITH s AS (SELECT {K}, l_quantity AS span, CASE WHEN l_returnflag <> 'R' THEN l_tax + 0.01 END AS mm, 0.3 AS layer, l_linenumber * 1.0 AS u FROM lineitem)
SELECT {K}, round(span * mm / layer, 8) AS count, round(greatest(span - 2 * u, 0) * mm / layer, 8) AS low, round((span + 2 * u) * mm / layer, 8) AS high FROM s
""")
def layer_counts(spark, base) -> DataFrame:
    mm = F.when(F.col("l_returnflag") != "R", F.col("l_tax") + 0.01)
    c = scoring.layer_count(F.col("l_quantity"), mm, F.lit(0.3), F.col("l_linenumber") * 1.0)
    return _lines(spark, base).select(*KEYS, c.alias("c")).select(*KEYS, *[F.round(f"c.{n}", 8).alias(n) for n in ("count", "low", "high")])


@catalog.add("ray_plane_lengths", f"""
WITH r AS (SELECT {K}, l_discount AS ax, l_tax AS ay, -l_tax AS bx, l_discount AS by_, 0.1 * l_linenumber AS nx, 0.05 AS ny, 1.0 AS nz, l_quantity / 10 AS d FROM lineitem),
t AS (SELECT *, nz * d / (ax*nx + ay*ny + nz) AS ta, nz * d / (bx*nx + by_*ny + nz) AS tb FROM r)
SELECT {K}, round(sqrt((ax*ta-bx*tb)*(ax*ta-bx*tb) + (ay*ta-by_*tb)*(ay*ta-by_*tb) + (ta-tb)*(ta-tb)), 8) AS length,
  round(abs(sqrt((ax*ta-bx*tb)*(ax*ta-bx*tb) + (ay*ta-by_*tb)*(ay*ta-by_*tb) + (ta-tb)*(ta-tb)) - 0.5) / 0.5, 8) AS relative_error FROM t
""")
def ray_plane_lengths(spark, base) -> DataFrame:
    a = F.array(F.col("l_discount"), F.col("l_tax"), F.lit(1.0))
    b = F.array(-F.col("l_tax"), F.col("l_discount"), F.lit(1.0))
    n = F.array(0.1 * F.col("l_linenumber"), F.lit(0.05), F.lit(1.0))
    p = F.array(F.lit(0.0), F.lit(0.0), F.col("l_quantity") / 10)
    length = camera.ray_plane_length(a, b, n, p)
    r = _lines(spark, base).select(*KEYS, length.alias("m"))
    return r.select(*KEYS, F.round("m", 8).alias("length"), F.round(camera.relative_error(F.col("m"), F.lit(0.5)), 8).alias("relative_error"))


@catalog.add("scale_fits", f"""
WITH p AS (SELECT {K}, l_quantity AS a, l_linenumber * 1.0 AS b, 3.0 AS c, l_quantity * 0.02 + l_discount AS x, l_linenumber * 0.02 AS y, 0.06 + l_tax AS z FROM lineitem),
r AS (SELECT *, (a*x + b*y + c*z) / (a*a + b*b + c*c) AS ratio FROM p)
SELECT {K}, round(ratio, 9) AS ratio, round(sqrt((ratio*a-x)*(ratio*a-x) + (ratio*b-y)*(ratio*b-y) + (ratio*c-z)*(ratio*c-z)) / greatest(sqrt(x*x+y*y+z*z), 1e-12), 9) AS residual FROM r
""")
def scale_fits(spark, base) -> DataFrame:
    s = F.array(F.col("l_quantity"), F.col("l_linenumber").cast("double"), F.lit(3.0))
    m = F.array(F.col("l_quantity") * 0.02 + F.col("l_discount"), F.col("l_linenumber") * 0.02, 0.06 + F.col("l_tax"))
    return _lines(spark, base).select(*KEYS, F.round(camera.scale_of_point(s, m), 9).alias("ratio"), F.round(camera.scale_residual(s, m), 9).alias("residual"))


@catalog.add("segment_costs", """
WITH s AS (SELECT l_orderkey, l_tax AS w, l_quantity * 0.2 + l_discount * 10 AS ra, l_linenumber * 1.0 - 3 AS rb FROM lineitem),
h AS (SELECT l_orderkey, w * (CASE WHEN abs(ra) <= 3 THEN 0.5*ra*ra ELSE 3*(abs(ra)-1.5) END + CASE WHEN abs(rb) <= 3 THEN 0.5*rb*rb ELSE 3*(abs(rb)-1.5) END) AS c FROM s)
SELECT l_orderkey, round(sum(c), 7) AS cost FROM h GROUP BY l_orderkey
""")
def segment_costs(spark, base) -> DataFrame:
    """Segments against the horizontal edge y = 0, so residuals are the end heights."""
    li = _lines(spark, base)
    s = li.select("l_orderkey", F.col("l_tax").alias("weight"), F.array(F.lit(2.0), F.col("l_quantity") * 0.2 + F.col("l_discount") * 10).alias("a"),
                  F.array(F.lit(8.0), F.col("l_linenumber") * 1.0 - 3).alias("b"), F.array(F.lit(0.0), F.lit(0.0)).alias("start"),
                  F.array(F.lit(10.0), F.lit(0.0)).alias("end"))
    return candidates.segment_cost(s, ["l_orderkey"]).withColumn("cost", F.round("cost", 7))


@catalog.add("run_warnings", """
WITH o AS (SELECT o_orderkey, o_totalprice / 2000 AS fps, o_custkey % 2000 AS height, o_orderstatus = 'F' AS calibrated, o_custkey AS frames FROM orders)
SELECT o_orderkey, concat_ws(',', CASE WHEN fps < 120 THEN 'below_120_fps' END, CASE WHEN height < 1080 THEN 'below_1080p' END, CASE WHEN NOT calibrated THEN 'missing_calibration' END) AS warnings,
       frames / fps >= 3 AS at_least_3_seconds FROM o
""")
def run_warnings(spark, base) -> DataFrame:
    fps, height = F.col("o_totalprice") / 2000, F.col("o_custkey") % 2000
    w = scoring.run_warnings(fps, height, F.col("o_orderstatus") == "F")
    m = scoring.milestone_flags(F.col("o_custkey"), fps, F.lit(True))
    return table(spark, base, "orders").select("o_orderkey", F.concat_ws(",", w).alias("warnings"), m.getField("at_least_3_seconds").alias("at_least_3_seconds"))


@catalog.add("presentation_rotation", """
WITH m AS (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 65536 WHEN 1 THEN 0 WHEN 2 THEN -65536 WHEN 3 THEN 0 ELSE 65536 END AS a,
  CASE p_size % 5 WHEN 1 THEN 65536 WHEN 3 THEN -65536 ELSE 0 END AS b, p_size * 1000 AS ticks FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 AND b = 0 THEN NULL ELSE degrees(atan2(b::DOUBLE, a::DOUBLE)) END AS rotation,
  round(CASE WHEN ticks <> 30000 THEN ticks / 600.0 END, 8) AS seconds, round(sqrt((500.0 + p_partkey) * 520.0), 8) AS focal FROM m
JOIN part USING (p_partkey)
""")
def presentation_rotation(spark, base) -> DataFrame:
    """Track matrices (a b 0 / -b a 0 / 0 0 1), sheared for some parts; clock ticks; rectified focal."""
    s = F.col("p_size") % 5
    a = F.when(s == 0, 65536).when(s == 2, -65536).when(s == 4, 65536).otherwise(0).cast("long")
    b = F.when(s == 1, 65536).when(s == 3, -65536).otherwise(0).cast("long")
    shear = F.when((F.col("p_partkey") % 9 == 0) & (b == 0), 1).otherwise(0).cast("long")
    zero, one = F.lit(0).cast("long"), F.lit(1 << 30).cast("long")
    rot = scoring.presentation_rotation(a, b, zero, -b + shear, a, zero, one)
    return table(spark, base, "part").select("p_partkey", rot.alias("rotation"),
                                             F.round(scoring.ticks_to_seconds(F.col("p_size") * 1000, F.lit(600), 30000), 8).alias("seconds"),
                                             F.round(camera.rectified_focal(500.0 + F.col("p_partkey"), F.lit(520.0)), 8).alias("focal"))


@catalog.add("crop_residuals", f"""
WITH {OBS} SELECT clip_id, count(*) AS n, round(avg(sqrt((x-y)*(x-y) + z*z) * 256 / 330), 7) AS mean, round(sqrt(avg(((x-y)*(x-y) + z*z) * (256/330.0) * (256/330.0))), 7) AS rms FROM obs GROUP BY clip_id
""")
def crop_residuals(spark, base) -> DataFrame:
    t = F.col("trans")
    r = scoring.crop_residual(F.array(t.getItem(0), t.getItem(2)), F.array(t.getItem(1), F.lit(0.0)), F.lit(256.0), F.lit(330.0))
    o = observations(spark, base).select("clip_id", r.alias("r"))
    return o.groupBy("clip_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 7).alias("mean"), F.round(F.sqrt(F.avg(F.col("r") ** 2)), 7).alias("rms"))


@catalog.add("frame_captions", f"""
WITH {OBS} SELECT clip_id, det_idx, printf('frame %06d | %.3f s | %s', frame, frame / 4.0, kind) AS caption FROM obs
""")
def frame_captions(spark, base) -> DataFrame:
    return observations(spark, base).select("clip_id", "det_idx", frame_caption(F.col("frame"), F.col("frame") / 4.0, F.col("kind")).alias("caption"))
