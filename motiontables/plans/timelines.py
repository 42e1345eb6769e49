"""Timelines: review ranges, summaries, alignment, selection, filling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.camera import source_frame, timestamp_ms
from ..functions.rotation import quat_to_axis_angle
from ..functions.text import range_text
from ..functions.vectors import let, norm
from ..operators import fill, ranges, selection, timeline
from ..sources.warehouse import event_ms, frame_count, observations, table
from .base import EVENT_MS, FRAME_COUNT, GROUPS, OBS, Catalog

catalog = Catalog.empty()
LOW_SCORE = 0.1


def _hands(spark, base) -> DataFrame:
    """Detections in the shape the summary expects; errors count as blurred views."""
    o = observations(spark, base)
    return o.select("clip_id", "frame", "side", "score", F.lit(True).alias("available"),
                    (F.col("trans").getItem(2) > 90).alias("outside"),
                    (F.col("kind") == "purchase").alias("has_parameters"),
                    F.col("ambiguous").alias("blur_flag"))


VIEW_FRAMES = OBS + f""",
vf AS (
  SELECT clip_id, frame, count(*) AS hands,
         count(*) FILTER (WHERE side = 'left') AS left_hands,
         count(*) FILTER (WHERE side = 'right') AS right_hands,
         sum(score) AS score_sum,
         bool_or(score < {LOW_SCORE} OR z > 90) AS weak, bool_or(kind = 'purchase') AS params,
         bool_or(ambiguous) AS blur
  FROM obs GROUP BY clip_id, frame),
flags AS (
  SELECT *, (CASE WHEN left_hands > 0 THEN 1 ELSE 0 END + CASE WHEN right_hands > 0 THEN 1 ELSE 0 END) < hands
              AS ambiguous FROM vf),
frames AS (SELECT *, hands < 2 OR weak OR ambiguous AS review FROM flags)"""


@catalog.add("review_ranges", f"""
WITH {VIEW_FRAMES},
tagged AS (
  SELECT clip_id, frame, 'review' AS reason FROM frames WHERE review
  UNION ALL SELECT clip_id, frame, 'ambiguous' FROM frames WHERE ambiguous
  UNION ALL SELECT clip_id, frame, 'blur' FROM frames WHERE blur),
numbered AS (
  SELECT *, frame - row_number() OVER (PARTITION BY clip_id, reason ORDER BY frame) AS island FROM tagged)
SELECT clip_id, reason, min(frame) AS "start", max(frame) AS "end",
       CASE WHEN min(frame) = max(frame) THEN CAST(min(frame) AS VARCHAR)
            ELSE CAST(min(frame) AS VARCHAR) || '–' || CAST(max(frame) AS VARCHAR) END AS label
FROM numbered GROUP BY clip_id, reason, island
""")
def review_ranges(spark, base) -> DataFrame:
    frames = timeline.view_frames(_hands(spark, base), ["clip_id"], LOW_SCORE)
    runs = timeline.review_ranges(frames, ["clip_id"])
    return runs.select("clip_id", "reason", "start", "end",
                       range_text(F.col("start"), F.col("end")).alias("label"))


@catalog.add("view_summary", f"""
WITH {VIEW_FRAMES}
SELECT clip_id, count(*) AS timeline_frames, count(*) AS available_frames, count(*) AS valid_frames,
       1.0 AS valid_frame_rate,
       count(*) FILTER (WHERE left_hands > 0 AND right_hands > 0) AS both_sides_frames,
       count(*) FILTER (WHERE hands = 2) AS two_observation_frames,
       CAST(sum(hands) AS BIGINT) AS hand_observations,
       round(sum(score_sum) / sum(hands), 10) AS mean_score,
       CAST(sum(left_hands) AS BIGINT) AS left_observations,
       CAST(sum(right_hands) AS BIGINT) AS right_observations,
       count(*) FILTER (WHERE left_hands > 0) AS left_frames,
       count(*) FILTER (WHERE right_hands > 0) AS right_frames,
       count(*) FILTER (WHERE params) AS parameter_frames
FROM frames GROUP BY clip_id
""")
def view_summary(spark, base) -> DataFrame:
    frames = timeline.view_frames(_hands(spark, base), ["clip_id"], LOW_SCORE)
    return timeline.view_summary(frames, ["clip_id"]).withColumn("mean_score", F.round("mean_score", 10))


@catalog.add("run_rejections", f"""
WITH {VIEW_FRAMES}
SELECT clip_id, round(avg(CASE WHEN blur THEN 1.0 ELSE 0.0 END), 6) AS blur_share, count(*) AS valid_frames,
       CASE WHEN avg(CASE WHEN blur THEN 1.0 ELSE 0.0 END) > 0.35 THEN 'blurred_majority' END AS rejection
FROM frames GROUP BY clip_id
""")
def run_rejections(spark, base) -> DataFrame:
    frames = timeline.view_frames(_hands(spark, base), ["clip_id"], LOW_SCORE)
    return timeline.run_rejections(frames, ["clip_id"], max_blur_share=0.35).withColumn(
        "blur_share", F.round("blur_share", 6))


@catalog.add("align_nearest_frame", f"""
WITH t AS (SELECT user_id AS clip_id, event_id, {EVENT_MS} AS ms FROM events)
SELECT clip_id, event_id,
       CAST(round_even(ms / 30000.0 * 1000, 0) AS BIGINT) AS timestamp_ms,
       CAST(floor((ms / 1000.0 - 7.25) * 0.03 + 0.5) AS BIGINT) AS source_frame,
       floor((ms / 1000.0 - 7.25) * 0.03 + 0.5) BETWEEN 0 AND 60000 AS available
FROM t
""")
def align_nearest_frame(spark, base) -> DataFrame:
    """Frame arithmetic on every event: 0.03 frames per second, 7.25 s offset."""
    e = table(spark, base, "events").select(F.col("user_id").alias("clip_id"), "event_id",
                                            event_ms(F.col("ts")).alias("ms"))
    target = source_frame(F.col("ms") / 1000.0, 0.03, -7.25)
    return e.select("clip_id", "event_id", timestamp_ms(F.col("ms"), 30000.0).alias("timestamp_ms"),
                    target.alias("source_frame"), target.between(0, 60000).alias("available"))


@catalog.add("align_two_views", f"""
WITH {OBS},
primary_view AS (SELECT DISTINCT clip_id, frame FROM obs),
other AS (SELECT clip_id, frame AS source_frame, count(*) AS hands FROM obs
          WHERE kind <> 'error' GROUP BY clip_id, frame),
target AS (SELECT clip_id, frame, CAST(floor((frame / 4.0 + 0.375) * 2.0 + 0.5) AS BIGINT) AS source_frame
           FROM primary_view)
SELECT t.clip_id, t.frame, t.source_frame, o.hands,
       t.source_frame BETWEEN 0 AND {FRAME_COUNT} // 2 - 1 AND o.hands IS NOT NULL AS available
FROM target t LEFT JOIN other o USING (clip_id, source_frame)
""")
def align_two_views(spark, base) -> DataFrame:
    """Four timeline frames per day against a second view with two frames per day."""
    o = observations(spark, base)
    clock = o.select("clip_id", "frame").distinct().withColumn("time_seconds", F.col("frame") / 4.0)
    second = (o.filter(F.col("kind") != "error").groupBy("clip_id", F.col("frame").alias("source_frame"))
              .agg(F.count(F.lit(1)).alias("hands")).withColumn("view_id", F.lit("side")))
    views = o.select("clip_id").distinct().select(
        "clip_id", F.lit("side").alias("view_id"), F.lit(2.0).alias("fps"),
        F.lit(0.375).alias("offset_seconds"), F.lit(frame_count(spark, base) // 2).alias("frame_count"))
    return timeline.align_views(clock, views, second).select(
        "clip_id", "frame", "source_frame", "hands", "available")


@catalog.add("reused_frames", f"""
WITH {OBS}, f AS (SELECT DISTINCT clip_id, frame FROM obs),
m AS (SELECT clip_id, frame, CAST(floor(frame * 0.5 + 0.5) AS BIGINT) AS source_frame FROM f)
SELECT clip_id, frame, source_frame,
       coalesce(source_frame = lag(source_frame) OVER (PARTITION BY clip_id ORDER BY frame), false)
         AS reused_source_frame
FROM m
""")
def reused_frames(spark, base) -> DataFrame:
    f = observations(spark, base).select("clip_id", "frame").distinct()
    mapped = f.withColumn("source_frame", source_frame(F.col("frame").cast("double"), 0.5, 0.0))
    return timeline.reused_source_frames(mapped, ["clip_id"], 32)


@catalog.add("timeline_checks", f"""
WITH e AS (SELECT user_id AS clip_id, event_id AS frame, {EVENT_MS} AS ms FROM events),
s AS (SELECT *, frame - lag(frame) OVER w AS step, ms - lag(ms) OVER w AS dt FROM e
      WINDOW w AS (PARTITION BY clip_id ORDER BY frame, ms))
SELECT clip_id, count(*) AS rows, min(frame) AS first_frame, max(frame) AS last_frame,
       count(*) FILTER (WHERE step > 1) AS gaps, count(*) FILTER (WHERE step = 0) AS repeats,
       count(*) FILTER (WHERE dt <= 0) AS not_increasing,
       min(frame) = 0 AND max(frame) = count(*) - 1 AND count(*) FILTER (WHERE step > 1) = 0
         AND count(*) FILTER (WHERE step = 0) = 0 AS complete
FROM s GROUP BY clip_id
""")
def timeline_checks(spark, base) -> DataFrame:
    e = table(spark, base, "events").select(F.col("user_id").alias("clip_id"), F.col("event_id").alias("frame"),
                                            event_ms(F.col("ts")).alias("ms"))
    return timeline.sequence_check(e, ["clip_id"], "frame", "ms", width=1 << 14)


@catalog.add("late_arrivals", f"""
WITH e AS (SELECT user_id AS clip_id, event_id AS seq, ({EVENT_MS}) // 60000 % 4096 AS ms FROM events),
s AS (SELECT *, max(ms) OVER (PARTITION BY clip_id ORDER BY seq
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM e)
SELECT clip_id, seq, ms FROM s WHERE ms <= seen
""")
def late_arrivals(spark, base) -> DataFrame:
    e = table(spark, base, "events").select(
        F.col("user_id").alias("clip_id"), F.col("event_id").alias("seq"),
        (F.floor(event_ms(F.col("ts")) / 60000) % 4096).alias("ms"))
    return timeline.late_rows(e, ["clip_id"], ["seq"], "ms", width=1 << 14)


@catalog.add("sampled_frames", f"""
WITH {OBS}, n AS (SELECT clip_id, max(frame) + 1 AS frame_count FROM obs GROUP BY clip_id),
picks AS (SELECT DISTINCT clip_id, CAST(round_even(i * (frame_count - 1) /
            greatest(least(12, frame_count) - 1, 1)::DOUBLE, 0) AS BIGINT) AS frame
          FROM n, range(0, 12) r(i) WHERE i < least(12, frame_count))
SELECT o.clip_id, o.frame, o.det_idx FROM obs o JOIN picks USING (clip_id, frame)
""")
def sampled_frames(spark, base) -> DataFrame:
    o = observations(spark, base)
    clips = o.groupBy("clip_id").agg((F.max("frame") + 1).alias("frame_count"))
    return timeline.sampled_rows(o, clips).select("clip_id", "frame", "det_idx")


@catalog.add("first_frames", f"""
WITH {OBS} SELECT clip_id, frame, count(*) AS observations FROM obs WHERE frame < 16 GROUP BY clip_id, frame
""")
def first_frames(spark, base) -> DataFrame:
    return (timeline.first_frames(observations(spark, base), 16).groupBy("clip_id", "frame")
            .agg(F.count(F.lit(1)).alias("observations")))


@catalog.add("hopping_windows", f"""
WITH {OBS}, per_frame AS (SELECT clip_id, frame, count(*) AS n, sum(score) AS s FROM obs GROUP BY clip_id, frame),
starts AS (SELECT i * 5 AS s0 FROM range(0, 22) r(i) UNION SELECT 105)
SELECT clip_id, CAST(s0 AS BIGINT) AS window_start, CAST(sum(n) AS BIGINT) AS observations,
       count(*) AS frames, round(sum(s) / sum(n), 10) AS mean_score
FROM per_frame JOIN starts ON frame BETWEEN s0 AND s0 + 14 GROUP BY clip_id, s0
""")
def hopping_windows(spark, base) -> DataFrame:
    per = observations(spark, base).groupBy("clip_id", "frame").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("s"))
    return (timeline.hopping_windows(per, frame_count(spark, base)).groupBy("clip_id", "window_start").agg(
        F.sum("n").alias("observations"), F.count(F.lit(1)).alias("frames"),
        F.round(F.sum("s") / F.sum("n"), 10).alias("mean_score")))


@catalog.add("select_observations", f"""
WITH {GROUPS}
SELECT g.clip_id, g.frame, g.side, g.n, g.n_sure, g.outcome,
       CASE WHEN g.outcome = 'retained' THEN g.kept_id END AS det_idx,
       CASE WHEN g.outcome = 'retained' THEN k.score END AS score
FROM outcomes g LEFT JOIN kept k USING (clip_id, frame, side)
""")
def select_observations(spark, base) -> DataFrame:
    groups = selection.classify_groups(observations(spark, base), payload=["score"])
    return groups.select("clip_id", "frame", "side", "n", "n_sure", "outcome",
                         F.col("row.det_idx").alias("det_idx"), F.col("row.score").alias("score"))


@catalog.add("exclusions", f"""
WITH {GROUPS}
SELECT o.clip_id, o.frame, o.side, o.det_idx, 'unresolved_same_side_identity' AS reason
FROM obs o JOIN outcomes g USING (clip_id, frame, side)
WHERE g.n > 1 AND g.outcome <> 'conflict' AND o.ambiguous
""")
def exclusions(spark, base) -> DataFrame:
    return selection.exclusions(observations(spark, base))


@catalog.add("missing_sides", f"""
WITH {GROUPS}, c AS (SELECT DISTINCT clip_id, frame // 4 AS day FROM obs),
s AS (SELECT 'left' AS side UNION ALL SELECT 'right')
SELECT clip_id, CAST(day AS BIGINT) AS day, side FROM c, s
WHERE NOT EXISTS (SELECT 1 FROM kept k
                  WHERE k.clip_id = c.clip_id AND k.frame // 4 = c.day AND k.side = s.side)
""")
def missing_sides(spark, base) -> DataFrame:
    """Each day of a user is its own clip."""
    o = observations(spark, base).withColumn("day", F.floor(F.col("frame") / 4))
    return selection.missing_sides(o, ["clip_id", "day"])


# The dense SQL timeline: neighbours per (clip, side, frame) by windows over a full grid.
DENSE = GROUPS + f""",
sides AS (SELECT DISTINCT clip_id, side FROM kept),
grid AS (SELECT clip_id, side, f AS frame FROM sides, (SELECT unnest(range(0, {FRAME_COUNT})) AS f) r),
joined AS (
  SELECT g.clip_id, g.side, g.frame, k.frame AS seen, k.x, k.y, k.z, k.score, k.angle
  FROM grid g LEFT JOIN kept k USING (clip_id, side, frame)),
near AS (
  SELECT *,
    last_value(seen IGNORE NULLS) OVER b AS p, first_value(seen IGNORE NULLS) OVER a AS q,
    last_value(x IGNORE NULLS) OVER b AS px, first_value(x IGNORE NULLS) OVER a AS qx,
    last_value(y IGNORE NULLS) OVER b AS py, first_value(y IGNORE NULLS) OVER a AS qy,
    last_value(z IGNORE NULLS) OVER b AS pz, first_value(z IGNORE NULLS) OVER a AS qz,
    last_value(angle IGNORE NULLS) OVER b AS pa, first_value(angle IGNORE NULLS) OVER a AS qa
  FROM joined
  WINDOW b AS (PARTITION BY clip_id, side ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY clip_id, side ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (
  SELECT clip_id, side, frame, score,
    CASE WHEN seen IS NOT NULL THEN 'observed' WHEN p IS NULL OR q IS NULL THEN 'endpoint_hold'
         ELSE 'interpolated' END AS sample_kind,
    coalesce(p, q) AS source_left,
    CASE WHEN seen IS NULL AND p IS NOT NULL THEN q END AS source_right,
    CASE WHEN seen IS NULL AND p IS NOT NULL AND q IS NOT NULL
         THEN (frame - p) / (q - p)::DOUBLE END AS alpha,
    px, qx, py, qy, pz, qz, pa, qa
  FROM near),
dense AS (
  SELECT clip_id, side, frame, score, sample_kind, source_left, source_right, alpha,
    CASE WHEN alpha IS NULL THEN coalesce(px, qx) ELSE (1 - alpha) * px + alpha * qx END AS x,
    CASE WHEN alpha IS NULL THEN coalesce(py, qy) ELSE (1 - alpha) * py + alpha * qy END AS y,
    CASE WHEN alpha IS NULL THEN coalesce(pz, qz) ELSE (1 - alpha) * pz + alpha * qz END AS z,
    CASE WHEN alpha IS NULL THEN coalesce(pa, qa) ELSE (1 - alpha) * pa + alpha * qa END AS angle
  FROM filled)"""


def retained(spark, base) -> DataFrame:
    return selection.select_observations(observations(spark, base), payload=["score", "trans", "quat"])


def dense_positions(spark, base) -> DataFrame:
    return fill.fill_vectors(retained(spark, base), ["clip_id", "side"], ["trans"], frame_count(spark, base))


@catalog.add("fill_timeline", f"""
WITH {DENSE}
SELECT clip_id, side, frame, sample_kind, source_left, source_right, round(alpha, 9) AS alpha,
       round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM dense
""")
def fill_timeline(spark, base) -> DataFrame:
    d, t = dense_positions(spark, base), F.col("trans")
    return d.select("clip_id", "side", "frame", "sample_kind",
                    F.col("source_frames").getItem(0).alias("source_left"),
                    F.get("source_frames", F.lit(1)).alias("source_right"),
                    F.round("alpha", 9).alias("alpha"), F.round(t.getItem(0), 9).alias("x"),
                    F.round(t.getItem(1), 9).alias("y"), F.round(t.getItem(2), 9).alias("z"))


# Half angles with the signs of continuous quaternions: the first has w >= 0, each next lies within a quarter of a turn.
TURNED = DENSE.replace("sides AS (", """flips AS (
  SELECT *, CASE WHEN lag(angle) OVER w IS NULL THEN cos(angle / 2) < 0 ELSE cos((angle - lag(angle) OVER w) / 2) < 0 END AS flip
  FROM kept WINDOW w AS (PARTITION BY clip_id, side ORDER BY frame)),
turned AS (
  SELECT * REPLACE (CASE WHEN sum(CASE WHEN flip THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, side ORDER BY frame) % 2 = 1
                         THEN angle - 2 * pi() ELSE angle END AS angle) FROM flips),
sides AS (""", 1).replace("LEFT JOIN kept k", "LEFT JOIN turned k")


@catalog.add("fill_rotation", f"""
WITH {TURNED}, whole AS (
  SELECT f.*, coalesce(pa, qa) / 2 AS ha, coalesce(qa, pa) / 2 AS hq FROM filled f),
ends AS (SELECT *, hq - 2 * pi() * round((hq - ha) / (2 * pi())) AS hb FROM whole),
mix AS (
  SELECT *, CASE WHEN alpha IS NULL THEN sin(ha)
                 WHEN cos(ha - hb) > 0.9995 THEN (1 - alpha) * sin(ha) + alpha * sin(hb)
                 ELSE sin((1 - alpha) * ha + alpha * hb) END AS sz,
            CASE WHEN alpha IS NULL THEN cos(ha)
                 WHEN cos(ha - hb) > 0.9995 THEN (1 - alpha) * cos(ha) + alpha * cos(hb)
                 ELSE cos((1 - alpha) * ha + alpha * hb) END AS cz FROM ends)
SELECT clip_id, side, frame, sample_kind, round(sz / sqrt(sz * sz + cz * cz), 8) + 0.0 AS qz,
       round(cz / sqrt(sz * sz + cz * cz), 8) + 0.0 AS qw, round(2 * atan2(abs(sz), abs(cz)), 8) AS angle FROM mix
""")
def fill_rotation(spark, base) -> DataFrame:
    """All rotations turn about z, so SLERP interpolates the angle once signs are continuous, and near-parallel
    pairs blend linearly before renormalising; ``angle`` is that of the shorter turn."""
    d = fill.fill_rotations(retained(spark, base), ["clip_id", "side"], "quat", frame_count(spark, base))
    q = F.col("quat")
    return d.select("clip_id", "side", "frame", "sample_kind", (F.round(q.getItem(2), 8) + 0.0).alias("qz"),
                    (F.round(q.getItem(3), 8) + 0.0).alias("qw"),
                    F.round(let(quat_to_axis_angle(q), lambda v: norm(v)), 8).alias("angle"))


@catalog.add("quaternion_signs", f"""
WITH {GROUPS}, q AS (
  SELECT clip_id, side, frame, CASE WHEN det_idx % 2 = 0 THEN 1 ELSE -1 END * sin(angle / 2) AS qz,
         CASE WHEN det_idx % 2 = 0 THEN 1 ELSE -1 END * cos(angle / 2) AS qw FROM kept),
f AS (SELECT *, CASE WHEN lag(qw) OVER w IS NULL THEN qw < 0
                     ELSE qz * lag(qz) OVER w + qw * lag(qw) OVER w < 0 END AS flip FROM q
      WINDOW w AS (PARTITION BY clip_id, side ORDER BY frame)),
s AS (SELECT *, sum(CASE WHEN flip THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id, side ORDER BY frame) % 2 AS odd FROM f)
SELECT clip_id, side, frame, round(CASE WHEN odd = 1 THEN -qz ELSE qz END, 6) + 0.0 AS qz,
       round(CASE WHEN odd = 1 THEN -qw ELSE qw END, 6) + 0.0 AS qw FROM s
""")
def quaternion_signs(spark, base) -> DataFrame:
    sign = F.when(F.col("det_idx") % 2 == 0, 1.0).otherwise(-1.0)
    r = retained(spark, base).withColumn("quat", F.array(*[F.col("quat").getItem(i) * sign for i in range(4)]))
    s = fill.continuous_signs(r.select("clip_id", "side", "frame", "quat"), ["clip_id", "side"], "quat", width=32)
    return s.select("clip_id", "side", "frame", (F.round(F.col("quat").getItem(2), 6) + 0.0).alias("qz"),
                    (F.round(F.col("quat").getItem(3), 6) + 0.0).alias("qw"))


@catalog.add("quaternion_diagnostics", f"""
WITH {GROUPS}, d AS (
  SELECT clip_id, side, cos((angle - lag(angle) OVER (PARTITION BY clip_id, side ORDER BY frame)) / 2) AS dot FROM kept)
SELECT clip_id, side, true AS unit_ok, round(coalesce(min(dot), 1.0), 6) AS min_adjacent_dot
FROM d GROUP BY clip_id, side
""")
def quaternion_diagnostics(spark, base) -> DataFrame:
    d = fill.quaternion_diagnostics(retained(spark, base), ["clip_id", "side"], "quat")
    return d.select("clip_id", "side", (F.col("max_unit_error") < 1e-10).alias("unit_ok"),
                    F.round("min_adjacent_dot", 6).alias("min_adjacent_dot"))


@catalog.add("acceleration", f"""
WITH {GROUPS}, n AS (
  SELECT clip_id, side, frame, x, y, z, lag(frame) OVER w AS pf, lead(frame) OVER w AS nf,
    lag(x) OVER w - 2 * x + lead(x) OVER w AS ax, lag(y) OVER w - 2 * y + lead(y) OVER w AS ay,
    3 * (lag(z) OVER w - 2 * z + lead(z) OVER w) AS az
  FROM kept WINDOW w AS (PARTITION BY clip_id, side ORDER BY frame))
SELECT clip_id, side, frame, round(ax, 6) + 0.0 AS ax, round(ay, 6) + 0.0 AS ay, round(az, 6) + 0.0 AS az
FROM n WHERE pf = frame - 1 AND nf = frame + 1
""")
def acceleration(spark, base) -> DataFrame:
    a = fill.second_difference(retained(spark, base), ["clip_id", "side"], "trans", width=32)
    v = F.col("acceleration")
    return a.filter(v.isNotNull()).select(
        "clip_id", "side", "frame", *[(F.round(v.getItem(i), 6) + 0.0).alias(n)
                                      for i, n in enumerate(("ax", "ay", "az"))])


@catalog.add("low_confidence_ranges", f"""
WITH {DENSE}, low AS (
  SELECT clip_id, side, frame FROM dense
  WHERE CASE WHEN sample_kind = 'observed' THEN score ELSE 0.0 END < 0.5),
n AS (SELECT *, frame - row_number() OVER (PARTITION BY clip_id, side ORDER BY frame) AS island FROM low)
SELECT clip_id, side, min(frame) AS "start", max(frame) AS "end" FROM n GROUP BY clip_id, side, island
""")
def low_confidence_ranges(spark, base) -> DataFrame:
    rows = fill.expand_gaps(retained(spark, base), ["clip_id", "side"], ["score"], frame_count(spark, base))
    samples = rows.select("clip_id", "side", F.col("at").alias("frame"), "sample_kind",
                          F.col("left.score").alias("confidence"))
    return timeline.low_confidence_ranges(samples, ["clip_id", "side"])


@catalog.add("usability_summary", f"""
WITH {DENSE}, s AS (SELECT clip_id, side, CASE WHEN sample_kind = 'observed' THEN score ELSE 0.0 END AS c FROM dense)
SELECT clip_id, side, round(avg(c), 10) AS mean_confidence, count(*) FILTER (WHERE c < 0.5) AS low_frames
FROM s GROUP BY clip_id, side
""")
def usability_summary(spark, base) -> DataFrame:
    rows = fill.expand_gaps(retained(spark, base), ["clip_id", "side"], ["score"], frame_count(spark, base))
    samples = rows.select("clip_id", "side", "sample_kind", F.col("left.score").alias("confidence"))
    return timeline.usability_summary(samples, ["clip_id", "side"]).withColumn(
        "mean_confidence", F.round("mean_confidence", 10))


@catalog.add("nearest_anchors", f"""
WITH {GROUPS}, f AS (SELECT DISTINCT clip_id, frame FROM obs),
k AS (SELECT clip_id, frame, x FROM kept WHERE side = 'left'),
j AS (SELECT f.clip_id, f.frame, k.frame AS seen, k.x FROM f LEFT JOIN k USING (clip_id, frame))
SELECT clip_id, frame, last_value(seen IGNORE NULLS) OVER b AS previous_frame,
       first_value(seen IGNORE NULLS) OVER a AS following_frame,
       last_value(x IGNORE NULLS) OVER b AS previous_value, first_value(x IGNORE NULLS) OVER a AS following_value
FROM j WINDOW b AS (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
              a AS (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
""")
def nearest_anchors(spark, base) -> DataFrame:
    groups = selection.classify_groups(observations(spark, base), payload=["trans"])
    left_value = F.when((F.col("side") == "left") & (F.col("outcome") == "retained"),
                        F.col("row.trans").getItem(0))
    frames = groups.groupBy("clip_id", "frame").agg(F.max(left_value).alias("x"))
    a = fill.nearest_anchors(frames, ["clip_id"], F.col("x"), width=32)
    return a.select("clip_id", "frame", F.col("previous.frame").alias("previous_frame"),
                    F.col("following.frame").alias("following_frame"),
                    F.col("previous.value").alias("previous_value"),
                    F.col("following.value").alias("following_value"))


@catalog.add("overlapping_windows", f"""
WITH w AS (SELECT user_id AS clip_id, {EVENT_MS} AS "start",
                  {EVENT_MS} + CAST(floor(value * 10000) AS BIGINT) AS "end" FROM events),
s AS (SELECT *, max("end") OVER (PARTITION BY clip_id ORDER BY "start", "end"
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM w)
SELECT clip_id, "start", "end" FROM s WHERE "start" <= reach
""")
def overlapping_windows(spark, base) -> DataFrame:
    e = table(spark, base, "events")
    w = e.select(F.col("user_id").alias("clip_id"), event_ms(F.col("ts")).alias("start"),
                 (event_ms(F.col("ts")) + F.floor(F.col("value") * 10000)).alias("end"))
    return ranges.overlapping_windows(w, ["clip_id"], width=6 * 3600 * 1000)
