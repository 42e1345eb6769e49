"""Contract queries on whole capture documents: each customer gives one JSON document, with faults by its numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import camera
from ..operators import contract, scale
from ..operators.lineage_cut import cut
from ..rules import Rule, bone_names
from ..sources import captures as docs
from ..sources.warehouse import table
from .base import Catalog

catalog = Catalog.empty()

# The numbers behind each document, in SQL that both engines read.
B = "CAST(floor(abs(c_acctbal)) AS BIGINT)"
FACTS = {
    "k": "c_custkey", "b": B, "ver": "concat('1.', c_custkey % 4)", "n": "2 + c_custkey % 4",
    "intr": "c_custkey % 5 <> 0", "dist": f"{B} % 3 <> 0", "calib": f"{B} % 2 = 0", "metric": f"{B} % 5 < 2",
    "anchor": f"CASE {B} % 7 WHEN 0 THEN NULL WHEN 1 THEN 'user_measured' ELSE 'hand_prior' END", "conf": f"{B} % 11 < 4",
    "af": f"CASE WHEN {B} % 13 < 6 THEN {B} % 6 END",
    "p_intr": f"CASE {B} % 4 WHEN 0 THEN 'calibrated' WHEN 1 THEN 'unobservable' ELSE 'inferred' END",
    "p_dist": f"CASE {B} % 9 WHEN 0 THEN 'unobservable' ELSE 'inferred' END",
    "p_scale": f"CASE {B} % 10 WHEN 3 THEN 'unobservable' ELSE 'observed' END",
    "units": f"CASE WHEN {B} % 17 < 9 THEN 'ue_centimeters' ELSE 'conditional_ue_units' END",
    "space": f"CASE WHEN {B} % 19 < 10 THEN 'shared_camera' ELSE 'per_hand_wrist_local' END",
    "assume": f"{B} % 23 < 12", "m_intr": f"{B} % 29 < 20", "m_dist": f"{B} % 14 < 9", "m_scale": f"{B} % 15 < 8",
    "m_inter": f"{B} % 16 < 7", "err": f"{B} % 31 < 12", "twice": "c_custkey % 6 = 0"}
FLAT = "f AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in FACTS.items()) + " FROM customer)"


def _frames(h: int) -> Column:
    """Two frames of a hand; a missing bone, masks and positions follow the numbers."""
    k, b = F.col("k"), F.col("b")
    left, right = (F.array(*map(F.lit, bone_names(side)[1:])) for side in ("left", "right"))
    names = left if h == 0 else F.when(F.col("twice"), left).otherwise(right)

    def frame(j: int) -> Column:
        keys = F.when((b + h + j) % 7 == 0, F.slice(names, 2, 14)).otherwise(names)
        return F.struct(
            (b % 3 + 2 * j).alias("frame"), F.when((b + h + j) % 5 == 0, "missing").otherwise("interpolated").alias("Sample_Kind"),
            F.struct(((b + 2 * h + j) % 3 != 0).alias("pose"), ((b + h + 3 * j) % 4 < 2).alias("global_translation")).alias("validity"),
            F.when((k + h + j) % 3 != 0, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))).alias("global_trans_cm"),
            F.array(F.array(F.when((k + j) % 4 == 0, 0.5).otherwise(0.0), F.lit(0.0), F.lit(0.0))).alias("joint_positions_cm"),
            F.map_from_arrays(keys, F.array_repeat(F.array(*map(F.lit, (0, 0, 0, 1))), F.size(keys))).alias("bone_rotations"))

    return F.array(frame(0), frame(1))


def _packet(i: int) -> Column:
    k, b = F.col("k"), F.col("b")
    state = F.element_at(F.array(*map(F.lit, ("Free", "UNKNOWN", "floating", "gripped"))), ((b + i) % 4 + 1).cast("int"))
    return F.struct(
        F.lit(f"P{i}").alias("id"), (b % 2).alias("birth_frame"), (b % 2 + (k + i) % 4 - 1).alias("death_frame"),
        F.when((b + i) % 3 != 0, 5).alias("card_count_estimate"), F.when((b + i) % 4 != 0, 0.5).alias("card_count_confidence"),
        F.array(F.struct(((k + i) % 4).alias("frame"), state.alias("contact_state"),
                         F.array(F.when((b + i) % 5 == 0, "elbow").otherwise("Index_01_L")).alias("contact_bones"))).alias("frames"))


PARTS = {
    "camera": """named_struct('intrinsics', IF(intr, named_struct('fx', 600.5, 'fy', 601, 'cx', 320, 'cy', 240), null),
        'distortion', IF(dist, array(0.0, 0.0, 0.0, 0.0), null), 'calibrated', calib)""",
    "scale": """named_struct('meters_per_unit', IF(metric, 0.5, null), 'anchor_method', anchor, 'confidence', IF(conf, 0.75, null),
        'anchor_frames', filter(array(af), x -> x IS NOT NULL))""",
    "provenance": """named_struct('camera_intrinsics', p_intr, 'camera_distortion', p_dist, 'metric_scale', p_scale, 'coordinate_units', units,
        'coordinate_frame', space, 'assumptions', filter(array('flat'), x -> assume))""",
    "validity": "named_struct('camera_intrinsics', m_intr, 'camera_distortion', m_dist, 'metric_scale', m_scale, 'inter_hand_transform', m_inter)",
    "quality": """named_struct('low_confidence_ranges', array(array(0, k % 3), array(b % 4, 1 + b % 5)),
        'mean_reprojection_error_px', IF(err, 1.5, null))""",
    "splits": "array(named_struct('frame', b % 7, 'source', concat('P', k % 4), 'results', array(concat('P', b % 3), concat('p', b % 5))))",
    "releases": "array(named_struct('frame', k % 6, 'packet', concat('p', b % 4)))",
}


def documents(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, text): the JSON documents; some keys are spelled in capitals."""
    facts = table(spark, base, "customer").selectExpr(*[f"{e} AS {n}" for n, e in FACTS.items()])
    facts = facts.selectExpr("*", *[f"{e} AS {n}" for n, e in PARTS.items()])
    hands = F.array(F.struct(F.lit("left").alias("side"), _frames(0).alias("frames")),
                    F.struct(F.when(F.col("twice"), "LEFT").otherwise("right").alias("side"), _frames(1).alias("frames")))
    whole = F.struct(F.col("ver").alias("Format_Version"), F.struct(F.col("n").alias("frame_count")).alias("meta"),
                     "camera", "scale", "provenance", "validity", hands.alias("HANDS"), F.array(*map(_packet, range(3))).alias("packets"),
                     F.struct("splits", F.array().alias("merges"), "releases").alias("events"), "quality")
    return facts.select(F.col("k").cast("string").alias("doc_id"), F.to_json(whole, {"ignoreNullFields": "false"}).alias("text"))


def captures(spark: SparkSession, base: str) -> DataFrame:
    return docs.typed(documents(spark, base))


def sql_of(rule: str, source: str, issues: list[tuple[str, str, str]], more: str = "") -> str:
    """One row for each condition that holds; ``path`` is SQL."""
    cases = ", ".join(f"CASE WHEN {c} THEN {{'path': {p}, 'message': '{m}'}} END" for c, p, m in issues)
    return f"""WITH {FLAT}{more}, v AS (SELECT k, unnest([{cases}]) AS v FROM {source})
SELECT CAST(k AS VARCHAR) AS doc_id, v.path AS path, '{rule}' AS rule, v.message AS message FROM v WHERE v IS NOT NULL"""


V12, V13 = "k % 4 >= 2", "k % 4 = 3"
LOCAL, SHARED = f"({V13} AND space = 'per_hand_wrist_local')", f"({V13} AND space = 'shared_camera')"
UNSEEN = "unobservable requires null and a value requires a source"


@catalog.add("document_rules", sql_of("document", "f", [
    *[(f"{V12} AND m_{c} <> {has}", f"'$.validity.{name}'", "mask must match the value")
      for c, has, name in (("intr", "intr", "camera_intrinsics"), ("dist", "dist", "camera_distortion"), ("scale", "metric", "metric_scale"))],
    *[(f"{V12} AND {has} = (p_{c} = 'unobservable')", f"'$.provenance.{name}'", UNSEEN)
      for c, has, name in (("intr", "intr", "camera_intrinsics"), ("dist", "dist", "camera_distortion"), ("scale", "metric", "metric_scale"))],
    (f"{V12} AND calib AND NOT (intr AND p_intr = 'calibrated')", "'$.camera.calibrated'", "calibrated flag requires calibrated intrinsics"),
    (f"{V12} AND CASE WHEN metric THEN anchor IS NULL ELSE anchor IS NOT NULL OR conf OR af IS NOT NULL END", "'$.scale'",
     "scale, anchor and confidence must agree"),
    (f"{V12} AND units <> CASE WHEN metric THEN 'ue_centimeters' ELSE 'conditional_ue_units' END", "'$.provenance.coordinate_units'",
     "units must agree with metric scale"),
    (f"{V12} AND NOT metric AND NOT assume", "'$.provenance.assumptions'", "conditional geometry requires assumptions"),
    ("k % 4 < 2 AND anchor = 'user_measured'", "'$.scale.anchor_method'", "value is not allowed"),
    (f"{V13} AND m_inter = (space = 'per_hand_wrist_local')", "'$.validity.inter_hand_transform'", "must match coordinate frame"),
    (f"{LOCAL} AND (intr OR dist OR calib)", "'$.camera'", "wrist-local output has no shared camera"),
    (f"{SHARED} AND NOT intr", "'$.camera.intrinsics'", "shared camera needs intrinsics"),
    (LOCAL, "'$.packets'", "wrist-local output has no packets"),
    (f"{LOCAL} AND err", "'$.quality.mean_reprojection_error_px'", "wrist-local output has no shared-camera residual"),
    ("af > n - 1", "'$.scale.anchor_frames'", "frame outside timeline"),
    ("twice", "'$.hands'", "duplicate hand side")]))
def document_rules(spark, base) -> DataFrame:
    return contract.document_violations(captures(spark, base))


AT = "'$.hands[' || h || '].frames[' || j || ']"


@catalog.add("sample_rules", sql_of("sample", "s", [
    ("2 * j + b % 3 >= n", f"{AT}.frame'", "frame outside timeline"),
    ("(b + h + j) % 7 = 0", f"{AT}.bone_rotations'", "expected exactly the configured bones"),
    (f"{V12} AND ((b + 2 * h + j) % 3 <> 0) = ((b + h + j) % 5 = 0)", f"{AT}.validity.pose'", "missing must be invalid and a supplied pose valid"),
    (f"{V13} AND ((b + h + 3 * j) % 4 < 2) <> ((k + h + j) % 3 <> 0)", f"{AT}.validity.global_translation'", "must match the translation"),
    (f"{LOCAL} AND (k + h + j) % 3 <> 0", f"{AT}.global_trans_cm'", "wrist-local translation must be null"),
    (f"{SHARED} AND (k + h + j) % 3 = 0", f"{AT}.global_trans_cm'", "shared-camera translation is required"),
    (f"{LOCAL} AND (k + j) % 4 = 0", f"{AT}.joint_positions_cm[0]'", "wrist-local origin must be zero")],
    ", s AS (SELECT f.*, h, j FROM f, (VALUES (0), (1)) a(h), (VALUES (0), (1)) c(j))"))
def sample_rules(spark, base) -> DataFrame:
    return contract.sample_violations(captures(spark, base))


PA = "'$.packets[' || i || ']"
PACKETS = """, p AS (SELECT f.*, i, b % 2 AS birth, b % 2 + (k + i) % 4 - 1 AS death FROM f, (VALUES (0), (1), (2)) a(i))"""


@catalog.add("packet_rules", f"""WITH own AS ({sql_of("packet", "p", [
    ("death < birth", f"{PA}.death_frame'", "death before birth"),
    ("birth >= n OR death >= n", f"{PA}.death_frame'", "frame outside timeline"),
    ("((b + i) % 3 = 0) <> ((b + i) % 4 = 0)", f"{PA}.card_count_confidence'", "one of count and confidence without the other")], PACKETS)}),
poses AS ({sql_of("packet_frame", "p", [
    ("(k + i) % 4 < birth OR (k + i) % 4 > death", f"{PA}.frames[0].frame'", "frame outside the packet lifetime"),
    ("(b + i) % 4 = 2 OR (b + i) % 4 = 1 AND k % 4 = 0", f"{PA}.frames[0].contact_state'", "contact state is not listed"),
    ("(b + i) % 5 = 0", f"{PA}.frames[0].contact_bones'", "contact names an unmapped bone")], PACKETS)})
SELECT * FROM own UNION ALL SELECT * FROM poses""")
def packet_rules(spark, base) -> DataFrame:
    return contract.packet_violations(cut(captures(spark, base).select("clip_id", "format_version", "meta", "packets")))


@catalog.add("event_rules", sql_of("reference", "f", [
    ("k % 4 = 3", "'$.events.splits[0]'", "no packet of this id"), ("b % 5 > 2", "'$.events.splits[0]'", "no packet of this id"),
    ("b % 4 = 3", "'$.events.releases[0]'", "no packet of this id"),
    ("b % 3 = k % 4", "'$.events.splits[0]'", "subject among its own members"),
    ("b % 5 = k % 4", "'$.events.splits[0]'", "subject among its own members"),
    ("b % 3 = b % 5", "'$.events.splits[0]'", "fewer than two members"),
    ("b % 7 > n - 1", "'$.events.splits[0]'", "event outside the timeline"),
    ("k % 6 > n - 1", "'$.events.releases[0]'", "event outside the timeline")]))
def event_rules(spark, base) -> DataFrame:
    c = cut(captures(spark, base).select("clip_id", "meta", "packets", "events"))  # several rules read it
    return contract.reference_violations(docs.events(c), docs.packets(c), c.select("clip_id", F.col("meta.frame_count").alias("n")))


@catalog.add("range_rules", sql_of("ranges", "f", [
    ("1 + b % 5 < b % 4 OR b % 4 <= k % 3", "'$.quality.low_confidence_ranges[1]'", "range not after the one before"),
    ("k % 3 > n - 1", "'$.quality.low_confidence_ranges[0]'", "range beyond the last frame"),
    ("greatest(b % 4, 1 + b % 5) > n - 1", "'$.quality.low_confidence_ranges[1]'", "range beyond the last frame")]))
def range_rules(spark, base) -> DataFrame:
    return contract.range_violations(cut(captures(spark, base).select("clip_id", "meta", "quality")))


@catalog.add("contract_counts", f"""WITH {FLAT}
SELECT CAST(k AS VARCHAR) AS clip_id, ver AS format_version, n AS frame_count, 2 AS hands, 4 AS hand_samples, 3 AS packets,
       3 AS packet_samples, 1 AS splits, 0 AS merges, 1 AS releases FROM f""")
def contract_counts(spark, base) -> DataFrame:
    return contract.contract_summary(captures(spark, base))


@catalog.add("retarget_rules", f"""WITH {FLAT}, s AS (SELECT f.*, h, j, (b + 2 * h + j) % 3 <> 0 AS pose, (b + h + j) % 5 = 0 AS missing,
    (k + h + j) % 3 <> 0 AS moved FROM f, (VALUES (0), (1)) a(h), (VALUES (0), (1)) c(j)),
g AS (SELECT k, h, any_value(CASE WHEN h = 0 THEN 'left' WHEN twice THEN 'LEFT' ELSE 'right' END) AS side,
             bool_or({V12} AND (NOT pose OR missing)) AS absent, bool_or({V13} AND moved = (space = 'per_hand_wrist_local')) AS wrong
      FROM s GROUP BY k, h)
SELECT CAST(k AS VARCHAR) AS clip_id, side, 'frames must be exactly 0..n-1' AS message FROM g
UNION ALL SELECT CAST(k AS VARCHAR), side, 'missing pose cannot be posed' FROM g WHERE absent
UNION ALL SELECT CAST(k AS VARCHAR), side, 'translation does not match the coordinate frame' FROM g WHERE wrong""")
def retarget_rules(spark, base) -> DataFrame:
    """Frames 0 and 2, or later ones, never are a whole timeline, so each hand is sparse."""
    return contract.retarget_issues(captures(spark, base))


SMALL_RULES = (Rule("$.resolution", "integers", low=1, high=5000, sizes=(2,)), Rule("$.shape", "numbers", sizes=(3,)),
               Rule("$.rotation", "quaternion"), Rule("$.seen", "integers", low=0, high=20, unique=True))


@catalog.add("array_rules", """
WITH f AS (SELECT p_partkey AS k, p_size AS s FROM part), v AS (
  SELECT k, '$.resolution' AS path, 'integers' AS rule, 'below minimum' AS message FROM f WHERE s % 5 = 0
  UNION ALL SELECT k, '$.shape', 'numbers', 'unexpected number of entries' FROM f WHERE s % 4 <> 3 AND s % 4 <> 0
  UNION ALL SELECT k, '$.shape', 'numbers', 'unexpected number of entries' FROM f WHERE s % 4 = 0
  UNION ALL SELECT k, '$.rotation', 'quaternion', 'unexpected number of entries' FROM f WHERE k % 6 = 0
  UNION ALL SELECT k, '$.rotation', 'quaternion', 'rotation is not of unit length' FROM f WHERE k % 6 <> 0 AND s % 3 <> 0
  UNION ALL SELECT k, '$.seen', 'integers', 'above maximum' FROM f WHERE s > 20
  UNION ALL SELECT k, '$.seen', 'integers', 'duplicate entry' FROM f WHERE s <= 20 AND s = k % 21)
SELECT CAST(k AS VARCHAR) AS doc_id, path, rule, message FROM v
""")
def array_rules(spark, base) -> DataFrame:
    """Fixed-length arrays, unit rotations and unique indices: each part is a small document."""
    text = """to_json(named_struct('resolution', array(640, p_size % 5), 'Shape', array_repeat(0.5, CAST(p_size % 4 AS INT)),
        'rotation', IF(p_partkey % 6 = 0, array(0.0, 0.0, 1.0), array(0.6, 0.0, 0.0, 0.8 + IF(p_size % 3 = 0, 0.0, 0.1))),
        'seen', array(CAST(p_size AS BIGINT), p_partkey % 21)))"""
    d = table(spark, base, "part").select(F.col("p_partkey").cast("string").alias("doc_id"), F.expr(text).alias("text"))
    return contract.field_violations(docs.leaves(d), contract.rule_table(spark, SMALL_RULES))


def messages(key: str, source: str, issues: list[tuple[str, str]]) -> str:
    """(key, message) for each condition that holds."""
    cases = ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in issues)
    return f"SELECT * FROM (SELECT {key}, unnest([{cases}]) AS message FROM {source}) WHERE message IS NOT NULL"


@catalog.add("bone_tree_rules", f"""
WITH p AS (SELECT p_partkey AS k, p_partkey % 16 AS joint, (p_partkey % 16 + p_size) % 18 - 1 AS parent, p_size % 23 - 1 AS landmark,
  CASE WHEN p_size % 11 = 0 THEN '' WHEN p_size % 13 = 0 THEN 'None' WHEN p_size % 7 = 0 THEN p_brand ELSE p_brand || '_' || p_partkey END AS bone FROM part),
d AS (SELECT *, count(*) OVER (PARTITION BY lower(bone)) AS n FROM p)
{messages("CAST(k AS VARCHAR) AS side, joint", "d", [
    ("joint = 0 AND parent <> -1", "wrist parent must be -1"), ("joint > 0 AND NOT parent BETWEEN 0 AND joint - 1", "parent must precede child"),
    ("bone = '' OR bone = 'None'", "invalid bone name"), ("n > 1", "duplicate bone name"),
    ("NOT landmark BETWEEN 0 AND 20", "landmark out of range")])}""")
def bone_tree_rules(spark, base) -> DataFrame:
    """Each part is a row of a bone tree."""
    rows = table(spark, base, "part").selectExpr(
        "CAST(p_partkey AS STRING) AS side", "p_partkey % 16 AS joint", "(p_partkey % 16 + p_size) % 18 - 1 AS parent", "p_size % 23 - 1 AS landmark",
        """CASE WHEN p_size % 11 = 0 THEN '' WHEN p_size % 13 = 0 THEN 'None' WHEN p_size % 7 = 0 THEN p_brand
           ELSE concat(p_brand, '_', p_partkey) END AS bone_name""")
    return contract.mapping_violations(rows)


@catalog.add("estimate_rules", f"""
WITH e AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS s, CAST(l_quantity AS BIGINT) AS q FROM lineitem)
{messages("l_orderkey, l_linenumber, l_partkey, s AS l_suppkey, q", "e", [
    ("s % 5 = 0", "invalid side"), ("q > 40", "confidence must be in [0, 1]"), ("q % 4 = 0", "image_landmarks must hold 21 finite points"),
    ("q % 6 = 1", "world_landmarks_m must hold 21 finite points"), ("s % 3 = 0", "coordinate convention must be explicit"),
    ("s % 4 <> 1 AND q > 30", "joint_confidences must hold 21 finite values"), ("l_linenumber = 2", "global_orient must hold 3 finite values"),
    ("s % 7 = 2", "hand_pose must hold 45 finite values"), ("q % 9 = 4", "shape must hold 10 finite values")])}""")
def estimate_rules(spark, base) -> DataFrame:
    """Each order line is a hand estimate whose vectors are too short, too large or not finite by its numbers."""
    rows = table(spark, base, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(l_quantity AS BIGINT) AS q").selectExpr(
        "*", "CASE WHEN l_suppkey % 5 = 0 THEN 'top' WHEN q % 2 = 0 THEN 'left' ELSE 'right' END AS side", "q / 40 AS handedness_confidence",
        "array_repeat(array(0.1D, 0.2D, IF(q % 4 = 0, double('NaN'), 0.3D)), 21) AS image_landmarks",
        "array_repeat(array(0.1D, 0.2D, 0.3D), IF(q % 6 = 1, 20, 21)) AS world_landmarks_m",
        "IF(l_suppkey % 3 = 0, ' ', 'y up') AS world_coordinate_system",
        "IF(l_suppkey % 4 = 1, null, array_repeat(q / 30, 21)) AS joint_confidences",
        "array_repeat(0.5D, IF(l_linenumber = 2, 4, 3)) AS global_orient",
        "IF(l_suppkey % 7 = 3, null, array_repeat(IF(l_suppkey % 7 = 2, double('Infinity'), 0.5D), 45)) AS hand_pose",
        "array_repeat(0.5D, IF(q % 9 = 4, 9, 10)) AS shape")
    return contract.estimate_violations(rows, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q"])


@catalog.add("seed_rules", f"""
WITH s AS (SELECT l_orderkey AS k, CASE WHEN l_suppkey % 9 = 0 THEN 'o ' || l_suppkey % 4 ELSE 'o' || l_suppkey % 4 END AS id,
  CASE WHEN l_orderkey % 3 = 0 THEN l_linenumber ELSE 0 END AS f, l_partkey % 5 AS area, l_partkey % 5 + CASE WHEN l_suppkey % 6 = 0 THEN 1 ELSE 0 END AS rec,
  l_suppkey % 8 AS h, l_suppkey % 10 AS p FROM lineitem),
w AS (SELECT *, count(*) OVER (PARTITION BY k, id) AS n, min(f) OVER (PARTITION BY k) AS f0, max(f) OVER (PARTITION BY k) AS f1 FROM s)
{messages("k AS clip_id, id AS object_id", "w", [
    ("id LIKE 'o %'", "unsafe object id"), ("n > 1", "duplicate object id"), ("f0 <> f1", "seeds must share one reference frame"),
    ("NOT (area > 0 AND area = rec)", "recorded area differs"), ("h = 0", "invalid mask hash"), ("p < 2", "provenance required")])}""")
def seed_rules(spark, base) -> DataFrame:
    """The lines of an order are the mask seeds of a clip."""
    rows = table(spark, base, "lineitem").selectExpr(
        "l_orderkey AS clip_id", "concat(IF(l_suppkey % 9 = 0, 'o ', 'o'), l_suppkey % 4) AS object_id", "IF(l_orderkey % 3 = 0, l_linenumber, 0) AS frame",
        "l_partkey % 5 AS area_px", "l_partkey % 5 + IF(l_suppkey % 6 = 0, 1, 0) AS recorded_area_px",
        "IF(l_suppkey % 8 = 0, 'no hash', sha2(CAST(l_partkey AS STRING), 256)) AS mask_sha256",
        "IF(l_suppkey % 10 = 0, '', 'manual') AS provenance_kind", "IF(l_suppkey % 10 = 1, null, 'first frame') AS selection_provenance")
    return contract.seed_violations(rows)


@catalog.add("prompt_rules", f"""
WITH p AS (SELECT o_orderkey AS k, o_custkey % 9 AS f, 'x' || o_custkey % 7 AS id, o_orderkey % 6 AS a, o_custkey % 5 AS b FROM orders),
objects AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 6 = 0 THEN 'x 0' ELSE 'x' || o_custkey % 6 END AS id FROM orders),
own AS ({messages("k AS clip_id, f AS frame, id AS object_id", "p", [
    ("f > 6", "frame outside timeline"), ("a = 0 AND b <> 3", "prompt needs points or a box"), ("a = 1", "every point needs a label"),
    ("a = 2", "point outside image"), ("a = 3", "label must be 0 or 1"), ("b = 3 AND a % 2 = 1", "invalid box"),
    ("b = 4", "provenance required"), ("a = 5", "ground-truth flag must be false")])})
SELECT * FROM own
UNION ALL SELECT k, f, id, 'unknown object' FROM p WHERE NOT EXISTS (SELECT 1 FROM objects o WHERE o.k = p.k AND o.id = p.id)
UNION ALL SELECT k, NULL, id, 'object has no prompt' FROM objects o WHERE NOT EXISTS (SELECT 1 FROM p WHERE o.k = p.k AND o.id = p.id)
UNION ALL SELECT k, NULL, id, 'unsafe object id' FROM objects WHERE id = 'x 0'""")
def prompt_rules(spark, base) -> DataFrame:
    """Each order is a clip with one object and one prompt."""
    o = table(spark, base, "orders")
    prompts = o.selectExpr(
        "o_orderkey AS clip_id", "CAST(o_custkey % 9 AS INT) AS frame", "concat('x', o_custkey % 7) AS object_id", "o_orderkey % 6 AS a", "o_custkey % 5 AS b").selectExpr(
        "clip_id", "frame", "object_id",
        "CASE a WHEN 0 THEN null WHEN 2 THEN array(array(10.0D, 480.0D)) ELSE array(array(10.0D, 20.0D)) END AS points",
        "CASE a WHEN 0 THEN null WHEN 1 THEN array(1, 0) WHEN 3 THEN array(2) ELSE array(1) END AS labels",
        "CASE WHEN b <> 3 THEN null WHEN a % 2 = 1 THEN array(5.0D, 5.0D, 5.0D, 9.0D) ELSE array(5.0D, 5.0D, 640.0D, 480.0D) END AS box",
        "IF(b = 4, '', 'manual') AS provenance_kind", "'first view' AS description", "a = 5 AS is_ground_truth")
    objects = o.selectExpr("o_orderkey AS clip_id", "IF(o_custkey % 6 = 0, 'x 0', concat('x', o_custkey % 6)) AS object_id")
    sources = o.selectExpr("o_orderkey AS clip_id", "640 AS width", "480 AS height", "7 AS frame_count")
    return contract.prompt_violations(prompts, objects, sources)


@catalog.add("display_rules", f"""
WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS s, l_quantity - 3 AS focal, l_discount - 0.02 AS ratio FROM lineitem)
{messages("l_orderkey, l_linenumber, l_partkey, s AS l_suppkey, focal", "d", [
    ("focal <= 0", "focal must be positive"), ("ratio < 0", "ratio must not be negative"),
    ("s % 4 = 0", "translation differs from its equation"), ("s % 5 = 0", "ratio differs")])}""")
def display_rules(spark, base) -> DataFrame:
    rows = table(spark, base, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity - 3 AS focal", "l_discount - 0.02 AS ratio",
        "l_discount - 0.02 + IF(l_suppkey % 5 = 0, 0.001D, 0D) AS recomputed_ratio", "array(1.0D, 2.0D, 3.0D) AS constant", "array(0.0D, 0.5D, 1.0D) AS slope").withColumn(
        "translation", F.expr("array(1.0D, 2.0D + 0.5D * focal, 3.0D + focal + IF(l_suppkey % 4 = 0, 0.01D, 0D))"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "focal", F.explode(contract.display_config_issues()).alias("message"))


@catalog.add("camera_record", """
SELECT p_partkey, p_size > 3 AND p_size % 4 <> 1 AS valid_camera, p_size % 6 NOT IN (1, 2) AS valid_transform,
  CASE WHEN p_size % 7 = 0 THEN 'unobservable' WHEN NOT (p_size > 3) THEN 'invalid_intrinsics' WHEN p_size % 5 = 0 THEN 'missing_distortion'
       WHEN p_size % 4 = 1 THEN 'unsupported_distortion' WHEN p_size % 3 = 0 THEN 'missing_image_space' ELSE 'calibrated' END AS status,
  CASE WHEN p_size % 5 <> 0 THEN CASE WHEN p_size % 3 = 1 THEN 0.0 ELSE 0.25 END END AS lens
FROM part
""")
def camera_record(spark, base) -> DataFrame:
    """Each part is a calibrated camera and a pose; rotation by a right angle, bent in every sixth."""
    rows = table(spark, base, "part").selectExpr(
        "p_partkey", "p_size", "(p_size - 3) * 100.0D AS fx", "array_repeat(0.25D, IF(p_size % 4 = 1, 6, 5)) AS lens",
        """array(0.0D, -1.0D, 0.0D, 1.0D, 1.0D, IF(p_size % 6 = 1, 0.5D, 0.0D), 0.0D, 2.0D, 0.0D, 0.0D, 1.0D, 3.0D, 0.0D, 0.0D, IF(p_size % 6 = 2, 1.0D, 0.0D), 1.0D) AS pose""")
    rows = rows.withColumn("known", F.expr("IF(p_size % 5 = 0, null, lens)")).withColumn("space", F.expr(
        "CASE p_size % 3 WHEN 0 THEN null WHEN 1 THEN 'undistorted_same_intrinsics' ELSE 'original_distorted' END"))
    fx = F.col("fx")
    return rows.select(
        "p_partkey", camera.camera_valid(fx, fx, F.lit(320.0), F.lit(240.0), F.col("lens")).alias("valid_camera"),
        camera.rigid_transform_valid(F.col("pose")).alias("valid_transform"),
        camera.camera_status(F.col("p_size") % 7 != 0, fx > 0, F.col("known"), F.col("space")).alias("status"),
        F.get(camera.effective_distortion(F.col("known"), F.coalesce("space", F.lit(""))), F.lit(0)).alias("lens"))


@catalog.add("evidence_rules", f"""
WITH s AS (SELECT p_partkey AS k, p_size AS s FROM part),
e AS ({messages("k AS p_partkey, 'evidence' AS of", "s", [
    ("s % 4 = 0", "description_missing"), ("s % 5 = 0", "sha256_invalid"), ("s % 6 = 0", "flag_not_explicit")])}),
c AS ({messages("k AS p_partkey, 'scale' AS of", "s", [
    ("s % 3 = 0 AND NOT (s % 2 = 0 AND s % 7 <> 0)", "unknown_scale_with_values"), ("s % 3 <> 0 AND s < 10", "nonpositive_factor"),
    ("s % 9 = 1", "invalid_nominal"), ("s % 2 <> 0 AND s % 5 <> 1", "prior_must_stay_low")])})
SELECT * FROM e UNION ALL SELECT * FROM c
""")
def evidence_rules(spark, base) -> DataFrame:
    """Each part is a piece of evidence and a scale estimate."""
    rows = table(spark, base, "part").selectExpr(
        "p_partkey", "p_size AS s", """named_struct('description', IF(p_size % 4 = 0, ' ', p_name),
          'sha256', IF(p_size % 5 = 0, 'x', sha2(p_name, 256)), 'ok', IF(p_size % 6 = 0, null, p_size > 9)) AS evidence""").selectExpr(
        "*", "IF(s % 3 = 0, null, s - 9.0D) AS meters_per_unit", "IF(s % 2 = 0, null, 'hand_prior') AS anchor_method",
        "CASE WHEN s % 3 = 0 AND s % 2 = 0 THEN 'unknown' WHEN s % 5 = 1 THEN 'low' ELSE 'medium' END AS confidence",
        "IF(s % 7 = 0, 'observed', 'unobservable') AS provenance_kind", "1.0D AS global_factor", "IF(s % 9 = 1, -1.0D, null) AS nominal_meters_per_unit")
    found = [rows.select("p_partkey", F.lit(of).alias("of"), F.explode(issues).alias("message"))
             for of, issues in (("evidence", scale.evidence_issues("evidence")), ("scale", scale.scale_estimate_issues()))]
    return found[0].unionByName(found[1])
