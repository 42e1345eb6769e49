"""Contract checking as joins: document leaves against a rule table.

All violations are reported, one row each: (doc_id, path, rule, message).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, is_safe_id, is_sha256, is_text
from ..functions.vectors import all_numbers, finite_items, is_number, let
from ..rules import (CAPTURE_RULES, CONTACT_STATES, JOINT_PARENTS, QUATERNION_TOLERANCE, Rule,
                     bone_names)
from ..sources import captures as docs
from .lineage_cut import cut
from .ranges import interval_order_issues

RULE_SCHEMA = """pattern string, expected string, since string, nullable_since string, low double, high double,
positive boolean, sizes array<int>, enum array<string>, fold boolean, is_unique boolean"""


def rule_table(spark, rules: Sequence[Rule] = CAPTURE_RULES) -> DataFrame:
    """The rules as a DataFrame; its size is the fixed number of contract fields."""
    def real(v):
        return None if v is None else float(v)

    rows = [(r.pattern, r.kind, r.since, r.nullable_since, real(r.low), real(r.high), r.positive,
             list(r.sizes) if r.sizes else None, list(r.enum) if r.enum else None, r.fold, r.unique) for r in rules]
    return spark.createDataFrame(rows, RULE_SCHEMA)


def _leaf_issue() -> Column:
    """Message for a leaf that breaks its rule, or null."""
    kind, want = F.col("kind"), F.col("expected")
    numeric = want.isin("number", "integer")
    arrays = want.isin("numbers", "integers", "quaternion")
    empty = (kind == "list") & (F.col("size") == 0)
    fits = ((kind == want) | (numeric & (kind == "number"))
            | (arrays & ((kind == "numbers") | (empty & (want != "quaternion"))))
            | ((want == "list") & kind.isin("list", "numbers", "strings"))
            | ((want == "strings") & empty))
    may_be_null = (kind == "null") & (F.col("version") >= F.col("nullable_since"))
    # Width and height of a packet may be unknown only two versions after the thickness.
    late_null = (kind == "null") & F.col("path").rlike(r"\.dimensions_cm\[[01]\]$") & (F.col("version") < "1.2")
    allowed = F.when(F.col("fold"), F.array_contains(F.col("enum"), ascii_fold(F.col("text")))) \
        .otherwise(F.array_contains(F.col("enum"), F.col("text")))
    low, high = F.col("low"), F.col("high")
    values = F.coalesce(F.col("numbers"), F.when(kind == "number", F.array("number")))
    squared = F.aggregate(F.col("numbers"), F.lit(0.0), lambda s, x: s + x * x)
    counted = want.isin("list", "strings")
    distinct = F.when(kind == "strings", F.size(F.array_distinct(F.transform("strings", ascii_fold)))) \
        .otherwise(F.size(F.array_distinct("numbers")))
    return (F.when(late_null, "null is not allowed in this version")
            .when(F.coalesce(may_be_null, F.lit(False)), F.lit(None))
            .when(kind == "null", "null is not allowed in this version")
            .when(~fits, F.concat(F.lit("expected "), want))
            .when((kind == "string") & (F.col("size") == 0), "text is empty")
            .when(F.exists(F.coalesce("strings", F.array()), lambda s: F.length(s) == 0) & (kind == "strings"),
                  "text is empty")
            .when(want.isin("integer", "integers") & (F.col("is_integral") == F.lit(False)), "expected integer")
            .when(F.col("sizes").isNotNull() & ~F.array_contains("sizes", F.col("size")), "unexpected number of entries")
            .when(counted & ((F.col("size") < low) | (F.col("size") > high)), "unexpected number of entries")
            .when((want == "quaternion") & (F.size("numbers") != 4), "unexpected number of entries")
            .when((want == "quaternion") & (F.abs(squared - 1) > QUATERNION_TOLERANCE), "rotation is not of unit length")
            .when(~counted & F.exists(values, lambda v: v < low), "below minimum")
            .when(~counted & F.exists(values, lambda v: v > high), "above maximum")
            .when(F.col("positive") & F.exists(values, lambda v: v <= 0), "must be positive")
            .when(F.col("enum").isNotNull() & ~F.coalesce(allowed, F.lit(False)), "value is not allowed")
            .when(F.col("is_unique") & (distinct < F.col("size")), "duplicate entry"))


def field_violations(leaves: DataFrame, rules: DataFrame) -> DataFrame:
    """Leaf rules and missing fields.

    The rule table, a fixed few dozen rows with one rule a pattern, is broadcast twice: as the rule of a leaf and as
    the fields of an object. Version and kinds travel with each leaf, so a document is read once and nothing is shuffled.
    """
    own = rules.withColumn("has_rule", F.lit(True))
    fields = rules.filter(~F.col("pattern").endswith("*") & ~F.col("pattern").endswith("[*]")).groupBy(
        F.regexp_replace("pattern", r"\.[^.]*$", "").alias("pattern")).agg(F.collect_list(F.struct(
            "since", F.regexp_extract("pattern", r"\.([^.]*)$", 1).alias("field"))).alias("fields"))
    joined = leaves.join(F.broadcast(own), "pattern", "left").join(F.broadcast(fields), "pattern", "left")

    def found(path, rule, message):
        return F.struct(path.alias("path"), rule.alias("rule"), message.alias("message"))

    leaf = F.when(F.col("has_rule") & (F.col("version") >= F.col("since")), _leaf_issue())
    missing = F.transform(
        F.filter("fields", lambda f: (F.col("version") >= f.getField("since")) & ~F.array_contains(F.col("strings"), f.getField("field"))),
        lambda f: found(F.concat_ws(".", "path", f.getField("field")), F.lit("required"), F.lit("no value at this path")))
    issues = F.array_compact(F.array(
        F.when(F.col("kind") == "invalid", found(F.lit("$"), F.lit("json"), F.col("text"))),
        F.when(leaf.isNotNull() & (F.col("kind") != "invalid"), found(F.col("path"), F.col("expected"), leaf))))
    return joined.select("doc_id", F.inline(F.concat(issues, F.when((F.col("kind") == "object") & F.col("fields").isNotNull(), missing)
                                                     .otherwise(F.array()))))


def _issue(condition: Column, path, message: str) -> Column:
    return F.when(condition, F.struct((path if isinstance(path, Column) else F.lit(path)).alias("path"),
                                      F.lit(message).alias("message")))


def _rows(df: DataFrame, rule: str, *issues: Column) -> DataFrame:
    return df.select(F.col("clip_id").alias("doc_id"), F.inline(F.array_compact(F.array(*issues)))).select(
        "doc_id", "path", F.lit(rule).alias("rule"), "message")


def document_violations(captures: DataFrame) -> DataFrame:
    """Cross-field rules of one document: provenance, nulls and masks must agree."""
    v12, v13 = F.col("format_version") >= "1.2", F.col("format_version") >= "1.3"
    known = {"camera_intrinsics": F.col("camera.intrinsics").isNotNull(),
             "camera_distortion": F.col("camera.distortion").isNotNull(),
             "metric_scale": F.col("scale.meters_per_unit").isNotNull()}
    issues = []
    for name, has in known.items():
        issues.append(_issue(v12 & (F.col(f"validity.{name}") != has), f"$.validity.{name}", "mask must match the value"))
        issues.append(_issue(v12 & (has == (F.col(f"provenance.{name}") == "unobservable")),
                             f"$.provenance.{name}", "unobservable requires null and a value requires a source"))
    metric = known["metric_scale"]
    frames_empty = F.size(F.coalesce("scale.anchor_frames", F.array().cast("array<int>"))) == 0
    local = v13 & (F.col("provenance.coordinate_frame") == "per_hand_wrist_local")
    shared = v13 & (F.col("provenance.coordinate_frame") == "shared_camera")
    last = F.col("meta.frame_count") - 1
    issues += [
        _issue(v12 & F.col("camera.calibrated") & ~(known["camera_intrinsics"]
               & F.coalesce(F.col("provenance.camera_intrinsics") == "calibrated", F.lit(False))),
               "$.camera.calibrated", "calibrated flag requires calibrated intrinsics"),
        _issue(v12 & F.when(metric, F.col("scale.anchor_method").isNull()).otherwise(
            F.col("scale.anchor_method").isNotNull() | F.col("scale.confidence").isNotNull() | ~frames_empty),
            "$.scale", "scale, anchor and confidence must agree"),
        _issue(v12 & (F.col("provenance.coordinate_units")
                      != F.when(metric, "ue_centimeters").otherwise("conditional_ue_units")),
               "$.provenance.coordinate_units", "units must agree with metric scale"),
        _issue(v12 & ~metric & (F.size("provenance.assumptions") == 0), "$.provenance.assumptions",
               "conditional geometry requires assumptions"),
        _issue(~v12 & (F.col("scale.anchor_method") == "user_measured"), "$.scale.anchor_method", "value is not allowed"),
        _issue(v13 & (F.col("validity.inter_hand_transform") == local), "$.validity.inter_hand_transform",
               "must match coordinate frame"),
        _issue(local & (known["camera_intrinsics"] | known["camera_distortion"] | F.col("camera.calibrated")),
               "$.camera", "wrist-local output has no shared camera"),
        _issue(shared & ~known["camera_intrinsics"], "$.camera.intrinsics", "shared camera needs intrinsics"),
        _issue(local & (F.size("packets") > 0), "$.packets", "wrist-local output has no packets"),
        _issue(local & F.col("quality.mean_reprojection_error_px").isNotNull(),
               "$.quality.mean_reprojection_error_px", "wrist-local output has no shared-camera residual"),
        _issue(F.exists("scale.anchor_frames", lambda f: f > last), "$.scale.anchor_frames", "frame outside timeline"),
        _issue(F.size(F.array_distinct(F.transform("hands", lambda h: ascii_fold(h.getField("side"))))) < F.size("hands"),
               "$.hands", "duplicate hand side")]
    return _rows(captures, "document", *issues)


def sample_violations(captures: DataFrame) -> DataFrame:
    """Rules of one hand sample that need the document around it."""
    wide = captures.select("clip_id", "format_version", F.col("meta.frame_count").alias("n"),
                           F.col("provenance.coordinate_frame").alias("space"), "hands")
    h = wide.select("*", F.posexplode("hands").alias("hand_index", "hand")).drop("hands")
    s = h.select("clip_id", "format_version", "n", "space", "hand_index", F.col("hand.side").alias("side"),
                 F.posexplode("hand.frames").alias("frame_index", "f"))
    at = F.format_string("$.hands[%d].frames[%d]", "hand_index", "frame_index")
    v12, v13 = F.col("format_version") >= "1.2", F.col("format_version") >= "1.3"
    local = v13 & (F.col("space") == "per_hand_wrist_local")
    missing = F.col("f.sample_kind") == "missing"
    has_translation = F.col("f.global_trans_cm").isNotNull()
    expected = F.when(ascii_fold(F.col("side")) == "left", F.array(*map(F.lit, bone_names("left")[1:]))).otherwise(
        F.array(*map(F.lit, bone_names("right")[1:])))
    keys = F.transform(F.map_keys("f.bone_rotations"), ascii_fold)
    wrist = F.get("f.joint_positions_cm", F.lit(0))
    return _rows(
        s, "sample",
        _issue(F.col("f.frame") >= F.col("n"), F.concat(at, F.lit(".frame")), "frame outside timeline"),
        _issue((F.size(F.array_except(keys, expected)) > 0) | (F.size(F.array_except(expected, keys)) > 0),
               F.concat(at, F.lit(".bone_rotations")), "expected exactly the configured bones"),
        _issue(v12 & (F.col("f.validity.pose") == missing), F.concat(at, F.lit(".validity.pose")),
               "missing must be invalid and a supplied pose valid"),
        _issue(v13 & (F.col("f.validity.global_translation") != has_translation),
               F.concat(at, F.lit(".validity.global_translation")), "must match the translation"),
        _issue(local & has_translation, F.concat(at, F.lit(".global_trans_cm")), "wrist-local translation must be null"),
        _issue(F.col("format_version").isNotNull() & ~local & ~has_translation & v13,
               F.concat(at, F.lit(".global_trans_cm")), "shared-camera translation is required"),
        _issue(local & F.exists(wrist, lambda x: F.abs(x) > 1e-8), F.concat(at, F.lit(".joint_positions_cm[0]")),
               "wrist-local origin must be zero"))


def packet_violations(captures: DataFrame) -> DataFrame:
    """Lifetimes, counts and contact fields of packets."""
    p = docs.packets(captures).join(captures.select("clip_id", "format_version",
                                                    F.col("meta.frame_count").alias("n")), "clip_id")
    at = F.format_string("$.packets[%d]", "packet_index")
    own = _rows(
        p, "packet",
        _issue(F.col("death_frame") < F.col("birth_frame"), F.concat(at, F.lit(".death_frame")), "death before birth"),
        _issue((F.col("birth_frame") >= F.col("n")) | (F.col("death_frame") >= F.col("n")),
               F.concat(at, F.lit(".death_frame")), "frame outside timeline"),
        _issue(F.col("card_count_estimate").isNull() != F.col("card_count_confidence").isNull(),
               F.concat(at, F.lit(".card_count_confidence")), "one of count and confidence without the other"))
    f = docs.packet_frames(captures).join(captures.select("clip_id", "format_version"), "clip_id")
    at_f = F.format_string("$.packets[%d].frames[%d]", "packet_index", "frame_index")
    state = F.col("contact_state")
    ok_state = ascii_fold(state).isin(*CONTACT_STATES) | ((F.col("format_version") >= "1.1") & (state == "UNKNOWN"))
    bones = F.array(*[F.lit(b) for side in ("left", "right") for b in bone_names(side)])
    unknown_bone = F.exists("contact_bones", lambda b: ~F.array_contains(bones, ascii_fold(b)))
    poses = _rows(
        f, "packet_frame",
        _issue(~F.col("frame").between(F.col("birth_frame"), F.col("death_frame")), F.concat(at_f, F.lit(".frame")),
               "frame outside the packet lifetime"),
        _issue(~ok_state, F.concat(at_f, F.lit(".contact_state")), "contact state is not listed"),
        _issue(unknown_bone, F.concat(at_f, F.lit(".contact_bones")), "contact names an unmapped bone"))
    return own.unionByName(poses)


def reference_violations(events: DataFrame, packets: DataFrame, timelines: DataFrame | None = None) -> DataFrame:
    """Events that name packets which are not there, themselves, or too few members; with ``timelines(clip_id, n)``, also
    events outside of 0..n-1."""
    ids = packets.select("clip_id", ascii_fold(F.col("id")).alias("ref")).distinct()
    at = F.format_string("$.events.%s[%d]", "kind", "event_index")
    base = events.select("*", at.alias("path"), ascii_fold(F.col("subject")).alias("__subject"))
    refs = base.select("clip_id", "path", "__subject", F.lit(False).alias("member"), F.col("__subject").alias("ref")).unionByName(
        base.select("clip_id", "path", "__subject", F.lit(True).alias("member"),
                    F.explode("members").alias("ref")).withColumn("ref", ascii_fold(F.col("ref"))))

    def found(rows: DataFrame, message: str) -> DataFrame:
        return rows.select(F.col("clip_id").alias("doc_id"), "path", F.lit("reference").alias("rule"), F.lit(message).alias("message"))

    out = found(refs.join(ids, ["clip_id", "ref"], "left_anti"), "no packet of this id")
    out = out.unionByName(found(refs.filter(F.col("member") & (F.col("ref") == F.col("__subject"))), "subject among its own members"))
    out = out.unionByName(found(base.filter(F.size(F.array_distinct(F.transform("members", ascii_fold))) < 2), "fewer than two members"))
    if timelines is not None:
        late = base.join(timelines.select("clip_id", "n"), "clip_id").filter(~F.col("frame").between(0, F.col("n") - 1))
        out = out.unionByName(found(late, "event outside the timeline"))
    return out


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count")).filter(F.col("count") > 1)


def duplicate_violations(captures: DataFrame) -> DataFrame:
    hands, poses = docs.hand_samples(captures), docs.packet_frames(captures)
    packs, evs = docs.packets(captures), docs.events(captures)

    def found(df, keys, path):
        return duplicate_keys(df, keys).select(F.col(keys[0]).alias("doc_id"), F.lit(path).alias("path"),
                                               F.lit("duplicate").alias("rule"), F.lit("duplicate key").alias("message"))

    fold_id = packs.select("clip_id", ascii_fold(F.col("id")).alias("id"))
    fold_ev = evs.select("clip_id", "kind", "frame", ascii_fold(F.col("subject")).alias("subject"))
    return (found(hands, ["clip_id", "hand_index", "frame"], "$.hands[*].frames[*].frame")
            .unionByName(found(fold_id, ["clip_id", "id"], "$.packets[*].id"))
            .unionByName(found(poses, ["clip_id", "packet_index", "frame"], "$.packets[*].frames[*].frame"))
            .unionByName(found(fold_ev, ["clip_id", "kind", "frame", "subject"], "$.events")))


def range_violations(captures: DataFrame) -> DataFrame:
    """Low-confidence ranges that are reversed, not after the one before, or reach beyond the last frame."""
    r = docs.intervals(captures)

    def found(rows: DataFrame, message: str) -> DataFrame:
        return rows.select(F.col("clip_id").alias("doc_id"),
                           F.format_string("$.quality.low_confidence_ranges[%d]", "interval_index").alias("path"),
                           F.lit("ranges").alias("rule"), F.lit(message).alias("message"))

    last = captures.select("clip_id", (F.col("meta.frame_count") - 1).alias("last"))
    return found(interval_order_issues(r, ["clip_id"], ["interval_index"]), "range not after the one before").unionByName(
        found(r.join(last, "clip_id").filter(F.greatest("start", "end") > F.col("last")), "range beyond the last frame"))


def validate(documents: DataFrame, rules: Sequence[Rule] = CAPTURE_RULES) -> DataFrame:
    """Every violation of every document."""
    table = rule_table(documents.sparkSession, rules)
    caps = cut(docs.typed(documents))  # six families of rules read it
    parts = [field_violations(docs.leaves(documents), table), document_violations(caps), sample_violations(caps),
             packet_violations(caps), reference_violations(docs.events(caps), docs.packets(caps), caps.select("clip_id", F.col("meta.frame_count").alias("n"))),
             duplicate_violations(caps), range_violations(caps)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def first_violation(violations: DataFrame) -> DataFrame:
    return violations.groupBy("doc_id").agg(F.min(F.struct("path", "rule", "message")).alias("v"),
                                            F.count(F.lit(1)).alias("violations")).select("doc_id", "violations", "v.*")


def contract_summary(captures: DataFrame) -> DataFrame:
    """Counts per capture; each fact is counted inside its own document row."""
    def count(c):
        return F.size(F.coalesce(c, F.array()))

    return captures.select(
        "clip_id", "format_version", F.col("meta.frame_count").alias("frame_count"),
        F.size("hands").alias("hands"),
        F.aggregate("hands", F.lit(0), lambda s, h: s + F.size(h.getField("frames"))).alias("hand_samples"),
        F.size("packets").alias("packets"),
        F.aggregate("packets", F.lit(0), lambda s, p: s + F.size(p.getField("frames"))).alias("packet_samples"),
        *[count(F.col(f"events.{k}").cast("array<string>")).alias(k) for k in ("splits", "merges", "releases")])


# ---- other record contracts ---------------------------------------------

def mapping_violations(mapping: DataFrame) -> DataFrame:
    """Bone tree rows (side, joint, parent, bone_name, landmark): order, range and unique names."""
    fold = ascii_fold(F.col("bone_name"))
    rows = mapping.withColumn("__fold", fold)
    dup = rows.groupBy("__fold").agg(F.count(F.lit(1)).alias("__n"))
    joined = rows.join(dup, "__fold")
    issue = F.array_compact(F.array(
        F.when((F.col("joint") == 0) & (F.col("parent") != -1), "wrist parent must be -1"),
        F.when((F.col("joint") > 0) & ~F.col("parent").between(0, F.col("joint") - 1), "parent must precede child"),
        F.when(~is_text(F.col("bone_name")) | (F.col("__fold") == "none"), "invalid bone name"),
        F.when(F.col("__n") > 1, "duplicate bone name"),
        F.when(~F.col("landmark").between(0, 20), "landmark out of range")))
    return joined.select("side", "joint", F.explode(issue).alias("message"))


def bone_mapping(spark) -> DataFrame:
    """The default bone tree as a dimension table of 32 rows."""
    from ..rules import LANDMARK_OF_JOINT
    rows = [(side, j, JOINT_PARENTS[j], bone_names(side)[j], LANDMARK_OF_JOINT[j])
            for side in ("left", "right") for j in range(16)]
    return spark.createDataFrame(rows, "side string, joint int, parent int, bone_name string, landmark int")


def estimate_findings() -> list[Column]:
    """Issues of a hand-estimate row (side, score, landmarks, optional parameter vectors), null where a rule is kept."""
    def shaped(name, size, required=False, unit=False):
        c = F.col(name)
        ok = (F.size(c) == size) & finite_items(c)
        if unit:
            ok = ok & (F.array_min(c) >= 0) & (F.array_max(c) <= 1)
        bad = ~F.coalesce(ok, F.lit(False))
        return F.when(bad if required else (c.isNotNull() & bad), f"{name} must hold {size} finite values")

    def points(name):
        c = F.col(name)
        ok = (F.size(c) == 21) & F.forall(c, lambda p: F.size(p) == 3) & finite_items(F.flatten(c))
        return F.when(~F.coalesce(ok, F.lit(False)), f"{name} must hold 21 finite points")

    score = F.col("handedness_confidence")
    return [
        F.when(~F.coalesce(F.col("side").isin("left", "right"), F.lit(False)), "invalid side"),
        F.when(~F.coalesce(is_number(score) & score.between(0, 1), F.lit(False)), "confidence must be in [0, 1]"),
        points("image_landmarks"), points("world_landmarks_m"),
        F.when(~is_text(F.col("world_coordinate_system")), "coordinate convention must be explicit"),
        shaped("joint_confidences", 21, unit=True), shaped("global_orient", 3), shaped("hand_pose", 45),
        shaped("shape", 10)]


def estimate_issues() -> Column:
    """The issues of a hand-estimate row as an array."""
    return F.array_compact(F.array(*estimate_findings()))


def estimate_violations(estimates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each issue of a hand estimate.

    Each rule is a column of its own: around a filter of the array or inside the generator, none would be compiled.
    """
    findings = estimate_findings()
    named = [f"__m{i}" for i in range(len(findings))]
    rows = estimates.select(*keys, *[m.alias(n) for m, n in zip(findings, named)])
    return rows.select(*keys, F.explode(F.array(*named)).alias("message")).filter(F.col("message").isNotNull())


def prompt_violations(prompts: DataFrame, objects: DataFrame, sources: DataFrame) -> DataFrame:
    """Prompt rows: inside the image, one per (frame, object), every object prompted."""
    p = prompts.join(sources, "clip_id")
    inside = F.forall("points", lambda q: (q.getItem(0) >= 0) & (q.getItem(0) < F.col("width"))
                      & (q.getItem(1) >= 0) & (q.getItem(1) < F.col("height")))
    b = F.col("box")
    box_ok = ((b.getItem(0) >= 0) & (b.getItem(0) < b.getItem(2)) & (b.getItem(2) <= F.col("width"))
              & (b.getItem(1) >= 0) & (b.getItem(1) < b.getItem(3)) & (b.getItem(3) <= F.col("height")))
    none = F.coalesce(F.size("points"), F.lit(0)) <= 0
    issue = F.array_compact(F.array(
        F.when(~F.col("frame").between(0, F.col("frame_count") - 1), "frame outside timeline"),
        F.when(none & b.isNull(), "prompt needs points or a box"),
        F.when(~none & (F.size("points") != F.size("labels")), "every point needs a label"),
        F.when(~none & ~inside, "point outside image"),
        F.when(~none & F.exists("labels", lambda v: ~v.isin(0, 1)), "label must be 0 or 1"),
        F.when(b.isNotNull() & ~F.coalesce(box_ok, F.lit(False)), "invalid box"),
        F.when(~is_text(F.col("provenance_kind")) | ~is_text(F.col("description")), "provenance required"),
        F.when(~F.col("is_ground_truth").eqNullSafe(False), "ground-truth flag must be false")))
    rows = p.select("clip_id", "frame", "object_id", F.explode(issue).alias("message"))
    repeated = duplicate_keys(prompts, ["clip_id", "frame", "object_id"]).select(
        "clip_id", "frame", "object_id", F.lit("more than one prompt").alias("message"))
    stray = prompts.join(objects, ["clip_id", "object_id"], "left_anti").select(
        "clip_id", "frame", "object_id", F.lit("unknown object").alias("message"))
    silent = objects.join(prompts, ["clip_id", "object_id"], "left_anti").select(
        "clip_id", F.lit(None).cast("int").alias("frame"), "object_id", F.lit("object has no prompt").alias("message"))
    unsafe = objects.filter(~is_safe_id(F.col("object_id"))).select(
        "clip_id", F.lit(None).cast("int").alias("frame"), "object_id", F.lit("unsafe object id").alias("message"))
    return rows.unionByName(repeated).unionByName(stray).unionByName(silent).unionByName(unsafe)


def seed_violations(seeds: DataFrame) -> DataFrame:
    """Mask seeds: safe unique ids, one reference frame, recorded area, provenance text."""
    per = seeds.groupBy("clip_id").agg(F.min("frame").alias("__f0"), F.max("frame").alias("__f1"))
    ids = seeds.groupBy("clip_id", "object_id").agg(F.count(F.lit(1)).alias("__n"))
    s = seeds.join(per, "clip_id").join(ids, ["clip_id", "object_id"])
    issue = F.array_compact(F.array(
        F.when(~is_safe_id(F.col("object_id")), "unsafe object id"),
        F.when(F.col("__n") > 1, "duplicate object id"),
        F.when(F.col("__f0") != F.col("__f1"), "seeds must share one reference frame"),
        F.when(~F.coalesce((F.col("area_px") > 0) & (F.col("area_px") == F.col("recorded_area_px")), F.lit(False)),
               "recorded area differs"),
        F.when(~is_sha256(F.col("mask_sha256")), "invalid mask hash"),
        F.when(~is_text(F.col("provenance_kind")) | ~is_text(F.col("selection_provenance")), "provenance required")))
    return s.select("clip_id", "object_id", F.explode(issue).alias("message"))


def timeline_mismatches(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Declared against decoded clip facts: fps (close), resolution and frame count (equal)."""
    j = declared.alias("d").join(actual.alias("a"), "clip_id", "full_outer")
    d, a = F.col("d.fps"), F.col("a.fps")
    close = F.abs(d - a) <= F.greatest(1e-6 * F.greatest(F.abs(d), F.abs(a)), F.lit(1e-4))
    issue = F.array_compact(F.array(
        F.when(~F.coalesce(is_number(a) & (a > 0), F.lit(False)), "no positive frame rate"),
        F.when(~F.coalesce(close, F.lit(False)), "fps differs"),
        F.when(~(F.col("d.width").eqNullSafe(F.col("a.width")) & F.col("d.height").eqNullSafe(F.col("a.height"))),
               "resolution differs"),
        F.when(~F.col("d.frame_count").eqNullSafe(F.col("a.frame_count")), "frame count differs")))
    return j.select("clip_id", F.explode(issue).alias("message"))


def display_config_issues() -> Column:
    """Display rows: positive focal, ratio, and translation = constant + focal * slope."""
    moved = F.exists(F.arrays_zip("translation", "constant", "slope"), lambda z: F.abs(
        z.getField("translation") - (z.getField("constant") + F.col("focal") * z.getField("slope"))) > 1e-5)
    return F.array_compact(F.array(
        F.when(~F.coalesce(is_number(F.col("focal")) & (F.col("focal") > 0), F.lit(False)), "focal must be positive"),
        F.when(F.col("ratio") < 0, "ratio must not be negative"),
        F.when(F.coalesce(moved, F.lit(True)), "translation differs from its equation"),
        F.when(F.abs(F.col("ratio") - F.col("recomputed_ratio")) > 1e-6, "ratio differs")))


def retarget_issues(captures: DataFrame) -> DataFrame:
    """Hands that cannot be posed: sparse, missing, or with the wrong kind of translation."""
    h = captures.select("clip_id", "format_version", F.col("meta.frame_count").alias("n"),
                        (F.col("provenance.coordinate_frame") == "per_hand_wrist_local").alias("local"),
                        F.explode("hands").alias("h"))
    frames = F.col("h.frames")
    dense = F.coalesce(F.transform(frames, lambda f: f.getField("frame")) ==
                       F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0))), F.lit(False))
    v12, v13 = F.col("format_version") >= "1.2", F.col("format_version") >= "1.3"
    absent = F.exists(frames, lambda f: ~F.coalesce(f.getField("validity").getField("pose"), F.lit(False))
                      | (f.getField("sample_kind") == "missing"))
    moved = F.exists(frames, lambda f: f.getField("global_trans_cm").isNotNull() == F.col("local"))
    issue = F.array_compact(F.array(
        F.when(~dense, "frames must be exactly 0..n-1"),
        F.when(v12 & absent, "missing pose cannot be posed"),
        F.when(v13 & moved, "translation does not match the coordinate frame")))
    return h.select("clip_id", F.col("h.side").alias("side"), F.explode(issue).alias("message"))


def quad_issues(corners: Column, min_area: float = 1.0, min_edge: float = 1e-3, min_sine: float = 1e-4) -> Column:
    """Reasons against four cyclic image corners; empty for a convex quad of real size."""
    def measures(c):
        p = [(c.getItem(i).getItem(0), c.getItem(i).getItem(1)) for i in range(4)]
        edge = [(p[(i + 1) % 4][0] - p[i][0], p[(i + 1) % 4][1] - p[i][1]) for i in range(4)]
        turns = [edge[i][0] * edge[(i + 1) % 4][1] - edge[i][1] * edge[(i + 1) % 4][0] for i in range(4)]
        shoelace = [p[i][0] * p[(i + 1) % 4][1] - p[(i + 1) % 4][0] * p[i][1] for i in range(4)]
        return F.struct(F.array(*turns).alias("turn"),
                        F.array(*[F.sqrt(x * x + y * y) for x, y in edge]).alias("length"),
                        (F.abs(shoelace[0] + shoelace[1] + shoelace[2] + shoelace[3]) / 2).alias("area"))

    finite = F.coalesce((F.size(corners) == 4) & F.forall(corners, lambda c: (F.size(c) == 2) & all_numbers(c)),
                        F.lit(False))
    def verdict(m):
        turn, length = m.getField("turn"), m.getField("length")
        shortest = F.array_min(length)
        convex = (F.array_min(turn) > 0) | (F.array_max(turn) < 0)
        sines = [F.abs(turn.getItem(i)) / (length.getItem(i) * length.getItem((i + 1) % 4)) for i in range(4)]
        return F.array_compact(F.array(
            F.when(shortest < min_edge, "edge too short"),
            F.when(~convex, "not convex"),
            F.when((shortest >= min_edge) & (F.least(*sines) < min_sine), "near-collinear corner"),
            F.when(m.getField("area") < min_area, "area too small")))

    return F.when(finite, let(let(corners, measures), verdict)).otherwise(F.array(F.lit("not four finite corners")))
