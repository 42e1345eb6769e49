"""Contract queries: rule tables, references, duplicates, re-nesting, upgrades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ascii_fold, digest
from ..operators import contract
from ..rules import Rule
from ..sources import captures as docs
from ..sources.warehouse import observations, table
from .base import OBS, Catalog

catalog = Catalog.empty()


def _key(*columns):
    return F.concat_ws("-", *columns)


@catalog.add("contract_violations", """
WITH d AS (SELECT event_id, event_type, value, CAST(regexp_extract(props, '"k": *(-?[0-9.]+)', 1) AS DOUBLE) AS k FROM events),
v AS (
  SELECT CAST(event_id AS VARCHAR) AS doc_id, '$.k' AS path, 'integer' AS rule, 'above maximum' AS message FROM d WHERE k > 80
  UNION ALL SELECT CAST(event_id AS VARCHAR), '$.k', 'integer', 'below minimum' FROM d WHERE k < 5
  UNION ALL SELECT CAST(event_id AS VARCHAR), '$.kind', 'string', 'value is not allowed' FROM d WHERE event_type = 'error'
  UNION ALL SELECT CAST(event_id AS VARCHAR), '$.score', 'number', 'null is not allowed in this version' FROM d
    WHERE event_type = 'signup' AND event_id % 4 < 2
  UNION ALL SELECT CAST(event_id AS VARCHAR), '$.score', 'number', 'must be positive' FROM d
    WHERE event_type <> 'signup' AND value - 1 <= 0)
SELECT * FROM v
""")
def contract_violations(spark, base) -> DataFrame:
    """Each event is a small document; versions 1.0..1.3 by id decide where null is allowed."""
    e = table(spark, base, "events")
    k = F.regexp_extract("props", r'"k": *(-?[0-9.]+)', 1)
    score = F.when(F.col("event_type") == "signup", "null").otherwise((F.col("value") - 1).cast("string"))
    text = F.concat(F.lit('{"format_version": "1.'), (F.col("event_id") % 4).cast("string"),
                    F.lit('", "K": '), k, F.lit(', "kind": "'), F.col("event_type"), F.lit('", "score": '), score, F.lit("}"))
    documents = e.select(F.col("event_id").cast("string").alias("doc_id"), text.alias("text"))
    rules = (Rule("$.k", "integer", low=5, high=80), Rule("$.kind", "string", enum=("click", "view", "signup", "purchase")),
             Rule("$.score", "number", nullable_since="1.2", positive=True))
    return contract.field_violations(docs.leaves(documents), contract.rule_table(spark, rules))


@catalog.add("missing_fields", """
SELECT CAST(event_id AS VARCHAR) AS doc_id, '$.j' AS path, 'required' AS rule, 'no value at this path' AS message FROM events
UNION ALL SELECT CAST(event_id AS VARCHAR), '$.k', 'quaternion', 'expected quaternion' FROM events
""")
def missing_fields(spark, base) -> DataFrame:
    documents = table(spark, base, "events").select(F.col("event_id").cast("string").alias("doc_id"),
                                                    F.col("props").alias("text"))
    rules = (Rule("$.j", "number"), Rule("$.k", "quaternion"))
    return contract.field_violations(docs.leaves(documents), contract.rule_table(spark, rules))


@catalog.add("duplicate_keys", f"""
WITH {OBS} SELECT clip_id, frame, side, count(*) AS "count" FROM obs GROUP BY clip_id, frame, side HAVING count(*) > 1
""")
def duplicate_keys(spark, base) -> DataFrame:
    return contract.duplicate_keys(observations(spark, base), ["clip_id", "frame", "side"])


@catalog.add("reference_check", """
WITH ids AS (SELECT DISTINCT lower(p_brand) AS ref FROM part WHERE p_size > 30),
ev AS (SELECT p_partkey, lower(p_brand) AS subject, 'brand#' || CAST(p_size % 30 AS VARCHAR) AS m1,
              'brand#' || CAST((p_size + p_partkey % 3) % 30 AS VARCHAR) AS m2 FROM part),
refs AS (SELECT p_partkey, subject, subject AS ref, false AS member FROM ev
         UNION ALL SELECT p_partkey, subject, m1, true FROM ev UNION ALL SELECT p_partkey, subject, m2, true FROM ev)
SELECT '$.events.splits[' || CAST(p_partkey AS VARCHAR) || ']' AS path, message, count(*) AS "count" FROM (
  SELECT p_partkey, 'no packet of this id' AS message FROM refs WHERE ref NOT IN (SELECT ref FROM ids)
  UNION ALL SELECT p_partkey, 'subject among its own members' FROM refs WHERE member AND ref = subject
  UNION ALL SELECT p_partkey, 'fewer than two members' FROM ev WHERE m1 = m2) v
GROUP BY p_partkey, message
""")
def reference_check(spark, base) -> DataFrame:
    """Parts play split events whose members are brands; brands of large parts are the packets."""
    p = table(spark, base, "part").withColumn("clip_id", F.lit("all"))
    size = F.col("p_size")
    events = p.select("clip_id", F.lit("splits").alias("kind"), F.col("p_partkey").alias("event_index"),
                      F.col("p_brand").alias("subject"),
                      F.array(F.concat(F.lit("BRAND#"), (size % 30).cast("string")),
                              F.concat(F.lit("brand#"), ((size + F.col("p_partkey") % 3) % 30).cast("string")))
                      .alias("members"))
    packets = p.filter(size > 30).select("clip_id", F.col("p_brand").alias("id"))
    v = contract.reference_violations(events, packets)
    return v.groupBy("path", "message").agg(F.count(F.lit(1)).alias("count"))


@catalog.add("timeline_mismatches", """
WITH d AS (SELECT o_orderkey AS clip_id, 30.0 AS fps, o_custkey % 3 AS width, o_custkey % 2 AS height, 4 AS frame_count FROM orders),
a AS (SELECT l_orderkey AS clip_id, max(CASE WHEN l_discount > 0.05 THEN 30.00005 ELSE 30.0002 END) AS fps,
             min(l_suppkey % 3) AS width, min(l_suppkey % 2) AS height, count(*) AS frame_count FROM lineitem GROUP BY l_orderkey),
j AS (SELECT coalesce(d.clip_id, a.clip_id) AS clip_id, d.fps AS df, a.fps AS af, d.width AS dw, a.width AS aw,
             d.height AS dh, a.height AS ah, d.frame_count AS dn, a.frame_count AS an FROM d FULL JOIN a ON d.clip_id = a.clip_id)
SELECT clip_id, 'no positive frame rate' AS message FROM j WHERE af IS NULL
UNION ALL SELECT clip_id, 'fps differs' FROM j WHERE NOT coalesce(abs(df - af) <= greatest(1e-6 * greatest(df, af), 1e-4), false)
UNION ALL SELECT clip_id, 'resolution differs' FROM j WHERE dw IS DISTINCT FROM aw OR dh IS DISTINCT FROM ah
UNION ALL SELECT clip_id, 'frame count differs' FROM j WHERE dn IS DISTINCT FROM an
""")
def timeline_mismatches(spark, base) -> DataFrame:
    declared = table(spark, base, "orders").select(
        F.col("o_orderkey").alias("clip_id"), F.lit(30.0).alias("fps"), (F.col("o_custkey") % 3).alias("width"),
        (F.col("o_custkey") % 2).alias("height"), F.lit(4).cast("long").alias("frame_count"))
    actual = table(spark, base, "lineitem").groupBy(F.col("l_orderkey").alias("clip_id")).agg(
        F.max(F.when(F.col("l_discount") > 0.05, 30.00005).otherwise(30.0002)).alias("fps"),
        F.min(F.col("l_suppkey") % 3).alias("width"), F.min(F.col("l_suppkey") % 2).alias("height"),
        F.count(F.lit(1)).alias("frame_count"))
    return contract.timeline_mismatches(declared, actual)


@catalog.add("quad_checks", """
WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS w, l_suppkey % 7 - 3.0 AS dx, l_partkey % 5 AS dy FROM lineitem),
c AS (SELECT *, 0.0 AS x0, 0.0 AS y0, w AS x1, 0.0 AS y1, w + dx AS x2, dy * 1.0 AS y2, 0.0 AS x3, 10.0 AS y3 FROM q),
e AS (SELECT *, x1-x0 AS ax, y1-y0 AS ay, x2-x1 AS bx, y2-y1 AS by_, x3-x2 AS cx, y3-y2 AS cy, x0-x3 AS ex, y0-y3 AS ey FROM c),
t AS (SELECT *, ax*by_-ay*bx AS t1, bx*cy-by_*cx AS t2, cx*ey-cy*ex AS t3, ex*ay-ey*ax AS t4,
        sqrt(ax*ax+ay*ay) AS l1, sqrt(bx*bx+by_*by_) AS l2, sqrt(cx*cx+cy*cy) AS l3, sqrt(ex*ex+ey*ey) AS l4,
        abs(x0*y1-x1*y0 + x1*y2-x2*y1 + x2*y3-x3*y2 + x3*y0-x0*y3) / 2 AS area FROM e)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(';',
  CASE WHEN least(l1,l2,l3,l4) < 1e-3 THEN 'edge too short' END,
  CASE WHEN NOT (least(t1,t2,t3,t4) > 0 OR greatest(t1,t2,t3,t4) < 0) THEN 'not convex' END,
  CASE WHEN least(l1,l2,l3,l4) >= 1e-3 AND least(abs(t1)/(l1*l2), abs(t2)/(l2*l3), abs(t3)/(l3*l4), abs(t4)/(l4*l1)) < 1e-4
       THEN 'near-collinear corner' END,
  CASE WHEN area < 1.0 THEN 'area too small' END) AS issues FROM t
""")
def quad_checks(spark, base) -> DataFrame:
    li = table(spark, base, "lineitem")
    w, dx = F.col("l_quantity"), F.col("l_suppkey") % 7 - 3.0
    dy = (F.col("l_partkey") % 5).cast("double")
    corners = F.array(F.array(F.lit(0.0), F.lit(0.0)), F.array(w, F.lit(0.0)), F.array(w + dx, dy),
                      F.array(F.lit(0.0), F.lit(10.0)))
    q = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", corners.alias("corners"))
    return q.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.concat_ws(";", contract.quad_issues(F.col("corners"))).alias("issues"))


@catalog.add("renest_roundtrip", """
SELECT o_orderkey, o_custkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice
FROM orders JOIN lineitem ON o_orderkey = l_orderkey
""")
def renest_roundtrip(spark, base) -> DataFrame:
    """Order lines nested into one document per order, then read back from the JSON text."""
    o, li = table(spark, base, "orders"), table(spark, base, "lineitem")
    rows = o.join(li, o.o_orderkey == li.l_orderkey)
    fields = ["o_custkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    nested = docs.renest(rows, "o_orderkey", ["l_linenumber", "l_partkey"], fields)
    schema = ("o_orderkey bigint, frames array<struct<l_linenumber int, l_partkey bigint, o_custkey bigint, "
              "l_suppkey bigint, l_quantity double, l_extendedprice double>>")
    back = nested.select(F.from_json("document", schema).alias("d")).select("d.o_orderkey", F.inline("d.frames"))
    return back.select("o_orderkey", *fields)


@catalog.add("upgrade_preserves", """
SELECT doc_id, '1.1' AS format_version, sha256(text) AS text_sha256, sha256(source) AS source_sha256, 0 AS changed FROM documents
""")
def upgrade_preserves(spark, base) -> DataFrame:
    """Documents wrapped as version 1.0 records, upgraded, and read back: only the version moved, at no other path a value."""
    d = table(spark, base, "documents")
    wrapped = d.select(F.col("doc_id").cast("string").alias("doc_id"), F.to_json(F.struct(
        F.lit("1.0").alias("format_version"), "text", "source")).alias("text"))
    up = docs.upgrade_version(wrapped)
    parsed = up.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.from_json("text", "format_version string, text string, source string").alias("d"))
    changed = docs.preserved(wrapped, up).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("changed"))
    return parsed.join(changed, "doc_id", "left").select(
        "doc_id", "d.format_version", F.sha2("d.text", 256).alias("text_sha256"), F.sha2("d.source", 256).alias("source_sha256"),
        F.coalesce("changed", F.lit(0)).alias("changed"))


@catalog.add("ascii_folding", """
SELECT doc_id, sha256(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS folded,
       sha256('v' || CAST(doc_id AS VARCHAR) || chr(31) || 'v' || lang || chr(31) || 'n') AS leaf_digest FROM documents
""")
def ascii_folding(spark, base) -> DataFrame:
    d = table(spark, base, "documents")
    return d.select("doc_id", F.sha2(ascii_fold(F.col("text")), 256).alias("folded"),
                    digest(F.col("doc_id"), F.col("lang"), F.lit(None).cast("string")).alias("leaf_digest"))
