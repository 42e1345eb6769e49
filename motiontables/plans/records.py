"""Lineage, lifecycle and job-log queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lifecycle, lineage
from ..sources.warehouse import observations, states, table
from .base import OBS, STATES, Catalog

catalog = Catalog.empty()


@catalog.add("hash_binding", """
WITH h AS (SELECT doc_id, lang, sha256(text) AS actual FROM documents),
d AS (SELECT doc_id, CASE WHEN n_chars < 500 THEN sha256(source) ELSE sha256(text) END AS declared FROM documents)
SELECT d.doc_id AS path, d.declared AS declared_sha256, h.actual AS actual_sha256
FROM d LEFT JOIN h ON h.doc_id = d.doc_id AND h.lang <> 'fr' WHERE d.declared IS DISTINCT FROM h.actual
""")
def hash_binding(spark, base) -> DataFrame:
    d = table(spark, base, "documents")
    inventory = d.filter(F.col("lang") != "fr").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"))
    references = d.select(F.col("doc_id").alias("path"), F.sha2(
        F.when(F.col("n_chars") < 500, F.col("source")).otherwise(F.col("text")), 256).alias("declared_sha256"))
    return lineage.unbound_references(references, inventory)


@catalog.add("exact_copies", """
WITH h AS (SELECT doc_id, sha256(text) AS h FROM documents),
f AS (SELECT h, min(doc_id) AS first_id, count(*) AS copies FROM h GROUP BY h)
SELECT doc_id, first_id, copies FROM h JOIN f USING (h)
""")
def exact_copies(spark, base) -> DataFrame:
    c = lineage.first_of_copies(table(spark, base, "documents").select("doc_id", "text"), F.col("text"), ["doc_id"])
    return c.select("doc_id", F.col("first.doc_id").alias("first_id"), "copies")


@catalog.add("reconcile", """
WITH g AS (SELECT o_orderkey AS k, o_custkey AS a, o_orderstatus AS s FROM orders WHERE o_orderpriority <> '1-URGENT'),
v AS (SELECT o_orderkey AS k, o_custkey AS a, CASE WHEN o_totalprice > 400000 THEN 'X' ELSE o_orderstatus END AS s FROM orders),
l AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
m AS (SELECT k, (SELECT 1 FROM g WHERE g.k = v.k) IS NULL AS no_g, (SELECT 1 FROM l WHERE l.k = v.k) IS NULL AS no_l,
             coalesce((SELECT g.s FROM g WHERE g.k = v.k) <> v.s, false) AS ds FROM v)
SELECT k, concat_ws(',', CASE WHEN no_g THEN 'geometry' END, CASE WHEN no_l THEN 'segmentation' END) AS missing,
       CASE WHEN ds OR NOT no_l THEN 's' ELSE '' END AS mismatched FROM m WHERE no_g OR no_l OR ds OR NOT no_l
""")
def reconcile(spark, base) -> DataFrame:
    """Three sources keyed by order; the third one has no status, which is a mismatch with a value."""
    o = table(spark, base, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"),
                                            "o_orderpriority", "o_totalprice")
    geometry = o.filter(F.col("o_orderpriority") != "1-URGENT")
    visibility = o.withColumn("s", F.when(F.col("o_totalprice") > 400000, "X").otherwise(F.col("s")))
    lines = table(spark, base, "lineitem").select(F.col("l_orderkey").alias("k")).distinct() \
        .withColumn("s", F.lit(None).cast("string"))
    r = lineage.reconcile({"geometry": geometry, "visibility": visibility, "segmentation": lines}, ["k"], ["s"])
    bad = lineage.disagreements(r)
    return bad.select("k", F.concat_ws(",", "missing").alias("missing"), F.concat_ws(",", "mismatched").alias("mismatched"))


@catalog.add("missing_objects", f"""
WITH {OBS}, f AS (SELECT DISTINCT clip_id, frame FROM obs), s AS (SELECT DISTINCT clip_id, kind FROM obs WHERE kind <> 'error'),
o AS (SELECT DISTINCT clip_id, frame, kind FROM obs)
SELECT f.clip_id, f.frame, s.kind AS object_id FROM f JOIN s USING (clip_id)
WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.clip_id = f.clip_id AND o.frame = f.frame AND o.kind = s.kind)
""")
def missing_objects(spark, base) -> DataFrame:
    o = observations(spark, base).select("clip_id", "frame", F.col("kind").alias("object_id")).distinct()
    return lineage.missing_objects(o.select("clip_id", "frame").distinct(),
                                   o.filter("object_id <> 'error'").select("clip_id", "object_id").distinct(), o)


@catalog.add("match_selection", """
WITH c AS (SELECT l_orderkey AS k, count(*) AS n, min(l_partkey) AS p FROM lineitem WHERE l_quantity > 30 GROUP BY 1)
SELECT o_orderkey AS k, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN p END AS l_partkey FROM orders LEFT JOIN c ON k = o_orderkey
""")
def match_selection(spark, base) -> DataFrame:
    selections = table(spark, base, "orders").select(F.col("o_orderkey").alias("k"))
    candidates = table(spark, base, "lineitem").filter(F.col("l_quantity") > 30).select(F.col("l_orderkey").alias("k"), "l_partkey")
    return lineage.match_exactly_one(selections, candidates, ["k"], ["l_partkey"])


@catalog.add("inventory_order", """
WITH a AS (SELECT o_orderstatus AS dir, o_orderkey AS stem, o_totalprice AS price, CAST(o_orderkey AS VARCHAR) || '.jpg' AS file,
             row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS position FROM orders),
m AS (SELECT dir, position, CASE WHEN price > 480000 THEN 'x' || file ELSE file END AS file FROM a WHERE price > 2000)
SELECT dir, position, a.file AS actual_file, m.file AS manifest_file FROM a FULL JOIN m USING (dir, position)
WHERE a.file IS DISTINCT FROM m.file
""")
def inventory_order(spark, base) -> DataFrame:
    o = table(spark, base, "orders")
    listed = o.select(F.col("o_orderstatus").alias("dir"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".jpg")).alias("file"),
                      F.col("o_orderkey").alias("stem"), F.col("o_totalprice").alias("price"))
    placed = lineage.row_numbers(listed, ["dir"], ["stem"], "position", 1 << 12).withColumn("position", F.col("position") - 1)
    manifest = placed.filter(F.col("price") > 2000).select("dir", "position", F.when(
        F.col("price") > 480000, F.concat(F.lit("x"), "file")).otherwise(F.col("file")).alias("file"))
    return lineage.inventory_order(listed.select("dir", "file"), manifest, ["dir"], 1 << 12)


@catalog.add("bundle_differences", """
WITH a AS (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_discount > 0.01),
b AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0.07 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity
      FROM lineitem WHERE l_discount < 0.09)
SELECT *, 'first' AS only_in FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)
UNION ALL SELECT *, 'second' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)
""")
def bundle_differences(spark, base) -> DataFrame:
    li = table(spark, base, "lineitem")
    a = li.filter(F.col("l_discount") > 0.01).select("l_orderkey", "l_linenumber", "l_quantity")
    b = li.filter(F.col("l_discount") < 0.09).select("l_orderkey", "l_linenumber", F.when(
        F.col("l_tax") > 0.07, F.col("l_quantity") + 1).otherwise(F.col("l_quantity")).alias("l_quantity"))
    return lineage.differences(a, b)


@catalog.add("debounce_states", f"""
WITH {STATES},
o AS (SELECT *, row_number() OVER w AS rn, lag(state) OVER w AS p, row_number() OVER w = 1 AS is_first FROM states
      WINDOW w AS (PARTITION BY clip_id ORDER BY at_ms, seq)),
g AS (SELECT *, sum(CASE WHEN is_first OR p IS DISTINCT FROM state THEN 1 ELSE 0 END)
        OVER (PARTITION BY clip_id ORDER BY rn) AS island FROM o),
i AS (SELECT clip_id, island, min(at_ms) AS "start", min(rn) AS first_row, count(*) AS n, min(state) AS value FROM g GROUP BY 1, 2),
k AS (SELECT *, lag(value) OVER (PARTITION BY clip_id ORDER BY island) AS previous FROM i WHERE value IS NOT NULL AND n >= 2)
SELECT clip_id, "start", first_row, first_row + 1 AS confirmed_row, value, previous FROM k WHERE previous IS NULL OR previous <> value
""")
def debounce_states(spark, base) -> DataFrame:
    c = lifecycle.confirmed_states(states(spark, base), ["clip_id"], ["at_ms", "seq"], "state", 2, width=86400000)
    return c.select("clip_id", "start", "first_row", "confirmed_row", "value", "previous")


@catalog.add("state_islands", f"""
WITH {STATES},
o AS (SELECT *, row_number() OVER w AS rn, lag(state) OVER w AS p FROM states WINDOW w AS (PARTITION BY clip_id ORDER BY at_ms, seq)),
g AS (SELECT *, sum(CASE WHEN rn = 1 OR p IS DISTINCT FROM state THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY rn) AS island FROM o)
SELECT clip_id, CAST(island AS BIGINT) AS island, min(at_ms) AS "start", max(at_ms) AS "end", count(*) AS rows, min(state) AS value FROM g GROUP BY clip_id, island
""")
def state_islands(spark, base) -> DataFrame:
    i = lifecycle.islands(states(spark, base), ["clip_id"], ["at_ms", "seq"], "state", 86400000)
    return i.select("clip_id", "island", "start", "end", "rows", "value")


@catalog.add("group_overlaps", """
WITH a AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS g, l_suppkey AS m FROM lineitem),
b AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS g, l_suppkey AS m FROM lineitem WHERE l_discount >= 0.05)
SELECT k, a.g AS old_id, b.g AS new_id, count(*) AS shared FROM a JOIN b USING (k, m) GROUP BY k, a.g, b.g
""")
def group_overlaps(spark, base) -> DataFrame:
    """Per order: groups of suppliers by return flag against groups by line number."""
    li = table(spark, base, "lineitem").withColumn("k", F.col("l_orderkey"))

    def groups(df, key):
        return df.groupBy("k", F.col(key).alias("group_id")).agg(F.collect_set("l_suppkey").alias("members"))

    new = li.filter(F.col("l_discount") >= 0.05)
    return lifecycle.group_overlaps(groups(li, "l_returnflag"), groups(new, "l_linenumber"), ["k"])


# Three partitions of four members, each a split or a merge of any other; six-hour slots without an event are holes.
MEMBERS = f"""{OBS},
one AS (SELECT clip_id, frame, min(det_idx) AS id FROM obs GROUP BY clip_id, frame),
m AS (SELECT one.clip_id, one.frame, CASE WHEN obs.kind = 'error' THEN NULL WHEN id % 3 = 0 THEN 'a,b,c,d' WHEN id % 3 = 1 THEN 'a,b|c,d' ELSE 'a|b|c,d' END AS p
      FROM one JOIN obs ON obs.det_idx = one.id)"""


@catalog.add("lifecycle_changes", f"""
WITH {MEMBERS},
o AS (SELECT *, lag(p) OVER w AS q, lag(frame) OVER w AS f FROM m WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
g AS (SELECT *, sum(CASE WHEN f IS NULL OR frame <> f + 1 OR p IS DISTINCT FROM q THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame) AS run FROM o),
r AS (SELECT clip_id, run, min(frame) AS s, max(frame) AS e, count(*) >= 2 AS long, min(p) AS value FROM g WHERE p IS NOT NULL GROUP BY clip_id, run),
b AS (SELECT *, last_value(CASE WHEN long THEN value END IGNORE NULLS) OVER (PARTITION BY clip_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM r),
l AS (SELECT *, last_value(CASE WHEN long OR previous = value THEN e END IGNORE NULLS)
        OVER (PARTITION BY clip_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_old FROM b)
SELECT clip_id, s AS start, s + 1 AS confirmed_at, value, previous, last_old, true AS accepted FROM l WHERE long AND previous IS DISTINCT FROM value
""")
def lifecycle_changes(spark, base) -> DataFrame:
    """Splits and merges that two frames in a row confirm; a frame without observation confirms nothing."""
    rows = observations(spark, base).groupBy("clip_id", "frame").agg(F.min(F.struct("det_idx", "kind")).alias("one"))
    text = F.when(F.col("one.kind") == "error", None).otherwise(F.element_at(F.array(
        F.lit("a,b,c,d"), F.lit("a,b|c,d"), F.lit("a|b|c,d")), (F.col("one.det_idx") % 3 + 1).cast("int")))
    changes = lifecycle.lifecycle_changes(rows.select("clip_id", "frame", lifecycle.parse_partition(text).alias("groups")), confirmation=2)
    return changes.select("clip_id", "start", "confirmed_at", "value", "previous", "last_old", "accepted")
