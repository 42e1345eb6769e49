"""Capture documents: strict reading, leaf table, typed facts, re-nesting, upgrade."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import variant
from ..schemas import CAPTURE

MAP_FIELDS = ("bone_rotations",)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) with one row per file and the byte-order mark removed."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.col("_metadata.file_path").alias("doc_id"),
                      F.regexp_replace("value", "^﻿", "").alias("text"))


def spread(documents: DataFrame) -> DataFrame:
    """The documents over all tasks: reading one costs far more than moving it, and many come in one file."""
    return documents.repartition(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), "doc_id")


def parsed(documents: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, v, nodes, bad): each document as a VARIANT, every node of its tree, or why it cannot be read.

    A document is refused if it is not one JSON object and nothing else, repeats a key (ASCII case ignored) or holds
    a number beyond double, or nests deeper than ``variant.LEVELS``. It is a projection: no shuffle and no Python.
    """
    rows = documents.select("doc_id", *keep, F.expr(variant.whole_document("text")).alias("v"))
    rows = rows.withColumn("level_0", F.expr(f"CASE WHEN v IS NOT NULL THEN array({variant.node("'$'", "'$'", "v")}) END"))
    for i in range(variant.LEVELS):
        step = f"transform(level_{i}, n -> {variant.children('n', MAP_FIELDS)})"
        rows = rows.withColumn(f"level_{i + 1}", F.expr(f"flatten(filter({step}, c -> size(c) > 0))"))
    levels = [f"level_{i}" for i in range(variant.LEVELS + 1)]
    rows = rows.select("doc_id", *keep, "v", F.concat(*levels).alias("nodes"), (F.size(levels[-1]) > 0).alias("deep"))
    keys = variant.let(variant.folded_keys("n.v"), "k", "size(array_distinct(k)) < size(k)")
    infinite = f"abs({variant.number('x')}) = double('Infinity')"
    bad = f"""CASE WHEN v IS NULL THEN 'not one JSON document' WHEN get(nodes, 0).kind <> 'object' THEN 'expected object'
        WHEN deep THEN 'nested too deeply' WHEN exists(nodes, n -> n.kind = 'object' AND {keys}) THEN 'duplicate object key'
        WHEN exists(nodes, n -> exists(CASE n.kind WHEN 'number' THEN array(n.v) WHEN 'numbers' THEN {variant.items('n.v')} END, x -> {infinite}))
        THEN 'nonfinite number' END"""
    return rows.select("doc_id", *keep, "v", "nodes", F.expr(bad).alias("bad"))


def leaves(documents: DataFrame, version_path: str = "$.format_version") -> DataFrame:
    """One row per node of a JSON document with the document's version; an unreadable document is one ``invalid`` row at ``$``."""
    version = variant.string(f"get(filter(nodes, n -> n.path = '{version_path}' AND n.kind = 'string'), 0).v")
    none = "array(named_struct('path', '$', 'pattern', '$', 'kind', 'invalid', 'v', CAST(NULL AS VARIANT)))"
    rows = parsed(spread(documents.select("doc_id", "text"))).selectExpr("doc_id", "bad", f"coalesce({version}, '1.0') AS version",
                                        f"explode(CASE WHEN bad IS NULL THEN nodes ELSE {none} END) AS n").select("doc_id", "bad", "version", "n.*")
    rows = rows.withColumn("number", F.expr(f"CASE kind WHEN 'number' THEN {variant.number('v')} END")).withColumn(
        "numbers", F.expr(f"CASE kind WHEN 'numbers' THEN transform({variant.items('v')}, x -> {variant.number('x')}) END"))
    return rows.selectExpr(
        "doc_id", "version", "path", "pattern", "kind", "number",
        "coalesce(number = floor(number), forall(numbers, x -> x = floor(x))) AS is_integral",
        f"""CASE WHEN kind = 'invalid' THEN bad WHEN kind = 'string' THEN {variant.string('v')}
            WHEN kind IN ('number', 'numbers') THEN concat_ws(' ', schema_of_variant(v), to_json(v)) END AS text""",
        f"CASE kind WHEN 'boolean' THEN {variant.boolean('v')} END AS flag",
        f"""CASE WHEN kind = 'string' THEN length({variant.string('v')}) WHEN kind = 'object' THEN size({variant.entries('v')})
            WHEN kind IN ('list', 'numbers', 'strings') THEN size({variant.items('v')}) END AS size""",
        "numbers",
        f"""CASE kind WHEN 'strings' THEN transform({variant.items('v')}, x -> {variant.string('x')})
            WHEN 'object' THEN {variant.folded_keys('v')} END AS strings""")


def typed(documents: DataFrame) -> DataFrame:
    """Typed capture per readable document; ``doc_id`` becomes ``clip_id``.

    A plain text is marked, parsed once and cast to the type of each field that is asked for; the walk over all nodes
    is left for the others (escapes, huge numbers, deep nesting).
    """
    rows = spread(documents.select("doc_id", "text")).withColumn("plain", F.expr(f"coalesce({variant.is_plain('text')}, false)"))
    rows = rows.withColumn("marked", F.expr(f"CASE WHEN plain THEN {variant.marked('text')} END"))
    rows = rows.select("doc_id", "plain", F.expr(variant.whole_document("marked")).alias("m"), F.expr("CASE WHEN NOT plain THEN text END").alias("text"))
    # A filter would be pushed down, and carry the whole tree of levels with it; a generator stays where it is.
    readable = parsed(rows, ("plain", "m")).selectExpr(
        "CAST(doc_id AS STRING) AS clip_id", "plain", "explode(CASE WHEN m IS NOT NULL OR bad IS NULL THEN array(struct(m, v)) ELSE array() END) AS d")
    members = readable.selectExpr("clip_id", "plain", "d.m AS m", f"CASE WHEN NOT plain THEN {variant.folded_map('d.v', 'e', 'e.value')} END AS members")
    fields = T._parse_datatype_string(CAPTURE).fields
    cast = members.selectExpr("clip_id", "plain", "members", *[
        f"try_variant_get(m, '$.{f.name}', '{variant.raw(f.dataType)}') AS {f.name}" for f in fields])
    return cast.selectExpr("clip_id", *[
        f"CASE WHEN plain THEN {variant.unmarked(f.name, f.dataType)} ELSE {variant.shaped(f'try_element_at(members, {f.name!r})', f.dataType)} END AS {f.name}"
        for f in fields])


# ---- facts --------------------------------------------------------------

def hand_samples(captures: DataFrame) -> DataFrame:
    h = captures.select("clip_id", F.posexplode("hands").alias("hand_index", "hand"))
    f = h.select("clip_id", "hand_index", F.col("hand.side").alias("side"),
                 F.posexplode("hand.frames").alias("frame_index", "f"))
    return f.select("clip_id", "hand_index", "side", "frame_index", "f.*")


def packets(captures: DataFrame) -> DataFrame:
    return captures.select("clip_id", F.posexplode("packets").alias("packet_index", "p")) \
        .select("clip_id", "packet_index", "p.*")


def packet_frames(captures: DataFrame) -> DataFrame:
    p = packets(captures)
    return p.select("clip_id", "packet_index", "id", "birth_frame", "death_frame",
                    F.posexplode("frames").alias("frame_index", "f")) \
        .select("clip_id", "packet_index", "id", "birth_frame", "death_frame", "frame_index", "f.*")


def events(captures: DataFrame) -> DataFrame:
    """(clip_id, kind, event_index, frame, subject, members) of all three event kinds."""
    def of(kind: str, subject: str, members: str | None) -> Column:
        return F.transform(F.coalesce(F.col(f"events.{kind}"), F.array()), lambda e, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("event_index"), e.getField("frame").alias("frame"),
            e.getField(subject).alias("subject"),
            (e.getField(members) if members else F.lit(None).cast("array<string>")).alias("members")))

    return captures.select("clip_id", F.inline(F.concat(
        of("splits", "source", "results"), of("merges", "result", "sources"), of("releases", "packet", None))))


def intervals(captures: DataFrame) -> DataFrame:
    r = captures.select("clip_id", F.posexplode("quality.low_confidence_ranges").alias("interval_index", "r"))
    return r.select("clip_id", "interval_index", F.get("r", F.lit(0)).alias("start"),
                    F.get("r", F.lit(1)).alias("end"))


# ---- documents from facts -----------------------------------------------

def renest(rows: DataFrame, key: str, order: list[str], fields: list[str], name: str = "frames") -> DataFrame:
    """One row per key with its rows as an ordered array, and the JSON text of it.

    A document is whole by definition; rows combine per key once, ordered inside the row.
    """
    item = F.struct(*order, *[f for f in fields if f not in order])
    nested = rows.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias(name))
    return nested.withColumn("document", F.to_json(F.struct(key, name), {"ignoreNullFields": "false"}))


TOKEN = re.compile(r'"(?:\\.|[^"\\])*"|[{}\[\]:]')


def _top_version(text: str, source: str) -> tuple[int, int] | None:
    """Where the document's own version stands in its text; versions of nested objects are not its own."""
    depth, tokens = 0, list(TOKEN.finditer(text))
    for key, colon, value in zip(tokens, tokens[1:], tokens[2:]):
        depth += {"{": 1, "[": 1, "}": -1, "]": -1}.get(key[0], 0)
        if depth == 1 and key[0].lower() == '"format_version"' and colon[0] == ":" and value[0] == f'"{source}"':
            return value.span()
    return None


def upgrade_version(documents: DataFrame, source: str = "1.0", target: str = "1.1") -> DataFrame:
    """Rewrite only the document's own ``format_version``; all else, nested versions too, stays byte for byte."""
    @F.pandas_udf("string")
    def upgraded(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            span = _top_version(text, source) if text else None
            return f'{text[:span[0]]}"{target}"{text[span[1]:]}' if span else text
        return texts.map(one)

    return documents.withColumn("text", upgraded("text"))


def preserved(before: DataFrame, after: DataFrame) -> DataFrame:
    """Leaves, other than the version, that differ between two document sets (should be none).

    Number leaves keep their type, so 1 and 1.0 differ as they do in JSON.
    """
    def fingerprint(documents, tag):
        flat = leaves(documents).filter(F.col("path") != "$.format_version")
        digest = F.sha2(F.to_json(F.struct("kind", "number", "is_integral", "text", "flag", "size", "numbers",
                                           "strings"), {"ignoreNullFields": "false"}), 256)
        return flat.select("doc_id", "path", digest.alias(tag))

    joined = fingerprint(before, "before").join(fingerprint(after, "after"), ["doc_id", "path"], "full_outer")
    return joined.filter(~F.col("before").eqNullSafe(F.col("after")))
