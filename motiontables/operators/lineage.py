"""Hash-bound lineage: inventories, bindings and reconciliation of independent sources."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .blocks import FRAME_BLOCK, row_numbers


CHUNK = 1 << 22


def file_inventory(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size, sha256) of files of any size.

    Spark lists the files; the task that a file falls to reads it piece by piece, so memory stays at one piece.
    Empty files are not listed: the reader of binary files passes over them.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(path))
    return files.select("path", F.col("length").alias("size")).withColumn("sha256", _file_sha256("path"))


@F.pandas_udf(StringType())
def _file_sha256(paths: pd.Series) -> pd.Series:
    def digest(path: str) -> str:
        if path.startswith("file:"):
            source, place = fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
        else:
            source, place = fs.FileSystem.from_uri(quote(path, safe=":/@"))
        state = hashlib.sha256()
        with source.open_input_stream(place, compression=None) as stream:
            while piece := stream.read(CHUNK):
                state.update(piece)
        return state.hexdigest()

    return paths.map(digest)


def unbound_references(references: DataFrame, inventory: DataFrame, path: str = "path") -> DataFrame:
    """References whose declared hash is not the actual one, or whose file is absent."""
    actual = inventory.select(F.col("path").alias(path), F.col("sha256").alias("actual_sha256"))
    joined = references.join(actual, path, "left")
    return joined.filter(~F.col("declared_sha256").eqNullSafe(F.col("actual_sha256")))


def reconcile(sources: dict[str, DataFrame], keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Compare the same fields of several sources row by row.

    Sources are stacked and grouped once on the key, instead of chained full outer joins:
    one shuffle for any number of sources, with partial aggregation. Result columns:
    ``sources`` seen, ``missing`` sources, ``duplicates`` and ``mismatched`` fields.
    """
    names = list(sources)
    stacked = None
    for name, df in sources.items():
        part = df.select(*keys, F.lit(name).alias("__src"), *fields)
        stacked = part if stacked is None else stacked.unionByName(part)
    aggs = [F.count_if(F.col("__src") == n).alias(f"__n_{n}") for n in names]
    for f in fields:
        # Equal everywhere means minimum = maximum and no mix of null and value.
        aggs.append(((F.min(f) != F.max(f)) | (F.count(f).between(1, F.count(F.lit(1)) - 1))).alias(f"__d_{f}"))
    per = stacked.groupBy(*keys).agg(*aggs)
    absent = F.array_compact(F.array(*[F.when(F.col(f"__n_{n}") == 0, F.lit(n)) for n in names]))
    twice = F.array_compact(F.array(*[F.when(F.col(f"__n_{n}") > 1, F.lit(n)) for n in names]))
    differing = F.array_compact(F.array(*[F.when(F.coalesce(f"__d_{f}", F.lit(False)), F.lit(f)) for f in fields]))
    return per.select(*keys, absent.alias("missing"), twice.alias("duplicates"), differing.alias("mismatched"))


def disagreements(reconciled: DataFrame) -> DataFrame:
    return reconciled.filter((F.size("missing") > 0) | (F.size("duplicates") > 0) | (F.size("mismatched") > 0))


def missing_objects(frames: DataFrame, seeds: DataFrame, observed: DataFrame) -> DataFrame:
    """Seed objects of a clip not observed in one of its frames.

    Frames join seeds on the clip (a clip has a handful of seeds), then observed pairs drop out.
    """
    expected = frames.select("clip_id", "frame").join(seeds.select("clip_id", "object_id"), "clip_id")
    return expected.join(observed.select("clip_id", "frame", "object_id"), ["clip_id", "frame", "object_id"], "left_anti")


def match_exactly_one(selections: DataFrame, candidates: DataFrame, keys: Sequence[str],
                      payload: Sequence[str]) -> DataFrame:
    """Each selection must meet exactly one candidate; the count stays in the result.

    Candidates are folded to one row per key before the join, so repeated candidates
    cannot multiply selections.
    """
    folded = candidates.groupBy(*keys).agg(F.count(F.lit(1)).alias("matches"),
                                           F.min(F.struct(*payload)).alias("__row"))
    joined = selections.join(folded, list(keys), "left")
    out = joined.withColumn("matches", F.coalesce("matches", F.lit(0)))
    return out.select(*selections.columns, "matches",
                      *[F.when(F.col("matches") == 1, F.col(f"__row.{p}")).alias(p) for p in payload])


def inventory_order(actual: DataFrame, manifest: DataFrame, keys: Sequence[str], width: int = FRAME_BLOCK) -> DataFrame:
    """Directory listing against manifest order: numeric stems give the actual position.

    ``actual(keys, file)``, ``manifest(keys, position, file)`` with positions from zero.
    """
    stem = F.regexp_extract("file", r"^(\d+)\.[^.]*$", 1)
    listed = actual.withColumn("__stem", F.when(stem != "", stem.cast("long")))
    numbered = row_numbers(listed.filter(F.col("__stem").isNotNull()), keys, ["__stem", "file"], "__rn", width)
    a = numbered.select(*keys, (F.col("__rn") - 1).alias("position"), F.col("file").alias("actual_file"))
    m = manifest.select(*keys, F.col("position").cast("long").alias("position"), F.col("file").alias("manifest_file"))
    order = a.join(m, [*keys, "position"], "full_outer").filter(
        ~F.col("actual_file").eqNullSafe(F.col("manifest_file")))
    odd = listed.filter(F.col("__stem").isNull()).select(
        *keys, F.lit(None).cast("long").alias("position"), F.col("file").alias("actual_file"),
        F.lit(None).cast("string").alias("manifest_file"))
    return order.unionByName(odd)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one table that the other lacks, with multiplicity; empty means equal."""
    return (a.exceptAll(b).withColumn("only_in", F.lit("first"))
            .unionByName(b.exceptAll(a).withColumn("only_in", F.lit("second"))))


def changed_inputs(before: DataFrame, after: DataFrame) -> DataFrame:
    """Protected files that changed, vanished or appeared between two inventories."""
    b = before.select("path", F.col("sha256").alias("before_sha256"))
    a = after.select("path", F.col("sha256").alias("after_sha256"))
    return b.join(a, "path", "full_outer").filter(~F.col("before_sha256").eqNullSafe(F.col("after_sha256")))


def first_of_copies(df: DataFrame, content: Column, order: Sequence[str]) -> DataFrame:
    """Exact copies as (row, first row of its content): one edge per row, never all pairs."""
    hashed = df.withColumn("__h", F.sha2(content, 256))
    first = hashed.groupBy("__h").agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("copies"))
    return hashed.join(first, "__h").drop("__h")
