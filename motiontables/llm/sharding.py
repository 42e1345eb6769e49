"""Shards of equal bytes by histogram sort.

Rows are ordered by a key, the 64-bit hash of the text and then a hash of the row, so equal texts lie next to
each other. A shard is a range of keys. Where the ranges end is found by counting: each round sums the exact
bytes of all rows between candidate keys, a few thousand cells of equal width inside the intervals that still
hold a wanted border, and keeps for each border the one cell that holds it. A border is settled as soon as a
candidate lies within ``tolerance`` of its target; texts decide first, so copies part only where no border
between two texts is near enough. What reaches the driver is the sums of the cells, whose number depends on the
number of shards alone. Rows then are exchanged once, by shard and block: blocks are ranges of the row's hash,
so that a shard is no single task's, and the sums of the blocks before give each row its place.

Everything is DataFrame operators. Keys and sizes are written to the shared folder before the first round, with
the columns to be carried along: the rounds read two numbers a row, and a lost executor repeats no hash.

Defined cases: a null text has size 1, as an empty one; null ids are rows like others; repeated rows are
separate rows, which the row's hash parts; an empty table gives no rows; where one text is larger than a share,
some shards may be empty; further columns are carried if asked for, under their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

ROUND_BITS = 10  # each interval is cut into so many bits' worth of cells a round
BLOCK_ROWS = 1 << 16
LEAST = -(1 << 63)
LEVELS = ("k1", "k2")


def prefix(level: str, bits: int) -> Column:
    return F.shiftright(level, 64 - bits) if bits else F.lit(0).cast("long")


def splitters(keyed: DataFrame, shards: int, tolerance: float) -> list[tuple[int, int]]:
    """The first key (k1, k2) of each shard but the first, with the bytes below it next to its share of all bytes."""
    total = keyed.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    found: dict[int, tuple[int, int]] = {}
    # Where a border is known to lie: level, the text's hash once it is settled, leading bits and their number, bytes below.
    wanted = {i: ("k1", None, 0, 0, 0) for i in range(1, shards)}
    while wanted:
        depth = {(level, bits) for level, _, _, bits, _ in wanted.values()}
        step = {}
        for level, bits in sorted(depth):
            more = min(64, bits + ROUND_BITS)
            inside = {(text, lead) for at, text, lead, b, _ in wanted.values() if (at, b) == (level, bits)}
            rows = keyed if not bits else keyed.where(prefix(level, bits).isin(sorted({lead for _, lead in inside})))
            if level == "k2":
                rows = rows.where(F.col("k1").isin(sorted({text for text, _ in inside})))
            cells = rows.groupBy(*([F.col("k1").alias("text")] if level == "k2" else [F.lit(None).cast("long").alias("text")]),
                                 prefix(level, more).alias("cell")).agg(
                                     F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min(level).alias("low"), F.max(level).alias("high"))
            for r in cells.collect():
                step.setdefault((level, r.text, more), []).append((r.cell, r.bytes, r.n, r.low, r.high))
        for cells in step.values():
            cells.sort()
        for i, (level, text, lead, bits, below) in list(wanted.items()):
            more = min(64, bits + ROUND_BITS)
            target = i * total / shards
            at = (level, text, lead, bits, below)
            own = [c for c in step.get((level, text, more), []) if not bits or c[0] >> (more - bits) == lead]
            for cell, size, n, low, high in own:
                if below + size > target or cell == own[-1][0]:
                    first, after = abs(target - below), abs(below + size - target)
                    if min(first, after) <= slack or n == 1 or (level == "k2" and low == high):
                        found[i] = border(level, text, low if first <= after else high + 1)
                    elif low == high:
                        at = ("k2", low, 0, 0, below)
                    else:
                        at = (level, text, cell, more, below)
                    break
                below += size
            if i in found or not own:
                found.setdefault(i, (LEAST, LEAST))
                del wanted[i]
            else:
                wanted[i] = at
    return [found[i] for i in range(1, shards)]


def border(level: str, text: int | None, edge: int) -> tuple[int, int]:
    """The first key at or after ``edge``; an edge past all numbers is the beginning of the next text, or past all keys."""
    if level == "k1":
        return (edge, LEAST) if edge < -LEAST else (-LEAST - 1, -LEAST - 1)
    return (text, edge) if edge < -LEAST else border("k1", None, text + 1)


def shard_of(edges: list[tuple[int, int]], first: int = 0) -> Column:
    """The number of borders at or below the row's key, as a tree of comparisons."""
    if not edges:
        return F.lit(first)
    mid = len(edges) // 2
    k1, k2 = edges[mid]
    reached = (F.col("k1") > k1) | ((F.col("k1") == k1) & (F.col("k2") >= k2))
    return F.when(reached, shard_of(edges[mid + 1:], first + mid + 1)).otherwise(shard_of(edges[:mid], first))


def sharded(docs: DataFrame, shards: int = 16, tolerance: float = 0.01, columns: list[str] | None = None) -> DataFrame:
    """The rows of ``docs``, or their ``columns``, in the struct ``row``, with size (UTF-8 bytes of the text and 1),
    text_crc32, shard and slot (from 0 in each shard, without gaps). Shards are within ``tolerance`` of an equal share at
    either end, or within the one row that lies across its border."""
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    keyed = written(docs.select(
        F.struct(*(columns or docs.columns)).alias("row"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("k1"), F.monotonically_increasing_id().alias("k2"))
        .withColumn("k2", F.xxhash64("k2", "k1")))
    edges = splitters(keyed, shards, tolerance)
    blocks = max(1, -(-keyed.count() // (shards * BLOCK_ROWS)))
    bits = (blocks - 1).bit_length()
    dealt = keyed.withColumn("shard", shard_of(edges).cast("int")).withColumn("block", prefix("k2", bits).cast("int"))
    before = dealt.groupBy("shard", "block").count().select(
        "shard", "block", (F.sum("count").over(Window.partitionBy("shard").orderBy("block")) - F.col("count")).alias("before"))
    place = F.row_number().over(Window.partitionBy("shard", "block").orderBy("k2", "k1")).cast("long")
    return dealt.withColumn("place", place).join(before, ["shard", "block"]).select(
        "row", "size", "text_crc32", "shard", (F.col("before") + F.col("place") - 1).alias("slot"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, tolerance: float = 0.01) -> None:
    """Parquet folders shard=0.. under ``path``, with the columns of ``docs`` and slot."""
    sharded(docs, shards, tolerance).select("row.*", "shard", "slot").write.partitionBy("shard").parquet(path)
