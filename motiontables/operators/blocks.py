"""Ordered scans that do not need one task per key.

A plain ``Window.partitionBy(key).orderBy(pos)`` sends a whole key to one task. A clip
(or a user, or a source) may hold a large share of all rows, so every ordered operator
here works on *blocks*: fixed-width slices of the order column. Rows are shuffled once
by (key, block); each block is scanned locally; one small summary row per block is
scanned across blocks, and the carried value is joined back on (key, block). The join
reuses the block partitioning, so the big side is shuffled once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__block"
FRAME_BLOCK = 4096


@dataclass(frozen=True)
class Scan:
    """One output column of :func:`block_scan`.

    kind: ``prev``/``next`` (neighbour row), ``last_known``/``next_known`` (nearest
    non-null at or before/after the row), ``last_before`` (strictly before), ``sum`` or ``max`` (inclusive running value),
    ``max_before`` (running maximum of the earlier rows).
    """

    kind: str
    value: Column
    name: str


def with_block(df: DataFrame, pos: str, width) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.col(pos) / width).cast("long"))


def block_window(keys: Sequence[str], order: Sequence) -> Window:
    return Window.partitionBy(*keys, BLOCK).orderBy(*order)


def _before(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _after(w: Window) -> Window:
    return w.rowsBetween(1, Window.unboundedFollowing)


def block_scan(df: DataFrame, keys: Sequence[str], order: Sequence[str], scans: Sequence[Scan],
               width=FRAME_BLOCK, block: Column | None = None, per_key: DataFrame | None = None) -> DataFrame:
    """Add the scan columns. ``order[0]`` is numeric; the rest breaks ties.

    Blocks are ``width`` wide in ``order[0]``, or given by ``block``, any integer that
    never decreases along the order (a logarithm for values spread over magnitudes).
    ``per_key`` has one row for each key, null in none; its further columns come along with the
    blocks' summaries, so the rows are not moved once more for them. Rows without one get nulls.
    """
    base = with_block(df, order[0], width) if block is None else df.withColumn(BLOCK, block.cast("long"))
    w = block_window(keys, order)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    onward = w.rowsBetween(0, Window.unboundedFollowing)
    key = F.struct(*order) if len(order) > 1 else F.col(order[0])
    # Blocks are summed up with plain values: a struct in an aggregate would have all rows sorted first.
    local, summary, carried, final = [], [], {}, []
    for i, s in enumerate(scans):
        mine, theirs, raw = f"__l{i}", f"__c{i}", f"__s{i}"
        box = F.struct(s.value.alias("v"))
        known = F.when(s.value.isNotNull(), key)
        if s.kind == "prev":
            local.append(F.lag(box).over(w).alias(mine))
            summary.append(F.max_by(s.value, key).alias(raw))
            carried[theirs] = lambda a, raw=raw: F.lag(F.struct(F.col(raw).alias("v"))).over(a)
            final.append(F.coalesce(mine, theirs).getField("v").alias(s.name))
        elif s.kind == "next":
            local.append(F.lead(box).over(w).alias(mine))
            summary.append(F.min_by(s.value, key).alias(raw))
            carried[theirs] = lambda a, raw=raw: F.lead(F.struct(F.col(raw).alias("v"))).over(a)
            final.append(F.coalesce(mine, theirs).getField("v").alias(s.name))
        elif s.kind == "last_known":
            local.append(F.last(s.value, True).over(upto).alias(mine))
            summary.append(F.max_by(s.value, known).alias(raw))
            carried[theirs] = lambda a, raw=raw: F.last(raw, True).over(_before(a))
            final.append(F.coalesce(mine, theirs).alias(s.name))
        elif s.kind == "last_before":
            local.append(F.last(s.value, True).over(_before(w)).alias(mine))
            summary.append(F.max_by(s.value, known).alias(raw))
            carried[theirs] = lambda a, raw=raw: F.last(raw, True).over(_before(a))
            final.append(F.coalesce(mine, theirs).alias(s.name))
        elif s.kind == "next_known":
            local.append(F.first(s.value, True).over(onward).alias(mine))
            summary.append(F.min_by(s.value, known).alias(raw))
            carried[theirs] = lambda a, raw=raw: F.first(raw, True).over(_after(a))
            final.append(F.coalesce(mine, theirs).alias(s.name))
        elif s.kind == "sum":
            local.append(F.sum(s.value).over(upto).alias(mine))
            summary.append(F.sum(s.value).alias(raw))
            carried[theirs] = lambda a, raw=raw: F.sum(raw).over(_before(a))
            final.append((F.coalesce(F.col(mine), F.lit(0)) + F.coalesce(F.col(theirs), F.lit(0))).alias(s.name))
        elif s.kind in ("max", "max_before"):
            local.append(F.max(s.value).over(upto if s.kind == "max" else _before(w)).alias(mine))
            summary.append(F.max(s.value).alias(raw))
            carried[theirs] = lambda a, raw=raw: F.max(raw).over(_before(a))
            final.append(F.greatest(mine, theirs).alias(s.name))
        else:
            raise ValueError(f"unknown scan kind {s.kind!r}")
    scanned = base.select("*", *local)
    per_block = base.groupBy(*keys, BLOCK).agg(*summary)
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    back = per_block.select(*keys, BLOCK, *[fn(across).alias(n) for n, fn in carried.items()])
    if per_key is not None:
        back = back.join(per_key, list(keys), "left")
        final += [F.col(c) for c in per_key.columns if c not in keys]
    return scanned.join(back, [*keys, BLOCK], "left").select(*[F.col(c) for c in df.columns], *final)


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "rn",
                width=FRAME_BLOCK) -> DataFrame:
    return block_scan(df, keys, order, [Scan("sum", F.lit(1).cast("long"), name)], width)


def count_changes(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column,
                  changed: Callable[[Column, Column], Column], first: Callable[[Column], Column], name: str,
                  width=FRAME_BLOCK, row_number: str | None = None) -> DataFrame:
    """Running count of changes between neighbouring rows, in one pass over the blocks.

    ``changed(previous, current)`` compares neighbours and ``first(current)`` judges the very
    first row. A block contributes its first and last value and the changes inside it, so
    neighbours across a border are compared on the summaries.
    """
    base = with_block(df, order[0], width).withColumn("__v", F.struct(value.alias("v")))
    w = block_window(keys, order)
    key = F.struct(*order) if len(order) > 1 else F.col(order[0])
    upto = w.rowsBetween(Window.unboundedPreceding, 0)

    def step(previous, current, at_start):
        return F.when(previous.isNull(), at_start).otherwise(
            F.coalesce(changed(previous.getField("v"), current.getField("v")).cast("long"), F.lit(0)))

    inner = base.withColumn("__step", step(F.lag("__v").over(w), F.col("__v"), F.lit(0)).cast("long"))
    scanned = inner.withColumn("__count", F.sum("__step").over(upto)).withColumn("__row", F.row_number().over(w))
    blocks = inner.groupBy(*keys, BLOCK).agg(
        F.min_by("__v", key).alias("__first"), F.max_by("__v", key).alias("__last"), F.sum("__step").alias("__inner"),
        F.count(F.lit(1)).alias("__rows"))
    across = Window.partitionBy(*keys).orderBy(BLOCK)
    joint = step(F.lag("__last").over(across), F.col("__first"), first(F.col("__first.v")).cast("long"))
    started = blocks.withColumn("__joint", joint).select(
        *keys, BLOCK,
        (F.sum("__joint").over(across.rowsBetween(Window.unboundedPreceding, 0))
         + F.coalesce(F.sum("__inner").over(_before(across)), F.lit(0))).alias("__start"),
        F.coalesce(F.sum("__rows").over(_before(across)), F.lit(0)).alias("__earlier"))
    total = (F.col("__count") + F.col("__start")).alias(name)
    extra = [(F.col("__row") + F.col("__earlier")).alias(row_number)] if row_number else []
    return scanned.join(started, [*keys, BLOCK], "left").select(*[F.col(c) for c in df.columns], total, *extra)
