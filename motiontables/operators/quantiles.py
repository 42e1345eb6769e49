"""Exact medians and percentiles of groups that may not fit one task.

The built-in ``percentile`` keeps every distinct value of a group in one aggregation
buffer. Here a rank is found by narrowing histograms. Equal values are counted first, with
partial counts before the shuffle. The distinct values fall into coarse bins that follow
the floating-point scale (64 to an octave, so an outlier does not widen the bins of the
rest), each coarse bin into fine bins. The bin that holds a rank is read off the running
counts of the coarse bins, then of the fine bins inside it, then of the values inside that.
No step orders more than about eight million rows of a group however many values it has:
the width of a bin is a share of the 64 bits of a double. Only the values of the coarse bins
that hold a rank are joined and moved again. One plan serves all sizes and
nothing is computed while it is built.

Results equal linear interpolation between order statistics. Null and NaN values are left
out; a group without others has no row; null is a group key like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COARSE, FINE = 2.0**6, 2.0**23  # bins of an octave, bins of a coarse bin
EXPONENTS, OCTAVE = 1100, 2**12  # lifts every exponent above zero; room of an octave in the bin number


def bins(v: Column) -> tuple[Column, Column]:
    """Numbers of the coarse and the fine bin; ordered by both, values never decrease.

    The exponent comes from a logarithm and may be one off next to a power of two. It never
    decreases with the value, and inside one exponent the mantissa keeps the order.
    """
    size = F.abs(v)
    exponent = F.least(F.floor(F.log2(size)), F.lit(1024.0)).cast("long")
    scaled = F.when(exponent < 1024, size / F.pow(F.lit(2.0), exponent.cast("double")) * COARSE).otherwise(0.0)
    sign = F.when(v < 0, -1).otherwise(1)
    coarse = F.when(v == 0, 0).otherwise(sign * (1 + (exponent + EXPONENTS) * OCTAVE + F.floor(scaled)))
    fine = F.when(v == 0, 0).otherwise(sign * F.floor((scaled - F.floor(scaled)) * FINE))
    return coarse.cast("long"), fine.cast("long")


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: Column, probs: dict[str, float]) -> DataFrame:
    """One row per group: ``n`` (values present) and one column per named probability."""
    keys = list(keys)
    # A struct is never null itself: joins on it keep null keys and push no filter into one branch only,
    # so both readers of a histogram share its exchange.
    group = F.struct(*keys) if keys else F.struct(F.lit(0).alias("__all"))
    data = df.select(group.alias("__g"), value.cast("double").alias("__v")).filter(F.col("__v").isNotNull() & ~F.isnan("__v"))
    coarse, fine = bins(F.col("__v"))
    counted = data.groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__c")).select(
        F.struct("__g", coarse.alias("bin")).alias("__b"), "__v", "__c")
    # Dealt once by coarse bin for both its readers. They share the exchange only if they take the same columns, so the
    # count asks for the value, too. The hash sorts faster than the struct, which decides.
    values = counted.select(F.xxhash64("__b").alias("__h"), "__b", "__v", "__c").repartition("__h", "__b")
    whole = values.groupBy("__h", "__b").agg(F.sum(F.when(F.col("__v").isNotNull(), F.col("__c"))).alias("__c")).select(
        F.col("__b.__g").alias("__g"), F.col("__b.bin").alias("__bin"), "__h", "__b", "__c")

    every = Window.partitionBy("__g").orderBy("__bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(high).alias("high"), (F.ceil if high else F.floor)(
        F.lit(float(p)) * (F.col("n") - 1)).cast("long").alias("rank"))
        for i, p in enumerate(probs.values()) for high in (False, True)])
    running = _running(whole, ["__g"], "__bin").withColumn("n", F.sum("__c").over(every))
    inside = lambda t: (t["rank"] >= F.col("__from")) & (t["rank"] < F.col("__from") + F.col("__c"))
    found = running.select("__h", "__b", F.struct("n", F.filter(asked, inside).alias("asked"), "__from").alias("__f")).filter(
        F.size("__f.asked") > 0)
    # Only the values of bins that hold a rank go on, and these are few unless a group is very large.
    held = values.join(found, ["__h", "__b"]).select(
        F.struct(F.col("__b.__g").alias("__g"), F.col("__b.bin").alias("bin"), fine.alias("part")).alias("__p"), "__v", "__c", "__f").repartition("__p")
    parts = held.groupBy("__p").agg(F.sum(F.when(F.col("__v").isNotNull(), F.col("__c"))).alias("__c"), F.first("__f").alias("__f")).select(
        F.struct("__p.__g", "__p.bin").alias("__b"), F.col("__p.part").alias("__part"), "__p", "__c", "__f")
    started = _running(parts, ["__b"], "__part").withColumn("__from", F.col("__from") + F.col("__f.__from"))
    started = started.filter(F.size(F.filter("__f.asked", inside)) > 0).select("__p", F.col("__from").alias("__before"))
    last = _running(held.join(started, "__p"), ["__p"], "__v").withColumn("__from", F.col("__from") + F.col("__before"))
    found = last.select(F.col("__p.__g").alias("__g"), "__v", F.col("__f.n").alias("n"), F.inline(F.filter("__f.asked", inside)))
    out = found.groupBy("__g", "n").agg(*[
        F.max(F.when((F.col("i") == i) & (F.col("high") == high), F.col("__v"))).alias(f"__{i}{high}")
        for i in range(len(probs)) for high in (False, True)])

    def between(i: int, p: float) -> Column:
        low, high, rank = F.col(f"__{i}False"), F.col(f"__{i}True"), F.lit(float(p)) * (F.col("n") - 1)
        return F.when(low == high, low).otherwise(low + (high - low) * (rank - F.floor(rank)))

    return out.select(*[F.col("__g").getField(k).alias(k) for k in keys], "n",
                      *[between(i, p).alias(name) for i, (name, p) in enumerate(probs.items())])


def _running(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds ``__from``, the count of all rows before this one."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("__from", F.coalesce(F.sum("__c").over(before), F.lit(0)))


def bounded_quantiles(df: DataFrame, keys: Sequence[str], value: Column, probs: dict[str, float]) -> DataFrame:
    """Same result for groups known to be small (joints of a hand, points of a mask).

    The rows of a group are sorted and the asked ranks picked out. The built-in ``percentile`` keeps a map for each group
    and aggregates objects, which takes most of the time where groups are many and hold a row or two.
    """
    present = value.isNotNull() & ~F.isnan(value)
    group = Window.partitionBy(*keys).orderBy(F.col("__v").asc_nulls_last())
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = df.select(*keys, F.when(present, value).cast("double").alias("__v")).select(
        *keys, "__v", (F.row_number().over(group) - 1).alias("__at"), F.count("__v").over(whole).alias("n"))
    places = {name: F.lit(float(p)) * (F.col("n") - 1) for name, p in probs.items()}
    out = rows.groupBy(*keys).agg(F.max("n").alias("n"), *[
        F.max(F.when(F.col("__at") == end(place), F.col("__v"))).alias(f"__{side}_{name}")
        for name, place in places.items() for side, end in (("low", F.floor), ("high", F.ceil))])

    def between(name: str) -> Column:
        low, high, place = F.col(f"__low_{name}"), F.col(f"__high_{name}"), places[name]
        return F.when(low == high, low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return out.select(*keys, "n", *[between(name).alias(name) for name in probs])
