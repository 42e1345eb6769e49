"""Strip profiles and periodograms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import Scan, block_scan
from .quantiles import exact_quantiles


def row_profile(pixels: DataFrame, keys: Sequence[str], row: str = "row", value: str = "v") -> DataFrame:
    """Median over the columns of each row."""
    return exact_quantiles(pixels, [*keys, row], F.col(value), {"profile": 0.5}).drop("n")


def detrend(profile: DataFrame, keys: Sequence[str], row: str = "row", value: str = "profile") -> DataFrame:
    """Remove the least-squares line of each strip."""
    fit = profile.groupBy(*keys).agg(
        F.regr_slope(F.col(value), F.col(row).cast("double")).alias("slope"),
        F.regr_intercept(F.col(value), F.col(row).cast("double")).alias("intercept"),
        F.count(F.lit(1)).alias("samples"))
    joined = profile.join(fit, list(keys))
    return joined.withColumn("signal", F.col(value) - (F.col("slope") * F.col(row) + F.col("intercept")))


def contrast(signal: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Spread between the 5th and 95th percentile of the detrended signal."""
    q = exact_quantiles(signal, keys, F.col("signal"), {"p5": 0.05, "p95": 0.95})
    return q.select(*keys, F.col("n").alias("samples"), (F.col("p95") - F.col("p5")).alias("contrast"))


def periodogram(signal: DataFrame, keys: Sequence[str], index: str, samples: Column, value: str = "signal") -> DataFrame:
    """Power per positive frequency of a Hann-windowed signal.

    Each sample contributes to every frequency of its own strip; the sums combine before
    the shuffle, so only (strip, frequency) partial sums move. A strip is at most as long
    as an image side.
    """
    n = samples.cast("double")
    hann = F.when(samples > 1, 0.5 - 0.5 * F.cos(2 * math.pi * F.col(index) / (n - 1))).otherwise(1.0)
    rows = signal.select(*keys, F.col(index).alias("__i"), n.alias("__n"), (F.col(value) * hann).alias("__x"),
                         F.explode(F.sequence(F.lit(1), F.floor(samples / 2).cast("int"))).alias("freq"))
    angle = 2 * math.pi * F.col("freq") * F.col("__i") / F.col("__n")
    s = rows.groupBy(*keys, "freq").agg(F.sum(F.col("__x") * F.cos(angle)).alias("__re"),
                                        F.sum(F.col("__x") * F.sin(angle)).alias("__im"), F.max("__n").alias("samples"))
    return s.select(*keys, "freq", "samples", (F.col("__re") ** 2 + F.col("__im") ** 2).alias("power"))


def spectral_peak(spectrum: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Peak, three-bin concentration and log-parabola refined period."""
    near = block_scan(spectrum, keys, ["freq"], [Scan("prev", F.col("power"), "__l"), Scan("next", F.col("power"), "__r")])
    total = near.groupBy(*keys).agg(
        F.sum("power").alias("__total"),
        F.min_by(F.struct("freq", "power", "__l", "__r", "samples"), F.struct((-F.col("power")).alias("p"), "freq")).alias("k"))
    left, mid, right = (F.log(F.greatest(F.col(f"k.{c}"), F.lit(1e-30))) for c in ("__l", "power", "__r"))
    den = left - 2 * mid + right
    offset = F.when((F.col("k.freq") > 1) & F.col("k.__r").isNotNull() & (F.abs(den) > 1e-12),
                    F.least(F.greatest(0.5 * (left - right) / den, F.lit(-0.5)), F.lit(0.5))).otherwise(0.0)
    three = F.coalesce("k.__l", F.lit(0.0)) + F.col("k.power") + F.coalesce("k.__r", F.lit(0.0))
    return total.filter(F.col("__total") > 1e-15).select(
        *keys, F.col("k.freq").alias("peak"), (three / F.col("__total")).alias("concentration"),
        (F.col("k.samples") / (F.col("k.freq") + offset)).alias("period"))


def lag_correlation(signal: DataFrame, keys: Sequence[str], index: str, lag: Column, value: str = "signal") -> DataFrame:
    """Correlation of a signal with itself ``lag`` samples later; an equi join on the shifted index."""
    a = signal.select(*keys, (F.col(index) + lag).cast("long").alias("__j"), F.col(value).alias("__a"))
    b = signal.select(*keys, F.col(index).cast("long").alias("__j"), F.col(value).alias("__b"))
    return a.join(b, [*keys, "__j"]).groupBy(*keys).agg(F.corr("__a", "__b").alias("lag_correlation"))


def lateral_correlations(pixels: DataFrame, profile: DataFrame, keys: Sequence[str], width: Column, parts: int = 4,
                         row: str = "row", col: str = "col", value: str = "v") -> DataFrame:
    """Correlation of each lateral part's row medians with the whole profile."""
    # The first (width mod parts) parts are one column wider.
    big, size = width % parts, F.floor(width / parts)
    edge = big * (size + 1)
    part = F.when(F.col(col) < edge, F.floor(F.col(col) / (size + 1))).otherwise(big + F.floor((F.col(col) - edge) / size))
    med = exact_quantiles(pixels.withColumn("part", part.cast("int")), [*keys, "part", row], F.col(value), {"m": 0.5})
    return med.join(profile, [*keys, row]).groupBy(*keys, "part").agg(F.corr("m", "profile").alias("correlation"))
