"""One observation per (clip, frame, side), without guessing unresolved identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIDE_KEYS = ("clip_id", "frame", "side")


def _tally(df: DataFrame, keys: Sequence[str], payload: Sequence[str]) -> DataFrame:
    """Per group: size, unambiguous size and the payload of the one usable row.

    Only boolean true marks a row ambiguous. All parts combine before the shuffle, so a
    group of any size costs one row per map task.
    """
    sure = ~F.coalesce(F.col("ambiguous"), F.lit(False))
    row = F.struct("det_idx", *[c for c in payload if c != "det_idx"])
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(sure).alias("n_sure"),
        F.min(F.when(sure, row)).alias("sure_row"), F.min(row).alias("any_row"))


def _outcome():
    return (F.when(F.col("n") == 1, "retained")
            .when(F.col("n_sure") == F.col("n"), "conflict")
            .when(F.col("n_sure") > 1, "conflict")
            .when(F.col("n_sure") == 1, "retained")
            .otherwise("excluded"))


def classify_groups(df: DataFrame, keys: Sequence[str] = SIDE_KEYS,
                    payload: Sequence[str] = ()) -> DataFrame:
    """Outcome per group: ``retained`` (with its row), ``excluded`` or ``conflict``.

    A single row is kept even when ambiguous. With several rows, exactly one unambiguous
    row is kept; none leaves a gap; more than one, or none flagged at all, is a conflict.
    """
    chosen = F.when(F.col("n") == 1, F.col("any_row")).otherwise(F.col("sure_row"))
    return (_tally(df, keys, payload).withColumn("outcome", _outcome())
            .withColumn("row", F.when(F.col("outcome") == "retained", chosen))
            .drop("sure_row", "any_row"))


def select_observations(df: DataFrame, keys: Sequence[str] = SIDE_KEYS,
                        payload: Sequence[str] = ()) -> DataFrame:
    """Retained rows only, payload columns restored."""
    kept = classify_groups(df, keys, payload).filter(F.col("outcome") == "retained")
    return kept.select(*keys, "row.*")


def exclusions(df: DataFrame, keys: Sequence[str] = SIDE_KEYS) -> DataFrame:
    """Rows dropped because they are the flagged members of a group of several."""
    groups = classify_groups(df, keys).filter((F.col("n") > 1) & (F.col("outcome") != "conflict"))
    flagged = df.filter(F.coalesce(F.col("ambiguous"), F.lit(False)))
    return (flagged.join(groups.select(*keys), list(keys), "left_semi")
            .select(*keys, "det_idx", F.lit("unresolved_same_side_identity").alias("reason")))


def missing_sides(df: DataFrame, clip_keys: Sequence[str] = ("clip_id",)) -> DataFrame:
    """Clips in which a side has no retained observation at all."""
    kept = select_observations(df, [*clip_keys, "frame", "side"])
    have = kept.groupBy(*clip_keys).agg(
        F.bool_or(F.col("side") == "left").alias("l"), F.bool_or(F.col("side") == "right").alias("r"))
    clips = df.select(*clip_keys).distinct()
    joined = clips.join(have, list(clip_keys), "left")
    lacking = F.array_compact(F.array(F.when(~F.coalesce("l", F.lit(False)), "left"),
                                      F.when(~F.coalesce("r", F.lit(False)), "right")))
    return joined.select(*clip_keys, F.explode(lacking).alias("side"))
