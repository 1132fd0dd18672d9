"""Calibration of the time between pitches, at-bats and innings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import ordered


def pitch_gaps(pitches: DataFrame) -> DataFrame:
    """Positive gaps in seconds, and whether they lie inside an at-bat, between at-bats of a half inning, or between innings.

    pitches: game_id, inning, at_bat, place (order in the game), us.
    """
    rows = ordered.gaps(pitches, ["game_id"], F.col("us"), ["place"])
    rows = ordered.gap_kind(rows, ["game_id", "inning"], ["at_bat"], ["place"])
    kind = F.when(F.col("kind") == "first", "inning").when(F.col("kind") == "across", "at_bat").otherwise("pitch")
    return rows.withColumn("kind", kind).where("gap > 0").select("game_id", "kind", "gap")


def calibration(gaps: DataFrame, trim: bool = False) -> dict[str, DataFrame]:
    """Statistics per kind of gap; with ``trim``, one percent of each tail is moved in."""
    out = {}
    for kind in ("pitch", "at_bat", "inning"):
        sample = gaps.where(F.col("kind") == kind)
        out[kind] = ordered.winsorized(sample, "gap") if trim else ordered.interval_statistics(sample, "gap")
    return out
