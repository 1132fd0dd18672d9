"""A player's dossier: metrics by split and type, with percentiles, from one scan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import matching, metrics, splits


def dossier(pitches: DataFrame, scope: list[str], kind: str, labels: Mapping[str, Column], flags: Mapping[str, Column], rounded: bool = False) -> DataFrame:
    """All metrics per scope and split, for each kind and for all (is_total = 1)."""
    rows = splits.by_label(pitches.withColumns({f"_f_{k}": v for k, v in flags.items()}), labels)
    bound = {k: F.col(f"_f_{k}") for k in flags}
    sums = splits.combined_and_each(rows, [*scope, "split"], kind, metrics.pitch_sums(bound))
    return metrics.with_rates(sums, rounded)


def with_percentiles(table: DataFrame, steps: DataFrame, on: list[str], lookups: Mapping[str, bool]) -> DataFrame:
    """A percentile column for each metric; steps: ``on``, stat_name, percentile, stat_value.  True marks metrics where less is better."""
    for stat, lower in lookups.items():
        own = steps.where(F.col("stat_name") == stat).select(*on, F.col("percentile").alias(f"{stat}_percentile"), F.col("stat_value").alias("_limit"))
        table = matching.percentile_of(table, own, on, stat, "_limit", f"{stat}_percentile", lower)
    return table


def flatten_percentiles(steps: DataFrame, column: str) -> DataFrame:
    """A document stat -> type -> percentile -> value as rows."""
    rows = steps.select(F.explode(column).alias("stat_name", "_t")).select("stat_name", F.explode("_t").alias("pitch_type", "_p"))
    return rows.select("stat_name", "pitch_type", F.explode("_p").alias("percentile", "stat_value")).withColumn("percentile", F.col("percentile").cast("double"))
