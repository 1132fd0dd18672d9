"""Corrections: keyed updates and removals, filling, matching of unplaced rows, and reports of what changed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def apply_updates(df: DataFrame, updates: DataFrame, key: list[str]) -> DataFrame:
    """Values of ``updates`` that aren't null replace those of the row with their key."""
    values = [c for c in updates.columns if c not in key]
    renamed = updates.select(*key, *(F.col(c).alias(f"_new_{c}") for c in values))
    out = df.join(renamed, key, "left")
    return out.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in values else F.col(c) for c in df.columns))


def apply_removals(df: DataFrame, removals: DataFrame, key: list[str]) -> DataFrame:
    return df.join(removals.select(*key), key, "left_anti")


def rename_ids(df: DataFrame, column: str, patches: DataFrame, old: str, new: str) -> DataFrame:
    """An id that is known to be wrong becomes the right one."""
    pairs = patches.where(F.col(new).isNotNull()).select(F.col(old).alias(column), F.col(new).alias("_new"))
    return df.join(pairs, column, "left").withColumn(column, F.coalesce("_new", column)).drop("_new").select(*df.columns)


def fill_missing(df: DataFrame, group: list[str], column: str) -> DataFrame:
    """Missing values of groups with one other value are filled; ``unclear`` says where there are several."""
    seen = df.groupBy(*group).agg(F.count_distinct(column).alias("_n"), F.min(column).alias("_only"))
    joined = df.join(seen, group)
    filled = F.when(F.col(column).isNull() & (F.col("_n") == 1), F.col("_only")).otherwise(F.col(column))
    return joined.withColumn("unclear", F.col(column).isNull() & (F.col("_n") > 1)).withColumn(column, filled).drop("_n", "_only")


def place_unmatched(pitches: DataFrame, at_bats: DataFrame) -> DataFrame:
    """at_bat_id for groups of pitches that no at-bat claims.

    pitches: group, game_id, inning, batter, pitcher, numbers (array); at_bats:
    at_bat_id, game_id, inning, batter, pitcher, missing (array).  A group fits
    an at-bat of its inning with its batter or its pitcher whose missing
    numbers it all has.  One fit places the group; of several, the one that
    misses exactly as many; otherwise it stays unplaced.
    """
    keys = ["game_id", "inning"]
    renamed = at_bats.select(*keys, "at_bat_id", F.col("batter").alias("_b"), F.col("pitcher").alias("_p"), "missing")
    met = pitches.join(renamed, keys).where((F.col("batter") == F.col("_b")) | (F.col("pitcher") == F.col("_p")))
    met = met.where((F.size("missing") > 0) & (F.size("missing") <= F.size("numbers")) & (F.size(F.array_except("missing", "numbers")) == 0))
    w = W.partitionBy("group")
    exact = F.size("missing") == F.size("numbers")
    met = met.withColumns({"_fits": F.count(F.lit(1)).over(w), "_exact": F.sum(exact.cast("int")).over(w)})
    return met.where((F.col("_fits") == 1) | (exact & (F.col("_exact") == 1))).select("group", "at_bat_id")


def differences(before: DataFrame, after: DataFrame, key: list[str], stats: list[str]) -> DataFrame:
    """A row for each statistic that isn't the same in both tables."""
    renamed = after.select(*key, *(F.col(c).alias(f"_a_{c}") for c in stats))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("stat"), F.col(c).alias("before"), F.col(f"_a_{c}").alias("after")) for c in stats)))
    rows = before.join(renamed, key).select(*key, pairs.alias("_s")).select(*key, "_s.*")
    return rows.where("before <> after").withColumn("diff", F.col("after") - F.col("before"))
