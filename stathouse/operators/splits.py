"""Overlapping splits of one table in one scan: grouping sets, label lists, shares, subtotals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import half_even


def by_label(df: DataFrame, splits: Mapping[str, Column], label: str = "split") -> DataFrame:
    """A row for each split that a row belongs to; splits may overlap."""
    names = F.array_compact(F.array(*(F.when(condition, F.lit(name)) for name, condition in splits.items())))
    return df.withColumn(label, F.explode(names))


def hand_splits(throws: str = "p_throws", stands: str = "stand") -> dict[str, Column]:
    """The seven batting splits: all, against each hand, and each pair of hands."""
    p, b = F.col(throws), F.col(stands)
    out = {"all": F.lit(True), "vs_rhp": p == "R", "vs_lhp": p == "L"}
    return out | {f"as_{x.lower()}hb_vs_{y.lower()}hp": (b == x) & (p == y) for x in "RL" for y in "RL"}


def stand_splits(stands: str = "stand") -> dict[str, Column]:
    """The three pitching splits: all (also unknown stands), and against each stand."""
    return {"all": F.lit(True), "vs_rhb": F.col(stands) == "R", "vs_lhb": F.col(stands) == "L"}


def in_scopes(df: DataFrame, scopes: Mapping[str, list[str]], aggregates: list[Column], name: str = "scope") -> DataFrame:
    """One aggregate for several scopes (lists of keys): a row says its scope, keys that it sums over are null."""
    keys = list(dict.fromkeys(k for ks in scopes.values() for k in ks))
    out = df.groupingSets([[F.col(k) for k in ks] for ks in scopes.values()], *(F.col(k) for k in keys)).agg(F.grouping_id().alias("_set"), *aggregates)
    number = {s: sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in ks) for s, ks in scopes.items()}
    label = F.create_map(*(F.lit(x) for s, n in number.items() for x in (n, s)))[F.col("_set").cast("int")]
    return out.withColumn(name, label).drop("_set")


#: Scopes of a player's batting lines, of a player's and of a team's pitching lines, and of a team's batting lines.
PLAYER_BATTING = {"career": ["player"], "year": ["player", "year"], "team": ["player", "team"], "team_year": ["player", "team", "year"], "opponent": ["player", "opponent"], "opponent_year": ["player", "opponent", "year"]}
PLAYER_PITCHING = {f"{s}_by_role": [*keys, "role"] for s, keys in PLAYER_BATTING.items()}
TEAM_BATTING = {"year": ["team", "year"], "lineup_spot": ["team", "year", "spot"], "position": ["team", "year", "position"], "player": ["team", "year", "player"], "spot_player": ["team", "year", "spot", "player"], "position_player": ["team", "year", "position", "player"]}
TEAM_PITCHING = {"year": ["team", "year"], "player": ["team", "year", "player"]}


def starter_splits(starter: Column) -> dict[str, Column]:
    """All, starters, and those who came from the bench."""
    return {"all": F.lit(True), "starters": starter, "bench": ~starter}


def role_splits(starter: Column) -> dict[str, Column]:
    """All, starting and relief pitchers."""
    return {"all": F.lit(True), "sp": starter, "rp": ~starter}


def combined_and_each(df: DataFrame, scope: list[str], kind: str, aggregates: list[Column]) -> DataFrame:
    """Per scope: a row for each kind and one for all kinds (is_total = 1)."""
    keys = [F.col(c) for c in (*scope, kind)]
    sets = [keys, keys[:-1]]
    return df.groupingSets(sets, *keys).agg(F.grouping(kind).cast("int").alias("is_total"), *aggregates)


def subtotals(df: DataFrame, keys: list[str], aggregates: list[Column]) -> DataFrame:
    """Rows of each level and totals above them; level counts the keys that are summed away."""
    level = sum((F.grouping(k).cast("int") for k in keys), F.lit(0))
    return df.rollup(*keys).agg(level.alias("level"), *aggregates)


def share_of(df: DataFrame, scope: list[str], count: str, share: str = "share") -> DataFrame:
    """Each row's part of the sum of its scope."""
    total = F.sum(count).over(W.partitionBy(*scope))
    return df.withColumn(share, F.when(total > 0, F.col(count).cast("double") / total).otherwise(0.0))


def without_rare_kinds(df: DataFrame, scope: list[str], kind: str, least: float = 0.01) -> DataFrame:
    """Rows whose kind is at least ``least`` of its scope (share rounded half to even at three places); counted per kind, then joined back."""
    kinds = share_of(df.groupBy(*scope, kind).agg(F.count(F.lit(1)).alias("_n")), scope, "_n", "_share")
    keep = kinds.where(half_even(F.col("_share"), 3) >= least).select(*scope, kind)
    return df.join(keep, [*scope, kind], "left_semi")


def distribution(df: DataFrame, scope: list[str], kind: str, rounded: bool = False) -> DataFrame:
    """How often each kind comes per scope, and its share; rounded, a hundred times the share at three places."""
    out = share_of(df.groupBy(*scope, kind).agg(F.count(F.lit(1)).alias("games")), scope, "games", "percent")
    return out.withColumn("percent", half_even(F.col("percent"), 3) * 100) if rounded else out


def pivot_mix(df: DataFrame, rows: str, columns: str, values: list, count: str = "n") -> DataFrame:
    """Counts of each row kind by column value."""
    return df.groupBy(rows).pivot(columns, values).agg(F.count(F.lit(1))).na.fill(0)


def two_perspectives(games: DataFrame, first: str, second: str, first_score: str, second_score: str, team: str = "team") -> DataFrame:
    """Two rows for each game: each side's own score and the other's."""
    side = lambda t, f, a, home: F.struct(F.col(t).alias(team), F.col(f).alias("scored"), F.col(a).alias("allowed"), F.lit(home).alias("second"))
    rest = [c for c in games.columns if c not in (first, second, first_score, second_score)]
    sides = F.explode(F.array(side(first, first_score, second_score, False), side(second, second_score, first_score, True)))
    return games.select(*rest, sides.alias("_s")).select(*rest, "_s.*")


def standings(games: DataFrame, first: str, second: str, first_score: str, second_score: str) -> DataFrame:
    """Wins, losses (a tie is a loss for both), and runs of each team."""
    rows = two_perspectives(games, first, second, first_score, second_score)
    won = F.col("scored") > F.col("allowed")
    return rows.groupBy("team").agg(
        F.count(F.when(won, 1)).alias("wins"), F.count(F.when(~won, 1)).alias("losses"),
        F.sum("scored").cast("long").alias("runs_scored"), F.sum("allowed").cast("long").alias("runs_allowed"),
    )


def all_entities(dimension: DataFrame, facts: DataFrame, key: list[str], fill: int = 0) -> DataFrame:
    """Every row of the dimension with its facts; missing ones are filled."""
    return dimension.join(facts, key, "left").na.fill(fill, [c for c in facts.columns if c not in key])
