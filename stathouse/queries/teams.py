"""Scopes and splits of players and teams over the driver's tables.

A line is a supplier's part of an order: player = supplier, team = return
flag, opponent = line status, spot = line number, position = a digit of the part.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, metrics, splits
from ..plans import dossier
from .common import Registry, flag_sql, flags, table

registry = Registry()

_LINES = """
WITH b AS (SELECT l_suppkey AS player, l_returnflag AS team, l_linestatus AS opponent, CAST(year(l_shipdate) AS INT) AS year, l_linenumber AS spot, CAST(l_partkey % 9 AS INT) + 1 AS position,
  l_linenumber <= 2 AS starter, CAST(l_quantity AS BIGINT) AS ab, CAST(l_partkey % 4 AS BIGINT) AS h FROM lineitem)
"""
_AGG = "COUNT(*) AS games, CAST(SUM(ab) AS BIGINT) AS ab, CAST(SUM(h) AS BIGINT) AS h, CASE WHEN SUM(ab) > 0 THEN CAST(SUM(h) AS DOUBLE) / SUM(ab) ELSE 0.0 END AS avg"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("player"), F.col("l_returnflag").alias("team"), F.col("l_linestatus").alias("opponent"), F.year("l_shipdate").alias("year"),
        F.col("l_linenumber").alias("spot"), ((F.col("l_partkey") % 9).cast("int") + 1).alias("position"), (F.col("l_linenumber") <= 2).alias("starter"),
        F.col("l_quantity").cast("long").alias("ab"), (F.col("l_partkey") % 4).alias("h"))


def _sums():
    ab, h = F.sum("ab").cast("long"), F.sum("h").cast("long")
    return [F.count("*").alias("games"), ab.alias("ab"), h.alias("h"), metrics.safe_ratio(h, ab).alias("avg")]


def _union(scopes: dict[str, list[str]], where: dict[str, str] | None = None) -> str:
    """The scopes one after another, for the other engine."""
    keys = list(dict.fromkeys(k for ks in scopes.values() for k in ks))
    kinds = {"player": "BIGINT", "team": "VARCHAR", "opponent": "VARCHAR", "year": "INT", "spot": "INT", "position": "INT", "role": "VARCHAR"}
    parts = []
    for label, condition in (where or {"": "TRUE"}).items():
        for scope, ks in scopes.items():
            ks = [k for k in ks if k != "role"]
            columns = ", ".join(k if k in ks else f"CAST(NULL AS {kinds[k]}) AS {k}" for k in keys if k != "role")
            parts.append(f"SELECT {columns}, '{scope}' AS scope{f", '{label}' AS split" if where else ''}, {_AGG} FROM b WHERE {condition} GROUP BY {', '.join(ks)}")
    return _LINES + " UNION ALL ".join(parts)


_BENCH = {"all": "TRUE", "starters": "starter", "bench": "NOT starter"}
_ROLES = {"all": "TRUE", "sp": "starter", "rp": "NOT starter"}


@registry.add(_union(splits.PLAYER_BATTING))
def player_bat_splits(spark, sf):
    """Six scopes of a player's batting lines, one aggregate."""
    return splits.in_scopes(_lines(spark, sf), splits.PLAYER_BATTING, _sums())


@registry.add(_union(splits.PLAYER_BATTING, _ROLES))
def player_pitch_splits_by_role(spark, sf):
    """The same scopes for all appearances, starts, and relief."""
    rows = splits.by_label(_lines(spark, sf), splits.role_splits(F.col("starter")))
    return splits.in_scopes(rows, {s: [*keys, "split"] for s, keys in splits.PLAYER_BATTING.items()}, _sums())


@registry.add(_union(splits.TEAM_BATTING, _BENCH))
def team_bat_splits(spark, sf):
    """A team's batting by year, spot, position, player and pairs of them, for all, starters and bench."""
    rows = splits.by_label(_lines(spark, sf), splits.starter_splits(F.col("starter")))
    return splits.in_scopes(rows, {s: [*keys, "split"] for s, keys in splits.TEAM_BATTING.items()}, _sums())


@registry.add(_union(splits.TEAM_PITCHING, _ROLES))
def team_pitch_splits(spark, sf):
    """A team's pitching by role, year and player."""
    rows = splits.by_label(_lines(spark, sf), splits.role_splits(F.col("starter")))
    return splits.in_scopes(rows, {s: [*keys, "split"] for s, keys in splits.TEAM_PITCHING.items()}, _sums())


@registry.add(_LINES + f"SELECT team, player, {_AGG} FROM b WHERE spot IN (1, 2) AND position IN (3, 6) GROUP BY 1, 2")
def lineup_spots_and_positions(spark, sf):
    """Lines of some spots of the order and some positions."""
    return _lines(spark, sf).where(F.col("spot").isin(1, 2) & F.col("position").isin(3, 6)).groupBy("team", "player").agg(*_sums())


@registry.add(_LINES + f"SELECT team, CASE WHEN starter THEN 'starters' ELSE 'bench' END AS split, {_AGG} FROM b GROUP BY 1, 2")
def starters_and_bench(spark, sf):
    """Starters against those from the bench."""
    rows = splits.by_label(_lines(spark, sf), splits.starter_splits(F.col("starter"))).where("split <> 'all'")
    return rows.groupBy("team", "split").agg(*_sums())


@registry.add(_LINES + f"SELECT x.team, y.year, COALESCE(games, 0) AS games, COALESCE(ab, 0) AS ab, COALESCE(h, 0) AS h, COALESCE(avg, 0.0) AS avg FROM (SELECT DISTINCT team FROM b) x CROSS JOIN (SELECT DISTINCT year FROM b) y LEFT JOIN (SELECT team, year, {_AGG} FROM b GROUP BY 1, 2) z ON z.team = x.team AND z.year = y.year")
def team_seasons(spark, sf):
    """Every team in every season, empty ones too."""
    rows = _lines(spark, sf)
    every = rows.select("team").distinct().crossJoin(F.broadcast(rows.select("year").distinct()))  # a few dozen rows each
    return splits.all_entities(every, rows.groupBy("team", "year").agg(*_sums()), ["team", "year"])


@registry.add("""
SELECT l_suppkey, split, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM (
  SELECT *, 'all' AS split FROM lineitem UNION ALL SELECT *, 'vs_rhb' FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT *, 'vs_lhb' FROM lineitem WHERE l_returnflag = 'A') x GROUP BY 1, 2""")
def pitching_stand_splits(spark, sf):
    """All, against right-handed, against left-handed batters; unknown stands count in all."""
    stands = table(spark, sf, "lineitem").withColumn("stand", F.when(F.col("l_returnflag") == "R", "R").when(F.col("l_returnflag") == "A", "L"))
    # summed by stand first; the labels are given to the few sums
    sums = stands.groupBy("l_suppkey", "stand").agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("s"))
    return splits.by_label(sums, splits.stand_splits()).groupBy("l_suppkey", "split").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


_SCOPES = {"game": ["l_orderkey"], "appearance": ["l_suppkey", "l_orderkey"], "pitcher_season": ["l_suppkey", "year"], "pitcher_career": ["l_suppkey"], "batter_game": ["l_partkey", "l_orderkey"], "batter_season": ["l_partkey", "year"], "batter_career": ["l_partkey"], "team_season": ["l_returnflag", "year"], "team_career": ["l_returnflag"], "season": ["year"], "team_game": ["l_returnflag", "l_orderkey"]}
_SCOPE_KEYS = list(dict.fromkeys(k for ks in _SCOPES.values() for k in ks))
_KIND = {"l_orderkey": "BIGINT", "l_suppkey": "BIGINT", "l_partkey": "BIGINT", "l_returnflag": "VARCHAR", "year": "INT"}


@registry.add("WITH b AS (SELECT *, CAST(year(l_shipdate) AS INT) AS year FROM lineitem) " + " UNION ALL ".join(
    f"SELECT {', '.join(k if k in ks else f'CAST(NULL AS {_KIND[k]}) AS {k}' for k in _SCOPE_KEYS)}, '{s}' AS scope, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM b GROUP BY {', '.join(ks)}" for s, ks in _SCOPES.items()))
def metrics_scopes(spark, sf):
    """Eleven scopes of one table of pitches."""
    rows = table(spark, sf, "lineitem").withColumn("year", F.year("l_shipdate"))
    return splits.in_scopes(rows, _SCOPES, [F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("s")])


_STEPS = "(SELECT 'whiff_rate' AS stat_name, k * 10.0 AS percentile, k / 10.0 AS stat_value FROM range(0, 11) r(k))"


@registry.add(f"""
WITH f AS (SELECT *, {flag_sql()} FROM lineitem), h AS (
  SELECT *, 'all' AS split FROM f UNION ALL SELECT *, 'vs_rhb' FROM f WHERE l_linestatus = 'F' UNION ALL SELECT *, 'vs_lhb' FROM f WHERE l_linestatus = 'O'),
a AS (SELECT l_suppkey, split, l_returnflag, CAST(grouping(l_returnflag) AS INT) AS is_total, COUNT(*) AS total_pitches, CAST(SUM(batter_did_swing) AS BIGINT) AS total_swings, CAST(SUM(swinging_strike) AS BIGINT) AS total_swinging_strikes
  FROM h GROUP BY GROUPING SETS ((l_suppkey, split, l_returnflag), (l_suppkey, split))),
r AS (SELECT *, CASE WHEN total_swings > 0 THEN CAST(total_swinging_strikes AS DOUBLE) / total_swings ELSE 0.0 END AS whiff_rate FROM a)
SELECT * FROM r""")
def player_dossier(spark, sf):
    """Metrics of each player by split, for each kind of pitch and for all."""
    li = table(spark, sf, "lineitem").withColumn("stand", F.when(F.col("l_linestatus") == "F", "R").otherwise("L"))
    some = {k: v for k, v in flags().items() if k in ("batter_did_swing", "swinging_strike")}
    out = dossier.dossier(li, ["l_suppkey"], "l_returnflag", splits.stand_splits(), some)
    return out.select("l_suppkey", "split", "l_returnflag", "is_total", "total_pitches", "total_swings", "total_swinging_strikes", "whiff_rate")


@registry.add("""
WITH s AS (SELECT l_suppkey, COUNT(*) AS n FROM lineitem GROUP BY 1), o AS (SELECT s_suppkey, s_nationkey FROM supplier)
SELECT l_suppkey, s_nationkey, n FROM s JOIN o ON l_suppkey = s_suppkey WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def in_list_filter(spark, sf):
    """Rows whose id is in a list, as a semi join."""
    sums = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    dim = table(spark, sf, "supplier")
    listed = dim.where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"))
    named = matching.with_keys(sums.join(listed, "l_suppkey", "left_semi"), [(dim.withColumnRenamed("s_suppkey", "l_suppkey"), ["l_suppkey"], "s_nationkey", "s_nationkey")])
    return named.select("l_suppkey", "s_nationkey", "n")
