"""Metrics, splits, subtotals and completeness over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expressions import half_even, safe_ratio
from ..operators import metrics, splits, status
from .common import Registry, day, flag_sql, flags, table

registry = Registry()

_SUMS = """
  COUNT(*) AS total_pitches, CAST(SUM(has_zone_location) AS BIGINT) AS total_located, CAST(SUM(batter_did_swing) AS BIGINT) AS total_swings,
  CAST(SUM(batter_made_contact) AS BIGINT) AS total_contact, CAST(SUM(called_strike) AS BIGINT) AS total_called_strikes,
  CAST(SUM(swinging_strike) AS BIGINT) AS total_swinging_strikes, CAST(SUM(inside_strike_zone) AS BIGINT) AS total_inside_zone,
  CAST(SUM(outside_strike_zone) AS BIGINT) AS total_outside_zone, CAST(SUM(swing_inside_zone) AS BIGINT) AS total_swings_inside,
  CAST(SUM(swing_outside_zone) AS BIGINT) AS total_swings_outside, CAST(SUM(contact_inside_zone) AS BIGINT) AS total_contact_inside,
  CAST(SUM(contact_outside_zone) AS BIGINT) AS total_contact_outside, CAST(SUM(is_in_play) AS BIGINT) AS total_in_play,
  CAST(SUM(is_ground_ball) AS BIGINT) AS total_ground_balls, CAST(SUM(is_fly_ball) AS BIGINT) AS total_fly_balls,
  CAST(SUM(is_line_drive) AS BIGINT) AS total_line_drives, CAST(SUM(is_popup) AS BIGINT) AS total_popups,
  CAST(SUM(is_hard_hit) AS BIGINT) AS total_hard_hits, CAST(SUM(is_medium_hit) AS BIGINT) AS total_medium_hits,
  CAST(SUM(is_soft_hit) AS BIGINT) AS total_soft_hits, CAST(SUM(is_barreled) AS BIGINT) AS total_barrels,
  CAST(SUM(is_final_pitch_of_ab) AS BIGINT) AS total_pa, CAST(SUM(ab_result_out) AS BIGINT) AS total_outs,
  CAST(SUM(ab_result_hit) AS BIGINT) AS total_hits, CAST(SUM(ab_result_single) AS BIGINT) AS total_singles,
  CAST(SUM(ab_result_double) AS BIGINT) AS total_doubles, CAST(SUM(ab_result_triple) AS BIGINT) AS total_triples,
  CAST(SUM(ab_result_homerun) AS BIGINT) AS total_homeruns, CAST(SUM(ab_result_bb) AS BIGINT) AS total_bb,
  CAST(SUM(ab_result_ibb) AS BIGINT) AS total_ibb, CAST(SUM(ab_result_k) AS BIGINT) AS total_k, CAST(SUM(ab_result_hbp) AS BIGINT) AS total_hbp,
  CAST(SUM(ab_result_error) AS BIGINT) AS total_errors, CAST(SUM(ab_result_sac_hit) AS BIGINT) AS total_sac_hits,
  CAST(SUM(ab_result_sac_fly) AS BIGINT) AS total_sac_flies,
  COUNT(CASE WHEN swinging_strike = 1 AND outside_strike_zone = 1 THEN 1 END) AS total_bad_whiffs"""


def _ratio(n: str, d: str) -> str:
    return f"CASE WHEN {d} > 0 THEN CAST({n} AS DOUBLE) / ({d}) ELSE 0.0 END"


_AB = "(total_hits + total_outs + total_errors - total_sac_hits - total_sac_flies)"


def _rates(r) -> str:
    """The ratios; ``r`` rounds each of them."""
    ratio = lambda n, d: r(_ratio(n, d))
    avg, slg = ratio("total_hits", _AB), ratio("(total_singles + 2 * total_doubles + 3 * total_triples + 4 * total_homeruns)", _AB)
    obp = ratio("(total_hits + total_bb + total_hbp)", f"{_AB} + total_bb + total_hbp + total_sac_flies")
    return f"""
  {_AB} AS total_at_bats, {ratio("total_inside_zone", "total_pitches")} AS zone_rate, {ratio("total_called_strikes", "total_pitches")} AS called_strike_rate,
  {ratio("total_swinging_strikes", "total_pitches")} AS swinging_strike_rate, {ratio("total_swings", "total_pitches")} AS swing_rate,
  {ratio("total_swinging_strikes", "total_swings")} AS whiff_rate, {ratio("total_bad_whiffs", "total_swings")} AS bad_whiff_rate,
  {ratio("total_contact", "total_swings")} AS contact_rate, {ratio("total_swings_outside", "total_outside_zone")} AS o_swing_rate,
  {ratio("total_swings_inside", "total_inside_zone")} AS z_swing_rate, {ratio("total_contact_outside", "total_swings_outside")} AS o_contact_rate,
  {ratio("total_contact_inside", "total_swings_inside")} AS z_contact_rate, {ratio("total_ground_balls", "total_in_play")} AS ground_ball_rate,
  {ratio("total_fly_balls", "total_in_play")} AS fly_ball_rate, {ratio("total_line_drives", "total_in_play")} AS line_drive_rate,
  {ratio("total_popups", "total_in_play")} AS popup_rate, {ratio("total_hard_hits", "total_in_play")} AS hard_hit_rate,
  {ratio("total_medium_hits", "total_in_play")} AS medium_hit_rate, {ratio("total_soft_hits", "total_in_play")} AS soft_hit_rate,
  {ratio("total_barrels", "total_in_play")} AS barrel_rate, {ratio("total_homeruns", "total_fly_balls")} AS hr_per_fb,
  {ratio("total_bb", "total_pa")} AS bb_rate, {ratio("total_k", "total_pa")} AS k_rate,
  {ratio("(total_called_strikes + total_swinging_strikes)", "total_pitches")} AS csw_rate,
  {avg} AS avg, {obp} AS obp, {slg} AS slg, {r(f"(({obp}) + ({slg}))")} AS ops, {r(f"(({slg}) - ({avg}))")} AS iso"""


_RATES = _rates(lambda x: x)
_EVEN = _rates(lambda x: f"CAST(format('{{:.3f}}', {x}) AS DOUBLE)")


def _metric_sql(keys: str, where: str = "TRUE") -> str:
    return f"WITH f AS (SELECT *, {flag_sql()} FROM lineitem WHERE {where}), a AS (SELECT {keys}, {_SUMS} FROM f GROUP BY {keys}) SELECT *, {_RATES} FROM a"


@registry.add(_metric_sql("l_suppkey, l_returnflag", "l_quantity > 0"))
def flagship_metrics_by_entity_type(spark, sf):
    """All pitch metrics by entity and type, after the validity filter."""
    rows = table(spark, sf, "lineitem").where(F.col("l_quantity") > 0)
    return metrics.pitch_metrics(rows, ["l_suppkey", "l_returnflag"], flags())


@registry.add(_metric_sql("l_partkey, l_returnflag, l_linestatus"))
def metrics_second_entity(spark, sf):
    """The other view: one more key, so that no column is left to chance."""
    return metrics.pitch_metrics(table(spark, sf, "lineitem"), ["l_partkey", "l_returnflag", "l_linestatus"], flags())


@registry.add(_metric_sql("l_suppkey, l_year").replace("FROM lineitem", "FROM (SELECT *, CAST(year(l_shipdate) AS INT) AS l_year FROM lineitem)"))
def metrics_by_year(spark, sf):
    """A season scope of the same aggregate."""
    rows = table(spark, sf, "lineitem").withColumn("l_year", F.year("l_shipdate"))
    return metrics.pitch_metrics(rows, ["l_suppkey", "l_year"], flags())


@registry.add(f"""
WITH f AS (SELECT *, {flag_sql()} FROM lineitem), a AS (SELECT l_suppkey, {_SUMS.replace("swinging_strike = 1 AND outside_strike_zone = 1", "swinging_strike = 1 AND swing_outside_zone = 1")} FROM f GROUP BY 1) SELECT *, {_EVEN} FROM a""")
def metrics_rounded_flavour(spark, sf):
    """Ratios rounded half to even, sums of rounded ratios."""
    return metrics.pitch_metrics(table(spark, sf, "lineitem"), ["l_suppkey"], flags(), rounded=True)


_LINES = """
WITH g AS (SELECT l_suppkey, o_custkey, l_orderkey, CAST(SUM(CAST(l_quantity AS INT)) AS BIGINT) AS at_bats, CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS hits,
    CAST(SUM(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS bases_on_balls, CAST(SUM(l_linenumber) AS BIGINT) AS strikeouts, COUNT(*) AS hit_by_pitch
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)
"""


@registry.add(_LINES + """
SELECT l_suppkey, COUNT(*) AS total_games, CAST(SUM(at_bats) AS BIGINT) AS outs, CAST(SUM(hits) AS BIGINT) AS hits, CAST(SUM(hit_by_pitch) AS BIGINT) AS earned_runs,
  CAST(SUM(bases_on_balls) AS BIGINT) AS bases_on_balls, CAST(SUM(strikeouts) AS BIGINT) AS strikeouts,
  27 * CAST(SUM(hit_by_pitch) AS DOUBLE) / SUM(at_bats) AS era, 3 * CAST(SUM(bases_on_balls + hits) AS DOUBLE) / SUM(at_bats) AS whip,
  27 * CAST(SUM(strikeouts) AS DOUBLE) / SUM(at_bats) AS k_per_nine,
  CASE WHEN SUM(bases_on_balls) > 0 THEN CAST(SUM(strikeouts) AS DOUBLE) / SUM(bases_on_balls) ELSE 0.0 END AS k_per_bb FROM g GROUP BY l_suppkey""")
def rate_stats_lines(spark, sf):
    """Lines per game first, then pitching rates per entity."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    games = rows.groupBy("l_suppkey", "o_custkey", "l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("int")).alias("outs"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("hits"),
        F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("bases_on_balls"), F.sum("l_linenumber").alias("strikeouts"), F.count("*").alias("earned_runs"),
        F.lit(0).alias("homeruns"), F.lit(1).alias("batters_faced"))
    out = metrics.pitch_lines(games, ["l_suppkey"])
    return out.select("l_suppkey", "total_games", "outs", "hits", "earned_runs", "bases_on_balls", "strikeouts", "era", "whip", "k_per_nine", "k_per_bb")


@registry.add(_LINES + """
SELECT o_custkey, COUNT(*) AS total_games, CAST(SUM(at_bats) AS BIGINT) AS at_bats, CAST(SUM(hits) AS BIGINT) AS hits,
  CAST(SUM(hits) AS DOUBLE) / SUM(at_bats) AS avg, CAST(SUM(hits + bases_on_balls + hit_by_pitch) AS DOUBLE) / SUM(at_bats + bases_on_balls + hit_by_pitch) AS obp FROM g GROUP BY o_custkey""")
def batting_lines(spark, sf):
    """Batting lines: on-base without sacrifice flies."""
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    zero = {c: F.lit(0) for c in ("doubles", "triples", "homeruns")}
    games = rows.groupBy("l_suppkey", "o_custkey", "l_orderkey").agg(
        F.sum(F.col("l_quantity").cast("int")).alias("at_bats"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("hits"),
        F.count(F.when(F.col("l_linestatus") == "O", 1)).alias("bases_on_balls"), F.sum("l_linenumber").alias("strikeouts"), F.count("*").alias("hit_by_pitch"),
    ).withColumns(zero | {"plate_appearances": F.lit(1)})
    return metrics.bat_lines(games, ["o_custkey"]).select("o_custkey", "total_games", "at_bats", "hits", "avg", "obp")


@registry.add("SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) * 2 + grouping(l_linestatus) AS INT) AS gid, COUNT(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def splits_cube(spark, sf):
    """Every combination of two hands and their totals."""
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().cast("int").alias("gid"), F.count("*").alias("n"))


@registry.add("""
SELECT l_suppkey, split, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM (
  SELECT *, 'all' AS split FROM lineitem UNION ALL SELECT *, 'vs_rhp' FROM lineitem WHERE l_linestatus = 'F' UNION ALL SELECT *, 'vs_lhp' FROM lineitem WHERE l_linestatus = 'O'
  UNION ALL SELECT *, 'as_' || CASE WHEN l_returnflag = 'R' THEN 'r' ELSE 'l' END || 'hb_vs_' || CASE WHEN l_linestatus = 'F' THEN 'r' ELSE 'l' END || 'hp' FROM lineitem) x GROUP BY l_suppkey, split""")
def splits_labels_explode(spark, sf):
    """Seven overlapping splits in one scan."""
    hands = table(spark, sf, "lineitem").withColumns({
        "p_throws": F.when(F.col("l_linestatus") == "F", "R").otherwise("L"), "stand": F.when(F.col("l_returnflag") == "R", "R").otherwise("L")})
    # summed by hands first; the labels are given to the few sums
    sums = hands.groupBy("l_suppkey", "p_throws", "stand").agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("s"))
    return splits.by_label(sums, splits.hand_splits()).groupBy("l_suppkey", "split").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


@registry.add("SELECT l_suppkey, l_returnflag, CAST(grouping(l_returnflag) AS INT) AS is_total, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY GROUPING SETS ((l_suppkey, l_returnflag), (l_suppkey))")
def combined_and_by_type_grouping_sets(spark, sf):
    """Per type and combined, from one aggregate."""
    return splits.combined_and_each(table(spark, sf, "lineitem"), ["l_suppkey"], "l_returnflag", [F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("s")])


@registry.add("""
WITH k AS (SELECT l_suppkey, l_tax, COUNT(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT l_suppkey, l_tax, n, CAST(n AS DOUBLE) / SUM(n) OVER (PARTITION BY l_suppkey) AS share FROM k)
SELECT l.l_suppkey, l.l_tax, COUNT(*) AS n FROM lineitem l JOIN s ON l.l_suppkey = s.l_suppkey AND l.l_tax = s.l_tax WHERE round(s.share, 3) >= 0.1 GROUP BY 1, 2""")
def remove_rare_types(spark, sf):
    """Rows of kinds that make up a tenth of their scope at least."""
    kept = splits.without_rare_kinds(table(spark, sf, "lineitem"), ["l_suppkey"], "l_tax", 0.1)
    return kept.groupBy("l_suppkey", "l_tax").agg(F.count("*").alias("n"))


@registry.add("SELECT l_suppkey, l_returnflag, COUNT(*) AS n, CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY l_suppkey) AS share FROM lineitem GROUP BY 1, 2")
def share_by_type(spark, sf):
    """Each type's share of its entity."""
    counts = table(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    return splits.share_of(counts, ["l_suppkey"], "n")


@registry.add("SELECT c_mktsegment, o_orderstatus, CAST(grouping(c_mktsegment) + grouping(o_orderstatus) AS INT) AS level, COUNT(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ROLLUP (c_mktsegment, o_orderstatus)")
def subtotals_rollup(spark, sf):
    """Separate, combined and total rows."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return splits.subtotals(rows, ["c_mktsegment", "o_orderstatus"], [F.count("*").alias("n")])


@registry.add("""
SELECT o.l_orderkey, n.l_linenumber, COALESCE(d, 0) AS d FROM (SELECT DISTINCT l_orderkey FROM lineitem) o CROSS JOIN (SELECT DISTINCT l_linenumber FROM lineitem) n
LEFT JOIN (SELECT l_orderkey, l_linenumber, MAX(CAST(l_quantity AS INT)) AS d FROM lineitem GROUP BY 1, 2) x ON x.l_orderkey = o.l_orderkey AND x.l_linenumber = n.l_linenumber""")
def pivot_details(spark, sf):
    """A list of details as rows, one for every line number, 0 where one is missing."""
    rows = table(spark, sf, "lineitem")
    lists = rows.groupBy("l_orderkey", "l_linenumber").agg(F.max(F.col("l_quantity").cast("int")).alias("d"))
    lists = lists.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "d"))).alias("_d"))
    out = lists.crossJoin(F.broadcast(rows.select("l_linenumber").distinct()))
    return out.select("l_orderkey", "l_linenumber", F.coalesce(F.try_element_at("_d", "l_linenumber"), F.lit(0)).alias("d"))


@registry.add("""
SELECT f.l_returnflag, y.year, CAST(COALESCE(n, 0) AS BIGINT) AS n FROM (SELECT DISTINCT l_returnflag FROM lineitem) f CROSS JOIN (SELECT DISTINCT year(l_shipdate) AS year FROM lineitem) y
LEFT JOIN (SELECT l_returnflag, year(l_shipdate) AS year, COUNT(*) AS n FROM lineitem GROUP BY 1, 2) x ON x.l_returnflag = f.l_returnflag AND x.year = y.year""")
def pivot_share_by_year(spark, sf):
    """Mix of types by season, a row for each type and every season of the data."""
    counts = table(spark, sf, "lineitem").groupBy("l_returnflag", F.year("l_shipdate").alias("year")).agg(F.count("*").alias("n"))
    every = counts.select("l_returnflag").distinct().crossJoin(F.broadcast(counts.select("year").distinct()))
    return every.join(counts, ["l_returnflag", "year"], "left").na.fill(0, ["n"])


@registry.add("SELECT o_custkey, o_orderpriority, COUNT(*) AS games, CAST(COUNT(*) AS DOUBLE) / SUM(COUNT(*)) OVER (PARTITION BY o_custkey) AS percent FROM orders GROUP BY 1, 2")
def distribution_share(spark, sf):
    """Games by position, and their share."""
    return splits.distribution(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority")


@registry.add("SELECT n_nationkey, n_name, CAST(COALESCE(n, 0) AS BIGINT) AS n FROM nation LEFT JOIN (SELECT s_nationkey, COUNT(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) s ON n_nationkey = s_nationkey")
def all_entities_with_zero_fill(spark, sf):
    """Every team, also without a row."""
    facts = table(spark, sf, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return splits.all_entities(table(spark, sf, "nation").select("n_nationkey", "n_name"), facts, ["n_nationkey"])


@registry.add("""
WITH g AS (SELECT o.o_orderkey, c.c_nationkey AS away, s.s_nationkey AS home, SUM(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END) AS a, SUM(CASE WHEN l_linenumber % 2 = 1 THEN 1 ELSE 0 END) AS h
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey GROUP BY 1, 2, 3),
p AS (SELECT away AS team, a AS f, h AS ag FROM g UNION ALL SELECT home, h, a FROM g)
SELECT team, CAST(SUM(CASE WHEN f > ag THEN 1 ELSE 0 END) AS BIGINT) AS wins, CAST(SUM(CASE WHEN f > ag THEN 0 ELSE 1 END) AS BIGINT) AS losses,
  CAST(SUM(f) AS BIGINT) AS runs_scored, CAST(SUM(ag) AS BIGINT) AS runs_allowed FROM p GROUP BY team""")
def standings_two_perspectives(spark, sf):
    """Wins, losses and runs, each game from both sides."""
    o, c, li, s = (table(spark, sf, t) for t in ("orders", "customer", "lineitem", "supplier"))
    games = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(s, F.col("s_suppkey") == F.col("l_suppkey"))
    games = games.groupBy("o_orderkey", F.col("c_nationkey").alias("away"), F.col("s_nationkey").alias("home")).agg(
        F.count(F.when(F.col("l_linenumber") % 2 == 0, 1)).alias("a"), F.count(F.when(F.col("l_linenumber") % 2 == 1, 1)).alias("h"))
    return splits.standings(games, "away", "home", "a", "h")


@registry.add("SELECT o_custkey, CAST(COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS wins, CAST(COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS BIGINT) AS losses, CAST(COUNT(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS BIGINT) AS saves FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-30 00:00:00' AND year(o_orderdate) = 1996 GROUP BY o_custkey")
def to_date_record(spark, sf):
    """A record up to a day of a season."""
    rows = table(spark, sf, "orders").where((F.col("o_orderdate") <= F.lit("1996-06-30").cast("timestamp_ntz")) & (F.year("o_orderdate") == 1996))
    return rows.groupBy("o_custkey").agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("wins"), F.count(F.when(F.col("o_orderstatus") == "O", 1)).alias("losses"), F.count(F.when(F.col("o_orderpriority") == "1-URGENT", 1)).alias("saves"))


def _status(spark, sf, keys):
    r, n, c, o = (table(spark, sf, t) for t in ("region", "nation", "customer", "orders"))
    parents = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("c_nationkey") == F.col("n_nationkey")).withColumnRenamed("c_custkey", "o_custkey")
    sums = {"finished": F.col("o_orderstatus") == "F", "open": F.col("o_orderstatus") == "O", "urgent": F.col("o_orderpriority") == "1-URGENT"}
    out = status.rolled_up(parents, o, ["o_custkey"], keys, {k: v.cast("int") for k, v in sums.items()})
    return out.withColumn("percent_complete", status.percent_complete(F.col("finished"), F.col("total")))


def _status_sql(keys: str) -> str:
    return f"""SELECT *, CASE WHEN total > 0 THEN CAST(finished AS DOUBLE) / total ELSE 0.0 END AS percent_complete FROM (
  SELECT {keys}, COUNT(*) AS total, CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished, CAST(SUM(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open,
    CAST(SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent
  FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey GROUP BY {keys}) x"""


@registry.add(_status_sql("r_name"))
def status_by_region(spark, sf):
    """Seasons: sums over all below."""
    return _status(spark, sf, ["r_name"])


@registry.add(_status_sql("r_name, n_name"))
def status_by_nation(spark, sf):
    """Dates."""
    return _status(spark, sf, ["r_name", "n_name"])


@registry.add(_status_sql("o_custkey"))
def status_by_customer(spark, sf):
    """Games."""
    return _status(spark, sf, ["o_custkey"])


_ORDER_STATUS = """SELECT {0} COUNT(*) AS total, CAST(SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished,
  CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, CAST(SUM(l_linenumber) AS BIGINT) AS lines FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY {1}"""


def _by_order(spark, sf, keys):
    lines = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    sums = {"finished": (F.col("l_linestatus") == "F").cast("int"), "returned": (F.col("l_returnflag") == "R").cast("int"), "lines": F.col("l_linenumber")}
    return status.rolled_up(table(spark, sf, "orders"), lines, ["o_orderkey"], keys, sums)


@registry.add(_ORDER_STATUS.format("o_orderkey,", "o_orderkey"))
def status_by_order(spark, sf):
    """Pitch appearances of a game."""
    return _by_order(spark, sf, ["o_orderkey"])


@registry.add(_ORDER_STATUS.format("o_custkey, o_orderstatus, o_orderkey,", "o_custkey, o_orderstatus, o_orderkey"))
def status_by_order_with_parent(spark, sf):
    """The same with its parents' columns, as keys."""
    return _by_order(spark, sf, ["o_custkey", "o_orderstatus", "o_orderkey"])


@registry.add("""
SELECT l_orderkey, CASE WHEN f = n THEN 'all' WHEN f > 0 THEN 'some' ELSE 'none' END AS finished, f = n AND r = 0 AS eligible, r > 0 AS error, n >= 5 AND r = 0 AS wide
FROM (SELECT l_orderkey, COUNT(*) AS n, SUM(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS f, SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS r FROM lineitem GROUP BY 1) x WHERE n >= 2 AND (f = n OR r > 0)""")
def eligible_ids_having(spark, sf):
    """Predicates on sums: what is eligible, complete, in error."""
    sums = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count(F.when(F.col("l_linestatus") == "F", 1)).alias("f"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("r"))
    kept = sums.where("n >= 2 AND (f = n OR r > 0)")
    text = status.described([(F.col("f") == F.col("n"), "all"), (F.col("f") > 0, "some")], "none")
    return kept.select("l_orderkey", text.alias("finished"), F.expr("f = n AND r = 0").alias("eligible"), F.expr("r > 0").alias("error"), F.expr("n >= 5 AND r = 0").alias("wide"))


@registry.add("""
SELECT c_mktsegment, COALESCE(list_sort(list(o_orderkey) FILTER (WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT')), []) AS urgent_done,
  COALESCE(list_sort(list(o_orderkey) FILTER (WHERE o_orderstatus = 'P')), []) AS pending FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def id_lists_by_predicate(spark, sf):
    """Audit report: lists of ids that meet each predicate."""
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    conditions = {"urgent_done": (F.col("o_orderstatus") == "F") & (F.col("o_orderpriority") == "1-URGENT"), "pending": F.col("o_orderstatus") == "P"}
    return status.id_lists(rows, ["c_mktsegment"], "o_orderkey", conditions)


@registry.add("""
WITH i AS (SELECT l_orderkey, l_suppkey, MIN(l_linenumber) AS r FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2),
ids AS (SELECT l_orderkey, list(l_suppkey ORDER BY r, l_suppkey) AS returned_ids, COUNT(*) AS returned_count FROM i GROUP BY 1)
SELECT a.l_orderkey, lines, any_returned, COALESCE(returned_count, 0) AS returned_count, COALESCE(returned_ids, []) AS returned_ids
FROM (SELECT l_orderkey, CAST(SUM(l_linenumber) AS BIGINT) AS lines, bool_or(l_returnflag = 'R') AS any_returned FROM lineitem GROUP BY 1) a LEFT JOIN ids ON ids.l_orderkey = a.l_orderkey""")
def event_audit(spark, sf):
    """Sums, any-error flags, distinct counts and ordered ids per game (an id's first row orders it)."""
    rows = table(spark, sf, "lineitem")
    out = status.event_audit(rows, ["l_orderkey"], "l_suppkey", "l_linenumber", {"lines": F.col("l_linenumber")}, {"returned": F.col("l_returnflag") == "R"})
    return out.select("l_orderkey", "lines", "any_returned", "returned_count", "returned_ids")


@registry.add("SELECT o_custkey, bool_or(o_orderstatus = 'P') AS any_pending, bool_and(o_orderstatus = 'P') AS all_pending FROM orders GROUP BY 1")
def any_and_all(spark, sf):
    """Any and all over children."""
    return status.any_and_all(table(spark, sf, "orders"), ["o_custkey"], {"pending": F.col("o_orderstatus") == "P"})


@registry.add("""
SELECT user_id, list_transform(list_sort(list({'o': -n, 'k': event_type})), lambda x: x.k) AS kinds, list_transform(list_sort(list({'o': -n, 'k': event_type})), lambda x: -x.o) AS counts
FROM (SELECT user_id, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2) x GROUP BY user_id""")
def counts_by_kind(spark, sf):
    """Counts per kind as an ordered map, greatest first."""
    out = status.counted_map(table(spark, sf, "events"), ["user_id"], "event_type", "m", by_count=True)
    return out.select("user_id", F.col("m.key").alias("kinds"), F.col("m.count").alias("counts"))


@registry.add("SELECT user_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, COUNT(DISTINCT event_type) AS kinds, CAST(MAX(value) AS DOUBLE) AS top FROM events GROUP BY 1, 2")
def distinct_per_day(spark, sf):
    """Distinct aggregation per person and day."""
    return table(spark, sf, "events").groupBy("user_id", day("ts").cast("string").alias("day")).agg(F.count_distinct("event_type").alias("kinds"), F.max("value").alias("top"))


@registry.add("SELECT o_orderpriority, COUNT(*) AS n, round(stddev_samp(CAST(o_custkey AS DOUBLE)), 6) AS sd FROM orders GROUP BY 1")
def standard_deviation(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.stddev_samp(F.col("o_custkey").cast("double")), 6).alias("sd"))


@registry.add("SELECT COUNT(*) AS n FROM orders")
def row_count(spark, sf):
    return table(spark, sf, "orders").agg(F.count("*").alias("n"))


@registry.add("SELECT l_suppkey, printf('%.3f', CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / COUNT(*)) AS rate FROM lineitem GROUP BY 1")
def printed_rates(spark, sf):
    """Ratios as printed text."""
    rate = safe_ratio(F.count(F.when(F.col("l_returnflag") == "R", 1)), F.count("*"))
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.format_number(half_even(rate, 3), 3).alias("rate"))
