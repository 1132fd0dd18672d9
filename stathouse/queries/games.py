"""Games, pages and stores over the driver's tables: an order is a game, its lines are plays."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import expressions as X
from ..operators import status
from ..plans import games, reconcile
from ..sources import pages, store, tables
from .common import Registry, day, events, table

registry = Registry()

_HALF = "SELECT l_orderkey, CAST(l_partkey % 12 AS INT) + 1 AS inning, l_suppkey % 2 = 1 AS bottom, CAST(SUM(l_linenumber % 3) AS BIGINT) AS runs FROM lineitem GROUP BY 1, 2, 3"
_LINE = f"WITH h AS ({_HALF}), r AS (SELECT l_orderkey, inning, SUM(runs) FILTER (WHERE NOT bottom) AS away, SUM(runs) FILTER (WHERE bottom) AS home FROM h GROUP BY 1, 2)"


def _halves(spark, sf):
    plays = table(spark, sf, "lineitem").select("l_orderkey", ((F.col("l_partkey") % 12).cast("int") + 1).alias("inning"), (F.col("l_suppkey") % 2 == 1).alias("bottom"), F.concat(F.lit("O"), F.repeat(F.lit("R"), (F.col("l_linenumber") % 3).cast("int"))).alias("result"))
    return games.half_innings(plays, ["l_orderkey"], "inning", "bottom", "result")


@registry.add(_HALF)
def runs_by_half_inning(spark, sf):
    """Runs of each half inning, counted from the letters of results."""
    return _halves(spark, sf)


@registry.add(_LINE + " SELECT l_orderkey, CAST(SUM(away) AS BIGINT) AS away_runs, CAST(SUM(home) AS BIGINT) AS home_runs, COUNT(*) > 9 AS extra_innings, string_agg(inning || ':' || COALESCE(CAST(away AS VARCHAR), '-') || ':' || COALESCE(CAST(home AS VARCHAR), '-'), ' ' ORDER BY inning) AS line FROM r GROUP BY 1")
def line_score(spark, sf):
    """Runs by inning of both sides, and totals."""
    out = games.line_score(_halves(spark, sf), ["l_orderkey"], "inning", "bottom")
    text = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    return out.select("l_orderkey", "away_runs", "home_runs", "extra_innings", F.array_join(F.transform("line", lambda x: F.concat_ws(":", x["inning"].cast("string"), text(x["away"]), text(x["home"]))), " ").alias("line"))


@registry.add(_LINE + """, s AS (SELECT *, COALESCE(away, 0) + COALESCE(home, 0) AS n, COUNT(*) FILTER (WHERE COALESCE(away, 0) + COALESCE(home, 0) > 0) OVER (PARTITION BY l_orderkey) AS k FROM r),
p AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN n > 0 THEN 0 ELSE 1 END, CASE WHEN k > 3 THEN -n ELSE inning END, CASE WHEN k > 3 THEN -inning ELSE inning END) AS place FROM s)
SELECT l_orderkey, list(inning ORDER BY inning) AS shown FROM p WHERE place <= 3 GROUP BY 1""")
def condensed_line_score(spark, sf):
    """The innings that a line of three columns shows."""
    lines = games.line_score(_halves(spark, sf), ["l_orderkey"], "inning", "bottom")
    return games.condensed(lines, ["l_orderkey"], 3)


@registry.add("""
WITH g AS (SELECT l_orderkey, l_suppkey % 7 AS home, CAST(l_shipdate AS DATE) AS d, l_linenumber AS n FROM lineitem), one AS (SELECT home, d, n, MIN(l_orderkey) AS k FROM g WHERE n <= 2 GROUP BY 1, 2, 3)
SELECT k, n, home || strftime(d, '%Y%m%d') || CAST(CASE WHEN MAX(n) OVER (PARTITION BY d, home) >= 2 THEN n ELSE 0 END AS VARCHAR) AS game_id FROM one""")
def doubleheader_ids(spark, sf):
    """Ids of games: 0 for a single game of a day, 1 and 2 for two."""
    g = table(spark, sf, "lineitem").where("l_linenumber <= 2").groupBy((F.col("l_suppkey") % 7).alias("home"), F.col("l_shipdate").cast("date").alias("d"), F.col("l_linenumber").alias("n")).agg(F.min("l_orderkey").alias("k"))
    return games.doubleheader_ids(g, "d", "home", "n").select("k", "n", "game_id")


_STATUS = "SELECT c_custkey, CAST(c_custkey % 2 AS INT) AS dash_a, CAST(c_custkey % 3 = 0 AS INT) AS dash_b, c_custkey % 5 = 0 AND c_custkey % 2 = 1 AS all_boxscores, c_custkey % 7 < 2 AND c_custkey % 2 = 1 AS all_pitch_logs, c_custkey % 35 = 0 AND c_custkey % 3 = 0 AS all_pitchfx, CAST(c_custkey % 8 AS INT) AS done FROM customer"


@registry.add(f"""
WITH s AS ({_STATUS}) SELECT c_custkey, CASE WHEN all_boxscores AND all_pitch_logs AND all_pitchfx THEN 'Scraped all game data'
  WHEN all_boxscores AND all_pitch_logs THEN 'Missing Brooks pitchfx logs (' || done || '/8, ' || CAST(round_even(done * 100 / 8.0, 0) AS INT) || '%)'
  WHEN all_pitch_logs AND NOT all_pitchfx THEN 'Scraped Brooks pitch logs, missing BBref boxscores' WHEN all_boxscores AND NOT all_pitchfx THEN 'Scraped BBref boxscores, missing Brooks pitch logs'
  WHEN NOT all_boxscores AND NOT all_pitch_logs AND NOT all_pitchfx AND dash_a = 1 AND dash_b = 1 THEN 'Missing BBref boxscores and Brooks pitch logs'
  WHEN NOT all_boxscores AND NOT all_pitch_logs AND NOT all_pitchfx AND dash_a = 0 AND dash_b = 1 THEN 'Scraped Brooks daily dashboard, missing BBref daily dash'
  WHEN NOT all_boxscores AND NOT all_pitch_logs AND NOT all_pitchfx AND dash_a = 1 AND dash_b = 0 THEN 'Scraped BBref daily dashboard, missing Brooks daily dash'
  WHEN dash_a = 0 AND dash_b = 0 THEN 'No data has been scraped' ELSE 'N/A' END AS description FROM s""")
def day_status_text(spark, sf):
    """The ten texts of a day's status."""
    k = F.col("c_custkey")
    s = table(spark, sf, "customer").select("c_custkey", (k % 2).cast("int").alias("dash_a"), (k % 3 == 0).cast("int").alias("dash_b"), ((k % 5 == 0) & (k % 2 == 1)).alias("all_boxscores"), ((k % 7 < 2) & (k % 2 == 1)).alias("all_pitch_logs"), ((k % 35 == 0) & (k % 3 == 0)).alias("all_pitchfx"), (k % 8).alias("pitchfx_done"), F.lit(8).alias("pitchfx_total"))
    return games.day_description(s).select("c_custkey", "description")


@registry.add("SELECT o_custkey, SUM(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) > 0 AND SUM(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) = 0 AS only_patched FROM orders GROUP BY 1")
def only_patched_data(spark, sf):
    """Whether all that was wrong has been patched."""
    n = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    return table(spark, sf, "orders").groupBy("o_custkey").agg(games.only_patched(n("F"), n("P")).alias("only_patched"))


@registry.add("SELECT c_custkey, COALESCE(bool_or(o_orderstatus = 'F'), true) AS any_done, COALESCE(bool_and(o_orderstatus = 'F'), true) AS all_done FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def any_and_all_defaults(spark, sf):
    """Any and all over children; those without children take the default."""
    flags = status.any_and_all(table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"], {"done": F.col("o_orderstatus") == "F"})
    return games.any_and_all_or(table(spark, sf, "customer").select("c_custkey"), flags, ["c_custkey"], True)


@registry.add("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 'skip' WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4) THEN 'cached' ELSE 'missing' END AS class FROM orders")
def job_classes(spark, sf):
    """Addresses of a job: done, in the cache, or missing."""
    li = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return games.job_classes(table(spark, sf, "orders").select("o_orderkey"), li.where("l_returnflag = 'R'"), li.where("l_linenumber = 4"), "o_orderkey")


@registry.add(_LINE + """, t AS (SELECT l_orderkey, CAST(SUM(away) AS BIGINT) AS away_runs, CAST(SUM(home) AS BIGINT) AS home_runs FROM r GROUP BY 1),
b AS (SELECT l_orderkey, COUNT(*) FILTER (WHERE l_suppkey % 2 = 0) AS n_batting, COUNT(*) FILTER (WHERE l_suppkey % 2 = 1) AS n_pitching FROM lineitem GROUP BY 1)
SELECT o_orderkey AS l_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS game_date, away_runs, home_runs, n_batting, n_pitching FROM orders LEFT JOIN t ON t.l_orderkey = o_orderkey LEFT JOIN b ON b.l_orderkey = o_orderkey""")
def scoreboard(spark, sf):
    """Box pages of the games of every date."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")
    g = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), day("o_orderdate").alias("game_date"))
    lines = games.line_score(_halves(spark, sf), ["l_orderkey"], "inning", "bottom")
    box = games.box_page(g, lines, li.where("l_suppkey % 2 = 0"), li.where("l_suppkey % 2 = 1"), "l_orderkey")
    size = lambda c: F.when(F.col("away_runs").isNotNull() | F.col("home_runs").isNotNull(), F.coalesce(F.size(c), F.lit(0))).cast("long").alias(f"n_{c}")
    return box.select("l_orderkey", F.col("game_date").cast("string").alias("game_date"), "away_runs", "home_runs", size("batting"), size("pitching"))


@registry.add("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 1 THEN '1 out' ELSE CAST(l_linenumber % 3 AS VARCHAR) || ' outs' END || ', ' || CASE l_suppkey % 3 WHEN 0 THEN 'bases empty' WHEN 1 THEN '1 on' ELSE '1-3 on' END || ', ' || l_linenumber || '-' || l_linenumber % 3 || ': Play ' || l_partkey AS text FROM lineitem")
def play_narrative(spark, sf):
    """A sentence for each play."""
    n = F.col("l_linenumber")
    runners = F.when(F.col("l_suppkey") % 3 == 0, "---").when(F.col("l_suppkey") % 3 == 1, "1--").otherwise("1-3")
    score, play = F.concat(n.cast("string"), F.lit("-"), (n % 3).cast("string")), F.concat(F.lit("Play "), F.col("l_partkey").cast("string"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", games.narrative(n % 3, runners, score, play).alias("text"))


@registry.add("""
WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END AS number FROM events),
s AS (SELECT *, COUNT(number) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run, COALESCE(last_value(number IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS seen FROM e)
SELECT event_id, CAST(seen + row_number() OVER (PARTITION BY user_id, run ORDER BY ts, event_id) - CASE WHEN run = 0 THEN 0 ELSE 1 END AS BIGINT) AS ab_number FROM s""")
def synthetic_at_bat_numbers(spark, sf):
    """An at-bat without a number takes one more than the one before."""
    e = events(spark, sf).select("event_id", "user_id", "us", F.when(F.col("event_id") % 3 != 0, F.col("event_id")).alias("number"))
    return games.synthetic_numbers(e, ["user_id"], ["us", "event_id"], "number").select("event_id", "ab_number")


@registry.add("SELECT CAST(year(o_orderdate) AS INT) AS season, CAST(MAX(CAST(o_orderdate AS DATE)) FILTER (WHERE o_orderstatus = 'F') AS VARCHAR) AS latest FROM orders GROUP BY 1")
def latest_complete_day(spark, sf):
    """The last day of each season whose data is complete."""
    d = table(spark, sf, "orders").select(F.year("o_orderdate").alias("season"), day("o_orderdate").alias("d"), "o_orderstatus")
    return games.latest_complete(d, "season", "d", F.col("o_orderstatus") == "F").select("season", F.col("latest").cast("string").alias("latest"))


@registry.add("""
WITH c AS (SELECT l_suppkey, l_linenumber, COUNT(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey AS app, string_agg(l_linenumber || ':' || n, ' ' ORDER BY l_linenumber) AS innings, CAST(SUM(n) AS BIGINT) AS total, MIN(p.first) AS first FROM c JOIN (SELECT l_suppkey AS k, first(l_orderkey * 10 + l_linenumber ORDER BY l_shipdate, l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY 1) p ON p.k = l_suppkey GROUP BY 1""")
def regrouped_logs(spark, sf):
    """Logs rebuilt after a patch: pitches in order of time, counts by inning."""
    p = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("app"), F.col("l_linenumber").alias("inning"), F.col("l_shipdate").alias("park_sv_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pitch_id"))
    out = games.regrouped(p, "app", "park_sv_id")
    text = F.array_join(F.transform("by_inning", lambda x: F.concat_ws(":", x["key"].cast("string"), x["count"].cast("string"))), " ")
    return out.select("app", text.alias("innings"), "total", F.col("pitches")[0].alias("first"))


@registry.add("SELECT DISTINCT l_suppkey, l_partkey FROM lineitem")
def bridge_pairs(spark, sf):
    """The pairs of a many-to-many relation."""
    return games.bridge(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@registry.add("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
def home_or_away(spark, sf):
    """Games of a team, at home or away."""
    return table(spark, sf, "orders").where((F.col("o_orderstatus") == "F") | (F.col("o_orderpriority") == "1-URGENT")).select("o_orderkey")


@registry.add("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE NOT (l_linenumber = 2 AND l_returnflag = 'A') AND l_tax > 0.01")
def class_flavour_filter(spark, sf):
    """Only what is invalid goes; handedness isn't asked."""
    invalid = (F.col("l_linenumber") == 2) & (F.col("l_returnflag") == "A")
    return table(spark, sf, "lineitem").where(~invalid & (F.col("l_tax") > 0.01)).select("l_orderkey", "l_linenumber", "l_suppkey")


@registry.add("SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS d, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_extendedprice DESC, l_linenumber) AS INT) AS place FROM lineitem WHERE l_tax > 0.07")
def barrels_by_date(spark, sf):
    """Barrels of each date, by game and launch speed."""
    from ..operators import ordered

    li = table(spark, sf, "lineitem").where("l_tax > 0.07").withColumn("d", day("l_shipdate"))
    return ordered.ranked(li, ["d"], ["l_orderkey", F.desc("l_extendedprice"), "l_linenumber"], "place").select(F.col("d").cast("string").alias("d"), "l_orderkey", "l_linenumber", "place")


@registry.add("SELECT o_orderkey, month(o_orderdate) * 100 + day(o_orderdate) BETWEEN 328 AND 929 AS in_season, year(o_orderdate) >= 1992 + 30 - 30 AS after_limit FROM orders")
def date_in_season(spark, sf):
    """Whether a date lies in its season, and after the debut limit (thirty years before the first season)."""
    d = F.col("o_orderdate")
    season = d.cast("date").between(F.make_date(F.year(d), F.lit(3), F.lit(28)), F.make_date(F.year(d), F.lit(9), F.lit(29)))
    return table(spark, sf, "orders").select("o_orderkey", season.alias("in_season"), (F.year(d) >= 2022 - 30).alias("after_limit"))


@registry.add("SELECT o_orderkey, CASE WHEN o_orderkey % 3000 BETWEEN 1871 AND 2100 THEN CAST(o_orderkey % 3000 AS INT) END AS year, CAST(o_orderkey % 9 * 60 + o_orderkey % 60 AS INT) AS minutes, CAST(o_orderkey % 9000 // 3600 AS VARCHAR) AS hours FROM orders")
def years_and_spans(spark, sf):
    """Valid years, minutes of h:mm, and the hours of a span's text."""
    k = F.col("o_orderkey")
    hm = F.format_string("%d:%02d", k % 9, k % 60)
    text = X.span_text(k % 9000)
    return table(spark, sf, "orders").select("o_orderkey", X.valid_year((k % 3000).cast("string")).alias("year"), X.hours_minutes(hm).cast("int").alias("minutes"), F.coalesce(F.nullif(F.regexp_extract(text, r"^(\d+)h", 1), F.lit("")), F.lit("0")).alias("hours"))


@registry.add("SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def view_scan(spark, sf):
    """Tables as views, and a view over them."""
    store.as_views({f"sh_{t}": table(spark, sf, t) for t in ("supplier", "nation")})
    spark.sql("CREATE OR REPLACE TEMP VIEW sh_supplier_nation AS SELECT s_suppkey, s_name, n_name FROM sh_supplier JOIN sh_nation ON s_nationkey = n_nationkey")
    return spark.table("sh_supplier_nation")


@registry.add("SELECT CAST(y AS INT) AS year, CAST(make_date(y, 3, 28) AS VARCHAR) AS starts, CAST(make_date(y, 9, 29) AS VARCHAR) AS ends FROM range(1992, 2010) r(y)")
def season_dimension(spark, sf):
    """Eighteen seasons as literal rows."""
    import datetime

    rows = [(y, datetime.date(y, 3, 28), datetime.date(y, 9, 29)) for y in range(1992, 2010)]
    return spark.createDataFrame(rows, "year int, starts date, ends date").select("year", F.col("starts").cast("string").alias("starts"), F.col("ends").cast("string").alias("ends"))


@registry.add("SELECT c_custkey, c_name AS name, c_nationkey AS nation FROM customer")
def naive_csv(spark, sf):
    """CSV texts without quotes to typed rows."""
    row = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string"))
    texts = table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.concat(F.lit("id,name,nation\n"), F.array_join(F.collect_list(row), "\r\n")).alias("text"))
    schema = T.StructType([T.StructField("c_custkey", T.LongType()), T.StructField("name", T.StringType()), T.StructField("nation", T.IntegerType())])
    return store.from_naive_csv(texts, "text", schema).drop("c_mktsegment")


@registry.add("SELECT s_suppkey AS id, s_name AS name, CAST(make_date(1970 + CAST(s_suppkey % 30 AS INT), 6, 1) AS VARCHAR) AS birth_date, CASE WHEN s_suppkey % 2 = 0 THEN 'R' ELSE 'L' END AS bats FROM supplier")
def player_service(spark, sf):
    """Rows of a player service's JSON answers."""
    k = F.col("s_suppkey")
    person = F.struct(k.cast("int").alias("id"), F.col("s_name").alias("fullName"), F.format_string("%d-06-01", 1970 + k % 30).alias("birthDate"), F.struct(F.when(k % 2 == 0, "R").otherwise("L").alias("code")).alias("batSide"))
    docs = table(spark, sf, "supplier").select(F.to_json(F.struct(F.array(person).alias("people"))).alias("doc"))
    return store.player_json(docs, "doc").select(F.col("id").cast("long").alias("id"), "name", F.col("birth_date").cast("string").alias("birth_date"), "bats")


@registry.add("SELECT s_suppkey, s_nationkey, n_regionkey AS region_id FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def backup_and_restore(spark, sf):
    """Tables as CSV, read back in order of dependency, keys looked up anew."""
    path = tables.shared_path(spark)
    nation = table(spark, sf, "nation").select((F.col("n_nationkey") + 1).alias("nk"), "n_name", (F.col("n_regionkey") + 1).alias("rk"))
    supplier = table(spark, sf, "supplier").select((F.col("s_suppkey") + 1).alias("sk"), (F.col("s_nationkey") + 1).alias("nk"))
    store.backup({"nation": nation, "supplier": supplier}, path)
    back = store.restore(spark, path, {"nation": nation.schema, "supplier": supplier.schema}, ["nation", "supplier"], {"supplier": [("nation", ["nk"], "rk", "region_id")]})
    return back["supplier"].select((F.col("sk") - 1).alias("s_suppkey"), (F.col("nk") - 1).alias("s_nationkey"), (F.col("region_id") - 1).alias("region_id"))


@registry.add("SELECT o_orderkey, o_custkey FROM orders")
def batched_insert(spark, sf):
    """Rows in files of at most 20,000."""
    return store.in_batches(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), tables.shared_path(spark))


@registry.add("SELECT s_suppkey, s_name FROM supplier")
def saved_twice(spark, sf):
    """The same rows at two places; what is read is the second."""
    df = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    paths = [tables.shared_path(spark), tables.shared_path(spark)]
    said = store.save_everywhere(df, paths)
    return spark.read.schema(df.schema).json([p for p in paths if said[p] is None][-1])


@registry.add("SELECT rpad(CAST(s_suppkey AS VARCHAR), 8, ' ') || ' | ' || rpad(s_name, 24, ' ') AS line FROM supplier")
def report_table(spark, sf):
    """A report's rows as text."""
    return store.report_lines(table(spark, sf, "supplier"), {"s_suppkey": 8, "s_name": 24})


@registry.add("SELECT o_custkey AS c_custkey, COUNT(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey > 3) GROUP BY 1")
def orphaned_ids(spark, sf):
    """Ids that facts use and the dimension lacks."""
    return store.orphans(table(spark, sf, "orders"), table(spark, sf, "customer").where("c_nationkey > 3"), "o_custkey", "c_custkey")


@registry.add("SELECT o_orderkey, CAST(1 + o_orderkey % 5 AS INT) AS step FROM orders WHERE o_orderkey % 6 < 5")
def import_steps(spark, sf):
    """Files by the step at which their data set is imported."""
    names = F.array(*map(F.lit, store.IMPORT_ORDER))
    k = F.col("o_orderkey")
    found = table(spark, sf, "orders").select("o_orderkey", F.when(k % 6 < 5, F.element_at(names, (k % 5 + 1).cast("int"))).otherwise("unknown").alias("kind"))
    return store.import_order(found, "kind").select("o_orderkey", "step")


def _pages(spark, sf, header: str, cells):
    """A page for each order: a table with a header and a row for each line."""
    names = F.array(*(F.lit(h) for h in header.split(",")))
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.array(*(c.cast("string") for c in cells)).alias("c")))).alias("r"))
    return rows.select("page_id", F.concat(F.lit("<html><title>Name "), F.col("page_id").cast("string"), F.lit("</title><a href='http://x.org/pfx.php?game=gid_"), F.col("page_id").cast("string"), F.lit("&pitchSel="), F.col("page_id").cast("string"), F.lit("'>log</a>"), pages.html_table(F.concat(F.array(names), F.transform("r", lambda x: x["c"]))), F.lit("</html>")).alias("html"))


@registry.add("SELECT l_orderkey AS page_id, l_linenumber AS id, CASE WHEN l_linenumber % 2 = 0 THEN 'missing_des' ELSE l_returnflag END AS des, CASE WHEN l_linenumber % 3 = 0 THEN 99 ELSE CAST(l_suppkey % 14 AS INT) END AS zone_location, l_tax AS px FROM lineitem")
def parse_pitch_table(spark, sf):
    """Pitch tables of pages to typed rows; missing values have their marks."""
    n = F.col("l_linenumber")
    cells = [F.col("l_partkey"), n, F.when(n % 2 == 1, F.col("l_returnflag")), F.when(n % 3 != 0, F.col("l_suppkey") % 14), F.col("l_tax")]
    return pages.pitch_table(_pages(spark, sf, "park_sv_id,id,des,zone_location,px", cells), "page_id", "html").select("page_id", "id", "des", "zone_location", "px")


@registry.add("SELECT l_orderkey AS page_id, 'Name ' || l_orderkey AS pitcher_name, l_orderkey AS pitcher_id_mlb, 'gid_' || l_orderkey AS bb_game_id, CAST(SUM(CAST(l_quantity AS INT)) AS BIGINT) AS total_pitch_count FROM lineitem GROUP BY 1")
def parse_pitch_log(spark, sf):
    """Pitch logs of pages: the pitcher, his game, his pitches."""
    rows = pages.pitch_log(_pages(spark, sf, "Inning,Pitches", [F.col("l_linenumber"), F.col("l_quantity").cast("int")]), "page_id", "html")
    return rows.select("page_id", "pitcher_name", "pitcher_id_mlb", "bb_game_id", "total_pitch_count")


@registry.add("SELECT l_orderkey AS page_id, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS ab, COUNT(*) FILTER (WHERE l_suppkey % 2 = 0) AS details FROM lineitem GROUP BY 1")
def parse_box_score(spark, sf):
    """Batting tables of box scores to typed rows."""
    made = _pages(spark, sf, "Batting,AB,Details", [F.col("l_suppkey"), F.col("l_linenumber"), F.when(F.col("l_suppkey") % 2 == 0, "2B")])
    rows = pages.box_score(made, "page_id", "html")["Batting"]
    return rows.groupBy("page_id").agg(F.count("*").alias("n"), F.sum("ab").cast("long").alias("ab"), F.count("details").alias("details"))


@registry.add("SELECT o_orderkey AS page_id, 'ABC' || strftime(o_orderdate, '%Y%m%d') || '0' AS game_id, true AS right_day FROM orders")
def parse_games_of_day(spark, sf):
    """Box scores that a day's page links to; all-star games are left out."""
    d = F.date_format("o_orderdate", "yyyyMMdd")
    made = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), day("o_orderdate").alias("d"), F.concat(F.lit("<a href='/boxes/ABC/ABC"), d, F.lit("0.shtml'>x</a><a href='/allstar/boxes/1.shtml'>y</a><a href='/about'>z</a>")).alias("html"))
    return pages.games_of_day(made, "page_id", "html", "d").select("page_id", "game_id", "right_day")


@registry.add("SELECT l_orderkey AS page_id, 'gid_' || (l_suppkey % 2) AS bb_game_id, COUNT(DISTINCT l_partkey) AS pitcher_appearance_count FROM lineitem GROUP BY 1, 2")
def parse_dashboard(spark, sf):
    """Games of a dashboard and how many pitchers have a log."""
    link = F.concat(F.lit("<a href='http://x.org/l.php?game=gid_"), (F.col("l_suppkey") % 2).cast("string"), F.lit("&pitchSel="), F.col("l_partkey").cast("string"), F.lit("'>x</a>"))
    made = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_join(F.collect_list(link), "").alias("html"))
    return pages.appearances_of_day(made, "page_id", "html").select("page_id", "bb_game_id", "pitcher_appearance_count")


@registry.add("SELECT l_orderkey, l_linenumber, 'P' || l_suppkey AS incoming_name, CASE WHEN l_linenumber % 2 = 0 THEN 'PH' ELSE 'P' END AS incoming_pos, 'Q' || l_partkey AS outgoing_name, 'CF' AS outgoing_pos, 1 + l_linenumber % 9 AS lineup_slot, CASE WHEN l_linenumber % 2 = 0 THEN 'bat' ELSE 'pitch' END AS kind FROM lineitem")
def substitutions(spark, sf):
    """Sentences of substitutions to fields."""
    n = F.col("l_linenumber")
    s = F.concat(F.lit("P"), F.col("l_suppkey").cast("string"), F.when(n % 2 == 0, " pinch hits for Q").otherwise(" replaces Q"), F.col("l_partkey").cast("string"), F.lit(" (CF) "), F.when(n % 2 == 0, "").otherwise("pitching "), F.lit("batting "), (1 + n % 9).cast("string"), F.lit("th"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", games.substitution(s).alias("s")).select("l_orderkey", "l_linenumber", "s.*")


@registry.add("SELECT o_orderkey, CAST(o_custkey % 20 AS INT) AS runs, CAST(o_custkey % 9 AS INT) AS hits, CAST(o_custkey % 3 AS INT) AS errors, CAST(o_custkey % 5 AS INT) AS left_on_base FROM orders")
def inning_total_sentences(spark, sf):
    """Closing sentences of innings to numbers."""
    k = F.col("o_custkey")
    t = F.format_string("%d runs, %d hits, %d errors, %d LOB. Blue Jays 3, Mariners 4.", k % 20, k % 9, k % 3, k % 5)
    return table(spark, sf, "orders").select("o_orderkey", games.inning_totals(t).alias("t")).select("o_orderkey", "t.runs", "t.hits", "t.errors", "t.left_on_base")


@registry.add("SELECT o_orderkey, CAST(10000 + o_custkey % 30000 AS INT) AS attendance, 'Some Park' AS park_name, CAST(120 + o_custkey % 60 AS INT) AS duration, 'Night Game' AS day_night, 'On Grass' AS field_type, CAST(50 + o_custkey % 40 AS INT) AS temperature, 'Wind 5mph out to Centerfield' AS wind, 'Cloudy' AS clouds, true AS parsed FROM orders")
def game_meta(spark, sf):
    """Meta lines and weather of a game."""
    k = F.col("o_custkey")
    crowd = F.concat(F.lit("Attendance: "), F.format_number(10000 + k % 30000, 0))
    lines = F.array(crowd, F.lit(": Some Park"), F.format_string("Game Duration: 2:%02d", k % 60), F.lit("Night Game, on grass"), F.lit("Start Time: 7:05 p.m. Local"))
    sky = F.concat((50 + k % 40).cast("string"), F.lit("° F, Wind 5mph out to Centerfield, Cloudy, No Precipitation."))
    out = games.game_meta(table(spark, sf, "orders").select("o_orderkey", lines.alias("lines"), sky.alias("sky")), "lines", "sky")
    return out.select("o_orderkey", "attendance", "park_name", "duration", "day_night", "field_type", "temperature", "wind", "clouds", "parsed")


@registry.add("""
SELECT CAST(user_id AS VARCHAR) AS game_id, COUNT(*) AS at_bats, CAST(SUM(2 + CAST(event_id % 2 = 0 AS INT)) AS BIGINT) AS pitches_due, CAST(SUM(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 2 + CAST(event_id % 2 = 0 AS INT) END) AS BIGINT) AS pitches_chosen,
  CAST(SUM(CASE WHEN event_id % 7 = 0 THEN 1 + CAST(event_id % 2 = 0 AS INT) ELSE 0 END) AS BIGINT) AS pitches_missing, CAST(SUM(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pitches_removed,
  CAST(0 AS BIGINT) AS pitches_invalid, CAST(SUM(CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS at_bats_missing, CAST(SUM(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS at_bats_removed, CAST(0 AS BIGINT) AS at_bats_invalid,
  bool_or(event_id % 7 = 0) AS has_error FROM events GROUP BY user_id""")
def combine_games(spark, sf):
    """Play-by-play rows and pitches through at-bats, numbering, reconciliation and audit.

    Each event is a complete at-bat; some have only their first pitch, some
    have that one twice, the second too late.
    """
    e = events(spark, sf)
    rows = e.select(F.col("user_id").cast("string").alias("game_id"), F.row_number().over(_by_user()).alias("row"), F.lit(1).alias("inning"), F.concat(F.lit("K"), (F.col("event_id") % 3).cast("string")).alias("base_key"), F.lit("event").alias("kind"), F.when(F.col("event_id") % 2 == 0, "CSS").otherwise("BX").alias("sequence"), F.lit(0).alias("outs_before"), F.lit(0).alias("outs_on_play"), F.lit(False).alias("interference"))
    at_bats = reconcile.at_bats(rows)
    need = at_bats.select("at_bat_id", "game_id", "number", "inning", "pitches", F.lit(0.0).alias("game_start"))
    ids = e.select(F.col("user_id").cast("string").alias("game_id"), F.row_number().over(_by_user()).alias("number"), "event_id")
    pitches = at_bats.join(ids, ["game_id", "number"]).select("game_id", "base_key", F.col("number").alias("ab_id"), "event_id", F.explode(F.sequence(F.lit(1), F.col("pitches"))).alias("ab_count"))
    pitches = pitches.where("event_id % 7 <> 0 OR ab_count = 1").withColumns({"thrown": (F.col("ab_id") * 200 + F.col("ab_count") * 20).cast("double"), "has_zone": F.lit(1), "pitch_id": F.col("event_id") * 100 + F.col("ab_count")})
    pitches = pitches.unionByName(pitches.where("event_id % 5 = 0 AND ab_count = 1").withColumns({"pitch_id": F.col("pitch_id") + 50, "thrown": F.col("thrown") + 5000}))
    numbered = reconcile.numbered_pitches(pitches)
    return reconcile.audit(reconcile.reconcile(need, numbered))


def _by_user():
    from pyspark.sql import Window as W

    return W.partitionBy("user_id").orderBy("us", "event_id")
