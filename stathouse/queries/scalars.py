"""Identifiers, bit flags, dates, text and sequence functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expressions as X
from .common import Registry, day, events, table

registry = Registry()


@registry.add("""
SELECT c_custkey, CAST(substr(c_name, 10) AS BIGINT) AS number, 'BOS2019' || printf('%02d', c_custkey % 12 + 1) || '17' || CAST(c_custkey % 3 AS VARCHAR) AS game_id,
  'BOS' AS home, CAST(2019 AS INT) AS year, CAST(c_custkey % 12 + 1 AS INT) AS month, CAST(CASE WHEN c_custkey % 3 < 2 THEN 1 ELSE 2 END AS INT) AS game_number, CAST(500000 + c_custkey AS INT) AS player FROM customer""")
def id_parsing(spark, sf):
    """Structured ids built from a table, then parsed."""
    c = table(spark, sf, "customer")
    game = F.format_string("BOS2019%02d17%d", F.col("c_custkey") % 12 + 1, F.col("c_custkey") % 3)
    rows = c.select("c_custkey", F.regexp_extract("c_name", r"(\d+)$", 1).cast("long").alias("number"), game.alias("game_id"))
    rows = rows.withColumn("g", X.parse_game_id(F.col("game_id")))
    app = X.parse_appearance_id(F.concat("game_id", F.lit("_"), F.col("c_custkey") + 500000))
    return rows.withColumn("a", app).select(
        "c_custkey", "number", "game_id", "g.home", F.year("g.day").alias("year"), F.month("g.day").alias("month"), F.col("g.number").alias("game_number"), "a.player")


@registry.add("SELECT o_orderkey, CAST(o_custkey AS VARCHAR) || '_INN_' || CASE WHEN o_orderkey % 2 = 0 THEN 'TOP' ELSE 'BOT' END || printf('%02d', o_orderkey % 9 + 1) AS inning_id, CAST(2 * (o_orderkey % 9 + 1) - CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS BIGINT) AS weight FROM orders")
def id_build(spark, sf):
    top, inning = F.col("o_orderkey") % 2 == 0, F.col("o_orderkey") % 9 + 1
    return table(spark, sf, "orders").select("o_orderkey", X.inning_id(F.col("o_custkey").cast("string"), top, inning).alias("inning_id"), X.inning_weight(top, inning).cast("long").alias("weight"))


_BITS = {"click": 1, "view": 2, "purchase": 4, "signup": 8, "error": 16}


@registry.add("""
WITH m AS (SELECT user_id, CAST(bit_or(CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 8 WHEN 'error' THEN 16 ELSE 0 END) AS INT) AS mask FROM events WHERE event_id % 40 < 3 GROUP BY 1)
SELECT user_id, mask, (mask & 4) = 4 AS bought, list_filter([CASE WHEN mask & 1 = 1 THEN 'click' END, CASE WHEN mask & 2 = 2 THEN 'view' END, CASE WHEN mask & 4 = 4 THEN 'purchase' END, CASE WHEN mask & 8 = 8 THEN 'signup' END, CASE WHEN mask & 16 = 16 THEN 'error' END], lambda x: x IS NOT NULL) AS kinds FROM m""".replace(" WHERE event_id % 40 < 3", "").replace("(mask & 4) = 4", "(mask & 4) = 4").replace("mask & 1 = 1", "(mask & 1) = 1").replace("mask & 2 = 2", "(mask & 2) = 2").replace("WHEN mask & 4 = 4", "WHEN (mask & 4) = 4").replace("mask & 8 = 8", "(mask & 8) = 8").replace("mask & 16 = 16", "(mask & 16) = 16"))
def bit_flags(spark, sf):
    """Masks of kinds, membership, and their names."""
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.bit_or(X.bit_of(F.col("event_type"), _BITS)).alias("mask"))
    return rows.select("user_id", "mask", X.has_bit(F.col("mask"), 4).alias("bought"), X.bits_of(F.col("mask"), _BITS).alias("kinds"))


@registry.add("SELECT o_orderkey, CAST(length(o_orderpriority) - length(replace(o_orderpriority, 'I', '')) AS INT) AS n FROM orders")
def char_count(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.char_count(F.col("o_orderpriority"), "I").alias("n"))


@registry.add("""
WITH s AS (SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'CBFX' WHEN 1 THEN 'BBBB' WHEN 2 THEN '^CFFFS' WHEN 3 THEN 'BV1>C' ELSE 'IIIH' END AS seq FROM orders)
SELECT o_orderkey, CAST(CASE seq WHEN 'CBFX' THEN 4 WHEN 'BBBB' THEN 4 WHEN '^CFFFS' THEN 5 WHEN 'BV1>C' THEN 2 ELSE 4 END AS INT) AS pitches, CAST(CASE seq WHEN 'CBFX' THEN 1 WHEN 'BBBB' THEN 4 WHEN '^CFFFS' THEN 0 WHEN 'BV1>C' THEN 2 ELSE 3 END AS INT) AS balls,
  CAST(CASE seq WHEN 'CBFX' THEN 2 WHEN 'BBBB' THEN 0 WHEN '^CFFFS' THEN 3 WHEN 'BV1>C' THEN 1 ELSE 0 END AS INT) AS strikes, seq <> 'BV1>C' AS complete FROM s""")
def seq_fold(spark, sf):
    """Balls, strikes and completeness of pitch sequences."""
    k = F.col("o_orderkey") % 5
    seq = F.when(k == 0, "CBFX").when(k == 1, "BBBB").when(k == 2, "^CFFFS").when(k == 3, "BV1>C").otherwise("IIIH")
    rows = table(spark, sf, "orders").select("o_orderkey", seq.alias("seq")).withColumn("f", X.fold_sequence(F.col("seq")))
    return rows.select("o_orderkey", "f.pitches", "f.balls", "f.strikes", X.completes_at_bat(F.col("seq")).alias("complete"))


@registry.add("SELECT event_id, strftime(timezone('America/New_York', timezone('UTC', date_trunc('second', ts))), '%Y-%m-%d %H:%M:%S') AS local, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS epoch FROM events")
def tz_resolution(spark, sf):
    """UTC shown as local time."""
    rows = events(spark, sf)
    return rows.select("event_id", F.date_format(F.from_utc_timestamp(F.date_trunc("second", "ts"), "America/New_York"), "yyyy-MM-dd HH:mm:ss").alias("local"), F.floor(F.col("us") / 1_000_000).cast("long").alias("epoch"))


@registry.add("SELECT CAST(strftime(d, '%Y%m%d') AS INT) AS date_id, CAST(CAST(d AS DATE) AS VARCHAR) AS day FROM (SELECT unnest(generate_series((SELECT MIN(CAST(ts AS DATE)) FROM events), (SELECT MAX(CAST(ts AS DATE)) FROM events), INTERVAL 1 DAY)) AS d) x")
def calendar(spark, sf):
    """One row for each day of a season."""
    ends = events(spark, sf).agg(F.min(day("ts")).alias("a"), F.max(day("ts")).alias("b"))
    days = ends.select(F.explode(F.sequence("a", "b")).alias("d"))
    return days.select(X.date_number(F.col("d")).alias("date_id"), F.col("d").cast("string").alias("day"))


@registry.add("SELECT o_orderkey, CAST(floor(date_diff('day', CAST(o_orderdate AS DATE), DATE '2019-06-30') / 365) AS INT) AS age FROM orders")
def age(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", X.age_at(day("o_orderdate"), F.lit(2019)).alias("age"))


@registry.add("SELECT l_orderkey, l_linenumber, CAST(floor(CAST(l_quantity AS INT) / 3) + (CAST(l_quantity AS INT) % 3) / 10.0 AS DOUBLE) AS innings, CAST(l_quantity AS INT) AS outs FROM lineitem")
def innings_and_outs(spark, sf):
    """Outs to innings and back."""
    innings = X.outs_to_innings(F.col("l_quantity").cast("int"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", innings.cast("double").alias("innings"), X.innings_to_outs(innings).alias("outs"))


@registry.add("SELECT p_partkey, regexp_replace(printf('%.3f', p_size / 64.0), '^0', '') AS text, CASE WHEN length(p_name) > 8 THEN substr(p_name, 1, 5) || '...' ELSE p_name END AS short, upper(p_brand) AS brand FROM part")
def display_text(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.baseball_decimal(F.col("p_size") / 64.0).alias("text"), X.ellipsize(F.col("p_name"), 8).alias("short"), F.upper("p_brand").alias("brand"))


@registry.add("""
SELECT l_orderkey, concat_ws(', ', CASE WHEN SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) = 1 THEN '2B' WHEN SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) > 1 THEN CAST(SUM(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS VARCHAR) || '-2B' END,
  CASE WHEN SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) = 1 THEN 'HR' WHEN SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) > 1 THEN CAST(SUM(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS VARCHAR) || 'HR' END) AS line FROM lineitem GROUP BY 1""")
def stat_line(spark, sf):
    """Counts as a printed line."""
    n = lambda f: F.count(F.when(F.col("l_returnflag") == f, 1))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(X.stat_line((n("R"), "2B"), (n("A"), "HR")).alias("line"))


@registry.add("""
WITH d AS (SELECT l_orderkey, string_agg(CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || '·2B' ELSE 'HR' END, ',' ORDER BY l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) || '·2B' ELSE 'HR' END) AS text,
  COUNT(*) AS items, arg_max(CAST(l_quantity AS INT), {'a': l_linenumber, 'b': CAST(CAST(l_quantity AS INT) AS VARCHAR) || '·2B'}) FILTER (WHERE l_linenumber % 2 = 0) AS last FROM lineitem GROUP BY 1)
SELECT l_orderkey, text, CAST(items AS INT) AS items, CAST(COALESCE(last, 0) AS INT) AS doubles FROM d""")
def detail_lists(spark, sf):
    """Text of details to an array, and one stat of it (the last of its name)."""
    item = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("·2B"))).otherwise("HR")
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", item.alias("x")))), lambda r: r["x"]), ",").alias("text"))
    parsed = lists.withColumn("d", X.parse_details(F.col("text")))
    return parsed.select("l_orderkey", "text", F.size("d").alias("items"), X.detail(F.col("d"), "2B").alias("doubles"))


@registry.add("SELECT c_custkey, TRY_CAST(substr(c_name, 10, 3) AS INT) AS number, CASE WHEN c_mktsegment IN ('BUILDING') THEN 'BLD' WHEN c_mktsegment = 'MACHINERY' THEN 'MCH' ELSE c_mktsegment END AS code, md5(c_name) AS hash FROM customer")
def parse_and_crosswalk(spark, sf):
    """Numbers that may fail, codes with a default, hashes."""
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.substring("c_name", 10, 3).try_cast("int").alias("number"), X.crosswalk(F.col("c_mktsegment"), {"BUILDING": "BLD", "MACHINERY": "MCH"}).alias("code"), F.md5("c_name").alias("hash"))


@registry.add("SELECT p_partkey, CAST(CASE WHEN greatest(length(p_name), length(p_type)) > 0 THEN 100.0::DOUBLE * (greatest(length(p_name), length(p_type)) - levenshtein(p_name, p_type)) / greatest(length(p_name), length(p_type)) ELSE 100.0 END AS DOUBLE) AS score FROM part")
def name_similarity(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.similarity(F.col("p_name"), F.col("p_type")).alias("score"))


@registry.add(r"SELECT doc_id, lower(strip_accents(lang)) AS lang, length(text) AS n, md5(regexp_replace(strip_accents(text), '[^\x00-\x7F]', '', 'g')) AS plain FROM documents")
def accents(spark, sf):
    """Whole texts without their accents."""
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.lower(X.without_accents(F.col("lang"))).alias("lang"), F.length("text").cast("long").alias("n"), F.md5(X.without_accents(F.col("text"))).alias("plain"))
