"""Windows, sessions, gaps, trimming, ranks and top-k over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered
from .common import Registry, day, events, table

registry = Registry()
_ORDER = ["us", "event_id"]
_E = "(SELECT *, epoch_us(ts) AS us, CAST(ts AS DATE) AS d FROM events)"


@registry.add("SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS INT) AS rank FROM supplier")
def rank_entities(spark, sf):
    rows = ordered.ranked(table(spark, sf, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), "s_suppkey"])
    return rows.select("s_suppkey", "rank")


@registry.add(f"SELECT event_id, CAST(floor((us - lag(us) OVER (PARTITION BY user_id, d ORDER BY us, event_id)) / 1000000) AS BIGINT) AS gap FROM {_E} e")
def gap_within_session(spark, sf):
    """Seconds between rows of one session (a day)."""
    return ordered.gaps(events(spark, sf).withColumn("d", day("ts")), ["user_id", "d"], F.col("us"), _ORDER).select("event_id", "gap")


@registry.add(f"""
SELECT event_id, CAST(floor((us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id)) / 1000000) AS BIGINT) AS gap,
  CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) = 1 THEN 'first' WHEN row_number() OVER (PARTITION BY user_id, d ORDER BY us, event_id) = 1 THEN 'across' ELSE 'within' END AS kind FROM {_E} e""")
def gap_across_sessions(spark, sf):
    """Gaps carried over session ends, and what kind each is."""
    rows = ordered.gaps(events(spark, sf).withColumn("d", day("ts")), ["user_id"], F.col("us"), _ORDER)
    return ordered.gap_kind(rows, ["user_id"], ["d"], _ORDER).select("event_id", "gap", "kind")


_GAPS = f"WITH g AS (SELECT CAST(floor((us - lag(us) OVER (PARTITION BY user_id, d ORDER BY us, event_id)) / 1000000) AS BIGINT) AS gap FROM {_E} e)"


@registry.add(_GAPS + """, r AS (SELECT gap, row_number() OVER (ORDER BY gap) AS rn, COUNT(*) OVER () AS n FROM g WHERE gap > 0),
k AS (SELECT MAX(CASE WHEN rn = CAST(floor(n * 0.01) AS BIGINT) + 1 THEN gap END) AS lo, MAX(CASE WHEN rn = n - CAST(floor(n * 0.01) AS BIGINT) THEN gap END) AS hi FROM r),
w AS (SELECT least(greatest(gap, lo), hi) AS v FROM r CROSS JOIN k)
SELECT CAST(SUM(v) AS BIGINT) AS total, COUNT(*) AS count, MAX(v) AS maximum, MIN(v) AS minimum, CAST(SUM(v) AS DOUBLE) / COUNT(*) AS average, MAX(v) - MIN(v) AS range FROM w""")
def winsorized_stats(spark, sf):
    """Interval statistics with one percent of each tail moved in."""
    rows = ordered.gaps(events(spark, sf).withColumn("d", day("ts")), ["user_id", "d"], F.col("us"), _ORDER).where("gap > 0")
    return ordered.winsorized(rows, "gap")


@registry.add(_GAPS + ", s AS (SELECT avg(gap) AS m, stddev_samp(gap) AS sd FROM g WHERE gap > 0) SELECT CAST(SUM(gap) AS BIGINT) AS total, COUNT(*) AS count, MAX(gap) AS maximum, MIN(gap) AS minimum, CAST(SUM(gap) AS DOUBLE) / COUNT(*) AS average, MAX(gap) - MIN(gap) AS range FROM g CROSS JOIN s WHERE gap > 0 AND abs(gap - m) <= 2 * sd")
def sd_trimmed_stats(spark, sf):
    """Interval statistics within two standard deviations."""
    rows = ordered.gaps(events(spark, sf).withColumn("d", day("ts")), ["user_id", "d"], F.col("us"), _ORDER).where("gap > 0")
    return ordered.interval_statistics(ordered.trimmed(rows, "gap"), "gap")


@registry.add("SELECT o_custkey, o_orderpriority, CAST(MIN(CAST(o_orderdate AS DATE)) AS VARCHAR) AS first_day, CAST(MAX(CAST(o_orderdate AS DATE)) AS VARCHAR) AS last_day, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY MIN(CAST(o_orderdate AS DATE)), o_orderpriority) AS INT) AS stint FROM orders GROUP BY 1, 2")
def stints(spark, sf):
    rows = table(spark, sf, "orders").withColumn("d", day("o_orderdate"))
    out = ordered.stints(rows, ["o_custkey"], "o_orderpriority", "d")
    return out.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@registry.add("""
WITH s AS (SELECT user_id, event_id, CAST(COALESCE(SUM(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS session FROM events)
SELECT user_id, session, COUNT(*) AS n, MIN(event_id) AS first_id, MAX(event_id) AS last_id FROM s GROUP BY 1, 2""")
def sessionize_boundary(spark, sf):
    """Groups that end with a closing row."""
    rows = ordered.sessions(events(spark, sf), ["user_id"], _ORDER, F.col("event_type") == "purchase")
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


@registry.add("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INT) AS instance, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) - 1 AS INT) AS kind_instance FROM events")
def instance_numbers(spark, sf):
    """Numbers of a repeated key, by row and by different value."""
    rows = ordered.instances(events(spark, sf), ["user_id", "event_type"], _ORDER)
    return ordered.instance_of_value(rows, ["user_id"], "event_type", "kind_instance").select("event_id", "instance", "kind_instance")


@registry.add("SELECT user_id, arg_min(event_type, epoch_us(ts) * 1000000 + event_id) AS first, arg_max(event_type, epoch_us(ts) * 1000000 + event_id) AS last, COUNT(*) AS n, CAST(floor((MAX(epoch_us(ts)) - MIN(epoch_us(ts))) / 1000000) AS BIGINT) AS duration FROM events GROUP BY 1".replace("epoch_us(ts) * 1000000 + event_id", "{'a': ts, 'b': event_id}"))
def first_last_duration(spark, sf):
    """First and last of each group, and the time between."""
    rows = events(spark, sf)
    ends = ordered.first_and_last(rows, ["user_id"], F.struct("us", "event_id"), "event_type")
    span = rows.groupBy("user_id").agg(F.floor((F.max("us") - F.min("us")) / 1_000_000).cast("long").alias("duration"))
    return ends.join(span, "user_id")


@registry.add("SELECT d, user_id, first_row, CAST(row_number() OVER (PARTITION BY d ORDER BY first_row, user_id) AS INT) AS number FROM (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS d, user_id, MIN(event_id) AS first_row FROM events GROUP BY 1, 2) x")
def appearance_order(spark, sf):
    return ordered.appearance_order(events(spark, sf).withColumn("d", day("ts").cast("string")), ["d"], "user_id", "event_id")


@registry.add("SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def latest_row(spark, sf):
    """The latest calibration row (a top-1 report)."""
    return ordered.latest(events(spark, sf).select("event_id", "user_id", "event_type", "us"), F.struct("us", "event_id")).drop("us")


@registry.add("SELECT o_orderkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 3) AS INT) AS chunk FROM orders")
def chunking(spark, sf):
    return ordered.chunks(table(spark, sf, "orders"), ["o_custkey"], ["o_orderkey"], 3).select("o_orderkey", "chunk")


@registry.add("SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey DESC) AS rows FROM orders GROUP BY 1")
def group_sort_collect(spark, sf):
    return ordered.grouped_lists(table(spark, sf, "orders"), ["o_custkey"], F.col("o_orderkey"), descending=True)


@registry.add("SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INT) AS rank FROM orders) x WHERE rank <= 3")
def top_k_per_group(spark, sf):
    return ordered.top_k(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", "rank")


@registry.add("SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY (CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) DESC, o_totalprice, o_orderkey) AS INT) AS place FROM orders")
def mixed_direction_sort(spark, sf):
    """Every order's place in a sort on several keys with mixed directions, within its customer."""
    order = [F.desc((F.col("o_orderstatus") == "F").cast("int")), F.asc("o_totalprice"), F.asc("o_orderkey")]
    return ordered.ranked(table(spark, sf, "orders"), ["o_custkey"], order, "place").select("o_orderkey", "o_custkey", "place")


@registry.add("SELECT event_id, user_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, CAST(MAX(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS BIGINT) AS last_us FROM events")
def running_frames(spark, sf):
    """Running counts and a moving frame."""
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy(*_ORDER)
    return events(spark, sf).select("event_id", "user_id", F.count("*").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("upto"), F.max("us").over(w.rowsBetween(-2, 0)).alias("last_us"))
