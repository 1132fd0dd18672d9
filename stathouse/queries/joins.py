"""Joins, set operations, patches and merges over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, sets, status
from ..plans import patches
from .common import Registry, day, events, table

registry = Registry()


@registry.add("SELECT l_orderkey, l_linenumber, o_custkey AS customer_id, s_nationkey AS team_id, p_size AS part_size, c_nationkey AS nation_id FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN customer ON o_custkey = c_custkey")
def surrogate_key_resolution(spark, sf):
    """Surrogate ids from natural keys; small dimensions are broadcast by their size."""
    get = lambda t, **names: table(spark, sf, t).withColumnsRenamed(names)
    lookups = [
        (get("orders", o_orderkey="l_orderkey"), ["l_orderkey"], "o_custkey", "customer_id"),
        (get("supplier", s_suppkey="l_suppkey"), ["l_suppkey"], "s_nationkey", "team_id"),
        (get("part", p_partkey="l_partkey"), ["l_partkey"], "p_size", "part_size"),
        (get("customer", c_custkey="customer_id"), ["customer_id"], "c_nationkey", "nation_id"),
    ]
    out = matching.with_keys(table(spark, sf, "lineitem"), lookups)
    return out.select("l_orderkey", "l_linenumber", "customer_id", "team_id", "part_size", "nation_id")


@registry.add("SELECT c_custkey, COALESCE(list(o_orderkey ORDER BY o_orderkey) FILTER (WHERE o_orderkey IS NOT NULL), []) AS children FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderpriority = '1-URGENT') o ON o_custkey = c_custkey GROUP BY 1")
def left_keep_empty(spark, sf):
    """Every at-bat with its pitches, also without any."""
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    return matching.keep_with_children(table(spark, sf, "customer").select("c_custkey"), urgent, ["c_custkey"], F.col("o_orderkey"), F.col("o_orderkey"))


@registry.add("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT' AND o.o_orderstatus = 'F')")
def anti_join_invalid(spark, sf):
    done = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").withColumnRenamed("o_custkey", "c_custkey")
    return matching.only_left(table(spark, sf, "customer"), done, ["c_custkey"]).select("c_custkey")


@registry.add("""
WITH a AS (SELECT o_custkey AS k, COUNT(*) AS n_f FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000 GROUP BY 1), b AS (SELECT o_custkey AS k, COUNT(*) AS n_o FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000 GROUP BY 1)
SELECT COALESCE(a.k, b.k) AS k, n_f, n_o, CASE WHEN b.k IS NULL THEN 'left' WHEN a.k IS NULL THEN 'right' ELSE 'both' END AS side FROM a FULL OUTER JOIN b ON a.k = b.k""")
def full_outer_leftovers(spark, sf):
    """Box-score pitchers against pitch logs: matched and left over on either side."""
    rich = table(spark, sf, "orders").where("o_totalprice > 200000")
    count = lambda s, name: rich.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias(name))
    return matching.both_or_either(count("F", "n_f"), count("O", "n_o"), ["k"]).select("k", "n_f", "n_o", "side")


@registry.add("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_required(spark, sf):
    returned = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf, "orders").join(returned, "o_orderkey", "left_semi").select("o_orderkey")


@registry.add("""
WITH c AS (SELECT a.o_orderkey AS x, b.o_orderkey AS y FROM orders a JOIN orders b ON CAST(a.o_orderdate AS DATE) = CAST(b.o_orderdate AS DATE) AND (a.o_custkey = b.o_custkey OR a.o_orderpriority = b.o_orderpriority) AND a.o_orderkey < b.o_orderkey),
n AS (SELECT x, y, COUNT(*) OVER (PARTITION BY x) AS m FROM c) SELECT x, y FROM n WHERE m = 1""")
def theta_match_unique(spark, sf):
    """Same day, and same customer or same priority; rows with one later match."""
    o = table(spark, sf, "orders").select(day("o_orderdate").alias("d"), "o_custkey", "o_orderpriority", F.col("o_orderkey").alias("x"))
    return matching.sole_later_match(o, ["d"], ["o_custkey", "o_orderpriority"], "x", "y")


@registry.add("""
WITH lk AS (SELECT p_type, pct, MAX(p_retailprice) AS stat_value FROM (SELECT p_type, p_retailprice, ntile(20) OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) * 5 AS pct FROM part) x WHERE pct < 100 GROUP BY 1, 2)
SELECT v.p_partkey, CAST(COALESCE(MIN(lk.pct), 100) AS DOUBLE) AS percentile FROM part v LEFT JOIN lk ON lk.p_type = v.p_type AND lk.stat_value >= v.p_retailprice GROUP BY 1""")
def percentile_range_lookup(spark, sf):
    """The first percentile whose limit reaches the value; 100 beyond the last."""
    from pyspark.sql import Window as W

    part = table(spark, sf, "part")
    tile = (F.ntile(20).over(W.partitionBy("p_type").orderBy("p_retailprice", "p_partkey")) * 5).alias("percentile")
    steps = part.select("p_type", "p_retailprice", tile).where("percentile < 100").groupBy("p_type", "percentile").agg(F.max("p_retailprice").alias("stat_value"))
    out = matching.percentile_of(part.select("p_partkey", "p_type", "p_retailprice"), steps, ["p_type"], "p_retailprice", "stat_value", "percentile")
    return out.select("p_partkey", F.col("percentile").cast("double").alias("percentile"))


@registry.add("""
WITH b AS (SELECT user_id, event_id AS a, COALESCE(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 1000000000) AS z FROM events WHERE event_type = 'signup')
SELECT e.event_id, b.a AS opened FROM events e JOIN b ON e.user_id = b.user_id AND e.event_id > b.a AND e.event_id < b.z""")
def interval_containment(spark, sf):
    """Rows strictly between the start and the end of their interval."""
    rows = table(spark, sf, "events").select("user_id", "event_id", "event_type")
    return matching.since_last_start(rows, ["user_id"], "event_id", F.col("event_type") == "signup", "opened").select("event_id", "opened")


@registry.add("""
SELECT c_custkey, arg_min(o_orderkey, {'d': abs(date_diff('day', DATE '1995-06-15', CAST(o_orderdate AS DATE))), 'k': o_orderkey}) AS o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def nearest_date(spark, sf):
    """The order nearest to a day, ties to the smaller key."""
    customers = table(spark, sf, "customer").select("c_custkey", F.lit("1995-06-15").cast("date").alias("debut"))
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("_c"), "o_orderkey", day("o_orderdate").alias("d")).withColumnRenamed("_c", "c_custkey")
    return matching.nearest(customers.withColumn("row", F.lit(0)), orders, ["c_custkey"], F.abs(F.datediff("d", "debut")), "row", "o_orderkey", "o_orderkey").drop("row")


@registry.add("""
WITH q AS (SELECT DISTINCT p_name AS q FROM part WHERE p_partkey % 100 = 0), c AS (SELECT DISTINCT p_name AS c FROM part),
s AS (SELECT q, c, CASE WHEN greatest(length(q), length(c)) > 0 THEN 100.0::DOUBLE * (greatest(length(q), length(c)) - levenshtein(q, c)) / greatest(length(q), length(c)) ELSE 100.0 END AS score FROM q, c)
SELECT q, c, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS INT) AS rank FROM s) x WHERE rank <= 10""")
def topk_fuzzy(spark, sf):
    """The ten most similar names of a stated list of queries (a top-k report)."""
    names = table(spark, sf, "part").where("p_partkey % 100 = 0").select(F.col("p_name").alias("q")).distinct()
    choices = table(spark, sf, "part").select(F.col("p_name").alias("c")).distinct()
    return matching.fuzzy_top(names, choices, "q", "c", None, None, 10).select("q", "c", "score", "rank")


@registry.add("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def set_subtract(spark, sf):
    """Ids in the folder that aren't in the database."""
    known = table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return sets.new_rows(table(spark, sf, "customer").select("c_custkey"), known, ["c_custkey"])


@registry.add("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'")
def set_union_dedup(spark, sf):
    a = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"))
    b = table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_nationkey").alias("k"))
    return sets.merged_once(a, b, ["k"])


@registry.add("SELECT 'c' AS src, c_custkey AS id, c_nationkey AS nation, CAST(NULL AS DOUBLE) AS bal FROM customer UNION ALL SELECT 's', s_suppkey, CAST(NULL AS INT), s_acctbal FROM supplier")
def union_all_sorted(spark, sf):
    """Three event lists under each other; columns may be missing."""
    c = table(spark, sf, "customer").select(F.lit("c").alias("src"), F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"))
    s = table(spark, sf, "supplier").select(F.lit("s").alias("src"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return sets.stacked(c, s).orderBy("id", "src")


@registry.add("SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 0 INTERSECT SELECT c_nationkey FROM customer WHERE c_acctbal > 9000")
def set_intersect(spark, sf):
    a = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_nationkey").alias("k"))
    return a.intersect(table(spark, sf, "customer").where("c_acctbal > 9000").select(F.col("c_nationkey").alias("k")))


@registry.add("""
SELECT user_id, n FROM (SELECT user_id, unnest(range(lo, hi + 1)) AS n FROM (SELECT user_id, MIN(event_id) AS lo, MAX(event_id) AS hi FROM events WHERE user_id < 20 GROUP BY 1) a) x
WHERE NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = x.user_id AND e.event_id = x.n)""".replace("WHERE user_id < 20 ", ""))
def missing_numbers(spark, sf):
    """Numbers of a range that no row has."""
    return sets.missing_numbers(table(spark, sf, "events").select("user_id", F.col("event_id").alias("n")), ["user_id"], "n")


@registry.add("SELECT c_custkey, c_mktsegment FROM customer c WHERE NOT EXISTS (SELECT 1 FROM customer o WHERE o.c_custkey % 7 <> 0 AND o.c_custkey = c.c_custkey)")
def changed_rows(spark, sf):
    """Rows that the old table doesn't have, one column left out of the comparison."""
    new = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_name")
    old = new.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 7 == 0, F.lit("OLD")).otherwise(F.col("c_mktsegment"))).withColumn("c_name", F.lit(""))
    return sets.changed_rows(new, old, ["c_name"]).select("c_custkey", "c_mktsegment")


_PATCH = "(VALUES (1, 'FIXED', FALSE), (2, CAST(NULL AS VARCHAR), TRUE), (5, 'FIXED', FALSE))"


def _patches(spark):
    return spark.createDataFrame([(1, "FIXED", False), (2, None, True), (5, "FIXED", False)], "c_custkey long, c_mktsegment string, remove boolean")


@registry.add(f"SELECT c.c_custkey, COALESCE(p.s, c.c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN {_PATCH} p(k, s, r) ON p.k = c.c_custkey")
def patch_update(spark, sf):
    """Corrections by key, applied as tables are read."""
    return patches.apply_updates(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), _patches(spark).drop("remove"), ["c_custkey"])


@registry.add(f"SELECT c.c_custkey FROM customer c WHERE c.c_custkey NOT IN (SELECT k FROM {_PATCH} p(k, s, r) WHERE r)")
def patch_remove(spark, sf):
    return patches.apply_removals(table(spark, sf, "customer").select("c_custkey"), _patches(spark).where("remove"), ["c_custkey"])


@registry.add("SELECT s_suppkey AS k, 'new' AS v FROM supplier UNION ALL SELECT c_custkey, 'old' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def patch_merge(spark, sf):
    """New patch lists win over old ones; both lists whole."""
    new = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("new").alias("v"))
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    return sets.replaced(old, new, ["k"])


@registry.add("""
WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS d, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS des FROM events),
g AS (SELECT user_id, d, COUNT(DISTINCT des) AS n, MIN(des) AS sole FROM e GROUP BY 1, 2)
SELECT event_id, CASE WHEN des IS NULL AND n = 1 THEN sole ELSE des END AS des, n > 1 AND des IS NULL AS unclear FROM e JOIN g ON e.user_id = g.user_id AND e.d = g.d""")
def fill_single_valued_missing(spark, sf):
    """A missing value is filled where its group has one value only."""
    rows = events(spark, sf).select("event_id", "user_id", day("ts").alias("d"), F.when(F.col("event_id") % 3 != 0, F.col("event_type")).alias("des"))
    return patches.fill_missing(rows, ["user_id", "d"], "des").select("event_id", "des", "unclear")


@registry.add("""
WITH a AS (SELECT o_custkey AS k, COUNT(*) AS n, MAX(o_orderpriority) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, COUNT(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT COALESCE(a.k, b.k) AS k, COALESCE(b.n, a.n) AS n, a.p FROM a FULL OUTER JOIN b ON a.k = b.k""")
def status_merge(spark, sf):
    """Upsert of counters: new values win, unknown keys are added."""
    o = table(spark, sf, "orders")
    a = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("p"))
    b = o.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"))
    return status.merged_status(a, b, ["k"])


@registry.add("""
WITH b AS (SELECT l_suppkey, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem GROUP BY 1), a AS (SELECT l_suppkey, COUNT(*) AS n, CAST(SUM(l_linenumber) AS BIGINT) AS s FROM lineitem WHERE l_returnflag <> 'R' OR l_suppkey % 2 = 0 GROUP BY 1),
u AS (SELECT b.l_suppkey, 'n' AS stat, b.n AS before, a.n AS after FROM b JOIN a ON a.l_suppkey = b.l_suppkey UNION ALL SELECT b.l_suppkey, 's', b.s, a.s FROM b JOIN a ON a.l_suppkey = b.l_suppkey)
SELECT l_suppkey, stat, before, after, after - before AS diff FROM u WHERE before <> after""")
def before_after_diff(spark, sf):
    """Statistics that a correction changed."""
    li = table(spark, sf, "lineitem")
    stats = lambda d: d.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("s"))
    return patches.differences(stats(li), stats(li.where("l_returnflag <> 'R' OR l_suppkey % 2 = 0")), ["l_suppkey"], ["n", "s"])
