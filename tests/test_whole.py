"""Queries that must use every row of their tables."""

from stathouse.operators import matching
from stathouse.queries import QUERIES


def test_patch_merge(spark, data):
    ids = lambda t, c: {r[0] for r in spark.read.parquet(f"{data}/{t}.parquet").select(c).collect()}
    old, new = ids("customer", "c_custkey"), ids("supplier", "s_suppkey")
    out = QUERIES["patch_merge"](spark, data).collect()
    assert sorted((r["k"], r["v"]) for r in out) == sorted([(k, "new") for k in new] + [(k, "old") for k in old - new])


def test_every_season_and_line_number(spark, data):
    lines = spark.read.parquet(f"{data}/lineitem.parquet")
    seasons = {r[0] for r in lines.selectExpr("year(l_shipdate)").distinct().collect()}
    mix = QUERIES["pivot_share_by_year"](spark, data).collect()
    assert {r["year"] for r in mix} == seasons and sum(r["n"] for r in mix) == lines.count()
    details = QUERIES["pivot_details"](spark, data)
    numbers = lines.select("l_linenumber").distinct()
    assert details.select("l_linenumber").distinct().count() == numbers.count() > 3
    assert details.count() == lines.select("l_orderkey").distinct().count() * numbers.count()


def test_every_order_has_a_place(spark, data):
    orders = spark.read.parquet(f"{data}/orders.parquet")
    out = QUERIES["mixed_direction_sort"](spark, data)
    assert out.count() == orders.count() > 50
    assert out.where("place = 1").count() == orders.select("o_custkey").distinct().count()


def test_fuzzy_top_of_many_choices(spark):
    queries = spark.createDataFrame([("red box",), ("name 7",), ("xyz",)], "q string")
    choices = spark.range(300).selectExpr("concat('name ', id) AS c").unionAll(spark.createDataFrame([("red box",), ("red fox",)], "c string"))
    get = lambda most: sorted(map(tuple, matching.fuzzy_top(queries, choices, "q", "c", None, None, k=4, most=most).collect()))
    assert get(40) == get(50_000) and len(get(40)) == 12
    many = spark.range(50_001).selectExpr("concat('name ', id) AS c")
    (best,) = matching.fuzzy_top(queries.where("q = 'name 7'"), many, "q", "c", None, None, k=1).collect()
    assert best["c"] == "name 7"
