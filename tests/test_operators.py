from pyspark.sql import functions as F

from stathouse.functions.expressions import half_even
from stathouse.operators import matching, metrics, ordered, sets, splits, status


def test_rounded_flavour(spark):
    df = spark.createDataFrame([(1, 1, 0, 1), (1, 0, 1, 0), (1, 1, 1, 1)], "k int, ab_result_hit int, ab_result_out int, ab_result_single int")
    zero = {f: F.lit(0) for f in metrics.PITCH_FLAGS if f not in df.columns}
    flags = zero | {c: F.col(c) for c in df.columns[1:]}
    plain, rounded = (metrics.pitch_metrics(df, ["k"], flags, r).first() for r in (False, True))
    assert plain["total_at_bats"] == 4
    assert plain["avg"] == 0.5
    assert rounded["ops"] == round(round(plain["obp"], 3) + round(plain["slg"], 3), 3)


def test_average_flavours(spark):
    df = spark.createDataFrame([(1, 90.0, 100.0, 1), (1, None, 0.0, 0), (1, 94.0, None, 1)], "k int, start_speed double, launch_speed double, is_in_play int")
    plain, rounded = (metrics.pitch_metrics(df, ["k"], None, r).first() for r in (False, True))
    assert plain["avg_start_speed"] == 92.0
    assert rounded["avg_start_speed"] == round(184 / 3, 1)
    assert plain["avg_launch_speed"] == 50.0
    assert rounded["avg_launch_speed"] == 100.0


def test_valid_pitches(spark):
    df = spark.createDataFrame([(0, 0, "R", "R"), (1, 0, "R", "R"), (0, 1, "R", "R"), (0, 0, "S", "R"), (0, 0, "L", None)], "is_invalid_ibb int, is_out_of_sequence int, stand string, p_throws string")
    assert metrics.valid_pitches(df).count() == 2
    assert metrics.valid_pitches(df, batters=True).count() == 1


def test_pitching_line(spark):
    df = spark.createDataFrame([(1, 18, 5, 2, 1, 6, 1, 24)], "k int, outs int, hits int, earned_runs int, bases_on_balls int, strikeouts int, homeruns int, batters_faced int")
    r = metrics.pitch_lines(df, ["k"], rounded=True).first()
    assert (r["era"], r["whip"], r["k_per_nine"], r["k_rate"]) == (3.0, 1.0, 9.0, 0.25)


def test_hand_splits_overlap(spark):
    df = spark.createDataFrame([("R", "L"), ("L", "L"), ("R", "R")], "p_throws string, stand string")
    got = {r["split"]: r["count"] for r in splits.by_label(df, splits.hand_splits()).groupBy("split").count().collect()}
    assert got == {"all": 3, "vs_rhp": 2, "vs_lhp": 1, "as_lhb_vs_rhp": 1, "as_lhb_vs_lhp": 1, "as_rhb_vs_rhp": 1}


def test_winsorize_by_ranks(spark):
    values = list(range(1, 251))
    r = ordered.winsorized(spark.createDataFrame([(v,) for v in values], "gap long"), "gap").first()
    moved = [min(max(v, 3), 248) for v in values]  # two of each tail
    assert (r["total"], r["minimum"], r["maximum"], r["count"]) == (sum(moved), 3, 248, 250)


def test_empty_samples(spark):
    none = spark.createDataFrame([], "gap long")
    assert ordered.winsorized(none, "gap").first()["total"] is None
    assert ordered.trimmed(none, "gap").count() == 0


def test_percentiles(spark):
    steps = spark.createDataFrame([("FF", 25.0, 10.0), ("FF", 50.0, 20.0), ("FF", 75.0, 30.0)], "t string, p double, v double")
    values = spark.createDataFrame([("FF", 15.0), ("FF", 31.0), ("SL", 1.0), ("FF", 10.0)], "t string, x double")
    got = {(r["t"], r["x"]): r["p"] for r in matching.percentile_of(values, steps, ["t"], "x", "v", "p").collect()}
    assert got == {("FF", 15.0): 50.0, ("FF", 31.0): 100.0, ("SL", 1.0): 100.0, ("FF", 10.0): 25.0}
    low = spark.createDataFrame([("FF", 25.0, 30.0), ("FF", 50.0, 20.0)], "t string, p double, v double")
    assert matching.percentile_of(values.where("x = 31"), low, ["t"], "x", "v", "p", lower_is_better=True).first()["p"] == 25.0


def test_whole_row_differences(spark):
    old = spark.createDataFrame([(1, None, "a"), (2, "x", "b")], "id int, team string, name string")
    new = spark.createDataFrame([(1, None, "changed"), (2, "y", "b"), (3, None, "c")], "id int, team string, name string")
    assert sorted(r["id"] for r in sets.changed_rows(new, old, ["name"]).collect()) == [2, 3]
    assert sets.same_rows(old, old) and not sets.same_rows(old, new)


def test_missing_numbers(spark):
    df = spark.createDataFrame([("a", 1), ("a", 4), ("b", 7)], "k string, n int")
    assert sorted(tuple(r) for r in sets.missing_numbers(df, ["k"], "n").collect()) == [("a", 2), ("a", 3)]


def test_missing_numbers_by_blocks(spark):
    rows = [("a", n) for n in (-5000, -4097, -4096, -1, 0, 4095, 4096, 4096, 9000, None)] + [(None, 4094), (None, 4097), ("b", 2**62), ("b", 2**62 + 3), ("c", None), ("d", -(2**63)), ("d", 2 - 2**63)]
    rows += [("e", 2**63 - 1), ("e", 2**63 - 3), ("e", 2**63 - 3)]
    want = [("a", n) for n in range(-5000, 9000) if ("a", n) not in rows] + [("b", 2**62 + 1), ("b", 2**62 + 2), ("d", 1 - 2**63), ("e", 2**63 - 2)]
    want += [(None, n) for n in range(4094, 4098)]  # a null equals no key, in SQL as well
    for kind in ("long", "int"):
        some = [r for r in rows if kind == "long" or r[1] is None or abs(r[1]) < 2**31]
        out = sets.missing_numbers(spark.createDataFrame(some, f"k string, n {kind}"), ["k"], "n")
        assert dict(out.dtypes)["n"] == {"long": "bigint", "int": "int"}[kind]
        assert sorted(map(tuple, out.collect()), key=str) == sorted((r for r in want if kind == "long" or abs(r[1]) < 2**31), key=str)


def test_missing_numbers_of_one_group_are_found_by_many_tasks(spark):
    out = sets.missing_numbers(spark.createDataFrame([("a", 0), ("a", 200_000)], "k string, n long"), ["k"], "n")
    found = out.groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in found) == 199_999
    assert len(found) > 1 and max(r["count"] for r in found) < 150_000


def test_missing_numbers_take_few_bytes_where_they_are_written(spark, tmp_path):
    rows = [(k, n) for k in range(120) for n in (k, 300 + 41 * k, 12_000 + k)]
    spark.createDataFrame(rows, "k long, n long").transform(sets.missing_numbers, ["k"], "n").write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.distinct().count() == 120 * 11_998
    assert out.join(spark.createDataFrame(rows, "k long, n long"), ["k", "n"]).count() == out.where("n < k OR n > 12000 + k").count() == 0
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 120 * 11_998  # 4 bytes a row, if each number is written out


def test_missing_numbers_of_long_ranges_are_dealt_to_more_tasks(spark):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = [(k, n) for k in range(128) for n in (0, (few + 3) << 16)]
    assert sets.missing_numbers(spark.createDataFrame(rows, "k long, n long"), ["k"], "n").rdd.getNumPartitions() == few + 4
    assert sets.missing_numbers(spark.createDataFrame(rows[:2], "k long, n long"), ["k"], "n").rdd.getNumPartitions() <= few


def test_missing_numbers_of_any_names_and_of_no_rows(spark):
    df = spark.createDataFrame([("x", 1, 1), ("x", 1, 700), ("x", 2, 5), (None, 1, 9)], "a string, b int, n long")
    assert {tuple(r) for r in sets.missing_numbers(df, ["a", "b"], "n").collect()} == {("x", 1, n) for n in range(2, 700)} | {(None, 1, 9)}
    assert sets.missing_numbers(df.limit(0), ["a", "b"], "n").count() == 0


def test_merge(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "id int, s string, n int")
    new = spark.createDataFrame([(2, None, 9), (3, "c", 1)], "id int, s string, n int")
    assert sorted(tuple(r) for r in status.merged_status(old, new, ["id"]).collect()) == [(1, "a", 5), (2, "b", 9), (3, "c", 1)]


def test_ties_count_as_losses(spark):
    games = spark.createDataFrame([("A", "B", 3, 3), ("A", "B", 4, 2)], "away string, home string, a int, h int")
    got = {r["team"]: (r["wins"], r["losses"], r["runs_scored"]) for r in splits.standings(games, "away", "home", "a", "h").collect()}
    assert got == {"A": (1, 1, 7), "B": (0, 2, 5)}


def test_printed_ratio(spark):
    assert spark.range(1).select(half_even(F.lit(2.675), 2)).first()[0] == round(2.675, 2)


def test_sole_later_match(spark):
    import random

    pick = random.Random(5)
    rows = [(x, pick.choice([1, 2, 3, 4, None]), pick.choice("abcdef"), pick.choice([None, *"uvwxyz"])) for x in range(150)]
    rows += [(1000 + x, 9, f"c{x}", "hot") for x in range(200)]
    met = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] is not None and a[1] == b[1] and (a[2] == b[2] or a[3] is not None and a[3] == b[3])]
    want = sorted(p for p in met if sum(q[0] == p[0] for q in met) == 1)
    df = spark.createDataFrame(rows, "x int, d int, c string, p string")
    assert sorted(tuple(r) for r in matching.sole_later_match(df, ["d"], ["c", "p"], "x", "y").collect()) == want
    pairs = matching.theta_matches(df, df.withColumnRenamed("x", "y"), ["d"], ["c", "p"], "x", "y", F.col("x") < F.col("y"))
    assert sorted(tuple(r) for r in pairs.collect()) == sorted(met)
    assert sorted(tuple(r) for r in matching.unique_matches(pairs, "x").collect()) == want
    assert matching.sole_later_match(df.limit(0), ["d"], ["c", "p"], "x", "y").count() == 0


def test_last_rows_are_cut_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, 1, "a", "u")], "x int, d int, c string, p string")
    plan = matching.sole_later_match(df, ["d"], ["c", "p"], "x", "y")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Partial") >= 2 and "WindowGroupLimit" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_since_last_start(spark):
    import random

    pick = random.Random(6)
    rows = [(pick.choice(["a", "b", None]), pick.choice([None, *range(60)]), pick.random() < 0.15) for _ in range(300)] + [("c", 5, False), ("d", 7, True), ("d", 900, False)]
    want = []
    for k, t, _ in rows:
        begun = [b for j, b, s in rows if s and j is not None and j == k and b is not None and t is not None and b <= t]
        if begun and max(begun) < t:
            want.append((k, t, max(begun)))
    df = spark.createDataFrame(rows, "k string, t int, s boolean")
    for cell in (1, 7, 65_536):
        got = matching.since_last_start(df, ["k"], "t", F.col("s"), "opened", cell).select("k", "t", "opened")
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    points, spans = df.where("k IS NOT NULL"), spark.createDataFrame([("a", 3, 20), ("a", 10, 40), ("b", 0, 59)], "k string, lo int, hi int")
    inside = sorted((k, t, lo) for k, t, _ in rows for j, lo, hi in [("a", 3, 20), ("a", 10, 40), ("b", 0, 59)] if k == j and t is not None and lo < t < hi)
    met = matching.inside_intervals(points, spans, ["k"], "t", "lo", "hi", 8)
    assert sorted(tuple(r) for r in met.select("k", "t", "lo").collect()) == inside
