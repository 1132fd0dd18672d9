"""Sentences, line scores, pages and stores against results by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from stathouse.functions import expressions as X
from stathouse.operators import metrics, sets, splits
from stathouse.plans import games
from stathouse.sources import pages, store


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Al Ab replaces Bo Ba (P) pitching and batting 9th", ("Al Ab", "P", "Bo Ba", "P", 9, "pitch")),
        ("Al Ab replaces Bo Ba pitching", ("Al Ab", "P", "Bo Ba", "P", 0, "pitch")),
        ("Al Ab pinch hits for Bo Ba (CF) batting 2nd", ("Al Ab", "PH", "Bo Ba", "CF", 2, "bat")),
        ("Al Ab pinch runs for Bo Ba (1B) batting 4th", ("Al Ab", "PR", "Bo Ba", "1B", 4, "bat")),
        ("Al Ab moves from CF to LF", ("Al Ab", "LF", "Al Ab", "CF", 0, "pitch")),
        ("Al Ab replaces Bo Ba (DH) playing 3B batting 7th (change occurred mid-batter)", ("Al Ab", "3B", "Bo Ba", "DH", 7, "pitch")),
        ("Al Ab running at second base to start the extra inning", ("Al Ab", "PR", "N/A", "N/A", 0, "bat")),
        ("Al Ab pinch hit for C and is now RF", ("Al Ab", "RF", "N/A", "C", 0, "bat")),
        ("Nothing of the kind", None),
    ],
)
def test_substitution(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(games.substitution(F.col("t")).alias("s")).first()["s"]
    assert (None if row is None else tuple(row)) == want


def test_meta_of_a_dome_and_of_nothing(spark):
    rows = [
        (["Attendance: 31,042", ": Big Dome", "Game Duration: 3:05", "Day Game, on artificial turf", "Start Time: 1:07 p.m."], "72° F, In Dome."),
        (["Start Time: 1:07 p.m."], ""),
        (["2:10", "2:20", "Day Game, on grass"], "60° F, Wind 3mph, Night"),
    ]
    out = games.game_meta(spark.createDataFrame(rows, "l array<string>, w string"), "l", "w").collect()
    assert (out[0]["attendance"], out[0]["park_name"], out[0]["duration"], out[0]["field_type"], out[0]["temperature"], out[0]["clouds"], out[0]["wind"]) == (31042, "Big Dome", 185, "On Artificial Turf", 72, "In Dome", "Wind 0mph")
    assert [r["parsed"] for r in out] == [True, False, False]
    assert (out[1]["attendance"], out[1]["park_name"]) == (0, "")


def test_line_score_and_what_is_left_of_it(spark):
    plays = [(1, i, b, "R" * n + "O") for i in range(1, 13) for b, n in ((False, i % 3 == 0), (True, (i == 2) * 4)) if not (i == 12 and b)]
    halves = games.half_innings(spark.createDataFrame(plays, "g int, inning int, bottom boolean, r string"), ["g"], "inning", "bottom", "r")
    line = games.line_score(halves, ["g"], "inning", "bottom")
    row = line.first()
    assert (row["away_runs"], row["home_runs"], row["extra_innings"], len(row["line"])) == (4, 4, True, 12)
    assert row["line"][-1]["home"] is None
    assert games.condensed(line, ["g"]).first()["shown"] == [1, 2, 3, 4, 5, 6, 7, 9, 12]
    assert games.condensed(line, ["g"], 3).first()["shown"] == [2, 9, 12]


def test_sequences_with_unknown_marks_are_null(spark):
    rows = spark.createDataFrame([("CFFBX",), ("C?X",), ("*B1>X.",), ("",)], "s string").select(X.fold_sequence(F.col("s")).alias("f")).collect()
    assert [r["f"] and tuple(r["f"]) for r in rows] == [(5, 1, 2), None, (2, 1, 0), (0, 0, 0)]


def test_texts(spark):
    got = spark.range(1).select(
        X.triple_slash(F.lit(0.3), F.lit(0.35), F.lit(1.0)), X.usage_text(F.lit(0.45), F.lit(12), F.lit(92.06)), X.pitching_line(F.lit(19), F.lit(5), F.lit(2), F.lit(7), F.lit(1)),
        X.wrapped(F.lit("aa bb cc dddddddd e"), 5), X.span_text(F.lit(3723)), X.span_text(F.lit(59)), X.valid_year(F.lit("1800")), X.hours_minutes(F.lit("x")), games.narrative(F.lit(1), F.lit("---"), F.lit("0-0"), F.lit("Walk")),
    ).first()
    assert tuple(got) == (".300/.350/1.000", "45% (12) 92.1mph", "6.1 IP, 5 H, 2 R, 7 K, 1 BB", "aa bb\ncc\ndddddddd\ne", "1h 02m 03s", "00m 59s", None, None, "1 out, bases empty, 0-0: Walk")


def test_rounded_averages(spark):
    df = spark.createDataFrame([(1, 0.123456, 2210.26, 6.054, 0.41237)], "k int, px double, spin_rate double, extension double, plate_time double")
    row = metrics.pitch_metrics(df, ["k"], {}, rounded=True).first()
    assert (row["avg_px"], row["avg_spin_rate"], row["avg_extension"], row["avg_plate_time"]) == (0.12, 2210.0, 6.05, 0.412)


def test_merged_once_takes_the_first_row_in_order(spark):
    both = sets.merged_once(spark.createDataFrame([(1, "b"), (1, "a")], "k int, v string"), spark.createDataFrame([(1, "0"), (2, "z"), (2, "y")], "k int, v string"), ["k"])
    assert sorted(map(tuple, both.collect())) == [(1, "a"), (2, "y")]


def test_scopes_and_percent(spark):
    df = spark.createDataFrame([(1, "x", None), (1, "y", 2), (2, "x", 2)], "player int, team string, year int")
    out = splits.in_scopes(df, {"career": ["player"], "team": ["player", "team"], "year": ["year"]}, [F.count("*").alias("n")])
    rows = {(r["scope"], r["player"], r["team"], r["year"], r["n"]) for r in out.collect()}
    assert rows == {("career", 1, None, None, 2), ("career", 2, None, None, 1), ("team", 1, "x", None, 1), ("team", 1, "y", None, 1), ("team", 2, "x", None, 1), ("year", None, None, None, 1), ("year", None, None, 2, 2)}
    shares = splits.distribution(spark.createDataFrame([(1, k) for k in "aab"], "g int, p string"), ["g"], "p", rounded=True)
    assert {(r["p"], round(r["percent"], 6)) for r in shares.collect()} == {("a", 66.7), ("b", 33.3)}


def test_object_store(spark, tmp_path):
    s = store.ObjectStore(spark, f"file:{tmp_path}")
    s.write("a/x.html", "<p>é</p>")
    assert s.read("a/x.html") == "<p>é</p>" and s.read("a/none") is None
    assert s.rename("a/x.html", "b/c/y.html") and not s.exists("a/x.html")
    assert [r["key"] for r in s.keys().collect()] == ["b/c/y.html"]
    assert s.delete("b/c/y.html") and not s.exists("b/c/y.html")


def test_saves_that_fail_are_told(spark, tmp_path):
    df = spark.range(3)
    said = store.save_everywhere(df, [f"file:{tmp_path}/a", "nosuchscheme://x/y"])
    assert said[f"file:{tmp_path}/a"] is None and said["nosuchscheme://x/y"]
    assert spark.read.json(f"{tmp_path}/a").count() == 3


def test_pages_of_another_day(spark):
    link = "<a href='https://x.org/boxes/TOR/TOR201908170.shtml'>b</a>"
    df = spark.createDataFrame([(1, link, datetime.date(2019, 8, 17)), (2, link, datetime.date(2019, 8, 18)), (3, "", None)], "k int, h string, d date")
    assert sorted((r["k"], r["game_id"], r["right_day"]) for r in pages.games_of_day(df, "k", "h", "d").collect()) == [(1, "TOR201908170", True), (2, "TOR201908170", False)]


def test_box_score_sections(spark):
    table = lambda *rows: "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    page = table(("Batting", "AB", "H"), ("Al", "4", "2"), ("Bo", "", "x")) + table(("Pitching", "IP", "ER"), ("Cy", "6.1", "3")) + table(("other",))
    out = pages.box_score(spark.createDataFrame([(1, page)], "k int, h string"), "k", "h")
    assert [(r["batting"], r["ab"], r["h"]) for r in out["Batting"].orderBy("row").collect()] == [("Al", 4, 2), ("Bo", None, None)]
    assert [(r["pitching"], r["ip"], r["er"]) for r in out["Pitching"].collect()] == [("Cy", "6.1", 3)]
    assert out["Inn"].count() == 0
