import pandas as pd
from pyspark.sql import functions as F

from stathouse.plans import dossier, patches, reconcile, timing


def _streams(spark, at_bats, pitches):
    a = spark.createDataFrame(at_bats, "at_bat_id string, game_id string, number int, inning int, pitches int, game_start double")
    p = spark.createDataFrame(pitches, "pitch_id long, at_bat_id string, game_id string, ab_count int, thrown double, has_zone int")
    return {r["at_bat_id"]: r for r in reconcile.reconcile(a, p).collect()}


def test_clean_game(spark):
    got = _streams(spark, [("g_a_0", "g", 1, 1, 2, 0.0)], [(1, "g_a_0", "g", 1, 20.0, 1), (2, "g_a_0", "g", 2, 45.0, 1)])
    r = got["g_a_0"]
    assert [c["pitch_id"] for c in r["chosen"]] == [1, 2] and r["removed"] == [] and r["missing"] == [] and not r["invalid"]


def test_missing_extra_and_unclaimed(spark):
    at_bats = [("g_a_0", "g", 1, 1, 3, 0.0), ("g_b_0", "g", 2, 1, 1, 0.0)]
    pitches = [(1, "g_a_0", "g", 1, 20.0, 1), (2, "g_a_0", "g", 1, 21.0, 0), (3, "g_a_0", "g", 3, 70.0, 1), (9, "g_z_0", "g", 1, 80.0, 1)]
    got = _streams(spark, at_bats, pitches)
    assert got["g_a_0"]["missing"] == [2] and got["g_a_0"]["removed"] == [2]
    assert got["g_b_0"]["missing"] == [1] and got["g_b_0"]["chosen"] is None
    assert got["g_z_0"]["invalid"] and got["g_z_0"]["removed"] == [9]


def test_choice_depends_on_the_pitch_before():
    limits = (4, 24, 120)
    near, far = {"thrown": 124.0, "has_zone": 1}, {"thrown": 150.0, "has_zone": 1}
    assert reconcile.choose([far, near], 100.0, limits) is near
    assert reconcile.choose([near, far], 126.0, limits) is far  # the nearer one would come before it
    assert reconcile.choose([{"thrown": 1.0, "has_zone": 0}, {"thrown": 2.0, "has_zone": 1}], 100.0, limits)["has_zone"] == 1


def test_every_pitch_is_accounted_for(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts"))
    at_bats, pitches = reconcile.demo_streams(events)
    r = reconcile.audit(reconcile.reconcile(at_bats, pitches)).agg(F.sum("pitches_due"), F.sum("pitches_chosen"), F.sum("pitches_missing"), F.sum("pitches_removed"), F.sum("pitches_invalid")).first()
    assert r[0] == r[1] + r[2]
    assert r[1] + r[3] + r[4] == pitches.count()


def test_at_bats_from_rows(spark):
    rows = [
        ("g", 1, "t1", "p_b", "event", "CB", 0, 0, False), ("g", 2, "t1", "p_b", "sub", None, 0, 0, False), ("g", 3, "t1", "p_b", "event", "CBX", 0, 1, False),
        ("g", 4, "t1", "p_c", "event", "BBBB", 1, 0, False), ("g", 5, "t1", "p_b", "event", "C", 2, 1, False), ("g", 6, "b1", "q_d", "event", "H", 0, 0, False),
    ]
    df = spark.createDataFrame(rows, "game_id string, row int, inning string, base_key string, kind string, sequence string, outs_before int, outs_on_play int, interference boolean")
    got = [(r["at_bat_id"], r["pitches"], r["complete"], len(r["events"])) for r in reconcile.at_bats(df).orderBy("number").collect()]
    assert got == [("g_p_b_0", 3, True, 3), ("g_p_c_0", 4, True, 1), ("g_p_b_1", 1, False, 1), ("g_q_d_0", 1, True, 1)]


def test_pitch_flags(spark):
    df = spark.createDataFrame([("Foul Tip", 7, "Strikeout", 1), ("Ball", 99, "Strikeout", 0), ("In play, no out", 1, "Home Run", 1)], "pdes string, zone_location int, des string, is_final_pitch_of_ab int")
    a, b, c = reconcile.outcome_flags(reconcile.plate_flags(df)).collect()
    assert (a["swinging_strike"], a["batter_made_contact"], a["swing_inside_zone"], a["ab_result_k"], a["ab_result_out"]) == (1, 1, 1, 1, 1)
    assert (b["has_zone_location"], b["batter_did_swing"], b["ab_result_k"]) == (0, 0, 0)
    assert (c["swing_outside_zone"], c["ab_result_homerun"], c["ab_result_hit"], c["ab_result_out"]) == (1, 1, 1, 0)


def test_patches(spark):
    df = spark.createDataFrame([("G1", "x"), ("G2", "y")], "id string, v string")
    p = spark.createDataFrame([("G1", "G9")], "old string, new string")
    assert sorted(r["id"] for r in patches.rename_ids(df, "id", p, "old", "new").collect()) == ["G2", "G9"]


def test_unmatched_groups_are_placed(spark):
    pitches = spark.createDataFrame([(1, "g", 1, 10, 20, [1, 2, 3]), (2, "g", 2, 11, 21, [1, 2])], "`group` int, game_id string, inning int, batter int, pitcher int, numbers array<int>")
    at_bats = spark.createDataFrame([("a", "g", 1, 10, 99, [1, 2]), ("b", "g", 2, 11, 21, [1]), ("c", "g", 2, 98, 21, [1, 2]), ("d", "g", 1, 97, 96, [1])], "at_bat_id string, game_id string, inning int, batter int, pitcher int, missing array<int>")
    assert sorted(tuple(r) for r in patches.place_unmatched(pitches, at_bats).collect()) == [(1, "a"), (2, "c")]


def test_calibration(spark):
    rows = [("g", 1, 1, 1, 0), ("g", 1, 1, 2, 20), ("g", 1, 2, 3, 60), ("g", 2, 3, 4, 260)]
    df = spark.createDataFrame([(*r[:4], r[4] * 1_000_000) for r in rows], "game_id string, inning int, at_bat int, place int, us long")
    got = {k: v.first()["total"] for k, v in timing.calibration(timing.pitch_gaps(df)).items()}
    assert got == {"pitch": 20, "at_bat": 40, "inning": 200}


def test_dossier(spark):
    df = spark.createDataFrame([(1, "FF", "R", "L", 1), (1, "SL", "L", "L", 0), (1, "FF", "R", "R", 1)], "batter int, pitch_type string, p_throws string, stand string, swing int")
    from stathouse.operators.splits import hand_splits

    out = dossier.dossier(df, ["batter"], "pitch_type", hand_splits(), {"batter_did_swing": F.col("swing")})
    got = {(r["split"], r["pitch_type"]): (r["total_pitches"], r["swing_rate"]) for r in out.collect()}
    assert got[("all", None)] == (3, 2 / 3) and got[("vs_rhp", "FF")] == (2, 1.0)
    steps = spark.createDataFrame([("swing_rate", "FF", 50.0, 0.5), ("swing_rate", "FF", 90.0, 1.0)], "stat_name string, pitch_type string, percentile double, stat_value double")
    ranked = dossier.with_percentiles(out.where("pitch_type = 'FF' AND split = 'all'"), steps, ["pitch_type"], {"swing_rate": False})
    assert ranked.first()["swing_rate_percentile"] == 90.0


def test_fold_of_empty_game():
    none = pd.DataFrame(columns=["at_bat_id", "game_id", "number", "inning", "pitches", "game_start"])
    assert reconcile.fold_game(none, pd.DataFrame(columns=["pitch_id", "at_bat_id", "ab_count", "thrown", "has_zone"]), reconcile.Limits()) == []
