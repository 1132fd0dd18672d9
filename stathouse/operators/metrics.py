"""Metric registries: sums over 0/1 flags first, ratios over sums second.

``flags`` names the 0/1 columns of a pitch-level table; any table whose
columns can be expressed as such flags gets all metrics.  The ``plain``
flavour keeps ratios unrounded; the ``rounded`` flavour rounds each ratio
half to even at three places and builds sums of ratios from rounded terms.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import half_even, safe_ratio

#: Flags of a pitch and the name of their sum.
PITCH_FLAGS = {
    "has_zone_location": "total_located", "batter_did_swing": "total_swings", "batter_made_contact": "total_contact",
    "called_strike": "total_called_strikes", "swinging_strike": "total_swinging_strikes",
    "inside_strike_zone": "total_inside_zone", "outside_strike_zone": "total_outside_zone",
    "swing_inside_zone": "total_swings_inside", "swing_outside_zone": "total_swings_outside",
    "contact_inside_zone": "total_contact_inside", "contact_outside_zone": "total_contact_outside",
    "is_in_play": "total_in_play", "is_ground_ball": "total_ground_balls", "is_fly_ball": "total_fly_balls",
    "is_line_drive": "total_line_drives", "is_popup": "total_popups", "is_hard_hit": "total_hard_hits",
    "is_medium_hit": "total_medium_hits", "is_soft_hit": "total_soft_hits", "is_barreled": "total_barrels",
    "is_final_pitch_of_ab": "total_pa", "ab_result_out": "total_outs", "ab_result_hit": "total_hits",
    "ab_result_single": "total_singles", "ab_result_double": "total_doubles", "ab_result_triple": "total_triples",
    "ab_result_homerun": "total_homeruns", "ab_result_bb": "total_bb", "ab_result_ibb": "total_ibb", "ab_result_k": "total_k",
    "ab_result_hbp": "total_hbp", "ab_result_error": "total_errors", "ab_result_sac_hit": "total_sac_hits",
    "ab_result_sac_fly": "total_sac_flies",
}

#: ratio = numerator over denominator, both sums.
PITCH_RATES = {
    "zone_rate": ("total_inside_zone", "total_pitches"), "called_strike_rate": ("total_called_strikes", "total_pitches"),
    "swinging_strike_rate": ("total_swinging_strikes", "total_pitches"), "swing_rate": ("total_swings", "total_pitches"),
    "whiff_rate": ("total_swinging_strikes", "total_swings"), "bad_whiff_rate": ("total_bad_whiffs", "total_swings"),
    "contact_rate": ("total_contact", "total_swings"), "o_swing_rate": ("total_swings_outside", "total_outside_zone"),
    "z_swing_rate": ("total_swings_inside", "total_inside_zone"), "o_contact_rate": ("total_contact_outside", "total_swings_outside"),
    "z_contact_rate": ("total_contact_inside", "total_swings_inside"), "ground_ball_rate": ("total_ground_balls", "total_in_play"),
    "fly_ball_rate": ("total_fly_balls", "total_in_play"), "line_drive_rate": ("total_line_drives", "total_in_play"),
    "popup_rate": ("total_popups", "total_in_play"), "hard_hit_rate": ("total_hard_hits", "total_in_play"),
    "medium_hit_rate": ("total_medium_hits", "total_in_play"), "soft_hit_rate": ("total_soft_hits", "total_in_play"),
    "barrel_rate": ("total_barrels", "total_in_play"), "hr_per_fb": ("total_homeruns", "total_fly_balls"),
    "bb_rate": ("total_bb", "total_pa"), "k_rate": ("total_k", "total_pa"),
}

#: Columns that are averaged where the table has them, and the places of the rounded flavour.
PITCH_AVERAGES = {"start_speed": 1, "spin_rate": 0, "pfx_x": 2, "pfx_z": 2, "px": 2, "pz": 2, "plate_time": 3, "extension": 2, "break_angle": 1, "break_length": 1, "break_y": 1, "spin_direction": 0}
LAUNCH = ("launch_speed", "launch_angle", "total_distance")


def pitch_sums(flags: Mapping[str, Column], rounded: bool = False) -> list[Column]:
    """One partial aggregate per flag, the pitch count, and the bad whiffs: outside of the zone, or (rounded flavour) at swings outside of it."""
    out = [F.count(F.lit(1)).alias("total_pitches")]
    out += [F.coalesce(F.sum(column.cast("int")), F.lit(0)).cast("long").alias(PITCH_FLAGS[name]) for name, column in flags.items()]
    outside = "swing_outside_zone" if rounded else "outside_strike_zone"
    if {"swinging_strike", outside} <= flags.keys():
        out.append(F.count(F.when((flags["swinging_strike"] == 1) & (flags[outside] == 1), 1)).alias("total_bad_whiffs"))
    return out


def with_rates(sums: DataFrame, rounded: bool = False) -> DataFrame:
    """Ratios, batting lines and their sums from a table of sums; what lacks a sum is left out."""
    has = set(sums.columns)
    clean = (lambda x: half_even(x, 3)) if rounded else (lambda x: x)
    out = {name: clean(safe_ratio(F.col(n), F.col(d))) for name, (n, d) in PITCH_RATES.items() if {n, d} <= has}
    if {"total_called_strikes", "total_swinging_strikes"} <= has:
        out["csw_rate"] = clean(safe_ratio(F.col("total_called_strikes") + F.col("total_swinging_strikes"), F.col("total_pitches")))
    if {"total_hits", "total_outs", "total_errors", "total_sac_hits", "total_sac_flies"} <= has:
        at_bats = F.col("total_hits") + F.col("total_outs") + F.col("total_errors") - F.col("total_sac_hits") - F.col("total_sac_flies")
        sums = sums.withColumn("total_at_bats", at_bats)
        ab, on = F.col("total_at_bats"), F.col("total_hits") + F.col("total_bb") + F.col("total_hbp")
        bases = F.col("total_singles") + 2 * F.col("total_doubles") + 3 * F.col("total_triples") + 4 * F.col("total_homeruns")
        avg, slg = clean(safe_ratio(F.col("total_hits"), ab)), clean(safe_ratio(bases, ab))
        obp = clean(safe_ratio(on, ab + F.col("total_bb") + F.col("total_hbp") + F.col("total_sac_flies")))
        out |= {"avg": avg, "obp": obp, "slg": slg, "ops": clean(obp + slg), "iso": clean(slg - avg)}
    return sums.withColumns(out)


def valid_pitches(df: DataFrame, batters: bool = False) -> DataFrame:
    """Pitches that count: not an unthrown walk, in sequence, known handedness."""
    ok = (F.col("is_invalid_ibb") == 0) & (F.col("is_out_of_sequence") == 0) & F.col("stand").isin("L", "R")
    return df.where(ok & F.col("p_throws").isin("L", "R") if batters else ok)


def pitch_metrics(df: DataFrame, keys: list[str], flags: Mapping[str, Column] | None = None, rounded: bool = False) -> DataFrame:
    """All metrics per key: one scan, one shuffle of partial sums."""
    flags = flags or {name: F.col(name) for name in PITCH_FLAGS if name in df.columns}
    aggregates = pitch_sums(flags, rounded)
    if rounded:  # over all pitches, missing values counting as 0; launch over what was measured and isn't 0
        average = lambda c: half_even(safe_ratio(F.coalesce(F.sum(c), F.lit(0)), F.count(F.lit(1))), PITCH_AVERAGES[c])
        launch = lambda c: half_even(safe_ratio(F.coalesce(F.sum(c), F.lit(0)), F.count(F.when(F.col(c) != 0, 1))), 1)
    else:
        average = F.avg
        launch = lambda c: safe_ratio(F.coalesce(F.sum(c), F.lit(0)), F.sum(flags["is_in_play"].cast("int")))
    aggregates += [average(c).alias(f"avg_{c}") for c in PITCH_AVERAGES if c in df.columns]
    if "is_in_play" in flags:
        aggregates += [launch(c).alias(f"avg_{c}") for c in LAUNCH if c in df.columns]
    if "launch_speed" in df.columns:
        aggregates.append(F.max("launch_speed").alias("max_launch_speed"))
    if "pitch_type_int" in df.columns:
        aggregates.append(F.bit_or("pitch_type_int").alias("pitch_type_mask"))
    return with_rates(df.groupBy(*keys).agg(*aggregates), rounded)


#: Summed columns of a batting and of a pitching line.
BAT_SUMS = ("at_bats", "runs_scored", "hits", "rbis", "bases_on_balls", "strikeouts", "plate_appearances", "total_pitches", "total_strikes", "doubles", "triples", "homeruns", "stolen_bases", "caught_stealing", "hit_by_pitch", "intentional_bb", "gdp", "sac_fly", "sac_hit")
PITCH_SUMS = ("outs", "hits", "runs", "earned_runs", "bases_on_balls", "strikeouts", "homeruns", "batters_faced", "pitch_count", "strikes", "strikes_contact", "strikes_swinging", "strikes_looking", "ground_balls", "fly_balls", "line_drives", "wins", "losses", "saves")


def bat_lines(df: DataFrame, keys: list[str], rounded: bool = False) -> DataFrame:
    """Batting: sums of lines, games, starts, and rates; on-base leaves sacrifice flies out."""
    clean = (lambda x: half_even(x, 3)) if rounded else (lambda x: x)
    sums = [F.count(F.lit(1)).alias("total_games")] + [F.sum(c).cast("long").alias(c) for c in BAT_SUMS if c in df.columns]
    sums += [F.sum(F.col(c).cast("int")).cast("long").alias(f"total_{c}") for c in ("is_starter",) if c in df.columns]
    sums += [(half_even(F.sum(c), places) if rounded else F.sum(c)).alias(c) for c, places in (("wpa_bat", 2), ("re24_bat", 1)) if c in df.columns]
    out = df.groupBy(*keys).agg(*sums)
    c = F.col
    singles = c("hits") - c("doubles") - c("triples") - c("homeruns")
    avg, slg = clean(safe_ratio(c("hits"), c("at_bats"))), clean(safe_ratio(singles + 2 * c("doubles") + 3 * c("triples") + 4 * c("homeruns"), c("at_bats")))
    on = c("hits") + c("bases_on_balls") + c("hit_by_pitch")
    obp = clean(safe_ratio(on, c("at_bats") + c("bases_on_balls") + c("hit_by_pitch")))
    if "total_is_starter" in out.columns:
        out = out.withColumn("percent_started", clean(safe_ratio(c("total_is_starter"), c("total_games"))))
    if "total_strikes" in out.columns and "strikes_contact" in out.columns:
        out = out.withColumn("contact_rate", clean(safe_ratio(c("strikes_contact"), c("total_strikes"))))
    return out.withColumns({
        "avg": avg, "obp": obp, "slg": slg, "ops": clean(obp + slg), "iso": clean(slg - avg),
        "bb_rate": clean(safe_ratio(c("bases_on_balls"), c("plate_appearances"))), "k_rate": clean(safe_ratio(c("strikeouts"), c("plate_appearances"))),
    })


def pitch_lines(df: DataFrame, keys: list[str], rounded: bool = False) -> DataFrame:
    """Pitching: sums of lines, earned run average, walks and hits per inning, and rates per nine innings."""
    clean = (lambda x, n=3: half_even(x, n)) if rounded else (lambda x, n=3: x)
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_games"), *(F.sum(c).cast("long").alias(c) for c in PITCH_SUMS if c in df.columns))
    c, k, bb = F.col, clean(safe_ratio(F.col("strikeouts"), F.col("batters_faced"))), clean(safe_ratio(F.col("bases_on_balls"), F.col("batters_faced")))
    return out.withColumns({
        "era": clean(safe_ratio(27 * c("earned_runs"), c("outs")), 2), "whip": clean(safe_ratio(3 * (c("bases_on_balls") + c("hits")), c("outs")), 2),
        "k_per_nine": clean(safe_ratio(27 * c("strikeouts"), c("outs")), 1), "bb_per_nine": clean(safe_ratio(27 * c("bases_on_balls"), c("outs")), 1),
        "hr_per_nine": clean(safe_ratio(27 * c("homeruns"), c("outs")), 1), "k_per_bb": clean(safe_ratio(c("strikeouts"), c("bases_on_balls")), 1),
        "k_rate": k, "bb_rate": bb, "k_minus_bb": clean(k - bb),
    })
