"""Reconciliation of two records of a game: play-by-play rows and measured pitches.

Play-by-play rows are cut into at-bats (sessions that end with a complete
pitch sequence, a third out, interference, or the inning).  Pitches are
numbered inside their key by at-bat.  Both meet on the at-bat; for each
pitch number the best candidate is chosen, which depends on the one chosen
before, so a game is folded in order: the one step that isn't relational,
run per game in Arrow batches.  A game has a few hundred rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import ordered

#: Strings of outcomes (lower case) by the flag they set.
OUTCOMES = {
    "ab_result_out": ("bunt groundout", "bunt pop out", "double play", "flyout", "forceout", "grounded into dp", "groundout", "lineout", "pop out", "runner out", "sac bunt", "sac fly", "sac fly dp", "sacrifice bunt dp", "strikeout", "strikeout - dp", "triple play"),
    "ab_result_unclear": ("batter interference", "catcher interference", "fan interference", "fielders choice", "fielders choice out", "missing_des"),
    "ab_result_hit": ("double", "home run", "single", "triple"),
    "ab_result_single": ("single",), "ab_result_double": ("double",), "ab_result_triple": ("triple",), "ab_result_homerun": ("home run",),
    "ab_result_bb": ("intent walk", "walk"), "ab_result_ibb": ("intent walk",), "ab_result_k": ("strikeout", "strikeout - dp"),
    "ab_result_hbp": ("hit by pitch",), "ab_result_error": ("field error",), "ab_result_sac_hit": ("sac bunt", "sacrifice bunt dp"),
    "ab_result_sac_fly": ("sac fly", "sac fly dp"),
}
#: Descriptions of a pitch that mean a swing, contact, or a swing and a miss.
SWINGING = ("Foul Tip", "Missed Bunt", "Swinging Pitchout", "Swinging Strike", "Swinging Strike (Blocked)")
CONTACT = ("Foul", "Foul (Runner Going)", "Foul Bunt", "Foul Tip", "In play, no out", "In play; no out", "In play, out(s)", "In play; out(s)", "In play, run(s)", "In play; run(s)")
SWING = tuple(dict.fromkeys((*CONTACT, *SWINGING)))
#: Cells of the zone grid that lie inside, as parsed pages number them.
INSIDE_CELLS = (6, 7, 8, 11, 12, 13, 16, 17, 18)


def plate_flags(pitches: DataFrame, inside: tuple[int, ...] = INSIDE_CELLS, missing: int = 99) -> DataFrame:
    """Swing, contact and zone flags of each pitch from its description (pdes) and cell (zone_location)."""
    d, z = F.col("pdes"), F.col("zone_location")
    swing, contact, located = d.isin(*SWING), d.isin(*CONTACT), z.isNotNull() & (z != missing)
    inner = located & z.isin(*inside)
    outer = located & ~z.isin(*inside)
    flags = {
        "has_zone_location": located, "batter_did_swing": swing, "batter_made_contact": contact, "called_strike": d.contains("Called Strike"),
        "swinging_strike": d.isin(*SWINGING), "inside_strike_zone": inner, "outside_strike_zone": outer, "swing_inside_zone": swing & inner,
        "swing_outside_zone": swing & outer, "contact_inside_zone": contact & inner, "contact_outside_zone": contact & outer,
    }
    return pitches.withColumns({k: X.flag(v) for k, v in flags.items()})


def outcome_flags(pitches: DataFrame, final: str = "is_final_pitch_of_ab", des: str = "des") -> DataFrame:
    """Flags of an at-bat's outcome, on its last pitch only."""
    at_end = F.col(final).cast("boolean")
    return pitches.withColumns({k: X.flag(at_end & F.lower(des).isin(*v)) for k, v in OUTCOMES.items()})


def at_bats(rows: DataFrame) -> DataFrame:
    """Play-by-play rows (game_id, row, inning, base_key, kind, sequence, outs_before, outs_on_play, interference) as at-bats.

    One row for each: at_bat_id, game_id, number, inning, base_key, sequence, pitches, complete, events.
    """
    event = F.col("kind") == "event"
    seq = F.replace(F.coalesce("sequence", F.lit("")), F.lit("^"), F.lit(""))
    complete = event & F.coalesce(X.completes_at_bat(seq), F.lit(False))
    third = event & (F.col("outs_before") + F.col("outs_on_play") >= 3)
    rows = rows.withColumns({"_seq": seq, "_complete": complete})
    rows = ordered.sessions(rows, ["game_id", "inning"], ["row"], complete | third | (event & F.col("interference")), "_group")
    last = F.max_by(F.struct("base_key", "_seq", "_complete"), F.when(event, F.col("row")))
    groups = rows.groupBy("game_id", "inning", "_group").agg(
        last.alias("_last"), F.min("row").alias("first_row"), F.max("row").alias("last_row"),
        F.sort_array(F.collect_list(F.struct("row", "kind"))).alias("events"))
    groups = groups.where("_last IS NOT NULL").select("game_id", "inning", "first_row", "last_row", "events", "_last.*")
    groups = ordered.instances(groups, ["game_id", "base_key"], ["last_row"])
    groups = ordered.ranked(groups, ["game_id"], ["last_row"], "number")
    return groups.select(
        F.concat_ws("_", "game_id", "base_key", F.col("instance").cast("string")).alias("at_bat_id"), "game_id", "number", "inning", "base_key",
        F.col("_seq").alias("sequence"), X.fold_sequence(F.col("_seq"))["pitches"].alias("pitches"), F.col("_complete").alias("complete"), "events")


def numbered_pitches(pitches: DataFrame) -> DataFrame:
    """Pitches (game_id, base_key, ab_id, ab_count, thrown, has_zone) with at_bat_id; a key's at-bats are numbered by ab_id."""
    out = ordered.instance_of_value(pitches, ["game_id", "base_key"], "ab_id")
    return out.withColumn("at_bat_id", F.concat_ws("_", "game_id", "base_key", F.col("instance").cast("string"))).drop("instance")


@dataclass
class Limits:
    """Seconds between pitches: least, usual and most, inside an at-bat, between at-bats, and between innings."""

    pitch: tuple[float, float, float] = (4, 24, 120)
    at_bat: tuple[float, float, float] = (10, 43, 240)
    inning: tuple[float, float, float] = (60, 160, 600)


def choose(candidates: list[dict], before: float, limits: tuple[float, float, float]) -> dict:
    """The candidate for one pitch number, given when the pitch before was thrown.

    Those whose gap lies within the limits come first; measured locations
    come before others, then the gap nearest to the usual one.  If none fits,
    the earliest with a measured location.
    """
    if len(candidates) == 1:
        return candidates[0]
    least, usual, most = limits
    gap = lambda c: c["thrown"] - before
    fit = [c for c in candidates if gap(c) >= 0 and int(least) <= gap(c) <= int(most)]
    if fit:
        return min(fit, key=lambda c: (-c["has_zone"], abs(usual - gap(c))))
    return min(candidates, key=lambda c: (-c["has_zone"], c["thrown"]))


def fold_game(at_bats: pd.DataFrame, pitches: pd.DataFrame, limits: Limits) -> list[tuple]:
    """(at_bat_id, pitch id, state) for a game in order; state is chosen or out_of_sequence."""
    by_at_bat = {k: g.to_dict("records") for k, g in pitches.sort_values(["at_bat_id", "ab_count", "thrown", "pitch_id"]).groupby("at_bat_id")}
    start = at_bats["game_start"].min() if len(at_bats) else 0.0
    before, inning, whole, out = start, None, True, []
    for ab in at_bats.sort_values("number").to_dict("records"):
        rows = by_at_bat.get(ab["at_bat_id"], [])
        previous = before if whole else start
        chosen = []
        for number in range(1, int(ab["pitches"]) + 1):
            candidates = [p for p in rows if p["ab_count"] == number]
            if not candidates:
                continue
            kind = limits.pitch if number > 1 else limits.at_bat if inning in (None, ab["inning"]) else limits.inning
            best = choose(candidates, previous, kind)
            chosen.append(best)
            previous = best["thrown"]
        ids = {p["pitch_id"] for p in chosen}
        out += [(ab["at_bat_id"], p["pitch_id"], "chosen" if p["pitch_id"] in ids else "out_of_sequence") for p in rows]
        whole = len(chosen) == ab["pitches"] and bool(chosen)
        before, inning = (chosen[-1]["thrown"] if chosen else start), ab["inning"]
    return out


def reconcile(at_bats: DataFrame, pitches: DataFrame, limits: Limits | None = None) -> DataFrame:
    """One row for each at-bat: its chosen pitches, those out of sequence, the numbers that are missing; and the pitches that no at-bat claims.

    at_bats: at_bat_id, game_id, number, inning, pitches, game_start (seconds);
    pitches: pitch_id, at_bat_id, game_id, ab_count, thrown (seconds), has_zone.
    """
    limits = limits or Limits()

    def fold(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(fold_game(left, right, limits), columns=["at_bat_id", "pitch_id", "state"])

    need = at_bats.select("at_bat_id", "game_id", "number", "inning", "pitches", "game_start")
    own = lambda c: F.col(c).alias(c)  # noqa: E731  both streams may come from one table
    have = pitches.select("pitch_id", own("at_bat_id"), own("game_id"), "ab_count", "thrown", F.col("has_zone").cast("int").alias("has_zone"))
    states = need.groupBy("game_id").cogroup(have.groupBy("game_id")).applyInPandas(fold, "at_bat_id string, pitch_id long, state string")
    placed = have.join(states, ["at_bat_id", "pitch_id"])
    is_chosen = F.col("state") == "chosen"
    lists = placed.groupBy("at_bat_id").agg(
        F.array_sort(F.collect_list(F.when(is_chosen, F.struct("ab_count", "pitch_id", "thrown")))).alias("chosen"),
        F.array_sort(F.collect_list(F.when(~is_chosen, F.col("pitch_id")))).alias("removed"))
    numbers = F.when(F.col("pitches") > 0, F.sequence(F.lit(1), F.col("pitches"))).otherwise(F.array().cast("array<int>"))
    out = need.withColumn("pitches", F.col("pitches").cast("int")).join(lists, "at_bat_id", "left")
    seen = F.coalesce(F.transform("chosen", lambda p: p["ab_count"].cast("int")), F.array().cast("array<int>"))
    out = out.withColumns({"missing": F.array_except(numbers, seen), "invalid": F.lit(False)})
    claimed = need.select("at_bat_id")
    orphans = have.join(claimed, "at_bat_id", "left_anti").groupBy("at_bat_id", "game_id").agg(F.array_sort(F.collect_list("pitch_id")).alias("removed"))
    return out.unionByName(orphans.withColumn("invalid", F.lit(True)), allowMissingColumns=True)


def audit(reconciled: DataFrame) -> DataFrame:
    """Per game: pitches that are due, chosen, missing, removed and invalid, and the at-bats concerned."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    valid = ~F.col("invalid")
    some = lambda c: F.count(F.when(c, 1))
    return reconciled.groupBy("game_id").agg(
        some(valid).alias("at_bats"), F.sum(F.when(valid, F.col("pitches")).otherwise(0)).cast("long").alias("pitches_due"),
        F.sum(F.greatest(size("chosen"), F.lit(0))).cast("long").alias("pitches_chosen"), F.sum(F.when(valid, size("missing")).otherwise(0)).cast("long").alias("pitches_missing"),
        F.sum(F.when(valid, F.greatest(size("removed"), F.lit(0))).otherwise(0)).cast("long").alias("pitches_removed"),
        F.sum(F.when(~valid, size("removed")).otherwise(0)).cast("long").alias("pitches_invalid"),
        some(valid & (size("missing") > 0)).alias("at_bats_missing"), some(valid & (size("removed") > 0)).alias("at_bats_removed"), some(~valid).alias("at_bats_invalid"),
        (F.coalesce(F.bool_or(F.when(valid, size("missing") > 0)), F.lit(False)) | F.bool_or(~valid)).alias("has_error"))


def demo_streams(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A game for each user: at-bats are sessions that end with a purchase; some pitches are lost, some doubled, some unclaimed."""
    rows = ordered.sessions(events, ["user_id"], ["us", "event_id"], F.col("event_type") == "purchase", "ab")
    rows = ordered.instances(rows, ["user_id", "ab"], ["us", "event_id"], "place")
    rows = rows.withColumns({"game_id": F.col("user_id").cast("string"), "at_bat_id": F.concat_ws("_", F.col("user_id").cast("string"), F.col("ab").cast("string")), "thrown": F.floor(F.col("us") / 1_000_000).cast("double")})
    games = rows.groupBy("game_id").agg(F.min("thrown").alias("game_start"))
    need = rows.where("ab % 11 <> 10").groupBy("at_bat_id", "game_id", "ab").agg(F.count("*").cast("int").alias("pitches"))
    need = need.join(games, "game_id").select("at_bat_id", "game_id", F.col("ab").cast("int").alias("number"), (F.col("ab") / 4).cast("int").alias("inning"), "pitches", "game_start")
    have = rows.where("event_id % 17 <> 0").select(F.col("event_id").alias("pitch_id"), "at_bat_id", "game_id", (F.col("place") + 1).alias("ab_count"), "thrown", (F.col("event_id") % 2).alias("has_zone"))
    doubled = have.where("pitch_id % 13 = 0").withColumns({"pitch_id": -F.col("pitch_id"), "thrown": F.col("thrown") + 30.0})
    return need, have.unionByName(doubled)
