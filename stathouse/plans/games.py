"""Games as pages show them: meta lines, substitutions, doubleheaders, line scores, box pages, status texts, job classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X
from ..operators import status

#: Words that a venue's name has, and defensive positions.
VENUE_TERMS = ("stadium", "park", "field", "coliseum", "centre", "estadio", "dome")
POSITIONS = ("P", "C", "1B", "2B", "3B", "SS", "LF", "CF", "RF", "DH")
#: Columns of a line score.
REGULATION = 9


def game_meta(df: DataFrame, lines: str, weather: str) -> DataFrame:
    """Attendance, venue, duration, day or night, field and weather from a page's lines (array) and its weather sentence.

    A value that stands in no line, or in more than one where one is due, is
    null (attendance 0, venue empty); ``parsed`` tells whether duration, day
    and weather were all found.
    """
    all_of = lambda x, p: F.regexp_extract_all(x, F.lit(f"({p})"), 1)
    every = lambda p, keep: F.flatten(F.transform(F.filter(F.col(lines), keep), lambda x: all_of(x, p)))
    only = lambda found: F.when(F.size(found) == 1, found[0])
    crowd = only(every(r"[0-9]{1,2},[0-9]{3}", lambda x: F.lit(True)))
    venue = F.filter(F.col(lines), lambda x: F.lower(x).rlike("|".join(VENUE_TERMS)))
    length = only(every("[1-9]:[0-5][0-9]", lambda x: ~F.lower(x).contains("start time")))
    when = only(F.filter(F.col(lines), lambda x: F.lower(x).contains("game, on")))
    w = F.col(weather)
    get = lambda p, i=1: F.nullif(F.regexp_extract(w, p, i), F.lit(""))
    out = r"([0-9]{1,3})° F, Wind ([0-9]{1,3})mph ([\w\s]+)[.,\s]+([\w\s]+)[.,\s]+([\w\s]+)?.?"
    roof = r"([0-9]{1,3})° F, Wind ([0-9]{1,3})mph, ([\w\s]+)"
    dome = r"([0-9]{1,3})° F, In Dome."
    is_out, is_roof, is_dome = w.rlike(out), w.rlike(roof), w.rlike(dome)
    wind = F.when(is_out, F.concat(F.lit("Wind "), get(out, 2), F.lit("mph "), get(out, 3))).when(is_roof, F.concat(F.lit("Wind "), get(roof, 2), F.lit("mph"))).when(is_dome, "Wind 0mph")
    return df.withColumns({
        "attendance": F.coalesce(F.replace(crowd, F.lit(","), F.lit("")).cast("int"), F.lit(0)),
        "park_name": F.coalesce(F.substr(F.try_element_at(venue, F.lit(1)), F.lit(3)), F.lit("")),
        "duration": X.hours_minutes(length),
        "day_night": F.trim(F.split(when, ",")[0]),
        "field_type": F.initcap(F.trim(F.split(when, ",")[1])),
        "temperature": F.coalesce(get(out), get(roof), get(dome)).cast("int"),
        "wind": wind,
        "clouds": F.when(is_out, get(out, 4)).when(is_roof, get(roof, 3)).when(is_dome, "In Dome"),
        "precipitation": F.when(is_out, F.coalesce(get(out, 5), F.lit(""))).when(is_roof | is_dome, ""),
    }).withColumn("parsed", F.col("duration").isNotNull() & F.col("day_night").isNotNull() & F.col("temperature").isNotNull())


def inning_totals(text: Column) -> Column:
    """runs, hits, errors, left_on_base and both scores of an inning's closing sentence; null where it isn't one."""
    p = r"([0-9]{1,2}) runs?, ([0-9]{1,2}) hits?, ([0-9]{1,2}) errors?, (-?[0-9]{1,2}) LOB\.(?:\s\w+){1,2} ([0-9]{1,2}),(?:\s\w+){1,2} ([0-9]{1,2})"
    names = ("runs", "hits", "errors", "left_on_base", "away_runs", "home_runs")
    return F.when(text.rlike(p), F.struct(*(F.regexp_extract(text, p, i + 1).cast("int").alias(n) for i, n in enumerate(names))))


def substitution(text: Column) -> Column:
    """Who comes, who goes, positions, lineup slot and kind (bat or pitch) of a substitution's sentence; null if it isn't one.

    The sentence is cut at its verb; what follows holds the player who goes,
    his position in brackets, what the new one does, and the lineup slot.
    """
    s = F.trim(F.split(text, r"\(change occurred mid-batter\)")[0])
    name, pos = r"(.+?)", r"\(([BCDFHLPRS123]{1,2})\)"
    g = lambda p, i: F.trim(F.regexp_extract(s, p, i))

    def made(who: Column, into: Column, whom: Column, of: Column, slot: Column, kind: Column | str) -> Column:
        values = {"incoming_name": who, "incoming_pos": into, "outgoing_name": whom, "outgoing_pos": of, "lineup_slot": slot.cast("int"), "kind": F.lit(kind) if isinstance(kind, str) else kind}
        return F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in values.items()))

    none, zero = F.lit("N/A"), F.lit(0)
    runner = rf"^{name} running at second base to start the extra inning$"
    now = rf"^{name} pinch (?:hit|ran) for {name} and is now {name}$"
    moves = rf"^{name} moves from (\w+) to (\w+)"
    relief = rf"^{name} replaces {name} pitching$"
    verb = rf"^{name} (replaces|pinch hits for|pinch runs for|moves) (.+?) batting\D*([1-9])"
    rest, act = g(verb, 3), F.regexp_extract(s, verb, 2)
    does = F.regexp_extract(rest, r"(pitching|playing .+?)(?: and)?$", 1)
    before = F.trim(F.regexp_replace(rest, r"\s*(pitching|playing .+?)(?: and)?$", ""))
    gone = F.trim(F.regexp_replace(before, rf"\s*{pos}.*$", ""))
    bracket = F.nullif(F.regexp_extract(rest, pos, 1), F.lit(""))
    field = F.regexp_extract(does, rf"\b({'|'.join(POSITIONS)})\b", 1)
    into = F.when(act == "pinch hits for", "PH").when(act == "pinch runs for", "PR").when(does == "pitching", "P").otherwise(F.nullif(field, F.lit("")))
    kind = F.when(act.isin("pinch hits for", "pinch runs for"), F.lit("bat")).otherwise(F.lit("pitch"))
    return (
        F.when(s.rlike(runner), made(g(runner, 1), F.lit("PR"), none, none, zero, "bat"))
        .when(s.rlike(now), made(g(now, 1), g(now, 3), none, g(now, 2), zero, "bat"))
        .when(s.rlike(moves) & ~s.contains("batting"), made(g(moves, 1), g(moves, 3), g(moves, 1), g(moves, 2), zero, "pitch"))
        .when(s.rlike(relief), made(g(relief, 1), F.lit("P"), g(relief, 2), F.lit("P"), zero, "pitch"))
        .when(s.rlike(verb), made(g(verb, 1), into, gone, F.coalesce(bracket, into), F.regexp_extract(s, verb, 4), kind))
    )


def doubleheader_ids(games: DataFrame, day: str, home: str, number: str, name: str = "game_id") -> DataFrame:
    """home + date + 0 for a single game of a day; 1 and 2 where there is a second one."""
    last = F.max(number).over(W.partitionBy(day, home))
    suffix = F.when(last >= 2, F.col(number)).otherwise(0)
    return games.withColumn(name, F.concat(F.col(home).cast("string"), F.date_format(day, "yyyyMMdd"), suffix.cast("string")))


def half_innings(plays: DataFrame, by: list[str], inning: str, bottom: str, result: str) -> DataFrame:
    """Runs of each half inning: the letters R in the results of its plays."""
    return plays.groupBy(*by, inning, bottom).agg(F.sum(X.char_count(F.col(result), "R")).cast("long").alias("runs"))


def line_score(halves: DataFrame, by: list[str], inning: str, bottom: str) -> DataFrame:
    """Per game: innings, away and home runs by inning (null: not played), totals, and whether there were extra innings."""
    side = lambda b: F.sum(F.when(F.col(bottom) == b, F.col("runs")))
    rows = halves.groupBy(*by, inning).agg(side(False).alias("away"), side(True).alias("home"))
    entry = F.struct(F.col(inning).alias("inning"), "away", "home")
    out = rows.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("line"), F.sum("away").alias("away_runs"), F.sum("home").alias("home_runs"))
    return out.withColumn("extra_innings", F.size("line") > REGULATION)


def condensed(lines: DataFrame, by: list[str], width: int = REGULATION) -> DataFrame:
    """The innings that a line of ``width`` columns shows: those with most runs first, then the earliest; ``shown`` is in order of innings."""
    rows = lines.select(*by, F.explode("line").alias("x")).select(*by, "x.*")
    runs = F.coalesce("away", F.lit(0)) + F.coalesce("home", F.lit(0))
    scored = runs > 0
    n_scored = F.count(F.when(scored, 1)).over(W.partitionBy(*by))
    # with too many scoring innings those with fewest runs go (earliest first); otherwise quiet innings fill up from the first
    order = [F.desc(scored.cast("int")), F.when(n_scored > width, -runs).otherwise(F.col("inning")), F.when(n_scored > width, -F.col("inning")).otherwise(F.col("inning"))]
    rows = rows.withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_place") <= width)
    return rows.groupBy(*by).agg(F.array_sort(F.collect_list("inning")).alias("shown"))


def day_description(df: DataFrame) -> DataFrame:
    """The text of a day's status from both dashboards (0 or 1) and whether all boxes, logs and pitches are there."""
    a, b = F.col("dash_a") == 1, F.col("dash_b") == 1
    box, logs, pitches = F.col("all_boxscores"), F.col("all_pitch_logs"), F.col("all_pitchfx")
    done = X.safe_ratio(F.col("pitchfx_done"), F.col("pitchfx_total"))
    missing = F.concat(F.lit("Missing Brooks pitchfx logs ("), F.col("pitchfx_done").cast("string"), F.lit("/"), F.col("pitchfx_total").cast("string"), F.lit(", "), X.percent_text(done), F.lit(")"))
    nothing = ~box & ~logs & ~pitches
    text = (
        F.when(box & logs & pitches, F.lit("Scraped all game data")).when(box & logs, missing)
        .when(logs & ~pitches, "Scraped Brooks pitch logs, missing BBref boxscores").when(box & ~pitches, "Scraped BBref boxscores, missing Brooks pitch logs")
        .when(a & b & nothing, "Missing BBref boxscores and Brooks pitch logs").when(~a & b & nothing, "Scraped Brooks daily dashboard, missing BBref daily dash")
        .when(a & ~b & nothing, "Scraped BBref daily dashboard, missing Brooks daily dash").when(~a & ~b, "No data has been scraped").otherwise("N/A")
    )
    return df.withColumn("description", text)


def only_patched(invalid: Column, patched: Column) -> Column:
    """Whether what was wrong has all been patched: patched pitches, and none invalid."""
    return (patched > 0) & (invalid == 0)


def any_and_all_or(parents: DataFrame, flags: DataFrame, on: list[str], default: bool) -> DataFrame:
    """any_ and all_ columns beside their parents; parents without children take the default."""
    names = [c for c in flags.columns if c not in on]
    return parents.join(flags, on, "left").na.fill(default, names)


def job_classes(wanted: DataFrame, done: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Each wanted address: skip if its data is there already, else cached or missing."""
    mark = lambda d, name: d.select(key).distinct().withColumn(name, F.lit(True))
    out = wanted.join(mark(done, "_done"), key, "left").join(mark(cached, "_cached"), key, "left")
    return out.withColumn("class", F.when(F.col("_done"), "skip").when(F.col("_cached"), "cached").otherwise("missing")).drop("_done", "_cached")


def box_page(games: DataFrame, lines: DataFrame, batting: DataFrame, pitching: DataFrame, key: str) -> DataFrame:
    """One nested row for each game: its line score, batting and pitching lines in order."""
    listed = lambda d, name: d.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*(c for c in d.columns if c != key)))).alias(name))
    return games.join(lines, key, "left").join(listed(batting, "batting"), key, "left").join(listed(pitching, "pitching"), key, "left")


def narrative(outs: Column, runners: Column, score: Column, play: Column) -> Column:
    """``2 outs, 1-3 on, 4-3: Single to left``."""
    n = F.when(outs == 1, F.lit("1 out")).otherwise(F.concat(outs.cast("string"), F.lit(" outs")))
    on = F.when(runners.rlike("[0-9]"), F.concat(F.array_join(F.regexp_extract_all(runners, F.lit("([0-9])"), 1), "-"), F.lit(" on"))).otherwise("bases empty")
    return F.concat(F.concat_ws(", ", n, on, score), F.lit(": "), play)


def synthetic_numbers(at_bats: DataFrame, by: list[str], order: list, number: str, name: str = "ab_number") -> DataFrame:
    """An at-bat without a number takes one more than the one before: the last number seen, and a step for each row since."""
    w = W.partitionBy(*by).orderBy(*order)
    seen = F.last(number, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0))
    since = F.count(F.col(number)).over(w)
    out = at_bats.withColumns({"_seen": F.coalesce(seen, F.lit(0)), "_run": since})
    steps = F.row_number().over(W.partitionBy(*by, "_run").orderBy(*order))
    steps = F.when(F.col("_run") == 0, steps).otherwise(steps - 1)
    return out.withColumn(name, (F.col("_seen") + steps).cast("long")).drop("_seen", "_run")


def latest_complete(days: DataFrame, season: str, day: str, complete: Column) -> DataFrame:
    """The last day of each season whose data is complete; null if there is none."""
    return days.groupBy(season).agg(F.max(F.when(complete, F.col(day))).alias("latest"))


def regrouped(pitches: DataFrame, key: str, order: str) -> DataFrame:
    """Logs rebuilt after a patch: each appearance's pitches in order, their number, and counts by inning."""
    counts = status.counted_map(pitches, [key], "inning", "by_inning")
    lists = pitches.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "pitch_id"))), lambda x: x["pitch_id"]).alias("pitches"), F.count("*").alias("total"))
    return lists.join(counts, key)


def bridge(rows: DataFrame, left: str, right: str) -> DataFrame:
    """The pairs of a many-to-many relation, once each."""
    return rows.select(left, right).where(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct()
