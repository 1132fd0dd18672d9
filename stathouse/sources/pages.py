"""Typed rows from parsed pages (see ``html.parse_pages``): pitch tables, pitch logs, daily dashboards and box scores."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expressions as X
from . import html

#: Columns of a pitch table and their types; others are left out.
PITCH_COLUMNS = {
    "park_sv_id": "string", "ab_total": "int", "ab_count": "int", "ab_id": "int", "des": "string", "type": "string", "id": "int", "sz_top": "double",
    "sz_bot": "double", "mlbam_pitch_name": "string", "zone_location": "int", "stand": "string", "strikes": "int", "balls": "int", "p_throws": "string",
    "pdes": "string", "inning": "int", "pfx_x": "double", "pfx_z": "double", "start_speed": "double", "px": "double", "pz": "double", "spin_rate": "int",
}
#: What stands for a missing value.
PITCH_DEFAULTS = {"des": "missing_des", "pdes": "missing_pdes", "zone_location": "99"}
#: The first cell of the header of each table of a box score, and the columns that are read.
BOX_SECTIONS = {
    "Batting": {"Batting": "string", "AB": "int", "R": "int", "H": "int", "RBI": "int", "BB": "int", "SO": "int", "PA": "int", "Details": "string"},
    "Pitching": {"Pitching": "string", "IP": "string", "H": "int", "R": "int", "ER": "int", "BB": "int", "SO": "int", "HR": "int"},
    "Inn": {"Inn": "string", "Score": "string", "Out": "int", "RoB": "string", "Pit(cnt)": "string", "R/O": "string", "Play Description": "string"},
}


def sections(parsed: DataFrame, key: str, firsts: tuple[str, ...]) -> DataFrame:
    """Rows of tables below a header whose first cell is one of ``firsts``: key, row, section, values (header -> cell)."""
    rows = parsed.select(key, F.posexplode("cells").alias("row", "c"))
    is_head = F.lower(F.col("c")[0]).isin(*(f.lower() for f in firsts))
    before = W.partitionBy(key).orderBy("row").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"_head": F.last(F.when(is_head, F.col("c")), ignorenulls=True).over(before), "_is": is_head})
    rows = rows.where(F.col("_head").isNotNull() & ~F.col("_is") & (F.size("c") == F.size("_head")))
    values = F.map_from_entries(F.arrays_zip(F.transform("_head", F.lower), F.col("c")))
    return rows.select(key, "row", F.col("_head")[0].alias("section"), values.alias("values"))


def typed(rows: DataFrame, kinds: Mapping[str, str], defaults: Mapping[str, str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The values of rows as columns; empty ones are null or the default."""
    value = lambda n: F.nullif(F.try_element_at("values", F.lit(n.lower())), F.lit(""))
    get = lambda n: F.coalesce(value(n), F.lit(defaults[n])) if defaults and n in defaults else value(n)
    return rows.select(*keep, *(get(n).try_cast(kind).alias(n) for n, kind in kinds.items()))


def pitch_table(pages: DataFrame, key: str, column: str) -> DataFrame:
    """A row for each pitch of a pitch table, typed; ``row`` is its place on the page."""
    parsed = html.parse_pages(pages, key, column)
    return typed(sections(parsed, key, ("park_sv_id",)), PITCH_COLUMNS, PITCH_DEFAULTS, (key, "row"))


def pitch_log(pages: DataFrame, key: str, column: str) -> DataFrame:
    """One row for each pitcher's log: game, pitcher, address of the pitch table, pitches by inning and in all."""
    parsed = html.parse_pages(pages, key, column)
    counts = typed(sections(parsed, key, ("Inning",)), {"Inning": "int", "Pitches": "int"}, None, (key,))
    counts = counts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("Inning", "Pitches")))).alias("pitch_count_by_inning"), F.sum("Pitches").cast("long").alias("total_pitch_count"))
    link = F.try_element_at(F.filter("links", lambda x: x.contains("pitchSel=")), F.lit(1))
    heads = parsed.select(key, F.col("title").alias("pitcher_name"), link.alias("pitchfx_url"))
    heads = heads.withColumns({"bb_game_id": html.query_parameter(F.col("pitchfx_url"), "game"), "pitcher_id_mlb": html.query_parameter(F.col("pitchfx_url"), "pitchSel").try_cast("long")})
    return heads.join(counts, key, "left")


def games_of_day(pages: DataFrame, key: str, column: str, day: str) -> DataFrame:
    """A row for each box score that a day's page links to (all-star games left out); ``right_day`` is false if the page is another day's."""
    parsed = html.parse_pages(pages, key, column).join(pages.select(key, day), key)
    links = parsed.select(key, day, F.posexplode(F.filter("links", lambda x: x.rlike(r"/boxes/") & ~x.contains("allstar"))).alias("place", "url"))
    links = links.withColumn("game_id", F.regexp_extract("url", r"([A-Z]{3}[0-9]{9})\.s?html", 1)).where("game_id <> ''")
    return links.withColumn("right_day", X.parse_game_id(F.col("game_id"))["day"] == F.col(day).cast("date"))


def appearances_of_day(pages: DataFrame, key: str, column: str) -> DataFrame:
    """Per game of a dashboard: its id, and the pitchers (id -> address of the log) that have one."""
    parsed = html.parse_pages(pages, key, column)
    links = parsed.select(key, F.explode("links").alias("url"))
    links = links.withColumns({"bb_game_id": html.query_parameter(F.col("url"), "game"), "pitcher": html.query_parameter(F.col("url"), "pitchSel")}).where("bb_game_id IS NOT NULL")
    pairs = links.groupBy(key, "bb_game_id", "pitcher").agg(F.min("url").alias("url"))
    some = F.col("pitcher").isNotNull()
    return pairs.groupBy(key, "bb_game_id").agg(F.count(F.when(some, 1)).alias("pitcher_appearance_count"), F.map_from_entries(F.array_sort(F.collect_list(F.when(some, F.struct("pitcher", "url"))))).alias("pitcher_appearances"))


def box_score(pages: DataFrame, key: str, column: str) -> dict[str, DataFrame]:
    """Batting lines, pitching lines and plays of box score pages, typed."""
    rows = sections(html.parse_pages(pages, key, column), key, tuple(BOX_SECTIONS))
    clean = lambda n: n.lower().replace(" ", "_").replace("/", "_").replace("(", "_").replace(")", "")
    out = {}
    for name, kinds in BOX_SECTIONS.items():
        one = typed(rows.where(F.lower("section") == name.lower()), kinds, None, (key, "row"))
        out[name] = one.withColumnsRenamed({n: clean(n) for n in kinds})
    return out


def html_table(rows: Column) -> Column:
    """A table of an array of arrays of cells."""
    cells = F.transform(rows, lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), F.coalesce(c, F.lit("")), F.lit("</td>"))), ""), F.lit("</tr>")))
    return F.concat(F.lit("<table>"), F.array_join(cells, ""), F.lit("</table>"))
