"""Nested JSON documents: schemas, reading, nesting and unnesting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One pitch appearance's log: what is read of it.  Class tags of a document are ignored.
_PITCH = (
    "pitch_app_id: string, pitcher_id: int, batter_id: int, bbref_game_id: string, park_sv_id: string, ab_id: int, ab_count: int, ab_total: int, "
    "id: int, inning: int, des: string, type: string, pdes: string, mlbam_pitch_name: string, stand: string, p_throws: string, strikes: int, "
    "balls: int, zone_location: int, start_speed: double, px: double, pz: double, spin_rate: int, launch_speed: double, launch_angle: double, "
    "time_pitch_thrown_str: string, has_zone_location: boolean"
)
PITCH_LOG = (
    "pitcher_name string, pitcher_id_mlb int, pitch_app_id string, total_pitch_count int, pitch_count_by_inning map<string,int>, "
    f"bbref_game_id string, pitchfx_log array<struct<{_PITCH}>>"
)
GAMES_FOR_DATE = "dashboard_url string, game_count int, game_date_str string, games array<struct<bbref_game_id: string, url: string>>"


def read_documents(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """One row for each file; what doesn't parse is kept in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt").json(paths).withColumn("_path", F.input_file_name())


def read_first(spark: SparkSession, folders: list[str], name: str, schema: str) -> DataFrame | None:
    """The document from the first folder that has it; None if no folder does."""
    hadoop, jvm = spark._jsc.hadoopConfiguration(), spark._jvm
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
        if path.getFileSystem(hadoop).exists(path):
            return read_documents(spark, [f"{folder}/{name}"], schema)
    return None


def listed_ids(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Ids of the files of a folder whose name fits a pattern; contents aren't read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    return names.withColumn("id", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)).where(F.col("id").rlike(pattern))


def pitches_of(logs: DataFrame) -> DataFrame:
    """A row for each pitch of the logs."""
    return logs.select(F.explode("pitchfx_log").alias("p")).select("p.*")


def nest(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """One document for each key, its rows as a sorted array."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, *rest))).alias(name))


def unnest(nested: DataFrame, keys: list[str], name: str) -> DataFrame:
    return nested.select(*keys, F.explode(name).alias("_r")).select(*keys, "_r.*")


def schema_of(df: DataFrame) -> T.StructType:
    return df.schema


def to_text(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def from_text(df: DataFrame, column: str, schema: T.StructType) -> DataFrame:
    return df.select(F.from_json(column, schema).alias("_d")).select("_d.*")
