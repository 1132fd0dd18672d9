"""Tables of the driver, and shared column definitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a time in microseconds (us), in UTC."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros("ts"))


def day(column: str) -> Column:
    return F.col(column).cast("date")


#: Flags of a pitch as expressions over lineitem, in SQL that both engines read.
FLAGS = {
    "has_zone_location": "l_linenumber <= 6",
    "batter_did_swing": "CAST(l_quantity AS INT) % 2 = 1",
    "batter_made_contact": "CAST(l_quantity AS INT) % 4 = 1",
    "called_strike": "CAST(l_quantity AS INT) % 4 = 2",
    "swinging_strike": "CAST(l_quantity AS INT) % 4 = 3",
    "inside_strike_zone": "l_discount > 0.045",
    "outside_strike_zone": "NOT (l_discount > 0.045)",
    "swing_inside_zone": "CAST(l_quantity AS INT) % 2 = 1 AND l_discount > 0.045",
    "swing_outside_zone": "CAST(l_quantity AS INT) % 2 = 1 AND NOT (l_discount > 0.045)",
    "contact_inside_zone": "CAST(l_quantity AS INT) % 4 = 1 AND l_discount > 0.045",
    "contact_outside_zone": "CAST(l_quantity AS INT) % 4 = 1 AND NOT (l_discount > 0.045)",
    "is_in_play": "CAST(l_quantity AS INT) % 4 = 1 AND l_linestatus = 'F'",
    "is_ground_ball": "CAST(l_quantity AS INT) % 4 = 1 AND l_linestatus = 'F' AND l_partkey % 4 = 0",
    "is_fly_ball": "CAST(l_quantity AS INT) % 4 = 1 AND l_linestatus = 'F' AND l_partkey % 4 = 1",
    "is_line_drive": "CAST(l_quantity AS INT) % 4 = 1 AND l_linestatus = 'F' AND l_partkey % 4 = 2",
    "is_popup": "CAST(l_quantity AS INT) % 4 = 1 AND l_linestatus = 'F' AND l_partkey % 4 = 3",
    "is_hard_hit": "CAST(l_quantity AS INT) % 4 = 1 AND l_linestatus = 'F' AND l_tax > 0.05",
    "is_medium_hit": "CAST(l_quantity AS INT) % 4 = 1 AND l_linestatus = 'F' AND l_tax <= 0.05 AND l_tax > 0.02",
    "is_soft_hit": "CAST(l_quantity AS INT) % 4 = 1 AND l_linestatus = 'F' AND l_tax <= 0.02",
    "is_barreled": "CAST(l_quantity AS INT) % 4 = 1 AND l_linestatus = 'F' AND l_tax > 0.07",
    "is_final_pitch_of_ab": "l_linenumber % 3 = 1",
    "ab_result_out": "l_linenumber % 3 = 1 AND l_partkey % 10 < 5",
    "ab_result_hit": "l_linenumber % 3 = 1 AND l_partkey % 10 IN (5, 6)",
    "ab_result_single": "l_linenumber % 3 = 1 AND l_partkey % 10 = 5",
    "ab_result_double": "l_linenumber % 3 = 1 AND l_partkey % 20 = 6",
    "ab_result_triple": "l_linenumber % 3 = 1 AND l_partkey % 40 = 16",
    "ab_result_homerun": "l_linenumber % 3 = 1 AND l_partkey % 40 = 36",
    "ab_result_bb": "l_linenumber % 3 = 1 AND l_partkey % 10 = 7",
    "ab_result_ibb": "l_linenumber % 3 = 1 AND l_partkey % 100 = 7",
    "ab_result_k": "l_linenumber % 3 = 1 AND l_partkey % 10 < 2",
    "ab_result_hbp": "l_linenumber % 3 = 1 AND l_partkey % 10 = 8",
    "ab_result_error": "l_linenumber % 3 = 1 AND l_partkey % 10 = 9",
    "ab_result_sac_hit": "l_linenumber % 3 = 1 AND l_partkey % 50 = 3",
    "ab_result_sac_fly": "l_linenumber % 3 = 1 AND l_partkey % 50 = 4",
}


def flags() -> dict[str, Column]:
    return {name: F.when(F.expr(sql), 1).otherwise(0) for name, sql in FLAGS.items()}


def flag_sql() -> str:
    """The same flags for the other engine."""
    return ",\n  ".join(f"CASE WHEN {sql} THEN 1 ELSE 0 END AS {name}" for name, sql in FLAGS.items())


class Registry:
    """Queries and their SQL by name."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None):
        def keep(f):
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return keep
