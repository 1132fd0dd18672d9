"""Streaming forms of batch plans: sessions, first-time loads, out-of-sequence rows, incremental imports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def new_files(spark: SparkSession, folder: str, schema, kind: str = "parquet", per_batch: int = 100) -> DataFrame:
    """Files that weren't read before; the checkpoint of the query remembers them."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(kind).load(folder)


def once_within(stream: DataFrame, time: str, key: list[str], late: str = "1 hour") -> DataFrame:
    """Rows whose key hasn't come within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def session_counts(stream: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions that end with a pause."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def window_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    out = stream.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("window.start").alias("start"), "n")


def flag_out_of_sequence(stream: DataFrame, key: str, number: str, row: str) -> DataFrame:
    """Whether a row's number comes after one at least as great of its key (state: the greatest so far)."""

    def step(keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        most = state.get[0] if state.exists else -1
        for rows in batches:
            out = []
            for r in rows.sort_values(row).itertuples():
                n = int(getattr(r, number))
                out.append((keys[0], int(getattr(r, row)), n <= most))
                most = max(most, n)
            yield pd.DataFrame(out, columns=[key, row, "out_of_sequence"])
        state.update((most,))

    kind = dict(stream.dtypes)[key]
    return stream.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {row} long, out_of_sequence boolean", "most long", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Writes what is there, then stops; a second run goes on from there."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
