"""Ordered analytics: gaps, sessions, instances, stints, ranks, trimming, first and last."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def gaps(df: DataFrame, by: list[str], time: Column, order: list, name: str = "gap") -> DataFrame:
    """Whole seconds since the row before, within ``by``."""
    before = F.lag(time).over(W.partitionBy(*by).orderBy(*order))
    return df.withColumn(name, F.floor((time - before) / 1_000_000).cast("long"))


def gap_kind(df: DataFrame, group: list[str], inner: list[str], order: list, name: str = "kind") -> DataFrame:
    """Whether a row follows one of its own inner group, opens the inner group, or opens the group."""
    w_inner, w_group = W.partitionBy(*group, *inner).orderBy(*order), W.partitionBy(*group).orderBy(*order)
    first_in, first = F.row_number().over(w_inner) == 1, F.row_number().over(w_group) == 1
    return df.withColumn(name, F.when(first, "first").when(first_in, "across").otherwise("within"))


def sessions(df: DataFrame, by: list[str], order: list, closes: Column, name: str = "session") -> DataFrame:
    """A running number that grows after each row that closes its session."""
    upto = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(closes.cast("int")).over(upto), F.lit(0)).cast("long"))


def instances(df: DataFrame, key: list[str], order: list, name: str = "instance") -> DataFrame:
    """0, 1, 2, ... of a repeated key, in order."""
    return df.withColumn(name, (F.row_number().over(W.partitionBy(*key).orderBy(*order)) - 1).cast("int"))


def instance_of_value(df: DataFrame, key: list[str], value: str, name: str = "instance") -> DataFrame:
    """The rank, from 0, of a value among the different values of its key."""
    return df.withColumn(name, (F.dense_rank().over(W.partitionBy(*key).orderBy(value)) - 1).cast("int"))


def stints(df: DataFrame, who: list[str], where: str, when: str) -> DataFrame:
    """First and last day of who at where, and the stint's number by first day."""
    spans = df.groupBy(*who, where).agg(F.min(when).alias("first_day"), F.max(when).alias("last_day"))
    return spans.withColumn("stint", F.row_number().over(W.partitionBy(*who).orderBy("first_day", where)).cast("int"))


def ranked(df: DataFrame, by: list[str], order: list, name: str = "rank") -> DataFrame:
    """1, 2, 3, ... without ties; name a unique last column in ``order``."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("int"))


def top_k(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return ranked(df, by, order, name).where(F.col(name) <= k)


def value_counts(df: DataFrame, value: str) -> DataFrame:
    """Each value once, how often it comes, and how many rows come up to it.

    Values repeat far more than they differ in the samples this serves
    (whole seconds), so the running sum is over values, not over rows.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value)).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("upto", F.sum("n").over(W.orderBy(value).rowsBetween(W.unboundedPreceding, 0)))


def winsorized(df: DataFrame, value: str, limit: float = 0.01) -> DataFrame:
    """Statistics of a sample whose floor(limit * n) least and greatest values are moved to the next one inside."""
    counts = value_counts(df, value)
    size = counts.agg(F.sum("n").alias("size"))
    k = F.floor(F.col("size") * limit)
    placed = counts.join(F.broadcast(size))  # one row
    ends = placed.agg(F.min(F.when(F.col("upto") > k, F.col(value))).alias("lo"), F.min(F.when(F.col("upto") >= F.col("size") - k, F.col(value))).alias("hi"))
    moved = counts.join(F.broadcast(ends)).withColumn("v", F.least(F.greatest(value, "lo"), "hi"))  # one row
    return interval_statistics(moved, "v", "n")


def interval_statistics(df: DataFrame, value: str, times: str | None = None) -> DataFrame:
    """total, count, avg, max, min and range of a sample."""
    n = F.col(times) if times else F.lit(1)
    out = df.agg(F.sum(F.col(value) * n).cast("long").alias("total"), F.sum(n).cast("long").alias("count"), F.max(value).alias("maximum"), F.min(value).alias("minimum"))
    return out.withColumns({"average": F.col("total").cast("double") / F.col("count"), "range": F.col("maximum") - F.col("minimum")})


def trimmed(df: DataFrame, value: str, deviations: float = 2.0) -> DataFrame:
    """Rows within some sample standard deviations of the mean."""
    ends = df.agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"))
    inside = F.abs(F.col(value) - F.col("_m")) <= deviations * F.col("_s")
    return df.join(F.broadcast(ends)).where(inside).drop("_m", "_s")  # one row


def first_and_last(df: DataFrame, by: list[str], order: Column, value: str) -> DataFrame:
    """The values at the least and the greatest place, and the number of rows."""
    return df.groupBy(*by).agg(F.min_by(value, order).alias("first"), F.max_by(value, order).alias("last"), F.count(F.lit(1)).alias("n"))


def appearance_order(df: DataFrame, by: list[str], who: str, order: str) -> DataFrame:
    """Everyone's number by first row."""
    first = df.groupBy(*by, who).agg(F.min(order).alias("first_row"))
    return ranked(first, by, ["first_row", who], "number")


def latest(df: DataFrame, order: Column) -> DataFrame:
    """The one row with the greatest place."""
    row = F.max_by(F.struct(*df.columns), order).alias("_r")
    return df.agg(row).where("_r IS NOT NULL").select("_r.*")


def chunks(df: DataFrame, by: list[str], order: list, size: int, name: str = "chunk") -> DataFrame:
    """Numbers of pieces of ``size`` rows."""
    return df.withColumn(name, F.floor((F.row_number().over(W.partitionBy(*by).orderBy(*order)) - 1) / size).cast("int"))


def grouped_lists(df: DataFrame, by: list[str], row: Column, name: str = "rows", descending: bool = False) -> DataFrame:
    """Each group's rows as a sorted array."""
    return df.groupBy(*by).agg(F.sort_array(F.collect_list(row), not descending).alias(name))
