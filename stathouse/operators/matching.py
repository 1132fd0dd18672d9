"""Joins: surrogate keys, kept and missing rows, theta matches, range lookups, intervals, nearest rows, fuzzy names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expressions import similarity


def with_keys(facts: DataFrame, lookups: list[tuple[DataFrame, list[str], str, str]]) -> DataFrame:
    """Surrogate keys by natural ones: for each (dimension, natural key, id column, new name), a left join."""
    for dimension, natural, key, name in lookups:
        facts = facts.join(dimension.select(*natural, F.col(key).alias(name)), natural, "left")
    return facts


def unresolved(facts: DataFrame, names: list[str]) -> DataFrame:
    """Rows that found no key for one of the names."""
    return facts.where(" OR ".join(f"{n} IS NULL" for n in names))


def keep_with_children(parents: DataFrame, children: DataFrame, on: list[str], child: Column, order: Column, name: str = "children") -> DataFrame:
    """Every parent with its children as an ordered array, which may be empty.

    Children are gathered before the join; ``order`` and ``child`` are columns of ``children``.
    """
    lists = children.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(order.alias("_o"), child.alias("_c")))).alias("_l"))
    out = parents.join(lists, on, "left")
    values = F.transform(F.coalesce("_l", F.expr("filter(_l, x -> false)")), lambda x: x["_c"])
    return out.withColumn(name, F.coalesce(values, F.array())).drop("_l")


def only_left(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    return left.join(right, on, "left_anti")


def both_or_either(left: DataFrame, right: DataFrame, on: list[str], side: str = "side") -> DataFrame:
    """Full outer join that says where a row comes from."""
    a, b = left.withColumn("_a", F.lit(True)), right.withColumn("_b", F.lit(True))
    where = F.when(F.col("_b").isNull(), "left").when(F.col("_a").isNull(), "right").otherwise("both")
    return a.join(b, on, "full_outer").withColumn(side, where).drop("_a", "_b")


def theta_matches(left: DataFrame, right: DataFrame, equal: list[str], either: list[str], row: str, other: str, extra: Column | None = None) -> DataFrame:
    """Pairs that agree on ``equal`` and on at least one of ``either``.

    One equi join for each of ``either``, so no pair is formed that agrees on
    none; a pair that agrees on several counts once.  ``right`` must bear the
    names of ``left`` but for ``row`` and ``other``.
    """
    out = None
    for column in either:
        pairs = left.select(*equal, column, row).join(right.select(*equal, column, other), [*equal, column]).select(row, other)
        out = pairs if out is None else out.unionByName(pairs)
    out = out.distinct()
    return out.where(extra) if extra is not None else out


def unique_matches(pairs: DataFrame, row: str) -> DataFrame:
    """Pairs of rows that have one match only."""
    n = F.count(F.lit(1)).over(W.partitionBy(row))
    return pairs.withColumn("_n", n).where("_n = 1").drop("_n")


def sole_later_match(rows: DataFrame, equal: list[str], either: list[str], row: str, other: str) -> DataFrame:
    """(row, other): rows with one later row (a greater ``row``, which is unique) that agrees on ``equal`` and on at least one of ``either``.

    No pairs are formed, so a large group costs no more than its rows: a row
    with one match is among the last two of each of its groups, and these are
    cut before they are shuffled.  Such a row qualifies if all the groups that
    offer it a partner offer the same one.  Nulls agree with nothing.
    """
    known = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in equal))
    groups = sum((F.col(c).isNotNull().cast("int") for c in either), F.lit(0))
    met = None
    for column in either:
        order = W.partitionBy(*equal, column).orderBy(F.desc(row))
        last = known.where(F.col(column).isNotNull()).select(*equal, column, row, groups.alias("_groups"), F.row_number().over(order).alias("_n")).where("_n <= 2")
        offers = last.select(row, "_groups", F.lag(row).over(order).alias("_other"))
        met = offers if met is None else met.unionByName(offers)
    seen = met.groupBy(row).agg(F.count(F.lit(1)).alias("_n"), F.max("_groups").alias("_groups"), F.min("_other").alias(other), F.max("_other").alias("_high"))
    return seen.where(f"_n = _groups AND {other} = _high").select(row, other)


def percentile_of(values: DataFrame, steps: DataFrame, on: list[str], value: str, limit: str, percentile: str, lower_is_better: bool = False, default: float = 100.0) -> DataFrame:
    """The first step whose limit reaches the value; ``default`` beyond the last.

    Steps are gathered per key as one sorted array (they are as many as
    percentiles), so each value meets one row, not one for each step.
    """
    lists = steps.groupBy(*on).agg(F.sort_array(F.collect_list(F.struct(F.col(percentile).alias("p"), F.col(limit).alias("v")))).alias("_steps"))
    reach = (lambda s: s["v"] <= F.col(value)) if lower_is_better else (lambda s: s["v"] >= F.col(value))
    first = F.try_element_at(F.filter("_steps", reach), F.lit(1))["p"]
    return values.join(lists, on, "left").withColumn(percentile, F.coalesce(first, F.lit(default))).drop("_steps")


def inside_intervals(points: DataFrame, intervals: DataFrame, on: list[str], at: str, lo: str, hi: str, cell: int) -> DataFrame:
    """Points strictly inside an interval of their key.

    Intervals are cut into cells of ``cell`` units, so that the join is on
    equal cells and a long interval doesn't meet every point of its key.
    """
    cells = intervals.withColumn("_cell", F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))))
    return points.withColumn("_cell", F.floor(F.col(at) / cell)).join(cells, [*on, "_cell"]).where((F.col(at) > F.col(lo)) & (F.col(at) < F.col(hi))).drop("_cell")


def since_last_start(rows: DataFrame, on: list[str], at: str, starts: Column, opened: str, cell: int = 65_536) -> DataFrame:
    """Rows strictly inside the intervals that the ``starts`` of their key open, each until the next one; ``opened`` is where theirs began.

    Such intervals never overlap, so no pairs are needed: the latest start is
    carried along within cells of ``cell`` units, and each cell gets the last
    start of the cells before it.  A key with very many rows is thus many
    groups.  Nulls in ``on`` or ``at`` are in no interval.
    """
    begin = F.when(starts, F.col(at))
    cut = rows.where(" AND ".join(f"{c} IS NOT NULL" for c in [*on, at])).withColumn("_cell", F.floor(F.col(at) / cell))
    before = W.partitionBy(*on).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cut.groupBy(*on, "_cell").agg(F.max(begin).alias("_last")).select(*on, "_cell", F.max("_last").over(before).alias("_before"))
    own = F.max(begin).over(W.partitionBy(*on, "_cell").orderBy(at))
    out = cut.withColumn("_own", own).join(cells, [*on, "_cell"]).withColumn(opened, F.coalesce("_own", "_before"))
    return out.where(F.col(at) > F.col(opened)).drop("_cell", "_own", "_before")


def nearest(left: DataFrame, right: DataFrame, on: list[str], distance: Column, row: str, value: str, tie: str) -> DataFrame:
    """For each row, the value of the right row that is nearest; ties to the least ``tie``."""
    met = left.join(right, on)
    return met.groupBy(*on, row).agg(F.min_by(value, F.struct(distance, F.col(tie))).alias(value))


def fuzzy_top(queries: DataFrame, choices: DataFrame, query: str, choice: str, block: Column | None, block_choice: Column | None, k: int = 10, cutoff: float = 0.0, most: int = 50_000) -> DataFrame:
    """The k most similar choices of each query that share its block; ties by name.

    Without blocks each query meets every choice.  Up to ``most`` choices (a
    list of names) are broadcast; more are dealt into parts, and the k best of
    each part are merged.
    """
    parts = 1
    if block is None:
        parts = max(1, -(-choices.count() // most))
        if parts == 1:
            met = queries.join(F.broadcast(choices))
        else:
            part = F.pmod(F.xxhash64(choice), F.lit(parts)).cast("int")
            met = queries.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).join(choices.withColumn("_b", part), "_b")
    else:
        met = queries.withColumn("_b", block).join(choices.withColumn("_b", block_choice), "_b").drop("_b")
    scored = met.withColumn("score", similarity(F.col(query), F.col(choice))).where(F.col("score") >= cutoff)
    best = [F.desc("score"), F.col(choice)]
    if parts > 1:
        scored = scored.withColumn("_n", F.row_number().over(W.partitionBy(query, "_b").orderBy(*best))).where(F.col("_n") <= k).drop("_n", "_b")
    order = W.partitionBy(query).orderBy(*best)
    return scored.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
