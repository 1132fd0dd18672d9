"""Completeness: sums over children, predicates on them, descriptions and merges."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expressions import safe_ratio


def rolled_up(parent: DataFrame, children: DataFrame, on: list[str], keys: list[str], sums: Mapping[str, Column], count: str = "total") -> DataFrame:
    """Inner join of parents with their children, then a count and sums per ``keys``."""
    joined = parent.join(children, on)
    return joined.groupBy(*keys).agg(F.count(F.lit(1)).alias(count), *(F.sum(v.cast("long")).alias(k) for k, v in sums.items()))


def with_defaults(parent: DataFrame, summed: DataFrame, on: list[str]) -> DataFrame:
    """Parents with the sums of their children, 0 where there are none."""
    return parent.join(summed, on, "left").na.fill(0, [c for c in summed.columns if c not in on])


def any_and_all(children: DataFrame, by: list[str], conditions: Mapping[str, Column]) -> DataFrame:
    """Whether any, and whether all children meet each condition."""
    out = []
    for name, condition in conditions.items():
        out += [F.bool_or(condition).alias(f"any_{name}"), F.bool_and(condition).alias(f"all_{name}")]
    return children.groupBy(*by).agg(*out)


def id_lists(df: DataFrame, by: list[str], key: str, conditions: Mapping[str, Column]) -> DataFrame:
    """Sorted ids that meet each condition, in one pass; empty lists where none does."""
    return df.groupBy(*by).agg(*(F.array_sort(F.collect_set(F.when(c, F.col(key)))).alias(name) for name, c in conditions.items()))


def percent_complete(done: Column, total: Column) -> Column:
    return safe_ratio(done, total)


def described(steps: list[tuple[Column, str]], otherwise: str) -> Column:
    """The text of the first condition that holds."""
    out = F
    for condition, text in steps:
        out = out.when(condition, text)
    return out.otherwise(otherwise)


def event_audit(df: DataFrame, by: list[str], at_bat: str, row: str, sums: Mapping[str, Column], conditions: Mapping[str, Column]) -> DataFrame:
    """Sums, whether any row errs, and for each condition the number of different at-bats and their ids in order of row."""
    out = [F.sum(v.cast("long")).alias(k) for k, v in sums.items()]
    for name, condition in conditions.items():
        ids = F.array_distinct(F.transform(F.array_sort(F.collect_set(F.when(condition, F.struct(F.col(row).alias("r"), F.col(at_bat).alias("i"))))), lambda x: x["i"]))
        out += [F.bool_or(condition).alias(f"any_{name}"), F.count_distinct(F.when(condition, F.col(at_bat))).alias(f"{name}_count"), ids.alias(f"{name}_ids")]
    return df.groupBy(*by).agg(*out)


def counted_map(df: DataFrame, by: list[str], key: str, name: str, by_count: bool = False) -> DataFrame:
    """How often each key comes, as entries in order of key, or of count from the greatest."""
    counts = df.groupBy(*by, key).agg(F.count(F.lit(1)).alias("n"))
    row = F.struct((-F.col("n")).alias("o"), F.col(key).alias("k"), F.col("n").alias("n")) if by_count else F.struct(F.lit(0).alias("o"), F.col(key).alias("k"), F.col("n").alias("n"))
    return counts.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(row)), lambda x: F.struct(x["k"].alias("key"), x["n"].alias("count"))).alias(name))


def merged_status(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Upsert: known keys take the new values that aren't null, unknown keys are added."""
    values = [c for c in new.columns if c not in key]
    renamed = new.select(*key, *(F.col(c).alias(f"_n_{c}") for c in values))
    joined = old.join(renamed, key, "full_outer")
    kept = [F.coalesce(f"_n_{c}", c).alias(c) if c in values else F.col(c) for c in old.columns if c not in key]
    return joined.select(*key, *kept)
