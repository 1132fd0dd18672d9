"""Operator 3: mixing sources to target weights with a splitting tree, in SQL functions only.

1. Every document's size is its number of words.  A source's share of the
   budget follows its weight; no source gets more than ``max_passes`` times
   its words, and what it can't take is dealt to the others by weight.
2. A hash of (seed, document) is the document's place in a random
   permutation of its source.  Equal cuts of the hash space are the source's
   blocks.  A target of 1.3 times the words means one whole pass and the
   first blocks of the permutation for the other 0.3; where the quota ends
   is found by counting words in 4,096 cells, three times, each time inside
   one cell of the last (no sort, no window over documents).
3. The blocks drawn from all sources are split among output shards by a
   binary tree: at each node the left half gets a multivariate
   hypergeometric number of blocks of each source, so that quotas stay exact
   and each shard is a random sample without replacement of all draws.
   Shards own disjoint ranges of a source's drawn blocks; inside a shard
   rows are shuffled by another hash.

The document at which a quota ends is taken in part (or, with
``whole=True``, wholly if at least half of it is due); identical rows there
share the rest.  Null and empty texts have size 0 and are never taken; a null
source is a source, last in order.  Repeated rows are drawn alike.  An empty
table gives an empty mix.  The same seed gives the same mix anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, join_small, materialize, parts_for
from .quality_rules import n_words_of

WEIGHTS = (3, 1, 2)
_DIGIT = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, max_passes: int = 2) -> DataFrame:
    """One row per source: _src (its number in code-point order, null last), source_size, target.

    A source is capped where its cap over its weight is at most the level at
    which the others share the rest; sorted by that ratio, the capped ones
    come first, so running sums find the level.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = W.orderBy(F.col("source").asc_nulls_last())  # a row for each source
    per = per.withColumn("_src", F.row_number().over(every) - 1)
    per = per.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod("_src", F.lit(len(weights))).cast("int") + 1))
    per = per.withColumn("_cap", F.lit(float(max_passes)) * F.col("source_size"))
    by_ratio = W.orderBy(F.col("_cap") / F.col("_weight"), "_src")
    before, here_on, whole = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing), W.partitionBy()
    per = per.withColumn("_level", (F.lit(budget) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(here_on))
    open_level = F.min(F.when(F.col("_cap") > F.col("_weight") * F.col("_level"), F.struct(F.col("_cap") / F.col("_weight"), "_src", "_level"))).over(whole)
    per = per.withColumn("_open", open_level["_level"])
    target = F.when(F.col("_open").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_weight") * F.col("_open")))
    return per.select("source", "_src", "source_size", target.cast("double").alias("target"))


def _quota_end(keyed: DataFrame, sources: DataFrame) -> DataFrame:
    """sources with _end (the 36-bit place at which the last, partial pass ends), _left (words due there) and _there (words that lie there)."""
    found = sources.withColumns({"_end": F.lit(0).cast("long"), "_left": F.col("_quota"), "_there": F.lit(0).cast("long")})
    for level in range(3):
        shift = 24 - 12 * level
        within = join_small(keyed, found.select("_src", F.col("_end").alias("_prefix")), ["_src"], spread="_place")
        if level:
            within = within.where(F.shiftright("_place", shift + 12) == F.col("_prefix"))
        cells = within.groupBy("_src", F.shiftright("_place", shift).alias("_cell")).agg(F.sum("size").alias("_words"))
        upto = W.partitionBy("_src").orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)  # 4,096 rows at most
        cells = cells.withColumn("_before", F.coalesce(F.sum("_words").over(upto), F.lit(0)))
        ends = join_small(cells, found.select("_src", F.col("_left").alias("_due")), ["_src"], spread="_cell")
        last = F.max(F.when(F.col("_before") <= F.col("_due"), F.struct("_cell", "_before", "_words")))
        ends = ends.where(F.col("_words") > 0).groupBy("_src").agg(last.alias("_at"))
        found = found.drop("_there").join(ends, "_src", "left").select(
            "source", "_src", "source_size", "target", "_passes", "_quota",
            F.coalesce(F.col("_at._cell"), F.lit(0)).cast("long").alias("_end"),
            (F.col("_left") - F.coalesce(F.col("_at._before"), F.lit(0))).alias("_left"),
            F.coalesce(F.col("_at._words"), F.lit(0)).cast("long").alias("_there"),
        )
        found = materialize(found, "quota")
    return found


#: One hypergeometric draw x of (n drawn, k of this source, m in all) by inversion of u: weights by recurrence over
#: nine standard deviations on either side of the mean, outside of which less than 1e-18 of the mass lies.
_DRAW = """
CASE WHEN least(k, n) <= greatest(0L, n + k - m) THEN least(k, n) ELSE
  aggregate(
    sequence(b.lo, b.hi),
    struct(b.lo AS x, 1.0D AS w, 0.0D AS c),
    (t, i) -> CASE WHEN t.c < u * b.total THEN struct(i AS x, CASE WHEN i < b.hi THEN t.w * ({ratio}) ELSE 0.0D END AS w, t.c + t.w AS c) ELSE t END,
    t -> t.x) END
"""
_RATIO = "(k - i) * 1.0D * (n - i) / ((i + 1) * 1.0D * (m - k - n + i + 1))"


def _split_level(nodes: DataFrame, level: int, seed: int) -> DataFrame:
    """Each node (lo, hi, q) gives two children; the left one's blocks are hypergeometric draws, source after source."""
    mean, spread = "(n * 1.0D * k / m)", "(9 * sqrt(n * 1.0D * k / m * (m - k) / m * (m - n) / greatest(m - 1, 1)) + 9)"
    low = f"greatest(greatest(0L, n + k - m), CAST(floor({mean} - {spread}) AS BIGINT))"
    high = f"least(least(k, n), CAST(ceil({mean} + {spread}) AS BIGINT))"

    def bind(body: str, **names: str) -> str:
        """Named values by one-element arrays: SQL has no let."""
        for name, value in reversed(names.items()):
            body = f"transform(array({value}), {name} -> {body})[0]"
        return body

    total = f"aggregate(sequence(r.lo, r.hi), struct(1.0D AS w, 0.0D AS c), (t, i) -> struct(CASE WHEN i < r.hi THEN t.w * ({_RATIO}) ELSE 0.0D END AS w, t.c + t.w AS c), t -> t.c)"
    one = bind(
        _DRAW.format(ratio=_RATIO), k="q[s]", n="a.n", m="a.total",
        r=f"struct({low} AS lo, greatest({low}, {high}) AS hi)", b=f"struct(r.lo AS lo, r.hi AS hi, {total} AS total)",
        u=f"(shiftrightunsigned(xxhash64({seed}, {level}, lo, hi, s), 11) / 9007199254740992.0D)",
    )
    one = f"CASE WHEN a.n <= 0 OR q[s] = 0 THEN 0L ELSE {one} END"
    step = bind("struct(a.n - x AS n, a.total - q[s] AS total, concat(a.xs, array(x)) AS xs)", x=one)
    whole = "aggregate(q, 0L, (x, y) -> x + y)"
    mid = "CAST((lo + hi) DIV 2 AS BIGINT)"
    nodes = nodes.withColumn("n_left", F.expr(f"CAST(({whole} * ({mid} - lo)) DIV (hi - lo) AS BIGINT)"))
    nodes = nodes.withColumn("left", F.expr(f"CASE WHEN hi - lo < 2 THEN q ELSE aggregate(sequence(0, size(q) - 1), struct(n_left AS n, {whole} AS total, CAST(array() AS ARRAY<BIGINT>) AS xs), (a, s) -> {step}, a -> a.xs) END"))
    children = F.expr(f"CASE WHEN hi - lo < 2 THEN array(struct(lo AS lo, hi AS hi, left AS q)) ELSE array(struct(lo AS lo, {mid} AS hi, left AS q), struct({mid} AS lo, hi AS hi, zip_with(q, left, (x, y) -> x - y) AS q)) END")
    return nodes.select(F.inline(children))


def splitting_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """quotas (_src, _draws) -> (_src, shard, _lo, _hi): the range of a source's draws that a shard owns."""
    one = quotas.agg(F.transform(F.array_sort(F.collect_list(F.struct("_src", "_draws"))), lambda x: x["_draws"]).alias("q"))
    nodes = one.where(F.size("q") > 0).select(F.lit(0).cast("long").alias("lo"), F.lit(shards).cast("long").alias("hi"), "q")
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        if level and level % 6 == 0:
            nodes = materialize(nodes.repartition("lo"), "tree")
        nodes = _split_level(nodes, level, seed)
    leaves = nodes.select(F.col("lo").alias("shard"), F.posexplode("q").alias("_src", "_got"))
    upto = W.partitionBy("_src").orderBy("shard")
    return leaves.withColumn("_hi", F.sum("_got").over(upto)).withColumn("_lo", F.col("_hi") - F.col("_got")).drop("_got")


def _placed(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with size (words) and _place (36 bits: where the row stands in its source's permutation)."""
    place = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 28)
    return docs.withColumns({"size": n_words_of(F.col("text")), "_place": place})


def _decide(docs: DataFrame, weights: tuple[int, ...], budget: float, max_passes: int, block_words: int, shard_words: int, seed: int, whole: bool) -> DataFrame:
    """``docs`` with size, source_size, target, draws.

    One pass over texts counts words; what is decided about sources, cells
    and blocks are small tables, joined to the rows of ``docs`` as they are
    read, so that texts are not shuffled.
    """
    sizes = materialize(_placed(docs, seed).select("doc_id", "source", "size", "_place"), "sizes")
    sources = source_targets(sizes, weights, budget, max_passes)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("_passes", passes.cast("long"))
    sources = materialize(sources.withColumn("_quota", (F.round("target") - F.col("_passes") * F.col("source_size")).cast("long")), "sources")
    null_key = lambda c: F.struct(F.col(c).isNull(), F.coalesce(F.col(c), F.lit("")))  # noqa: E731  null is a source
    numbered = materialize(sources.select(null_key("source").alias("_k"), "_src"), "numbers")
    with_number = lambda d: join_small(d.withColumn("_k", null_key("source")), numbered, ["_k"], spread="_place").drop("_k")
    keyed = with_number(sizes)
    ends = _quota_end(keyed.where(F.col("size") > 0), sources)
    block_of = lambda p: F.floor(p.cast("double") * F.col("_blocks") / float(1 << 36)).cast("long")
    ends = ends.withColumn("_blocks", F.greatest(F.lit(1), F.ceil(F.col("source_size") / block_words)).cast("long"))
    ends = ends.withColumn("_draws", F.col("_passes") * F.col("_blocks") + F.when(F.col("_quota") > 0, block_of(F.col("_end")) + 1).otherwise(0))
    total = sizes.agg(F.sum("size")).first()[0] or 0
    shards = max(8, math.ceil(budget * total / shard_words))
    ranges = splitting_tree(ends.select("_src", "_draws"), shards, seed)
    owner = ranges.where("_hi > _lo").select("_src", "shard", F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("_draw"))
    owner = materialize(owner, "owner")  # a row for each drawn block; a block is never hot
    owner_fits = owner.count() <= BROADCAST_ROWS
    rows = keyed if set(docs.columns) <= {"doc_id", "source", "text"} else with_number(_placed(docs, seed))
    df = join_small(rows, ends.select("_src", "source_size", "target", "_passes", "_end", "_left", "_there", "_blocks"), ["_src"], spread="_place")
    part = F.when(F.col("_there") > 0, (F.col("size") * F.col("_left")).cast("decimal(38,0)") / F.col("_there")).otherwise(0)
    rest = F.when(F.col("_place") < F.col("_end"), F.col("size")).when(F.col("_place") > F.col("_end"), 0)
    at_end = F.floor(part).cast("long") if not whole else F.when(2 * F.col("_left") >= F.col("_there"), F.col("size")).otherwise(0)
    df = df.withColumns({"_rest": rest.otherwise(at_end).cast("long"), "_block": block_of(F.col("_place"))})
    for n in range(max_passes):
        words = F.when(F.col("_passes") > n, F.col("size")).when(F.col("_passes") == n, F.col("_rest")).otherwise(0)
        df = df.withColumn(f"_words{n}", words).withColumn("_draw", F.when(F.col(f"_words{n}") > 0, F.lit(n) * F.col("_blocks") + F.col("_block")))
        mine = owner.withColumnRenamed("shard", f"_shard{n}")
        df = df.join(F.broadcast(mine) if owner_fits else mine, ["_src", "_draw"], "left").drop("_draw")
    draw = lambda n: F.struct(F.lit(n).alias("pass"), F.col(f"_shard{n}").alias("shard"), F.xxhash64(F.lit(seed + n + 1), "_place").alias("place"), F.col(f"_words{n}").alias("words"))
    return df.withColumn("draws", F.filter(F.array(*(F.when(F.col(f"_shard{n}").isNotNull(), draw(n)) for n in range(max_passes))), lambda x: x.isNotNull()))


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, max_passes: int = 2, block_words: int = 1 << 16, shard_words: int = 1 << 22, seed: int = 17, whole: bool = False) -> DataFrame:
    """doc_id, size, source_size, target, taken, and where the copies go: draws = array of (pass, shard, place, words)."""
    df = _decide(docs.select("doc_id", "source", "text"), weights, budget, max_passes, block_words, shard_words, seed, whole)
    taken = F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    return df.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "draws")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = 1.5, max_passes: int = 2, block_words: int = 1 << 16, shard_words: int = 1 << 22, seed: int = 17) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each time a document is drawn (whole documents), shards together and shuffled inside."""
    columns = docs.columns
    own = docs.select("doc_id", "source", "text", F.struct(*columns).alias("_row"))
    df = _decide(own, weights, budget, max_passes, block_words, shard_words, seed, True)
    rows = df.select("_row", F.explode("draws").alias("_draw"))
    return rows.repartition(parts_for(docs), "_draw.shard").sortWithinPartitions("_draw.shard", "_draw.place").select("_row.*")
