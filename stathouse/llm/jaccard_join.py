r"""Operator 6: n-gram Jaccard join by partitioning the universe of shingles (pigeonhole), verified exactly.

A document's set is its distinct ``k``-word shingles, as 64-bit hashes
(lower-cased A-Z; the whole sequence if it has fewer words).  Two documents
link when 100 * |A & B| >= ``percent`` * |A | B|.

1. Classes.  Documents with equal sets share a fingerprint; only classes
   take part from here on.
2. Signatures.  Sets are dealt into size bands; a set takes part in its own
   band and, if a partner may be there, in the next one.  In a band, shingles
   are hashed into ``m`` segments; two linked sets differ in at most H
   shingles, so of the non-empty segments of either (those with a
   one-deletion neighbourhood counted twice) all but H are equal in both, or
   equal but for one shingle.  Empty segments are no signature.  ``m`` and the
   number of segments that get neighbourhoods are chosen per band for the
   least number of signatures that leaves every size enough of them.
3. Allocation by cost.  Signatures are counted.  In any one order of all
   signatures, the first H + 1 of two linked sets share one; the order is
   from rare to common, so a set leaves out as many of its most common ones as
   it has more than H + 1, and a set whose first H + 1 stand alone has no
   partner.  (Bands with neighbourhoods leave out none.)
4. Candidates.  Each class meets the class of its signature's group that
   shares most of itself, and verified links are contracted to components.
   In groups that still span components, the remaining pairs are compared by
   512-bit parities of their sets, whose differing bits are never more than
   the sets' differing shingles; pairs that this can't exclude are verified.
   Large groups are cut into blocks, so that no task holds one.  Sets with
   too few signatures (checked for each) are joined on single shingles.
5. Verification intersects whole sets.  Links are contracted by alternating
   large-star and small-star steps on distributed tables.

Null text and text without words is the empty set (n_shingles 0), linked
with nothing, its own component.  Rows of equal doc_id share a component if
their sets link; component ids are the least doc_id of a component, and a
null doc_id counts as the largest.  Repeated rows are one class.  An empty
table stays empty; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, flat_slices, map_batches, materialize, mix64, parts_for, rolling, task_of, word_reader

_LAST = (1 << 63) - 1
#: Bands grow by this factor.
GROWTH = 1.7
#: Classes of a block of a large group.
BLOCK = 1024
#: Distinct classes of a signature up to which they are counted; beyond, it is as common as can be.
COUNTED = 1 << 20
#: Words of a set's parity.
PARITY = 8


class Bands:
    """Sizes, segments and neighbourhoods of each band, for one threshold."""

    def __init__(self, percent: int):
        self.percent = percent
        low = [1]
        while low[-1] < 1 << 40:
            low.append(max(low[-1] + 1, math.floor(low[-1] * GROWTH) + 1))
        self.low = np.asarray(low)
        self.plan = lru_cache(maxsize=None)(self._plan)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, side="right") - 1

    def largest(self, n: np.ndarray) -> np.ndarray:
        """The largest partner of a set of n."""
        return n * 100 // self.percent

    def need(self, n: np.ndarray, band: np.ndarray) -> np.ndarray:
        """One more than the most shingles in which a set of n and a partner can differ, if the larger of the two is in the band."""
        other = np.maximum(n, np.minimum(self.largest(n), self.low[band + 1] - 1))
        return (n + other) * (100 - self.percent) // (100 + self.percent) + 1

    def _plan(self, band: int) -> tuple[int, int]:
        """(segments, how many of them get neighbourhoods): the fewest signatures with six standard deviations to spare."""
        top = int(self.low[band + 1]) - 1
        sizes = np.unique(np.linspace(max(1, self.low[band] * self.percent // 100), top, 24).astype(np.int64))
        need, n = self.need(sizes, np.full(len(sizes), band)).astype(float), sizes.astype(float)
        best, at = math.inf, (1, 1)
        for m in range(1, 4 * int(need.max()) + 4):
            empty, both = (1 - 1 / m) ** n, (1 - 2 / m) ** n if m > 1 else 0 * n
            sd = np.sqrt(np.maximum(m * empty + m * (m - 1) * both - (m * empty) ** 2, 0))
            full = m - m * empty
            for share in (0, 0.25, 0.5, 1) if need.max() <= 12 else (0,):
                doubled = math.ceil(share * m)
                spare = full * (1 + doubled / m) - need - 6 * sd * (1 + doubled / m) - (1 if need.max() > 12 else 0)
                if spare.min() >= 0 or m == 1 and doubled == 1 and need.max() <= 2:
                    cost = m + doubled * n.mean() / m
                    if cost < best:
                        best, at = cost, (m, doubled)
            if best < m:
                break
        return at if best < math.inf else (max(1, int(need.max())), max(1, int(need.max())))

    def _segments(self, flat: np.ndarray, size: np.ndarray, step: int) -> dict[str, np.ndarray]:
        """Segments of the sets (sorted hashes, end to end) that take part in their own band (``step`` 0) or the next one (1)."""
        band = self.of(np.maximum(size, 1)) + step
        need = self.need(size, band)
        part = (size > 0) & (need > 1)  # else partners are equal sets, which are one class
        if step:
            part &= self.largest(size) >= self.low[band]
        row = np.flatnonzero(part)
        plans = np.asarray([self.plan(int(b)) for b in band[row]], np.int64).reshape(-1, 2)
        s, own = flat[np.repeat(part, size)], np.repeat(np.arange(len(row)), size[row])
        segment = ((s >> np.uint64(32)) * plans[own, 0].astype(np.uint64) >> np.uint64(32)).astype(np.int64)  # sets are sorted, so segments are runs
        first = np.flatnonzero((np.diff(segment, prepend=-1) != 0) | (np.diff(own, prepend=-1) != 0))
        sizes, which, of = np.diff(first, append=len(s)), segment[first], own[first]
        # a one-shingle segment's neighbourhood is the empty set, which is no signature; it counts once
        twice = (which < plans[of, 1]) & (sizes > 1)
        return {"row": row, "band": band[row], "need": need[row], "doubled": plans[:, 1], "s": s, "first": first, "sizes": sizes, "which": which, "of": of, "twice": twice}

    def spares(self, flat: np.ndarray, size: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """How many signatures each set may leave out in its own and in the next band, and whether it has too few."""
        out, short = [], np.zeros(len(size), bool)
        for step in (0, 1):
            x, spare = self._segments(flat, size, step), np.zeros(len(size), np.int64)
            units = np.bincount(x["of"], weights=1 + x["twice"], minlength=len(x["row"])).astype(np.int64) - x["need"]
            short[x["row"]] |= units < 0
            spare[x["row"]] = np.where(x["doubled"] > 0, 0, np.maximum(units, 0))
            out.append(spare)
        return out, short

    def signatures(self, flat: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All signatures and the number of the set of each; the lowest bit tells the band."""
        sigs, rows = [], []
        with np.errstate(over="ignore"):
            for step in (0, 1):
                x = self._segments(flat, size, step)
                if not len(x["first"]):
                    continue
                band = x["band"][x["of"]].astype(np.uint64)
                run = np.repeat(np.arange(len(x["first"])), x["sizes"])
                token = mix64(x["s"] ^ (band * np.uint64(0x9E3779B97F4A7C15))[run])
                total = np.add.reduceat(token, x["first"])
                seed = mix64(x["which"].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + band)
                own = np.flatnonzero(x["twice"][run])
                at = np.concatenate([np.arange(len(x["first"])), run[own]])
                key = np.concatenate([total + seed, total[run[own]] - token[own] + seed[run[own]]])
                sigs.append((mix64(key) & ~np.uint64(1)) | (band[at] & np.uint64(1)))
                rows.append(x["row"][x["of"][at]])
        return (np.concatenate(sigs), np.concatenate(rows)) if sigs else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


@lru_cache(maxsize=4)
def bands(percent: int) -> Bands:
    return Bands(percent)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted shingle sets of the texts of a slice, end to end, and their sizes."""
    h, count = word_reader(True).read(data, offsets)
    at = np.cumsum(count) - count
    n = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    to = np.cumsum(n)
    of = np.repeat(np.arange(len(n)), n)
    start = at[of] + np.arange(len(of)) - (to - n)[of]
    flat = np.zeros(len(of), np.uint64)
    for width in range(1, k + 1):  # texts of fewer words are one shingle of all of them
        mine = np.flatnonzero((count[of] == width) if width < k else (count[of] >= k))
        if len(mine):
            flat[mine] = mix64(rolling(h, width) + np.uint64(width))[start[mine]]
    for lo, hi in zip((to - n).tolist(), to.tolist(), strict=True):
        if hi - lo > 1:
            flat[lo:hi].sort()
    keep = np.ones(len(flat), bool)
    keep[1:] = (np.diff(flat) != 0) | (np.diff(of) != 0)
    return flat[keep], np.bincount(of[keep], minlength=len(n))


def fingerprints(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """64 bits of each whole set; 0 for empty sets."""
    out, full = np.zeros(len(size), np.uint64), np.flatnonzero(size)
    if len(full):
        first = (np.cumsum(size) - size)[full]
        with np.errstate(over="ignore"):
            mixed = mix64(flat + np.uint64(0x632BE59BD9B4E019))
            out[full] = mix64(np.add.reduceat(mixed, first) ^ (np.bitwise_xor.reduceat(mix64(mixed), first) * size[full].astype(np.uint64)))
    return out.view(np.int64)


def parities(flat: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A row of PARITY words for each set: of 64 * PARITY cells, whether an odd number of shingles falls there.

    Two sets differ in at least as many shingles as their parities in bits.
    """
    cells = 64 * PARITY
    at = np.repeat(np.arange(len(size)), size) * cells + (flat & np.uint64(cells - 1)).astype(np.int64)
    odd = np.bincount(at, minlength=len(size) * cells) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(size), cells), axis=1).view(np.int64).reshape(len(size), PARITY)


def _members(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """_id, _same, n, fp (0 for empty sets), the spare of the set's own and next band, its own band's parity, and whether it lacks signatures."""

    @task_of("jaccard_join")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = bands(percent)
        for batch in batches:
            for lo, data, offsets in flat_slices(batch.column("text")):
                flat, size = shingle_sets(data, offsets, k)
                (own, later), short = plan.spares(flat, size)
                parity = plan.of(np.maximum(size, 1)) & 1
                columns = [batch.column("_id").slice(lo, len(size)), batch.column("_same").slice(lo, len(size)), pa.array(size), pa.array(fingerprints(flat, size)), pa.array(own), pa.array(later), pa.array(parity, pa.int32()), pa.array(short)]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_same", "n", "fp", "own", "next", "parity", "short"])

    return map_batches(docs, run, "_id long, _same long, n long, fp long, own long, next long, parity int, short boolean")


def _signatures(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """sig, fp: the signatures of each class, once for each task that reads it."""

    @task_of("jaccard_join")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, seen = bands(percent), np.zeros(0, np.int64)
        for batch in batches:
            for _, data, offsets in flat_slices(batch.column("text")):
                flat, size = shingle_sets(data, offsets, k)
                fp = fingerprints(flat, size)
                new, first = np.unique(fp, return_index=True)
                keep = np.zeros(len(size), bool)
                keep[first[~np.isin(new, seen)]] = True
                seen = new if len(seen) > 1 << 18 else np.union1d(seen, new)  # bounded; a class may then be sent twice
                sig, row = plan.signatures(flat[np.repeat(keep, size)], np.where(keep, size, 0))
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(fp[row])], names=["sig", "fp"])

    return map_batches(docs.select("text"), run, "sig long, fp long")


def _groups(signatures: DataFrame, parts: int) -> DataFrame:
    """sig, fp, freq: the signatures that two or more classes have, and how many have them; one pass over sorted rows."""

    @task_of("jaccard_join")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shared(sig: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            """Of whole runs."""
            first = np.flatnonzero(np.diff(sig, prepend=~sig[:1]) != 0)
            length = np.diff(first, append=len(sig))
            mixed = np.repeat(np.minimum.reduceat(fp, first) != np.maximum.reduceat(fp, first), length) if len(first) else np.zeros(0, bool)
            sig, fp = sig[mixed], fp[mixed]
            order = np.lexsort((fp, sig))
            sig, fp = sig[order], fp[order]
            new = np.ones(len(sig), bool)
            new[1:] = (np.diff(sig) != 0) | (np.diff(fp) != 0)
            sig, fp = sig[new], fp[new]
            first = np.flatnonzero(np.diff(sig, prepend=~sig[:1]) != 0)
            length = np.diff(first, append=len(sig))
            return made(sig, fp, np.repeat(length, length))

        def made(sig: np.ndarray, fp: np.ndarray, freq: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(fp), pa.array(freq.astype(np.int64))], names=["sig", "fp", "freq"])

        held = (np.zeros(0, np.int64), np.zeros(0, np.int64))
        hot = None  # a signature of more classes than are counted; it is passed on as it comes
        for batch in batches:
            sig, fp = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("sig", "fp"), strict=True))
            if not len(sig):
                continue
            if hot is not None:
                n = int((sig == hot).sum())
                yield made(sig[:n], fp[:n], np.full(n, _LAST))
                sig, fp = sig[n:], fp[n:]
                if not len(sig):
                    held = (sig, fp)
                    continue
                hot = None
            last = int(np.flatnonzero(np.diff(sig, prepend=~sig[:1]) != 0)[-1])
            if last:
                yield shared(sig[:last], fp[:last])
            sig, fp = sig[last:], fp[last:]
            if len(sig) > COUNTED:
                fp = np.unique(fp)
                sig = sig[: len(fp)]
                if len(fp) > COUNTED // 2:
                    hot = sig[0]
                    yield made(sig, fp, np.full(len(fp), _LAST))
                    sig, fp = sig[:0], fp[:0]
            held = (sig, fp)
        if len(held[0]):
            yield shared(*held)

    return map_batches(signatures.repartition(parts, "sig").sortWithinPartitions("sig"), run, "sig long, fp long, freq long")


def _kept(groups: DataFrame, classes: DataFrame) -> DataFrame:
    """sig, fp, n, known: without each class's most common signatures, as far as it can spare them; known is the share of a class that others have."""
    spare = F.when(F.col("sig").bitwiseAND(1).cast("int") == F.col("parity"), F.col("own")).otherwise(F.col("next"))
    common = W.partitionBy("fp", F.col("sig").bitwiseAND(1)).orderBy(F.desc("freq"), F.desc("sig"))
    rows = groups.join(classes.select("fp", "n", "own", "next", "parity"), "fp")
    rows = rows.withColumn("known", F.count("*").over(W.partitionBy("fp")) / F.col("n")).withColumn("_place", F.row_number().over(common))
    return rows.where(F.col("_place") > spare).select("sig", "fp", "n", "known")


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """fp, n, parity, s: the sets of the wanted classes (_id of one member, fp)."""

    @task_of("jaccard_join")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, data, offsets in flat_slices(batch.column("text")):
                flat, size = shingle_sets(data, offsets, k)
                asked = batch.column("fp").slice(lo, len(size)).to_numpy()
                right = fingerprints(flat, size) == asked  # another row may have the same doc_id
                flat, size = flat[np.repeat(right, size)], size[right]
                lists = lambda values, counts: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))
                parity = lists(parities(flat, size).ravel(), np.full(len(size), PARITY))
                yield pa.RecordBatch.from_arrays([pa.array(asked[right]), pa.array(size), parity, lists(flat.view(np.int64), size)], names=["fp", "n", "parity", "s"])

    few = wanted.count() <= BROADCAST_ROWS  # then texts needn't be shuffled
    chosen = docs.join(F.broadcast(wanted) if few else wanted, "_id").select("text", "fp")
    return map_batches(chosen, run, "fp long, n long, parity array<long>, s array<long>")


def _near(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sizes and parities allow a link."""
    about = lambda c: sets.select(F.col("fp").alias(c), F.col("n").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"))
    apart = sum((F.bit_count(F.element_at("p_a", i).bitwiseXOR(F.element_at("p_b", i))) for i in range(1, PARITY + 1)), F.lit(0))
    most = F.least(F.floor((F.col("n_a") + F.col("n_b") - apart) / 2), "n_a", "n_b")
    both = pairs.join(about("a"), "a").join(about("b"), "b")
    return both.where(100 * most >= percent * (F.col("n_a") + F.col("n_b") - most)).select("a", "b")


def _verify(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that link."""

    @task_of("jaccard_join")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            xv, xo = x.values.to_numpy(zero_copy_only=False).view(np.uint64), x.offsets.to_numpy()
            yv, yo = y.values.to_numpy(zero_copy_only=False).view(np.uint64), y.offsets.to_numpy()
            keep = []
            for i in range(batch.num_rows):
                p, q = xv[xo[i] : xo[i + 1]], yv[yo[i] : yo[i + 1]]
                at = np.searchsorted(p, q)
                both = int((p[np.minimum(at, len(p) - 1)] == q).sum())
                keep.append(100 * both >= percent * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    # the set of a class of several rows with equal doc_id may be there more than once
    x, y = sets.select(F.col("fp").alias("a"), F.col("s").alias("x")), sets.select(F.col("fp").alias("b"), F.col("s").alias("y"))
    if near.count() <= BROADCAST_ROWS:  # then only the sets of these pairs are shuffled
        x, near = x.join(F.broadcast(near.select("a").distinct()), "a"), F.broadcast(near)
    both = y.join(near, "b").join(x, "a").select("a", "b", "x", "y")
    return map_batches(both, run, "a long, b long")


def _is_forest(edges: DataFrame) -> bool:
    """Whether every node has one parent at most and no parent has one: then parents are roots."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """node, root of each node of the edges (a, b): large-star and small-star steps until every edge points at a root."""
    scratch = scratch or Scratch(edges.sparkSession)
    pair = lambda u, v: F.struct(F.col(u).alias("u"), F.col(v).alias("v"))
    edges = scratch.keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _is_forest(edges):
        both = edges.select(F.explode(F.array(pair("u", "v"), pair("v", "u"))).alias("e")).select("e.u", "e.v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(pair("v", "m"), pair("u", "m"))).alias("e")).select("e.u", "e.v")
        after = scratch.keep(small.where("u <> v").distinct(), "edges")
        scratch.drop(edges)
        edges = after
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _others(star: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, parts: int) -> DataFrame:
    """Pairs (a, b) of different components that share a signature and whose sizes and parities allow a link; star has sig, fp, size of the groups of three or more classes."""
    rows = star.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    open_ = rows.groupBy("sig").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select("sig")
    rows = rows.join(open_, "sig").join(sets.select("fp", "n", "parity").dropDuplicates(["fp"]), "fp")
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rows = rows.withColumn("block", F.pmod(F.xxhash64("fp"), blocks).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("sig", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "block", "fp", "root", "n", "parity")

    def compare(item: np.ndarray, block: np.ndarray, fp: np.ndarray, root: np.ndarray, n: np.ndarray, parity: np.ndarray, inside: np.ndarray) -> pa.RecordBatch:
        """Rows of whole items, each next to the others: all pairs of an item, by their distance."""
        first = np.flatnonzero(np.diff(item, prepend=~item[:1]) != 0)
        length = np.diff(first, append=len(item))
        left = np.repeat(first + length, length) - np.arange(len(item)) - 1  # rows of the item that follow
        a, b, d, i = [], [], 1, np.flatnonzero(left >= 1)
        while len(i):
            j = i + d
            may = (root[i] != root[j]) & (inside[i] | (block[i] != block[j])) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            p, q = i[may], j[may]
            apart = np.bitwise_count(parity[p] ^ parity[q]).sum(axis=1, dtype=np.int64)
            most = np.minimum((n[p] + n[q] - apart) // 2, np.minimum(n[p], n[q]))
            fine = 100 * most >= percent * (n[p] + n[q] - most)
            a.append(fp[p[fine]])
            b.append(fp[q[fine]])
            d += 1
            i = i[left[i] >= d]
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])

    @task_of("jaccard_join")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = {c: batch.column(c).to_numpy() for c in ("sig", "lo", "hi", "block", "fp", "root", "n")}
            got["parity"] = batch.column("parity").values.to_numpy(zero_copy_only=False)[batch.column("parity").offsets[0].as_py() :][: batch.num_rows * PARITY].view(np.uint64).reshape(-1, PARITY)
            got["item"] = mix64(got["sig"].view(np.uint64) + mix64((got["lo"].astype(np.uint64) << np.uint64(32)) + got["hi"].astype(np.uint64) + np.uint64(1)))
            if held:
                got = {c: np.concatenate([held[c], got[c]]) for c in got}
            last = int(np.flatnonzero(np.diff(got["item"], prepend=~got["item"][:1]) != 0)[-1])
            held = {c: v[last:] for c, v in got.items()}
            if last:
                whole = {c: v[:last] for c, v in got.items()}
                yield compare(*(whole[c] for c in ("item", "block", "fp", "root", "n", "parity")), whole["lo"] == whole["hi"])
        if held:
            yield compare(*(held[c] for c in ("item", "block", "fp", "root", "n", "parity")), held["lo"] == held["hi"])

    dealt = rows.repartition(parts, "sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")
    return map_batches(dealt, run, "a long, b long").distinct()


def _lacking(docs: DataFrame, classes: DataFrame, k: int, percent: int) -> DataFrame:
    """Candidate pairs of classes with too few signatures: they meet every class of a fitting size that shares a shingle."""
    few = classes.where("short")
    largest = few.agg(F.max("n")).first()[0]
    if largest is None:
        return classes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    theirs = _sets_of(docs, few.select("fp", "_id"), k).select(F.col("fp").alias("a"), F.explode("s").alias("shingle"))
    fitting = classes.where(F.col("n") * percent <= largest * 100).select("fp", "_id")
    every = _sets_of(docs, fitting, k).select(F.col("fp").alias("b"), F.explode("s").alias("shingle"))
    met = theirs.join(every, "shingle").where("a <> b")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _keyed(docs: DataFrame, *more: Column) -> DataFrame:
    """_id (the largest number for null), _same (equal for equal texts), text."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_id"), F.xxhash64("text").alias("_same"), "text", *more)


def _labelled(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """_id, _same, n of each row; root, component and n_members, null for empty sets."""
    keyed, scratch, parts = _keyed(docs), Scratch(docs.sparkSession), parts_for(docs)
    members = scratch.keep(_members(keyed, k, percent), "members")
    first = lambda c: F.min(c).alias(c)
    classes = scratch.keep(members.where("n > 0").groupBy("fp").agg(*map(first, ("_id", "n", "own", "next", "parity", "short")), F.count("*").alias("copies")), "classes")
    groups = scratch.keep(_groups(_signatures(keyed, k, percent), parts), "groups")
    kept = scratch.keep(_kept(groups, classes), "kept")
    scratch.drop(groups)
    # what many near copies come from shares most of its signatures: it is the best centre for them
    centers = kept.groupBy("sig").agg(F.max_by(F.struct("fp", "n"), F.struct("known", "fp")).alias("c"), F.count("*").alias("size")).where("size > 1")
    star = scratch.keep(kept.join(centers, "sig").select("sig", "fp", "n", F.col("c.fp").alias("center"), F.col("c.n").alias("_n"), "size"), "star")
    scratch.drop(kept)
    fits = 100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")
    pairs = star.where(F.col("fp") != F.col("center")).where(fits).select(F.least("fp", "center").alias("a"), F.greatest("fp", "center").alias("b"))
    pairs = scratch.keep(pairs.unionByName(_lacking(keyed, classes, k, percent)).distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).unionByName(star.where("size > 2").select("fp")).distinct().join(classes.select("fp", "_id"), "fp")
    sets = scratch.keep(_sets_of(keyed, wanted, k), "sets")
    near = scratch.keep(_near(pairs, sets, percent), "near")
    links = scratch.keep(_verify(near, sets, percent), "links")
    roots = components(links, scratch)
    others = _others(star.where("size > 2").select("sig", "fp", "size"), roots, sets, percent, parts)
    rest = scratch.keep(others.join(pairs, ["a", "b"], "left_anti"), "rest")
    more = _verify(rest, sets, percent)
    known = roots.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(known.unionByName(more), scratch)
    rooted = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("_id").alias("component"), F.sum("copies").alias("n_members"))
    labels = scratch.keep(rooted.join(least, "root").select("fp", "root", "component", "n_members"), "labels")
    scratch.drop_all_but(members, labels)
    full = members.where("n > 0").select("_id", "_same", "n", "fp").join(labels, "fp").drop("fp")
    empty = members.where("n = 0").select("_id", "_same", "n", *(F.lit(None).cast("long").alias(c) for c in ("root", "component", "n_members")))
    return full.unionByName(empty)


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, n_members of each row of ``docs`` (doc_id, text)."""
    known = lambda c: F.when(c != _LAST, c)
    component = F.coalesce("component", "_id")
    return _labelled(docs, k, percent).select(known(F.col("_id")).alias("doc_id"), F.col("n").alias("n_shingles"), known(component).alias("component_id"), F.coalesce("n_members", F.lit(1)).alias("n_members"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when one row of each component does: the one with the least doc_id (of rows without a word, one of each doc_id and text).

    Rows that go, and rows that are there more than once, are listed; all
    others pass without a shuffle of their texts if the list is short.
    """
    found = materialize(_labelled(docs, k, percent), "labelled")
    first = found.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("_id", "_same")).alias("_r")).select("_r.*", F.lit(True).alias("_stays"))
    rows = found.groupBy("_id", "_same").agg(F.count("*").alias("_rows"), F.max(F.col("root").isNull()).alias("_bare")).join(first, ["_id", "_same"], "left")
    rows = rows.select("_id", "_same", "_rows", (F.col("_bare") | F.coalesce("_stays", F.lit(False))).alias("_stays"))
    listed = materialize(rows.where("_rows > 1 OR NOT _stays"), "listed")
    small = listed.count() <= BROADCAST_ROWS
    keyed = _keyed(docs, F.struct(*docs.columns).alias("_row")).drop("text").join(F.broadcast(listed) if small else listed, ["_id", "_same"], "left")
    once = keyed.where("_stays IS NULL").select("_row.*")
    again = keyed.where("_stays").dropDuplicates(["_id", "_same"]).select("_row.*")
    return once.unionByName(again)
