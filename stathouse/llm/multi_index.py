"""Operator 9: nearest neighbours by multi-index hashing of learned binary codes.

1. Fit (on at most ``fit_rows`` vectors with the smallest hashes of vec_id):
   rotations that make signs lose little (iterative quantization), one after
   another until the code has ``bits`` bits, and the Hamming radius within
   which ``cover`` of the sample's true neighbours lie.  More rows only bring
   neighbours nearer, so the radius holds for the whole table.
2. Index: every vector's code; blocks of rows dealt by a hash of vec_id.
   In a block, codes are split into 16-bit substrings, and each substring
   has a table from its values to the rows that hold them.
3. Search: by the pigeonhole principle a code within the radius lies, in
   some substring, within that substring's share of it.  All values within
   the share are looked up, and Hamming distances are taken only of what
   the tables return; what lies within the radius is ranked by the inner
   product in double precision.  A query with fewer than ``k`` finds in a
   block widens its radius there until it has them.
4. The best ``k`` of all blocks, ties to the smaller vec_id.

Vectors of different lengths are made comparable for inner products by one
more component (what their norm lacks of the largest).  Null and zero
vectors, those with null or non-finite components, and those whose length
isn't the most common one take no part.  Rows of equal vec_id are not each
other's neighbours.  An empty table, or one without queries, gives no rows;
columns other than the two are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

def usable(v: Column) -> Column:
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(v, lambda x: x != 0)


@dataclass
class Coder:
    rotation: np.ndarray  # (length + 1) x bits
    top: float  # the largest norm
    radius: int

    def codes(self, v: np.ndarray) -> np.ndarray:
        """Rows of 16-bit words."""
        lack = np.sqrt(np.maximum(self.top**2 - (v * v).sum(axis=1), 0))
        return self._pack(np.hstack([v, lack[:, None]]))

    def query_codes(self, q: np.ndarray) -> np.ndarray:
        return self._pack(np.hstack([q, np.zeros((len(q), 1))]))

    def _pack(self, x: np.ndarray) -> np.ndarray:
        return np.packbits(x @ self.rotation > 0, axis=1).view(np.uint16)


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between two sets of codes (rows of 16-bit words)."""
    wide = np.uint64 if a.shape[1] % 4 == 0 else np.uint16
    a, b = np.ascontiguousarray(a).view(wide), np.ascontiguousarray(b).view(wide)
    out = np.zeros((len(a), len(b)), np.uint16)
    for j in range(a.shape[1]):
        out += np.bitwise_count(a[:, j][:, None] ^ b[:, j][None])
    return out


def fit(vectors: np.ndarray, top: float, k: int, bits: int, cover: float, seed: int = 3, rounds: int = 15) -> Coder:
    lack = np.sqrt(np.maximum(top**2 - (vectors * vectors).sum(axis=1), 0))
    x = np.hstack([vectors, lack[:, None]])
    rng, d, parts = np.random.default_rng(seed), x.shape[1], []
    while sum(p.shape[1] for p in parts) < bits:
        r = np.linalg.qr(rng.standard_normal((d, d)))[0]
        for _ in range(rounds if len(x) > d else 0):
            u, _, vt = np.linalg.svd(x.T @ np.where(x @ r > 0, 1.0, -1.0))
            r = u @ vt
        parts.append(r)
    coder = Coder(np.hstack(parts)[:, :bits], top, bits)
    queries = vectors[:: max(1, len(vectors) // 400)]
    scores = queries @ vectors.T
    near = np.argsort(-scores, axis=1)[:, 1 : k + 1]  # the first is the query itself
    far = hamming(coder.query_codes(queries), coder.codes(vectors))
    found = np.take_along_axis(far, near, axis=1)
    coder.radius = int(np.quantile(found, cover)) if found.size else bits
    return coder


#: All 16-bit words, those with few bits first, and how many have at most so many bits.
_MASKS = np.argsort(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)), kind="stable").astype(np.uint16)
_UP_TO = np.cumsum(np.bincount(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)), minlength=17))


class SubstringIndex:
    """For each substring of the codes of a block, the rows by their value there."""

    def __init__(self, codes: np.ndarray):
        self.codes = np.ascontiguousarray(codes)
        self.rows = [np.argsort(c, kind="stable") for c in codes.T]
        self.count = [np.bincount(c, minlength=1 << 16) for c in codes.T]
        self.start = [np.cumsum(n) - n for n in self.count]

    def probe(self, query: np.ndarray, radius: int) -> np.ndarray:
        """The rows that some substring's table returns; every code within the radius is among them.

        With m substrings and radius = m * q + a, the first a + 1 are probed
        to distance q and the others to q - 1.
        """
        share, rest = divmod(radius, self.codes.shape[1])
        found = np.zeros(len(self.codes), bool)
        for j in range(self.codes.shape[1]):
            most = min(share if j <= rest else share - 1, 16)
            if most < 0:
                continue
            values = query[j] ^ _MASKS[: _UP_TO[most]]
            n = self.count[j][values]
            values, n = values[n > 0], n[n > 0]
            at = np.repeat(self.start[j][values] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            found[self.rows[j][at]] = True
        return np.flatnonzero(found)

    def within(self, query: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose codes lie within the radius."""
        rows = self.probe(query, radius)
        return rows[hamming(query[None], self.codes[rows])[0] <= radius]


def _search(coder: Coder, k: int, step: int = 4):
    def matrix(t: pa.Table) -> np.ndarray:
        flat = t.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(t.num_rows, -1)

    def run(index: pa.Table, asked: pa.Table) -> pa.Table:
        out = ([], [], [])
        if index.num_rows and asked.num_rows:
            ids, v = index.column("vec_id").to_numpy(), matrix(index)
            tables = SubstringIndex(np.frombuffer(b"".join(index.column("code").to_pylist()), np.uint16).reshape(len(ids), -1))
            q_ids, q = asked.column("vec_id").to_numpy(), matrix(asked)
            bits = 16 * tables.codes.shape[1]
            for i, code in enumerate(coder.query_codes(q)):
                radius = coder.radius
                rows = tables.within(code, radius)
                while (ids[rows] != q_ids[i]).sum() < k and radius < bits:
                    radius = min(bits, radius + step)
                    rows = tables.within(code, radius)
                rows = rows[ids[rows] != q_ids[i]]
                s = np.einsum("j,ij->i", q[i], v[rows])
                best = np.lexsort((ids[rows], -s))[:k]
                for o, c in zip(out, (np.full(len(best), q_ids[i]), ids[rows[best]], s[best]), strict=True):
                    o.append(c)
        cat = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
        return pa.table([cat(out[0], pa.int64()), cat(out[1], pa.int64()), cat(out[2], pa.float64())], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: Column, k: int = 20, bits: int = 64, fit_rows: int = 6000, cover: float = 0.95, index_block: int = 1 << 15, query_block: int = 1 << 13) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of ``vectors`` (vec_id, embedding) that ``queries`` selects."""
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"  # moved as they are, ranked as doubles
    good = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), queries.alias("asked")).where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    lengths = good.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not lengths:
        return empty
    good = good.where(F.size("embedding") == lengths[0]["d"])
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    n, n_asked, top = good.agg(F.count("*"), F.count(F.when(F.col("asked"), 1)), F.max(norm)).first()
    if not n_asked:
        return empty
    sample = np.asarray([r["embedding"] for r in good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).select("embedding").collect()])
    coder = fit(sample, top, k, bits, cover)

    def encode(batches):
        for b in batches:
            v = b.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1).astype(np.float64)
            yield b.append_column("code", pa.array([c.tobytes() for c in coder.codes(v)] if b.num_rows else [], pa.binary()))

    blocks, q_blocks = math.ceil(n / index_block), math.ceil(n_asked / query_block)
    deal = lambda count, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(count)).cast("int")
    index = materialize(good.mapInArrow(encode, f"vec_id long, embedding {kind}, asked boolean, code binary"), "codes")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = index.select("vec_id", "embedding", "code", deal(blocks, 1).alias("i")).withColumn("q", every(q_blocks))
    right = index.where("asked").select("vec_id", "embedding", deal(q_blocks, 2).alias("q")).withColumn("i", every(blocks))
    found = left.groupBy("i", "q").cogroup(right.groupBy("i", "q")).applyInArrow(_search(coder, k), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
