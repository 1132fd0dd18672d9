"""Shared plumbing: durable intermediate tables, small joins, text slicing."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six white-space characters that separate words, as a Java regex class.
SPACE = r" \t\n\x0B\f\r"
#: The same characters, for trim functions.
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: UTF-8 bytes that a Python worker turns into word lists at a time.
SLICE_BYTES = 2 << 20
#: Bytes that a batch of rows for a Python worker may have, besides its number of rows: several are held at once, in the JVM and in the worker.
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows that a side may have to be broadcast; beyond it a salted join is used.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir; a local folder only where that is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stathouse-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/stathouse-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_batches(df: DataFrame, run: Callable, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of about BATCH_BYTES, or one row: 10,000 rows of documents are 30 MB and more.

    Spark has no bound for one plan, so the session gets it, unless it has one already.
    """
    if df.sparkSession.conf.get(_BATCH_BYTES, None) is None:
        df.sparkSession.conf.set(_BATCH_BYTES, BATCH_BYTES)
    return df.mapInArrow(run, schema)


class Scratch:
    """The intermediate tables of one call: durable, and deleted once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(table)] = (table, path)
        return table

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self.paths.pop(id(table))
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        left = {id(t) for t in tables}
        self.drop(*(t for k, (t, _) in list(self.paths.items()) if k not in left))


def parts_for(df: DataFrame, bytes_each: int = 128 << 20) -> int:
    """How many partitions a shuffle of about ``df``'s size should have: the session's number, or more for a large input (of known size)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // bytes_each) if size < 1 << 55 else 1)


def join_small(df: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salt: int = 32, spread: str | None = None) -> DataFrame:
    """Join with a table that is expected to be small; its size is counted first.

    Up to BROADCAST_ROWS rows it is broadcast.  Beyond that, it is copied
    ``salt`` times and ``df`` is dealt by (keys, salt), so that one hot key
    doesn't land in one task; ``spread`` names the column that is salted by.
    """
    if small.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(small), keys, how)
    by = F.pmod(F.xxhash64(spread or df.columns[0]), F.lit(salt)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
    return df.withColumn("_salt", by).join(copies, [*keys, "_salt"], how).drop("_salt")


def text_slices(column: pa.Array) -> Iterator[tuple[int, list[bytes | None]]]:
    """Pieces of a string column as lists of UTF-8 bytes, each of about SLICE_BYTES, with the first row's number."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    group = np.cumsum(lengths) // SLICE_BYTES
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    for lo, hi in zip(starts, [*starts[1:], len(lengths)]):  # noqa: B905  no rows, no slices
        yield int(lo), column.slice(lo, hi - lo).cast(pa.binary()).to_pylist()


class BoundedCache(dict):
    """A dict that computes missing values, with two generations so that frequent keys stay and memory is bounded."""

    def __init__(self, compute: Callable, limit: int = 250_000):
        super().__init__()
        self.compute, self.limit, self.old = compute, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value

    def trim(self) -> None:
        """Call between slices: starts a new generation when this one is full."""
        if len(self) > self.limit:
            self.old = dict(self)
            self.clear()


_releases: list[Callable[[], None]] = []
_operator = [""]


def when_done(release: Callable[[], None]) -> None:
    """Registers what frees the state that an operator keeps in a Python worker between its tasks."""
    _releases.append(release)


def give_back() -> None:
    """Freed memory goes back to the system: the allocators of Arrow and libc keep it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def take_over(operator: str) -> None:
    """Frees what another operator left in this worker.  (Of this module, not of a closure: closures carry copies of what they name.)"""
    if _operator[0] != operator:
        _operator[0] = operator
        for release in _releases:
            release()
        gc.collect()
        give_back()


def task_of(operator: str) -> Callable:
    """For functions over the batches of a task: Python workers are used again, so what another operator left there is freed first."""

    def wrap(run: Callable) -> Callable:
        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            take_over(operator)
            yield from run(batches)
            give_back()

        return task

    return wrap


def flat_slices(column: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of a string column as one array of UTF-8 bytes and the offsets of its texts, with the first row's number: whole texts, ``size`` bytes or one text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n, (_, bounds, values) = len(column), column.buffers()
    if not n:
        return
    at = np.frombuffer(bounds, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1)
        yield lo, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def _powers(n: int, base: int) -> np.ndarray:
    out, have = np.ones(n, np.uint64), 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * np.uint64(pow(base, have, 1 << 64))
        have += more
    return out


class WordHashes:
    """64-bit polynomial hashes of words between ASCII white space, for all texts of a slice at once; with ``fold``, A-Z count as a-z."""

    BASE, CHUNK = 0xD1342543DE82EF95, 1 << 19

    def __init__(self, fold: bool = False):
        self.value = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        if fold:
            self.value[65:91] = self.value[97:123]
        self.space = np.isin(np.arange(256), np.frombuffer(SPACE_CHARS.encode(), np.uint8))
        self._grow(self.CHUNK)

    def _grow(self, n: int) -> None:
        self.up, self.down = _powers(n, self.BASE), _powers(n, pow(self.BASE, -1, 1 << 64))

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hashes of all words, end to end, and how many words each text has."""
        if len(data) <= self.CHUNK or len(offsets) > 2:
            return self._read(data, offsets)
        out, lo = [], 0  # one long text, cut at white space
        while lo < len(data):
            hi = lo + self.CHUNK
            while hi < len(data) and not (gap := self.space[data[hi : hi + self.CHUNK]]).any():
                hi += self.CHUNK
            hi = min(len(data), hi + int(gap.argmax()) if hi < len(data) else hi)
            out.append(self._read(data[lo:hi], np.asarray([0, hi - lo]))[0])
            lo = hi
        return np.concatenate(out), np.asarray([sum(map(len, out))])

    def _read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
        if n > len(self.up):
            self._grow(1 << n.bit_length())
        space, edge = self.space[data], np.zeros(n + 1, bool)
        edge[offsets] = True
        first, last = ~space, ~space
        first[1:] &= space[:-1] | edge[1:n]
        last[:-1] &= space[1:] | edge[1:n]
        s, e = np.flatnonzero(first), np.flatnonzero(last)
        with np.errstate(over="ignore"):
            total = np.cumsum(self.value[data] * self.up[:n], dtype=np.uint64)
            h = (total[e] - np.where(s > 0, total[s - 1], np.uint64(0))) * self.down[s]
        if n > 4 * self.CHUNK:
            self._grow(self.CHUNK)
        return mix64(h), np.diff(np.searchsorted(s, offsets))


@lru_cache(maxsize=2)
def word_reader(fold: bool = False) -> WordHashes:
    """One for each Python worker: its tables take 8 MB."""
    return WordHashes(fold)


when_done(word_reader.cache_clear)


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Rabin-Karp hashes modulo 2**64 of every k consecutive entries, by doubling: out[i] covers h[i:i+k]."""
    base = 0x9E3779B97F4A7C15
    out, have, power, width = None, 0, h.astype(np.uint64), 1
    with np.errstate(over="ignore"):
        while True:
            if k & width:
                if out is None:
                    out, have = power, width
                else:
                    shift = np.uint64(pow(base, width, 1 << 64))
                    n = len(h) - have - width + 1
                    out = out[:n] * shift + power[have : have + n] if n > 0 else h[:0]
                    have += width
            width *= 2
            if width > k:
                return out
            half = width // 2
            n = len(h) - width + 1
            power = power[:n] * np.uint64(pow(base, half, 1 << 64)) + power[half : half + n] if n > 0 else h[:0]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective finalizer: spreads the bits of rolling hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def int_lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and the length of each list."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))
