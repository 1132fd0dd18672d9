"""Operator 1: token ids in ORC, written in document order, read back stripe by stripe.

Documents are dealt into ranges of ascending doc_id (nulls first; equal ids
by text), encoded inside their range, and written by Spark's ORC writer:
``ids`` is an integer column (run-length encoded), stripes are short, row
indexes and a Bloom filter on doc_id let readers skip stripes.  Each row
carries its file's number and where its ids start among that file's ids, so
global positions need only one sum per file.

Null text counts as empty (just the end id).  Repeated rows are written
again; an empty table gives an empty store.  Integer ids of any type are kept
as long.  Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import flat_slices, join_small, materialize, parts_for, shared_dir, task_of
from .tokens import encoder

SCHEMA = "doc_id long, shard int, token_offset long, ids array<int>"
END_ID = 1
#: Bytes of texts that are encoded at once: each distinct piece among them is looked up once.
SLICE_BYTES = 4 << 20


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, stripe_bytes: int = 16 << 20, row_stride: int = 1000) -> None:
    """Encode ``docs`` (doc_id, text) and write the store to ``path``."""

    @task_of("token_store")
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, offset, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            ids_of = batch.column("doc_id")
            for lo, data, at in flat_slices(batch.column("text"), SLICE_BYTES):
                values, bounds = enc.encode_all(data, at, end)
                n, starts = len(at) - 1, offset + bounds[:-1]
                offset += len(values)
                yield pa.RecordBatch.from_arrays([ids_of.slice(lo, n), pa.array(np.full(n, shard, np.int32)), pa.array(starts), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))], names=["doc_id", "shard", "token_offset", "ids"])

    order = [F.col("doc_id").asc_nulls_first(), F.col("_tie")]
    (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
        .repartitionByRange(parts_for(docs), *order)
        .sortWithinPartitions(*order, "text")
        .select("doc_id", "text")
        .mapInArrow(encode, SCHEMA)
        .write.option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", row_stride)
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01)
        .option("orc.compress", "ZSTD").orc(path)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The stored rows; with ``doc_ids``, the filter reaches stripe statistics and Bloom filters."""
    df = spark.read.schema(SCHEMA).orc(path)
    return df if doc_ids is None else df.where(F.col("doc_id").isin(doc_ids))


def digest(stored: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each stored document, from the ids that were read."""

    @task_of("token_store")
    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8).data
            at = ids.offsets.to_numpy()
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("shard"), batch.column("token_offset"), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "shard", "token_offset", "n_tokens", "ids_crc32"])

    # the ids are read once; what is left of them is a few numbers a document
    rows = materialize(stored.mapInArrow(crc, "doc_id long, shard int, token_offset long, n_tokens long, ids_crc32 long"), "digest")
    files = rows.groupBy("shard").agg(F.max(F.col("token_offset") + F.col("n_tokens")).alias("_n"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row for each file
    base = files.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    out = join_small(rows, base, ["shard"])
    return out.select("doc_id", (F.col("_base") + F.col("token_offset")).alias("start"), "n_tokens", "ids_crc32")


def token_store(docs: DataFrame, tokenizer: str, **options) -> tuple[DataFrame, str]:
    """Write the store to the shared folder; returns its rows as read back, and its path."""
    path = shared_dir(docs.sparkSession) + "-tokens"
    write_tokens(docs, path, tokenizer, **options)
    return read_tokens(docs.sparkSession, path), path
