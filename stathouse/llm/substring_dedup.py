r"""Operator 10: removal of passages that an earlier document has, by hashes of every window of fixed length.

Words are ``[^\x20\x09-\x0D]+``, a window is ``k`` consecutive ones.  A word
goes if a window that covers it also starts in a document with a smaller
doc_id; windows are judged on the input.

1. Anchors.  Each window's anchor is the least hash among the half-length
   grams inside it, so equal windows have equal anchors, and a document has
   few.  Anchors are counted by documents (pre-aggregated); those of two or
   more documents set bits of a sketch of fixed size.  Windows whose anchor
   isn't in it stand in one document and are settled.  A crowded sketch
   only lets more windows through.
2. Rabin-Karp hashes of all other windows are counted in Spark: the least
   doc_id of each hash, summed before the shuffle, then joined back (a hot
   hash is a skewed join that Spark splits, not a group in one task).
3. Windows with a smaller owner are gathered per document, merged into
   maximal intervals, and cut out of the text.

Hashes have 64 bits; two different windows fall together once in 2**64
pairs.  Null and empty texts have no words, nothing is removed, and the kept
text is empty.  A null doc_id counts as larger than every other.  Rows with
equal doc_id don't remove from each other.  An empty table stays empty;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_slices, int_lists, mix64, rolling, task_of, text_slices, word_reader

_LAST = (1 << 63) - 1


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive entries, by doubling."""
    out, have, power, size = None, 0, h, 1
    while size <= width:
        if width & size:
            n = max(0, len(h) - have - size + 1)
            out, have = (power, size) if out is None else (np.minimum(out[:n], power[have : have + n]), have + size)
        n = max(0, len(h) - 2 * size + 1)
        power = np.minimum(power[:n], power[size : size + n])
        size *= 2
    return out


class Windows:
    """Hashes of the windows of some texts, end to end."""

    def __init__(self, k: int):
        self.k, self.words = k, word_reader()

    def read(self, data: np.ndarray, offsets: np.ndarray, hashes: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """For each window: number of its text, place of its first word, anchor, hash (if asked for)."""
        h, counts = self.words.read(data, offsets)
        starts = np.cumsum(counts) - counts
        text = np.repeat(np.arange(len(counts)), counts)
        place = np.arange(len(h)) - starts[text]
        half = self.k // 2
        n = max(0, len(h) - self.k + 1)
        inside = np.flatnonzero((place + self.k <= counts[text])[:n])
        if not len(inside):
            none = np.zeros(0, np.int64)
            return none, none, none, none
        anchor = sliding_min(mix64(rolling(h, half)), self.k - half + 1)[inside]
        full = mix64(rolling(h, self.k))[inside].view(np.int64) if hashes else None
        return text[inside], place[inside], anchor.view(np.int64), full


def _changes(text: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Where a pair differs from the one before."""
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (anchor[1:] != anchor[:-1])
    return new


def _anchors(docs: DataFrame, k: int) -> DataFrame:
    """anchor, _id: each anchor of a document once."""

    @task_of("substring_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(k)
        for batch in batches:
            for lo, data, offsets in flat_slices(batch.column("text")):
                text, _, anchor, _ = windows.read(data, offsets, False)
                new = _changes(text, anchor)  # runs first, then the rest: runs hold most repeats
                text, anchor = text[new], anchor[new]
                order = np.lexsort((anchor, text))
                text, anchor = text[order], anchor[order]
                new = _changes(text, anchor)
                ids = batch.column("_id").slice(lo, len(offsets) - 1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(anchor[new]), pa.array(ids[text[new]])], names=["anchor", "_id"])

    return docs.mapInArrow(run, "anchor long, _id long")


def _sketch(docs: DataFrame, k: int, log_bits: int) -> np.ndarray:
    """Bits of the anchors that two or more documents have; its size is fixed, whatever the input."""
    seen = _anchors(docs.select("_id", "text"), k).groupBy("anchor").agg(F.min("_id").alias("a"), F.max("_id").alias("b"))
    bit = F.shiftrightunsigned("anchor", 64 - log_bits)
    words = seen.where("a < b").select(F.shiftright(bit, 6).alias("at"), F.expr(f"shiftleft(1L, CAST(shiftrightunsigned(anchor, {64 - log_bits}) & 63 AS INT))").alias("v"))
    got = words.groupBy("at").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(1 << (log_bits - 6), np.int64)
    out[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return out


def _candidates(docs: DataFrame, k: int, sketch, log_bits: int) -> DataFrame:
    """hash, _id, at of each window whose anchor is in the sketch; at = place and 30 bits that tell rows with equal ids apart."""

    @task_of("substring_dedup")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, bits = Windows(k), sketch.value
        for batch in batches:
            for lo, data, offsets in flat_slices(batch.column("text")):
                text, place, anchor, full = windows.read(data, offsets, True)
                bit = anchor.view(np.uint64) >> np.uint64(64 - log_bits)
                hit = ((bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)).astype(np.int64)) & 1).astype(bool)
                ids = batch.column("_id").slice(lo, len(offsets) - 1).to_numpy(zero_copy_only=False)
                tags = batch.column("_tag").slice(lo, len(offsets) - 1).to_numpy(zero_copy_only=False)
                own = text[hit]
                yield pa.RecordBatch.from_arrays([pa.array(full[hit]), pa.array(ids[own]), pa.array((place[hit] << 30) | tags[own])], names=["hash", "_id", "at"])

    return docs.mapInArrow(run, "hash long, _id long, at long")


def removal_starts(docs: DataFrame, k: int = 50, log_bits: int = 26) -> DataFrame:
    """_id, _tag, starts: the first words of all windows to remove of a document (``docs`` has _id, _tag, text)."""
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(docs, k, log_bits))
    windows = _candidates(docs, k, sketch, log_bits)  # read twice: hashing again is cheaper than keeping them on disk
    owners = windows.groupBy("hash").agg(F.min("_id").alias("owner"), F.max("_id").alias("_last")).where("owner < _last").select("hash", "owner")
    late = windows.join(owners, "hash").where("owner < _id")
    tag, place = F.col("at").bitwiseAND((1 << 30) - 1), F.shiftrightunsigned("at", 30)
    return late.groupBy("_id", tag.alias("_tag")).agg(F.collect_list(place).alias("starts"))


def substring_dedup(docs: DataFrame, k: int = 50, log_bits: int = 26) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text, intervals (array of removed [from, to) in words) of each row of ``docs``."""
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND((1 << 30) - 1).alias("_tag"))
    starts = removal_starts(keyed.select("_id", "_tag", "text"), k, log_bits)
    joined = keyed.join(starts, ["_id", "_tag"], "left").select("doc_id", "text", "starts")
    kind = dict(docs.dtypes)["doc_id"]

    @task_of("substring_dedup")
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_slices(batch.column("text")):
                own = batch.column("starts").slice(lo, len(texts))
                n_words, kept, spans = [], [], []
                for i, t in enumerate(texts):
                    words, at = (t or b"").split(), own[i]
                    n_words.append(len(words))
                    if at.is_valid:
                        p = np.unique(at.values.to_numpy(zero_copy_only=False))
                        first = np.flatnonzero(np.diff(p, prepend=-k - 1) > k)
                        merged = list(zip(p[first].tolist(), (np.append(p[first[1:] - 1], p[-1]) + k).tolist(), strict=True))
                        left, pieces = 0, []
                        for a, b in merged:
                            pieces += words[left:a]
                            left = b
                        words = pieces + words[left:]
                        spans.append(merged)
                    else:
                        spans.append([])
                    kept.append(b" ".join(words))
                flat = np.asarray([x for s in spans for ab in s for x in ab], np.int64)
                removed = [sum(b - a for a, b in s) for s in spans]
                intervals = int_lists(flat, np.asarray([2 * len(s) for s in spans]), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)), pa.array(n_words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), intervals], names=["doc_id", "n_words", "n_removed", "kept_text", "intervals"])

    return joined.mapInArrow(cut, f"doc_id {kind}, n_words long, n_removed long, kept_text string, intervals array<long>")


def sha256_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
