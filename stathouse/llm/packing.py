r"""Operator 5: hierarchical packing of documents into windows of several lengths.

Documents are encoded where they are read; no text or token is shuffled.
Each task is a packer that sees its documents in order and keeps bounded
buffers:

* A document fills whole windows of the longest tier; what remains is routed
  to the shortest tier that holds it (128, 256, 512 or 1024 tokens).
* A tier's pieces are packed first-fit into open windows of that tier.
* A window of the longest tier whose gap fits no piece of its own is filled
  from shorter tiers: the longest piece that fits, again and again; a gap
  that no whole piece fits takes the head of the next one, whose tail stays.
* Windows of shorter tiers are only closed when they are full, so what is
  not padded is exact; what is left at the end of a task is joined into
  long windows, and the last of it is cut at powers of two.
* ``step_group`` numbers windows of one length in groups of ``step_tokens``
  tokens, so that each step of a group costs the same.

Null and empty texts are one end id.  Equal or missing ids don't matter:
pieces carry doc_id as it is.  An empty table gives no pieces.  The same
files and split sizes give the same packing, so a lost task is redone alike.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import map_batches, task_of, text_slices
from .tokens import encoder

TIERS = (128, 256, 512, 1024)
END_ID = 0
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tier int, step_group long"


class Tier:
    """Pieces that wait for windows of one length, by their own length."""

    def __init__(self):
        self.lengths, self.pieces, self.held = [], defaultdict(deque), 0

    def put(self, piece: tuple) -> None:
        n = piece[2]
        if n not in self.pieces:
            insort(self.lengths, n)
        self.pieces[n].append(piece)
        self.held += n

    def pop(self, at: int) -> tuple:
        """The first piece of the length at this place."""
        n = self.lengths[at]
        piece = self.pieces[n].popleft()
        if not self.pieces[n]:
            del self.pieces[n], self.lengths[at]
        self.held -= n
        return piece


class Packer:
    """One task's packer.  A piece is (document, start, length); the buffers hold at most ``hold`` tokens (or a window)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, hold: int = 1 << 20, step_tokens: int = 1 << 16):
        self.tiers, self.hold, self.step_tokens = tiers, hold, step_tokens
        self.waiting = {t: Tier() for t in tiers}
        self.sequences, self.steps = 0, dict.fromkeys(tiers, 0)

    @property
    def held(self) -> int:
        return sum(t.held for t in self.waiting.values())

    def add(self, doc, tokens: int) -> Iterator[tuple]:
        window, start = self.tiers[-1], 0
        while tokens - start >= window:
            yield from self._close(window, [(doc, start, window)])
            start += window
        if start < tokens:
            self._wait((doc, start, tokens - start))
        if self.held >= self.hold:
            yield from self._drain(max(self.hold // 2, window))

    def _wait(self, piece: tuple) -> None:
        self.waiting[next(t for t in self.tiers if piece[2] <= t)].put(piece)

    def _take(self, most: int, tiers: tuple[int, ...]) -> tuple | None:
        """The longest waiting piece of at most ``most`` tokens from these tiers, longer tiers first."""
        for tier in reversed(tiers):
            if at := bisect_right(self.waiting[tier].lengths, most):
                return self.waiting[tier].pop(at - 1)
        return None

    def _head(self, gap: int) -> tuple | None:
        """The head of the shortest waiting piece that is longer than the gap; its tail waits on."""
        for tier in self.tiers:
            if self.waiting[tier].lengths:
                doc, start, n = self.waiting[tier].pop(0)
                if n > gap:
                    self._wait((doc, start + gap, n - gap))
                return doc, start, min(n, gap)
        return None

    def _drain(self, keep: int) -> Iterator[tuple]:
        """Full windows, until at most ``keep`` tokens (a longest window at least) wait: a window of each tier in turn, gaps filled from that tier, then from shorter ones."""
        while self.held > keep:
            for tier in reversed(self.tiers):
                shorter = tuple(t for t in self.tiers if t <= tier)
                if sum(self.waiting[t].held for t in shorter) < tier or not self.waiting[tier].held:
                    continue
                pieces, gap = [], tier
                while gap:
                    piece = self._take(gap, shorter) or self._head_of(gap, shorter)
                    if piece is None:
                        break
                    pieces.append(piece)
                    gap -= piece[2]
                if gap:  # cannot fill: put back, the long windows take it
                    for p in pieces:
                        self._wait(p)
                    continue
                yield from self._close(tier, pieces)
                break
            else:
                yield from self._close(self.tiers[-1], self._fill(self.tiers[-1]))

    def _head_of(self, gap: int, tiers: tuple[int, ...]) -> tuple | None:
        return self._head(gap) if any(self.waiting[t].held for t in tiers) else None

    def _fill(self, size: int) -> list[tuple]:
        pieces, gap = [], size
        while gap and self.held:
            piece = self._take(gap, self.tiers) or self._head(gap)
            pieces.append(piece)
            gap -= piece[2]
        return pieces

    def end(self) -> Iterator[tuple]:
        """What waits: full long windows, then powers of two."""
        window = self.tiers[-1]
        yield from self._drain(window)
        while self.held >= window:
            yield from self._close(window, self._fill(window))
        while self.held:
            size = 1 << (self.held.bit_length() - 1)
            yield from self._close(size, self._fill(size))

    def _close(self, size: int, pieces: list[tuple]) -> Iterator[tuple]:
        tier = next(t for t in self.tiers if size <= t)
        offset, group = 0, self.steps[tier] // self.step_tokens
        for doc, start, length in pieces:
            yield doc, start, length, self.sequences, offset, size, tier, group
            offset += length
        self.sequences += 1
        self.steps[tier] += size


def pack(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID, hold: int = 1 << 20, step_tokens: int = 1 << 16) -> DataFrame:
    """One row for each piece of ``docs`` (doc_id, text); the ids of a piece are tokens start..start+length of its document."""

    @task_of("packing")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, enc = TaskContext.get().partitionId(), encoder(tokenizer, spaced=True)
        end, packer = np.asarray([end_id], "<u4").tobytes(), Packer(tiers, hold, step_tokens)
        live: dict[int, list] = {}  # documents with waiting pieces: [doc_id, ids that wait, where they start, tokens, tokens that wait]
        rows: list[tuple] = []

        def emit(pieces: Iterator[tuple]) -> None:
            for key, start, length, sequence, offset, size, tier, group in pieces:
                doc = live[key]
                rows.append((doc[0], start, length, zlib.crc32(doc[1][4 * (start - doc[2]) : 4 * (start + length - doc[2])]), doc[3], (task << 40) | sequence, offset, size, tier, (task << 40) | group))
                doc[4] -= length
                if not doc[4]:
                    del live[key]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 8 + [pa.int32(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

        key = 0
        for batch in batches:
            for lo, texts in text_slices(batch.column("text")):
                for doc_id, text in zip(batch.column("doc_id").slice(lo, len(texts)).to_pylist(), texts, strict=True):
                    ids = enc.encode(text or b"") + end
                    n = len(ids) // 4
                    live[key] = [doc_id, ids, 0, n, n]
                    emit(packer.add(key, n))
                    if key in live and n > tiers[-1]:  # whole windows are out; only what waits is kept
                        cut = n - n % tiers[-1]
                        live[key][1:3] = ids[4 * cut :], cut
                    key += 1
                if rows:
                    yield batch_of(rows)
                    rows.clear()
        emit(packer.end())
        if rows:
            yield batch_of(rows)

    return map_batches(docs.select("doc_id", "text"), run, SCHEMA)
