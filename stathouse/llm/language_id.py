"""Operator 7: language identification with error-correcting output codes.

Each language has a codeword of ``bits`` bits; binary classifiers over
hashed byte n-grams (one to three bytes, square roots of their shares)
predict the bits; decoding takes the language whose codeword has the least
logistic loss, each bit weighted by how well it was learned.  A small lead
over the runner-up flags the row as ambiguous.

The model is fitted on at most ``per_language`` labelled rows of each
language (those with the smallest hashes of doc_id; of rows with equal id and
language, the least features, so that fits don't depend on the order of rows); prediction reads whole
texts and nothing else.  Null texts and texts without a letter are ``und``
with score 0, and so is everything if there is no labelled row.  With one
language, it is predicted for every text with a letter.  A null doc_id is in
fold 0.  Repeated rows get
equal results, an empty table an empty result; other columns are kept by
``accepted`` and ignored by ``identify``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import give_back, join_small, map_batches, task_of, text_slices
from .linear import fit_logistic

UNKNOWN = "und"
_ASCII_LETTER = re.compile(rb"[A-Za-z]")
_LETTER = re.compile(r"[^\W\d_]")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as an empty text (fold 0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(n))


def has_letter(text: bytes | None) -> bool:
    return bool(text) and bool(_ASCII_LETTER.search(text) or _LETTER.search(text.decode("utf-8", "replace")))


def features(texts: list[bytes | None], size: int) -> np.ndarray:
    """Square roots of the shares of hashed byte n-grams, a row for each text.

    Long texts are counted piece by piece, so memory stays bounded.
    """
    out = np.zeros((len(texts), size), np.float32)
    step = 1 << 20
    for row, text in enumerate(texts):
        if not text:
            continue
        for lo in range(0, len(text), step):
            b = np.frombuffer(b" " + text[lo : lo + step].lower() + b"  ", np.uint8).astype(np.uint32)
            one, two = b[:-2], b[:-2] * np.uint32(257) + b[1:-1] + np.uint32(1 << 10)
            three = (two * np.uint32(263) + b[2:]) * np.uint32(2654435761)
            h = np.concatenate([one, two * np.uint32(2246822519) >> np.uint32(7), three >> np.uint32(9)]) % np.uint32(size)
            out[row] += np.bincount(h, minlength=size)
        out[row] /= out[row].sum()
    return np.sqrt(out)


def codewords(n: int, bits: int, seed: int = 5) -> np.ndarray:
    """n codewords of +1 and -1: of many random codes, the one whose closest pair of rows is farthest apart and whose columns differ most."""
    rng, best, at = np.random.default_rng(seed), (-1, -1.0), np.ones((n, bits), np.int8)
    for _ in range(400 if n > 1 else 0):
        code = rng.choice(np.asarray([-1, 1], np.int8), (n, bits))
        code[:, np.abs(code.sum(axis=0)) == n] *= np.where(np.arange(n) % 2, 1, -1)[:, None].astype(np.int8)
        apart = (code[:, None] != code[None]).sum(axis=2)
        score = (int(apart[~np.eye(n, dtype=bool)].min()), float(apart.mean()))
        if score > best:
            best, at = score, code
    return at


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    bit_weight: np.ndarray
    size: int

    def predict(self, texts: list[bytes | None], lead: float) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score, and whether the lead is small, of each text."""
        known = np.asarray([has_letter(t) for t in texts], bool)
        if not self.languages:
            known[:] = False
        names, score, close = [UNKNOWN] * len(texts), np.zeros(len(texts)), ~known
        rows = np.flatnonzero(known)
        for part in np.array_split(rows, max(1, len(rows) // 256)):
            if not len(part):
                continue
            f = features([texts[i] for i in part], self.size) @ self.weights + self.bias
            loss = np.logaddexp(0, -f[:, None, :] * self.code[None]) @ self.bit_weight
            p = np.exp(loss.min(axis=1, keepdims=True) - loss)
            p /= p.sum(axis=1, keepdims=True)
            order = np.sort(p, axis=1)
            for i, k in zip(part, p.argmax(axis=1), strict=True):
                names[i] = self.languages[k]
            score[part] = order[:, -1]
            close[part] = (order[:, -1] - (order[:, -2] if p.shape[1] > 1 else 0)) < lead
        return names, np.clip(score, 0, 1), close


def fit(docs: DataFrame, per_language: int = 700, size: int = 2048, bits: int = 15, held_out: int = 2, folds: int = 4) -> Model:
    """Fit on labelled rows of other folds than ``held_out``: at most ``per_language`` of each language."""
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    # a language may hold most rows: hashes below a share that leaves some 2 * per_language of each come first, then the exact number
    part = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / float(1 << 53)
    shares = labelled.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(2.0 * per_language) / F.count("*")).alias("_share"))
    first = W.partitionBy("lang").orderBy("_part", "doc_id")
    ids = join_small(labelled.select("lang", "doc_id", part.alias("_part")), shares, ["lang"], spread="doc_id").where("_part <= _share").select("lang", "doc_id", "_part").distinct()
    ids = ids.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= per_language).drop("_part")

    @task_of("language_id")
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_slices(batch.column("text")):
                x = features(texts, size).astype(np.float16)
                good = pa.array([has_letter(t) for t in texts])
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(lo, len(texts)), batch.column("doc_id").slice(lo, len(texts)), pa.array([r.tobytes() for r in x], pa.binary()), good], names=["lang", "doc_id", "x", "good"])

    chosen = labelled.join(F.broadcast(ids.drop("_n")), ["lang", "doc_id"]).select("lang", "doc_id", "text")
    sample = map_batches(chosen, measure, f"lang string, doc_id {dict(docs.dtypes)['doc_id']}, x binary, good boolean").where("good").groupBy("lang", "doc_id").agg(F.min("x").alias("x")).toArrow()
    sample = sample.sort_by([("lang", "ascending"), ("doc_id", "ascending"), ("x", "ascending")])
    langs = sample.column("lang").to_pylist()
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((0, bits)), np.zeros((size, bits), np.float32), np.zeros(bits, np.float32), np.ones(bits), size)
    x = np.frombuffer(b"".join(sample.column("x").to_pylist()), np.float16).reshape(len(langs), size).astype(np.float32)
    del sample
    which = np.asarray([names.index(v) for v in langs])
    code = codewords(len(names), bits)
    y = (code[which] > 0).astype(np.float32)
    w, b = fit_logistic(x, y, 1.0 / np.bincount(which)[which], rate=60.0, penalty=1e-5)
    right = (((x @ w + b) > 0) == (y > 0)).mean(axis=0)
    del x
    give_back()
    return Model(names, code.astype(np.float32), w, b, np.clip(2 * right - 1, 0.05, 1), size)


def identify(docs: DataFrame, model: Model, lead: float = 0.2) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of each row of ``docs`` (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]

    @task_of("language_id")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_slices(batch.column("text")):
                names, score, close = model.predict(texts, lead)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)), pa.array(names, pa.string()), pa.array(score, pa.float64()), pa.array(close, pa.bool_())], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")


def accepted(docs: DataFrame, model: Model, lead: float = 0.2) -> DataFrame:
    """The rows of ``docs`` whose language can be told (not ``und``); all columns stay as they are."""

    @task_of("language_id")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_slices(batch.column("text")):
                names, _, _ = model.predict(texts, lead)
                yield batch.slice(lo, len(texts)).filter(pa.array([n != UNKNOWN for n in names], pa.bool_()))

    return map_batches(docs, run, docs.schema)
