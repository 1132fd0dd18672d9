"""Operator 8: toxicity by weak supervision.

1. Voters: fixed lexicons, patterns, and lexicons found in labelled rows of
   the learning folds (beginnings of words that are far likelier in toxic
   texts, counted once for each family of near copies).  A voter says 1, -1 or nothing.
2. A generative label model (expectation maximization over what each voter
   says given the true class) estimates accuracies on labelled and unlabelled
   documents of the learning folds alike.  A given label is one more voter,
   whose own accuracy is estimated with the rest; voters that agree beyond
   what the class explains are correlated and share their weight.
3. A linear classifier over counts of lexicon entries is trained on the posterior labels;
   it alone scores texts, whole, and never sees labels, lang, source or id.

At most ``fit_rows`` labelled and as many unlabelled rows (smallest hashes of
doc_id) are learned from; of equal texts one, toxic if one of them is.  Null and empty texts get the score of a text without any word.  Rows
without label only get scores; without any labelled row the fixed lexicon
votes alone.  Repeated rows get equal scores, an empty table stays empty,
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, task_of, text_slices, when_done
from .language_id import fold
from .linear import fit_logistic

#: Lexicons of abuse, a voter each.
LEXICONS = {
    "insult": ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "loser", "losers", "clown", "fool", "imbecile", "dimwit", "jerk", "creep"),
    "contempt": ("pathetic", "worthless", "disgusting", "useless", "ugly", "vile", "repulsive", "filthy", "hopeless"),
    "dehumanizing": ("trash", "scum", "garbage", "vermin", "parasite", "parasites", "subhuman", "filth"),
    "threat": ("kill", "hurt", "destroy", "burn", "shoot", "strangle"),
    "profane": ("damn", "crap", "bastard", "bitch", "shit", "fuck", "fucking", "asshole"),
    "other languages": ("idiota", "estúpido", "imbécil", "basura", "asqueroso", "idiote", "stupide", "ordure", "dummkopf", "idioten", "abschaum", "wertlos", "widerlich"),
}
_WORD = re.compile(r"[^\W\d_]+")
_SHOUT = re.compile(r"\b[A-Z]{4,}\b.*!|!{3,}", re.DOTALL)
_YOU = re.compile(r"\byou(?:'re| are)?\s+(?:a |an |such a |so )?(?:\w+ )?(?:{})\b".format("|".join(LEXICONS["insult"] + LEXICONS["contempt"] + LEXICONS["dehumanizing"])), re.IGNORECASE)


class Lexicon:
    """Finds words, and beginnings of words, in whole texts with one automaton."""

    def __init__(self, words: tuple[str, ...], starts: tuple[str, ...]):
        import ahocorasick

        self.names = [*words, *starts]
        self.automaton = ahocorasick.Automaton()
        for i, w in enumerate(self.names):
            self.automaton.add_word(w, (*(self.automaton.get(w, ())), (i, len(w), i < len(words))))
        if self.names:
            self.automaton.make_automaton()

    def counts(self, text: str) -> Counter:
        """How often each entry stands in a lower-case text."""
        found: Counter = Counter()
        if self.names:
            n = len(text)
            for end, entries in self.automaton.iter(text):
                for i, size, whole in entries:
                    before, after = end - size, end + 1
                    if (before < 0 or not text[before].isalpha()) and not (whole and after < n and text[after].isalpha()):
                        found[i] += 1
        return found


@lru_cache(maxsize=4)
def lexicon(words: tuple[str, ...], starts: tuple[str, ...]) -> Lexicon:
    return Lexicon(words, starts)


when_done(lexicon.cache_clear)


FIXED_WORDS = tuple(sorted({w for words in LEXICONS.values() for w in words}))


def voters(starts: tuple[str, ...]) -> list[frozenset[int]]:
    """The entries that each lexicon voter counts: the fixed lexicons, then three parts of the learned one."""
    at = {w: i for i, w in enumerate(FIXED_WORDS)}
    return [frozenset(at[w] for w in words) for words in LEXICONS.values()] + [frozenset(range(len(at) + k, len(at) + len(starts), 3)) for k in range(3)]


def read(text: bytes | None, starts: tuple[str, ...], parts: list[frozenset[int]]) -> tuple[Counter, list[int]]:
    """Counts of lexicon entries in a text, and what each voter says of it."""
    raw = (text or b"").decode("utf-8", "replace")
    counts, words = lexicon(FIXED_WORDS, starts).counts(raw.lower()), raw.count(" ") + 1
    votes = []
    for part in parts:
        hits = sum(n for i, n in counts.items() if i in part)
        votes.append(1 if hits >= 2 or hits and hits * 200 >= words else 0 if hits else -1)
    return counts, [*votes, 1 if counts and _YOU.search(raw) else 0, 1 if counts and _SHOUT.search(raw) else 0]


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 30, trust: float = 0.9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of label 1 for each row, accuracy of each voter, and their correlations given the label.

    votes: rows x voters in -1, 0, 1; labels: 1, 0, or -1 where unknown, a
    voter that is right with ``trust`` at first, then as often as the model
    finds (0.8 to 0.99, for either class).
    """
    n, m = votes.shape
    known = labels >= 0
    right = np.asarray([trust, trust])  # of labels 0, of labels 1
    says_label = lambda: np.where(labels == 1, np.log(right[1] / (1 - right[0])), np.log((1 - right[1]) / right[0])) * known
    start = 1 / (1 + np.exp(-(votes == 1).sum(axis=1) + 0.5))
    post = np.where(known, np.where(labels == 1, trust, 1 - trust), start)
    says = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float)  # rows x voters x answers
    share, corr = np.ones(m), np.eye(m)
    for _ in range(rounds):
        prior = np.clip(post.mean(), 1e-3, 1 - 1e-3)
        table = [(np.einsum("r,rva->va", p, says) + 0.5) / (p.sum() + 1.5) for p in (1 - post, post)]
        means = [(t[:, 2] - t[:, 0]) for t in table]
        rest = votes - np.outer(1 - post, means[0]) - np.outer(post, means[1])
        cov = rest.T @ rest / n
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
        corr = cov / np.outer(sd, sd)
        share = 1 / (1 + np.clip(corr - np.eye(m), 0, None).sum(axis=1))
        ratio = np.einsum("rva,va,v->r", says, np.log(table[1] / table[0]), share)
        post = 1 / (1 + np.exp(-np.clip(ratio + says_label() + np.log(prior / (1 - prior)), -30, 30)))
        for c, p in ((0, 1 - post), (1, post)):
            if (weight := p[known].sum()) > 1:
                right[c] = np.clip(p[known & (labels == c)].sum() / weight, 0.8, 0.99)
    fired = np.maximum((votes != 0) @ np.ones(m), 1)
    accuracy = np.asarray([(np.where(votes[:, j] == 1, post, np.where(votes[:, j] == -1, 1 - post, 0))).sum() / max((votes[:, j] != 0).sum(), 1) for j in range(m)])
    return np.where(fired > 0, post, post.mean()), accuracy, corr


@dataclass
class Model:
    starts: tuple[str, ...]
    weights: np.ndarray
    bias: float
    accuracies: np.ndarray
    correlations: np.ndarray

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        out, entries = np.full(len(texts), self.bias), lexicon(FIXED_WORDS, self.starts)
        for i, t in enumerate(texts):
            for k, n in entries.counts(t.decode("utf-8", "replace").lower()).items() if t else ():
                out[i] += self.weights[k] * np.log1p(n)
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def _sample(docs: DataFrame, labels: DataFrame, fit_rows: int, held_out: int, folds: int) -> DataFrame:
    """doc_id, text, toxic (-1 where unlabelled) to learn from: whole texts of at most ``fit_rows`` labelled and as many unlabelled ids, each different text once."""
    learning = lambda d: d.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
    first = lambda d: d.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    labelled = learning(labels.where("toxic IS NOT NULL")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    others = learning(docs.where("text IS NOT NULL").select("doc_id")).distinct().join(labels.select("doc_id").distinct(), "doc_id", "left_anti")
    ids = first(labelled).unionByName(first(others).withColumn("toxic", F.lit(-1)))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where(F.col("text").isNotNull()).groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic")).select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 8000, held_out: int = 0, folds: int = 5, learned: int = 160, min_families: int = 4) -> Model:
    kind = dict(docs.dtypes)["doc_id"]
    sample = _sample(docs, labels, fit_rows, held_out, folds)

    @task_of("toxicity")
    def families(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least hash of three-word windows: near copies mostly share it."""
        import xxhash

        for batch in batches:
            for lo, texts in text_slices(batch.column("text")):
                out = []
                for t in texts:
                    raw = t.split()
                    grams = zip(raw, raw[1:], raw[2:])  # noqa: B905  three-word windows
                    out.append(min((xxhash.xxh3_64_intdigest(b" ".join(g)) for g in grams), default=0) >> 1)
                yield batch.slice(lo, len(texts)).append_column("family", pa.array(out, pa.int64()))

    @task_of("toxicity")
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many texts hold a word that begins so; summed in the task first."""
        pos, every = Counter(), Counter()
        for batch in batches:
            for lo, texts in text_slices(batch.column("text")):
                for t, y in zip(texts, batch.column("toxic").slice(lo, len(texts)).to_pylist(), strict=True):
                    raw = _WORD.findall(t.decode("utf-8", "replace").lower())
                    own = {w[:n] for w in raw for n in range(4, 10) if len(w) >= n}
                    every.update(own)
                    if y:
                        pos.update(own)
        yield pa.RecordBatch.from_arrays([pa.array(list(pos), pa.string()), pa.array([int(n) for n in pos.values()], pa.int64()), pa.array([every[w] for w in pos], pa.int64())], names=["start", "pos", "n"])
        rest = [w for w in every if w not in pos]
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string()), pa.array([0] * len(rest), pa.int64()), pa.array([every[w] for w in rest], pa.int64())], names=["start", "pos", "n"])

    sample = materialize(sample, "sample")
    once = sample.where("toxic >= 0").select("text", "toxic").mapInArrow(families, "text string, toxic int, family long").groupBy("family", "toxic").agg(F.min("text").alias("text"))
    seen = once.select("text", "toxic").mapInArrow(words, "start string, pos long, n long")
    per = seen.groupBy("start").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))
    odds = F.log((F.col("pos") + 0.5) / (F.col("n") - F.col("pos") + 0.5))
    likely = per.where(F.col("pos") >= min_families).withColumn("odds", odds).where("odds > 1")
    found: list[str] = []
    for r in likely.orderBy(F.desc(F.col("odds") * F.sqrt("pos")), F.length("start"), "start").limit(20 * learned).collect():
        if len(found) < learned and not any(r["start"].startswith(f) or f.startswith(r["start"]) for f in found):
            found.append(r["start"])
    starts = tuple(w for w in found if w not in FIXED_WORDS)
    parts = voters(starts)

    @task_of("toxicity")
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_slices(batch.column("text")):
                got = [read(t, starts, parts) for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)), batch.column("toxic").slice(lo, len(texts)).cast(pa.int32()), pa.array([v for _, v in got], pa.list_(pa.int32())), pa.array([list(c) for c, _ in got], pa.list_(pa.int32())), pa.array([list(c.values()) for c, _ in got], pa.list_(pa.int32()))], names=["doc_id", "toxic", "votes", "entry", "n"])

    got = sample.mapInArrow(measure, f"doc_id {kind}, toxic int, votes array<int>, entry array<int>, n array<int>").toArrow().to_pylist()
    got.sort(key=lambda r: (r["doc_id"], r["votes"], r["toxic"]))
    names = [*FIXED_WORDS, *starts]
    size = len(names)
    x = np.zeros((len(got) + size, size), np.float32)
    for i, r in enumerate(got):
        x[i, r["entry"]] = np.log1p(r["n"])
    x[len(got) :] = np.eye(size, dtype=np.float32) * np.log(3)  # each entry twice, and nothing else: what its voter would say
    alone = [read(f"{w} {w}".encode(), starts, parts)[1] for w in names]
    votes = np.asarray([*[r["votes"] for r in got], *alone], int)
    labelled = np.asarray([r["toxic"] for r in got] + [-1] * size, int)
    post, accuracy, corr = label_model(votes, labelled)
    weight = np.concatenate([np.ones(len(got)), np.full(size, 0.2)])
    y = post
    y[len(got) :] = np.clip(post[len(got) :], 0.05, 0.95)
    w, b = fit_logistic(x, y[:, None], weight, steps=600, penalty=2e-5, rate=1.5)
    return Model(starts, w[:, 0].astype(float), float(b[0]), accuracy, corr)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score of each row of ``docs`` (doc_id, text)."""
    kind = dict(docs.dtypes)["doc_id"]

    @task_of("toxicity")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, texts in text_slices(batch.column("text")):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)), pa.array(model.score(texts), pa.float64())], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
