r"""Operator 4: secrets by fixed patterns, and by the guess cost of values in credential contexts.

Base kinds (leftmost, non-overlapping, per kind): ``assign`` (a credential
name, ``:`` or ``=``, a value of at least 6 characters), ``access`` (AKIA
keys of at least 20 characters), ``hex`` (at least 24 lower-case hex digits).

Method: a wider net of credential names, each followed by a separator and a
value of visible characters, proposes values.  A dynamic program finds the
cheapest way to guess a value as a sequence of spans: words (with capitals
and look-alike letters), dates, repeats, keyboard walks, and brute force for
the rest.  Words cost their rank: some common words of passwords first, then
the whole words of public vocabularies, whose files are a parameter and are
read once, by the driver; the workers get the words.  A value that costs at
least ``min_guesses`` and isn't inside a base span is added as kind ``guess``.

Positions are code points of the whole text, end exclusive.  Null text is
empty text: no spans.  A value of any length costs time in proportion to
its length.  Rows are independent; repeated rows repeat; an empty table
stays empty; other columns of the input are ignored by ``secret_spans`` and
kept by ``redact``, whose own columns replace those of the same name.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, map_batches, task_of, text_slices, when_done

KINDS = ("assign", "access", "hex", "guess")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: Bytes-level tests that any base or context match passes; they spare most texts the slower patterns.
_NAMES = re.compile(rb"(?i)pass|secret|token|api_?key|pwd|credential|auth|bearer|(?:api|private|access|client|signing)[_-]?key")
_LONG = re.compile(rb"AKIA|[0-9a-f]{24}")
_CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|(?:api|private|access|client|signing)[_-]?(?:key|secret))"
    r"[\"']?(?:\x20*(?::=|=>|[:=])\x20*|\x20+is\x20+)[\"']?([^\s\"'<>,;]{6,})", re.IGNORECASE | re.ASCII,
)

#: Common words of passwords, most common first (their rank is their cost); those of the vocabularies follow.
COMMON_WORDS = (
    "password", "qwerty", "letmein", "welcome", "admin", "login", "monkey", "dragon", "master", "princess", "sunshine",
    "football", "baseball", "shadow", "michael", "jennifer", "jordan", "superman", "batman", "iloveyou", "trustno",
    "hello", "freedom", "whatever", "secret", "test", "changeme", "default", "example", "sample", "user", "root",
    "guest", "access", "token", "demo", "love", "summer", "winter", "spring", "autumn", "january", "february", "march",
    "april", "june", "july", "august", "september", "october", "november", "december", "monday", "friday", "pass",
    "word", "key", "null", "none", "true", "false", "undefined", "your", "here", "insert", "replace", "placeholder",
    "value", "string", "company", "server", "database", "computer", "internet", "google", "the", "and", "for", "with",
)
#: Rows of a keyboard.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
_STEP = {(row[i], row[i + d]) for row in KEY_ROWS for d in (1, -1) for i in range(len(row)) if 0 <= i + d < len(row)}
_LEET = str.maketrans("430157@$!", "aeoistasi")
_DATE = re.compile(r"(?:(?:19|20)\d\d(?:[-./]?(?:0[1-9]|1[0-2])[-./]?(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])[-./]?(?:0[1-9]|1[0-2])[-./]?(?:19|20)\d\d)")


#: Files of vocabularies: a word counts if all files of a group have it.
Vocabularies = tuple[tuple[str, ...], ...]


class Words(NamedTuple):
    """The rank of each word, and the length of the longest."""

    rank: dict[str, int]
    longest: int


def vocabularies(path: Callable[[str], str]) -> Vocabularies:
    """The public files: English words that two of them share, and the words of one for many languages."""
    return (path("byte_bpe_50k.json"), path("word_bpe_49k.json")), (path("byte_bpe_multi_50k.tiktoken"),)


def _whole_words(path: str) -> dict[str, int]:
    """Lower-case words of at least four letters of one vocabulary, with their places in it.

    Ranks (``.tiktoken``) and byte-level tokens (``.json``) mark the front of a
    word by a space, the others its end.  Only ASCII words of the latter two
    are read, as their other characters stand for bytes.
    """
    found: dict[str, int] = {}
    if path.endswith(".tiktoken"):
        with open(path, "rb") as file:
            tokens = ((base64.b64decode(t).decode("utf-8", "replace"), int(i)) for t, i in map(bytes.split, file))
            words = [(t[1:], i) for t, i in tokens if t.startswith(" ")]
    else:
        with open(path, encoding="utf-8") as file:
            tokens = json.load(file)["model"]["vocab"].items()
        words = [(t[1:] if t[0] == "\u0120" else t[:-4], i) for t, i in tokens if t.isascii() and t.endswith("</w>") or t[0] == "\u0120" and t[1:].isascii()]
    for word, i in words:
        word = word.lower()
        if len(word) >= 4 and word.isalpha():
            found[word] = min(i, found.get(word, i))
    return found


@lru_cache(maxsize=2)
def words_of(groups: Vocabularies) -> Words:
    """COMMON_WORDS, then the words of the vocabularies by their least place in the first file of a group that has them; equal places by the word."""
    place: dict[str, int] = {}
    for first, *others in groups:
        rest = [_whole_words(path) for path in others]
        for word, i in _whole_words(first).items():
            if all(word in r for r in rest):
                place[word] = min(i, place.get(word, i))
    return ranked("\n".join(dict.fromkeys([*COMMON_WORDS, *sorted(place, key=lambda w: (place[w], w))])))


@lru_cache(maxsize=2)
def ranked(lines: str) -> Words:
    """The words of these lines, the first of rank 1: what a Python worker makes of the driver's list, without the files."""
    every = lines.split("\n")
    return Words({w: i + 1 for i, w in enumerate(every)}, max(map(len, every)))


when_done(ranked.cache_clear)


def _lines_of(groups: Vocabularies) -> str:
    """What ``ranked`` reads; the files' memory is given back."""
    lines = "\n".join(words_of(groups).rank)
    give_back()
    return lines


def _class_size(c: str) -> int:
    return 10 if c.isdigit() else 26 if c.isascii() and c.isalpha() else 33 if c.isascii() else 100


def guess_cost(value: str, words: Words) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` needs.

    best[i] is the cheapest cost of the first i characters.  Each span adds
    its own log cost; brute force adds one character at a time.  A run of one
    character, or of equal blocks, costs its block and its count, whatever
    the length of either.
    """
    n, low = len(value), value.lower()
    plain = low.translate(_LEET)
    best = [0.0] + [math.inf] * n

    def relax(i: int, j: int, cost: float) -> None:
        if best[i] + cost < best[j]:
            best[j] = best[i] + cost

    run_to, walk_to = list(range(1, n + 1)), list(range(1, n + 1))
    for i in range(n - 2, -1, -1):
        if low[i] == low[i + 1]:
            run_to[i] = run_to[i + 1]
        if (low[i], low[i + 1]) in _STEP:
            walk_to[i] = walk_to[i + 1]
    last: dict[str, int] = {}
    copied: dict[int, int] = {}
    for i in range(n):
        relax(i, i + 1, math.log10(_class_size(value[i])))
        for j in range(i + 3, min(n, i + words.longest) + 1):
            rank = words.rank.get(low[i:j]) or words.rank.get(plain[i:j])
            if rank:
                upper, leet = value[i:j] != low[i:j], low[i:j] != plain[i:j]
                relax(i, j, math.log10(rank * (2 if upper else 1) * (4 if leet else 1) + 1))
        if found := _DATE.match(low, i):
            relax(i, found.end(), math.log10(120 if found.end() - i == 4 else 365 * 120))
        if run_to[i] - i >= 3:
            relax(i, run_to[i], math.log10(_class_size(value[i]) * (run_to[i] - i)))
        # What stands ``back`` characters before, again; each run is measured once.
        for back in {2, 3, 4, i - last.get(value[i : i + 4], i)}:
            if 0 < back <= i:
                if copied.get(back, 0) <= i:
                    end = i
                    while end < n and value[end] == value[end - back]:
                        end += 1
                    copied[back] = end
                again = copied[back] - i
                if again >= back:
                    relax(i, i + again // back * back, math.log10(1 + again // back))
                    relax(i, i + again, math.log10(1 + again / back))
        last[value[i : i + 4]] = i
        if walk_to[i] - i >= 3:
            relax(i, walk_to[i], math.log10(47 * 4 * (walk_to[i] - i)))
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def guess_spans(text: str, base: list[tuple[int, int, int]], min_guesses: float, words: Words) -> list[tuple[int, int, int]]:
    out = []
    for m in _CONTEXT.finditer(text):
        lo, hi = m.span(1)
        if any(a <= lo and hi <= b for a, _, b in base):
            continue
        if guess_cost(m[1], words) >= min_guesses:
            out.append((lo, 3, hi))
    return out


def _named(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def scan(text: bytes | None, min_guesses: float, words: Words) -> tuple[list, list]:
    """Base spans and all spans of one text."""
    if not text or not (_NAMES.search(text) or _LONG.search(text)):
        return [], []
    whole = text.decode("utf-8", "replace")
    base = base_spans(whole)
    return base, sorted(base + guess_spans(whole, base, min_guesses, words))


def secret_spans(docs: DataFrame, groups: Vocabularies, min_guesses: float = 10.0) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess of each row of ``docs`` (doc_id, text); ``groups`` as of ``vocabularies``."""
    lines = _lines_of(groups)

    @task_of("secret_scan")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ranked(lines)
        for batch in batches:
            for lo, texts in text_slices(batch.column("text")):
                both = [scan(t, min_guesses, words) for t in texts]
                counts = [pa.array([sum(k == kind for _, k, _ in every) for _, every in both], pa.int64()) for kind in range(4)]
                sums = [hashlib.sha256(_named(base).encode()).hexdigest() for base, _ in both]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, len(texts)), *counts[:3], pa.array(sums, pa.string()), pa.array([_named(every) for _, every in both], pa.string()), counts[3]], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"])

    kind = dict(docs.dtypes)["doc_id"]
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long")


def redact(docs: DataFrame, groups: Vocabularies, mark: str = "[SECRET]", min_guesses: float = 10.0) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by ``mark`` (overlapping spans by one mark), and n_chars made to fit; all rows stay."""
    lines = _lines_of(groups)

    def clean(text: bytes | None, words: Words) -> str | None:
        _, spans = scan(text, min_guesses, words)
        if text is None or not spans:
            return None if text is None else text.decode("utf-8", "replace")
        whole, out, at = text.decode("utf-8", "replace"), [], 0
        for lo, _, hi in spans:
            if lo >= at:
                out += [whole[at:lo], mark]
            at = max(at, hi)
        return "".join([*out, whole[at:]])

    @task_of("secret_scan")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = ranked(lines)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for lo, texts in text_slices(batch.column("text")):
                piece = batch.slice(lo, len(texts))
                yield piece.set_column(at, "text", pa.array([clean(t, words) for t in texts], pa.string()))

    out = map_batches(docs, run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
