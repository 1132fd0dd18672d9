"""Exact, cached use of the public tokenizers: whole texts are cut where no token can cross, pieces are encoded once."""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from .common import SPACE_CHARS, BoundedCache, when_done

_LINES = re.compile(r"(?<=\S)\n(?=\S)")
_SPACES = re.compile(r" (?=\S)")


#: Words of these characters are in normal form, and everyone agrees on their classes and lower case.
_PLAIN = re.compile(r"[!-~\xa1-\xac\xae-\u012f\u0131-\u0236]+")
#: How the vocabularies' own patterns cut such words.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_SPACED_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+")


#: What byte-level vocabularies write for each byte: itself if it is a visible Latin-1 character, else the next free one from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
#: The same for whole characters.
_CHARS = {c: "".join(_BYTES.get(b, chr(b)) for b in chr(c).encode()) for c in range(0xA1, 0x237)}
#: Marks that are one piece behind a word, however many.
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: Entries of a generation of a cache: a worker's caches stay below some 100 MB.
CACHED = 120_000


class Encoder:
    """The library's tokenizer; pieces of plain characters go straight to its merges.  Texts that name one of its added tokens are encoded whole."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.raw = [t.content.encode() for t in added if not t.normalized]
        self.folded = [t.content.lower().encode() for t in added if t.normalized]

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, piece: str) -> bytes:
        """Of one piece of plain characters in normal form; those below 256 that aren't visible ASCII are written as their bytes are."""
        front, piece = (_BYTES[32], piece[1:]) if piece[0] == " " else ("", piece)
        if not piece.isascii():
            piece = piece.translate(_CHARS)
        return array("I", [t.id for t in self.tokenize(front + piece)]).tobytes()

    def names_added(self, text: bytes) -> bool:
        return any(t in text for t in self.raw) or bool(self.folded) and any(t in text.lower() for t in self.folded)


#: Kinds of bytes. Whole words with odd ones (and with digits of two bytes) are left to the library.
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)


def _kind(c: int) -> int:
    if chr(c) in SPACE_CHARS:
        return _SPACE
    if not _PLAIN.fullmatch(chr(c)) or c > 127 and regex.match(r"\p{N}", chr(c)):
        return _ODD
    return _LETTER if regex.match(r"\p{L}", chr(c)) else _DIGIT if 48 <= c < 58 else _MARK


#: By byte, and by both bytes of the characters that C2 to C8 begin; lower case of ASCII.
_ONE = np.asarray([_kind(b) if b < 128 else _ODD for b in range(256)], np.uint8)
_TWO = np.asarray([[_kind(64 * lead + b) for b in range(64)] for lead in range(2, 9)], np.uint8)
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)


class WordEncoder(Encoder):
    """For vocabularies that drop white space: all texts of a slice are cut into pieces at once, each distinct piece is encoded once.

    The normalizer (NFC, white space to one space, lower case by code point)
    and the splitting pattern never look across ASCII white space.  Words of
    plain characters are cut as the pattern does: contractions, runs of
    letters, single digits, runs of marks.  Any other word is one piece, and
    so is a text that names an added token.
    """

    #: Longer pieces are encoded each time: a cache has a bound of entries, not of bytes.
    LONGEST = 64
    #: One text beyond this is cut at white space, so that arrays stay small.
    CHUNK = 8 << 20

    def __init__(self, path: str):
        super().__init__(path)
        self.cache = BoundedCache(self._key, 2 * CACHED)

    def _key(self, key: bytes) -> bytes:
        if key.isalpha():  # ASCII letters
            return array("I", [t.id for t in self.tokenize(key.lower().decode())]).tobytes()
        text = key.decode("utf-8", "replace")
        low = text.lower()  # of some plain characters it isn't one (U+0181 and others)
        return self._piece(low) if _PLAIN.fullmatch(text) and _PLAIN.fullmatch(low) and _PIECES.fullmatch(low) else self._ids(text)

    @staticmethod
    def _cut(data: np.ndarray, at: np.ndarray, whole: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The bytes of all pieces, where each starts among them, and how many pieces each text has; texts in ``whole`` are one piece."""
        n, edge = len(data), np.zeros(len(data) + 3, bool)
        edge[at] = True
        kind, low = _ONE[data], np.append(_LOWER[data], np.zeros(3, np.uint8))
        lead = np.flatnonzero((data[:-1] >= 0xC2) & (data[:-1] <= 0xC8) & (data[1:] & 0xC0 == 0x80) & ~edge[1:n])
        kind[lead] = kind[lead + 1] = _TWO[data[lead] - 0xC2, data[lead + 1] & 63]
        for i in whole:
            kind[at[i] : at[i + 1]] = _ODD
        first = edge.copy()
        first[1:n] |= kind[1:] != kind[:-1]
        first[:n] |= kind == _DIGIT
        mark = np.flatnonzero(data == ord("'"))
        mark = mark[first[mark] & ~edge[mark + 1]]  # 's 't 'm 'd, 're 've 'll
        a, b = low[mark + 1], np.where(edge[mark + 2], 0, low[mark + 2])
        short, long = np.isin(a, np.frombuffer(b"stmd", np.uint8)), (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        first[mark[short | long] + 1] = False
        first[mark[short] + 2] = True
        first[mark[long] + 3] = True
        solid = kind != _SPACE
        if (odd := np.flatnonzero(kind == _ODD)).size:  # words with odd bytes: one piece, as they were
            begin, last = solid & edge[:n], solid & edge[1 : n + 1]
            begin[1:] |= solid[1:] & ~solid[:-1]
            last[:-1] |= solid[:-1] & ~solid[1:]
            begins, lasts = np.flatnonzero(begin), np.flatnonzero(last)
            words = np.unique(np.searchsorted(begins, odd, side="right") - 1)
            step = np.zeros(n + 1, np.int8)
            step[begins[words]] += 1
            step[lasts[words] + 1] -= 1
            inside = np.cumsum(step[:n], dtype=np.int8).view(bool)
            first[:n] &= ~inside | begin
            low[:n][inside] = data[inside]
        first = first[:n] & solid
        counts = np.asarray([np.count_nonzero(first[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], np.int64)
        return low[:n][solid], np.flatnonzero(first[solid]), counts

    def encode_all(self, data: np.ndarray, at: np.ndarray, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, end to end, each with ``end`` behind it, and where they start (and end) there; text i is ``data[at[i]:at[i + 1]]``."""
        added = self.names_added(data.tobytes())
        if len(at) == 2 and len(data) > 2 * self.CHUNK and not added:
            return self._encode_long(data, end)
        whole = [i for i in range(len(at) - 1) if self.names_added(data[at[i] : at[i + 1]].tobytes())] if added else []
        flat, starts, counts = self._cut(data, at, whole)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(flat)).astype(np.int32)), pa.py_buffer(flat)])
        coded = pieces.dictionary_encode()
        keys, cache = coded.dictionary, self.cache
        text, bounds = keys.buffers()[2].to_pybytes() if len(keys) else b"", np.frombuffer(keys.buffers()[1], np.int32)[: len(keys) + 1].tolist()
        ids = [cache[text[a:b]] if b - a <= self.LONGEST else self._key(text[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        cache.trim()
        ids.append(end)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        table = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
        stops = np.cumsum(counts)
        out = table.take(pa.array(np.insert(coded.indices.to_numpy(), stops, len(keys))))
        return out.values.to_numpy(), out.offsets.to_numpy()[np.append(0, stops + np.arange(1, len(at)))].astype(np.int64)

    def _encode_long(self, data: np.ndarray, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        out, lo = [], 0
        while lo < len(data):
            hi = min(lo + self.CHUNK, len(data))
            while hi < len(data) and not (gap := _ONE[data[hi : hi + self.CHUNK]] == _SPACE).any():
                hi = min(hi + self.CHUNK, len(data))
            hi += int(gap.argmax()) if hi < len(data) else 0
            out.append(self.encode_all(data[lo:hi], np.asarray([0, hi - lo]))[0] if hi - lo <= 2 * self.CHUNK else np.frombuffer(self._key(data[lo:hi].tobytes().strip(SPACE_CHARS.encode())), np.int32))
            lo = hi
        values = np.concatenate([*out, np.frombuffer(end, np.int32)])
        return values, np.asarray([0, len(values)])

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return self.encode_all(np.frombuffer(text, np.uint8), np.asarray([0, len(text)]))[0].tobytes()


class SpacedEncoder(Encoder):
    """For byte-level vocabularies whose pieces take one space in front: cut before a space, and around a newline, that stand before visible characters.

    The splitting pattern starts a piece at every such space, and takes a
    newline between two visible characters as a piece of its own.
    """

    def __init__(self, path: str):
        super().__init__(path)
        self.pieces = BoundedCache(self._piece, CACHED)
        self.first = BoundedCache(lambda word: self._spaced(word, ""), CACHED // 4)
        self.rest = BoundedCache(lambda word: self._spaced(word, " "), CACHED)
        self.newline = self._ids("\n")

    def _spaced(self, word: str, space: str) -> bytes:
        if word.isascii() and word.isalpha():
            return array("I", [t.id for t in self.tokenize(_BYTES[32] + word if space else word)]).tobytes()
        if not _PLAIN.fullmatch(word):
            return self._ids(space + word)
        stem = word.rstrip(_MARKS)
        if stem.isalpha():
            return self.pieces[space + stem] + (self.pieces[word[len(stem) :]] if len(stem) < len(word) else b"")
        return b"".join(map(self.pieces.__getitem__, _SPACED_PIECES.findall(space + word)))

    def encode(self, text: bytes) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.names_added(text):
            return self._ids(text.decode("utf-8", "replace"))
        return self._encode(text)

    def _encode(self, text: bytes) -> bytes:
        first, rest, out, text = self.first, self.rest, [], text.decode("utf-8", "replace")
        lines = [line.split() for line in text.split("\n")]
        if not all(lines) or "\n".join(map(" ".join, lines)) != text:  # white space other than single spaces and newlines between words
            lines = map(_SPACES.split, _LINES.split(text))
        for head, *words in lines:
            out.append((first[head] if head else b"") + b"".join(map(rest.__getitem__, words)))
        first.trim()
        rest.trim()
        self.pieces.trim()
        return self.newline.join(out)


@lru_cache(maxsize=2)
def encoder(path: str, spaced: bool = False) -> WordEncoder | SpacedEncoder:
    """One encoder for each Python worker."""
    return (SpacedEncoder if spaced else WordEncoder)(path)


when_done(encoder.cache_clear)
