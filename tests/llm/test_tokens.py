"""Token store and packing: exact against the library on whole texts."""

import glob
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from stathouse.llm import packing, queries, token_store
from stathouse.llm.tokens import WordEncoder, encoder

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def library(path):
    t = Tokenizer.from_file(path)  # as it comes: added tokens in texts are found
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("path", "spaced"), [(WORDS, False), (BYTES, True)])
def test_pieces_give_the_ids_of_the_whole(path, spaced):
    want, mine = library(path), encoder(path, spaced)
    piece = st.sampled_from(["it's", "I'LL", "don't", "  ", "\n\n", " \n", "\t", "\x1c", " ", "\x85", "é", "É", "ß", "İ", "Σ", "ς", "́", "日本", "²", "12", "!?", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "a<|endoftext|>b", "<|", "zorkelthions&&&", "Ġaġ", "ªº·µ", "dogs'", "café...", "x_y", "_z", "ǅ", "Ǿ9", "ÉCLAIRÉ", "\xad", "x", "Word", ".", ",\n", "\r\n"])

    @settings(max_examples=400, deadline=None)
    @given(st.one_of(st.lists(piece, max_size=12).map("".join), st.lists(piece, max_size=12).map(" ".join), st.text(max_size=20)))
    def same(text):
        text = text.encode("utf-8", "ignore").decode()
        assert np.frombuffer(mine.encode(text.encode()), "<u4").tolist() == want(text)

    same()


def test_capitals_and_marks_are_no_new_words():
    """What costs most is merging: once for each piece, whatever capitals, marks or texts it comes in."""
    want, mine, merged = library(WORDS), WordEncoder(WORDS), []
    merge = mine.tokenize
    mine.tokenize = lambda piece: merged.append(piece) or merge(piece)
    for text in ("Zorkel zorkel, ZORKEL", "ZORKEL! zorkeL", "zorkel's (Zorkel)"):
        assert np.frombuffer(mine.encode(text.encode()), "<u4").tolist() == want(text)
    assert sorted(merged) == ["!", "'s", "(", ")", ",", "zorkel"]


@pytest.mark.parametrize("text", ["Ɓ", "ƁA Ɔ Ɗaɗi ƎƏ", "İx KELVIN Å W\u030a É'S ½ x² «'s» ¿'T'll'LLama'd're'rest'v", "ǅ Ȿ Ⱥ ȶ ȷ"])
def test_letters_whose_lower_case_is_elsewhere(text):
    assert np.frombuffer(encoder(WORDS).encode(text.encode()), "<u4").tolist() == library(WORDS)(text)


def test_texts_of_a_slice_stay_apart():
    want, mine = library(WORDS), WordEncoder(WORDS)
    piece = st.sampled_from(["it's", "'", "'LL", "s", "\n", " ", "Éa", "日本", "²", "7", "!?", "<|endoftext|>", "\x85", "W\u030a", "Ɓ", "é", "x" * 70, "·"])
    raw = st.sampled_from([b"\xc3", b"\xa9", b"\xc3\xa9", b"'", b"ll", b""])

    @settings(max_examples=400, deadline=None)
    @given(st.lists(st.one_of(st.lists(piece, max_size=9).map(lambda x: "".join(x).encode()), st.binary(max_size=9), raw), min_size=1, max_size=6), st.sampled_from([4, 1 << 20]))
    def same(texts, chunk):
        mine.CHUNK = chunk  # a text alone is cut beyond it
        values, bounds = mine.encode_all(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]), np.array([1], "<u4").tobytes())
        assert [values[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [[*want(t.decode("utf-8", "replace")), 1] for t in texts]

    same()


def check_store(rows, texts):
    ids, start = library(WORDS), 0
    got = {r["doc_id"]: r for r in rows}
    for doc_id in sorted(texts):
        own = [*ids(texts[doc_id] or ""), 1]
        r = got[doc_id]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
        start += len(own)


def test_store(spark, data, texts):
    check_store(queries.op1_token_store(spark, data).collect(), texts)


def test_store_edges(edge, none):
    stored, _ = token_store.token_store(edge, WORDS)
    rows = sorted(token_store.digest(stored).collect(), key=lambda r: r["start"])
    assert len(rows) == edge.count() and rows[0]["doc_id"] is None
    assert [r["doc_id"] for r in rows[1:]] == sorted(r["doc_id"] for r in rows[1:])
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(rows, rows[1:], strict=False))
    assert {r["n_tokens"] for r in rows if r["doc_id"] in (4, 5, 6)} == {1}
    assert token_store.digest(token_store.token_store(none, WORDS)[0]).count() == 0


def test_store_prunes_by_id(spark, docs):
    _, path = token_store.token_store(docs, WORDS, stripe_bytes=1 << 16, row_stride=1000)
    few = token_store.read_tokens(spark, path, [3, 5])
    assert "In(doc_id, [3,5])" in few._jdf.queryExecution().toString()
    assert {r["doc_id"] for r in few.collect()} == {3, 5}


def test_store_has_stripes_and_bloom_filters(spark, docs):
    _, path = token_store.token_store(docs, WORDS, stripe_bytes=1 << 16, row_stride=1000)
    jvm, found, stripes = spark._jvm, 0, 0
    for f in glob.glob(f"{path.removeprefix('file:')}/*.orc"):
        options = jvm.org.apache.orc.OrcFile.readerOptions(spark._jsc.hadoopConfiguration())
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f), options)
        rows, lists = reader.rows(), reader.getStripes()
        for i in range(lists.size()):
            kinds = [str(x.getKind()) for x in rows.readStripeFooter(lists.get(i)).getStreamsList()]
            found += "BLOOM_FILTER_UTF8" in kinds and "ROW_INDEX" in kinds
            stripes += 1
    assert stripes == found >= 2


def check_pack(rows, texts):
    """rows of (key, piece); each key's ids come once, sequences are gapless."""
    ids, by_doc, by_sequence, padding, total = library(BYTES), defaultdict(list), defaultdict(list), 0, 0
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for doc_id, text in texts.items():
        own, at = np.array([*ids(text or ""), 0], "<u4"), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(own)
            assert r["ids_crc32"] == zlib.crc32(own[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(own)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= 1024
        total += at
        padding += 1024 - at if at & (at - 1) else 0
    assert padding <= 0.01 * total


def test_pack(spark, data, texts):
    check_pack(queries.op5_packing(spark, data).collect(), texts)


def test_pack_edges(edge, none):
    once = {r["doc_id"]: r["text"] for r in edge.where("doc_id < 9 OR doc_id > 9").collect()}
    check_pack(packing.pack(edge.where("doc_id < 9 OR doc_id > 9"), BYTES, hold=2048).collect(), once)
    assert packing.pack(none, BYTES).count() == 0
    assert {r["doc_id"] for r in packing.pack(edge, BYTES).collect()} == {r["doc_id"] for r in edge.collect()}


def test_packer_holds_only_what_waits():
    """Long documents with short tails: what is kept is bounded by tokens that wait, not by the documents they come from."""
    p = packing.Packer(hold=4096, step_tokens=4096)
    for i in range(3000):
        list(p.add(i, 30 * 1024 + 5 + i % 5))
        assert p.held <= 4096 + 1024


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 3000), max_size=60), st.integers(1, 6000))
def test_packer_keeps_every_token(lengths, hold):
    p, out = packing.Packer(hold=hold, step_tokens=4096), []
    for i, n in enumerate(lengths):
        out += p.add(i, n)
    out += p.end()
    seen, sizes, steps = defaultdict(list), defaultdict(int), defaultdict(int)
    for doc, start, length, seq, offset, size, tier, group in out:
        seen[doc].append((start, length))
        assert offset == sizes[seq]
        sizes[seq] += length
        steps[(tier, group)] += length
        assert sizes[seq] <= size <= 1024
    for i, n in enumerate(lengths):
        at = 0
        for start, length in sorted(seen[i]):
            assert start == at
            at += length
        assert at == n
    assert all(n & (n - 1) == 0 for n in sizes.values())
    assert all(n <= 4096 + 1024 for n in steps.values())
