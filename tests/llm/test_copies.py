"""Jaccard join and substring dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from compare import assert_same
from hypothesis import given, settings
from hypothesis import strategies as st

from stathouse.llm import jaccard_join, queries, substring_dedup
from stathouse.llm.common import WordHashes, flat_slices, mix64, rolling
from stathouse.llm.jaccard_join import Bands


def shingles(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute(rows):
    """component by row number."""
    sets, parent, holders = [shingles(t) for _, t in rows], list(range(len(rows))), defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    both = defaultdict(int)
    for i, s in enumerate(sets):
        for g in s:
            for j in holders[g]:
                both[(j, i)] += 1
            holders[g].append(i)
    for (i, j), n in both.items():
        if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
            parent[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return [(rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))]


def check(df):
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    got = sorted(tuple(r)[:3] for r in jaccard_join.jaccard_components(df).collect())
    assert got == sorted(brute(rows))


def test_join(docs):
    check(docs)


def test_join_of_edges(edge, none):
    check(edge.where("doc_id IS NOT NULL"))
    null = [r for r in jaccard_join.jaccard_components(edge).collect() if r["doc_id"] is None]
    assert [(r["n_shingles"], r["component_id"]) for r in null] == [(1, None)]
    assert jaccard_join.jaccard_components(none).count() == 0


def test_join_of_boilerplate_and_near_copies(spark):
    """Passages that many short documents share, chains of near copies, many sizes: the cases that leave classes poor in signatures."""
    rng = random.Random(4)
    passages = [[f"p{k}x{i}" for i in range(40)] for k in range(3)]
    rows = []
    for i in range(260):
        own = [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(2, 24))]
        parts = rng.sample(passages, rng.randrange(1, 3))
        rows.append((len(rows), " ".join([*own, *(w for p in parts for w in p)])))
    for size in (6, 8, 12, 30, 90, 300):
        words = [f"c{size}w{i}" for i in range(size)]
        for _ in range(25):
            words = words.copy()
            words[rng.randrange(size)] = f"e{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))


def test_one_of_each(docs, edge):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert sorted(r["doc_id"] for r in jaccard_join.one_of_each(docs).collect()) == sorted({c for _, _, c in brute(rows)})
    kept = jaccard_join.one_of_each(edge)
    assert kept.columns == edge.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 4, 5, 6, 7, 8, 9, 10, 11]


@settings(max_examples=150, deadline=None)
@given(st.integers(4, 900), st.integers(0, 2**32), st.floats(0, 0.12))
def test_linked_sets_share_a_signature(n, seed, part):
    """Unless a set is short of signatures, which is recorded."""
    rng, plan = np.random.default_rng(seed), Bands(80)
    a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
    drop = int(part * n)
    b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, drop, dtype=np.uint64)]))
    both = len(np.intersect1d(a, b))
    if 100 * both < 80 * (len(a) + len(b) - both) or np.array_equal(a, b):
        return
    flat, size = np.concatenate([a, b]), np.asarray([len(a), len(b)])
    spares, short = plan.spares(flat, size)
    if short.any():
        return
    sig, row = plan.signatures(flat, size)
    order = rng.permutation(np.unique(sig))  # any order of all signatures will do
    place = {int(s): i for i, s in enumerate(order)}
    kept = [set(), set()]
    for r in (0, 1):
        for parity in (0, 1):
            mine = sorted((int(s) for s in sig[row == r] if int(s) & 1 == parity), key=place.__getitem__)
            own = int(plan.of(size[r : r + 1])[0]) & 1 == parity
            spare = int(spares[0 if own else 1][r])
            kept[r] |= set(mine[: len(mine) - spare])
    assert kept[0] & kept[1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aAbBé \t\n"), max_size=40), min_size=1, max_size=12), st.integers(1, 64))
def test_shingle_sets(texts, chunk):
    """Sizes of sets and equality of words, whatever the slices, for short and long texts."""
    column = pa.array([None, *texts, "x"]).slice(1)
    reader = WordHashes(True)
    seen = {}
    for lo, data, offsets in flat_slices(column, chunk):
        flat, size = jaccard_join.shingle_sets(data, offsets, 5)
        assert size.tolist() == [len(shingles(t)) for t in column.to_pylist()[lo : lo + len(size)]]
        h, count = reader.read(data, offsets)
        words = [w for t in column.to_pylist()[lo : lo + len(size)] for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()]
        assert len(h) == len(words) == count.sum()
        for x, w in zip(h.tolist(), words, strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)


def test_word_hashes_of_a_long_text():
    reader = WordHashes()
    reader.CHUNK = 64
    text = b" ".join(b"w%d" % (i % 97) for i in range(500)) + b" " + b"y" * 300 + b"  z"
    whole, count = reader.read(np.frombuffer(text, np.uint8), np.asarray([0, len(text)]))
    assert count.tolist() == [502] and len(np.unique(whole)) == 99
    assert len(np.unique(whole[:97])) == 97 and (whole[:97] == whole[97:194]).all()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 2**64 - 1), max_size=90), st.sets(st.integers(0, 2**64 - 1), max_size=90), st.sets(st.integers(0, 2**64 - 1), max_size=90))
def test_parities_are_a_bound(a, b, both):
    x, y = sorted(a | both), sorted(b | both)
    p = jaccard_join.parities(np.asarray(x + y, np.uint64), np.asarray([len(x), len(y)]))
    assert int(np.bitwise_count((p[0] ^ p[1]).view(np.uint64)).sum()) <= len(set(x) ^ set(y))


def test_large_groups_are_cut_into_blocks(docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    check(docs)


@pytest.mark.parametrize("counted", [1, 4])
def test_hot_signatures_are_passed_on(spark, monkeypatch, counted):
    """The rows of a signature with more classes than are counted are all there."""
    monkeypatch.setattr(jaccard_join, "COUNTED", counted)
    rows = [(s, f) for s in range(5) for f in range(3 * s + 1) for _ in range(2)]
    got = {(r["sig"], r["fp"]) for r in jaccard_join._groups(spark.createDataFrame(rows, "sig long, fp long"), 2).collect()}
    assert got == {(s, f) for s, f in rows if s}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=60), st.integers(1, 60))
def test_rolling_hashes(values, k):
    h = np.asarray(values, np.uint64)
    got = rolling(h, k)
    assert len(got) == max(0, len(h) - k + 1)
    for i, x in enumerate(got):
        want = 0
        for v in values[i : i + k]:
            want = (want * 0x9E3779B97F4A7C15 + v) % (1 << 64)
        assert int(x) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=80), st.integers(1, 40))
def test_sliding_min(values, width):
    got = substring_dedup.sliding_min(np.asarray(values, np.uint64), width)
    assert got.tolist() == [min(values[i : i + width]) for i in range(len(values) - width + 1)]


def test_mix_is_one_to_one():
    x = np.arange(10_000, dtype=np.uint64)
    assert len(np.unique(mix64(x))) == len(x)


def dedup(rows, k):
    first = {}
    for doc_id, text in rows:
        w = (text or "").encode().split()
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(first.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        w, gone = (text or "").encode().split(), set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < doc_id:
                gone |= set(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df, **options):
    out = substring_dedup.substring_dedup(df, **options).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], substring_dedup.sha256_of(r["kept_text"])) for r in out), key=str)


def test_dedup_sql(spark, data):
    assert_same(queries.op10_substring_dedup(spark, data), queries.ORACLE_SQL["op10_substring_dedup"], data)


@pytest.mark.parametrize("log_bits", [26, 6])
def test_dedup_of_shared_passages(spark, log_bits):
    """Also with a sketch so small that it lets every window through."""
    rng = random.Random(2)
    passages = [[f"p{k}x{i}" for i in range(14)] for k in range(4)]
    rows = []
    for i in range(80):
        words = [f"v{rng.randrange(50)}" for _ in range(rng.randrange(0, 40))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = p
        rows.append((rng.randrange(60), " ".join(words) if i % 9 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert rows_of(df, k=8, log_bits=log_bits) == sorted(dedup(rows, 8), key=str)


def test_dedup_of_edges(edge, none):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    last = 1 << 62
    want = [(None if d == last else d, n, g, h) for d, n, g, h in dedup([(last if d is None else d, t) for d, t in rows], 50)]
    assert rows_of(edge) == sorted(want, key=str)
    assert substring_dedup.substring_dedup(none).count() == 0
