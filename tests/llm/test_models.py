"""Language, toxicity and neighbours: held-out accuracy and recall against brute force; edges."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from stathouse.llm import language_id, multi_index, queries, toxicity


def test_language(spark, data, docs, edge, none):
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = queries.op7_language_id(spark, data).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([lang[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    model = language_id.fit(docs)
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.identify(edge, model).collect()}
    assert {(4, "und"), (5, "und"), (6, "und")} <= got and (1, "und") not in got
    kept = language_id.accepted(edge, model)
    assert kept.columns == edge.columns and kept.count() == edge.count() - 3
    assert language_id.identify(none, model).count() == 0


def test_language_without_labels(edge, none):
    model = language_id.fit(none)
    assert {r["lang_pred"] for r in language_id.identify(edge, model).collect()} == {"und"}
    one = language_id.fit(edge.where("lang = 'en'"))
    assert {r["lang_pred"] for r in language_id.identify(edge.where("doc_id IN (1, 7)"), one).collect()} == {"en"}


def test_codewords_are_apart():
    for n in (2, 3, 4, 9):
        code = language_id.codewords(n, 15)
        assert min((code[i] != code[j]).sum() for i in range(n) for j in range(i)) >= 4


def test_toxicity(spark, data, docs, edge, none):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    toxic = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    rows = queries.op8_toxicity(spark, data).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    known = [r for r in rows if r["doc_id"] in toxic]
    assert all((r["score"] >= 0.5) == (r["predicted"] == 1) for r in rows) and known
    big = queries.op8_toxicity(spark, data.replace("sf0.001", "sf0.1"))
    truth = spark.read.parquet(f"{data.replace('sf0.001', 'sf0.1')}/labels.parquet").select("doc_id", "toxic")
    n = big.where("held_out").join(truth, "doc_id").agg(F.sum(F.col("toxic") * F.col("predicted")).alias("hit"), F.sum("toxic").alias("bad"), F.sum("predicted").alias("said")).first()
    print("held-out toxic", n)
    assert n["hit"] >= 0.85 * n["bad"] and n["hit"] >= 0.95 * n["said"]
    model = toxicity.fit(docs, labels)
    extra = spark.createDataFrame([(1, "you stupid worthless idiot, what a pathetic moron"), (2, "a calm and friendly letter about the garden")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(extra, model).collect()}
    assert score[1] > 0.5 > score[2]
    got = toxicity.score(edge, model).collect()
    assert len(got) == edge.count() and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(none, model).count() == 0


def test_toxicity_without_labels(docs, spark):
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert 0 <= model.score([b"idiot idiot", b""])[0] <= 1


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    votes = np.stack([np.where(rng.random(4000) < a, np.where(y, 1, -1), np.where(y, -1, 1)) for a in (0.95, 0.8, 0.6)], axis=1)
    votes = np.hstack([votes, votes[:, :1]])  # a voter that repeats another
    labels = np.where(rng.random(4000) < 0.1, y.astype(int), -1)
    post, accuracy, corr = toxicity.label_model(votes, labels)
    assert ((post > 0.5) == y).mean() > 0.93
    assert accuracy[0] > accuracy[1] > accuracy[2]
    assert corr[0, 3] > 0.5 > corr[1, 2]


def test_neighbours(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet").toArrow()
    ids, x = table.column("vec_id").to_numpy(), np.asarray(table.column("embedding").to_pylist(), np.float32).astype(float)
    got = {}
    for r in queries.op9_multi_index(spark, data).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    recall = []
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        want = set(ids[np.lexsort((ids, -s))[:20]])
        rows = sorted(got[ids[i]])
        assert [r[0] for r in rows] == list(range(1, 21))
        assert all(a[2] > b[2] or a[2] == b[2] and a[1] < b[1] for a, b in zip(rows, rows[1:], strict=False))
        assert all(abs(r[2] - s[np.flatnonzero(ids == r[1])[0]]) < 1e-9 for r in rows)
        recall.append(len(want & {r[1] for r in rows}) / 20)
    assert np.mean(recall) >= 0.9


def test_neighbours_of_edges(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [3.0, 0.0]), (7, [3.0, 0.0]), (8, [1.0]), (9, [float("inf"), 0.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    out = multi_index.nearest(df, F.col("vec_id") % 20 == 0, k=20).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in sorted(out, key=lambda r: r["rank"])] == [(0, 1, 6, 3.0), (0, 2, 7, 3.0), (0, 3, 1, 0.5)]
    assert multi_index.nearest(df.limit(0), F.lit(True)).count() == 0
    assert multi_index.nearest(df, F.lit(False)).count() == 0


def test_probes_reach_every_code_in_the_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 16, (400, 8)).astype(np.uint16)
    queries_ = codes[:20] ^ (rng.random((20, 8)) < 0.5) * (1 << rng.integers(0, 16, (20, 8))).astype(np.uint16)
    index = multi_index.SubstringIndex(codes)
    for radius in (0, 3, 17, 40, 60):
        far = multi_index.hamming(queries_, codes)
        for i, q in enumerate(queries_):
            near = set(np.flatnonzero(far[i] <= radius))
            assert near <= set(index.probe(q, radius)) and near == set(index.within(q, radius))
    assert len(index.probe(queries_[0], 3)) < 20  # few codes are touched where the radius is small
