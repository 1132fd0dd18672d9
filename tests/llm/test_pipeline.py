"""The pipeline against what its stages must do, stage by stage."""

from collections import Counter

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_copies import brute

from stathouse.llm import common, language_id, mixing, secret_scan


def test_stages(spark, data, docs):
    rows, columns = docs, docs.columns
    words = secret_scan.words_of(secret_scan.vocabularies(public_tokenizers.path))
    for (name, stage), follow in zip(corpus_pipeline.STAGES, [*corpus_pipeline.STAGES[1:], None], strict=True):
        out = stage(spark, rows, data).cache()
        before, after = [r for r in rows.collect()], [r for r in out.collect()]
        if follow:
            assert out.columns == columns
        if name == "language_id":
            assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if language_id.has_letter((r["text"] or "").encode()))
        elif name == "jaccard_join":
            assert sorted(r["doc_id"] for r in after) == sorted({c for _, _, c in brute([(r["doc_id"], r["text"]) for r in before])})
        elif name == "secret_scan":
            found = {r["doc_id"] for r in before if secret_scan.scan(r["text"].encode(), 10.0, words)[1]}
            text = {r["doc_id"]: r["text"] for r in before}
            assert {r["doc_id"] for r in after if r["text"] != text[r["doc_id"]]} == found
            assert len(after) == len(before) and all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "source_mix":
            plan = mixing.mix_plan(rows, whole=True).collect()
            assert Counter(r["doc_id"] for r in after) == Counter({r["doc_id"]: len(r["draws"]) for r in plan if r["draws"]})
            assert max(Counter(r["doc_id"] for r in after).values()) <= 2
        else:
            tokens = Counter()
            for r in after:
                tokens[r["doc_id"]] += r["length"]
            times = Counter(r["doc_id"] for r in before)
            assert all(tokens[r["doc_id"]] == times[r["doc_id"]] * r["doc_tokens"] for r in after)
        rows = out
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "secret_scan", "source_mix", "packing"]


def test_empty(spark, data, docs):
    rows = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, data)
    assert rows.count() == 0


def test_run_is_all_stages(spark, data):
    """From documents to sequences without gaps; every piece's document is one that the first stage keeps."""
    rows = corpus_pipeline.run(spark, data).collect()
    held = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert held.get(r["sequence_id"], 0) == r["offset"]
        held[r["sequence_id"]] = r["offset"] + r["length"]
    assert rows and all(n == 1024 or n & (n - 1) == 0 for n in held.values())


@pytest.mark.parametrize("name", ["language_id", "jaccard_join", "secret_scan", "packing"])
def test_batches_are_bounded_by_bytes(spark, data, name):
    """Once a stage is planned, no worker of the session gets more than some BATCH_BYTES at once (or one row), nor fewer rows in all."""
    rows = spark.range(4000, numPartitions=1).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("word "), "id"), F.when(F.col("id") == 7, 2_000_000).otherwise(500)).alias("text"))
    rows = rows.select("*", F.lit("en").alias("lang"), F.lit("a").alias("source"), F.length("text").cast("long").alias("n_chars"))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    spark.conf.unset(common._BATCH_BYTES)
    dict(corpus_pipeline.STAGES)[name](spark, rows.limit(3), data)
    found = rows.mapInArrow(sizes, "n long, size long").collect()
    assert sum(r["n"] for r in found) == 4000
    small = [r["size"] for r in found if r["size"] < 10_000_000]
    assert len(found) - len(small) == 1 and max(small) < 2 * common.BATCH_BYTES


def test_own_bound_of_a_session_stays(spark, none):
    spark.conf.set(common._BATCH_BYTES, 1 << 16)
    try:
        secret_scan.redact(none, ())
        assert spark.conf.get(common._BATCH_BYTES) == str(1 << 16)
    finally:
        spark.conf.unset(common._BATCH_BYTES)


def test_memory_of_another_operator_goes_back_first(monkeypatch):
    """What it left is given back to the system before the next operator takes memory of its own, not when its first task ends."""
    done = []
    monkeypatch.setattr(common, "_operator", ["another"])
    monkeypatch.setattr(common, "_releases", [lambda: done.append("freed")])
    monkeypatch.setattr(common, "give_back", lambda: done.append("given back"))
    list(common.task_of("this")(lambda batches: (done.append("run") or b for b in batches))(iter([1])))
    assert done == ["freed", "given back", "run", "given back"]
