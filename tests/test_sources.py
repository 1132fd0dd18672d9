import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stathouse.sources import documents, html, tables
from stathouse.streaming import streams


def test_documents(spark, tmp_path):
    log = {"__log__": True, "pitcher_name": "A", "pitch_app_id": "TOR201906170_123456", "pitch_count_by_inning": {"1": 2}, "pitchfx_log": [{"des": "Walk", "inning": 1}, {"des": "Single", "inning": 1}]}
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "one.json").write_text(json.dumps(log, indent=1))
    df = documents.read_documents(spark, [str(tmp_path / "a" / "one.json")], documents.PITCH_LOG)
    assert [r["des"] for r in documents.pitches_of(df).collect()] == ["Walk", "Single"]
    assert documents.read_first(spark, [str(tmp_path / "none"), str(tmp_path / "a")], "one.json", documents.PITCH_LOG).count() == 1
    assert documents.read_first(spark, [str(tmp_path / "none")], "one.json", documents.PITCH_LOG) is None
    assert [r["id"] for r in documents.listed_ids(spark, str(tmp_path / "a"), "^o").collect()] == ["one"]


def test_page():
    page = html.read_page("<title>T &amp; x</title><table><tr><th>a</th><th>b</th></tr><tr><td> 1 </td><td><b>2</b></td></tr></table><a href='/x?game=7'>l</a>")
    assert (page.title, page.links, page.rows) == ("T & x", ["/x?game=7"], [["a", "b"], ["1", "2"]])
    assert html.read_page(None).rows == []


def test_page_records(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table>"), (2, None)], "id int, html string")
    got = html.records(html.parse_pages(pages, "id", "html"), "id", ["a", "b"]).collect()
    assert [(r["id"], r["a"], r["b"]) for r in got] == [(1, "1", "2")]


def test_query_parameter(spark):
    got = spark.range(1).select(html.query_parameter(F.lit("http://x/y?a=1&game=gid_2&z="), "game"), html.query_parameter(F.lit("http://x/y"), "game")).first()
    assert tuple(got) == ("gid_2", None)


def test_csv(spark, tmp_path):
    schema = T.StructType.fromDDL("id int, `2B` int, name string")
    (tmp_path / "t.csv").write_text("id,2B,name\n 1, 3 , Al \n")
    r = tables.read_csv(spark, str(tmp_path / "t.csv"), schema, {"2B": "doubles"}).first()
    assert (r["id"], r["doubles"], r["name"]) == (1, 3, "Al")
    clean = tables.clean_values(spark.createDataFrame([(0, "a,b", True, "")], "n int, s string, b boolean, e string")).first()
    assert tuple(clean) == (None, "a;b", 1, None)


def test_append_is_idempotent(spark, tmp_path):
    df, path = spark.createDataFrame([(1,), (2,)], "id int"), str(tmp_path / "facts")
    tables.append_new(df, spark.createDataFrame([], "id int"), ["id"], path)
    tables.append_new(df, spark.read.parquet(path), ["id"], path)
    assert spark.read.parquet(path).count() == 2


def test_sync(spark):
    t = lambda rows: spark.createDataFrame(rows, "id string, length long, modificationTime int")
    got = {r["id"]: r["state"] for r in tables.files_to_sync(t([("a", 1, 5), ("b", 2, 5), ("c", 3, 5)]), t([("a", 1, 9), ("b", 9, 1)])).collect()}
    assert got == {"b": "outdated", "c": "missing"}


def test_stream_imports_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    schema = T.StructType.fromDDL("k int, n int, row long")
    spark.createDataFrame([(1, 1, 1), (1, 3, 2), (1, 2, 3), (2, 1, 4)], schema).coalesce(1).write.parquet(src)
    flagged = streams.flag_out_of_sequence(streams.new_files(spark, src, schema), "k", "n", "row")
    streams.run_available(flagged, out, ck)
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, 1, False), (1, 2, False), (1, 3, True), (2, 4, False)]
    spark.createDataFrame([(1, 3, 5), (2, 2, 6)], schema).coalesce(1).write.mode("append").parquet(src)
    streams.run_available(streams.flag_out_of_sequence(streams.new_files(spark, src, schema), "k", "n", "row"), out, ck)
    rows = {r["row"]: r["out_of_sequence"] for r in spark.read.parquet(out).collect()}
    assert len(rows) == 6 and rows[5] and not rows[6]
