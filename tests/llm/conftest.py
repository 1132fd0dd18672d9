import pytest

#: Nulls, empty and blank texts, repeated rows, equal ids, a very long text, near copies, and columns that clash with names the operators use.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, fp long, _id string, score double, _row int"
PROSE = " ".join(f"word{i} and more of it." for i in range(60))


def edge_rows():
    long = " ".join(f"w{i % 9000}" for i in range(120_000))
    texts = [
        (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, PROSE + " tail", "en", None), (4, None, "en", "b"), (5, "", None, "b"),
        (6, " \t\n ", None, "c"), (7, long, "xx", "c"), (8, "a b", "en", "a"), (9, "a b", "en", "a"), (9, "a b", "en", "a"),
        (9, "other text under the same id", "en", "a"), (None, "no id here at all", None, None), (10, "été \U0001f600 naïve", "fr", "a"),
        (11, "line\nline\nline\n\n line", "en", "z"),
    ]
    return [(i, t, lang, s, None if t is None else len(t), 1, 2, "x", 0.5, 3) for i, t, lang, s in texts]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
