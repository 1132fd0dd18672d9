"""Order-insensitive comparison with DuckDB."""

import glob
import os

import duckdb


def value(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(value(x) for x in v)
    if v is None or str(v) in ("<NA>", "nan", "NaT", "None"):
        return None
    return int(v) if isinstance(v, float) and v == int(v) and abs(v) < 1e15 else v


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(value(x) for x in r) for r in frame.itertuples(index=False, name=None)), key=str)


def tables(folder):
    db = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


def assert_same(spark_frame, sql, folder):
    got, want = spark_frame.toPandas(), tables(folder).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
