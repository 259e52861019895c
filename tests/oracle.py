"""Compares a Spark result with DuckDB's on the same tables."""

import os

import duckdb


def connect(sf_dir):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = os.path.join(sf_dir, name)
        db.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return db


def cells(frame):
    def text(v):
        if v is None or v != v:
            return "null"
        v = v.item() if hasattr(v, "item") else v
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    return sorted(tuple(text(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).itertuples(index=False))


def assert_same(spark, sf_dir, query, sql):
    mine, theirs = query(spark, sf_dir).toPandas(), connect(sf_dir).sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert cells(mine) == cells(theirs)
