"""Rows of a Spark query and of its SQL on DuckDB over the same tables."""

from __future__ import annotations

from pathlib import Path


def connect(sf_dir: str):
    import duckdb

    connection = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        connection.sql(f"create view {p.stem} as select * from '{p}'")
    return connection


def check(spark, connection, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    found = [tuple(r[c] for c in columns) for r in df.collect()]
    result = connection.sql(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = [tuple(r[i] for i in at) for r in result.fetchall()]
    key = lambda row: tuple((v is None, v) for v in row)
    assert sorted(found, key=key) == sorted(want, key=key)
