"""Spark's rows against DuckDB's."""

from __future__ import annotations

import os
from glob import glob

import duckdb


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for p in glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def _cell(x):
    return ("",) if x is None else (round(x, 6),) if isinstance(x, float) else (str(x),)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(_cell(r[k]) for k in order) for r in rows)


def assert_same(df, c: duckdb.DuckDBPyConnection, sql: str) -> None:
    theirs = c.execute(sql)
    names = [d[0] for d in theirs.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(names, theirs.fetchall())
