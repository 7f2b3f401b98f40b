from __future__ import annotations

import pytest

import __spark_entry__ as entry
from lodestone.plans import queries

from .oracle import assert_same, views


@pytest.fixture(scope="module")
def duck(sf_dir):
    return views(sf_dir)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_agrees_with_sql(spark, sf_dir, duck, name):
    assert_same(entry.queries()[name](spark, sf_dir), duck, entry.oracle_sql()[name])


def test_entry_has_rows_in_a_stable_order(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "filename", "start", "end"]
    rows = df.collect()
    assert rows and rows == sorted(rows, key=lambda r: (r["filename"], r["start"], r["doc_id"]))


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
