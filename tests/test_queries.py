"""Every query with SQL equals DuckDB on the same tables; the others are run and have rows."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quarry.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([row[i] for i in order]) for row in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    if name not in ORACLES:
        assert rows
        return
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(names) == sorted(frame.columns)
    assert canonical(frame.columns, rows) == canonical(names, want)


def test_entry_has_rows(spark):
    assert os.path.isdir(SF) and entry.entry(spark).count() > 0


def test_oracles_name_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
