"""Every query of the engine against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__
from lodestone import queries as core

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
#: Long iterations, which tests of the iteration itself cover.
SLOW = {"pagerank_part_supplier"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(frame, columns):
    frame = frame[columns]
    return sorted(map(repr, frame.astype(object).where(frame.notna(), None).values.tolist()))


def same(spark, duck, name, queries, oracles):
    got, want = queries[name](spark, SF).toPandas(), duck.sql(oracles[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(core.ORACLES) - SLOW))
def test_query_matches_sql(spark, duck, name):
    same(spark, duck, name, core.QUERIES, core.ORACLES)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 25
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
