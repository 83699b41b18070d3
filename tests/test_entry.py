"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
from check_oracles import TABLES, difference

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return con


def test_every_query_of_the_library_has_sql():
    assert set(SQL) <= set(entry.queries())
    assert set(entry.QUERIES) <= set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, tables, name):
    mine = entry.queries()[name](spark, FOLDER).toPandas()
    assert difference(mine, tables.execute(SQL[name]).df()) == ""


def test_word_vector_queries_answer_every_query(spark):
    run = entry.queries()["w2v_qe_search"](spark, FOLDER).toPandas()
    assert run.query_id.nunique() == 40
    assert run.groupby("query_id")["rank"].max().max() <= 10


def test_entry(spark):
    assert entry.entry(spark).count() > 0
