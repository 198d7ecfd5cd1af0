"""Every query with SQL against DuckDB, over the smallest tables."""

import math

import duckdb
import pytest

from murmur import queries, step_queries  # noqa: F401  (adds its queries)

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def cells(row):
    return tuple("null" if v is None or (isinstance(v, float) and math.isnan(v)) else round(v, 5) + 0.0 if isinstance(v, float) else str(v) for v in row)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, sf, db, name):
    got = queries.QUERIES[name](spark, sf)
    want = db.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    left = sorted((cells(r[c] for c in columns) for r in got.collect()), key=repr)
    at = [want.columns.index(c) for c in columns]
    right = sorted((cells(r[i] for i in at) for r in want.fetchall()), key=repr)
    assert left == right


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["es_subspace", "local_analysis", "gram_matrix"])
def test_every_label_is_there(spark, sf, db, name):
    """Members of every label, not of one."""
    labels = {r[0] for r in db.sql("select distinct label from embeddings").fetchall()}
    got = queries.QUERIES[name](spark, sf)
    assert len(labels) > 1 and {r[0] for r in got.select("label").distinct().collect()} == labels
