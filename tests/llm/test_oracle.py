"""The queries with SQL against DuckDB: the smallest tables, and the awkward rows."""

import duckdb
import pytest

from murmur.llm import queries

from .helpers import saved
from .test_pii import ODD, corpus
from .test_warc import ROWS as PAGES


def rows(columns, found):
    return sorted((tuple("null" if v is None else round(v, 5) if isinstance(v, float) else str(v) for v in r) for r in found), key=repr)


def compare(spark, name, folder, tables):
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet{'' if folder.startswith('/root') else '/*.parquet'}')")
    got, want = queries.QUERIES[name](spark, folder), con.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert rows(columns, ([r[c] for c in columns] for r in got.collect())) == rows(columns, ([r[i] for i in at] for r in want.fetchall()))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_smallest_tables(spark, sf, name):
    compare(spark, name, sf, ["documents", "pages"])


@pytest.mark.parametrize("name", ["op10_pii", "op1_licences", "op8_sharding", "op3_mixing"])
def test_odd_documents(spark, tmp_path, name):
    docs = [(100 + i, t, "en", "a", 1, "", "") for i, t in enumerate(ODD)] + corpus() + [(None, "é x@y.z", None, None, None, None, None)]
    compare(spark, name, saved(spark, tmp_path, docs), ["documents"])


def test_odd_pages(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, url string, html string, digest string").write.parquet(f"{tmp_path}/pages.parquet")
    compare(spark, "op4_warc", str(tmp_path), ["pages"])
