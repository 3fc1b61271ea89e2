"""Each registered key-value query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from stratakv import queries as kv

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", list(kv.QUERIES))
def test_query(spark, duck, name):
    got = kv.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in columns)) for r in got.collect())
    duck.execute(f"CREATE OR REPLACE TABLE want AS {kv.SQL[name]}")
    assert sorted(r[0] for r in duck.execute("DESCRIBE want").fetchall()) == columns
    assert rows == sorted(map(repr, duck.execute(f"SELECT {', '.join(columns)} FROM want").fetchall()))


def _odd(duck_sql: str, folder, table: str, query: str):
    """A table made by SQL, and the answer to a query's SQL on it."""
    c = duckdb.connect()
    c.execute(f"COPY ({duck_sql}) TO '{folder}/{table}.parquet'")
    c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return c.execute(kv.SQL[query]).fetchall()


def test_byte_order_of_null_urls(spark, tmp_path):
    urls = "['b', 'a', NULL, '', 'é', 'a' || chr(0), chr(0), '日本']"
    want = _odd(f"SELECT i AS page_id, {urls}[1 + i] AS url FROM range(8) t(i)", tmp_path, "pages", "byte_order_urls")
    got = kv.QUERIES["byte_order_urls"](spark, str(tmp_path)).select("page_id", "url_hex", "nth").collect()
    assert sorted(want) == sorted(map(tuple, got))


def test_byte_order_of_equal_urls(spark, tmp_path):
    """The SQL leaves open which of equal urls comes first: ranks and rows are its own, ties go by page_id."""
    want = _odd("SELECT 399 - i AS page_id, ['b', 'a', NULL, ''][1 + i % 4] AS url FROM range(400) t(i)", tmp_path, "pages", "byte_order_urls")
    got = kv.QUERIES["byte_order_urls"](spark, str(tmp_path)).select("page_id", "url_hex", "nth").collect()
    assert {r[:2] for r in want} == {(r.page_id, r.url_hex) for r in got}
    assert {r[1:] for r in want} == {(r.url_hex, r.nth) for r in got}
    got.sort(key=lambda r: r.nth)
    assert all(a.page_id < b.page_id for a, b in zip(got, got[1:]) if a.url_hex == b.url_hex)


def test_signed_order_of_null_keys(spark, tmp_path):
    want = _odd("SELECT unnest([900, NULL, 5, 701]::BIGINT[]) AS c_custkey", tmp_path, "customer", "signed_key_order")
    got = kv.QUERIES["signed_key_order"](spark, str(tmp_path)).select("id", "key_hex", "nth").collect()
    assert sorted(want, key=repr) == sorted(map(tuple, got), key=repr)
