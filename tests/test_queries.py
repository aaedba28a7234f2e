import math
import os

import duckdb
import pytest

import __spark_entry__ as driver
from rawloom.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for t in TABLES:
        path = f"{SF}/{t}.parquet"
        found.sql(f"create view {t} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return found


def plain(rows):
    return sorted(tuple("" if v is None or isinstance(v, float) and math.isnan(v) else repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    found = queries.QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    sql = queries.ORACLES[name]
    assert columns == sorted(duck.sql(sql).columns)
    want = duck.sql(f"select {', '.join(f'"{c}"' for c in columns)} from ({sql})").fetchall()
    assert plain(map(tuple, found.select(*[f"`{c}`" for c in columns]).collect())) == plain(want)


def test_checksum(spark):
    from rawloom.functions.blake3 import blake3
    from rawloom.session import table

    want = {r["doc_id"]: blake3((r["text"] or "").encode()) for r in table(spark, SF, "documents").select("doc_id", "text").collect()}
    assert {r["doc_id"]: r["checksum"] for r in queries.checksum_blake3(spark, SF).collect()} == want


def test_entry(spark):
    assert driver.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())
