"""Every registered query against its DuckDB statement (sf0.001, whole tables, exact floats)."""

import os

import duckdb
import pytest

os.environ["NAVLENS_EXACT"] = "1"   # floats must match bit for bit, not only to 9 digits

import __spark_entry__ as entry
from navlens.plans.catalog import REGISTRY
from tools.oracle_check import TABLES, rows_of

SF = "/root/testdata/sf0.001"
# the catalogue's queries; those of the training-data package are tested with it
ORACLES = {k: v for k, v in entry.oracle_sql().items() if k in REGISTRY}
QUERIES = {k: v for k, v in entry.queries().items() if k in REGISTRY}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def test_every_query_is_registered_with_most_having_an_oracle():
    assert len(QUERIES) >= 80
    missing = set(QUERIES) - set(ORACLES)
    assert missing <= {"file_listing", "release_payload_json"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_duckdb(spark, con, name):
    sdf = QUERIES[name](spark, SF)
    s_rows = [tuple(r) for r in sdf.collect()]
    res = con.execute(ORACLES[name])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(sdf.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert rows_of(sdf.columns, s_rows) == rows_of(d_cols, d_rows)


def test_entry_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["visit_id", "unique_pages", "hits", "date_time_visit"]
    assert df.count() > 0
