"""A sample of registered queries against their SQL, and rules every query follows."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["tx8_board_key", "nu9_intensities", "ag4_entity_years", "st2_median", "wn3_year_over_year", "jn6_board_resolution", "sc4_peer_metrics", "rp1_school_list_page", "fs4_lookup", "src6_unified_layouts"]


@pytest.fixture(scope="module")
def con():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    want = con.sql(entry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    got_rows = sorted((tuple(None if v != v else v for v in (r[c] for c in order)) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in order]
    assert got_rows == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.limit(5).count() > 0 and "eui_percentile" in df.columns


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
