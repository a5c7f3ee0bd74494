"""Every registered query against its DuckDB oracle on the sf0.001 tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from campusflow import plans  # noqa: E402
from oracle_check import compare, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = plans.QUERIES, plans.ORACLES


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle_or_a_reason():
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
    # the file catalogue lists files, not table rows: checked in test_catalogue_files
    assert set(QUERIES) - set(ORACLES) == {"catalogue_files"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, con, name, QUERIES[name], ORACLES[name], SF)
    assert r["status"] == "ok", r


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 1 and rows[0].total_students == 150


def test_catalogue_files(spark):
    rows = QUERIES["catalogue_files"](spark, SF).collect()
    assert len(rows) == 14 and all(r.accepted for r in rows)
    assert {r.file_name for r in rows} >= {"events.parquet", "lineitem.parquet"}
