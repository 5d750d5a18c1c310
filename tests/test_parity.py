"""Registered queries against their SQL counterparts at the smallest scale."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry  # noqa: E402
from parity import TABLES, compare  # noqa: E402

from rollout_lake.plans import catalog  # noqa: E402

QUERIES = catalog.queries()
ORACLES = catalog.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for name in TABLES:
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return c


def test_every_counterpart_has_a_query():
    assert set(ORACLES) == set(QUERIES) and len(QUERIES) > 200
    assert set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, con, name):
    verdict, _ = compare(spark, con, sf, name, QUERIES[name], ORACLES[name])
    assert verdict.startswith("ok"), verdict


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert {r["data_source"] for r in rows} == {"set/O.parquet", "set/F.parquet"}
