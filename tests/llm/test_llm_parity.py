"""The package's queries against their SQL counterparts at the smallest scale."""

from __future__ import annotations

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from parity import TABLES, compare  # noqa: E402

from rollout_lake.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    verdict, _ = compare(spark, con, sf, name, QUERIES[name], ORACLES[name])
    assert verdict.startswith("ok"), verdict
