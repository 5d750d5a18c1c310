"""All registered queries."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from . import answers, evaluation, flagship, policy, preparation, rewards, sequences, storage, trajectories  # noqa: F401
from .registry import ORACLES, QUERIES, Tables


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES[name](Tables(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: partial(_run, name) for name in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
