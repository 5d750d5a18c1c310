"""The query registry and the table handle each query receives."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import views


class Tables:
    """Lazy access to the parquet tables of one scale folder and the views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def spread(self, df: DataFrame) -> DataFrame:
        """Rows over all cores when the files give fewer partitions than there are.

        For work that is heavy per row: a file with one row group is one task. Large
        tables have enough splits and pass through unchanged.
        """
        wanted = self.spark.sparkContext.defaultParallelism
        return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df

    def view(self, name: str) -> DataFrame:
        source, exprs, where = views.VIEWS[name]
        base = self.view(source) if source in views.VIEWS else self.table(source)
        if name in views.HEAVY:
            base = self.spread(base)
        out = base.selectExpr(*exprs)
        return out.where(where) if where else out

    def sequences(self) -> DataFrame:
        return views.sequences(self.table("embeddings"))


QUERIES: dict[str, Callable[[Tables], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a query under a name, with the SQL that must give the same rows."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = views.expand(oracle)
        return fn

    return wrap


def r6(expr: str, digits: int = 6) -> str:
    """SQL text that rounds and turns a negative zero into zero."""
    return f"(round({expr}, {digits}) + 0.0)"
