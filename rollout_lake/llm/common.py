"""Text rules, written intermediates and the joins shared by the operators of this package."""

from __future__ import annotations

import gc
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rollout_lake.session import scratch_path

BLANKS = " \t\n\x0b\x0c\r"
"""The characters of ``[\\x20\\x09-\\x0D]``."""

SPLIT_BLANKS = r"[\x20\x09-\x0D]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

HOT_PARTS = 1024
"""A key is hot when it holds more than 1/HOT_PARTS of all rows; at most HOT_PARTS keys can be."""

NO_ID = -(2**63)
"""Stands for a missing document id, below every other."""


def written(df: DataFrame, name: str, block_bytes: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder, read back: cuts the lineage, survives lost executors.

    ``block_bytes`` bounds what a task that writes wide rows holds of them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write if block_bytes is None else df.write.option("parquet.block.size", block_bytes)
    writer.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more, and the shuffle files of finished queries."""
    for table in tables:
        jvm = table.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(table._written_to)
        path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        drop_shuffles(tables[0].sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    """Delete the shuffle files of finished queries: Spark does so once the driver's garbage collector has met them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def whole(text: Column) -> Column:
    """The text, with a missing one taken as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; plain ``lower`` where every character is ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` applied to a value that is computed once, also where it stands in a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """The maximal runs of other characters than blanks."""
    bare = F.btrim(whole(text), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPLIT_BLANKS))


def rows_each(df: DataFrame, weight: str | None = None) -> int:
    """The number of rows, or the sum of a column, of a written table."""
    what = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return int(df.agg(what.alias("n")).first()["n"] or 0)


def join_hot(rows: DataFrame, table: DataFrame, on: list[tuple[str, str]], count: str, how: str = "left",
             hot_parts: int = HOT_PARTS) -> DataFrame:
    """Join rows to a written table with one row a key, where one key may hold a third of all rows.

    ``on`` pairs columns of ``rows`` with columns of ``table``, and ``count`` is the table's
    column with the number of rows a key has. Hot keys, at most ``hot_parts`` of them,
    meet their rows in a broadcast; the rows of hot keys are dealt out by a hash of all their
    columns in the shuffle that joins the others. The table's columns, key columns apart, are added.
    """
    keys = [b for _, b in on]
    kept = [c for c in table.columns if c not in keys]
    total = rows_each(table, count)
    hot = table.where(F.col(count) * hot_parts > total)
    packed = F.struct(*[F.col(c) for c in kept]) if kept else F.struct(F.lit(1).alias("one"))
    hot = hot.select(*[F.col(b).alias(f"__g{i}") for i, b in enumerate(keys)], packed.alias("__hot"))
    cold = table.select(*[F.col(b).alias(f"__c{i}") for i, b in enumerate(keys)], packed.alias("__cold"),
                        F.lit(0).cast("bigint").alias("__slot"))
    is_hot, is_cold = F.lit(True), F.lit(True)
    for i, (a, _) in enumerate(on):
        is_hot &= F.col(a) == F.col(f"__g{i}")
        is_cold &= F.col(a) == F.col(f"__c{i}")
    spread = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 40)) + 1
    salted = rows.join(F.broadcast(hot), is_hot, "left").withColumn(
        "__salt", F.when(F.col("__hot").isNull(), F.lit(0).cast("bigint")).otherwise(spread)
    )
    joined = salted.join(cold, is_cold & (F.col("__salt") == F.col("__slot")), "left")
    found = F.coalesce(F.col("__hot"), F.col("__cold"))
    if how == "inner":
        joined = joined.where(found.isNotNull())
    return joined.select(*rows.columns, *[found[c].alias(c) for c in kept])
