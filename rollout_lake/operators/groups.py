"""Group statistics joined back to their rows without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_PARTS = 1024
"""A key is hot when it holds more than 1/HOT_PARTS of all rows, so at most HOT_PARTS keys are."""


def attach_group_stats(
    df: DataFrame,
    keys: Sequence[str],
    aggs: Sequence[Column],
    spread_by: Sequence[str] = (),
    hot_parts: int = HOT_PARTS,
) -> DataFrame:
    """Add per-group aggregates to every row; they are computed with partial aggregation."""
    stats = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *aggs)
    return _join_by_weight(df, stats, keys, spread_by, hot_parts)


def lookup_join(
    df: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str] = (),
    hot_parts: int = HOT_PARTS,
) -> DataFrame:
    """Left join to a table with one row per key, safe for keys that hold many rows of ``df``."""
    weights = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    return _join_by_weight(df, lookup.join(weights, list(keys)), keys, spread_by, hot_parts)


def _join_by_weight(
    df: DataFrame, stats: DataFrame, keys: Sequence[str], spread_by: Sequence[str], hot_parts: int
) -> DataFrame:
    """Join rows to their key's statistics, given each key's row count ``__n``.

    The rows of hot keys get their statistics from a broadcast of at most
    ``hot_parts`` rows and are then spread over the shuffle by a salt; all other keys
    meet their statistics in an equi-join, where no key is large.
    """
    cols = df.columns
    names = [c for c in stats.columns if c not in keys and c != "__n"]
    limit = df.agg(F.count(F.lit(1)).alias("t")).scalar() / F.lit(hot_parts)
    # both sides keep the row count, so that they read one and the same exchange
    packed = F.struct("__n", *[F.col(c) for c in names])
    hot = stats.where(F.col("__n") > limit).select(
        *[F.col(k).alias(f"__h{i}") for i, k in enumerate(keys)], packed.alias("__hot")
    )
    cold = stats.select(
        *[F.col(k).alias(f"__c{i}") for i, k in enumerate(keys)], packed.alias("__cold"),
        F.lit(0).cast("bigint").alias("__slot"),
    )
    on_hot = F.lit(True)
    on_cold = F.lit(True)
    for i, k in enumerate(keys):
        on_hot = on_hot & F.col(k).eqNullSafe(F.col(f"__h{i}"))
        on_cold = on_cold & F.col(k).eqNullSafe(F.col(f"__c{i}"))
    salt_cols = list(spread_by) or [c for c, t in df.dtypes if not t.startswith(("array", "map", "struct"))]
    salted = df.join(F.broadcast(hot), on_hot, "left").withColumn(
        "__salt",
        F.when(F.col("__hot").isNull(), F.lit(0).cast("bigint")).otherwise(
            F.pmod(F.xxhash64(*salt_cols), F.lit(hot_parts)) + 1
        ),
    )
    joined = salted.join(cold, on_cold & (F.col("__salt") == F.col("__slot")), "left")
    chosen = F.coalesce(F.col("__hot"), F.col("__cold"))
    return joined.select(*cols, *[chosen[n].alias(n) for n in names])


def keep_groups(df: DataFrame, keys: Sequence[str], aggs: Sequence[Column], keep: Column) -> DataFrame:
    """Rows of the groups whose aggregates satisfy ``keep``."""
    cols = df.columns
    return attach_group_stats(df, keys, aggs).where(keep).select(*cols)
