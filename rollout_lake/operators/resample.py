"""Rejection of prompt groups, refill and downsampling of a batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .groups import attach_group_stats
from .ordering import seeded_index

BROADCAST_GROUPS = 100_000
MIN_STD = 1e-3
"""Groups whose reward deviation is below this carry no signal (fixed value)."""


def group_aggregates(reward: str, length: str, max_length: int) -> list[Column]:
    """The aggregates all group rules need, so that one shuffle serves them."""
    r, n = F.col(reward), F.col(length)
    return [
        F.count(F.lit(1)).alias("g_n"),
        F.avg(r).alias("g_mean"),
        F.stddev_samp(r).alias("g_std"),
        F.bool_and(r == 0).alias("g_none"),
        F.bool_and(r == 1).alias("g_all"),
        F.stddev_samp(n).alias("g_len_std"),
        F.count_if(n >= max_length).alias("g_over"),
    ]


def group_rules(
    acc_low: float | None = None,
    acc_high: float | None = None,
    remove_clip: bool = False,
    min_n: int = 1,
    rejection_sample: bool = True,
) -> dict[str, Column]:
    """Flags of a group, given the columns of ``group_aggregates``.

    A group of one has no deviation and is kept. The accuracy band only looks at
    groups the deviation rule lets through.
    """
    yes = F.lit(True)
    no = F.lit(False)
    flat = F.coalesce(F.col("g_std") < MIN_STD, no) if rejection_sample else no
    band = acc_low is not None and acc_high is not None and rejection_sample
    low = (~flat & (F.col("g_mean") < acc_low)) if band else no
    high = (~flat & ~low & (F.col("g_mean") > acc_high)) if band else no
    all_over = F.col("g_over") == F.col("g_n")
    too_few = (~all_over & (F.col("g_n") - F.col("g_over") < min_n)) if remove_clip else no
    return {
        "is_flat": flat,
        "is_low": low,
        "is_high": high,
        "is_over_long": all_over | too_few,
        "is_none": F.col("g_none") & yes if rejection_sample else no,
        "is_all": F.col("g_all") & yes if rejection_sample else no,
    }


def group_table(
    df: DataFrame, uid: str, reward: str, length: str, max_length: int, **rules
) -> DataFrame:
    """One row per prompt group with its statistics, flags and the verdict."""
    grouped = df.groupBy(uid).agg(*group_aggregates(reward, length, max_length))
    flagged = grouped.withColumns(group_rules(**rules))
    rejected = F.col("is_flat") | F.col("is_low") | F.col("is_high") | F.col("is_over_long")
    return flagged.withColumn("is_filtered", rejected)


def funnel(groups: DataFrame) -> DataFrame:
    """Batch counters over the group table."""
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        F.count_if("is_none").alias("solve_none"),
        F.count_if("is_all").alias("solve_all"),
        F.count_if("is_high").alias("solve_high"),
        F.count_if("is_low").alias("solve_low"),
        F.count_if("is_over_long").alias("over_long_all"),
        F.sum("g_over").alias("response_clip_number"),
        F.avg("g_len_std").alias("length_vars"),
        F.count_if("is_filtered").alias("filter_all"),
    )


def keep_valid(df: DataFrame, uid: str, reward: str, length: str, max_length: int, **rules) -> DataFrame:
    """Rows of the groups no rule rejects."""
    cols = df.columns
    flags = group_rules(**rules)
    rejected = flags["is_flat"] | flags["is_low"] | flags["is_high"] | flags["is_over_long"]
    stated = attach_group_stats(df, [uid], group_aggregates(reward, length, max_length))
    return stated.where(~rejected).select(*cols)


def effective_groups(rows: DataFrame, samples_per_prompt: int, batch_size: int) -> DataFrame:
    """Whole groups the surviving rows amount to, capped at the batch size."""
    valid = F.floor(F.count(F.lit(1)) / samples_per_prompt)
    return rows.agg(valid.alias("valid_groups"), F.least(valid, F.lit(batch_size)).alias("effective_batch_size"))


def refill(rows: DataFrame, uid: str, batch_size: int, groups: Column) -> DataFrame:
    """Replicate rows 1 + (B - 1) // v times with suffixed group ids when only v < B groups remain.

    ``groups`` is the number of groups, as a number or a scalar subquery.
    """
    times = F.when(
        groups < batch_size, 1 + F.floor(F.lit(batch_size - 1) / F.greatest(groups, F.lit(1)))
    ).otherwise(F.lit(1))
    copies = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), times.cast("bigint") - 1)))
    renamed = F.when(groups < batch_size, F.concat(F.col(uid).cast("string"), F.lit("_"), F.col("copy").cast("string")))
    return copies.withColumn(uid, F.coalesce(renamed, F.col(uid).cast("string")))


def group_count(rows: DataFrame, uid: str) -> Column:
    """Number of distinct groups as a scalar subquery."""
    return rows.select(uid).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()


def downsample_groups(rows: DataFrame, uid: str, batch_size: int, seed: int) -> DataFrame:
    """Exactly ``batch_size`` whole groups in seeded random order; fails when there are fewer.

    Groups are ranked in a table with one row each, then their rows are kept.
    """
    cols = rows.columns
    ids = rows.select(uid).distinct()
    enough = F.when(
        ids.agg(F.count(F.lit(1)).alias("n")).scalar() < batch_size,
        F.raise_error(F.lit(f"fewer than {batch_size} groups remain")),
    ).otherwise(F.lit(True))
    ranked = seeded_index(ids, [uid], seed, out="__rank")
    chosen = ranked.where((F.col("__rank") < batch_size) & enough).select(uid)
    if batch_size <= BROADCAST_GROUPS:
        # the chosen ids are at most batch_size rows, and a hot group stays where it is
        chosen = F.broadcast(chosen)
    return rows.join(chosen, uid, "left_semi").select(*cols)
