"""Ranks, running totals and seeded orders that never put one group into one task.

A plain window gathers its whole partition in a single task, so a key that holds a
third of all rows decides the run time. The helpers below cut every group into
chunks first, do the window work per chunk, and add the totals of the earlier
chunks. There are a few chunk totals per group for each shuffle partition.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import let

LEAST_CUTS = 64
CHUNKS_PER_PARTITION = 4


def chunk_count(df: DataFrame) -> int:
    """A few chunks for each shuffle partition of the session, so that the work of a chunk stays a task's share."""
    return max(LEAST_CUTS, CHUNKS_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def shuffle_key(seed: int, *keys: str | Column) -> Column:
    """A reproducible pseudo-random sort key: hex digest of the row key and a seed."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]
    return F.md5(F.concat_ws("-", *parts, F.lit(str(seed))))


def digest_chunk(digest: Column, chunks: int = 4096) -> Column:
    """The first hex digits of a digest, three or more: at least ``chunks`` evenly filled chunks, in digest order."""
    return F.substring(digest, 1, max(3, -(-(chunks - 1).bit_length() // 4)))


def with_ordered_chunks(df: DataFrame, col: str, out: str = "__bucket", cuts: int | None = None) -> DataFrame:
    """Add an ordered chunk number of a numeric column, about equally many rows in each.

    The borders come from one approximate pass and are constants of the plan, so a
    repeated task puts a row into the same chunk. At most ``cuts`` numbers reach the
    driver, and values that cluster do not fill one chunk.
    """
    cuts = cuts or chunk_count(df)
    borders = df.approxQuantile(col, [i / cuts for i in range(1, cuts)], 0.5 / cuts)
    inner = sorted(set(borders)) or [0.0]
    splits = [float("-inf"), *inner, float("inf")]
    return Bucketizer(splits=splits, inputCol=col, outputCol=out, handleInvalid="keep").transform(df)


def running_total(
    df: DataFrame,
    value: Column,
    order_by: Sequence[Column | str],
    chunk: Column,
    group_by: Sequence[str] = (),
    out: str = "running_total",
) -> DataFrame:
    """Inclusive running sum of ``value`` within ``group_by``, in ``order_by`` order.

    ``chunk`` must not decrease along the order. The first window works per
    (group, chunk); the second one only sees one row per chunk.
    """
    cols = df.columns
    keys = [*group_by, "__chunk"]
    staged = df.withColumn("__chunk", chunk).withColumn("__value", value)
    sums = staged.groupBy(*keys).agg(F.sum("__value").alias("__sum"))
    before = (
        Window.partitionBy(*group_by) if group_by else Window.partitionBy(F.lit(1))
    ).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.sum("__sum").over(before).alias("__offset"))
    inside = (
        Window.partitionBy(*keys).orderBy(*order_by)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = staged.withColumn("__local", F.sum("__value").over(inside))
    renamed = offsets.select(*[F.col(k).alias(f"__o{i}") for i, k in enumerate(keys)], "__offset")
    condition = F.lit(True)
    for i, k in enumerate(keys):
        condition = condition & F.col(k).eqNullSafe(F.col(f"__o{i}"))
    return local.join(renamed, condition, "left").select(
        *cols, (F.col("__local") + F.coalesce("__offset", F.lit(0))).alias(out)
    )


def row_index(
    df: DataFrame,
    order_by: Sequence[Column | str],
    chunk: Column,
    group_by: Sequence[str] = (),
    out: str = "row_index",
) -> DataFrame:
    """Zero-based position of every row in its group."""
    counted = running_total(df, F.lit(1).cast("bigint"), order_by, chunk, group_by, out)
    return counted.withColumn(out, F.col(out) - 1)


def index_by_id(df: DataFrame, id_col: str, out: str = "row_index") -> DataFrame:
    """Dense zero-based index of rows with a unique numeric id."""
    return row_index(with_ordered_chunks(df, id_col), [id_col], F.col("__bucket"), out=out).drop("__bucket")


def seeded_index(
    df: DataFrame, keys: Sequence[str], seed: int, group_by: Sequence[str] = (), out: str = "row_index"
) -> DataFrame:
    """Zero-based position in a seeded shuffle of the rows (within ``group_by``)."""
    cols = df.columns
    keyed = df.withColumn("__digest", shuffle_key(seed, *keys))
    placed = row_index(keyed, ["__digest", *keys], digest_chunk(F.col("__digest"), chunk_count(df)), group_by, out)
    return placed.select(*cols, out)


SALTS = 64


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, out: str, salts: int = SALTS) -> DataFrame:
    """The first ``n`` rows of every group by ``order``, which has no ties, with their rank from 1.

    Each group is first cut into parts by a hash of its rows, of which the first ``n`` are candidates; only those, at most
    ``salts * n`` of a group, are ranked against each other. So a group may hold a third of all rows, and ``n`` may be large.
    """
    cut = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(salts)))
    local = Window.partitionBy(*keys, "__part").orderBy(*order)
    some = cut.withColumn("__r", F.row_number().over(local)).where(F.col("__r") <= n).drop("__r", "__part")
    return some.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= n)


PERMUTE_ROUNDS = 6
PERMUTE_WALKS = 40


def permuted(index: Column, n: int, seed: int | Column) -> Column:
    """The place of ``index`` in a seeded permutation of 0..n-1, computed from the number alone: no sort, no shuffle.

    A Feistel network over pairs of numbers, whose product of ranges is just above ``n``; a result beyond ``n`` goes
    through it again until it is inside, which keeps the whole a permutation.
    """
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    b = max(1, -(-n // a))
    key = F.lit(seed) if isinstance(seed, int) else seed

    def mixed(half: Column, turn: int, size: int) -> Column:
        return F.pmod(F.xxhash64(half, key, F.lit(turn)), F.lit(size).cast("bigint"))

    def once(x: Column) -> Column:
        pair = F.struct(F.pmod(x, F.lit(a)).alias("l"), F.floor(x / F.lit(a)).cast("bigint").alias("r"))
        for turn in range(PERMUTE_ROUNDS):
            if turn % 2:
                pair = let(pair, lambda p, t=turn: F.struct(p["l"].alias("l"), F.pmod(p["r"] + mixed(p["l"], t, b), F.lit(b)).alias("r")))
            else:
                pair = let(pair, lambda p, t=turn: F.struct(F.pmod(p["l"] + mixed(p["r"], t, a), F.lit(a)).alias("l"), p["r"].alias("r")))
        return let(pair, lambda p: p["r"] * F.lit(a) + p["l"])

    walks = F.array_repeat(F.lit(0), PERMUTE_WALKS)
    found = F.aggregate(walks, once(index.cast("bigint")), lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return let(found, lambda x: F.when(x < n, x).otherwise(F.raise_error(F.lit("no place was found within the walks"))))
