"""Token layout: one row per token, and the masked statistics over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalars import EPS


def explode_tokens(
    df: DataFrame, streams: Sequence[str], keep: Sequence[str] = ("seq_id",), cluster: str | None = None
) -> DataFrame:
    """One row per array position.

    With ``cluster`` the compact array rows are hash-partitioned on that key before
    the explode, and windows over the key then need no further exchange.
    """
    src = df.repartition(F.col(cluster)) if cluster else df
    zipped = F.arrays_zip(*[F.col(s) for s in streams])
    return src.select(*keep, F.posexplode(zipped).alias("pos", "t")).select(
        *keep, F.col("pos").cast("bigint").alias("pos"), *[F.col("t")[s].alias(s) for s in streams]
    )


def so_far(seq: str = "seq_id", pos: str = "pos"):
    """Rows of the sequence up to and including this one."""
    return Window.partitionBy(seq).orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def from_here(seq: str = "seq_id", pos: str = "pos"):
    """Rows of the sequence from this one on, read backwards so that a frame only grows."""
    return Window.partitionBy(seq).orderBy(F.col(pos).desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )


def whole(seq: str = "seq_id"):
    return Window.partitionBy(seq)


def cumulative(tokens: DataFrame, value: str, mask: str, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """Masked running sum and running count of valid tokens."""
    w = so_far(seq, pos)
    return tokens.withColumns({
        "cum_sum": F.sum(F.col(value) * F.col(mask)).over(w),
        "cum_count": F.sum(F.col(mask).cast("bigint")).over(w),
    })


def position_ids(tokens: DataFrame, mask: str, seq: str = "seq_id", pos: str = "pos") -> DataFrame:
    """(running count of valid tokens - 1) times the mask."""
    count = F.sum(F.col(mask).cast("bigint")).over(so_far(seq, pos))
    return tokens.withColumn("position_id", (count - 1) * F.col(mask))


def turn_end_position(
    tokens: DataFrame, turn_end: str, seq: str = "seq_id", pos: str = "pos"
) -> DataFrame:
    """For every token the position where its turn ends; the last token always ends one."""
    last = F.max(pos).over(whole(seq))
    ends = F.when(F.col(turn_end) == 1, F.col(pos))
    return tokens.withColumn("end_pos", F.coalesce(F.min(ends).over(from_here(seq, pos)), last))


def masked_stats(tokens: DataFrame, value: str, mask: str, prefix: str = "") -> DataFrame:
    """One row: masked mean (with the small denominator term), unbiased variance, count.

    The sums come from one pass; the squared deviations around the damped mean follow
    from the stable variance aggregate. A mask with fewer than two tokens is an error.
    """
    valid = F.when(F.col(mask) > 0, F.col(value))
    one = tokens.agg(
        F.sum(F.col(value) * F.col(mask)).alias("s"),
        F.sum(F.col(mask).cast("double")).alias("n"),
        F.var_pop(valid).alias("v"),
    )
    mean = F.col("s") / (F.col("n") + F.lit(EPS))
    shift = F.col("s") / F.col("n") - mean
    spread = (F.col("v") + shift * shift) * F.col("n")
    variance = F.when(
        F.col("n") > 1, spread / (F.col("n") + F.lit(EPS)) * F.col("n") / (F.col("n") - 1)
    ).otherwise(F.raise_error(F.lit("the variance needs at least two valid tokens")))
    return one.select(
        mean.alias(prefix + "mean"), variance.alias(prefix + "var"), F.col("n").cast("bigint").alias(prefix + "count")
    )


def whitened(value: Column, stats: Column, keep_mean: bool = False) -> Column:
    """(value - mean) / sqrt(var + 1e-8), from a struct of mean and var."""
    out = (value - stats["mean"]) / F.sqrt(stats["var"] + F.lit(EPS))
    return out + stats["mean"] if keep_mean else out


def stats_scalar(stats: DataFrame) -> Column:
    """A one-row frame as a struct constant of the surrounding plan."""
    return stats.select(F.struct(*[F.col(c) for c in stats.columns]).alias("s")).scalar()


def longest(df: DataFrame, arr: str) -> Column:
    """Size of the longest array as a scalar subquery."""
    return df.agg(F.max(F.size(arr)).alias("n")).scalar()


def cut_to_effective_length(df: DataFrame, mask: str, columns: Sequence[str], cut_left: bool = True) -> DataFrame:
    """Trim all arrays to the largest number of valid tokens any row has."""
    from ..functions import arrays as A

    effective = df.agg(F.max(A.count_ones(F.col(mask))).alias("n")).scalar()
    keep = A.keep_last if cut_left else A.keep_first
    staged = df.withColumn("__n", effective)
    return staged.withColumns({c: keep(F.col(c), F.col("__n")) for c in columns}).drop("__n")


def fill_inactive(all_rows: DataFrame, results: DataFrame, key: str, ids: str, text: str, pad_id: int) -> DataFrame:
    """Results of the active rows spread back over all rows; filler ids and empty text elsewhere."""
    from ..functions import arrays as A

    width = longest(results, ids)
    joined = all_rows.select(key).join(results.select(key, ids, text), key, "left").withColumn("__w", width)
    filler = A.repeat_to(F.lit(pad_id).cast(dict(results.select(F.explode(ids)).dtypes)["col"]), F.col("__w"))
    return joined.withColumns({
        ids: F.coalesce(F.col(ids), filler), text: F.coalesce(F.col(text), F.lit(""))
    }).drop("__w")


def drop_clipped_masks(df: DataFrame, mask: str, max_length: int) -> DataFrame:
    """Zero the mask of responses that reached the limit; no rows when every one did."""
    from ..functions import arrays as A

    clipped = A.count_ones(F.col(mask)) >= max_length
    everything = df.agg(F.bool_and(clipped).alias("b")).scalar()
    zeros = F.transform(F.col(mask), lambda _: F.lit(0))
    return df.where(~everything).withColumn(mask, F.when(clipped, zeros).otherwise(F.col(mask)))


def coverage(df: DataFrame, loss_mask: str, response_mask: str) -> DataFrame:
    """Mean trained length and the share of response tokens that are trained."""
    from ..functions import arrays as A

    trained, total = A.count_ones(F.col(loss_mask)), A.count_ones(F.col(response_mask))
    return df.agg(F.avg(trained).alias("response_length"), (F.sum(trained) / F.sum(total)).alias("response_coverage"))
