"""Importance ratios between the policy that sampled and the policy that trains.

All functions take the token layout (sequence key, position, log-probs, mask). The
sequence key is the partitioning of every window here, so one exchange at the
explode serves the whole chain, the per-sequence aggregates included.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EPS, clip, ratio_or_zero, safe_exp
from .quantiles import exact_quantiles
from .tokens import cumulative, from_here, whole

LEVELS = ("token", "cum-token", "cum-turn", "sequence")
SAFETY_BOUND = 20.0
"""Log ratios are held within this before exp (fixed value)."""


FOLDED = ("fold_log_w", "fold_vetoed")
"""Columns of ``fold_sequences`` that the token functions take instead of a window over the sequence."""


def fold_sequences(
    df: DataFrame, numerator: str, denominator: str, mask: str, geometric: bool = False, floor_count: bool = False, veto: float | None = None,
) -> DataFrame:
    """Array rows with the sequence's log ratio and whether a valid token's ratio is below the veto: no shuffle.

    Carry the added columns along when the arrays are exploded.
    """
    diffs = F.zip_with(numerator, denominator, lambda a, b: a - b)
    pairs = F.arrays_zip(diffs.alias("d"), F.col(mask).alias("m"))
    total = F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x["d"] * x["m"])
    count = F.aggregate(mask, F.lit(0).cast("bigint"), lambda s, m: s + m)
    mean = total / (F.greatest(count, F.lit(1)) if floor_count else count + F.lit(EPS))
    bad = F.exists(pairs, lambda x: (x["d"] < math.log(veto)) & (x["m"] > 0)) if veto else F.lit(False)
    return df.withColumns({FOLDED[0]: mean if geometric else total, FOLDED[1]: bad.cast("int")})


def log_ratio_at(
    tokens: DataFrame,
    numerator: str,
    denominator: str,
    mask: str,
    level: str,
    geometric: bool = False,
    turn_end: str | None = None,
    floor_count: bool = False,
    seq: str = "seq_id",
    pos: str = "pos",
    out: str = "log_w",
) -> DataFrame:
    """Add the log importance ratio of each token at the chosen level.

    token: the token's own ratio; cum-token: product of ratios up to the token;
    cum-turn: product up to the end of the token's turn; sequence: product over the
    sequence. Geometric takes means instead of products, over valid tokens only.
    ``floor_count`` divides by max(count, 1) instead of count + 1e-8.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}, not {level!r}")
    diff = F.col(numerator) - F.col(denominator)
    if level == "token":
        return tokens.withColumn(out, diff)

    def mean(total: Column, count: Column) -> Column:
        return total / (F.greatest(count, F.lit(1)) if floor_count else count + F.lit(EPS))

    if level == "sequence" and FOLDED[0] in tokens.columns:
        return tokens.withColumn(out, F.col(FOLDED[0]))
    if level == "sequence":
        w = whole(seq)
        total = F.sum(diff * F.col(mask)).over(w)
        count = F.sum(F.col(mask).cast("bigint")).over(w)
        return tokens.withColumn(out, mean(total, count) if geometric else total)

    run = cumulative(tokens.withColumn("__diff", diff), "__diff", mask, seq, pos)
    if level == "cum-token":
        value = mean(F.col("cum_sum"), F.col("cum_count")) if geometric else F.col("cum_sum")
        value = F.when(F.col(mask) > 0, value).otherwise(0.0)
        return run.withColumn(out, value).drop("__diff", "cum_sum", "cum_count")

    if turn_end is None:
        raise ValueError("the cum-turn level needs the turn-end column")
    is_end = (F.col(turn_end) == 1) | (F.col(pos) == F.col("__last"))
    at_end = F.when(is_end, F.struct("cum_sum", "cum_count"))
    staged = run.withColumn("__last", F.max(pos).over(whole(seq)))
    staged = staged.withColumn("__end", F.last(at_end, ignorenulls=True).over(from_here(seq, pos)))
    total, count = F.col("__end.cum_sum"), F.col("__end.cum_count")
    return staged.withColumn(out, mean(total, count) if geometric else total).drop(
        "__diff", "cum_sum", "cum_count", "__last", "__end"
    )


def thresholds(upper: float, lower: float | None) -> tuple[float, float]:
    """The band of accepted weights; the lower bound defaults to the reciprocal."""
    return upper, (1.0 / upper if lower is None else lower)


def rollout_weights(
    tokens: DataFrame,
    old: str,
    rollout: str,
    mask: str,
    level: str,
    mode: str,
    upper: float,
    lower: float | None = None,
    veto: float | None = 1e-4,
    geometric: bool = False,
    turn_end: str | None = None,
    seq: str = "seq_id",
) -> DataFrame:
    """Importance weights after truncation or masking and after the veto.

    Adds log_w (unclamped), raw_w, catastrophic, vetoed, in_band and weight. A veto
    of zero or None is off.
    """
    if mode not in ("truncate", "mask"):
        raise ValueError(f"mode must be truncate or mask, not {mode!r}")
    up, low = thresholds(upper, lower)
    rated = log_ratio_at(tokens, old, rollout, mask, level, geometric, turn_end, seq=seq)
    raw = safe_exp(F.col("log_w"), SAFETY_BOUND)
    if level == "cum-token" and not geometric:
        raw = F.when(F.col(mask) > 0, raw).otherwise(0.0)
    rated = rated.withColumn("raw_w", raw)
    if veto:
        bad = ((F.col(old) - F.col(rollout) < math.log(veto)) & (F.col(mask) > 0)).cast("int")
        rated = rated.withColumn("catastrophic", bad)
        veto_of = F.col(FOLDED[1]) if FOLDED[1] in rated.columns else F.max("catastrophic").over(whole(seq))
        rated = rated.withColumn("vetoed", veto_of)
    else:
        rated = rated.withColumns({"catastrophic": F.lit(0), "vetoed": F.lit(0)})
    rated = rated.withColumn("in_band", F.col("raw_w").between(low, up).cast("int"))
    shaped = F.least("raw_w", F.lit(up)) if mode == "truncate" else F.col("raw_w") * F.col("in_band")
    return rated.withColumn("weight", shaped * (1 - F.col("vetoed")) * F.col(mask))


def _per_sequence(weighted: DataFrame, mask: str, up: float, low: float, seq: str) -> DataFrame:
    m, w = F.col(mask), F.col("raw_w")
    held = clip(w, low, up)
    valid = F.when(m > 0, w)
    return weighted.groupBy(seq).agg(
        F.sum(m).alias("n"),
        F.sum(w * m).alias("sw"),
        F.sum(held * m).alias("sc"),
        F.sum(held * held * m).alias("sc2"),
        F.sum("catastrophic").alias("bad"),
        F.max("vetoed").alias("vetoed"),
        F.sum((w > up).cast("int") * m).alias("high"),
        F.sum((w < low).cast("int") * m).alias("low"),
        F.max(valid).alias("w_max"),
        F.min(valid).alias("w_min"),
        F.max("log_w").alias("lw"),
        F.sum((1 - F.col("in_band")) * m).alias("outside"),
        F.max(1 - F.col("in_band")).alias("seq_outside"),
    )


def weight_statistics(
    weighted: DataFrame,
    mask: str,
    level: str,
    upper: float,
    lower: float | None = None,
    geometric: bool = False,
    share_per_sequence: bool | None = None,
    damp_by_raw_mean: bool = False,
    seq: str = "seq_id",
) -> DataFrame:
    """One row of statistics of the raw weights, over tokens and over sequences.

    Deviation and effective sample size use weights clamped to the band and their own
    mean; ``damp_by_raw_mean`` uses the unclamped mean instead. For whole-sequence
    products the high and low shares count sequences unless told otherwise.
    """
    up, low = thresholds(upper, lower)
    table = _per_sequence(weighted, mask, up, low, seq)
    per_seq = level == "sequence"
    if share_per_sequence is None:
        share_per_sequence = per_seq and not geometric
    n = F.sum("n") + F.lit(EPS)
    mean = F.sum("sw") / n
    center = mean if damp_by_raw_mean else F.sum("sc") / n
    square = F.sum("sc2") / n
    seq_mean = F.col("sw") / (F.col("n") + F.lit(EPS))
    over, under = F.col("lw") > math.log(up), F.col("lw") < math.log(low)
    if per_seq and share_per_sequence:
        high, below = F.avg(over.cast("int")), F.avg(under.cast("int"))
    elif per_seq:
        high, below = F.sum(over.cast("int") * F.col("n")) / n, F.sum(under.cast("int") * F.col("n")) / n
    else:
        high, below = F.sum("high") / n, F.sum("low") / n
    top = F.exp(F.least(F.max("lw"), F.lit(SAFETY_BOUND))) if per_seq else F.max("w_max")
    bottom = F.exp(F.min("lw")) if per_seq else F.min("w_min")
    return table.agg(
        F.avg(F.col("vetoed")).alias("veto_fraction"),
        (F.sum("bad") / n).alias("catastrophic_token_fraction"),
        mean.alias("mean"), top.alias("max"), bottom.alias("min"),
        high.alias("ratio_fraction_high"), below.alias("ratio_fraction_low"),
        F.sqrt(F.greatest(square - center * center, F.lit(0.0))).alias("std"),
        (1 / (square / ((center + F.lit(EPS)) * (center + F.lit(EPS))))).alias("eff_sample_size"),
        F.avg(seq_mean).alias("seq_mean"),
        F.coalesce(F.stddev_samp(seq_mean), F.lit(0.0)).alias("seq_std"),
        F.max(seq_mean).alias("seq_max"), F.min(seq_mean).alias("seq_min"),
        F.max(F.abs(seq_mean - 1)).alias("seq_max_deviation"),
        F.avg((seq_mean > up).cast("int")).alias("seq_fraction_high"),
        F.avg((seq_mean < low).cast("int")).alias("seq_fraction_low"),
    )


def masked_fractions(
    weighted: DataFrame, mask: str, level: str, void_flag: str | None = None, seq: str = "seq_id"
) -> DataFrame:
    """Share of tokens and of sequences outside the band, and their overlap with void turns.

    ``void_flag`` is 0 on sequences with a void turn; the conditional shares are zero
    when their condition never holds.
    """
    whole_seq = F.max(1 - F.col("in_band"))
    any_token = (F.sum((1 - F.col("in_band")) * F.col(mask)) > 0).cast("int")
    table = weighted.groupBy(seq).agg(
        F.sum(mask).alias("n"),
        F.sum((1 - F.col("in_band")) * F.col(mask)).alias("outside"),
        (whole_seq if level == "sequence" else any_token).alias("clipped"),
        (F.max((F.col(void_flag) == 0).cast("int")) if void_flag else F.lit(0)).alias("void"),
    )
    out = [
        (F.sum("outside") / (F.sum("n") + F.lit(EPS))).alias("masked_fraction"),
        F.avg("clipped").alias("seq_masked_fraction"),
    ]
    if void_flag:
        both = F.sum(F.col("void") * F.col("clipped"))
        out += [
            ratio_or_zero(both, F.sum("clipped")).alias("void_turn_in_masked_ratio"),
            ratio_or_zero(both, F.sum("void")).alias("masked_in_void_turn_ratio"),
        ]
    return table.agg(*out)


WEIGHT_PERCENTILES = (0.25, 0.5, 0.75, 0.95, 0.99)

SKETCH_ACCURACY = 10_000
"""The sketch's rank error is 1/SKETCH_ACCURACY of the rows."""


def weight_percentiles(weighted: DataFrame, mask: str, value: str = "raw_w", approximate: bool = False) -> DataFrame:
    """Percentiles of the valid weights, exact or from the built-in sketch."""
    valid = weighted.where(F.col(mask) > 0)
    names = [f"p{int(p * 100)}" for p in WEIGHT_PERCENTILES]
    if approximate:
        sketch = valid.agg(F.percentile_approx(value, list(WEIGHT_PERCENTILES), SKETCH_ACCURACY).alias("q"))
        return sketch.select(*[F.get("q", F.lit(i)).alias(n) for i, n in enumerate(names)])
    return exact_quantiles(valid, value, WEIGHT_PERCENTILES, names)


def sequence_perplexity(tokens: DataFrame, old: str, rollout: str, mask: str, keep: Sequence[str] = (), seq: str = "seq_id") -> DataFrame:
    """Per-sequence sums the mismatch metrics are made of."""
    m = F.col(mask)
    diff = F.col(old) - F.col(rollout)
    n = F.sum(m) + F.lit(EPS)
    return tokens.groupBy(seq, *keep).agg(
        F.sum(m).alias("n"),
        (F.sum(F.col(old) * m) / n).alias("mean_old"),
        (F.sum(F.col(rollout) * m) / n).alias("mean_rollout"),
        F.sum(-diff * m).alias("kl_sum"),
        F.sum((F.exp(diff) - diff - 1) * m).alias("k3_sum"),
    )


def _mismatch_aggregates() -> list[Column]:
    n = F.sum("n") + F.lit(EPS)
    gap = F.col("mean_rollout") - F.col("mean_old")
    return [
        F.count(F.lit(1)).alias("sequences"),
        F.avg(F.exp(-F.col("mean_old"))).alias("training_ppl"),
        F.avg(-F.col("mean_old")).alias("training_log_ppl"),
        (F.sum("kl_sum") / n).alias("kl"),
        (F.sum("k3_sum") / n).alias("k3_kl"),
        F.avg(F.exp(-F.col("mean_rollout"))).alias("rollout_ppl"),
        F.avg(-F.col("mean_rollout")).alias("rollout_log_ppl"),
        F.avg(gap).alias("log_ppl_diff"),
        F.avg(F.abs(gap)).alias("log_ppl_abs_diff"),
        F.max(gap).alias("log_ppl_diff_max"),
        F.min(gap).alias("log_ppl_diff_min"),
        F.avg(F.exp(gap)).alias("ppl_ratio"),
    ]


def mismatch_metrics(sequences: DataFrame) -> DataFrame:
    """KL, perplexities and their gap over all sequences."""
    return sequences.agg(*_mismatch_aggregates())


def mismatch_by_sign(sequences: DataFrame, reward: str) -> DataFrame:
    """The same over all sequences and split by positive reward, in one rollup."""
    signed = sequences.withColumn("positive", F.col(reward) > 0)
    rolled = signed.rollup("positive").agg(F.grouping("positive").alias("g"), *_mismatch_aggregates())
    name = F.when(F.col("g") == 1, "all").when(F.col("positive"), "positive").otherwise("negative")
    return rolled.select(name.alias("subset"), *[c for c in rolled.columns if c not in ("positive", "g")])


def sign_differences(by_sign: DataFrame) -> DataFrame:
    """Positive minus negative for perplexity and KL; null when one side is empty."""
    def side(name, col):
        return F.max(F.when(F.col("subset") == name, F.col(col)))

    return by_sign.agg(
        (side("positive", "training_ppl") - side("negative", "training_ppl")).alias("ppl_diff_pos_neg"),
        (side("positive", "kl") - side("negative", "kl")).alias("kl_diff_pos_neg"),
    )


def probability_gap(tokens: DataFrame, old: str, rollout: str, mask: str) -> DataFrame:
    """Difference of token probabilities and token ratio over the mask."""
    valid = F.col(mask) > 0
    gap = F.when(valid, F.exp(rollout) - F.exp(old))
    ratio = F.when(valid, F.exp(F.col(old) - F.col(rollout)))
    return tokens.agg(
        F.max(gap).alias("probs_diff_max"), F.avg(gap).alias("probs_diff_mean"),
        F.stddev_samp(gap).alias("probs_diff_std"),
        F.max(ratio).alias("is_ratio_token_wise_max"), F.avg(ratio).alias("is_ratio_token_wise_mean"),
    )


def choose_old_log_probs(
    df: DataFrame, bypass: bool, old: str = "old_log_probs", rollout: str = "rollout_log_probs"
) -> DataFrame:
    """Old log-probs for the objective: the recomputed ones, or the sampled ones (bypass).

    With bypass the recomputed ones stay beside as ``actor_old_log_probs``.
    """
    if not bypass:
        return df
    if rollout not in df.columns:
        raise ValueError(f"bypass needs the column {rollout}")
    return df.withColumns({"actor_old_log_probs": F.col(old), old: F.col(rollout)})
