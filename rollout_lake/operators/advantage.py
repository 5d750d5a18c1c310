"""Rewards and advantages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.scalars import EPS, clip
from .groups import attach_group_stats, lookup_join
from .ordering import running_total
from .tokens import explode_tokens, masked_stats, stats_scalar, whitened


def score_on_last_token(mask: Column, score: Column) -> Column:
    """Token rewards that are zero but for the score at the last valid token."""
    return A.place_at(F.size(mask), A.count_ones(mask) - 1, score)


def expand_model_score(scores: Column, positions: Column, mask: Column, response_length: int) -> Column:
    """Keep the score of the last attended token at its place; return the response part."""
    weighted = F.zip_with(positions, mask, lambda p, m: p * m)
    at = F.array_position(weighted, F.array_max(weighted)).cast("int") - 1
    return A.keep_last(A.place_at(F.size(mask), at, F.get(scores, at)), F.lit(response_length))


def tool_use_credit(score: Column, true_tool_use: Column) -> Column:
    """Half the score where the tool was not really used."""
    return F.when(true_tool_use == 0, score * 0.5).otherwise(score)


def kl_penalty(log_prob: Column, ref_log_prob: Column, kind: str) -> Column:
    """Per-token KL estimate between the policy and the reference policy."""
    diff = log_prob - ref_log_prob
    if kind == "kl":
        return diff
    if kind == "abs":
        return F.abs(diff)
    if kind == "mse":
        return 0.5 * diff * diff
    if kind == "low_var_kl":
        back = ref_log_prob - log_prob
        return clip(F.exp(back) - back - 1, -10.0, 10.0)
    raise ValueError(f"unknown KL estimator {kind!r}")


def kl_shaped_rewards(
    tokens: DataFrame, score: str, log_prob: str, ref: str, mask: str, beta: float, kind: str = "kl"
) -> DataFrame:
    """Token reward = score - beta * masked KL."""
    kld = kl_penalty(F.col(log_prob), F.col(ref), kind) * F.col(mask)
    return tokens.withColumns({"kld": kld, "token_reward": F.col(score) - F.lit(beta) * kld})


def mean_sequence_kl(shaped: DataFrame, mask: str, beta: float, seq: str = "seq_id") -> DataFrame:
    """Batch mean of the per-sequence masked mean KL, next to the coefficient in use."""
    per_seq = shaped.groupBy(seq).agg(
        (F.sum(F.col("kld") * F.col(mask)) / (F.sum(mask) + F.lit(EPS))).alias("k")
    )
    return per_seq.agg(F.avg("k").alias("reward_kl_penalty"), F.lit(beta).alias("reward_kl_penalty_coeff"))


def simple_rewards(score: Column, old_log_prob: Column, ref_log_prob: Column, ratio: float) -> Column:
    return score - (old_log_prob - ref_log_prob) * F.lit(ratio)


def adaptive_kl_coefficient(
    steps: DataFrame, step: str, kl: str, n: str, init: float, target: float, horizon: float
) -> DataFrame:
    """Coefficient after every step of the adaptive controller.

    The controller multiplies a factor per step, so the value after a step is the
    exponential of a running sum of logs. Factors stay positive while 0.2 * n < horizon.
    """
    if horizon <= 0:
        raise ValueError("horizon must be larger than 0")
    error = clip(F.col(kl) / F.lit(target) - 1, -0.2, 0.2)
    factor = 1 + error * F.col(n) / F.lit(horizon)
    log_factor = F.when(factor > 0, F.log(factor)).otherwise(
        F.raise_error(F.lit("the step size exceeds five horizons"))
    )
    run = running_total(steps, log_factor, [step], F.floor(F.col(step) / 4096), out="log_value")
    return run.withColumn("kl_coef", F.lit(init) * F.exp("log_value")).drop("log_value")


def fixed_kl_coefficient(steps: DataFrame, value: float) -> DataFrame:
    return steps.withColumn("kl_coef", F.lit(value))


def grpo_advantage(df: DataFrame, score: str = "score", uid: str = "uid", eps: float = 1e-6) -> DataFrame:
    """Score standardised in its group with the sample deviation; a group of one uses mean 0, std 1."""
    stated = attach_group_stats(
        df, [uid], [F.avg(score).alias("g_mean"), F.stddev_samp(score).alias("g_std"), F.count(score).alias("g_n")]
    )
    alone = F.col("g_n") == 1
    mean = F.when(alone, 0.0).otherwise(F.col("g_mean"))
    std = F.when(alone, 1.0).otherwise(F.col("g_std"))
    return stated.withColumn("advantage", (F.col(score) - mean) / (std + F.lit(eps))).drop("g_mean", "g_std", "g_n")


def rloo_advantage(df: DataFrame, score: str = "score", uid: str = "uid") -> DataFrame:
    """Score minus the mean of the others in its group; a group of one keeps its score."""
    stated = attach_group_stats(df, [uid], [F.avg(score).alias("g_mean"), F.count(score).alias("g_n")])
    n = F.col("g_n")
    spread = F.col(score) * n / (n - 1) - F.col("g_mean") * n / (n - 1)
    return stated.withColumn("advantage", F.when(n > 1, spread).otherwise(F.col(score))).drop("g_mean", "g_n")


def spread_over_tokens(advantage: Column, mask: Column) -> Column:
    """The sample's advantage on every valid token."""
    return F.transform(mask, lambda m: m * advantage)


def _whiten_arrays(df: DataFrame, values: str, mask: str) -> DataFrame:
    """Add ``advantages``: the array whitened by the masked statistics of all rows."""
    stats = stats_scalar(masked_stats(explode_tokens(df, [values, mask], keep=()), values, mask))
    with_stats = df.withColumn("__stats", stats)
    return with_stats.withColumn(
        "advantages", F.transform(F.col(values), lambda x: whitened(x, F.col("__stats")))
    ).drop("__stats")


def reinforce_plus_plus(df: DataFrame, rewards: str, mask: str, gamma: float) -> DataFrame:
    """Discounted return-to-go reset by the mask, then whitened over all valid tokens."""
    returns = df.withColumn("returns", A.suffix_recurrence(F.col(rewards), F.col(mask), gamma))
    white = _whiten_arrays(returns, "returns", mask)
    return white.withColumn("advantages", F.zip_with("advantages", F.col(mask), lambda a, m: a * m))


def remax(
    df: DataFrame, baselines: DataFrame, rewards: str, mask: str, key: str, baseline: str = "baseline"
) -> DataFrame:
    """Masked return-to-go minus the greedy baseline of the prompt (joined on its key)."""
    joined = lookup_join(df, baselines.select(key, baseline), [key])
    masked = F.zip_with(F.col(rewards), F.col(mask), lambda r, m: r * m)
    ones = F.transform(masked, lambda _: F.lit(1))
    returns = joined.withColumn("returns", A.suffix_recurrence(masked, ones, 1.0))
    return returns.withColumn(
        "advantages", F.zip_with(F.col("returns"), F.col(mask), lambda r, m: r - F.col(baseline) * m)
    )


def gae(df: DataFrame, rewards: str, values: str, mask: str, gamma: float, lam: float) -> DataFrame:
    """Generalised advantage estimation; returns = raw advantage + value, advantages whitened."""
    n = F.size(values)
    following = F.concat(F.slice(F.col(values), F.lit(2), F.greatest(n - 1, F.lit(0))), F.array(F.lit(0.0)))
    ahead = F.zip_with(F.col(rewards), following, lambda r, w: r + F.lit(gamma) * w)
    deltas = F.zip_with(ahead, F.col(values), lambda a, v: a - v)
    ones = F.transform(F.col(values), lambda _: F.lit(1))
    raw = df.withColumn("raw_advantages", A.suffix_recurrence(deltas, ones, gamma * lam))
    returns = F.zip_with(F.col("raw_advantages"), F.col(values), lambda a, v: a + v)
    return _whiten_arrays(raw, "raw_advantages", mask).withColumn("returns", returns).drop("raw_advantages")


ESTIMATORS: dict[str, Callable[..., DataFrame]] = {
    "grpo": grpo_advantage,
    "rloo": rloo_advantage,
    "reinforce_plus_plus": reinforce_plus_plus,
    "remax": remax,
    "gae": gae,
}


def compute_advantage(df: DataFrame, estimator: str, **params) -> DataFrame:
    """Advantage by estimator name."""
    if estimator not in ESTIMATORS:
        raise NotImplementedError(f"unknown advantage estimator {estimator!r}")
    return ESTIMATORS[estimator](df, **params)
