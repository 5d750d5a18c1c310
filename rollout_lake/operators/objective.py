"""Clipped policy objectives evaluated offline on logged log-probs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import EPS, clip
from .mismatch import log_ratio_at
from .quantiles import exact_quantiles
from .tokens import cumulative, stats_scalar, whole

RATIO_QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
QUANTILE_NAMES = ("q01", "q05", "q25", "q50", "q75", "q95", "q99")


def ratio_statistics(
    tokens: DataFrame,
    log_ratio: str,
    mask: str,
    advantage: str,
    low: Column | float,
    high: Column | float,
    log_bounds: bool = False,
    quantiles: bool = True,
) -> DataFrame:
    """Spread and quantiles of the ratio and the shares clipped by advantage sign.

    With ``log_bounds`` the bounds are widths in log space (columns or numbers),
    otherwise offsets from 1.
    """
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    valid = tokens.where(F.col(mask) > 0)
    ratio, adv = F.exp(F.col(log_ratio)), F.col(advantage)
    if log_bounds:
        under, over = F.col(log_ratio) < -low, F.col(log_ratio) > high
    else:
        under, over = ratio < 1 - low, ratio > 1 + high
    under, over = under & (adv < 0), over & (adv > 0)
    rated = valid.withColumns({"__ratio": ratio, "__under": under.cast("int"), "__over": over.cast("int")})
    stats = rated.agg(
        F.avg("__ratio").alias("mean"), F.stddev_samp("__ratio").alias("std"), F.var_samp("__ratio").alias("var"),
        F.min("__ratio").alias("min"), F.max("__ratio").alias("max"),
        F.avg("__under").alias("pg_clip_lower_frac"), F.avg("__over").alias("pg_clip_upper_frac"),
        F.avg(F.greatest("__under", "__over")).alias("pg_clip_frac"),
    )
    if not quantiles:
        return stats
    q = stats_scalar(exact_quantiles(rated, "__ratio", RATIO_QUANTILES, QUANTILE_NAMES))
    return stats.withColumn("__q", q).select(*stats.columns, *[F.col("__q")[n].alias(n) for n in QUANTILE_NAMES])


def token_losses(
    tokens: DataFrame,
    log_ratio: str,
    mask: str,
    advantage: str,
    clip_low: float,
    clip_high: float,
    clip_c: float | None = 3.0,
    log_min: float | None = None,
    log_max: float | None = 10.0,
    masked_ratio: bool = True,
    scale: str | None = None,
) -> DataFrame:
    """Per-token clipped loss, with the flags of the three clip statistics.

    ``clip_c`` None leaves out the dual clip. ``scale`` names a column that widens all
    bounds, which then act in log space.
    """
    if clip_c is not None and clip_c <= 1 and scale is None:
        raise ValueError("the dual clip bound must be greater than 1")
    log_r = F.col(log_ratio)
    if log_max is not None:
        log_r = F.least(log_r, F.lit(log_max))
    if log_min is not None:
        log_r = F.greatest(log_r, F.lit(log_min))
    staged = tokens.withColumn("__lr", log_r)

    def masked(c: Column) -> Column:
        return F.when(F.col(mask) > 0, c).otherwise(0.0) if masked_ratio else c

    ratio = masked(F.exp("__lr"))
    staged = staged.withColumn("ratio", ratio)
    adv = F.col(advantage)
    if scale is None:
        bounded = clip(F.col("ratio"), 1 - clip_low, 1 + clip_high)
        cap = F.lit(clip_c) if clip_c is not None else None
    else:
        s = F.col(scale)
        bounded = masked(F.exp(clip(F.col("__lr"), -clip_low * s, clip_high * s)))
        cap = F.exp(clip_c * s) if clip_c is not None else None
    staged = staged.withColumns({"__l1": -adv * F.col("ratio"), "__l2": -adv * bounded})
    worst = F.greatest("__l1", "__l2")
    staged = staged.withColumns({"__worst": worst, "clipped": (F.col("__l2") > F.col("__l1")).cast("int")})
    if cap is None:
        return staged.withColumns({"loss": F.col("__worst"), "dual_clipped": F.lit(0)}).drop("__lr", "__l1", "__l2", "__worst")
    staged = staged.withColumn("__l3", -adv * cap)
    loss = F.when(adv < 0, F.least("__l3", "__worst")).otherwise(F.col("__worst"))
    dual = ((F.col("__worst") > F.col("__l3")) & (adv < 0)).cast("int")
    return staged.withColumns({"loss": loss, "dual_clipped": dual}).drop("__lr", "__l1", "__l2", "__l3", "__worst")


LOSS_MODES = ("token-mean", "seq-mean-token-sum", "seq-mean-token-mean", "seq-mean-token-sum-norm")


def loss_columns(mode: str, width: int | None = None) -> Column:
    """Aggregate over per-sequence sums ``ls`` (masked loss) and ``n`` (valid tokens)."""
    if mode == "token-mean":
        return F.sum("ls") / (F.sum("n") + F.lit(EPS))
    if mode == "seq-mean-token-sum":
        return F.avg("ls")
    if mode == "seq-mean-token-mean":
        return F.avg(F.col("ls") / F.greatest("n", F.lit(1)))
    if mode == "seq-mean-token-sum-norm":
        if not width:
            raise ValueError("the normed sum needs the response width")
        return F.sum("ls") / width
    raise ValueError(f"unknown loss aggregation {mode!r}")


def aggregate_loss(tokens: DataFrame, loss: str, mask: str, mode: str, width: int | None = None, seq: str = "seq_id") -> DataFrame:
    """Loss over tokens to one number in one of four modes."""
    table = tokens.groupBy(seq).agg(F.sum(F.col(loss) * F.col(mask)).alias("ls"), F.sum(mask).alias("n"))
    return table.agg(loss_columns(mode, width).alias("loss"))


def objective_report(
    tokens: DataFrame, mask: str, kl: Column, mode: str, width: int | None = None, weight: str | None = None, seq: str = "seq_id"
) -> DataFrame:
    """One row: loss, clip shares, approximate KL, from per-sequence sums."""
    m = F.col(mask)
    loss = F.col("loss") * F.col(weight) if weight else F.col("loss")
    table = tokens.groupBy(seq).agg(
        F.sum(loss * m).alias("ls"), F.sum(m).alias("n"), F.sum(kl * m).alias("kl"),
        F.sum(F.col("clipped") * m).alias("c"), F.sum(F.col("dual_clipped") * m).alias("d"),
        F.sum(F.when(m > 0, F.col("dual_clipped"))).alias("dv"), F.count_if(m > 0).alias("nv"),
    )
    n = F.sum("n") + F.lit(EPS)
    return table.agg(
        loss_columns(mode, width).alias("pg_loss"),
        (F.sum("c") / n).alias("pg_clipfrac"),
        (F.sum("kl") / n).alias("ppo_kl"),
        (F.sum("d") / n).alias("pg_clipfrac_lower"),
        (F.sum("dv") / F.sum("nv")).alias("pg_dual_clip_frac"),
    )


def clipped_objective(
    tokens: DataFrame, new: str, old: str, mask: str, advantage: str, clip_low: float, clip_high: float,
    clip_c: float = 3.0, mode: str = "token-mean", width: int | None = None, weight: str | None = None,
) -> DataFrame:
    """Token-ratio objective with dual clip; its lower clip share compares the capped loss
    with the cap itself and is therefore always zero."""
    rated = tokens.withColumn("log_r", clip(F.col(new) - F.col(old), -20.0, 20.0))
    losses = token_losses(rated, "log_r", mask, advantage, clip_low, clip_high, clip_c, log_max=None, masked_ratio=False)
    report = objective_report(losses, mask, -F.col("log_r"), mode, width, weight)
    return report.withColumn("pg_clipfrac_lower", F.lit(0.0)).drop("pg_dual_clip_frac")


def level_objective(
    tokens: DataFrame, new: str, old: str, mask: str, advantage: str, level: str, geometric: bool,
    clip_low: float, clip_high: float, clip_c: float = 3.0, mode: str = "token-mean", width: int | None = None,
    turn_end: str | None = None, weight: str | None = None, log_min: float | None = None, log_max: float = 10.0,
) -> DataFrame:
    """Objective on the sequence, cum-token, cum-turn or token ratio."""
    rated = log_ratio_at(tokens, new, old, mask, level, geometric, turn_end, floor_count=level == "sequence", out="log_r")
    losses = token_losses(rated, "log_r", mask, advantage, clip_low, clip_high, clip_c, log_min, log_max)
    return objective_report(losses, mask, F.col(old) - F.col(new), mode, width, weight)


def rollout_objective(tokens: DataFrame, new: str, rollout: str, mask: str, advantage: str, level: str, geometric: bool, clip_low: float, clip_high: float, clip_c: float = 3.0, mode: str = "token-mean") -> DataFrame:
    """Objective directly against the sampling policy, log ratio held within +-20."""
    if level == "cum-turn":
        raise ValueError("this objective knows the token, cum-token and sequence levels")
    return level_objective(
        tokens, new, rollout, mask, advantage, level, geometric, clip_low, clip_high, clip_c, mode, log_min=-20.0, log_max=20.0
    )


def with_length_scale(tokens: DataFrame, new: str, old: str, mask: str, level: str) -> DataFrame:
    """Log ratio (product form) and the square root of the tokens it covers."""
    rated = log_ratio_at(tokens, new, old, mask, level, out="log_r")
    count = F.col(mask).cast("bigint")
    if level == "sequence":
        n = F.greatest(F.sum(count).over(whole()), F.lit(1))
        return rated.withColumn("scale", F.sqrt(n))
    if level == "cum-token":
        run = cumulative(rated.withColumn("__one", F.lit(1)), "__one", mask)
        return run.withColumn("scale", F.sqrt("cum_count")).drop("__one", "cum_sum", "cum_count")
    raise ValueError("length-scaled bounds exist for the sequence and cum-token levels")


def length_scaled_objective(tokens: DataFrame, new: str, old: str, mask: str, advantage: str, level: str, clip_low: float, clip_high: float, clip_c: float = 3.0, mode: str = "token-mean") -> DataFrame:
    """Objective with log-space bounds that widen with the square root of the length."""
    rated = with_length_scale(tokens, new, old, mask, level)
    losses = token_losses(rated, "log_r", mask, advantage, clip_low, clip_high, clip_c, scale="scale")
    return objective_report(losses, mask, F.col(old) - F.col(new), mode)


def sequence_mean_objective(tokens: DataFrame, new: str, old: str, mask: str, advantage: str, clip_low: float = 0.2, clip_high: float = 0.28) -> DataFrame:
    """Geometric-mean sequence ratio with a single clip and sequence-mean aggregation."""
    rated = log_ratio_at(tokens, new, old, mask, "sequence", True, floor_count=True, out="log_r")
    losses = token_losses(rated, "log_r", mask, advantage, clip_low, clip_high, clip_c=None, masked_ratio=False)
    return objective_report(losses, mask, F.col(old) - F.col(new), "seq-mean-token-mean").drop("pg_dual_clip_frac")


def running_mean_objective(tokens: DataFrame, new: str, old: str, mask: str, advantage: str, clip_low: float = 0.2, clip_high: float = 0.28, clip_c: float = 3.0, mode: str = "seq-mean-token-mean", weight: str | None = None) -> DataFrame:
    """Running geometric-mean ratio at every token, dual clip."""
    return level_objective(tokens, new, old, mask, advantage, "cum-token", True, clip_low, clip_high, clip_c, mode, weight=weight).drop("pg_dual_clip_frac")


def value_loss(tokens: DataFrame, predicted: str, returns: str, values: str, mask: str, clip_range: float) -> DataFrame:
    """Half the masked mean of the larger of the plain and the clipped squared error."""
    v, m = F.col(values), F.col(mask)
    held = clip(F.col(predicted), v - clip_range, v + clip_range)
    plain = F.pow(F.col(predicted) - F.col(returns), F.lit(2.0))
    clipped = F.pow(held - F.col(returns), F.lit(2.0))
    n = F.sum(m) + F.lit(EPS)
    return tokens.agg(
        (0.5 * F.sum(F.greatest(plain, clipped) * m) / n).alias("vf_loss"),
        (F.sum((clipped > plain).cast("int") * m) / n).alias("vf_clipfrac"),
    )


def combined_objective(policy: DataFrame, entropy: DataFrame, kl: DataFrame, entropy_coef: float, kl_coef: float) -> DataFrame:
    """policy loss - entropy * coefficient + KL * coefficient, from three one-row frames."""
    e, k = entropy.scalar(), kl.scalar()
    one = policy.withColumns({"entropy_loss": e, "kl_loss": k})
    return one.withColumn(
        "total_loss", F.col("pg_loss") - F.col("entropy_loss") * entropy_coef + F.col("kl_loss") * kl_coef
    )


def noise_statistics(logged: DataFrame, sigma: str) -> DataFrame:
    """Spread of the logged noise scale."""
    return logged.agg(
        F.avg(sigma).alias("sigma_mean"), F.stddev_samp(sigma).alias("sigma_std"),
        F.min(sigma).alias("sigma_min"), F.max(sigma).alias("sigma_max"),
    )
