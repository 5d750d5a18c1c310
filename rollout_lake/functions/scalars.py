"""Small numeric column builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def clip(x: Column, lo, hi) -> Column:
    """Clamp to [lo, hi]; bounds may be numbers or columns, the lower one wins."""
    return F.greatest(F.least(x, _lit(hi)), _lit(lo))


def safe_exp(log_value: Column, bound: float = 20.0) -> Column:
    """exp of a log value held within +-bound."""
    return F.exp(clip(log_value, -bound, bound))


def ratio_or_zero(num: Column, den: Column) -> Column:
    """num / den, zero where the denominator is zero or missing."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def masked_mean_of_sums(total: Column, count: Column) -> Column:
    """Masked mean from its two sums; an empty mask gives zero."""
    return total / (count + F.lit(EPS))


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(float(v))
