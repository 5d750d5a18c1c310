"""Column builders over per-sequence arrays: masks, padding, positions, folds.

Everything here is linear in the array length and stays in one row, so a table in
array layout needs no shuffle for it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import EPS


def array_sum(arr) -> Column:
    """Sum of a numeric array as double."""
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def count_ones(mask) -> Column:
    """Number of set positions of a 0/1 mask."""
    return F.aggregate(mask, F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint"))


def masked_sum(values, mask) -> Column:
    return array_sum(F.zip_with(values, mask, lambda v, m: v * m))


def masked_mean(values, mask) -> Column:
    return masked_sum(values, mask) / (count_ones(mask) + F.lit(EPS))


def repeat_to(value, n: Column) -> Column:
    """``n`` copies of a value, none when n is negative."""
    return F.array_repeat(value, F.greatest(n, F.lit(0)).cast("int"))


def pad_right(arr: Column, pad: Column, length: Column) -> Column:
    return F.concat(arr, repeat_to(pad, length - F.size(arr)))


def pad_left(arr: Column, pad: Column, length: Column) -> Column:
    return F.concat(repeat_to(pad, length - F.size(arr)), arr)


def keep_first(arr: Column, n: Column) -> Column:
    return F.slice(arr, F.lit(1), F.greatest(n, F.lit(0)).cast("int"))


def keep_last(arr: Column, n: Column) -> Column:
    take = F.least(F.greatest(n, F.lit(0)), F.size(arr)).cast("int")
    return F.slice(arr, F.size(arr) - take + 1, take)


def truncate(arr: Column, max_length: int, side: str) -> Column:
    """Cut an over-long array on the left or right, or fail the row."""
    limit = F.lit(max_length)
    if side == "left":
        return keep_last(arr, limit)
    if side == "right":
        return keep_first(arr, limit)
    if side == "error":
        return F.when(F.size(arr) <= limit, arr).otherwise(
            F.raise_error(F.format_string("sequence of %d tokens is longer than %d", F.size(arr), limit))
        )
    raise ValueError(f"unknown truncation side {side!r}")


def first_position(ids: Column, wanted: Sequence[int]) -> Column:
    """One-based position of the first element among ``wanted``; 0 when absent."""
    hits = F.filter(
        F.array(*[F.array_position(ids, F.lit(w)) for w in wanted]), lambda p: p > 0
    )
    return F.coalesce(F.array_min(hits), F.lit(0)).cast("bigint")


def eos_mask(ids: Column, eos: Sequence[int]) -> Column:
    """1 up to and including the first end token, 0 after it."""
    n = F.size(ids)
    at = first_position(ids, eos)
    keep = F.when(at > 0, at).otherwise(n).cast("int")
    return F.concat(repeat_to(F.lit(1), keep), repeat_to(F.lit(0), n - keep))


def attention_mask(ids: Column, pad_id: int) -> Column:
    return F.transform(ids, lambda x: F.when(x != pad_id, 1).otherwise(0))


def strip_left_padding(ids: Column, mask: Column) -> Column:
    return keep_last(ids, count_ones(mask))


def move_padding(ids: Column, pad_id: int, to_left: bool = True) -> Column:
    """Gather the padding on one side; real tokens keep their order."""
    pads = F.filter(ids, lambda x: x == pad_id)
    real = F.filter(ids, lambda x: x != pad_id)
    return F.concat(pads, real) if to_left else F.concat(real, pads)


def move_padding_struct(rows: Column, field: str, pad_id: int, to_left: bool = True) -> Column:
    """The same permutation for parallel streams zipped into an array of structs."""
    pads = F.filter(rows, lambda r: r[field] == pad_id)
    real = F.filter(rows, lambda r: r[field] != pad_id)
    return F.concat(pads, real) if to_left else F.concat(real, pads)


ROLL_PRIME, ROLL_BASE = 2**31 - 1, 1_000_003


def find_subsequence(seq: Column, sub: Column) -> Column:
    """Zero-based index of the first occurrence of ``sub``; -1 when absent or empty.

    One pass with a rolling hash of the last elements; arrays are only compared where the hashes are equal.
    """
    def code(x):
        return F.pmod(F.xxhash64(x.cast("string")), F.lit(ROLL_PRIME))

    def rolled(h, x):
        return F.pmod(h * F.lit(ROLL_BASE) + x, F.lit(ROLL_PRIME))

    def search(p):
        m = F.size(p["sub"])

        def step(s, i):
            gone = F.when(i >= m, F.get(p["codes"], i - m) * p["power"]).otherwise(F.lit(0).cast("bigint"))
            h = F.pmod(s["h"] * F.lit(ROLL_BASE) + F.get(p["codes"], i) - F.pmod(gone, F.lit(ROLL_PRIME)), F.lit(ROLL_PRIME))
            return let(h, lambda now: F.struct(now.alias("h"), F.when(s["at"] >= 0, s["at"]).when(
                (i >= m - 1) & (now == p["wanted"]) & (F.slice(p["seq"], i - m + 2, m) == p["sub"]), i - m + 1
            ).otherwise(F.lit(-1)).alias("at")))

        start = F.struct(F.lit(0).cast("bigint").alias("h"), F.lit(-1).alias("at"))
        return F.aggregate(F.sequence(F.lit(0), F.size(p["seq"]) - 1), start, step)["at"]

    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    staged = F.struct(
        seq.alias("seq"), sub.alias("sub"), F.transform(seq, code).alias("codes"),
        F.aggregate(F.transform(sub, code), zero, rolled).alias("wanted"),
        F.aggregate(sub, one, lambda h, _: rolled(h, zero)).alias("power"),
    )
    found = F.when((F.size(sub) > 0) & (F.size(seq) >= F.size(sub)), let(staged, search))
    return F.coalesce(found, F.lit(-1)).cast("bigint")


def extend_positions(positions: Column, n: Column) -> Column:
    """Position ids of a prompt continued by 1..n after its last one."""
    last = F.element_at(positions, -1)
    return F.when(n > 0, F.concat(positions, F.sequence(last + 1, last + n))).otherwise(positions)


def place_at(length: Column, index: Column, value: Column) -> Column:
    """An array of zeros with one value at a zero-based index."""
    before = F.least(F.greatest(index, F.lit(0)), length)
    inside = (index >= 0) & (index < length)
    return F.when(
        inside,
        F.concat(repeat_to(F.lit(0.0), before), F.array(value), repeat_to(F.lit(0.0), length - before - 1)),
    ).otherwise(repeat_to(F.lit(0.0), length))


def scale_mask(mask: Column, flag: Column) -> Column:
    return F.transform(mask, lambda m: m * flag)


def multiply_masks(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x * y)


def let(value: Column, body) -> Column:
    """``body`` applied to a value that is evaluated once.

    A lambda of an array function evaluates the outer expressions it mentions for every
    element; a bound variable is computed only once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _exp_sums(logits: Column, top: Column, finish) -> Column:
    """Fold of sum exp(x - top) and sum x * exp(x - top)."""
    zero = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("t"))

    def add(acc, x):
        w = F.exp(x - top)
        return F.struct((acc["s"] + w).alias("s"), (acc["t"] + w * x).alias("t"))

    return F.aggregate(logits, zero, add, finish)


def log_sum_exp(logits: Column) -> Column:
    """Max-shifted log of the sum of exponentials."""
    return let(F.array_max(logits), lambda top: _exp_sums(logits, top, lambda acc: top + F.log(acc["s"])))


def label_log_prob(logits: Column, label: Column) -> Column:
    return F.get(logits, label.cast("int")) - log_sum_exp(logits)


def logit_entropy(logits: Column) -> Column:
    """logsumexp minus the softmax-weighted mean logit."""
    return let(
        F.array_max(logits),
        lambda top: _exp_sums(logits, top, lambda acc: top + F.log(acc["s"]) - acc["t"] / acc["s"]),
    )


def join_streams(
    prior: Column, ids: Column, log_probs: Column, info: Column, pad_id: int, to_left: bool = False
) -> Column:
    """Append a turn and its tool output to a token stream, then gather the padding.

    ``prior`` is an array of (id, mask_id, logp). The tool output enters the mask stream
    as padding and the log-prob stream as -1; one permutation moves all three.
    """
    pad = F.lit(pad_id).cast("bigint")

    def token(i, m, lp):
        return F.struct(i.cast("bigint").alias("id"), m.cast("bigint").alias("mask_id"), lp.cast("double").alias("logp"))

    turn = F.zip_with(ids, log_probs, lambda i, lp: token(i, i, lp))
    tool = F.transform(info, lambda i: token(i, pad, F.lit(-1.0)))
    return move_padding_struct(F.concat(prior, turn, tool), "id", pad_id, to_left)


CELLS_PER_BLOCK = 1 << 21


def _suffix_recurrence(values: pd.Series, carry: pd.Series, factor: float) -> pd.Series:
    """y[t] = x[t] + factor * carry[t + 1] * y[t + 1], a block of rows at a time."""
    lengths = values.map(len).to_numpy()
    order = np.argsort(lengths, kind="stable")
    out: list[np.ndarray] = [np.empty(0)] * len(values)
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop + 1 - start) * max(lengths[order[stop]], 1) <= CELLS_PER_BLOCK:
            stop += 1
        rows = order[start:stop]
        width = int(lengths[rows].max())
        x = np.zeros((len(rows), width))
        c = np.zeros((len(rows), width + 1))
        for j, r in enumerate(rows):
            x[j, : lengths[r]] = values.iat[r]
            c[j, : lengths[r]] = carry.iat[r]
        running = np.zeros(len(rows))
        for t in range(width - 1, -1, -1):
            running = x[:, t] + factor * c[:, t + 1] * running
            x[:, t] = running
        for j, r in enumerate(rows):
            out[r] = x[j, : lengths[r]]
        start = stop
    return pd.Series(out, index=values.index)


def suffix_recurrence(values: Column, carry: Column, factor: float) -> Column:
    """Backward recurrence over an array; ``carry`` says where the later value counts."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, c: pd.Series) -> pd.Series:
        return _suffix_recurrence(x, c, factor)

    return run(values, carry)
