"""Linear recurrences over tokens as an associative scan, for sequences of any length.

``y[t] = b[t] + a[t] * y[t + 1]`` composes maps y -> a y + b. Within a chunk of positions the maps are composed by
doubling: each step composes every map with the one twice as far ahead. The map of a whole chunk stands for the chunk one
level up, until one chunk is left, and each chunk then starts from the value behind it. No task holds more of a
sequence than a chunk. Positions of a sequence are 0, 1, 2 and so on, each once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tokens import masked_stats, stats_scalar, whitened

CHUNK = 4096


def _scanned(maps: DataFrame, chunk: int, longest: int) -> DataFrame:
    """``maps`` (__seq, __pos, __a, __b and more) with ``__y``."""
    window = Window.partitionBy("__seq", "__chunk").orderBy("__pos")
    staged = maps.withColumn("__chunk", F.floor(F.col("__pos") / chunk))
    ahead = 1
    while ahead < min(chunk, longest + 1):
        staged = staged.withColumns({
            "__a": F.col("__a") * F.lead("__a", ahead, 1.0).over(window),
            "__b": F.col("__b") + F.col("__a") * F.lead("__b", ahead, 0.0).over(window),
        })
        ahead *= 2
    if longest < chunk:
        return staged.withColumn("__y", F.col("__b")).drop("__chunk")
    firsts = staged.where(F.col("__pos") % chunk == 0).select("__seq", F.col("__chunk").alias("__pos"), "__a", "__b")
    behind = _scanned(firsts, chunk, longest // chunk).select("__seq", (F.col("__pos") - 1).alias("__chunk"), F.col("__y").alias("__behind"))
    met = staged.join(behind, ["__seq", "__chunk"], "left")
    return met.withColumn("__y", F.col("__b") + F.col("__a") * F.coalesce("__behind", F.lit(0.0))).drop("__chunk", "__behind")


def backward_scan(tokens: DataFrame, seq: str, pos: str, a: Column, b: Column, out: str, chunk: int = CHUNK) -> DataFrame:
    """All rows with ``out`` = ``b + a * out`` of the sequence's next position, 0 behind its last one."""
    longest = tokens.agg(F.max(pos).alias("m")).first()["m"] or 0
    staged = tokens.withColumns({
        "__seq": F.col(seq), "__pos": F.col(pos).cast("bigint"), "__a": a.cast("double"), "__b": b.cast("double")})
    return _scanned(staged, chunk, int(longest)).withColumn(out, F.col("__y")).drop("__seq", "__pos", "__a", "__b", "__y")


def following(tokens: DataFrame, seq: str, pos: str, value: str, out: str, chunk: int = CHUNK) -> DataFrame:
    """All rows with ``out``: the value at the sequence's next position, 0 behind its last one."""
    staged = tokens.withColumn("__chunk", F.floor(F.col(pos) / chunk))
    firsts = staged.where(F.col(pos) % chunk == 0).select(seq, (F.col("__chunk") - 1).alias("__chunk"), F.col(value).alias("__first"))
    inside = F.lead(value).over(Window.partitionBy(seq, "__chunk").orderBy(pos))
    met = staged.withColumn("__next", inside).join(firsts, [seq, "__chunk"], "left")
    return met.withColumn(out, F.coalesce("__next", "__first", F.lit(0))).drop("__chunk", "__next", "__first")


def _white(tokens: DataFrame, value: str, mask: str) -> DataFrame:
    stats = stats_scalar(masked_stats(tokens, value, mask))
    return tokens.withColumn("__stats", stats).withColumn("advantages", whitened(F.col(value), F.col("__stats"))).drop("__stats")


def discounted_returns(tokens: DataFrame, rewards: str, mask: str, gamma: float, seq: str = "seq_id", pos: str = "pos",
                       chunk: int = CHUNK) -> DataFrame:
    """Return-to-go that the mask resets, and its advantages, whitened over valid tokens, masked."""
    staged = following(tokens, seq, pos, mask, "__valid", chunk)
    scanned = backward_scan(staged, seq, pos, F.col("__valid") * gamma, F.col(rewards), "returns", chunk).drop("__valid")
    return _white(scanned, "returns", mask).withColumn("advantages", F.col("advantages") * F.col(mask))


def baseline_returns(tokens: DataFrame, rewards: str, mask: str, baseline: str, seq: str = "seq_id", pos: str = "pos",
                     chunk: int = CHUNK) -> DataFrame:
    """Undiscounted masked return-to-go, and its advantages over a baseline."""
    scanned = backward_scan(tokens, seq, pos, F.lit(1.0), F.col(rewards) * F.col(mask), "returns", chunk)
    return scanned.withColumn("advantages", F.col("returns") - F.col(baseline) * F.col(mask))


def gae_tokens(tokens: DataFrame, rewards: str, values: str, mask: str, gamma: float, lam: float, seq: str = "seq_id", pos: str = "pos",
               chunk: int = CHUNK) -> DataFrame:
    """Generalised advantage estimation: returns are raw advantage plus value, advantages are whitened."""
    staged = following(tokens, seq, pos, values, "__ahead", chunk)
    delta = F.col(rewards) + F.col("__ahead") * gamma - F.col(values)
    scanned = backward_scan(staged, seq, pos, F.lit(gamma * lam), delta, "__raw", chunk)
    return _white(scanned.withColumn("returns", F.col("__raw") + F.col(values)), "__raw", mask).drop("__ahead", "__raw")
