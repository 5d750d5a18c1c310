"""Evaluation roll-ups, batch metrics and throughput reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .groups import attach_group_stats
from .ordering import first_rows, running_total, shuffle_key


def pass_at_k(n: Column, correct: Column, k: int) -> Column:
    """Unbiased estimate 1 - prod (n - c - i) / (n - i); fails when n < k."""
    if k < 1:
        raise ValueError("k must be at least 1")
    fail = F.aggregate(
        F.sequence(F.lit(0), F.lit(k - 1)), F.lit(1.0), lambda acc, i: acc * (n - correct - i) / (n - i)
    )
    return F.when(
        n < k, F.raise_error(F.format_string("a problem has %d samples, fewer than k", n.cast("bigint")))
    ).otherwise(F.when(correct == 0, 0.0).otherwise(1 - fail))


def pass_at_k_by(
    df: DataFrame, problem: str, score: str, k: int, by: Sequence[str] = ()
) -> DataFrame:
    """Problem-level counts first, so that few large sources cost nothing; then the average."""
    per_problem = df.groupBy(*by, problem).agg(
        F.count(F.lit(1)).alias("n"), F.sum(score).alias("c"), F.sum(score).alias("total")
    )
    out = per_problem.groupBy(*by) if by else per_problem.groupBy()
    return out.agg(
        F.avg(pass_at_k(F.col("n"), F.col("c"), k)).alias(f"pass_at_{k}"),
        (F.sum("total") / F.sum("n")).alias("test_score"),
        F.count(F.lit(1)).alias("problems"),
    )


def any_correct(df: DataFrame, problem: str, score: str, by: Sequence[str]) -> DataFrame:
    """Share of problems with at least one fully correct response."""
    solved = df.groupBy(*by, problem).agg(F.max(score).alias("top"))
    return solved.groupBy(*by).agg(
        F.avg((F.col("top") == 1).cast("int")).alias("any_correct"), F.count(F.lit(1)).alias("problems")
    )


def extra_means(df: DataFrame, source: str, keys: Sequence[str]) -> DataFrame:
    """Mean of each extra reward key per source, in long form."""
    means = df.groupBy(source).agg(*[F.avg(k).alias(k) for k in keys])
    return means.unpivot([source], list(keys), "key", "mean_value")


def best_and_worst(
    df: DataFrame, problem: str, score: str, order: Sequence[str], payload: Sequence[str]
) -> DataFrame:
    """One best and one worst sample per problem, the first in ``order`` on ties, with the mean score."""
    picked = F.struct(F.col(score).alias("score"), *[F.col(p) for p in payload])
    down = [(-F.col(o)).alias(f"o{i}") for i, o in enumerate(order)]
    up = [F.col(o).alias(f"o{i}") for i, o in enumerate(order)]
    agg = df.groupBy(problem).agg(
        F.max_by(picked, F.struct(F.col(score), *down)).alias("best"),
        F.min_by(picked, F.struct(F.col(score), *up)).alias("worst"),
        F.avg(score).alias("avg_score"),
    )
    both = F.array(
        F.struct(F.lit("best").alias("pick"), F.col("best").alias("s")),
        F.struct(F.lit("worst").alias("pick"), F.col("worst").alias("s")),
    )
    return agg.select(problem, "avg_score", F.explode(both).alias("r")).select(
        problem, F.col("r.pick").alias("pick"), F.col("r.s.score").alias("score"),
        *[F.col(f"r.s.{p}").alias(p) for p in payload], "avg_score",
    )


def first_per_source(df: DataFrame, source: str, order: Sequence[str], n: int) -> DataFrame:
    """First ``n`` rows of every source, with their rank from 1."""
    return first_rows(df, [source], [F.col(c) for c in order], n, "rank")


def shuffled_first(df: DataFrame, keys: Sequence[str], seed: int, n: int) -> DataFrame:
    """First ``n`` rows of a seeded shuffle, with their place from 0; only candidates are ranked, not the table."""
    digest = shuffle_key(seed, *keys)
    some = df.withColumn("__digest", digest).orderBy("__digest", *keys).limit(n)
    place = F.row_number().over(Window.orderBy("__digest", *keys))
    return some.withColumn("position", place.cast("bigint") - 1).select(*df.columns, "position")


def wide_samples(samples: DataFrame, step: str, slot: str, n: int, fields: Sequence[str]) -> DataFrame:
    """One row per step with n samples side by side."""
    aggs = [F.first(f, ignorenulls=True).alias(f) for f in fields]
    return samples.groupBy(step).pivot(slot, list(range(1, n + 1))).agg(*aggs)


def column_accuracy(samples: DataFrame, scores: str) -> DataFrame:
    """Accuracy of the i-th response over ragged score arrays, in percent with one decimal.

    A short array counts with its last value at the positions it lacks. Positions and
    array lengths are aggregated separately and meet in a running sum over lengths, so
    nothing is padded.
    """
    per_pos = samples.select(F.posexplode(F.col(scores)).alias("pos", "s")).groupBy("pos").agg(
        F.sum(F.col("s").cast("double")).alias("present")
    )
    ends = samples.groupBy(F.size(scores).alias("len")).agg(
        F.sum(F.element_at(F.col(scores), -1).cast("double")).alias("last_sum"), F.count(F.lit(1)).alias("cnt")
    )
    total = samples.agg(F.count(F.lit(1)).alias("n")).scalar()
    joined = per_pos.join(ends.select("len", "last_sum"), F.col("pos") == F.col("len"), "left")
    padded = running_total(
        joined, F.coalesce("last_sum", F.lit(0.0)), ["pos"], F.floor(F.col("pos") / 4096), out="pad"
    )
    return padded.select(
        F.col("pos").cast("bigint").alias("response"),
        F.round((F.col("present") + F.col("pad")) / total * 100, 1).alias("acc"),
    )


def type_accuracy(samples: DataFrame, kind: str, scores: str) -> DataFrame:
    """Accuracy per problem type on the last response, in percent with one decimal."""
    last = F.element_at(F.col(scores), -1).cast("double")
    return samples.groupBy(kind).agg(F.round(F.avg(last) * 100, 1).alias("acc"))


def evaluation_counts(samples: DataFrame, scores: str, timed_out: Column, last_pred: Column) -> DataFrame:
    return samples.agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.sum(F.size(scores).cast("bigint")).alias("num_scores"),
        F.sum(timed_out.cast("bigint")).alias("timeout_samples"),
        F.count_if(F.coalesce(last_pred, F.lit("")) == "").alias("empty_samples"),
    )


def keep_last_by(df: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of every key in ``order``."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return picked.select(key, *[F.col("r")[c].alias(c) for c in rest])


def flat_mean(df: DataFrame, dataset: str, score: Column) -> DataFrame:
    """Mean over all responses of a dataset, four decimals."""
    return df.groupBy(dataset).agg(F.round(F.avg(score), 4).alias("score"))


def majority_vote(df: DataFrame, problem: str, answer: str, order: str) -> DataFrame:
    """Most frequent answer per problem, the first seen on ties."""
    votes = df.groupBy(problem, answer).agg(F.count(F.lit(1)).alias("votes"), F.min(order).alias("seen"))
    return votes.groupBy(problem).agg(
        F.max_by(answer, F.struct(F.col("votes"), -F.col("seen"))).alias("answer"), F.max("votes").alias("votes")
    )


def spread_of(names: dict[str, Column]) -> list[Column]:
    """mean, max and min aggregates for each name."""
    out = []
    for name, c in names.items():
        out += [F.avg(c).alias(f"{name}_mean"), F.max(c).alias(f"{name}_max"), F.min(c).alias(f"{name}_min")]
    return out


def length_metrics(df: DataFrame, length: str, limit: Column, name: str) -> DataFrame:
    at_limit = F.avg((F.col(length) == limit).cast("int")).alias(f"{name}_clip_ratio")
    return df.agg(*spread_of({name: F.col(length)}), at_limit)


def critic_metrics(
    tokens: DataFrame, mask: str, advantage: str, ret: str, value: str
) -> DataFrame:
    """Token-level spread of advantages, returns and values over the mask, and explained variance."""
    def valid(c):
        return F.when(F.col(mask) > 0, F.col(c))

    explained = 1 - F.var_samp(valid(ret) - valid(value)) / (F.var_samp(valid(ret)) + 1e-5)
    names = {"advantages": valid(advantage), "returns": valid(ret), "values": valid(value)}
    return tokens.agg(*spread_of(names), explained.alias("vf_explained_var"))


def environment_metrics(trajectories: DataFrame) -> DataFrame:
    """Roll-up of the trajectory table: turns, finish, void and code ratios."""
    turns = F.col("turns")
    return trajectories.agg(
        *spread_of({"num_turns": turns}),
        F.avg((turns == 1).cast("int")).alias("num_one_turn"),
        (1 - F.avg(F.col("active").cast("int"))).alias("finish_ratio"),
        (1 - F.avg(F.col("no_void").cast("int"))).alias("void_turn_ratio"),
        F.avg("use_code").alias("num_code_use"),
        F.avg(F.col("use_code") / turns).alias("code_use_ratio"),
        F.avg("valid_code").alias("num_valid_code"),
        F.avg(F.col("valid_code") / turns).alias("valid_code_ratio"),
    )


def extra_statistics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """mean, max, min and population variance of extra reward columns, in long form."""
    stats = df.agg(*[
        F.struct(F.avg(k).alias("mean"), F.max(k).alias("max"), F.min(k).alias("min"), F.var_pop(k).alias("var")).alias(k)
        for k in keys
    ])
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).alias("s")) for k in keys])
    return stats.select(F.explode(rows).alias("r")).select(F.col("r.key").alias("key"), F.col("r.s.*"))


GENERATION = "gen"
ALL_TOKEN_SECTIONS = ("ref", "values", "adv", "update_critic", "update_actor")


def timing_metrics(timings: DataFrame, lengths: DataFrame) -> DataFrame:
    """Seconds per section and milliseconds per token.

    Generation is divided by response tokens, the listed other sections by all tokens,
    any further section has no per-token figure.
    """
    totals = lengths.agg(
        F.struct(F.sum("prompt_len").alias("p"), F.sum("resp_len").alias("r")).alias("t")
    ).scalar()
    per = F.when(F.col("section") == GENERATION, totals["r"]).when(
        F.col("section").isin(*ALL_TOKEN_SECTIONS), totals["p"] + totals["r"]
    )
    return timings.select(
        "section", F.col("seconds").alias("timing_s"), (F.col("seconds") * 1000 / per).alias("timing_per_token_ms")
    )


def throughput(steps: DataFrame, gpus: int) -> DataFrame:
    """Tokens, seconds and tokens per second and device, per step."""
    return steps.groupBy("step").agg(
        F.sum("tokens").alias("total_num_tokens"), F.sum("seconds").alias("time_per_step")
    ).withColumn("throughput", F.col("total_num_tokens") / (F.col("time_per_step") * gpus))


def reduce_metrics(long: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Mean per metric name; a listed name without values is zero."""
    means = long.groupBy("metric").agg(F.avg("value").alias("value"))
    if names is None:
        return means.select("metric", F.coalesce("value", F.lit(0.0)).alias("value"))
    return names.select("metric").distinct().join(means, "metric", "left").select(
        "metric", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def dense_flops(lengths: DataFrame, length: str, config: dict, seconds: float, by: Sequence[str] = ()) -> DataFrame:
    """Teraflops per second of a dense transformer: 6 * parameters * tokens plus attention."""
    head = config["hidden_size"] // config["num_attention_heads"]
    q = config["num_attention_heads"] * head
    kv = config["num_key_value_heads"] * head
    mlp = config["hidden_size"] * config["intermediate_size"] * 3
    attention = config["hidden_size"] * (q + kv + kv + q)
    embedding = config["vocab_size"] * config["hidden_size"] * 2
    params = (mlp + attention) * config["num_hidden_layers"] + embedding
    per_square = 12 * head * config["num_attention_heads"] * config["num_hidden_layers"]
    return _flops(lengths, length, params, per_square, seconds, by)


def expert_flops(lengths: DataFrame, length: str, config: dict, seconds: float, by: Sequence[str] = ()) -> DataFrame:
    """The same for a mixture-of-experts model with low-rank attention projections."""
    hidden, heads, layers = config["hidden_size"], config["num_attention_heads"], config["num_hidden_layers"]
    q_head = config["qk_nope_head_dim"] + config["qk_rope_head_dim"]
    gate = hidden * config["n_routed_experts"]
    experts = hidden * config["moe_intermediate_size"] * (config["num_experts_per_tok"] + config["n_shared_experts"]) * 3
    rank = config.get("q_lora_rank")
    attention = hidden * heads * q_head if rank is None else hidden * rank + heads * q_head * rank
    attention += hidden * (config["kv_lora_rank"] + config["qk_rope_head_dim"])
    attention += heads * (q_head - config["qk_rope_head_dim"] + config["v_head_dim"]) * config["kv_lora_rank"]
    attention += heads * config["v_head_dim"] * hidden
    dense_layers = config["first_k_dense_replace"]
    params = (
        (gate + experts + attention) * (layers - dense_layers)
        + (hidden * config["intermediate_size"] * 3 + attention) * dense_layers
        + config["vocab_size"] * hidden * 2
    )
    return _flops(lengths, length, params, 12 * layers * q_head * heads, seconds, by)


def _flops(
    lengths: DataFrame, length: str, params: int, per_square: int, seconds: float, by: Sequence[str]
) -> DataFrame:
    n = F.col(length).cast("double")
    total = F.lit(float(6 * params)) * F.sum(n) + F.lit(float(per_square)) * F.sum(n * n)
    grouped = lengths.groupBy(*by) if by else lengths.groupBy()
    return grouped.agg((total / F.lit(seconds) / F.lit(1e12)).alias("tflops"))


def add_mean_per_prompt(df: DataFrame, prompt: str, score: str, out: str = "avg_score") -> DataFrame:
    """avg@n next to every sample of the prompt."""
    return attach_group_stats(df, [prompt], [F.avg(score).alias(out)])
