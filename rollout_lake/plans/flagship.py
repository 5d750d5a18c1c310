"""The flagship query: rejection sampling, group-relative advantages, report per source."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import resample as I
from ..operators.groups import attach_group_stats
from .registry import Tables, query, r6

MAX_LENGTH = 48


@query("entry_grpo_with_rejection", f"""
SELECT data_source, count(*) AS samples, count(DISTINCT uid) AS prompts, {r6('avg(score)')} AS mean_score,
{r6('avg(abs(adv))')} AS mean_abs_advantage, {r6('max(adv)')} AS max_advantage, {r6('min(adv)')} AS min_advantage FROM (
SELECT *, (score - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE s END + 1e-6) AS adv FROM (
SELECT *, count(*) OVER w AS n, avg(score) OVER w AS m, stddev_samp(score) OVER w AS s, count_if(resp_len >= {MAX_LENGTH}) OVER w AS o
FROM @rollouts WINDOW w AS (PARTITION BY uid))
WHERE (s IS NULL OR s >= 1e-3) AND o < n AND (m >= 0.05 AND m <= 0.95)) GROUP BY data_source""")
def _(t: Tables):
    # the verdict and the advantage need the same group statistics: one aggregate, one join
    rows = t.view("rollouts").select("uid", "data_source", "score", "resp_len")
    stated = attach_group_stats(rows, ["uid"], I.group_aggregates("score", "resp_len", MAX_LENGTH))
    flags = I.group_rules(acc_low=0.05, acc_high=0.95)
    kept = stated.where(~(flags["is_flat"] | flags["is_low"] | flags["is_high"] | flags["is_over_long"]))
    alone = F.col("g_n") == 1
    advantage = (F.col("score") - F.when(alone, 0.0).otherwise(F.col("g_mean"))) / (
        F.when(alone, 1.0).otherwise(F.col("g_std")) + 1e-6
    )
    # rows first shrink to one per source and prompt, so a large source spreads over its prompts
    per_prompt = kept.withColumn("advantage", advantage).groupBy("data_source", "uid").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").alias("score"), F.sum(F.abs("advantage")).alias("a"),
        F.max("advantage").alias("hi"), F.min("advantage").alias("lo"),
    )
    return per_prompt.groupBy("data_source").agg(
        F.sum("n").alias("samples"),
        F.count(F.lit(1)).alias("prompts"),
        F.round(F.sum("score") / F.sum("n"), 6).alias("mean_score"),
        F.round(F.sum("a") / F.sum("n"), 6).alias("mean_abs_advantage"),
        F.round(F.max("hi"), 6).alias("max_advantage"),
        F.round(F.min("lo"), 6).alias("min_advantage"),
    )
