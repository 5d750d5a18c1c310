"""Queries over rewards, advantages, group rejection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import advantage as G
from ..operators import resample as I
from ..operators import scans as N
from ..operators.groups import lookup_join
from ..operators.tokens import explode_tokens
from .registry import Tables, query, r6

SEQ = ["seq_id", "uid", "pos"]


HOUR_SQL = "timestampdiff(HOUR, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"


def _long(df, arrays, keep=("seq_id",)):
    return explode_tokens(df, arrays, keep=keep)


@query("g01_score_on_last_token", f"""
SELECT seq_id, pos, CASE WHEN pos = n - 1 THEN score ELSE 0e0 END AS reward
FROM (SELECT *, sum(mask) OVER (PARTITION BY seq_id) AS n FROM @tok)""")
def _(t: Tables):
    s = t.sequences().withColumn("reward", G.score_on_last_token(F.col("mask"), F.col("score")))
    return _long(s, ["reward"])


@query("g02_tool_use_half_credit", """
SELECT uid, line, part, supp, price, CASE WHEN part % 3 = 0 THEN score * 0.5 ELSE score END AS credited FROM @rollouts""")
def _(t: Tables):
    r = t.view("rollouts").withColumn("true_tool_use", F.when(F.col("part") % 3 == 0, 0).otherwise(1))
    return r.select("uid", "line", "part", "supp", "price", G.tool_use_credit(F.col("score"), F.col("true_tool_use")).alias("credited"))


@query("g03_model_score_to_tokens", f"""
SELECT seq_id, pos - 16 AS pos, {r6("CASE WHEN pos = last_pos THEN e ELSE 0e0 END")} AS rm_score FROM (
SELECT *, max(CASE WHEN mask = 1 THEN pos END) OVER (PARTITION BY seq_id) AS last_pos FROM @tok) WHERE pos >= 16""")
def _(t: Tables):
    positions = F.transform("mask", lambda m, i: i * m)
    s = t.sequences().withColumn("positions", positions)
    s = s.withColumn("rm_score", G.expand_model_score(F.col("e"), F.col("positions"), F.col("mask"), 48))
    return _long(s, ["rm_score"]).withColumn("rm_score", F.round("rm_score", 6))


@query("g04_kl_estimators", f"""
SELECT seq_id, pos, {r6("old_lp - ref_lp")} AS kl, {r6("abs(old_lp - ref_lp)")} AS kl_abs,
{r6("0.5 * (old_lp - ref_lp) * (old_lp - ref_lp)", 8)} AS kl_mse,
{r6("greatest(least(exp(ref_lp - old_lp) - (ref_lp - old_lp) - 1, 10), -10)", 8)} AS low_var_kl FROM @tok""")
def _(t: Tables):
    tok = _long(t.sequences(), ["old_lp", "ref_lp"])
    lp, ref = F.col("old_lp"), F.col("ref_lp")
    return tok.select(
        "seq_id", "pos",
        F.round(G.kl_penalty(lp, ref, "kl"), 6).alias("kl"),
        F.round(G.kl_penalty(lp, ref, "abs"), 6).alias("kl_abs"),
        F.round(G.kl_penalty(lp, ref, "mse"), 8).alias("kl_mse"),
        F.round(G.kl_penalty(lp, ref, "low_var_kl"), 8).alias("low_var_kl"),
    )


def _shaped(t: Tables):
    s = t.sequences().withColumn("reward", G.score_on_last_token(F.col("mask"), F.col("score")))
    tok = _long(s, ["reward", "old_lp", "ref_lp", "loss_mask"])
    return G.kl_shaped_rewards(tok, "reward", "old_lp", "ref_lp", "loss_mask", 0.05, "low_var_kl")


_SHAPED_SQL = """
SELECT *, (CASE WHEN pos = n - 1 THEN score ELSE 0e0 END) - 0.05 * kld AS token_reward FROM (
SELECT *, sum(mask) OVER (PARTITION BY seq_id) AS n,
greatest(least(exp(ref_lp - old_lp) - (ref_lp - old_lp) - 1, 10), -10) * loss_mask AS kld FROM @tok)"""


@query("g05_kl_shaped_rewards", f"SELECT seq_id, pos, {r6('token_reward', 8)} AS token_reward FROM ({_SHAPED_SQL})")
def _(t: Tables):
    return _shaped(t).select("seq_id", "pos", F.round("token_reward", 8).alias("token_reward"))


@query("g05_kl_penalty_metrics", f"""
SELECT {r6('avg(k)', 8)} AS reward_kl_penalty, 5e-2 AS reward_kl_penalty_coeff FROM (
SELECT seq_id, sum(kld * loss_mask) / (sum(loss_mask) + 1e-8) AS k FROM ({_SHAPED_SQL}) GROUP BY seq_id)""")
def _(t: Tables):
    m = G.mean_sequence_kl(_shaped(t), "loss_mask", 0.05)
    return m.select(F.round("reward_kl_penalty", 8).alias("reward_kl_penalty"), "reward_kl_penalty_coeff")


@query("g06_simple_kl_rewards", f"SELECT seq_id, pos, {r6('score - (old_lp - ref_lp) * 0.1')} AS reward FROM @tok")
def _(t: Tables):
    tok = explode_tokens(t.sequences(), ["old_lp", "ref_lp"], keep=("seq_id", "score"))
    return tok.select("seq_id", "pos", F.round(G.simple_rewards(F.col("score"), F.col("old_lp"), F.col("ref_lp"), 0.1), 6).alias("reward"))


@query("g07_adaptive_kl_coefficient", f"""
WITH s AS (SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS step, avg(value) / 100 AS kl, count(*) AS n FROM events GROUP BY 1),
f AS (SELECT step, n, kl, 1 + greatest(least(kl / 0.5 - 1, 0.2), -0.2) * n / 10000 AS m FROM s)
SELECT step, {r6('kl', 9)} AS kl, {r6('0.2 * exp(sum(ln(m)) OVER (ORDER BY step ROWS UNBOUNDED PRECEDING))')} AS kl_coef FROM f""")
def _(t: Tables):
    steps = t.table("events").groupBy(F.expr(HOUR_SQL).alias("step")).agg(
        (F.avg("value") / 100).alias("kl"), F.count(F.lit(1)).alias("n")
    )
    out = G.adaptive_kl_coefficient(steps, "step", "kl", "n", 0.2, 0.5, 10000.0)
    return out.select("step", F.round("kl", 9).alias("kl"), F.round("kl_coef", 6).alias("kl_coef"))


@query("g07_fixed_kl_coefficient", "SELECT DISTINCT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS step, 1e-3 AS kl_coef FROM events")
def _(t: Tables):
    steps = t.table("events").select(F.expr(HOUR_SQL).alias("step")).distinct()
    return G.fixed_kl_coefficient(steps, 1e-3)


ROW = "uid, line, part, supp, price"
ROWC = ["uid", "line", "part", "supp", "price"]


@query("g08_grpo_advantage", f"""
SELECT {ROW}, {r6('(score - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE s END + 1e-6)', 4)} AS advantage FROM (
SELECT *, count(*) OVER w AS n, avg(score) OVER w AS m, stddev_samp(score) OVER w AS s FROM @rollouts WINDOW w AS (PARTITION BY uid))""")
def _(t: Tables):
    return G.grpo_advantage(t.view("rollouts")).select(*ROWC, F.round("advantage", 4).alias("advantage"))


@query("g08_grpo_advantage_tokens", f"""
SELECT s.seq_id, pos, {r6('a * mask')} AS advantage FROM @tok s JOIN (
SELECT seq_id, (score - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE sd END + 1e-6) AS a FROM (
SELECT *, count(*) OVER w AS n, avg(score) OVER w AS m, stddev_samp(score) OVER w AS sd
FROM (SELECT DISTINCT seq_id, uid, score FROM @tok) WINDOW w AS (PARTITION BY uid))) g ON s.seq_id = g.seq_id""")
def _(t: Tables):
    scored = G.grpo_advantage(t.sequences().select("seq_id", "uid", "mask", "score"))
    spread = scored.withColumn("advantage", G.spread_over_tokens(F.col("advantage"), F.col("mask")))
    return _long(spread, ["advantage"]).withColumn("advantage", F.round("advantage", 6))


@query("g09_rloo_advantage", f"""
SELECT {ROW}, {r6('CASE WHEN n > 1 THEN score * n / (n - 1) - m * n / (n - 1) ELSE score END')} AS advantage FROM (
SELECT *, count(*) OVER w AS n, avg(score) OVER w AS m FROM @rollouts WINDOW w AS (PARTITION BY uid))""")
def _(t: Tables):
    return G.rloo_advantage(t.view("rollouts")).select(*ROWC, F.round("advantage", 6).alias("advantage"))


def _token_rewards(t: Tables):
    # a dense reward stream, so that discounting and resets matter at every position
    return t.sequences().withColumn("rewards", F.zip_with("e", "new_lp", lambda e, n: e - n * 0.25))


_RET_SQL = """
SELECT a.seq_id, a.pos, a.mask, sum(pow(0.9, b.pos - a.pos) * b.r *
CASE WHEN a.pos = b.pos THEN 1 WHEN b.pos < a.width AND a.first_zero > b.pos THEN 1 ELSE 0 END) AS ret
FROM (SELECT *, e - new_lp * 0.25 AS r, 16 + seq_id % 49 AS first_zero FROM @tok) a
JOIN (SELECT seq_id, pos, e - new_lp * 0.25 AS r FROM @tok) b ON a.seq_id = b.seq_id AND b.pos >= a.pos
GROUP BY 1, 2, 3"""


_G10_SQL = f"""
WITH r AS ({_RET_SQL}), s AS (SELECT sum(ret * mask) / (sum(mask) + 1e-8) AS mu, sum(mask) AS n FROM r),
v AS (SELECT sum(mask * (ret - mu) * (ret - mu)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM r, s)
SELECT seq_id, pos, {r6('ret')} AS returns, {r6('(ret - mu) / sqrt(var + 1e-8) * mask')} AS advantages FROM r, s, v"""


def _scan_tokens(t: Tables):
    return explode_tokens(_token_rewards(t), ["rewards", "e", "mask"], keep=("seq_id", "uid"))


def _advantages(out):
    return out.select("seq_id", "pos", F.round("returns", 6).alias("returns"), F.round("advantages", 6).alias("advantages"))


@query("g10_discounted_returns_scan", _G10_SQL)
def _(t: Tables):
    return _advantages(N.discounted_returns(_scan_tokens(t), "rewards", "mask", 0.9, chunk=16))


@query("g10_reinforce_plus_plus", _G10_SQL)
def _(t: Tables):
    out = G.compute_advantage(_token_rewards(t), "reinforce_plus_plus", rewards="rewards", mask="mask", gamma=0.9)
    return _long(out, ["returns", "advantages"]).select(
        "seq_id", "pos", F.round("returns", 6).alias("returns"), F.round("advantages", 6).alias("advantages"))


_G11_SQL = f"""
WITH b AS (SELECT CAST(label AS BIGINT) AS uid, avg(CAST(embedding[1] AS DOUBLE)) AS baseline FROM embeddings GROUP BY 1),
r AS (SELECT *, sum((e - new_lp * 0.25) * mask) OVER (PARTITION BY seq_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS ret FROM @tok)
SELECT seq_id, pos, {r6('ret')} AS returns, {r6('ret - baseline * mask')} AS advantages FROM r JOIN b ON r.uid = b.uid"""


@query("g11_baseline_returns_scan", _G11_SQL)
def _(t: Tables):
    baselines = t.sequences().groupBy("uid").agg(F.avg(F.get("e", F.lit(0))).alias("baseline"))
    return _advantages(N.baseline_returns(lookup_join(_scan_tokens(t), baselines, ["uid"]), "rewards", "mask", "baseline", chunk=16))


@query("g11_remax", _G11_SQL)
def _(t: Tables):
    seqs = _token_rewards(t)
    baselines = t.sequences().groupBy("uid").agg(F.avg(F.get("e", F.lit(0))).alias("baseline"))
    out = G.compute_advantage(seqs, "remax", baselines=baselines, rewards="rewards", mask="mask", key="uid")
    return _long(out, ["returns", "advantages"]).select(
        "seq_id", "pos", F.round("returns", 6).alias("returns"), F.round("advantages", 6).alias("advantages"))


_G12_SQL = f"""
WITH d AS (SELECT *, (e - new_lp * 0.25) + 0.98 * coalesce(lead(e) OVER (PARTITION BY seq_id ORDER BY pos), 0) - e AS delta FROM @tok),
a AS (SELECT x.seq_id, x.pos, x.mask, x.e, sum(pow(0.98 * 0.9, y.pos - x.pos) * y.delta) AS adv FROM d x JOIN d y ON x.seq_id = y.seq_id AND y.pos >= x.pos GROUP BY 1, 2, 3, 4),
s AS (SELECT sum(adv * mask) / (sum(mask) + 1e-8) AS mu, sum(mask) AS n FROM a),
v AS (SELECT sum(mask * (adv - mu) * (adv - mu)) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM a, s)
SELECT seq_id, pos, {r6('adv + e')} AS returns, {r6('(adv - mu) / sqrt(var + 1e-8)')} AS advantages FROM a, s, v"""


@query("g12_gae_scan", _G12_SQL)
def _(t: Tables):
    return _advantages(N.gae_tokens(_scan_tokens(t), "rewards", "e", "mask", 0.98, 0.9, chunk=16))


@query("g12_gae", _G12_SQL)
def _(t: Tables):
    out = G.compute_advantage(_token_rewards(t), "gae", rewards="rewards", values="e", mask="mask", gamma=0.98, lam=0.9)
    return _long(out, ["returns", "advantages"]).select(
        "seq_id", "pos", F.round("returns", 6).alias("returns"), F.round("advantages", 6).alias("advantages"))


@query("g13_estimator_by_name", f"""
SELECT estimator, data_source, count(*) AS n, {r6('sum(abs(adv))', 3)} AS total FROM (
SELECT 'grpo' AS estimator, data_source, (soft - CASE WHEN n = 1 THEN 0 ELSE m END) / (CASE WHEN n = 1 THEN 1 ELSE s END + 1e-6) AS adv FROM
(SELECT *, count(*) OVER w AS n, avg(soft) OVER w AS m, stddev_samp(soft) OVER w AS s FROM @rollouts WINDOW w AS (PARTITION BY uid))
UNION ALL SELECT 'rloo', data_source, CASE WHEN n > 1 THEN soft * n / (n - 1) - m * n / (n - 1) ELSE soft END FROM
(SELECT *, count(*) OVER w AS n, avg(soft) OVER w AS m, stddev_samp(soft) OVER w AS s FROM @rollouts WINDOW w AS (PARTITION BY uid))) GROUP BY 1, 2""")
def _(t: Tables):
    rows = t.view("rollouts")
    parts = [
        G.compute_advantage(rows, name, score="soft").select(F.lit(name).alias("estimator"), "data_source", "advantage")
        for name in ("grpo", "rloo")
    ]
    return parts[0].unionByName(parts[1]).groupBy("estimator", "data_source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum(F.abs("advantage")), 3).alias("total"))


@query("g14_sequence_score", f"SELECT seq_id, {r6('sum(e - new_lp * 0.25)')} AS score FROM @tok GROUP BY 1")
def _(t: Tables):
    return _token_rewards(t).select("seq_id", F.round(A.array_sum("rewards"), 6).alias("score"))


@query("g15_accuracy_column", f"""
SELECT {ROW}, score, CASE WHEN tax >= 0.08 THEN 0e0 ELSE score END AS acc FROM @rollouts""")
def _(t: Tables):
    from ..operators.scoring import settle_score

    r = t.view("rollouts").withColumn("failed", F.col("tax") >= 0.08)
    return r.select(*ROWC, "score", settle_score(F.col("score"), F.col("failed"))["score"].alias("acc"))


# ---------------------------------------------------------------- rejection of groups

RULES = dict(acc_low=0.1, acc_high=0.6, remove_clip=True, min_n=2)
MAXLEN = 48

_GROUPS_SQL = f"""
SELECT *, is_flat OR is_low OR is_high OR is_over_long AS is_filtered FROM (
SELECT *, NOT is_flat AND g_mean < 0.1 AS is_low, NOT is_flat AND g_mean > 0.6 AS is_high,
g_over = g_n OR g_n - g_over < 2 AS is_over_long FROM (
SELECT *, coalesce(g_std < 1e-3, false) AS is_flat FROM (
SELECT uid, count(*) AS g_n, avg(score) AS g_mean, stddev_samp(score) AS g_std, bool_and(score = 0) AS is_none, bool_and(score = 1) AS is_all,
stddev_samp(resp_len) AS g_len_std, CAST(count_if(resp_len >= {MAXLEN}) AS BIGINT) AS g_over FROM @rollouts GROUP BY uid)))"""


def _groups(t: Tables):
    return I.group_table(t.view("rollouts"), "uid", "score", "resp_len", MAXLEN, **RULES)


@query("i01_drop_flat_groups", f"""
SELECT {ROW}, score FROM (SELECT *, stddev_samp(score) OVER (PARTITION BY uid) AS s FROM @rollouts) WHERE s IS NULL OR s >= 1e-3""")
def _(t: Tables):
    return I.keep_valid(t.view("rollouts"), "uid", "score", "resp_len", 10**9).select(*ROWC, "score")


@query("i02_accuracy_band", f"SELECT uid, is_flat, is_low, is_high, {r6('g_mean')} AS g_mean FROM ({_GROUPS_SQL})")
def _(t: Tables):
    return _groups(t).select("uid", "is_flat", "is_low", "is_high", F.round("g_mean", 6).alias("g_mean"))


@query("i03_solved_none_or_all", f"SELECT count_if(is_none)::BIGINT AS solve_none, count_if(is_all)::BIGINT AS solve_all FROM ({_GROUPS_SQL})")
def _(t: Tables):
    return I.funnel(_groups(t)).select("solve_none", "solve_all")


@query("i04_over_long_groups", f"SELECT uid, g_n, g_over FROM ({_GROUPS_SQL}) WHERE is_over_long")
def _(t: Tables):
    return _groups(t).where("is_over_long").select("uid", "g_n", "g_over")


@query("i05_group_funnel", f"""
SELECT count(*) AS groups, count_if(is_none)::BIGINT AS solve_none, count_if(is_all)::BIGINT AS solve_all, count_if(is_high)::BIGINT AS solve_high,
count_if(is_low)::BIGINT AS solve_low, count_if(is_over_long)::BIGINT AS over_long_all, sum(g_over)::BIGINT AS response_clip_number,
{r6('avg(g_len_std)')} AS length_vars, count_if(is_filtered)::BIGINT AS filter_all FROM ({_GROUPS_SQL})""")
def _(t: Tables):
    return I.funnel(_groups(t)).withColumn("length_vars", F.round("length_vars", 6))


@query("i06_keep_valid_rows", f"""
SELECT {', '.join('r.' + c for c in ROWC)} FROM @rollouts r JOIN ({_GROUPS_SQL}) g ON r.uid = g.uid WHERE NOT g.is_filtered""")
def _(t: Tables):
    return I.keep_valid(t.view("rollouts"), "uid", "score", "resp_len", MAXLEN, **RULES).select(*ROWC)


@query("i06_effective_batch", f"""
SELECT CAST(floor(count(*) / 4) AS BIGINT) AS valid_groups, CAST(least(floor(count(*) / 4), 512) AS BIGINT) AS effective_batch_size
FROM @rollouts r JOIN ({_GROUPS_SQL}) g ON r.uid = g.uid WHERE NOT g.is_filtered""")
def _(t: Tables):
    rows = I.keep_valid(t.view("rollouts"), "uid", "score", "resp_len", MAXLEN, **RULES)
    return I.effective_groups(rows, 4, 512)


@query("i07_refill_groups", f"""
WITH k AS (SELECT r.* FROM @rollouts r JOIN ({_GROUPS_SQL}) g ON r.uid = g.uid WHERE NOT g.is_filtered),
v AS (SELECT count(DISTINCT uid) AS v FROM k)
SELECT concat(CAST(uid AS STRING), '_', CAST(c AS STRING)) AS uid, line, part, supp, price, c AS copy FROM (
SELECT k.*, unnest(range(0, CAST(1 + floor((9999 - 1) / v) AS BIGINT))) AS c FROM k, v WHERE v < 9999)
UNION ALL SELECT CAST(uid AS STRING), line, part, supp, price, 0 FROM k, v WHERE v >= 9999""")
def _(t: Tables):
    rows = I.keep_valid(t.view("rollouts"), "uid", "score", "resp_len", MAXLEN, **RULES)
    return I.refill(rows, "uid", 9999, I.group_count(rows, "uid")).select(*ROWC, "copy")


@query("i08_downsample_groups", f"""
SELECT {', '.join('r.' + c for c in ROWC)} FROM @rollouts r JOIN (
SELECT uid FROM (SELECT DISTINCT uid FROM @rollouts) ORDER BY md5(concat(CAST(uid AS STRING), '-', '7')), uid LIMIT 500) g ON r.uid = g.uid""")
def _(t: Tables):
    return I.downsample_groups(t.view("rollouts"), "uid", 500, 7).select(*ROWC)
