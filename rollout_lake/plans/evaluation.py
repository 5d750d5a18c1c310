"""Queries over evaluation roll-ups and batch metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as J
from ..operators.ordering import first_rows, shuffle_key
from ..operators.tokens import explode_tokens
from .registry import Tables, query, r6

ROWC = ["uid", "line", "part", "supp", "price"]


def _pass_sql(k: int, c: str = "c", n: str = "n") -> str:
    terms = " * ".join(f"(({n} - {c} - {i}) / ({n} - {i}))" for i in range(k))
    return f"(CASE WHEN {c} = 0 THEN 0 ELSE 1 - {terms} END)"


@query("j01_pass_at_k", f"SELECT {r6(f'avg({_pass_sql(4)})')} AS pass_at_4, {r6('sum(c) / sum(n)')} AS test_score, count(*) AS problems FROM (SELECT part, count(*) AS n, sum(score) AS c FROM @rollouts GROUP BY 1)")
def _(t: Tables):
    p = J.pass_at_k_by(t.view("rollouts"), "part", "score", 4)
    return p.select(F.round("pass_at_4", 6).alias("pass_at_4"), F.round("test_score", 6).alias("test_score"), "problems")


@query("j02_any_correct", f"SELECT data_source, {r6('avg(CASE WHEN top = 1 THEN 1 ELSE 0 END)')} AS any_correct, count(*) AS problems FROM (SELECT data_source, uid, max(score) AS top FROM @rollouts GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables):
    a = J.any_correct(t.view("rollouts"), "uid", "score", ["data_source"])
    return a.select("data_source", F.round("any_correct", 6).alias("any_correct"), "problems")


@query("j03_score_per_source", f"SELECT data_source, {r6(f'avg({_pass_sql(2)})')} AS pass_at_2, {r6('sum(c) / sum(n)')} AS test_score, count(*) AS problems FROM (SELECT data_source, supp, count(*) AS n, sum(score) AS c FROM @rollouts GROUP BY 1, 2) GROUP BY 1")
def _(t: Tables):
    p = J.pass_at_k_by(t.view("rollouts"), "supp", "score", 2, by=["data_source"])
    return p.select("data_source", F.round("pass_at_2", 6).alias("pass_at_2"), F.round("test_score", 6).alias("test_score"), "problems")


@query("j04_extra_reward_means", f"SELECT data_source, 'soft' AS key, {r6('avg(soft)')} AS mean_value FROM @rollouts GROUP BY 1 UNION ALL SELECT data_source, 'tax', {r6('avg(tax)')} FROM @rollouts GROUP BY 1")
def _(t: Tables):
    m = J.extra_means(t.view("rollouts"), "data_source", ["soft", "tax"])
    return m.select("data_source", "key", F.round("mean_value", 6).alias("mean_value"))


@query("j05_mean_per_prompt", f"SELECT uid, line, part, supp, price, {r6('avg(score) OVER (PARTITION BY uid)')} AS avg_score FROM @rollouts")
def _(t: Tables):
    return J.add_mean_per_prompt(t.view("rollouts"), "uid", "score").select(*ROWC, F.round("avg_score", 6).alias("avg_score"))


@query("j06_best_and_worst", f"""SELECT uid, 'best' AS pick, score, line, part, supp, {r6('a')} AS avg_score FROM (SELECT *, avg(score) OVER (PARTITION BY uid) AS a, row_number() OVER (PARTITION BY uid ORDER BY score DESC, line, part, supp) AS r FROM @rollouts) WHERE r = 1
UNION ALL SELECT uid, 'worst', score, line, part, supp, {r6('a')} FROM (SELECT *, avg(score) OVER (PARTITION BY uid) AS a, row_number() OVER (PARTITION BY uid ORDER BY score, line, part, supp) AS r FROM @rollouts) WHERE r = 1""")
def _(t: Tables):
    b = J.best_and_worst(t.view("rollouts"), "uid", "score", ["line", "part", "supp"], ["line", "part", "supp"])
    return b.withColumn("avg_score", F.round("avg_score", 6))


@query("j06_first_generations_per_source", """SELECT source, doc_id, r AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 3""")
def _(t: Tables):
    f = J.first_per_source(t.table("documents").select("source", "doc_id"), "source", ["doc_id"], 3)
    return f.withColumn("rank", F.col("rank").cast("bigint"))


@query("j07_shuffled_first", "SELECT doc_id, row_number() OVER (ORDER BY md5(concat(CAST(doc_id AS STRING), '-42')), doc_id) - 1 AS position FROM documents QUALIFY position < 64")
def _(t: Tables):
    return J.shuffled_first(t.table("documents").select("doc_id"), ["doc_id"], 42, 64)


_WIDE = "SELECT step, part, score, row_number() OVER (PARTITION BY step ORDER BY md5(concat_ws('-', uid, line, part, supp, '3')), uid, line, part, supp) AS r FROM @rollouts"


@query("j08_wide_samples", "SELECT step, " + ", ".join(f"max(CASE WHEN r = {i} THEN part END) AS \"{i}_part\", max(CASE WHEN r = {i} THEN score END) AS \"{i}_score\"" for i in (1, 2, 3)) + f" FROM ({_WIDE}) WHERE r <= 3 GROUP BY 1")
def _(t: Tables):
    rows = t.view("rollouts").select("step", "uid", "line", "part", "supp", "score")
    keys = ["uid", "line", "part", "supp"]
    keyed = rows.withColumn("digest", shuffle_key(3, *keys))
    ranked = first_rows(keyed, ["step"], [F.col(c) for c in ("digest", *keys)], 3, "slot")
    return J.wide_samples(ranked, "step", "slot", 3, ["part", "score"])


def _ragged(t: Tables):
    """Per problem the verdicts of its responses: as many as its mask allows."""
    right = F.filter(F.zip_with("e", "mask", lambda e, m: F.when(m == 1, e > 0.02)), lambda s: s.isNotNull())
    return t.sequences().select("seq_id", "uid", right.alias("scores"))


_RAGGED_SQL = "SELECT seq_id, uid, pos, CASE WHEN e > 0.02 THEN 1 ELSE 0 END AS s, sum(mask) OVER (PARTITION BY seq_id) AS n FROM @tok WHERE mask = 1"


@query("j09_column_accuracy", f"""WITH r AS ({_RAGGED_SQL}), p AS (SELECT x.seq_id, p.pos, coalesce(a.s, b.s) AS s FROM (SELECT DISTINCT seq_id, n FROM r) x, (SELECT unnest(range(0, (SELECT CAST(max(n) AS BIGINT) FROM r))) AS pos) p
LEFT JOIN r a ON a.seq_id = x.seq_id AND a.pos = p.pos LEFT JOIN r b ON b.seq_id = x.seq_id AND b.pos = x.n - 1)
SELECT pos AS response, {r6('avg(s) * 100', 1)} AS acc FROM p GROUP BY 1""")
def _(t: Tables):
    return J.column_accuracy(_ragged(t), "scores")


@query("j10_type_accuracy", f"SELECT uid, {r6('avg(s) * 100', 1)} AS acc FROM ({_RAGGED_SQL}) WHERE pos = n - 1 GROUP BY 1")
def _(t: Tables):
    return J.type_accuracy(_ragged(t), "uid", "scores")


@query("j11_evaluation_counts", "SELECT count(*) AS num_samples, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS num_scores, CAST(sum(CASE WHEN n_chars > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS timeout_samples, CAST(count_if(lang = 'en') AS BIGINT) AS empty_samples FROM documents")
def _(t: Tables):
    d = t.table("documents").withColumn("preds", F.split("text", " "))
    last = F.when(F.col("lang") != "en", F.element_at("preds", -1).isNotNull().cast("string"))
    return J.evaluation_counts(d, "preds", F.col("n_chars") > 5000, last)


@query("j12_keep_last_by_index", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1")
def _(t: Tables):
    kept = J.keep_last_by(t.table("conversations"), "conv_id", F.col("turn"))
    return kept.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("j13_flat_mean_per_dataset", f"SELECT uid % 3 AS dataset, {r6('avg(s)', 4)} AS score FROM ({_RAGGED_SQL}) GROUP BY 1")
def _(t: Tables):
    flat = _ragged(t).select((F.col("uid") % 3).alias("dataset"), F.explode("scores").alias("s"))
    return J.flat_mean(flat, "dataset", F.col("s").cast("int"))


@query("j14_majority_vote", """SELECT problem_id, pred AS answer, votes FROM (SELECT *, row_number() OVER (PARTITION BY problem_id ORDER BY votes DESC, seen) AS r FROM (
SELECT problem_id, pred, count(*) AS votes, min(case_id) AS seen FROM @answers GROUP BY 1, 2)) WHERE r = 1""")
def _(t: Tables):
    return J.majority_vote(t.view("answers"), "problem_id", "pred", "case_id")


def _spread(names):
    return ", ".join(f"{r6(f'avg({e})')} AS {n}_mean, {r6(f'max({e})')} AS {n}_max, {r6(f'min({e})')} AS {n}_min" for n, e in names.items())


def _round_all(df, digits=6):
    numeric = {c for c, ty in df.dtypes if ty == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in numeric else F.col(c) for c in df.columns])


@query("j15_critic_metrics", f"SELECT {_spread({'advantages': 'adv', 'returns': 'new_lp', 'values': 'old_lp'})}, {r6('1 - var_samp(new_lp - old_lp) / (var_samp(new_lp) + 1e-5)')} AS vf_explained_var FROM @tok WHERE mask > 0")
def _(t: Tables):
    tok = explode_tokens(t.sequences(), ["new_lp", "old_lp", "mask"], keep=("seq_id", "adv"))
    return _round_all(J.critic_metrics(tok, "mask", "adv", "new_lp", "old_lp"))


@query("j15_score_metrics", f"SELECT {_spread({'score': 'score', 'rewards': 'soft'})} FROM @rollouts")
def _(t: Tables):
    return _round_all(t.view("rollouts").agg(*J.spread_of({"score": F.col("score"), "rewards": F.col("soft")})))


@query("j16_length_metrics", f"SELECT {r6('avg(resp_len)')} AS response_length_mean, max(resp_len) AS response_length_max, min(resp_len) AS response_length_min, {r6('avg(CASE WHEN resp_len = m THEN 1 ELSE 0 END)')} AS response_length_clip_ratio FROM (SELECT *, max(resp_len) OVER () AS m FROM @rollouts)")
def _(t: Tables):
    r = t.view("rollouts")
    limit = r.agg(F.max("resp_len").alias("m")).scalar()
    return _round_all(J.length_metrics(r.withColumn("limit", limit), "resp_len", F.col("limit"), "response_length"))


@query("j18_extra_reward_statistics", " UNION ALL ".join(f"SELECT '{k}' AS key, {r6(f'avg({k})')} AS mean, {r6(f'max({k})')} AS max, {r6(f'min({k})')} AS min, {r6(f'var_pop({k})')} AS var FROM @rollouts" for k in ("soft", "tax", "score")))
def _(t: Tables):
    return _round_all(J.extra_statistics(t.view("rollouts"), ["soft", "tax", "score"]))


SECTION = "CASE event_type WHEN 'click' THEN 'gen' WHEN 'view' THEN 'ref' WHEN 'purchase' THEN 'adv' WHEN 'error' THEN 'update_actor' ELSE 'reward' END"


@query("j19_timing_metrics", f"""SELECT section, {r6('s')} AS timing_s, {r6('CASE section WHEN ' + "'gen'" + ' THEN s * 1000 / r WHEN ' + "'reward'" + ' THEN NULL ELSE s * 1000 / (p + r) END')} AS timing_per_token_ms FROM (
SELECT {SECTION} AS section, sum(value) AS s FROM events GROUP BY 1), (SELECT sum(prompt_len) AS p, sum(resp_len) AS r FROM @rollouts)""")
def _(t: Tables):
    timings = t.table("events").groupBy(F.expr(SECTION).alias("section")).agg(F.sum("value").alias("seconds"))
    return _round_all(J.timing_metrics(timings, t.view("rollouts")))


@query("j20_throughput", f"SELECT step, CAST(sum(prompt_len + resp_len) AS BIGINT) AS total_num_tokens, {r6('sum(tax)')} AS time_per_step, {r6('sum(prompt_len + resp_len) / (sum(tax) * 8)')} AS throughput FROM @rollouts GROUP BY 1")
def _(t: Tables):
    steps = t.view("rollouts").select("step", (F.col("prompt_len") + F.col("resp_len")).alias("tokens"), F.col("tax").alias("seconds"))
    return _round_all(J.throughput(steps, 8))


@query("j21_reduce_metrics", f"SELECT event_type AS metric, {r6('avg(value)')} AS value FROM events GROUP BY 1 UNION ALL SELECT DISTINCT concat('no_', event_type), 0e0 FROM events")
def _(t: Tables):
    e = t.table("events").select(F.col("event_type").alias("metric"), "value")
    names = e.select("metric").union(e.select(F.concat(F.lit("no_"), "metric")))
    return _round_all(J.reduce_metrics(e, names))


DENSE = dict(hidden_size=3584, vocab_size=152064, num_hidden_layers=28, num_key_value_heads=4, num_attention_heads=28, intermediate_size=18944)
_DENSE_N = (3584 * 18944 * 3 + 3584 * (3584 + 512 + 512 + 3584)) * 28 + 152064 * 3584 * 2


@query("j22_dense_flops", f"SELECT step, {r6(f'(6 * {_DENSE_N}e0 * sum(n) + 12e0 * 128 * 28 * 28 * sum(n * n)) / 2.5 / 1e12')} AS tflops FROM (SELECT step, CAST(resp_len + prompt_len AS DOUBLE) AS n FROM @rollouts) GROUP BY 1")
def _(t: Tables):
    r = t.view("rollouts").withColumn("len", F.col("resp_len") + F.col("prompt_len"))
    return _round_all(J.dense_flops(r, "len", DENSE, 2.5, by=["step"]))


EXPERT = dict(hidden_size=7168, vocab_size=129280, moe_intermediate_size=2048, num_hidden_layers=61, first_k_dense_replace=3, num_attention_heads=128, n_routed_experts=256, num_experts_per_tok=8, n_shared_experts=1, qk_nope_head_dim=128, qk_rope_head_dim=64, v_head_dim=128, q_lora_rank=1536, kv_lora_rank=512, intermediate_size=18432)
_ATT = 7168 * 1536 + 128 * 192 * 1536 + 7168 * (512 + 64) + 128 * (192 - 64 + 128) * 512 + 128 * 128 * 7168
_EXP_N = (7168 * 256 + 7168 * 2048 * 9 * 3 + _ATT) * 58 + (7168 * 18432 * 3 + _ATT) * 3 + 129280 * 7168 * 2


@query("j23_expert_flops", f"SELECT step, {r6(f'(6 * {_EXP_N}e0 * sum(n) + 12e0 * 61 * 192 * 128 * sum(n * n)) / 2.5 / 1e12')} AS tflops FROM (SELECT step, CAST(resp_len + prompt_len AS DOUBLE) AS n FROM @rollouts) GROUP BY 1")
def _(t: Tables):
    r = t.view("rollouts").withColumn("len", F.col("resp_len") + F.col("prompt_len"))
    return _round_all(J.expert_flops(r, "len", EXPERT, 2.5, by=["step"]))
