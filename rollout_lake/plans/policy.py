"""Queries over importance ratios, mismatch metrics and policy objectives."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..operators import mismatch as H
from ..operators import objective as O
from ..operators.tokens import explode_tokens
from .registry import Tables, query, r6

STREAMS = ["e", "old_lp", "rollout_lp", "new_lp", "ref_lp", "mask", "loss_mask", "turn_end"]
SCALARS = ("seq_id", "uid", "adv", "void_ok", "score")
UPPER, LOWER, VETO = 1.12, 0.9, 0.74


def _tokens(t: Tables, streams=STREAMS, cluster: bool = True):
    return explode_tokens(t.sequences(), streams, keep=SCALARS, cluster="seq_id" if cluster else None)


def log_w_sql(num: str, den: str, mask: str, level: str, geometric: bool, floor: bool = False, src: str = "@tok") -> str:
    """The log ratio at a level, written with SQL windows."""
    def mean(total, count):
        return f"({total}) / (greatest({count}, 1))" if floor else f"({total}) / ({count} + 1e-8)"

    if level == "token":
        return f"SELECT *, {num} - {den} AS log_w FROM {src}"
    if level == "sequence":
        total, count = f"sum(({num} - {den}) * {mask}) OVER s", f"sum({mask}) OVER s"
        value = mean(total, count) if geometric else total
        return f"SELECT *, {value} AS log_w FROM {src} WINDOW s AS (PARTITION BY seq_id)"
    run = f"""SELECT *, sum(({num} - {den}) * {mask}) OVER c AS cs, sum({mask}) OVER c AS cc,
coalesce(min(CASE WHEN turn_end = 1 THEN pos END) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), width - 1) AS endp
FROM {src} WINDOW c AS (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING)"""
    if level == "cum-token":
        value = mean("cs", "cc") if geometric else "cs"
        return f"SELECT *, CASE WHEN {mask} > 0 THEN {value} ELSE 0 END AS log_w FROM ({run})"
    value = mean("z.cs", "z.cc") if geometric else "z.cs"
    return f"WITH run AS ({run}) SELECT a.*, {value} AS log_w FROM run a JOIN run z ON a.seq_id = z.seq_id AND a.endp = z.pos"


def weights_sql(level: str, geometric: bool, mode: str, veto: float | None = VETO, mask: str = "loss_mask") -> str:
    raw = "exp(greatest(least(log_w, 20), -20))"
    if level == "cum-token" and not geometric:
        raw = f"CASE WHEN {mask} > 0 THEN {raw} ELSE 0 END"
    bad = f"CASE WHEN old_lp - rollout_lp < ln({veto}) AND {mask} > 0 THEN 1 ELSE 0 END" if veto else "0"
    shaped = f"least(raw_w, {UPPER})" if mode == "truncate" else "raw_w * in_band"
    return f"""SELECT *, {shaped} * (1 - vetoed) * {mask} AS weight FROM (
SELECT *, max(catastrophic) OVER (PARTITION BY seq_id) AS vetoed, CASE WHEN raw_w BETWEEN {LOWER} AND {UPPER} THEN 1 ELSE 0 END AS in_band FROM (
SELECT *, {raw} AS raw_w, {bad} AS catastrophic FROM ({log_w_sql('old_lp', 'rollout_lp', mask, level, geometric)})))"""


def _pair(num: str, den: str, mask: str, level: str = "token") -> list[str]:
    """The streams that a ratio at a level reads."""
    return [num, den, mask, *(["turn_end"] if level == "cum-turn" else [])]


def _weights(t: Tables, level: str, geometric: bool, mode: str, veto: float | None = VETO, mask: str = "loss_mask", more=()):
    """Weights from the streams they need; without veto a token's weight needs no other token."""
    streams = list(dict.fromkeys([*_pair("old_lp", "rollout_lp", mask, level), *more]))
    if level in ("token", "sequence"):
        tokens = _folded(t, "old_lp", "rollout_lp", mask, streams, geometric, veto=veto)
    else:
        tokens = _tokens(t, streams)
    return H.rollout_weights(tokens, "old_lp", "rollout_lp", mask, level, mode, UPPER, LOWER, veto, geometric, "turn_end")


def _folded(t: Tables, num: str, den: str, mask: str, streams: list[str], geometric: bool, floor: bool = False, veto: float | None = None):
    """Tokens with what their sequence's arrays say as a whole, so that no window has to."""
    rows = H.fold_sequences(t.sequences(), num, den, mask, geometric, floor, veto)
    return explode_tokens(rows, streams, keep=(*SCALARS, *H.FOLDED))


def _register_level(name: str, level: str, geometric: bool):
    sql = f"SELECT seq_id, pos, {r6('exp(greatest(least(log_w, 20), -20))')} AS ratio FROM ({log_w_sql('old_lp', 'rollout_lp', 'loss_mask', level, geometric)}) WHERE loss_mask > 0"

    @query(name, sql)
    def _(t: Tables):
        streams = _pair("old_lp", "rollout_lp", "loss_mask", level)
        tokens = _folded(t, "old_lp", "rollout_lp", "loss_mask", streams, geometric) if level == "sequence" else _tokens(t, streams, level != "token")
        rated = H.log_ratio_at(tokens, "old_lp", "rollout_lp", "loss_mask", level, geometric, "turn_end")
        return rated.where("loss_mask > 0").select("seq_id", "pos", F.round(H.safe_exp(F.col("log_w")), 6).alias("ratio"))


_register_level("h01_token_ratio", "token", False)
_register_level("h02_cum_token_ratio", "cum-token", False)
_register_level("h02_cum_token_ratio_geometric", "cum-token", True)
_register_level("h03_cum_turn_ratio", "cum-turn", False)
_register_level("h03_cum_turn_ratio_geometric", "cum-turn", True)
_register_level("h04_sequence_ratio", "sequence", False)
_register_level("h04_sequence_ratio_geometric", "sequence", True)


@query("h05_veto", f"SELECT seq_id, any_value(vetoed)::INTEGER AS vetoed, sum(catastrophic)::BIGINT AS catastrophic FROM ({weights_sql('token', False, 'truncate')}) GROUP BY 1")
def _(t: Tables):
    w = _weights(t, "token", False, "truncate")
    return w.groupBy("seq_id").agg(F.max("vetoed").alias("vetoed"), F.sum("catastrophic").cast("bigint").alias("catastrophic"))


def _register_weight(name: str, level: str, geometric: bool, mode: str):
    @query(name, f"SELECT seq_id, pos, {r6('weight')} AS weight FROM ({weights_sql(level, geometric, mode)})")
    def _(t: Tables):
        return _weights(t, level, geometric, mode).select("seq_id", "pos", F.round("weight", 6).alias("weight"))


_register_weight("h06_truncated_weights", "token", False, "truncate")
_register_weight("h06_masked_weights", "cum-token", True, "mask")
_register_weight("h06_masked_weights_per_turn", "cum-turn", True, "mask")


def _fractions_sql(level: str, geometric: bool, cols: str) -> str:
    clipped = "max(1 - in_band)" if level == "sequence" else "CASE WHEN sum((1 - in_band) * loss_mask) > 0 THEN 1 ELSE 0 END"
    return f"""SELECT {cols} FROM (SELECT seq_id, sum(loss_mask) AS n, sum((1 - in_band) * loss_mask) AS outside, {clipped} AS clipped,
max(CASE WHEN void_ok = 0 THEN 1 ELSE 0 END) AS void FROM ({weights_sql(level, geometric, 'mask')}) GROUP BY 1)"""


@query("h07_masked_fractions", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{lv}' AS level, * FROM ({_fractions_sql(lv, g, r6('sum(outside) / (sum(n) + 1e-8)') + ' AS masked_fraction, ' + r6('avg(clipped)') + ' AS seq_masked_fraction')})"
    for lv, g in (("token", False), ("sequence", False))) + ")")
def _(t: Tables):
    parts = [
        H.masked_fractions(_weights(t, lv, g, "mask"), "loss_mask", lv).select(
            F.lit(lv).alias("level"), F.round("masked_fraction", 6).alias("masked_fraction"),
            F.round("seq_masked_fraction", 6).alias("seq_masked_fraction"))
        for lv, g in (("token", False), ("sequence", False))
    ]
    return parts[0].unionByName(parts[1])


@query("h08_void_turn_shares", _fractions_sql("sequence", False, ", ".join([
    r6("coalesce(sum(void * clipped) / nullif(sum(clipped), 0), 0)") + " AS void_turn_in_masked_ratio",
    r6("coalesce(sum(void * clipped) / nullif(sum(void), 0), 0)") + " AS masked_in_void_turn_ratio"])))
def _(t: Tables):
    out = H.masked_fractions(_weights(t, "sequence", False, "mask"), "loss_mask", "sequence", "void_ok")
    return out.select(F.round("void_turn_in_masked_ratio", 6).alias("void_turn_in_masked_ratio"),
                      F.round("masked_in_void_turn_ratio", 6).alias("masked_in_void_turn_ratio"))


STAT_COLS = ["veto_fraction", "catastrophic_token_fraction", "mean", "max", "min", "ratio_fraction_high", "ratio_fraction_low", "std", "eff_sample_size"]
SEQ_COLS = ["seq_mean", "seq_std", "seq_max", "seq_min", "seq_max_deviation", "seq_fraction_high", "seq_fraction_low"]


def _stats_sql(level: str, geometric: bool, raw_mean: bool = False) -> str:
    tokens = weights_sql(level, geometric, "mask")
    per_seq = level == "sequence"
    center = "(sum(sw) / (sum(n) + 1e-8))" if raw_mean else "(sum(sc) / (sum(n) + 1e-8))"
    if per_seq and not geometric:
        high, low = f"avg(CASE WHEN lw > ln({UPPER}) THEN 1 ELSE 0 END)", f"avg(CASE WHEN lw < ln({LOWER}) THEN 1 ELSE 0 END)"
    elif per_seq:
        high, low = (f"sum(CASE WHEN lw > ln({UPPER}) THEN n ELSE 0 END) / (sum(n) + 1e-8)", f"sum(CASE WHEN lw < ln({LOWER}) THEN n ELSE 0 END) / (sum(n) + 1e-8)")
    else:
        high, low = "sum(hi) / (sum(n) + 1e-8)", "sum(lo) / (sum(n) + 1e-8)"
    top, bottom = ("exp(least(max(lw), 20))", "exp(min(lw))") if per_seq else ("max(wmax)", "min(wmin)")
    square = "(sum(sc2) / (sum(n) + 1e-8))"
    exprs = {
        "veto_fraction": "avg(vetoed)", "catastrophic_token_fraction": "sum(bad) / (sum(n) + 1e-8)",
        "mean": "sum(sw) / (sum(n) + 1e-8)", "max": top, "min": bottom, "ratio_fraction_high": high, "ratio_fraction_low": low,
        "std": f"sqrt(greatest({square} - {center} * {center}, 0))",
        "eff_sample_size": f"1 / ({square} / (({center} + 1e-8) * ({center} + 1e-8)))",
        "seq_mean": "avg(sw / (n + 1e-8))", "seq_std": "stddev_samp(sw / (n + 1e-8))", "seq_max": "max(sw / (n + 1e-8))",
        "seq_min": "min(sw / (n + 1e-8))", "seq_max_deviation": "max(abs(sw / (n + 1e-8) - 1))",
        "seq_fraction_high": f"avg(CASE WHEN sw / (n + 1e-8) > {UPPER} THEN 1 ELSE 0 END)",
        "seq_fraction_low": f"avg(CASE WHEN sw / (n + 1e-8) < {LOWER} THEN 1 ELSE 0 END)",
    }
    table = f"""SELECT seq_id, sum(loss_mask) AS n, sum(raw_w * loss_mask) AS sw, sum(cw * loss_mask) AS sc, sum(cw * cw * loss_mask) AS sc2,
sum(catastrophic) AS bad, max(vetoed) AS vetoed, sum(CASE WHEN raw_w > {UPPER} THEN loss_mask ELSE 0 END) AS hi,
sum(CASE WHEN raw_w < {LOWER} THEN loss_mask ELSE 0 END) AS lo, max(CASE WHEN loss_mask > 0 THEN raw_w END) AS wmax,
min(CASE WHEN loss_mask > 0 THEN raw_w END) AS wmin, max(log_w) AS lw
FROM (SELECT *, greatest(least(raw_w, {UPPER}), {LOWER}) AS cw FROM ({tokens})) GROUP BY 1"""
    return f"FROM ({table})", exprs


def _register_stats(name: str, level: str, geometric: bool, cols: list[str], raw_mean: bool = False):
    src, exprs = _stats_sql(level, geometric, raw_mean)

    @query(name, "SELECT " + ", ".join(f"{r6(exprs[c])} AS {c}" for c in cols) + " " + src)
    def _(t: Tables):
        stats = H.weight_statistics(
            _weights(t, level, geometric, "mask"), "loss_mask", level, UPPER, LOWER, geometric, damp_by_raw_mean=raw_mean
        )
        return stats.select(*[F.round(c, 6).alias(c) for c in cols])


_register_stats("h09_weight_statistics_token", "token", False, STAT_COLS)
_register_stats("h09_weight_statistics_token_raw_mean", "token", False, STAT_COLS, True)
_register_stats("h09_weight_statistics_sequence", "sequence", False, STAT_COLS)
_register_stats("h09_weight_statistics_geometric", "sequence", True, STAT_COLS)
_register_stats("h09_weight_statistics_cum_turn", "cum-turn", True, STAT_COLS)
_register_stats("h10_sequence_weight_statistics", "token", False, SEQ_COLS)


@query("h11_weight_percentiles", "SELECT " + ", ".join(f"{r6(f'quantile_cont(raw_w, {p})')} AS p{int(p * 100)}" for p in H.WEIGHT_PERCENTILES)
       + f" FROM ({weights_sql('cum-token', True, 'mask')}) WHERE loss_mask > 0")
def _(t: Tables):
    q = H.weight_percentiles(_weights(t, "cum-token", True, "mask"), "loss_mask")
    return q.select(*[F.round(c, 6).alias(c) for c in q.columns])


@query("h11_weight_percentiles_approximate", "SELECT " + ", ".join(f"true AS p{int(p * 100)}" for p in H.WEIGHT_PERCENTILES))
def _(t: Tables):
    """Whether each percentile of the sketch has a rank within the error it promises."""
    weights = _weights(t, "cum-token", True, "mask").where("loss_mask > 0").select("raw_w")
    sketch = H.weight_percentiles(_weights(t, "cum-token", True, "mask"), "loss_mask", approximate=True).first()
    ranks = weights.agg(F.count(F.lit(1)).alias("n"), *[
        F.struct(F.count_if(F.col("raw_w") < v).alias("below"), F.count_if(F.col("raw_w") <= v).alias("upto")).alias(name)
        for name, v in sketch.asDict().items()])
    slack = F.col("n") / H.SKETCH_ACCURACY + 1
    return ranks.select(*[
        ((F.col(f"p{int(p * 100)}.below") <= p * F.col("n") + slack) & (F.col(f"p{int(p * 100)}.upto") >= p * F.col("n") - slack)).alias(f"p{int(p * 100)}")
        for p in H.WEIGHT_PERCENTILES])


MISMATCH = ["training_ppl", "training_log_ppl", "kl", "k3_kl", "rollout_ppl", "rollout_log_ppl", "log_ppl_diff", "log_ppl_abs_diff", "log_ppl_diff_max", "log_ppl_diff_min", "ppl_ratio"]
_PPL_SQL = """SELECT seq_id, score, sum(loss_mask) AS n, sum(old_lp * loss_mask) / (sum(loss_mask) + 1e-8) AS mo,
sum(rollout_lp * loss_mask) / (sum(loss_mask) + 1e-8) AS mr, sum((rollout_lp - old_lp) * loss_mask) AS kl,
sum((exp(old_lp - rollout_lp) - (old_lp - rollout_lp) - 1) * loss_mask) AS k3 FROM @tok GROUP BY 1, 2"""
_MISMATCH_EXPR = {
    "training_ppl": "avg(exp(-mo))", "training_log_ppl": "avg(-mo)", "kl": "sum(kl) / (sum(n) + 1e-8)", "k3_kl": "sum(k3) / (sum(n) + 1e-8)",
    "rollout_ppl": "avg(exp(-mr))", "rollout_log_ppl": "avg(-mr)", "log_ppl_diff": "avg(mr - mo)", "log_ppl_abs_diff": "avg(abs(mr - mo))",
    "log_ppl_diff_max": "max(mr - mo)", "log_ppl_diff_min": "min(mr - mo)", "ppl_ratio": "avg(exp(mr - mo))",
}
_MISMATCH_SELECT = "count(*) AS sequences, " + ", ".join(f"{r6(_MISMATCH_EXPR[c], 8)} AS {c}" for c in MISMATCH)


def _perplexity(t: Tables):
    return H.sequence_perplexity(_tokens(t, ["old_lp", "rollout_lp", "loss_mask"], cluster=False), "old_lp", "rollout_lp", "loss_mask", keep=["score"])


def _rounded(df, cols, digits=8):
    return df.select(*[c for c in df.columns if c not in cols], *[F.round(c, digits).alias(c) for c in cols])


@query("h12_mismatch_metrics", f"SELECT {_MISMATCH_SELECT} FROM ({_PPL_SQL})")
def _(t: Tables):
    return _rounded(H.mismatch_metrics(_perplexity(t)), MISMATCH)


@query("h13_mismatch_by_reward_sign", f"""SELECT 'all' AS subset, {_MISMATCH_SELECT} FROM ({_PPL_SQL}) UNION ALL
SELECT CASE WHEN score > 0 THEN 'positive' ELSE 'negative' END, {_MISMATCH_SELECT} FROM ({_PPL_SQL}) GROUP BY 1""")
def _(t: Tables):
    return _rounded(H.mismatch_by_sign(_perplexity(t), "score"), MISMATCH)


@query("h13_mismatch_sign_differences", f"""SELECT {r6("avg(CASE WHEN score > 0 THEN exp(-mo) END) - avg(CASE WHEN score <= 0 THEN exp(-mo) END)", 8)} AS ppl_diff_pos_neg,
{r6("sum(CASE WHEN score > 0 THEN kl END) / (sum(CASE WHEN score > 0 THEN n END) + 1e-8) - sum(CASE WHEN score <= 0 THEN kl END) / (sum(CASE WHEN score <= 0 THEN n END) + 1e-8)", 8)} AS kl_diff_pos_neg FROM ({_PPL_SQL})""")
def _(t: Tables):
    return _rounded(H.sign_differences(H.mismatch_by_sign(_perplexity(t), "score")), ["ppl_diff_pos_neg", "kl_diff_pos_neg"])


@query("h14_probability_gap", f"""SELECT {r6('max(exp(rollout_lp) - exp(old_lp))')} AS probs_diff_max, {r6('avg(exp(rollout_lp) - exp(old_lp))')} AS probs_diff_mean,
{r6('stddev_samp(exp(rollout_lp) - exp(old_lp))')} AS probs_diff_std, {r6('max(exp(old_lp - rollout_lp))')} AS is_ratio_token_wise_max,
{r6('avg(exp(old_lp - rollout_lp))')} AS is_ratio_token_wise_mean FROM @tok WHERE mask > 0""")
def _(t: Tables):
    g = H.probability_gap(_tokens(t, ["old_lp", "rollout_lp", "mask"], cluster=False), "old_lp", "rollout_lp", "mask")
    return _rounded(g, g.columns, 6)


RATIO_COLS = ["mean", "std", "var", "min", "max", *O.QUANTILE_NAMES, "pg_clip_lower_frac", "pg_clip_upper_frac", "pg_clip_frac"]


def _ratio_stats_sql(src: str, under: str, over: str, mask: str) -> str:
    q = ", ".join(f"{r6(f'quantile_cont(r, {p})')} AS {n}" for p, n in zip(O.RATIO_QUANTILES, O.QUANTILE_NAMES))
    return f"""SELECT {r6('avg(r)')} AS mean, {r6('stddev_samp(r)')} AS std, {r6('var_samp(r)')} AS var, {r6('min(r)')} AS min, {r6('max(r)')} AS max, {q},
{r6('avg(u)')} AS pg_clip_lower_frac, {r6('avg(o)')} AS pg_clip_upper_frac, {r6('avg(greatest(u, o))')} AS pg_clip_frac FROM (
SELECT exp(log_w) AS r, CASE WHEN adv < 0 AND {under} THEN 1 ELSE 0 END AS u, CASE WHEN adv > 0 AND {over} THEN 1 ELSE 0 END AS o FROM ({src}) WHERE {mask} > 0)"""


CLIP_LOW, CLIP_HIGH = 0.12, 0.14


@query("h15_ratio_statistics", _ratio_stats_sql(log_w_sql("new_lp", "old_lp", "loss_mask", "token", False),
       f"exp(log_w) < 1 - {CLIP_LOW}", f"exp(log_w) > 1 + {CLIP_HIGH}", "loss_mask"))
def _(t: Tables):
    rated = H.log_ratio_at(_tokens(t, _pair("new_lp", "old_lp", "loss_mask"), cluster=False), "new_lp", "old_lp", "loss_mask", "token")
    return _rounded(O.ratio_statistics(rated, "log_w", "loss_mask", "adv", CLIP_LOW, CLIP_HIGH), RATIO_COLS, 6)


_SCALED_SEQ_SQL = f"SELECT *, sqrt(greatest(sum(loss_mask) OVER (PARTITION BY seq_id), 1)) AS scale FROM ({log_w_sql('new_lp', 'old_lp', 'loss_mask', 'sequence', False)})"
_SCALED_CUM_SQL = f"SELECT *, sqrt(sum(loss_mask) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS scale FROM ({log_w_sql('new_lp', 'old_lp', 'loss_mask', 'cum-token', False)})"


@query("h16_ratio_statistics_length_scaled", _ratio_stats_sql(_SCALED_CUM_SQL, "log_w < -0.05 * scale", "log_w > 0.05 * scale", "loss_mask"))
def _(t: Tables):
    rated = O.with_length_scale(_tokens(t, _pair("new_lp", "old_lp", "loss_mask")), "new_lp", "old_lp", "loss_mask", "cum-token")
    bound = F.col("scale") * 0.05
    return _rounded(O.ratio_statistics(rated, "log_r", "loss_mask", "adv", bound, bound, log_bounds=True), RATIO_COLS, 6)


@query("h17_ratio_statistics_before_void_masking", _ratio_stats_sql(
    f"SELECT * REPLACE (least(log_w, 10) AS log_w) FROM ({log_w_sql('new_lp', 'old_lp', 'mask', 'cum-turn', True)})",
    f"exp(log_w) < 1 - {CLIP_LOW}", f"exp(log_w) > 1 + {CLIP_HIGH}", "mask"))
def _(t: Tables):
    rated = H.log_ratio_at(_tokens(t, _pair("new_lp", "old_lp", "mask", "cum-turn")), "new_lp", "old_lp", "mask", "cum-turn", True, "turn_end")
    held = rated.withColumn("log_w", F.least("log_w", F.lit(10.0)))
    return _rounded(O.ratio_statistics(held, "log_w", "mask", "adv", CLIP_LOW, CLIP_HIGH), RATIO_COLS, 6)


def _loss_mode_sql(mode: str, width: int = 64) -> str:
    return {
        "token-mean": "sum(ls) / (sum(n) + 1e-8)", "seq-mean-token-sum": "avg(ls)",
        "seq-mean-token-mean": "avg(ls / greatest(n, 1))", "seq-mean-token-sum-norm": f"sum(ls) / {width}",
    }[mode]


def objective_sql(src: str, mask: str, mode: str, kl: str, low: float, high: float, cap: str | None = "3.0", lmin: str | None = None,
                  lmax: str | None = "10", masked: bool = True, scaled: bool = False, weight: str = "1", extra: str = "") -> str:
    """The clipped objective over a select that offers log_w."""
    lr = f"least(log_w, {lmax})" if lmax else "log_w"
    lr = f"greatest({lr}, {lmin})" if lmin else lr

    def m(x):
        return f"CASE WHEN {mask} > 0 THEN {x} ELSE 0 END" if masked else x

    bounded = m(f"exp(greatest(least(lr, {high} * scale), -{low} * scale))") if scaled else f"greatest(least(r, {1 + high}), {1 - low})"
    worst = "greatest(-adv * r, -adv * b)"
    loss = f"CASE WHEN adv < 0 THEN least(-adv * {cap}, {worst}) ELSE {worst} END" if cap else worst
    dual = f"CASE WHEN adv < 0 AND {worst} > -adv * {cap} THEN 1 ELSE 0 END" if cap else "0"
    return f"""SELECT {r6(_loss_mode_sql(mode))} AS pg_loss, {r6('sum(c) / (sum(n) + 1e-8)')} AS pg_clipfrac, {r6('sum(kl) / (sum(n) + 1e-8)')} AS ppo_kl,
{r6('sum(d) / (sum(n) + 1e-8)')} AS pg_clipfrac_lower{extra} FROM (
SELECT seq_id, sum(loss * {weight} * {mask}) AS ls, sum({mask}) AS n, sum(c * {mask}) AS c, sum(d * {mask}) AS d, sum(({kl}) * {mask}) AS kl,
sum(CASE WHEN {mask} > 0 THEN d END) AS dv, count(CASE WHEN {mask} > 0 THEN 1 END) AS nv FROM (
SELECT *, {loss} AS loss, {dual} AS d, CASE WHEN -adv * b > -adv * r THEN 1 ELSE 0 END AS c FROM (
SELECT *, {bounded} AS b FROM (SELECT *, {m('exp(lr)')} AS r FROM (SELECT *, {lr} AS lr FROM ({src}))))) GROUP BY 1)"""


DUAL = f", {r6('sum(dv) / sum(nv)')} AS pg_dual_clip_frac"
BASE_COLS = ["pg_loss", "pg_clipfrac", "ppo_kl", "pg_clipfrac_lower"]


@query("h18_clipped_objective", f"SELECT pg_loss, pg_clipfrac, ppo_kl, 0e0 AS pg_clipfrac_lower FROM ({objective_sql(log_w_sql('new_lp', 'old_lp', 'loss_mask', 'token', False), 'loss_mask', 'token-mean', '-lr', CLIP_LOW, CLIP_HIGH, '1.1', '-20', '20', masked=False)})")
def _(t: Tables):
    rep = O.clipped_objective(_tokens(t, _pair("new_lp", "old_lp", "loss_mask")), "new_lp", "old_lp", "loss_mask", "adv", CLIP_LOW, CLIP_HIGH, 1.1)
    return _rounded(rep, BASE_COLS, 6)


@query("h18_clipped_objective_weighted", f"SELECT pg_loss, pg_clipfrac, ppo_kl, 0e0 AS pg_clipfrac_lower FROM ({objective_sql('SELECT * REPLACE (new_lp - old_lp AS log_w) FROM (' + weights_sql('token', False, 'mask') + ')', 'loss_mask', 'token-mean', '-lr', CLIP_LOW, CLIP_HIGH, '1.1', '-20', '20', masked=False, weight='weight')})")
def _(t: Tables):
    rep = O.clipped_objective(_weights(t, "token", False, "mask", more=["new_lp"]), "new_lp", "old_lp", "loss_mask", "adv", CLIP_LOW, CLIP_HIGH, 1.1, weight="weight")
    return _rounded(rep, BASE_COLS, 6)


@query("h19_loss_aggregation", " UNION ALL ".join(
    f"SELECT '{m}' AS mode, {r6(_loss_mode_sql(m))} AS loss FROM (SELECT seq_id, sum(e * loss_mask) AS ls, sum(loss_mask) AS n FROM @tok GROUP BY 1)" for m in O.LOSS_MODES))
def _(t: Tables):
    tok = _tokens(t, ["e", "loss_mask"], cluster=False)
    table = tok.groupBy("seq_id").agg(F.sum(F.col("e") * F.col("loss_mask")).alias("ls"), F.sum("loss_mask").alias("n"))
    wide = table.agg(*[O.loss_columns(m, 64).alias(m) for m in O.LOSS_MODES])
    return wide.unpivot([], list(O.LOSS_MODES), "mode", "loss").select("mode", F.round("loss", 6).alias("loss"))


@query("h19_aggregate_loss", " UNION ALL ".join(
    f"SELECT '{m}' AS mode, {r6(_loss_mode_sql(m))} AS loss FROM (SELECT seq_id, sum(e * loss_mask) AS ls, sum(loss_mask) AS n FROM @tok GROUP BY 1)" for m in O.LOSS_MODES))
def _(t: Tables):
    tok = _tokens(t, ["e", "loss_mask"], cluster=False)
    out = None
    for mode in O.LOSS_MODES:
        one = O.aggregate_loss(tok, "e", "loss_mask", mode, 64).select(F.lit(mode).alias("mode"), F.round("loss", 6).alias("loss"))
        out = one if out is None else out.unionByName(one)
    return out


TIGHT_LOW, TIGHT_HIGH = 0.008, 0.01


def _register_objective(name, level, geometric, mode):
    sql = objective_sql(log_w_sql("new_lp", "old_lp", "loss_mask", level, geometric, floor=level == "sequence"), "loss_mask", mode, "old_lp - new_lp", TIGHT_LOW, TIGHT_HIGH, "1.004", extra=DUAL)

    @query(name, sql)
    def _(t: Tables):
        rep = O.level_objective(_tokens(t, _pair("new_lp", "old_lp", "loss_mask", level)), "new_lp", "old_lp", "loss_mask", "adv", level, geometric, TIGHT_LOW, TIGHT_HIGH, 1.004, mode, 64, "turn_end")
        return _rounded(rep, rep.columns, 6)


_register_objective("h20_sequence_objective", "sequence", True, "seq-mean-token-mean")
_register_objective("h20_sequence_product_objective", "sequence", False, "seq-mean-token-sum-norm")
_register_objective("h20_cum_token_objective", "cum-token", True, "token-mean")
_register_objective("h20_cum_turn_objective", "cum-turn", True, "seq-mean-token-sum")


@query("h20_cum_turn_objective_weighted", objective_sql(
    f"SELECT a.*, w.weight FROM ({log_w_sql('new_lp', 'old_lp', 'loss_mask', 'cum-turn', True)}) a JOIN ({weights_sql('sequence', True, 'truncate')}) w ON a.seq_id = w.seq_id AND a.pos = w.pos",
    "loss_mask", "token-mean", "old_lp - new_lp", TIGHT_LOW, TIGHT_HIGH, "1.004", weight="weight", extra=DUAL))
def _(t: Tables):
    rep = O.level_objective(_weights(t, "sequence", True, "truncate", more=["new_lp", "turn_end"]), "new_lp", "old_lp", "loss_mask", "adv", "cum-turn", True, TIGHT_LOW, TIGHT_HIGH, 1.004, turn_end="turn_end", weight="weight")
    return _rounded(rep, rep.columns, 6)


@query("h21_objective_against_sampler", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{lv}' AS level, * FROM ({objective_sql(log_w_sql('new_lp', 'rollout_lp', 'loss_mask', lv, g, floor=lv == 'sequence'), 'loss_mask', 'token-mean', 'rollout_lp - new_lp', CLIP_LOW, CLIP_HIGH, '1.2', '-20', '20', extra=DUAL)})"
    for lv, g in (("token", False), ("cum-token", True), ("sequence", True))) + ")")
def _(t: Tables):
    out = None
    for lv, g in (("token", False), ("cum-token", True), ("sequence", True)):
        rep = O.rollout_objective(_tokens(t, _pair("new_lp", "rollout_lp", "loss_mask", lv)), "new_lp", "rollout_lp", "loss_mask", "adv", lv, g, CLIP_LOW, CLIP_HIGH, 1.2)
        rep = _rounded(rep, rep.columns, 6).withColumn("level", F.lit(lv))
        out = rep if out is None else out.unionByName(rep)
    return out


@query("h22_length_scaled_objective", "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{lv}' AS level, * FROM ({objective_sql(src, 'loss_mask', 'token-mean', 'old_lp - new_lp', 0.03, 0.04, 'exp(0.2 * scale)', scaled=True, extra=DUAL)})"
    for lv, src in (("sequence", _SCALED_SEQ_SQL), ("cum-token", _SCALED_CUM_SQL))) + ")")
def _(t: Tables):
    parts = []
    for lv in ("sequence", "cum-token"):
        rep = O.length_scaled_objective(_tokens(t, _pair("new_lp", "old_lp", "loss_mask")), "new_lp", "old_lp", "loss_mask", "adv", lv, 0.03, 0.04, 0.2)
        parts.append(_rounded(rep, rep.columns, 6).withColumn("level", F.lit(lv)))
    return parts[0].unionByName(parts[1])


@query("h23_sequence_mean_objective", objective_sql(log_w_sql("new_lp", "old_lp", "loss_mask", "sequence", True, floor=True), "loss_mask", "seq-mean-token-mean", "old_lp - new_lp", 0.01, 0.015, None, masked=False))
def _(t: Tables):
    tokens = _folded(t, "new_lp", "old_lp", "loss_mask", _pair("new_lp", "old_lp", "loss_mask"), True, True)
    rep = O.sequence_mean_objective(tokens, "new_lp", "old_lp", "loss_mask", "adv", 0.01, 0.015)
    return _rounded(rep, BASE_COLS, 6)


@query("h24_running_mean_objective", objective_sql(log_w_sql("new_lp", "old_lp", "loss_mask", "cum-token", True), "loss_mask", "seq-mean-token-mean", "old_lp - new_lp", 0.03, 0.04, "1.1"))
def _(t: Tables):
    rep = O.running_mean_objective(_tokens(t, _pair("new_lp", "old_lp", "loss_mask")), "new_lp", "old_lp", "loss_mask", "adv", 0.03, 0.04, 1.1)
    return _rounded(rep, BASE_COLS, 6)


@query("h25_value_loss", f"""SELECT {r6('0.5 * sum(greatest(a, b) * mask) / (sum(mask) + 1e-8)')} AS vf_loss, {r6('sum(CASE WHEN b > a THEN mask ELSE 0 END) / (sum(mask) + 1e-8)')} AS vf_clipfrac FROM (
SELECT mask, pow(new_lp - ref_lp, 2) AS a, pow(greatest(least(new_lp, old_lp + 0.1), old_lp - 0.1) - ref_lp, 2) AS b FROM @tok)""")
def _(t: Tables):
    v = O.value_loss(_tokens(t, ["new_lp", "ref_lp", "old_lp", "mask"], cluster=False), "new_lp", "ref_lp", "old_lp", "mask", 0.1)
    return _rounded(v, v.columns, 6)


_LSE_SQL = "SELECT seq_id, adv, label, mask0, mx + ln(sum(exp(8 * e - mx))) AS lse, sum(8 * e * exp(8 * e - mx)) / sum(exp(8 * e - mx)) AS mean_logit, max(CASE WHEN pos = seq_id % 64 THEN 8 * e END) AS picked FROM (SELECT *, max(8 * e) OVER (PARTITION BY seq_id) AS mx, uid AS label, CASE WHEN seq_id % 4 = 0 THEN 0 ELSE 1 END AS mask0 FROM @tok) GROUP BY seq_id, adv, label, mask0, mx"


def _logits(t: Tables):
    # every embedding row read as the logits of one token over a vocabulary of its size
    return t.sequences().select(
        "seq_id", F.transform("e", lambda x: x * 8).alias("logits"), (F.col("seq_id") % 64).alias("label"),
        F.when(F.col("seq_id") % 4 == 0, 0).otherwise(1).alias("mask0"),
    )


@query("h26_mean_entropy", f"SELECT {r6('sum((lse - mean_logit) * mask0) / (sum(mask0) + 1e-8)')} AS entropy FROM ({_LSE_SQL})")
def _(t: Tables):
    ent = _logits(t).withColumn("h", A.logit_entropy(F.col("logits")))
    n = F.sum("mask0") + F.lit(1e-8)
    return ent.agg(F.round(F.sum(F.col("h") * F.col("mask0")) / n, 6).alias("entropy"))


@query("h27_void_turn_masking", "SELECT seq_id, sum(loss_mask * void_ok)::BIGINT AS kept, sum(loss_mask)::BIGINT AS before FROM @tok GROUP BY 1")
def _(t: Tables):
    masked = t.sequences().withColumn("after", A.scale_mask(F.col("loss_mask"), F.col("void_ok")))
    return masked.select("seq_id", A.count_ones("after").alias("kept"), A.count_ones("loss_mask").alias("before"))


@query("h28_choose_old_log_probs", f"SELECT seq_id, pos, {r6('rollout_lp')} AS old_log_probs, {r6('old_lp')} AS actor_old_log_probs FROM @tok")
def _(t: Tables):
    s = t.sequences().withColumnsRenamed({"old_lp": "old_log_probs", "rollout_lp": "rollout_log_probs"})
    tok = explode_tokens(H.choose_old_log_probs(s, bypass=True), ["old_log_probs", "actor_old_log_probs"])
    return tok.select("seq_id", "pos", F.round("old_log_probs", 6).alias("old_log_probs"), F.round("actor_old_log_probs", 6).alias("actor_old_log_probs"))


@query("h29_combined_objective", f"""SELECT {r6('pg')} AS pg_loss, {r6('ent')} AS entropy_loss, {r6('kl')} AS kl_loss, {r6('pg - ent * 0.001 + kl * 0.02')} AS total_loss FROM (
SELECT (SELECT sum(lr * m) / (sum(m) + 1e-8) FROM (SELECT loss_mask AS m, CASE WHEN adv < 0 THEN least(-adv * 3.0, w) ELSE w END AS lr FROM (
SELECT loss_mask, adv, greatest(-adv * exp(new_lp - old_lp), -adv * greatest(least(exp(new_lp - old_lp), 1.14), 0.88)) AS w FROM @tok))) AS pg,
(SELECT sum((lse - mean_logit) * mask0) / (sum(mask0) + 1e-8) FROM ({_LSE_SQL})) AS ent,
(SELECT sum(greatest(least(exp(ref_lp - new_lp) - (ref_lp - new_lp) - 1, 10), -10) * loss_mask) / (sum(loss_mask) + 1e-8) FROM @tok) AS kl)""")
def _(t: Tables):
    from ..operators.advantage import kl_penalty

    policy = O.clipped_objective(_tokens(t, _pair("new_lp", "old_lp", "loss_mask")), "new_lp", "old_lp", "loss_mask", "adv", CLIP_LOW, CLIP_HIGH).select("pg_loss")
    n = F.sum("mask0") + F.lit(1e-8)
    entropy = _logits(t).withColumn("h", A.logit_entropy(F.col("logits"))).agg((F.sum(F.col("h") * F.col("mask0")) / n).alias("h"))
    tok = _tokens(t, ["new_lp", "ref_lp", "loss_mask"], cluster=False)
    kld = kl_penalty(F.col("new_lp"), F.col("ref_lp"), "low_var_kl") * F.col("loss_mask")
    kl = tok.agg((F.sum(kld) / (F.sum("loss_mask") + F.lit(1e-8))).alias("k"))
    out = O.combined_objective(policy, entropy, kl, 0.001, 0.02)
    return _rounded(out, out.columns, 6)


@query("h30_noise_statistics", f"SELECT {r6('avg(value)')} AS sigma_mean, {r6('stddev_samp(value)')} AS sigma_std, {r6('min(value)')} AS sigma_min, {r6('max(value)')} AS sigma_max FROM events")
def _(t: Tables):
    s = O.noise_statistics(t.table("events"), "value")
    return _rounded(s, s.columns, 6)
