"""Queries over array and token-layout functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.scalars import clip
from ..operators import intervals as I
from ..operators import tokens as T
from .registry import Tables, query, r6

# word lengths stand in for token ids; a whole document is one sequence
_DOC_SQL = "SELECT doc_id, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS BIGINT)) AS ids FROM documents"
_CONV_SQL = "SELECT conv_id, turn, text, list_transform(string_split(text, ' '), lambda w: CAST(length(w) AS BIGINT)) AS ids FROM conversations"


def _ids(df, *keep):
    words = F.split("text", " ")
    return df.select(*keep, F.transform(words, lambda w: F.length(w).cast("bigint")).alias("ids"))


def _docs(t: Tables):
    return _ids(t.spread(t.table("documents").select("doc_id", "text")), "doc_id")


def _conv(t: Tables):
    return _ids(t.table("conversations"), "conv_id", "turn", "text")


def _digest(arr):
    """A whole array as one digest, so that results stay small and every element counts."""
    return F.md5(F.array_join(F.transform(arr, lambda x: x.cast("string")), ","))


def _md5(arr: str) -> str:
    return f"md5(array_to_string({arr}, ','))"


@query("d01_masked_sum_and_mean", f"SELECT seq_id, {r6('sum(e * loss_mask)')} AS masked_sum, {r6('sum(e * loss_mask) / (sum(loss_mask) + 1e-8)')} AS masked_mean FROM @tok GROUP BY 1")
def _(t: Tables):
    s = t.sequences()
    return s.select("seq_id", F.round(A.masked_sum("e", "loss_mask"), 6).alias("masked_sum"), F.round(A.masked_mean("e", "loss_mask"), 6).alias("masked_mean"))


_STATS_SQL = """WITH s AS (SELECT sum(e * loss_mask) / (sum(loss_mask) + 1e-8) AS mean, sum(loss_mask) AS n FROM @tok),
v AS (SELECT any_value(s.mean) AS mean, any_value(s.n) AS n, sum(loss_mask * (e - s.mean) * (e - s.mean)) / (any_value(s.n) + 1e-8) * any_value(s.n) / (any_value(s.n) - 1) AS var FROM @tok t, s)"""


@query("d02_masked_variance", f"{_STATS_SQL} SELECT {r6('mean')} AS mean, {r6('var', 8)} AS var, CAST(n AS BIGINT) AS count FROM v")
def _(t: Tables):
    tok = T.explode_tokens(t.sequences(), ["e", "loss_mask"], keep=())
    s = T.masked_stats(tok, "e", "loss_mask")
    return s.select(F.round("mean", 6).alias("mean"), F.round("var", 8).alias("var"), "count")


@query("d03_masked_whitening", f"{_STATS_SQL} SELECT seq_id, pos, {r6('(e - mean) / sqrt(var + 1e-8)')} AS white, {r6('(e - mean) / sqrt(var + 1e-8) + mean')} AS white_kept_mean FROM @tok t, v")
def _(t: Tables):
    tok = T.explode_tokens(t.sequences(), ["e", "loss_mask"])
    stats = T.stats_scalar(T.masked_stats(tok, "e", "loss_mask"))
    out = tok.withColumn("st", stats)
    return out.select("seq_id", "pos", F.round(T.whitened(F.col("e"), F.col("st")), 6).alias("white"),
                      F.round(T.whitened(F.col("e"), F.col("st"), keep_mean=True), 6).alias("white_kept_mean"))


@query("d04_end_token_mask", f"""SELECT doc_id, {_md5("list_transform(ids, lambda x, i: CASE WHEN i <= k THEN 1 ELSE 0 END)")} AS digest, CAST(k AS BIGINT) AS kept FROM (
SELECT *, CASE WHEN f IS NULL THEN len(ids) ELSE f END AS k FROM (
SELECT *, least(nullif(list_position(ids, 9), 0), nullif(list_position(ids, 12), 0)) AS f FROM ({_DOC_SQL})))""")
def _(t: Tables):
    d = _docs(t).withColumn("m", A.eos_mask(F.col("ids"), [9, 12]))
    return d.select("doc_id", _digest("m").alias("digest"), A.count_ones("m").alias("kept"))


@query("d05_clip_by_value", "SELECT o_orderkey, greatest(least(o_totalprice, 200000e0), 1000e0) AS fixed, greatest(least(o_totalprice, o_custkey * 100e0), o_custkey * 10e0) AS by_column FROM orders")
def _(t: Tables):
    c = F.col("o_custkey")
    return t.table("orders").select("o_orderkey", clip(F.col("o_totalprice"), 1000, 200000).alias("fixed"), clip(F.col("o_totalprice"), c * 10.0, c * 100.0).alias("by_column"))


_LOGIT_SQL = """SELECT seq_id, mx + ln(sum(exp(8 * e - mx))) AS lse, sum(8 * e * exp(8 * e - mx)) / sum(exp(8 * e - mx)) AS mean_logit, max(CASE WHEN pos = seq_id % 64 THEN 8 * e END) AS picked
FROM (SELECT *, max(8 * e) OVER (PARTITION BY seq_id) AS mx FROM @tok) GROUP BY seq_id, mx"""


def _logits(t: Tables):
    return t.sequences().select("seq_id", F.transform("e", lambda x: x * 8).alias("logits"), (F.col("seq_id") % 64).alias("label"))


@query("d06_label_log_prob", f"SELECT seq_id, {r6('picked - lse')} AS log_prob FROM ({_LOGIT_SQL})")
def _(t: Tables):
    return _logits(t).select("seq_id", F.round(A.label_log_prob(F.col("logits"), F.col("label")), 6).alias("log_prob"))


@query("d07_logit_entropy", f"SELECT seq_id, {r6('lse - mean_logit')} AS entropy FROM ({_LOGIT_SQL})")
def _(t: Tables):
    return _logits(t).select("seq_id", F.round(A.logit_entropy(F.col("logits")), 6).alias("entropy"))


@query("d08_pad_to_longest", f"""SELECT conv_id, turn, CAST(len(p) AS BIGINT) AS n, {_md5('p')} AS digest FROM (
SELECT conv_id, turn, list_concat(ids, list_transform(range(0, w - len(ids)), lambda x: CAST(-1 AS BIGINT))) AS p FROM (SELECT *, max(len(ids)) OVER () AS w FROM ({_CONV_SQL})))""")
def _(t: Tables):
    c = _conv(t)
    padded = c.withColumn("w", T.longest(c, "ids")).withColumn("p", A.pad_right(F.col("ids"), F.lit(-1).cast("bigint"), F.col("w")))
    return padded.select("conv_id", "turn", F.size("p").cast("bigint").alias("n"), _digest("p").alias("digest"))


_PAD = "list_transform(range(0, greatest(200 - len(ids), 0)), lambda x: CAST(-1 AS BIGINT))"


@query("d09_pad_to_length", f"SELECT conv_id, turn, {_md5(f'list_concat({_PAD}, ids)')} AS left_padded, {_md5(f'list_concat(ids, {_PAD})')} AS right_padded FROM ({_CONV_SQL})")
def _(t: Tables):
    pad, n = F.lit(-1).cast("bigint"), F.lit(200)
    return _conv(t).select("conv_id", "turn", _digest(A.pad_left(F.col("ids"), pad, n)).alias("left_padded"), _digest(A.pad_right(F.col("ids"), pad, n)).alias("right_padded"))


@query("d10_truncate", f"SELECT doc_id, {_md5('ids[greatest(len(ids) - 99, 1):]')} AS kept_right_end, {_md5('ids[1:100]')} AS kept_left_end FROM ({_DOC_SQL})")
def _(t: Tables):
    return _docs(t).select("doc_id", _digest(A.truncate(F.col("ids"), 100, "left")).alias("kept_right_end"), _digest(A.truncate(F.col("ids"), 100, "right")).alias("kept_left_end"))


@query("d11_strip_left_padding", f"SELECT doc_id, {_md5('ids')} AS digest, CAST(len(ids) AS BIGINT) AS n FROM ({_DOC_SQL})")
def _(t: Tables):
    d = _docs(t).withColumn("padded", A.pad_left(F.col("ids"), F.lit(-1).cast("bigint"), F.size("ids") + F.lit(25)))
    d = d.withColumn("m", A.attention_mask(F.col("padded"), -1)).withColumn("out", A.strip_left_padding(F.col("padded"), F.col("m")))
    return d.select("doc_id", _digest("out").alias("digest"), F.size("out").cast("bigint").alias("n"))


@query("d12_attention_mask", f"SELECT doc_id, {_md5('list_transform(ids, lambda x: CASE WHEN x <> 2 THEN 1 ELSE 0 END)')} AS digest FROM ({_DOC_SQL})")
def _(t: Tables):
    return _docs(t).select("doc_id", _digest(A.attention_mask(F.col("ids"), 2)).alias("digest"))


@query("d13_position_ids", "SELECT seq_id, pos, CAST((sum(loss_mask) OVER (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1) * loss_mask AS BIGINT) AS position_id FROM @tok")
def _(t: Tables):
    tok = T.explode_tokens(t.sequences(), ["loss_mask"], cluster="seq_id")
    return T.position_ids(tok, "loss_mask").select("seq_id", "pos", F.col("position_id").cast("bigint").alias("position_id"))


@query("d14_cut_to_effective_length", f"""SELECT seq_id, CAST(count(CASE WHEN pos >= 64 - w THEN 1 END) AS BIGINT) AS n_left, {r6('sum(CASE WHEN pos >= 64 - w THEN e ELSE 0 END)')} AS sum_left, {r6('sum(CASE WHEN pos < w THEN e ELSE 0 END)')} AS sum_right
FROM @tok, (SELECT max(n) AS w FROM (SELECT sum(loss_mask) AS n FROM @tok GROUP BY seq_id)) GROUP BY seq_id""")
def _(t: Tables):
    s = t.sequences().select("seq_id", "loss_mask", F.col("e").alias("l"), F.col("e").alias("r"))
    left = T.cut_to_effective_length(s, "loss_mask", ["l"], cut_left=True)
    both = T.cut_to_effective_length(left, "loss_mask", ["r"], cut_left=False)
    return both.select("seq_id", F.size("l").cast("bigint").alias("n_left"), F.round(A.array_sum("l"), 6).alias("sum_left"), F.round(A.array_sum("r"), 6).alias("sum_right"))


_P, _R = "list_filter(ids, lambda x: x = 2)", "list_filter(ids, lambda x: x <> 2)"


@query("d15_move_padding", f"SELECT doc_id, {_md5(f'list_concat({_P}, {_R})')} AS to_left, {_md5(f'list_concat({_R}, {_P})')} AS to_right FROM ({_DOC_SQL})")
def _(t: Tables):
    return _docs(t).select("doc_id", _digest(A.move_padding(F.col("ids"), 2)).alias("to_left"), _digest(A.move_padding(F.col("ids"), 2, to_left=False)).alias("to_right"))


@query("d16_join_streams", f"""SELECT doc_id, {_md5('list_transform(ord, lambda i: resp[i])')} AS ids, {_md5('list_transform(ord, lambda i: msk[i])')} AS mask_ids, {r6('list_sum(list_transform(ord, lambda i, j: lp[i] * j))', 4)} AS weighted_logp FROM (
SELECT *, list_concat(list_filter(range(1, len(resp) + 1), lambda i: resp[i] <> 2), list_filter(range(1, len(resp) + 1), lambda i: resp[i] = 2)) AS ord FROM (
SELECT doc_id, list_concat(ids, cur, obs) AS resp, list_concat(ids, cur, list_transform(obs, lambda x: CAST(2 AS BIGINT))) AS msk,
list_concat(list_transform(ids, lambda x: -x / 10e0), list_transform(cur, lambda x: -x / 5e0), list_transform(obs, lambda x: -1e0)) AS lp FROM (
SELECT doc_id, ids, list_reverse(ids[1:20]) AS cur, ids[5:14] AS obs FROM ({_DOC_SQL}))))""")
def _(t: Tables):
    d = _docs(t).withColumns({"cur": F.reverse(F.slice("ids", 1, 20)), "obs": F.slice("ids", 5, 10)})
    prior = F.transform("ids", lambda x: F.struct(x.alias("id"), x.alias("mask_id"), (-x / 10.0).alias("logp")))
    d = d.withColumn("prior", prior).withColumn("cur_lp", F.transform("cur", lambda x: -x / 5.0))
    d = d.withColumn("out", A.join_streams(F.col("prior"), F.col("cur"), F.col("cur_lp"), F.col("obs"), 2))
    weighted = A.array_sum(F.transform("out", lambda r, i: r["logp"] * (i + 1)))
    return d.select("doc_id", _digest(F.col("out.id")).alias("ids"), _digest(F.col("out.mask_id")).alias("mask_ids"), F.round(weighted, 4).alias("weighted_logp"))


@query("d17_fill_inactive_rows", f"""WITH c AS ({_CONV_SQL}), r AS (SELECT conv_id, ids, text FROM c WHERE turn = 4)
SELECT a.conv_id, coalesce(md5(r.text), md5('')) AS text_digest, {_md5('coalesce(r.ids, list_transform(range(0, w), lambda x: CAST(0 AS BIGINT)))')} AS digest
FROM (SELECT DISTINCT conv_id FROM c) a LEFT JOIN r ON a.conv_id = r.conv_id, (SELECT max(len(ids)) AS w FROM r)""")
def _(t: Tables):
    c = _conv(t)
    out = T.fill_inactive(c.select("conv_id").distinct(), c.where("turn = 4"), "conv_id", "ids", "text", 0)
    return out.select("conv_id", F.md5("text").alias("text_digest"), _digest("ids").alias("digest"))


@query("d18_response_mask_and_lengths", "SELECT seq_id, CAST(sum(CASE WHEN pos < 16 THEN loss_mask END) AS BIGINT) AS prompt_length, CAST(sum(CASE WHEN pos >= 16 THEN loss_mask END) AS BIGINT) AS response_length FROM @tok GROUP BY 1")
def _(t: Tables):
    s = t.sequences().withColumn("response_mask", A.keep_last(F.col("loss_mask"), F.lit(48)))
    s = s.withColumn("prompt_mask", A.keep_first(F.col("loss_mask"), F.size("loss_mask") - 48))
    return s.select("seq_id", A.count_ones("prompt_mask").alias("prompt_length"), A.count_ones("response_mask").alias("response_length"))


@query("d19_drop_clipped_masks", "SELECT seq_id, CAST(CASE WHEN n >= 55 THEN 0 ELSE n END AS BIGINT) AS kept FROM (SELECT seq_id, sum(mask) AS n FROM @tok GROUP BY 1)")
def _(t: Tables):
    return T.drop_clipped_masks(t.sequences(), "mask", 55).select("seq_id", A.count_ones("mask").alias("kept"))


@query("d20_loss_mask_coverage", f"SELECT {r6('avg(l)')} AS response_length, {r6('sum(l) / sum(n)')} AS response_coverage FROM (SELECT seq_id, sum(mask * info) AS l, sum(mask) AS n FROM @tok GROUP BY 1)")
def _(t: Tables):
    s = t.sequences().withColumn("lm", A.multiply_masks(F.col("info"), F.col("mask")))
    c = T.coverage(s, "lm", "mask")
    return c.select(*[F.round(x, 6).alias(x) for x in c.columns])


@query("d21_turn_end_position", "SELECT seq_id, pos, coalesce(min(CASE WHEN turn_end = 1 THEN pos END) OVER (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), width - 1) AS end_pos FROM @tok")
def _(t: Tables):
    tok = T.explode_tokens(t.sequences(), ["turn_end"], cluster="seq_id")
    return T.turn_end_position(tok, "turn_end").select("seq_id", "pos", "end_pos")


@query("d21_next_event_across_tables", """SELECT t.seq_id, t.pos, e.pos AS end_pos FROM (SELECT seq_id, pos FROM @tok) t
ASOF LEFT JOIN (SELECT seq_id, pos FROM @tok WHERE turn_end = 1) e ON t.seq_id = e.seq_id AND t.pos <= e.pos""")
def _(t: Tables):
    tok = T.explode_tokens(t.sequences(), ["turn_end"], cluster="seq_id")
    ends = tok.where("turn_end = 1").select("seq_id", F.col("pos").alias("event_pos"))
    return I.next_at_or_after(tok.select("seq_id", "pos"), ends, ["seq_id"], "pos", "event_pos", "end_pos", 16)


@query("e12_spans_over_tokens", f"""WITH s AS (SELECT doc_id, doc_id % 7 * 11 AS start, doc_id % 7 * 11 + 1 + doc_id % 97 AS stop, 'a' AS kind FROM documents
UNION ALL SELECT doc_id, 30 + doc_id % 13, 30 + doc_id % 13 + doc_id % 5 * 40, 'b' FROM documents),
w AS (SELECT doc_id, unnest(range(0, len(ids))) AS pos FROM ({_DOC_SQL}))
SELECT w.doc_id, w.pos, s.kind FROM w JOIN s ON s.doc_id = w.doc_id AND s.start <= w.pos AND w.pos < s.stop""")
def _(t: Tables):
    d = _docs(t)
    one = d.select("doc_id", (F.col("doc_id") % 7 * 11).alias("start"), (F.col("doc_id") % 7 * 11 + 1 + F.col("doc_id") % 97).alias("stop"), F.lit("a").alias("kind"))
    two = d.select("doc_id", (30 + F.col("doc_id") % 13).alias("start"), (30 + F.col("doc_id") % 13 + F.col("doc_id") % 5 * 40).alias("stop"), F.lit("b").alias("kind"))
    places = d.select("doc_id", F.posexplode("ids").alias("pos", "id")).select("doc_id", F.col("pos").cast("bigint").alias("pos"))
    return I.covering_spans(places, one.unionByName(two), ["doc_id"], "pos", "start", "stop", 32).select("doc_id", "pos", "kind")


@query("d22_masked_cumulative", f"SELECT seq_id, pos, {r6('sum(e * loss_mask) OVER w')} AS cum_sum, CAST(sum(loss_mask) OVER w AS BIGINT) AS cum_count FROM @tok WINDOW w AS (PARTITION BY seq_id ORDER BY pos ROWS UNBOUNDED PRECEDING)")
def _(t: Tables):
    tok = T.explode_tokens(t.sequences(), ["e", "loss_mask"], cluster="seq_id")
    return T.cumulative(tok, "e", "loss_mask").select("seq_id", "pos", F.round("cum_sum", 6).alias("cum_sum"), "cum_count")


@query("d23_find_subsequence", f"""SELECT doc_id, CASE WHEN len(sub) = 0 THEN -1 ELSE CAST(coalesce(list_position(list_transform(range(1, len(ids) - len(sub) + 2), lambda i: ids[i:i + len(sub) - 1] = sub), true), 0) - 1 AS BIGINT) END AS found FROM (
SELECT doc_id, ids, ids[40:43] AS sub FROM ({_DOC_SQL}))""")
def _(t: Tables):
    return _docs(t).select("doc_id", A.find_subsequence(F.col("ids"), F.slice("ids", 40, 4)).alias("found"))


@query("d24_extend_position_ids", f"""SELECT doc_id, {_md5('list_concat(range(0, n), range(n, n + len(ids)))')} AS positions, {_md5('list_concat(list_transform(range(0, n), lambda x: 1), list_transform(ids, lambda x, i: CASE WHEN k = 0 OR i <= k THEN 1 ELSE 0 END))')} AS mask FROM (
SELECT doc_id, ids, 5 + doc_id % 7 AS n, coalesce(list_position(ids, 9), 0) AS k FROM ({_DOC_SQL}))""")
def _(t: Tables):
    n = F.lit(5) + F.col("doc_id") % 7
    d = _docs(t).withColumn("prompt_pos", F.sequence(F.lit(0).cast("bigint"), n - 1))
    prompt_mask = F.transform("prompt_pos", lambda _: F.lit(1))
    positions = A.extend_positions(F.col("prompt_pos"), F.size("ids").cast("bigint"))
    return d.select("doc_id", _digest(positions).alias("positions"), _digest(F.concat(prompt_mask, A.eos_mask(F.col("ids"), [9]))).alias("mask"))
