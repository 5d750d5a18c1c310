"""Queries over agent turns, transcripts and observation spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as J
from ..operators import scoring as S
from ..operators import trajectories as R
from .answers import WS
from .registry import Tables, query, r6

FENCE_RX = r"(?s)```(?:py|python)?\n(.*?)\n```"
UPTO_RX = r"(?s)^.*?```(?:py|python)?\n.*?\n```"


def _cut_mid(col: str, n: int, marker: str | None = None) -> str:
    note = marker or f"chr(10) || '..._This content has been truncated to stay below {n} characters_...' || chr(10)"
    return f"CASE WHEN length({col}) <= {n} THEN {col} ELSE left({col}, {n // 2}) || {note} || right({col}, {-(-n // 2)}) END"


@query("e01_cut_after_code", f"SELECT traj_id, turn, md5(coalesce(nullif(regexp_extract(text, '{UPTO_RX}'), ''), text)) AS digest FROM @turns")
def _(t: Tables):
    return t.view("turns").select("traj_id", "turn", F.md5(T.cut_after_code(F.col("text"))).alias("digest"))


@query("e02_first_code", f"SELECT traj_id, turn, CASE WHEN regexp_matches(text, '{FENCE_RX}') THEN trim(regexp_extract(text, '{FENCE_RX}', 1), {WS}) END AS code FROM @turns")
def _(t: Tables):
    return t.view("turns").select("traj_id", "turn", T.first_code(F.col("text")).alias("code"))


_CLASS_SQL = f"""SELECT *, NOT active OR answered OR (active AND NOT answered AND NOT coded) AS done0, CASE WHEN active AND coded THEN 1 ELSE 0 END AS use_code,
active AND NOT answered AND NOT coded AS is_void FROM (SELECT *, traj_id % 5 <> 0 OR turn < 4 AS active, contains(text, chr(92) || 'boxed' || chr(123)) AS answered,
regexp_matches(text, '{FENCE_RX}') AS coded FROM @turns)"""


def _active():
    return (F.col("traj_id") % 5 != 0) | (F.col("turn") < 4)


def _classified(t: Tables):
    turns = t.view("turns").withColumn("active", _active())
    return R.classify_turns(turns, t.view("exec_log"), ["traj_id", "turn"], "text", "active")


_OBS_SQL = f"""SELECT c.*, e.success, e.stdout, e.stderr, CASE WHEN use_code = 1 AND stderr = '' AND stdout <> '' THEN 1 ELSE 0 END AS valid_code,
done0 OR (use_code = 1 AND contains(stdout, chr(92) || 'boxed' || chr(123))) AS done,
CASE WHEN use_code = 1 THEN chr(10) || 'Code execution result: ' || CASE WHEN stderr <> '' THEN {_cut_mid("string_split(stderr, chr(10))[-1]", 512)}
WHEN stdout <> '' THEN {_cut_mid("stdout", 512)} WHEN NOT success THEN 'interpreter timeout' ELSE '' END || chr(10) WHEN is_void THEN chr(10) END AS observation
FROM ({_CLASS_SQL}) c JOIN @exec_log e ON c.traj_id = e.traj_id AND c.turn = e.turn"""


@query("e03_classify_turn", f"SELECT traj_id, turn, done0 AS done, use_code, is_void FROM ({_CLASS_SQL})")
def _(t: Tables):
    c = t.view("turns").withColumn("c", T.classify_turn(F.col("text"), _active()))
    return c.select("traj_id", "turn", "c.done", "c.use_code", "c.is_void")


@query("e04_observation", f"SELECT traj_id, turn, md5(observation) AS digest, valid_code, done FROM ({_OBS_SQL})")
def _(t: Tables):
    return _classified(t).select("traj_id", "turn", F.md5("observation").alias("digest"), "valid_code", "done")


@query("e05_truncate_middle", f"SELECT doc_id, md5({_cut_mid('text', 400)}) AS even, md5({_cut_mid('text', 333)}) AS odd, md5(CASE WHEN length(text) > 400 THEN left(text, 200) || '...' || right(text, 200) ELSE text END) AS short FROM documents")
def _(t: Tables):
    c = F.col("text")
    return t.table("documents").select("doc_id", F.md5(T.truncate_middle(c, 400)).alias("even"), F.md5(T.truncate_middle(c, 333)).alias("odd"),
                                       F.md5(T.truncate_middle(c, 400, "...", even=True)).alias("short"))


@query("e06_count_lines", f"""SELECT doc_id, CAST(len(l) AS BIGINT) AS total_lines, CAST(len(list_filter(l, lambda x: trim(x, {WS}) <> '' AND NOT starts_with(ltrim(x, {WS}), '#'))) AS BIGINT) AS code_lines FROM (
SELECT doc_id, string_split(regexp_replace(s, '\\n$', ''), chr(10)) AS l FROM (SELECT doc_id, concat('# head', chr(10), text, chr(10), chr(10), '  # x', chr(10), 'y = 1', chr(10)) AS s FROM documents))""")
def _(t: Tables):
    code = F.concat(F.lit("# head\n"), "text", F.lit("\n\n  # x\ny = 1\n"))
    d = t.table("documents").withColumn("n", T.count_lines(code))
    return d.select("doc_id", F.col("n.total_lines").cast("bigint").alias("total_lines"), F.col("n.code_lines").cast("bigint").alias("code_lines"))


_ROLL_SQL = f"SELECT traj_id, count(*) AS turns, sum(use_code)::BIGINT AS use_code, sum(valid_code)::BIGINT AS valid_code, bool_and(NOT done) AS active, bool_and(NOT is_void) AS no_void FROM ({_OBS_SQL}) GROUP BY 1"


@query("e07_trajectory_roll_up", _ROLL_SQL)
def _(t: Tables):
    return R.roll_up(_classified(t))


@query("e08_active_per_turn", f"SELECT turn, count_if(NOT done)::BIGINT AS active, count(*) AS trajectories FROM ({_OBS_SQL}) GROUP BY 1")
def _(t: Tables):
    return R.active_per_turn(_classified(t))


_W = "list_transform(string_split({}, ' '), lambda w: CAST(length(w) AS BIGINT))"
_PARTS_SQL = f"""SELECT traj_id, turn, {_W.format('text')} AS ids, CASE WHEN observation IS NULL THEN [] ELSE {_W.format("coalesce(observation, '')")} END AS obs FROM ({_OBS_SQL})"""


def _parts(t: Tables):
    def ids(c):
        return F.transform(F.split(c, " "), lambda w: F.length(w).cast("bigint"))

    c = _classified(t)
    obs = F.when(F.col("observation").isNull(), F.array().cast("array<bigint>")).otherwise(ids(F.col("observation")))
    p = c.select("traj_id", "turn", ids(F.col("text")).alias("ids"), obs.alias("obs"))
    return p.withColumn("lp", F.transform("ids", lambda x: -x / 10.0))


@query("e09_assemble_transcript", f"""SELECT traj_id, md5(array_to_string(ids[1:300], ',')) AS ids, md5(array_to_string(m[1:300], ',')) AS info_mask, {r6('list_sum(lp[1:300])', 4)} AS logp_sum FROM (
SELECT traj_id, flatten(list(list_concat(ids, obs) ORDER BY turn)) AS ids, flatten(list(list_concat(list_transform(ids, lambda x: 1), list_transform(obs, lambda x: 0)) ORDER BY turn)) AS m,
flatten(list(list_concat(list_transform(ids, lambda x: -x / 10e0), list_transform(obs, lambda x: -1e0)) ORDER BY turn)) AS lp FROM ({_PARTS_SQL}) GROUP BY 1)""")
def _(t: Tables):
    a = R.assemble(_parts(t), "ids", "lp", "obs", 300)

    def dig(c):
        return F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ","))

    return a.select("traj_id", dig("ids").alias("ids"), dig("info_mask").alias("info_mask"),
                    F.round(F.aggregate("log_probs", F.lit(0.0), lambda s, x: s + x), 4).alias("logp_sum"))


@query("e10_rolling_context", f"""SELECT traj_id, turn, CAST(greatest(e - 256, 0) AS BIGINT) AS context_start, CAST(e AS BIGINT) AS context_end FROM (
SELECT traj_id, turn, 20 + traj_id % 9 + coalesce(sum(len(ids) + len(obs)) OVER (PARTITION BY traj_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM ({_PARTS_SQL}))""")
def _(t: Tables):
    p = _parts(t).select("traj_id", "turn", (F.size("ids") + F.size("obs")).cast("bigint").alias("n_tokens"), (F.col("traj_id") % 9 + 20).alias("prompt_tokens"))
    return R.rolling_context(p, "prompt_tokens", 256).select("traj_id", "turn", "context_start", "context_end")


@query("e11_cap_observation", f"SELECT traj_id, turn, md5(array_to_string(ids[1:40], ',')) AS digest, len(ids) > 40 AS was_cut FROM ({_PARTS_SQL})")
def _(t: Tables):
    p = _parts(t).withColumn("o", R.cap_observation(F.col("ids"), 40))
    return p.select("traj_id", "turn", F.md5(F.array_join(F.transform("o.ids", lambda x: x.cast("string")), ",")).alias("digest"), "o.was_cut")


# a document with two observations behind it, the first one failed or empty on most rows
_C1 = "CASE doc_id % 4 WHEN 0 THEN 'ValueError: x' WHEN 1 THEN '' WHEN 2 THEN ' None ' ELSE '42' END"
_SPAN_SRC = f"""SELECT *, length(text) + 1 AS s1, length(text) + 1 + 22 + length(c1) AS e1, length(text) + 1 + 22 + length(c1) + 9 AS s2, length(w) AS e2, doc_id % 4 <> 3 AS err1, false AS err2 FROM (
SELECT *, text || chr(10) || 'Code execution result:' || c1 || '```mid```' || 'code execution RESULT: fine ' || lang AS w FROM (SELECT doc_id, text, lang, {_C1} AS c1 FROM documents))"""


def _wrapped(t: Tables):
    c1 = F.expr(_C1)
    w = F.concat("text", F.lit("\nCode execution result:"), c1, F.lit("```mid```code execution RESULT: fine "), "lang")
    return t.spread(t.table("documents").select("doc_id", "text", "lang")).select("doc_id", w.alias("w"))


@query("e12_find_observations", f"SELECT doc_id, CAST(s1 AS INTEGER) AS \"start\", CAST(e1 AS INTEGER) AS \"end\", err1 AS has_error FROM ({_SPAN_SRC}) UNION ALL SELECT doc_id, CAST(s2 AS INTEGER), CAST(e2 AS INTEGER), err2 FROM ({_SPAN_SRC})")
def _(t: Tables):
    return _wrapped(t).select("doc_id", F.explode(T.find_observations(F.col("w"))).alias("o")).select("doc_id", "o.start", "o.end", "o.has_error")


@query("e13_error_observation", f"SELECT doc_id, regexp_matches(lower(text), 'err|timeout|exception|traceback') OR lower(trim(text, {WS})) IN ('', '[]', 'none') AS has_error FROM documents")
def _(t: Tables):
    return t.table("documents").select("doc_id", T.is_error_observation(F.col("text")).alias("has_error"))


@query("e14_last_error_end", f"SELECT doc_id, CAST(CASE WHEN err1 THEN e1 ELSE -1 END AS INTEGER) AS last_error FROM ({_SPAN_SRC})")
def _(t: Tables):
    return _wrapped(t).select("doc_id", T.last_error_end(T.find_observations(F.col("w"))).alias("last_error"))


def _word_at(expr: str) -> str:
    return f"(len(string_split(left(w, CAST({expr} AS BIGINT)), ' ')) - 1)"


@query("e15_mask_labels", f"""SELECT doc_id, CAST(len(list_filter(l, lambda x: x = -100)) AS BIGINT) AS masked, md5(array_to_string(l, ',')) AS digest FROM (
SELECT doc_id, list_transform(words, lambda x, i: CASE WHEN (i - 1 BETWEEN a1 AND b1) OR (i - 1 BETWEEN a2 AND b2) OR (err1 AND i - 1 <= b1) THEN -100 ELSE i - 1 END) AS l FROM (
SELECT *, string_split(w, ' ') AS words, {_word_at('s1')} AS a1, {_word_at('e1 - 1')} AS b1, {_word_at('s2')} AS a2, {_word_at('e2 - 1')} AS b2 FROM ({_SPAN_SRC})))""")
def _(t: Tables):
    d = _wrapped(t).withColumn("labels", F.transform(F.split("w", " "), lambda _, i: i.cast("bigint")))
    d = d.withColumn("l", T.mask_labels(F.col("w"), F.col("labels")))
    return d.select("doc_id", F.size(F.filter("l", lambda x: x == -100)).cast("bigint").alias("masked"),
                    F.md5(F.array_join(F.transform("l", lambda x: x.cast("string")), ",")).alias("digest"))


_CODES = """CASE c_custkey % 6 WHEN 0 THEN concat('final_answer(', CAST(c_custkey AS STRING), ')') WHEN 1 THEN concat('\"\"\"doc\"\"\"', chr(10), 'final_answer(x)')
WHEN 2 THEN concat('x = 1', chr(10), 'final_answer(x)') WHEN 3 THEN 'final_answer(' WHEN 4 THEN 'print(1)' ELSE concat('# note', chr(10), 'final_answer(f(2))') END"""


@query("e16_only_final_answer", "SELECT c_custkey, c_custkey % 6 IN (0, 1, 5) AS only_answer FROM customer")
def _(t: Tables):
    return t.table("customer").select("c_custkey", T.is_only_final_answer(F.expr(_CODES)).alias("only_answer"))


_HELPER_SQL = "concat(chr(10), 'def final_answer(result):', chr(10), '    print(f\"', chr(92), chr(92), 'boxed{{{result}}}\")', chr(10), chr(10), "


@query("e17_prepend_helper", "SELECT c_custkey, md5(" + _HELPER_SQL + _CODES + ")) AS digest FROM customer")
def _(t: Tables):
    return t.table("customer").select("c_custkey", F.md5(T.with_answer_helper(F.expr(_CODES))).alias("digest"))


@query("e18_output_tail", "SELECT doc_id, md5(right(text, 1000)) AS digest FROM documents")
def _(t: Tables):
    return t.table("documents").select("doc_id", F.md5(T.output_tail(F.col("text"))).alias("digest"))


@query("e19_tool_use_flags", f"""SELECT traj_id, turn, CASE WHEN coded THEN 1 ELSE 0 END AS use_code, CASE WHEN coded AND stderr = '' THEN 1 ELSE 0 END AS no_bug_code, CASE WHEN coded AND stderr = '' THEN 1 ELSE 0 END AS true_tool_use FROM ({_OBS_SQL})""")
def _(t: Tables):
    return S.tool_use(t.view("turns"), t.view("exec_log"), ["traj_id", "turn"], "text").select("traj_id", "turn", "use_code", "no_bug_code", "true_tool_use")


@query("e20_closing_prompt", f"SELECT traj_id, turn, md5(CASE WHEN turn = 3 AND observation <> '' THEN observation || 'Answer now.' ELSE observation END) AS digest FROM ({_OBS_SQL})")
def _(t: Tables):
    obs = T.add_closing_prompt(F.col("observation"), F.col("turn"), 5, "Answer now.")
    return _classified(t).select("traj_id", "turn", F.md5(obs).alias("digest"))


@query("j17_environment_metrics", f"""SELECT {r6('avg(turns)')} AS num_turns_mean, max(turns) AS num_turns_max, min(turns) AS num_turns_min, {r6('avg(CASE WHEN turns = 1 THEN 1 ELSE 0 END)')} AS num_one_turn,
{r6('1 - avg(CASE WHEN active THEN 1 ELSE 0 END)')} AS finish_ratio, {r6('1 - avg(CASE WHEN no_void THEN 1 ELSE 0 END)')} AS void_turn_ratio, {r6('avg(use_code)')} AS num_code_use,
{r6('avg(use_code / turns)')} AS code_use_ratio, {r6('avg(valid_code)')} AS num_valid_code, {r6('avg(valid_code / turns)')} AS valid_code_ratio FROM ({_ROLL_SQL})""")
def _(t: Tables):
    m = J.environment_metrics(R.roll_up(_classified(t)))
    return m.select(*[F.round(c, 6).alias(c) if ty == "double" else F.col(c) for c, ty in m.dtypes])


@query("j17_code_line_metrics", f"""SELECT {r6("avg(CASE WHEN valid_code = 1 THEN n END)")} AS success_code_lines, {r6("avg(CASE WHEN stderr <> '' THEN n END)")} AS fail_code_lines,
{r6("avg(CASE WHEN valid_code = 1 THEN r END)")} AS success_code_strip_lines, {r6("avg(CASE WHEN stderr <> '' THEN r END)")} AS fail_code_strip_lines FROM (
SELECT *, len(l) AS n, len(list_filter(l, lambda x: trim(x, {WS}) <> '' AND NOT starts_with(ltrim(x, {WS}), '#'))) AS r FROM (
SELECT *, string_split(trim(regexp_extract(text, '{FENCE_RX}', 1), {WS}), chr(10)) AS l FROM ({_OBS_SQL}) WHERE use_code = 1))""")
def _(t: Tables):
    m = R.code_line_metrics(_classified(t))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])
