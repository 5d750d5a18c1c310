"""Queries over sources, sinks, streams and the function registries."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import answers as X
from ..functions import registry as M
from ..operators import managers  # noqa: F401  fills the registries
from ..session import scratch_path
from ..sources import files as A
from ..sources import steps as Z
from ..streaming import processors as P
from ..streaming import steps as L
from .answers import _JUDGED_SQL, _LADDER_TAIL, TRANSCRIPT_SQL, _ladder_sql, _runs, chain, math_equal_sql, normalise_sql
from .registry import Tables, query, r6
from .rewards import HOUR_SQL
from .trajectories import _OBS_SQL, _wrapped


def _doc_meta(t: Tables):
    return t.table("documents").select("doc_id", "lang", "source", "n_chars")


@query("a01_read_parquet_list", "SELECT count(*) AS n, CAST(count(text) AS BIGINT) AS texts, CAST(count(html) AS BIGINT) AS pages, CAST(count(item_id) AS BIGINT) AS items FROM (SELECT text, NULL AS html, NULL AS item_id FROM documents UNION ALL SELECT text, NULL, item_id FROM benchmark UNION ALL SELECT NULL, html, NULL FROM pages)")
def _(t: Tables):
    df = A.read_parquet_list(t.spark, [f"{t.sf_dir}/{n}.parquet" for n in ("documents", "benchmark", "pages")])
    return df.agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("texts"), F.count("html").alias("pages"), F.count("item_id").alias("items"))


@query("a02_stamp_source", "SELECT 'documents.parquet' AS file, count(*) AS n FROM documents")
def _(t: Tables):
    d = A.stamp_source(t.table("documents"))
    return d.select(F.substring_index("data_source", "/", -1).alias("file")).groupBy("file").agg(F.count(F.lit(1)).alias("n"))


@query("a04_read_jsonl", "SELECT doc_id, md5(text) AS digest, lang FROM documents")
def _(t: Tables):
    path = scratch_path(t.spark, "jsonl")
    docs = t.table("documents").select("doc_id", "text", "lang")
    A.write_jsonl(docs, path)
    return A.read_jsonl(t.spark, path, docs.schema).select("doc_id", F.md5("text").alias("digest"), "lang")


@query("a05_write_jsonl", "SELECT count(*) AS n, CAST(sum(CASE WHEN regexp_matches(text, '[^\\x00-\\x7F]') THEN 1 ELSE 0 END) AS BIGINT) AS with_non_ascii FROM documents")
def _(t: Tables):
    path = scratch_path(t.spark, "jsonl")
    A.write_jsonl(t.table("documents").select("doc_id", "text"), path)
    raw = t.spark.read.text(path)
    return raw.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value").rlike(r"[^\x00-\x7F]")).alias("with_non_ascii"))


@query("a06_cached_dataset", "SELECT doc_id, lang, source, n_chars FROM documents")
def _(t: Tables):
    path = scratch_path(t.spark, "cache")
    A.cached_dataset(t.spark, path, lambda: _doc_meta(t))
    return A.cached_dataset(t.spark, path, lambda: _doc_meta(t))


@query("a07_generations", "SELECT conv_id, CAST(count(*) AS BIGINT) AS n, md5(string_agg(text, '|' ORDER BY turn)) AS digest FROM conversations GROUP BY 1")
def _(t: Tables):
    c = t.table("conversations")
    g = A.generations(c.select("conv_id").distinct(), c, "conv_id", "turn", "text")
    path = scratch_path(t.spark, "generations")
    g.write.parquet(path)
    back = t.spark.read.parquet(path)
    return back.select("conv_id", F.size("responses").cast("bigint").alias("n"), F.md5(F.array_join("responses", "|")).alias("digest"))


@query("a08_append_records", "SELECT 'train' AS split, 1 AS step, count(*) AS n FROM orders UNION ALL SELECT 'train', 2, count(*) FROM orders UNION ALL SELECT 'val', 1, count(*) FROM customer")
def _(t: Tables):
    path = scratch_path(t.spark, "records")
    orders = t.table("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("score"))
    A.append_records(orders, path, "train", 1)
    A.append_records(orders, path, "train", A.next_step(t.spark, path, "train"))
    A.append_records(t.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")), path, "val", 1)
    return t.spark.read.schema("id bigint, score double, split string, step int").json(path).groupBy("split", "step").agg(F.count(F.lit(1)).alias("n"))


@query("a08_step_manifests", """SELECT 'train' AS split, CAST(s AS BIGINT) AS step, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS ids, CAST(4 AS BIGINT) AS next_step
FROM orders, (SELECT unnest([1, 2, 3]) AS s) WHERE s <> 2 OR o_orderkey % 2 = 0 GROUP BY 2""")
def _(t: Tables):
    path = scratch_path(t.spark, "step-records")
    orders = t.table("orders").select("o_orderkey", "o_totalprice")
    Z.register(t.spark)

    def save(rows, step: int) -> None:
        rows.write.format("step_records").option("path", path).option("split", "train").option("step", step).mode("append").save()

    save(orders, Z.next_step(path, "train"))
    save(orders, Z.next_step(path, "train"))
    save(orders.where("o_orderkey % 2 = 0"), 2)  # the step is written again and replaces itself
    save(orders, Z.next_step(path, "train"))
    back = t.spark.read.format("step_records").option("path", path).schema("o_orderkey bigint, split string, step bigint").load()
    return back.groupBy("split", "step").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("ids"), F.lit(Z.next_step(path, "train")).cast("bigint").alias("next_step"))


@query("a09_step_from_file_name", "SELECT CAST(s AS INTEGER) AS step, count(*) AS n FROM orders, (SELECT unnest([0, 7, 20]) AS s) GROUP BY 1")
def _(t: Tables):
    path = scratch_path(t.spark, "step-files")
    rows = t.table("orders").select("o_orderkey")
    for step in ("step-7.", "step-20.", "records"):
        rows.write.parquet(f"{path}/{step}")
    files = t.spark.read.option("recursiveFileLookup", "true").parquet(path)
    return files.select(A.step_from_file_name(F.col("_metadata.file_path")).alias("step")).groupBy("step").agg(F.count(F.lit(1)).alias("n"))


@query("a09_next_step", "SELECT 'train' AS split, CAST(max(year(o_orderdate)) + 1 AS BIGINT) AS next_step FROM orders UNION ALL SELECT 'val', 1")
def _(t: Tables):
    path = scratch_path(t.spark, "records")
    orders = t.table("orders").select(F.col("o_orderkey").alias("id"), F.lit("train").alias("split"), F.year("o_orderdate").alias("step"))
    orders.repartition("step").write.partitionBy("split", "step").json(path)
    rows = [(s, A.next_step(t.spark, path, s)) for s in ("train", "val")]
    return t.spark.createDataFrame(rows, "split string, next_step bigint")


@query("a10_snapshots", "SELECT step, count(*) AS n FROM (SELECT CAST(floor(o_orderkey / 100) AS BIGINT) AS step FROM orders) WHERE step % 20 = 0 GROUP BY 1")
def _(t: Tables):
    path = scratch_path(t.spark, "snapshots")
    batches = t.table("orders").withColumn("step", F.floor(F.col("o_orderkey") / 100))
    A.write_snapshots(batches.repartition("step"), path)
    return t.spark.read.parquet(path).groupBy(F.col("step").cast("bigint").alias("step")).agg(F.count(F.lit(1)).alias("n"))


@query("a11_profile", f"""SELECT 'vec_id' AS "column", count(*) AS rows, count(vec_id) AS "values", {r6('min(vec_id)::DOUBLE')} AS min, {r6('max(vec_id)::DOUBLE')} AS max, {r6('avg(vec_id)')} AS mean FROM embeddings
UNION ALL SELECT 'label', count(*), count(label), {r6('min(label)::DOUBLE')}, {r6('max(label)::DOUBLE')}, {r6('avg(label)')} FROM embeddings
UNION ALL SELECT 'embedding', any_value(n), count(*), {r6('min(x)')}, {r6('max(x)')}, {r6('avg(x)')} FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x, n FROM (SELECT embedding, count(*) OVER () AS n FROM embeddings))""")
def _(t: Tables):
    p = A.profile(t.table("embeddings"))
    return p.select("column", "rows", "values", *[F.round(c, 6).alias(c) for c in ("min", "max", "mean")])


_WIDE_STEPS = "SELECT CAST(year(l_shipdate) AS BIGINT) AS step, sum(l_quantity) AS quantity, CAST(count(*) AS DOUBLE) AS rows FROM lineitem GROUP BY 1"


def _wide_steps(t: Tables):
    return t.table("lineitem").groupBy(F.year("l_shipdate").cast("bigint").alias("step")).agg(
        F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).cast("double").alias("rows"))


@query("a14_log_metrics", f"SELECT step, 'quantity' AS metric, quantity AS value FROM ({_WIDE_STEPS}) UNION ALL SELECT step, 'rows', rows FROM ({_WIDE_STEPS})")
def _(t: Tables):
    path = scratch_path(t.spark, "metrics")
    A.log_metrics(_wide_steps(t), path)
    return t.spark.read.parquet(path)


@query("a15_metric_line", f"SELECT step, 'step:' || step || ' - quantity:' || printf('%.3f', quantity) || ' - rows:' || printf('%.3f', rows) AS line FROM ({_WIDE_STEPS})")
def _(t: Tables):
    return A.metric_line(A.to_metric_table(_wide_steps(t), "step"))


@query("a16_validation_lines", "SELECT event_type || ': ' || CAST(count(*) AS STRING) AS value FROM events GROUP BY event_type")
def _(t: Tables):
    path = scratch_path(t.spark, "validation")
    m = t.table("events").groupBy(F.col("event_type").alias("metric")).agg(F.count(F.lit(1)).alias("value"))
    A.write_validation(m, path)
    return t.spark.read.text(path)


@query("a17_flatten_columns", "SELECT event_id, user_id AS \"a/u\", value AS \"a/b/v\" FROM events")
def _(t: Tables):
    nested = F.struct(F.col("user_id").alias("u"), F.struct(F.col("value").alias("v")).alias("b"))
    return A.flatten_columns(t.table("events").select("event_id", nested.alias("a")))


# ---------------------------------------------------------------- streams

def _event_stream(t: Tables, files: int = 1):
    """The event table as a stream: as it lies, or rewritten into files in time order."""
    schema = t.table("events").schema
    if files == 1:
        raw = L.read_files(t.spark, t.sf_dir, schema, "events.parquet")
    else:
        folder = scratch_path(t.spark, "events")
        t.table("events").repartitionByRange(files, "ts").sortWithinPartitions("ts").write.parquet(folder)
        raw = L.read_files(t.spark, folder, schema, files_per_batch=1)
    return _at(raw)


def _at(events):
    """The zone-less event time as an instant, whatever the session's time zone."""
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)"
    return events.withColumn("at", F.expr(f"timestamp_micros({micros})"))


@query("l01_stream_scored_records", "SELECT event_id, user_id, CASE WHEN value > 20 THEN 1e0 ELSE 0e0 END AS score FROM events")
def _(t: Tables):
    base = scratch_path(t.spark, "l01")
    scored = L.score_records(_event_stream(t), F.when(F.col("value") > 20, 1.0).otherwise(0.0), ["event_id", "user_id"])
    L.run_to_end(scored, base + "/checkpoint", path=base + "/out")
    return t.spark.read.parquet(base + "/out")


@query("l02_tumbling_metrics", f"SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, {r6('sum(value)', 2)} AS total FROM events GROUP BY 1, 2")
def _(t: Tables):
    base = scratch_path(t.spark, "l02")
    m = L.windowed_metrics(_event_stream(t), "at", ["event_type"], "value", "6 hours")
    L.run_to_end(m, base + "/checkpoint", mode="update", each=L.upsert_batches(base + "/out"))
    out = L.latest(t.spark, base + "/out", ["start", "event_type"])
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


@query("l02_sliding_metrics", f"SELECT CAST(epoch(time_bucket(INTERVAL 2 HOUR, ts)) - o AS BIGINT) AS start, event_type, count(*) AS n, {r6('sum(value)', 2)} AS total FROM events, (SELECT unnest([0, 7200, 14400]) AS o) GROUP BY 1, 2")
def _(t: Tables):
    base = scratch_path(t.spark, "l02s")
    m = L.windowed_metrics(_event_stream(t), "at", ["event_type"], "value", "6 hours", "2 hours")
    L.run_to_end(m, base + "/checkpoint", mode="update", each=L.upsert_batches(base + "/out"))
    out = L.latest(t.spark, base + "/out", ["start", "event_type"])
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


LATE_SQL = "CAST(least(3, floor((epoch(ts) - (SELECT min(epoch(ts)) FROM events)) / 691200) + CASE WHEN event_id % 11 = 0 THEN 1 ELSE 0 END) AS BIGINT)"
"""The delivery of four, each of eight days, that brings an event; one event in eleven comes a delivery late."""


def _saved(df, name: str):
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _deliveries(events):
    first = events.agg(F.min("at").alias("t")).first()["t"]
    day = (F.unix_micros("at") - F.unix_micros(F.lit(first))) / 1e6 / 691200
    return events.withColumn("delivery", F.least(F.lit(3), F.floor(day) + F.when(F.col("event_id") % 11 == 0, 1).otherwise(0)))


def _deliver(t: Tables, rows, base: str, job, numbers=range(4), mark: str | None = None, **sink) -> int:
    """Run a streaming job over rows that come in deliveries, one start of the job after each; the state's rows at the end."""
    plain = rows.drop("delivery")
    left = 0
    for number in numbers:
        rows.where(F.col("delivery") == number).drop("delivery").write.mode("append").parquet(base + "/in")
        if mark and number == max(numbers):
            P.with_closing_mark(t.spark, base + "/in", plain, "at", mark)
        left = L.run_to_end(job(L.read_files(t.spark, base + "/in", plain.schema)), base + "/checkpoint", **sink)
    return left


@query("l03_groups_with_deadline", f"""WITH e AS (SELECT event_id, ts, value, {LATE_SQL} AS delivery, user_id * 1000000 + (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 4 AS uid FROM events),
g AS (SELECT *, min(epoch_ms(ts)) OVER (PARTITION BY uid) AS issued FROM e),
w AS (SELECT delivery, coalesce(max(max(issued)) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 43200000, 0) AS clock FROM g GROUP BY delivery),
r AS (SELECT g.*, issued < clock AS late FROM g JOIN w USING (delivery)),
k AS (SELECT uid, issued, count(*) AS n, sum(value) AS total FROM r WHERE NOT late GROUP BY uid, issued)
SELECT 'late' AS kind, uid, CAST(1 AS BIGINT) AS n, {r6('value', 2)} AS total FROM r WHERE late
UNION ALL SELECT CASE WHEN n = 4 THEN 'complete' ELSE 'timeout' END, uid, n, {r6('total', 2)} FROM k
WHERE n = 4 OR issued < (SELECT max(issued) - 43200000 FROM r)""")
def _(t: Tables):
    base = scratch_path(t.spark, "l03")
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    events = _deliveries(_at(t.table("events"))).withColumn("uid", F.col("user_id") * 1000000 + F.floor(seq / 4))
    issued = events.groupBy("uid").agg(F.min("at").alias("issued"))
    rows = _saved(events.join(issued, "uid").select("uid", "value", "issued", "at", "delivery"), "l03-rows")
    _deliver(t, rows, base, lambda s: P.groups_with_deadline(s, "uid", "value", "issued", 4, "12 hours"), path=base + "/out")
    return t.spark.read.parquet(base + "/out").withColumn("total", F.round("total", 2))


@query("l03_complete_groups", "SELECT user_id AS uid, unnest(range(0, CAST(floor(count(*) / 8) AS BIGINT))) AS group_no, CAST(8 AS BIGINT) AS n FROM events GROUP BY user_id")
def _(t: Tables):
    base = scratch_path(t.spark, "l03")
    g = L.complete_groups(_event_stream(t, files=3), "user_id", "value", 8)
    L.run_to_end(g, base + "/checkpoint", path=base + "/out")
    return t.spark.read.parquet(base + "/out").select("uid", "group_no", "n")


@query("l04_session_trajectories", """SELECT user_id, count(*) AS turns, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS use_code, min(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) AS no_void, CAST(0 AS BIGINT) AS state_rows FROM (
SELECT *, sum(CASE WHEN gap IS NULL OR gap >= 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)) GROUP BY user_id, s""")
def _(t: Tables):
    base = scratch_path(t.spark, "l04")
    flagged = _deliveries(_at(t.table("events"))).select(
        "user_id", "at", (F.col("event_type") == "click").cast("bigint").alias("use_code"),
        F.when(F.col("event_type") == "error", 0).otherwise(1).alias("no_void"), "delivery")
    left = _deliver(t, flagged, base, lambda s: L.session_trajectories(s, "at", "user_id", "30 minutes", "9 days"),
                    mark="10 DAYS", path=base + "/out")
    return t.spark.read.parquet(base + "/out").select("user_id", "turns", "use_code", "no_void", F.lit(left).cast("bigint").alias("state_rows"))


@query("l05_resume", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t: Tables):
    return L.not_yet_written(t.table("documents").select("doc_id", "lang"), t.table("labels"), ["doc_id"])


@query("l05_resume_stream", "SELECT count(*) AS n, count(DISTINCT event_id) AS events FROM events")
def _(t: Tables):
    # two runs on one checkpoint: the second finds nothing left to do
    base = scratch_path(t.spark, "l05")
    for _ in range(2):
        L.run_to_end(_event_stream(t).select("event_id"), base + "/checkpoint", path=base + "/out")
    return t.spark.read.parquet(base + "/out").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"))


@query("l06_adaptive_coefficient_stream", f"""WITH s AS (SELECT event_type AS run, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS step, avg(value) / 100 AS kl, count(*) AS n FROM events GROUP BY 1, 2)
SELECT run, step, n, {r6('kl')} AS kl, {r6('0.2 * exp(sum(ln(1 + greatest(least(kl / 0.5 - 1, 0.2), -0.2) * n / 10000)) OVER (PARTITION BY run ORDER BY step ROWS UNBOUNDED PRECEDING))')} AS kl_coef FROM s""")
def _(t: Tables):
    base = scratch_path(t.spark, "l06")
    rows = _deliveries(_at(t.table("events"))).select(
        F.col("event_type").alias("run"), F.expr(HOUR_SQL).alias("step"), (F.col("value") / 100).alias("kl"), "at", "delivery")
    ends = (F.col("step") + 1) * 3600000
    _deliver(t, rows, base, lambda s: P.ordered_coefficients(s, "run", "step", "kl", "at", ends, "9 days", 0.2, 0.5, 10000.0),
             mark="10 DAYS", path=base + "/out")
    out = t.spark.read.parquet(base + "/out")
    return out.select("run", "step", "n", F.round("kl", 6).alias("kl"), F.round("kl_coef", 6).alias("kl_coef"))


@query("l07_full_batches", """WITH g AS (SELECT user_id, user_id % 3 AS delivery FROM events GROUP BY user_id),
p AS (SELECT *, row_number() OVER (ORDER BY delivery, md5(concat(CAST(user_id AS STRING), '-5')), user_id) - 1 AS pos FROM g),
c AS (SELECT delivery AS batch, sum(count(*)) OVER (ORDER BY delivery) // 4 * 4 AS upto FROM g GROUP BY delivery),
b AS (SELECT batch, upto, coalesce(lag(upto) OVER (ORDER BY batch), 0) AS since FROM c)
SELECT user_id, CAST(batch AS INTEGER) AS batch, CAST((pos - since) // 4 AS BIGINT) AS slot FROM p JOIN b ON pos >= since AND pos < upto""")
def _(t: Tables):
    base = scratch_path(t.spark, "l07")
    groups = t.table("events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("score"))
    rows = _saved(groups.withColumn("delivery", F.col("user_id") % 3), "l07-groups")
    _deliver(t, rows, base, lambda s: s, range(3), each=L.full_batches(base + "/carry", base + "/out", "user_id", 4, 5))
    return t.spark.read.parquet(base + "/out").select("user_id", "batch", "slot")


@query("m01_user_reward_function", "SELECT case_id, CASE WHEN contains(response, 'boxed') THEN 1e0 ELSE 0e0 END AS score, CASE WHEN case_id % 9 = 0 THEN 1 ELSE 0 END AS is_filter FROM @responses".replace("CASE WHEN contains", "CASE WHEN case_id % 9 = 0 THEN 0e0 WHEN contains"))
def _(t: Tables):
    source = Path(__file__).with_name("example_reward.py")
    fn = M.python_reward(M.load_reward_function(str(source), "reward"))
    r = t.view("responses").withColumn("result", fn(F.col("kind"), F.col("response"), F.col("gold"), F.col("case_id")))
    return r.select("case_id", "result.score", "result.is_filter")


@query("m01_registered_reward", "SELECT case_id, CASE WHEN a = '' THEN 0e0 WHEN replace(a, ',', '') = gold THEN 1e0 ELSE 0e0 END AS score FROM (SELECT case_id, concat(CAST(problem_id AS STRING), '000') AS gold, regexp_extract(response, '#### (-?[0-9.,]+)', 1) AS a FROM @responses)")
def _(t: Tables):
    r = t.view("responses").withColumn("truth", F.concat(F.col("problem_id").cast("string"), F.lit("000")))
    return M.apply_reward(r, "hash", "kind", "response", "truth", "case_id").select("case_id", "result.score")


@query("m02_code_manager", "SELECT t.sol_id, CASE WHEN t.code <> '' AND coalesce(ok, true) THEN 1e0 ELSE 0e0 END AS score FROM @code_tasks t LEFT JOIN (SELECT sol_id, bool_and(passed) AS ok FROM (" + _JUDGED_SQL + ") GROUP BY 1) j ON t.sol_id = j.sol_id")
def _(t: Tables):
    return M.MANAGERS.get("code")(t.view("code_tasks"), "code", "truth", _runs(t), "sol_id").select("sol_id", "score")


@query("m02_math_manager", TRANSCRIPT_SQL)
def _(t: Tables):
    return M.MANAGERS.get("math")(t.view("responses"), "response", "gold").select("case_id", "score", "is_boxed_ratio", "valid_code")


_EXEC_SRC = f"SELECT traj_id * 1000 + turn AS case_id, CASE WHEN coded THEN right(stdout, 1000) ELSE '' END AS r FROM ({_OBS_SQL})"
_EXEC_ANS = f"SELECT case_id, s AS pred, CAST(CAST(floor(case_id / 1000) AS BIGINT) AS STRING) AS gold FROM ({normalise_sql(chain(_ladder_sql(_EXEC_SRC), *_LADDER_TAIL))})"


@query("m02_math_exec_manager", f"""SELECT traj_id, turn, CASE WHEN coded THEN 1 ELSE 0 END AS use_code, CASE WHEN coded AND stderr = '' THEN 1 ELSE 0 END AS true_tool_use,
CASE WHEN NOT equal THEN 0e0 WHEN coded AND stderr = '' THEN 1e0 ELSE 0.5e0 END AS score FROM ({_OBS_SQL}) o JOIN ({math_equal_sql(_EXEC_ANS)}) e ON e.case_id = o.traj_id * 1000 + o.turn""")
def _(t: Tables):
    turns = t.view("turns").withColumn("truth", F.col("traj_id").cast("string"))
    out = M.MANAGERS.get("math_exec")(turns, "text", "truth", t.view("exec_log"), ["traj_id", "turn"])
    return out.select("traj_id", "turn", "use_code", "true_tool_use", "score")


@query("m03_coerce_results", "SELECT c_custkey, c_acctbal AS score, CASE c_custkey % 3 WHEN 1 THEN 1 ELSE 0 END AS extras FROM customer")
def _(t: Tables):
    kind, score = F.col("c_custkey") % 3, F.col("c_acctbal").cast("string")
    result = F.when(kind == 0, score).when(
        kind == 1, F.concat(F.lit('{"score": '), score, F.lit(', "extra_info": {"a": 1}}'))).otherwise(F.concat(F.lit("["), score, F.lit(', "note"]')))
    got = t.table("customer").withColumn("r", M.coerce_column(result))
    return got.select("c_custkey", "r.score", F.size("r.extra_info").alias("extras"))


@query("m03_coerce_python_results", "SELECT c_custkey, c_acctbal AS score, CASE c_custkey % 3 WHEN 1 THEN 1 ELSE 0 END AS extras FROM customer")
def _(t: Tables):
    coerce = M.coerce_result

    def shard(pdf):
        kinds = {0: lambda v: v, 1: lambda v: {"score": v, "extra_info": {"a": 1}}, 2: lambda v: (v, "note")}
        got = [coerce(kinds[k % 3](v)) for k, v in zip(pdf["c_custkey"], pdf["c_acctbal"])]
        return pdf[["c_custkey"]].assign(score=[g["score"] for g in got], extras=[len(g["extra_info"]) for g in got])

    return M.map_shards(t.table("customer").select("c_custkey", "c_acctbal"), shard, "c_custkey bigint, score double, extras int")


@query("m04_map_shards", f"SELECT o_orderkey, {r6('o_totalprice / 2')} AS half FROM orders")
def _(t: Tables):
    out = M.map_shards(t.table("orders").select("o_orderkey", "o_totalprice"), lambda p: p.assign(half=p["o_totalprice"] / 2)[["o_orderkey", "half"]], "o_orderkey bigint, half double")
    return out.select("o_orderkey", F.round("half", 6).alias("half"))


@query("m07_observation_span_rows", "SELECT doc_id, CAST(2 AS BIGINT) AS spans, CAST(CASE WHEN doc_id % 4 <> 3 THEN 1 ELSE 0 END AS BIGINT) AS errors FROM documents")
def _(t: Tables):
    rows = M.observation_rows(_wrapped(t), "w", ["doc_id"])
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("spans"), F.count_if("has_error").alias("errors"))


@query("m05_group_function", "SELECT uid, line, part, supp, price, max(score) OVER w AS best, min(resp_len) OVER w AS shortest FROM @rollouts WINDOW w AS (PARTITION BY uid)")
def _(t: Tables):
    from ..operators.groups import attach_group_stats

    out = attach_group_stats(t.view("rollouts"), ["uid"], [F.max("score").alias("best"), F.min("resp_len").alias("shortest")])
    return out.select("uid", "line", "part", "supp", "price", "best", "shortest")


@query("m06_masked_aggregates", f"""WITH s AS (SELECT sum(old_lp * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS n FROM @tok)
SELECT {r6('any_value(s.mean)')} AS mean, {r6('sum(mask * (old_lp - s.mean) * (old_lp - s.mean)) / (any_value(s.n) + 1e-8) * any_value(s.n) / (any_value(s.n) - 1)', 8)} AS var, CAST(any_value(s.n) AS BIGINT) AS count FROM @tok t, s""")
def _(t: Tables):
    from ..operators.tokens import explode_tokens, masked_stats

    s = masked_stats(explode_tokens(t.sequences(), ["old_lp", "mask"], keep=()), "old_lp", "mask")
    return s.select(F.round("mean", 6).alias("mean"), F.round("var", 8).alias("var"), "count")
