"""Rollout-shaped views over the star-schema tables, in text that both engines read alike.

``VIEWS`` maps a name to (source table or view, select list, filter). ``expand``
replaces ``@name`` in a counterpart query by the same select as a subquery.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOXED = "concat(chr(92), 'boxed', chr(123))"
FENCE = "'```'"

VIEWS: dict[str, tuple[str, list[str], str | None]] = {
    # one row per sampled response of a prompt
    "rollouts": (
        "lineitem",
        [
            "l_orderkey AS uid",
            "CAST(l_linenumber AS BIGINT) AS line",
            "l_partkey AS part",
            "l_suppkey AS supp",
            "l_extendedprice AS price",
            "concat('set/', l_linestatus, '.parquet') AS data_source",
            "CASE WHEN l_returnflag = 'R' THEN 1e0 ELSE 0e0 END AS score",
            "CAST(l_quantity AS BIGINT) AS resp_len",
            "CAST(l_partkey % 64 + 1 AS BIGINT) AS prompt_len",
            "l_discount * 10e0 AS soft",
            "l_tax AS tax",
            "CAST(year(l_shipdate) AS BIGINT) AS step",
        ],
        None,
    ),
    # agent turns: some with code, some with an answer, some with neither
    "turns": (
        "conversations",
        [
            "conv_id AS traj_id",
            "turn",
            "role",
            "CASE WHEN turn % 4 = 1 THEN concat(text, chr(10), '```python', chr(10), 'print(', CAST(turn AS STRING), ')', "
            "chr(10), '# note', chr(10), chr(10), 'x = ', CAST(conv_id AS STRING), chr(10), '```', chr(10), 'after the code') "
            "WHEN turn % 4 = 3 AND conv_id % 3 = 0 THEN concat(text, chr(10), 'The answer is ', chr(92), 'boxed', chr(123), "
            "CAST(conv_id % 7 AS STRING), chr(125), '.') "
            "WHEN turn % 4 = 2 THEN concat('```', chr(10), 'y = ', CAST(turn AS STRING), chr(10), '```', chr(10), text) "
            "ELSE text END AS text",
        ],
        None,
    ),
    # what a recorded run of the turn's code gave back
    "exec_log": (
        "conversations",
        [
            "conv_id AS traj_id",
            "turn",
            "(conv_id + turn) % 5 <> 4 AS success",
            "CASE WHEN (conv_id + turn) % 5 = 0 THEN concat('value = ', CAST(turn * 7 AS STRING), chr(10)) "
            "WHEN (conv_id + turn) % 5 = 1 THEN concat(chr(92), 'boxed', chr(123), CAST(conv_id AS STRING), chr(125), chr(10)) "
            "WHEN (conv_id + turn) % 5 = 2 THEN text ELSE '' END AS stdout",
            "CASE WHEN (conv_id + turn) % 5 = 3 THEN concat('Traceback (most recent call last):', chr(10), '  File a.py', chr(10), "
            "'ValueError: bad value ', CAST(conv_id AS STRING)) ELSE '' END AS stderr",
        ],
        None,
    ),
    # answers as a model writes them, next to the reference answer
    "answers": (
        "orders",
        [
            "o_orderkey AS case_id",
            "o_custkey AS problem_id",
            "CASE o_orderkey % 24 "
            "WHEN 0 THEN concat('$', CAST(o_custkey AS STRING), '.50') "
            "WHEN 1 THEN concat(CAST(o_custkey % 97 AS STRING), chr(92), '%') "
            "WHEN 2 THEN concat(chr(92), 'frac', CAST(o_custkey % 9 + 1 AS STRING), CAST(o_orderkey % 7 + 1 AS STRING)) "
            "WHEN 3 THEN concat(chr(92), 'dfrac', chr(123), CAST(o_custkey % 9 AS STRING), chr(125), chr(123), '4', chr(125)) "
            "WHEN 4 THEN concat(CAST(o_custkey % 50 AS STRING), '/', CAST(o_orderkey % 50 + 1 AS STRING)) "
            "WHEN 5 THEN concat('x = ', CAST(o_custkey % 100 AS STRING)) "
            "WHEN 6 THEN concat('(', CAST(o_custkey % 10 AS STRING), ', ', CAST(o_orderkey % 10 AS STRING), ')') "
            "WHEN 7 THEN concat('[', CAST(o_custkey % 10 AS STRING), ',', CAST(o_orderkey % 10 AS STRING), ']') "
            "WHEN 8 THEN concat(CAST(o_custkey % 90 AS STRING), '^', chr(92), 'circ') "
            "WHEN 9 THEN concat(CAST(o_custkey % 30 AS STRING), ' ', chr(92), 'text', chr(123), ' cm', chr(125)) "
            "WHEN 10 THEN concat(chr(92), 'sqrt', CAST(o_custkey % 9 AS STRING), ' + 1') "
            "WHEN 11 THEN concat('.', CAST(o_custkey % 100 AS STRING)) "
            "WHEN 12 THEN concat(CAST(o_custkey % 12 AS STRING), ',', '345') "
            "WHEN 13 THEN concat(CAST(o_custkey % 12 AS STRING), ' hours') "
            "WHEN 14 THEN concat(CAST(o_custkey % 100 AS STRING), '.000') "
            "WHEN 15 THEN CASE o_custkey % 5 WHEN 0 THEN 'twelve' WHEN 1 THEN 'three hundred' WHEN 2 THEN 'twenty one' WHEN 3 THEN 'two thousand five' ELSE 'zero' END "
            "WHEN 16 THEN concat(chr(92), 'begin', chr(123), 'pmatrix', chr(125), CAST(o_custkey % 5 AS STRING), ' & 1', chr(92), chr(92), '2 & ', "
            "CAST(o_orderkey % 5 AS STRING), chr(92), 'end', chr(123), 'pmatrix', chr(125)) "
            "WHEN 17 THEN concat(chr(92), 'text', chr(123), 'Tuesday', chr(125)) "
            "WHEN 18 THEN concat('(', substr('ABCDE', CAST(o_custkey % 5 + 1 AS INT), 1), ')') "
            "WHEN 19 THEN concat('-', CAST(o_custkey % 100 AS STRING), '.', CAST(o_orderkey % 1000 AS STRING)) "
            "WHEN 20 THEN concat(chr(92), 'left(-', chr(92), 'infty, ', CAST(o_custkey % 10 AS STRING), chr(92), 'right)') "
            "WHEN 21 THEN concat(CAST(o_custkey % 8 AS STRING), ' ', CAST(o_custkey % 3 + 1 AS STRING), '/4') "
            "WHEN 22 THEN '0.5' "
            "ELSE concat(CAST(o_custkey % 20 AS STRING), ' million') END AS pred",
            "CASE o_orderkey % 24 "
            "WHEN 0 THEN concat(CAST(o_custkey AS STRING), '.5') "
            "WHEN 1 THEN concat('0.', CAST(o_custkey % 97 AS STRING)) "
            "WHEN 2 THEN concat(CAST(o_custkey % 9 + 1 AS STRING), '/', CAST(o_orderkey % 7 + 1 AS STRING)) "
            "WHEN 3 THEN concat(chr(92), 'frac', chr(123), CAST(o_custkey % 8 AS STRING), chr(125), chr(123), '4', chr(125)) "
            "WHEN 4 THEN concat(chr(92), 'frac', chr(123), CAST(o_custkey % 50 AS STRING), chr(125), chr(123), CAST(o_orderkey % 50 + 1 AS STRING), chr(125)) "
            "WHEN 5 THEN CAST(o_custkey % 99 AS STRING) "
            "WHEN 6 THEN concat('(', CAST(o_custkey % 10 AS STRING), ',', CAST(o_orderkey % 9 AS STRING), ')') "
            "WHEN 7 THEN concat('[', CAST(o_custkey % 10 AS STRING), '.0,', CAST(o_orderkey % 10 AS STRING), ']') "
            "WHEN 8 THEN CAST(o_custkey % 90 AS STRING) "
            "WHEN 9 THEN CAST(o_custkey % 30 AS STRING) "
            "WHEN 10 THEN concat(chr(92), 'sqrt', chr(123), CAST(o_custkey % 9 AS STRING), chr(125), '+1') "
            "WHEN 11 THEN concat('0.', CAST(o_custkey % 100 AS STRING)) "
            "WHEN 12 THEN concat(CAST(o_custkey % 12 AS STRING), '345') "
            "WHEN 13 THEN CAST(o_custkey % 11 AS STRING) "
            "WHEN 14 THEN CAST(o_custkey % 100 AS STRING) "
            "WHEN 15 THEN CASE o_custkey % 5 WHEN 0 THEN '12' WHEN 1 THEN '300' WHEN 2 THEN '21' WHEN 3 THEN '2005' ELSE '1' END "
            "WHEN 16 THEN concat(chr(92), 'begin', chr(123), 'pmatrix', chr(125), CAST(o_custkey % 4 AS STRING), ' & 1.0', chr(92), chr(92), '2 & ', "
            "CAST(o_orderkey % 5 AS STRING), chr(92), 'end', chr(123), 'pmatrix', chr(125)) "
            "WHEN 17 THEN 'tuesday' "
            "WHEN 18 THEN substr('ABCDE', CAST(o_custkey % 4 + 1 AS INT), 1) "
            "WHEN 19 THEN concat('-', CAST(o_custkey % 100 AS STRING), '.', CAST(o_orderkey % 1000 + 1 AS STRING)) "
            "WHEN 20 THEN concat('(-', chr(92), 'infty,', CAST(o_custkey % 10 AS STRING), ')') "
            "WHEN 21 THEN concat(CAST(o_custkey % 8 AS STRING), '+', CAST(o_custkey % 3 + 1 AS STRING), '/4') "
            "WHEN 22 THEN concat(chr(92), 'frac', chr(123), '1', chr(125), chr(123), '2', chr(125)) "
            "ELSE concat(CAST(o_custkey % 20 AS STRING), '*10^6') END AS gold",
            "o_totalprice AS price",
            "o_orderpriority AS kind",
        ],
        None,
    ),
    # whole responses around those answers
    "responses": (
        "answers",
        [
            "case_id",
            "problem_id",
            "gold",
            "pred",
            "kind",
            "CASE case_id % 8 "
            "WHEN 0 THEN concat('We get ', chr(92), 'boxed', chr(123), pred, chr(125), ' as asked.') "
            "WHEN 1 THEN concat('So the final answer is $', pred, '$. I hope it is correct.') "
            "WHEN 2 THEN concat('Adding up, the answer is ', pred, '.') "
            "WHEN 3 THEN concat('First ', CAST(case_id % 100 AS STRING), ' then -', CAST(problem_id % 100 AS STRING), '.25 and that is all') "
            "WHEN 4 THEN concat('Work it out', chr(10), '#### ', CAST(problem_id AS STRING), ',000', chr(10)) "
            "WHEN 5 THEN concat('<think>', kind, '</think> so ', chr(92), 'boxed', chr(123), 'a', chr(125), ' no, ', chr(92), 'boxed', chr(123), pred, chr(125)) "
            "WHEN 6 THEN concat('The choice is (', substr('ABCDE', CAST(problem_id % 5 + 1 AS INT), 1), '). Done') "
            "ELSE concat('```python', chr(10), 'print(', CAST(problem_id AS STRING), ')', chr(10), '```', chr(10), 'Code execution result: ', "
            "CAST(problem_id AS STRING), chr(10), chr(92), 'boxed', chr(123), CAST(problem_id AS STRING), chr(125), '<|im_end|>tail') END AS response",
        ],
        None,
    ),
    # code solutions with their tests as JSON text, in the three layouts
    "code_tasks": (
        "customer",
        [
            "c_custkey AS sol_id",
            "CASE WHEN c_custkey % 11 = 0 THEN '' ELSE concat('class Solution: pass  # ', c_name) END AS code",
            "CASE c_custkey % 3 WHEN 0 THEN concat('[{\"testtype\":\"stdin\",\"input\":\"1\",\"output\":\"', CAST(c_custkey AS STRING), "
            "'\"},{\"testtype\":\"functional\",\"input\":\"[1,2]', chr(92), chr(92), 'n 3\",\"output\":\"7\",\"metadata\":{\"func_name\":\"solve\"}}]') "
            "WHEN 1 THEN '{\"functional\":\"assert f(1) == 2\"}' "
            "ELSE concat('{\"inputs\":[\"1\",\"2\",\"3\"],\"outputs\":[\"', CAST(c_custkey AS STRING), '\",\"5\",\"6\"],\"fn_name\":\"go\"}') END AS truth",
            "c_acctbal AS balance",
            "c_mktsegment AS segment",
        ],
        None,
    ),
    # recorded runs: one row per solution, the tests are the slots 0 to 2
    "code_runs": (
        "customer",
        [
            "c_custkey AS sol_id",
            "CASE WHEN c_custkey % 5 = 0 THEN 'wrong' ELSE concat(' ', CAST(c_custkey AS STRING), chr(10)) END AS out0",
            "CASE WHEN c_custkey % 5 = 1 THEN 'wrong' WHEN c_custkey % 3 = 0 THEN concat('7', chr(10)) ELSE '5' END AS out1",
            "CASE WHEN c_custkey % 5 = 2 THEN 'wrong' ELSE '6' END AS out2",
            "CASE WHEN c_custkey % 7 = 0 THEN 'Error' ELSE '' END AS err0",
            "CASE WHEN c_custkey % 7 = 1 THEN 'Error' ELSE '' END AS err1",
            "CASE WHEN c_custkey % 7 = 2 THEN 'Error' ELSE '' END AS err2",
        ],
        None,
    ),
}

HEAVY = ("answers",)
"""Views whose rows feed long text expressions."""

# one row per token of a logged sequence, for the counterpart queries
TOKENS_SQL = (
    "SELECT *, old_lp - 9e-1 * e + (seq_id * 7 + pos * 11) % 23 / 2e3 AS rollout_lp, "
    "old_lp + ((seq_id * 31 + pos * 17) % 41 - 20) / 1e2 AS new_lp, "
    "old_lp + ((seq_id * 13 + pos * 7) % 31 - 15) / 2e2 AS ref_lp, mask * info AS loss_mask FROM ("
    "SELECT vec_id AS seq_id, CAST(label AS BIGINT) AS uid, CAST(i - 1 AS BIGINT) AS pos, CAST(embedding[i] AS DOUBLE) AS e, "
    "-abs(CAST(embedding[i] AS DOUBLE)) AS old_lp, CAST(len(embedding) AS BIGINT) AS width, "
    "CASE WHEN i - 1 < 16 + vec_id % 49 THEN 1 ELSE 0 END AS mask, "
    "CASE WHEN (i - 1) % 9 IN (6, 7) THEN 0 ELSE 1 END AS info, "
    "CASE WHEN (i - 1) % 9 = 7 THEN 1 ELSE 0 END AS turn_end, "
    "(vec_id % 5 - 2) * 5e-1 AS adv, "
    "CASE WHEN vec_id % 6 = 0 THEN 0 ELSE 1 END AS void_ok, "
    "CASE WHEN vec_id % 3 = 0 THEN 1e0 ELSE 0e0 END AS score "
    "FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
)


def sequences(embeddings: DataFrame) -> DataFrame:
    """One row per logged sequence; every token stream is an array of the same length."""
    base = embeddings.select(
        F.col("vec_id").alias("seq_id"),
        F.col("label").cast("bigint").alias("uid"),
        F.transform("embedding", lambda x: x.cast("double")).alias("e"),
    )
    seq = F.col("seq_id")

    def stream(fn):
        return F.transform("e", lambda x, i: fn(x, i.cast("bigint")))

    def drift(a: int, b: int, m: int):
        return lambda i: (seq * a + i * b) % m

    jitter, move, ref = drift(7, 11, 23), drift(31, 17, 41), drift(13, 7, 31)
    return base.select(
        "seq_id",
        "uid",
        "e",
        stream(lambda x, i: -F.abs(x)).alias("old_lp"),
        stream(lambda x, i: -F.abs(x) - x * F.lit(0.9) + jitter(i) / F.lit(2000.0)).alias("rollout_lp"),
        stream(lambda x, i: -F.abs(x) + (move(i) - 20) / F.lit(100.0)).alias("new_lp"),
        stream(lambda x, i: -F.abs(x) + (ref(i) - 15) / F.lit(200.0)).alias("ref_lp"),
        stream(lambda x, i: F.when(i < 16 + seq % 49, 1).otherwise(0)).alias("mask"),
        stream(lambda x, i: F.when((i % 9).isin(6, 7), 0).otherwise(1)).alias("info"),
        stream(lambda x, i: F.when(i % 9 == 7, 1).otherwise(0)).alias("turn_end"),
        ((seq % 5 - 2) * F.lit(0.5)).alias("adv"),
        F.when(seq % 6 == 0, 0).otherwise(1).alias("void_ok"),
        F.when(seq % 3 == 0, 1.0).otherwise(0.0).alias("score"),
    ).withColumn("loss_mask", F.zip_with("mask", "info", lambda a, b: a * b))


def view_sql(name: str) -> str:
    """The view as SQL text over the base tables."""
    if name == "tok":
        return TOKENS_SQL
    source, exprs, where = VIEWS[name]
    inner = f"({view_sql(source)})" if source in VIEWS else source
    text = f"SELECT {', '.join(exprs)} FROM {inner}"
    return f"{text} WHERE {where}" if where else text


def expand(sql: str) -> str:
    """Replace every ``@view`` in the text by its select as a subquery."""
    return re.sub(r"@(\w+)", lambda m: f"({view_sql(m.group(1))})", sql)
