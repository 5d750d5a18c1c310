"""Reward managers by name: scored records from responses and recorded runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers as X
from ..functions.registry import MANAGERS, REWARDS, column_reward
from ..functions.text import output_tail
from . import scoring as S
from .advantage import tool_use_credit

REWARDS.add("boxed", column_reward(lambda source, solution, truth, extra: X.boxed_score(solution, truth)))
REWARDS.add("hash", column_reward(lambda source, solution, truth, extra: X.hash_score(solution, truth)))
REWARDS.add("think", column_reward(lambda source, solution, truth, extra: X.think_score(solution, truth)))
REWARDS.add("math", column_reward(lambda source, solution, truth, extra: S.transcript_score(solution, truth)["score"]))


def math_manager(df: DataFrame, response: str, truth: str) -> DataFrame:
    """Score, box and code flags of whole transcripts."""
    return df.withColumn("s", S.transcript_score(F.col(response), F.col(truth))).select(*df.columns, "s.*")


def math_exec_manager(df: DataFrame, response: str, truth: str, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Grade the tail of the recorded output; half credit when the tool was not really used."""
    used = S.tool_use(df, runs, keys, response)
    ran = F.when(F.col("use_code") == 1, output_tail(F.col("stdout")))
    solution = F.coalesce(ran, F.lit(""))
    graded = F.when(X.math_equal(X.extract_answer(solution, "math"), F.col(truth)), 1.0).otherwise(0.0)
    scored = used.withColumn("score", tool_use_credit(graded, F.col("true_tool_use")))
    return scored.select(*df.columns, "use_code", "no_bug_code", "true_tool_use", "score")


def code_manager(df: DataFrame, code: str, truth: str, runs: DataFrame, key: str) -> DataFrame:
    """All recorded tests of a solution must pass."""
    judged = S.judge_tests(S.expand_tests(df, key, code, truth), runs, key)
    return S.code_score(df, judged, key, code)


MANAGERS.add("math", math_manager)
MANAGERS.add("math_exec", math_exec_manager)
MANAGERS.add("code", code_manager)
