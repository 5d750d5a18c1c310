"""Turn tables: roll-ups, transcripts, rolling context."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions import text as T
from .ordering import running_total

TURNS_PER_CHUNK = 256


NO_TOOL_PROMPT = "\n"
"""What the agent sees after a turn with neither an answer nor code (fixed value)."""


def classify_turns(
    turns: DataFrame, runs: DataFrame, keys: Sequence[str], text: str, active: str, stop_on_void: bool = True,
    no_tool_prompt: str = NO_TOOL_PROMPT,
) -> DataFrame:
    """Classify every turn and join the recorded run of its code.

    A boxed answer in the run's output ends the trajectory as well. A void turn's observation is the prompt to
    use a tool; answers and inactive turns have none.
    """
    staged = turns.withColumn("__c", T.classify_turn(F.col(text), F.col(active), stop_on_void))
    flat = staged.select(*turns.columns, "__c.*")
    ran = runs.select(*keys, "success", "stdout", "stderr")
    joined = flat.join(ran, list(keys), "left")
    used = F.col("use_code") == 1
    flags = T.run_flags(F.col("stdout"), F.col("stderr"))
    return joined.withColumn("__f", flags).withColumns({
        "valid_code": F.when(used, F.coalesce(F.col("__f.valid_code"), F.lit(0))).otherwise(0),
        "done": F.col("done") | (used & F.coalesce(F.col("__f.answered"), F.lit(False))),
        "observation": F.when(used, T.observation(F.col("success"), F.col("stdout"), F.col("stderr"))).when(
            F.col("is_void"), F.lit(no_tool_prompt)),
    }).drop("__f")


def roll_up(turns: DataFrame, traj: str = "traj_id") -> DataFrame:
    """Per trajectory: turns, code uses, valid runs, still active, free of void turns."""
    return turns.groupBy(traj).agg(
        F.count(F.lit(1)).alias("turns"),
        F.sum("use_code").alias("use_code"),
        F.sum("valid_code").alias("valid_code"),
        F.bool_and(~F.col("done")).alias("active"),
        F.bool_and(~F.col("is_void")).alias("no_void"),
    )


def active_per_turn(turns: DataFrame, turn: str = "turn") -> DataFrame:
    """Trajectories still active after each turn."""
    return turns.groupBy(turn).agg(F.count_if(~F.col("done")).alias("active"), F.count(F.lit(1)).alias("trajectories"))


def code_line_metrics(turns: DataFrame, code: str = "code") -> DataFrame:
    """Mean line counts of successful and failed code, all lines and real lines."""
    counted = turns.where(F.col("use_code") == 1).withColumn("n", T.count_lines(F.col(code)))
    ok, bad = F.col("valid_code") == 1, F.coalesce(F.col("stderr"), F.lit("")) != ""
    return counted.agg(
        F.avg(F.when(ok, F.col("n.total_lines"))).alias("success_code_lines"),
        F.avg(F.when(bad, F.col("n.total_lines"))).alias("fail_code_lines"),
        F.avg(F.when(ok, F.col("n.code_lines"))).alias("success_code_strip_lines"),
        F.avg(F.when(bad, F.col("n.code_lines"))).alias("fail_code_strip_lines"),
    )


def _offsets(df: DataFrame, traj: str, turn: str) -> DataFrame:
    """Tokens of the trajectory up to and before each turn (``n_tokens`` counts the turn's own)."""
    run = running_total(
        df, F.col("n_tokens"), [turn], F.floor(F.col(turn) / TURNS_PER_CHUNK), group_by=[traj], out="until"
    )
    return run.withColumn("before", F.col("until") - F.col("n_tokens"))


def assemble(
    turns: DataFrame, ids: str, log_probs: str, info: str, max_length: int, traj: str = "traj_id", turn: str = "turn"
) -> DataFrame:
    """Transcript of every trajectory with its parallel mask and log-prob streams.

    Tool output has mask 0 and log-prob -1. Only turns that start below the cap reach
    the per-trajectory collection, so it holds at most ``max_length`` turns.
    """
    def token(i, m, lp):
        return F.struct(i.alias("id"), m.alias("mask"), lp.cast("double").alias("logp"))

    said = F.zip_with(ids, log_probs, lambda i, lp: token(i, F.lit(1), lp))
    seen = F.transform(info, lambda i: token(i, F.lit(0), F.lit(-1.0)))
    parts = turns.select(traj, turn, F.concat(said, seen).alias("part")).withColumn("n_tokens", F.size("part").cast("bigint"))
    bounded = _offsets(parts.where("n_tokens > 0"), traj, turn).where(F.col("before") < max_length)
    ordered = bounded.groupBy(traj).agg(F.sort_array(F.collect_list(F.struct(turn, "part"))).alias("p"))
    stream = A.keep_first(F.flatten(F.transform("p", lambda p: p["part"])), F.lit(max_length))
    return ordered.select(traj, stream.alias("s")).select(
        traj, F.col("s.id").alias("ids"), F.col("s.mask").alias("info_mask"), F.col("s.logp").alias("log_probs")
    )


def rolling_context(turns: DataFrame, prompt_tokens: str, max_prompt_length: int, traj: str = "traj_id", turn: str = "turn") -> DataFrame:
    """Token range of the transcript each turn sees: the last ``max_prompt_length`` before it.

    ``prompt_tokens`` is the length of the prompt in front of the first turn.
    """
    placed = _offsets(turns, traj, turn)
    end = F.col("before") + F.col(prompt_tokens)
    start = F.greatest(end - max_prompt_length, F.lit(0))
    return placed.withColumns({"context_start": start, "context_end": end})


def cap_observation(info, max_length: int):
    """First ``max_length`` tokens of an observation and whether it was longer."""
    return F.struct(A.keep_first(info, F.lit(max_length)).alias("ids"), (F.size(info) > max_length).alias("was_cut"))
