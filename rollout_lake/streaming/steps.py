"""The step loop as Structured Streaming jobs.

Every job takes a streaming frame and a place for its checkpoint. ``run_to_end``
drains the source with the available-now trigger; on a cluster the same writers run
with a processing-time trigger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ordering import seeded_index
from .processors import ROCKSDB


def read_files(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def run_to_end(stream: DataFrame, checkpoint: str, mode: str = "append", path: str | None = None, each: Callable | None = None) -> int:
    """Drain a stream into parquet files, or hand each micro-batch to ``each``; the rows of state left at the end."""
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark = stream.sparkSession
    before = spark.conf.get(provider)
    spark.conf.set(provider, ROCKSDB)  # the timers of keyed processors need it
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
    finally:
        spark.conf.set(provider, before)
    query.awaitTermination()
    last = query.lastProgress
    return sum(s["numRowsTotal"] for s in last["stateOperators"]) if last else 0


def score_records(stream: DataFrame, score, out_columns: list[str]) -> DataFrame:
    """Arriving rollout records with their score, ready for an append sink."""
    return stream.withColumn("score", score).select(*out_columns, "score")


def windowed_metrics(stream: DataFrame, time: str, keys: list[str], value: str, window: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Metric aggregates per tumbling or sliding window; rows later than ``delay`` are dropped."""
    w = F.window(time, window, slide) if slide else F.window(time, window)
    return stream.withWatermark(time, delay).groupBy(w, *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")
    ).select(F.col("window.start").alias("start"), *keys, "n", "total")


def upsert_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Sink for update mode: every batch appends its changed rows with the batch number.

    A batch that is repeated after a failure overwrites its own partition only.
    """
    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Last state of every key written by ``upsert_batches``."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return picked.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


GROUP_OUTPUT = "uid bigint, group_no bigint, n bigint, score_sum double"
GROUP_STATE = "seen bigint, groups bigint, score_sum double"


def complete_groups(stream: DataFrame, uid: str, score: str, samples: int, timeout_ms: int = 0) -> DataFrame:
    """One row whenever ``samples`` responses of a prompt are in.

    The state of a key is three numbers, whatever the number of its rows. With a timeout,
    a group that stays incomplete is emitted with the rows it has.
    """
    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, groups, total = state.get if state.exists else (0, 0, 0.0)
        out = []
        if state.hasTimedOut:
            if seen:
                out.append((key[0], groups, seen, total))
            state.remove()
        else:
            for pdf in batches:
                for value in pdf["score"]:
                    seen, total = seen + 1, total + float(value)
                    if seen == samples:
                        out.append((key[0], groups, seen, total))
                        seen, groups, total = 0, groups + 1, 0.0
            state.update((seen, groups, total))
            if timeout_ms:
                state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(out, columns=["uid", "group_no", "n", "score_sum"])

    wait = GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout
    return stream.select(F.col(uid).cast("bigint").alias("uid"), F.col(score).cast("double").alias("score")).groupBy(
        "uid"
    ).applyInPandasWithState(step, GROUP_OUTPUT, GROUP_STATE, "append", wait)


def session_trajectories(stream: DataFrame, time: str, key: str, gap: str, delay: str = "10 minutes") -> DataFrame:
    """Turns of a key that follow each other within ``gap`` make one trajectory.

    In append mode a trajectory is written once, when the watermark has passed its end, and leaves the state. Rows without a
    key are marks of time only.
    """
    w = F.session_window(time, gap)
    return stream.withWatermark(time, delay).where(F.col(key).isNotNull() | F.col(time).isNull()).groupBy(w, key).agg(
        F.count(F.lit(1)).alias("turns"), F.sum("use_code").alias("use_code"),
        F.min("no_void").alias("no_void"),
    ).select(key, F.col("session_window.start").alias("start"), "turns", "use_code", "no_void")


def not_yet_written(rows: DataFrame, written: DataFrame, keys: list[str]) -> DataFrame:
    """Rows a resumed run still has to process."""
    return rows.join(written.select(*keys).distinct(), keys, "left_anti")


def full_batches(carry_path: str, out_path: str, uid: str, batch_size: int, seed: int) -> Callable[[DataFrame, int], None]:
    """Emit whole batches of prompt groups; groups beyond the last full batch wait for the next one.

    Groups arrive complete, one row each. Ranks continue across micro-batches: the rows
    carried over come first.
    """
    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.withColumn("carried", F.lit(0))
        if number > 0:
            old = spark.read.parquet(f"{carry_path}/{number - 1}").withColumn("carried", F.lit(1))
            fresh = fresh.unionByName(old)
        ranked = seeded_index(fresh, [uid], seed, group_by=["carried"], out="place")
        held = fresh.agg(F.sum("carried").alias("c"), F.count(F.lit(1)).alias("n")).first()
        carried, total = int(held["c"] or 0), int(held["n"])
        place = F.when(F.col("carried") == 1, F.col("place")).otherwise(F.col("place") + carried)
        full = total // batch_size * batch_size
        placed = ranked.withColumn("place", place)
        emitted = placed.where(F.col("place") < full).withColumn("slot", F.floor(F.col("place") / batch_size))
        emitted.drop("carried", "place").write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        placed.where(F.col("place") >= full).drop("carried", "place").write.mode("overwrite").parquet(f"{carry_path}/{number}")

    return each
