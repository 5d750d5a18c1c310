"""Keyed state with event-time timers: groups with a deadline, and a coefficient that follows steps in order.

The state lies in RocksDB; a key's state is removed as soon as it has been emitted, so what is kept is what is
still open. ``with_closing_mark`` ends a finite stream: behind its mark every window and timer is due.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

GROUP_ROWS = "kind string, uid bigint, n bigint, total double"


BUCKETS = 256
"""Parts by a hash of their keys that groups with a deadline are kept in; each start of a checkpoint must have the same."""


class DeadlineGroups(StatefulProcessor):
    """``samples`` rows of a key make a group; what is in when the watermark passes the key's time is a group, too.

    A call of Python or of the state costs more than a group's few rows, so a call sees a bucket of many keys: its rows come in
    batches of bounded size and are added up by key with NumPy. Its open groups are a list, whose earliest deadline has the only timer.

    A row that comes behind its deadline is emitted as ``late``.
    """

    def __init__(self, samples: int):
        self.samples = samples

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "uid bigint, n bigint, total double, due bigint")

    def _held(self) -> pd.DataFrame:
        rows = list(self.open.get()) if self.open.exists() else []
        kinds = {"uid": "int64", "n": "int64", "total": "float64", "due": "int64"}
        return pd.DataFrame(rows, columns=[*kinds]).astype(kinds)

    def _hold(self, rows: pd.DataFrame) -> None:
        if len(rows):
            self.open.put([(int(u), int(n), float(t), int(d)) for u, n, t, d in rows.itertuples(index=False)])
            self.handle.registerTimer(int(rows["due"].min()))
        else:
            self.open.clear()

    def _added(self, rows: pd.DataFrame) -> pd.DataFrame:
        """Groups of ``samples`` rows of a key and what is left of it, from open groups and the rows behind them."""
        rows = rows.iloc[np.argsort(rows["uid"].to_numpy(), kind="stable")]
        uid, n = rows["uid"].to_numpy(), rows["n"].to_numpy()
        key = np.r_[True, uid[1:] != uid[:-1]]
        seen = np.cumsum(n)
        ahead = (seen - n)[key][np.cumsum(key) - 1]
        group = (seen - ahead - 1) // self.samples
        first = np.flatnonzero(key | np.r_[True, group[1:] != group[:-1]])
        return pd.DataFrame({
            "uid": uid[first], "n": np.add.reduceat(n, first), "total": np.add.reduceat(rows["total"].to_numpy(), first),
            "due": np.minimum.reduceat(rows["due"].to_numpy(), first),
        })

    def _out(self, key, kind: str, rows: pd.DataFrame) -> pd.DataFrame:
        out = rows[["uid", "n", "total"]].assign(kind=kind)[["kind", "uid", "n", "total"]]
        return out.assign(uid=pd.array([None] * len(out), "Int64") if key[0] == BUCKETS else out["uid"].astype("Int64"))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = self._held()
        timer = int(held["due"].min()) if len(held) else None
        for batch in rows:
            if batch["deadline"].isna().any():
                raise ValueError("a row has no time")
            uid = 0 if key[0] == BUCKETS else batch["uid"].astype("int64")  # rows without a key are a bucket of their own
            fresh = pd.DataFrame({"uid": uid, "n": 1, "total": batch["score"].astype("float64"), "due": batch["deadline"].astype("int64")})
            late = fresh["due"] < now
            if late.any():
                yield self._out(key, "late", fresh[late])
            if not late.all():
                found = self._added(pd.concat([held, fresh[~late]]))
                whole = found["n"] == self.samples
                yield self._out(key, "complete", found[whole])
                held = found[~whole]
        if timer is not None:
            self.handle.deleteTimer(timer)
        self._hold(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        due = held["due"] < timerValues.getCurrentWatermarkInMs()
        self._hold(held[~due])
        yield self._out(key, "timeout", held[due])

    def close(self) -> None:
        pass


def groups_with_deadline(stream: DataFrame, uid: str, score: str, issued: str, samples: int, wait: str) -> DataFrame:
    """``kind, uid, n, total``: groups that are complete, those whose deadline passed first, and late rows.

    All rows of a group carry the time it was ``issued``. Its deadline is the moment when rows issued ``wait`` later are in.
    Each row is in exactly one emitted group or late, unless its group is still open at the end. A row's
    time must not be null.

    The watermark is taken from marks, rows without a value, because Spark drops late rows of an event-time
    column before a processor sees them. Marks go no further.
    """
    rows = stream.select(
        F.col(uid).cast("bigint").alias("uid"), F.col(score).cast("double").alias("score"),
        F.unix_millis(issued).alias("deadline"), F.col(issued).alias("at"),
    ).withColumn("tick", F.explode(F.array(F.lit(None).cast("timestamp"), F.col("at"))))
    clocked = rows.select("uid", "score", "deadline", "tick").withWatermark("tick", wait).where("tick is null")
    bucket = F.when(F.col("uid").isNull(), BUCKETS).otherwise(F.pmod(F.xxhash64("uid"), F.lit(BUCKETS)))
    return clocked.withColumn("bucket", bucket).groupBy("bucket").transformWithStateInPandas(
        DeadlineGroups(samples), GROUP_ROWS, "Append", "EventTime")


COEFFICIENTS = "run string, step bigint, n bigint, kl double, kl_coef double"


class OrderedCoefficient(StatefulProcessor):
    """The adaptive KL coefficient of a run, step by step in order, whatever the order of arrival.

    Open steps are kept as sums and released in order once the watermark has passed their end.
    """

    def __init__(self, init: float, target: float, horizon: float, clip: float = 0.2):
        self.start, self.target, self.horizon, self.clip = init, target, horizon, clip

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "ends bigint", "step bigint, n bigint, total double")
        self.value = handle.getValueState("value", "kl_coef double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for (step, ends), part in batch.groupby(["step", "ends"]):
                n, total, at = int(part["n"].sum()), float(part["total"].sum()), (int(ends),)
                if self.steps.containsKey(at):
                    _, had_n, had_total = self.steps.getValue(at)
                    n, total = n + had_n, total + had_total
                else:
                    self.handle.registerTimer(at[0])
                self.steps.updateValue(at, (int(step), n, total))
        yield pd.DataFrame([], columns=["run", "step", "n", "kl", "kl_coef"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.steps.containsKey((expiredTimerInfo.getExpiryTimeInMs(),)):
            return  # released with an earlier step
        now = timerValues.getCurrentWatermarkInMs()
        value = self.value.get()[0] if self.value.exists() else self.start
        out = []
        for ends, step, n, total in sorted((k[0], *v) for k, v in self.steps.iterator() if k[0] <= now):
            error = min(max(total / n / self.target - 1, -self.clip), self.clip)
            value *= 1 + error * n / self.horizon
            out.append((key[0], step, n, total / n, value))
            self.steps.removeKey((ends,))
        if out:
            self.value.update((value,))
        yield pd.DataFrame(out, columns=["run", "step", "n", "kl", "kl_coef"])

    def close(self) -> None:
        pass


def _step_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        sums = batch.groupby(["run", "step", "ends"], dropna=False).agg(n=("kl", "size"), total=("kl", "sum"), at=("at", "max"))
        sums = sums.reset_index()
        sums["run"] = sums["run"].astype(object).where(sums["run"].notna(), None)
        yield sums.astype({"step": "Int64", "ends": "Int64"})


def ordered_coefficients(stream: DataFrame, run: str, step: str, kl: str, time: str, ends: Column, delay: str,
                         init: float, target: float, horizon: float) -> DataFrame:
    """``run, step, n, kl, kl_coef``: the coefficient after each step, once no row of the step can come any more.

    ``ends`` is when a step is over, in milliseconds. Rows are summed up by step within each task first, so what reaches
    a run's state is a few sums for each batch. Rows later than ``delay`` are dropped. Rows of a null run are marks of time only.
    """
    rows = stream.select(F.col(run).cast("string").alias("run"), F.col(step).cast("bigint").alias("step"), ends.cast("bigint").alias("ends"),
                         F.col(kl).cast("double").alias("kl"), F.col(time).alias("at"))
    sums = rows.mapInPandas(_step_sums, "run string, step bigint, ends bigint, n bigint, total double, at timestamp")
    open_steps = sums.withWatermark("at", delay).where("run is not null or at is null")
    return open_steps.groupBy("run").transformWithStateInPandas(
        OrderedCoefficient(init, target, horizon), COEFFICIENTS, "Append", "EventTime")


def with_closing_mark(spark, folder: str, rows: DataFrame, time: str, after: str) -> None:
    """Write the end of a finite stream into its folder: one row, null but for a time ``after`` the last of ``rows``."""
    last = rows.agg(F.max(time).alias("t")).select((F.col("t") + F.expr(f"INTERVAL {after}")).alias("t"))
    columns = [F.col("t").alias(f.name) if f.name == time else F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema.fields]
    last.select(*columns).write.mode("append").parquet(folder)
