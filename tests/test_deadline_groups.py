"""Groups with a deadline, held against one dictionary: many keys in a call, keys that repeat, and rows without a key."""

import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import pandas as pd
import pytest

from rollout_lake.streaming import processors as P
from rollout_lake.streaming import steps as L


class Kept:
    """A list state and the timers of one bucket; counts the calls."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], set(), 0

    def getListState(self, name, schema):
        return self

    def exists(self):
        self.calls += 1
        return bool(self.rows)

    def get(self):
        self.calls += 1
        return iter(self.rows)

    def put(self, rows):
        self.calls += 1
        self.rows = rows

    def clear(self):
        self.calls += 1
        self.rows = []

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


@pytest.mark.parametrize("keyed", [True, False])
def test_a_call_takes_many_keys(keyed):
    rng = random.Random(4)
    kept = Kept()
    processor = P.DeadlineGroups(3)
    processor.init(kept)
    key = (7,) if keyed else (P.BUCKETS,)
    issued = [rng.randrange(0, 1000) for _ in range(900)] if keyed else [500]
    got, want, state, now = Counter(), Counter(), defaultdict(lambda: (0, 0.0)), 0
    for step in range(12):
        rows = [(u, float(rng.randrange(9)), issued[u]) for u in (rng.randrange(len(issued)) for _ in range(400))]
        frame = pd.DataFrame(rows, columns=["uid", "score", "deadline"])
        if not keyed:
            frame["uid"] = None
        out = list(processor.handleInputRows(key, iter([frame[:150], frame[150:]]), SimpleNamespace(getCurrentWatermarkInMs=lambda: now)))
        for u, score, due in rows:
            if due < now:
                want["late", u, 1, score] += 1
                continue
            n, total = state.pop(u, (0, 0.0))
            if n == 2:
                want["complete", u, 3, total + score] += 1
            else:
                state[u] = (n + 1, total + score)
        now = step * 90
        while any(t < now for t in kept.timers):
            kept.timers.remove(min(kept.timers))
            out += processor.handleExpiredTimer(key, SimpleNamespace(getCurrentWatermarkInMs=lambda: now), None)
        for u in [u for u in state if issued[u] < now]:
            want["timeout", u, *state.pop(u)] += 1
        assert all(x["uid"].isna().all() for x in out) or keyed
        got += Counter((r.kind, r.uid if keyed else 0, r.n, r.total) for x in out for r in x.itertuples())
        assert len(kept.timers) == bool(state)
    assert got == want and {k for k, *_ in want} == ({"late", "complete", "timeout"} if keyed else {"late", "complete"} | {k for k, *_ in want})
    assert kept.calls < 12 * 12  # not a few for each of the 900 keys


def test_keys_share_buckets_in_a_stream(spark, tmp_path):
    rows = [(None if u == 0 else u, float(n), f"2024-01-01 0{u % 5}:00:00") for u in range(1500) for n in range(1 + u % 4)]
    df = spark.createDataFrame(rows, "uid long, score double, t string").selectExpr("uid", "score", "cast(t as timestamp) AS issued")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = P.groups_with_deadline(L.read_files(spark, str(tmp_path / "in"), df.schema), "uid", "score", "issued", 3, "2 hours")
    L.run_to_end(stream, str(tmp_path / "check"), path=str(tmp_path / "out"))
    got = Counter((r["kind"], r["uid"], r["n"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    want = Counter(("complete", u, 3) for u in range(1500) if u % 4 >= 2)
    want += Counter(("timeout", u or None, (1 + u % 4) % 3) for u in range(1500) if u % 4 != 2 and u % 5 < 2)
    assert got == want
