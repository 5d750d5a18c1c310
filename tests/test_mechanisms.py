"""Packing, permutations, selection, scans, interval joins, digests, step records and keyed streams against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollout_lake.functions import arrays as A
from rollout_lake.operators import batch as C
from rollout_lake.operators import intervals as I
from rollout_lake.operators import ordering as O
from rollout_lake.operators import packing as K
from rollout_lake.operators import scans as N
from rollout_lake.operators.quantiles import exact_quantiles
from rollout_lake.sources import steps as Z
from rollout_lake.streaming import processors as P
from rollout_lake.streaming import steps as L


def brute_first_fit(samples, capacity):
    rooms, out = [], {}
    for i, n in sorted(samples, key=lambda s: (-s[1], s[0])):
        at = next((p for p, room in enumerate(rooms) if room >= n), len(rooms))
        if at == len(rooms):
            rooms.append(capacity)
        rooms[at] -= n
        out[i] = at
    return out


@pytest.mark.parametrize("seed", range(6))
def test_first_fit(spark, seed):
    rng = random.Random(seed)
    top = rng.choice([3, 10, 60, 100])
    samples = [(i, rng.randrange(0 if seed else 1, top + 1)) for i in range(800)]
    df = spark.createDataFrame([(i, n, i % 2) for i, n in samples], "id long, len long, s int").repartition(3)
    got = K.pack_first_fit(df, "id", "len", 100, F.col("s")).collect()
    assert len(got) == len(samples)
    for s in (0, 1):
        own = [x for x in samples if x[0] % 2 == s]
        assert {r["id"]: r["partition"] for r in got if r["shard"] == s} == brute_first_fit(own, 100)
    if seed == 1:
        def packs(rows):
            return len({(r["shard"], r["partition"]) for r in rows})
        assert packs(got) <= packs(K.pack_samples(df, "id", "len", 100, F.col("s")).collect())
        with pytest.raises(Exception, match="exceeds the capacity"):
            K.pack_first_fit(df, "id", "len", 2, F.col("s")).collect()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 99_991])
def test_permutation_is_a_bijection(spark, n):
    places = [r["p"] for r in spark.range(n).select(O.permuted(F.col("id"), n, 7).alias("p")).collect()]
    assert sorted(places) == list(range(n))
    if n >= 1000:
        other = [r["p"] for r in spark.range(n).select(O.permuted(F.col("id"), n, 8).alias("p")).collect()]
        assert sum(a == b for a, b in zip(places, other)) < 20 and sum(i == p for i, p in enumerate(places)) < 20
        plan = spark.range(n).select(O.permuted(F.col("id"), n, 7))._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Sort" not in plan


@pytest.mark.parametrize("kind", ["normal", "ties", "tiny", "wide", "one"])
def test_radix_quantiles(spark, kind):
    rng = np.random.default_rng(4)
    values = {
        "normal": rng.standard_normal(30_000), "ties": rng.integers(-3, 3, 30_000).astype(float), "tiny": np.array([-1.5, 0.0, -0.0, 7.25]),
        "wide": np.concatenate([-np.exp(rng.uniform(-600, 600, 70_000)), np.exp(rng.uniform(-600, 600, 70_000))]), "one": np.array([5.0]),
    }[kind]
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double").repartition(4)
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    got = exact_quantiles(df, "v", probs, [f"q{i}" for i in range(7)]).first()
    assert list(got) == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)
    assert list(exact_quantiles(df.limit(0), "v", [0.5], ["m"]).first()) == [None]


def test_scan_over_long_sequences(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for seq, n in ((0, 1), (1, 15), (2, 16), (3, 300), (4, 4097)):
        a, b = [rng.uniform(-1, 1) for _ in range(n)], [rng.uniform(-2, 2) for _ in range(n)]
        y = 0.0
        for t in reversed(range(n)):
            y = b[t] + a[t] * y
            want[seq, t] = y
        rows += [(seq, t, a[t], b[t]) for t in range(n)]
    df = spark.createDataFrame(rows, "seq long, pos long, a double, b double").repartition(5)
    for chunk in (16, 4096):
        got = {(r["seq"], r["pos"]): r["y"] for r in N.backward_scan(df, "seq", "pos", F.col("a"), F.col("b"), "y", chunk).collect()}
        assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], rel_tol=1e-9, abs_tol=1e-9) for k in want)
        ahead = {(r["seq"], r["pos"]): r["v"] for r in N.following(df, "seq", "pos", "b", "v", chunk).collect()}
        values = {(s, p): b for s, p, _, b in rows}
        assert all(ahead[s, p] == values.get((s, p + 1), 0.0) for s, p in want)


def test_next_event_and_covering_spans(spark):
    rng = random.Random(6)
    rows = [(i, 0 if i % 3 else i % 11, rng.randrange(0, 40) if i % 3 else rng.randrange(0, 3000)) for i in range(3000)]
    events = [(rng.randrange(0, 11), rng.randrange(0, 3000)) for _ in range(60)]
    spans = [(rng.randrange(0, 11), s, s + rng.choice([0, 1, 5, 900]), f"s{i}") for i, s in enumerate(rng.randrange(0, 3000) for _ in range(80))]
    df = spark.createDataFrame(rows + [(9001, None, 5), (9002, 1, None)], "id long, k long, at long")
    ev = spark.createDataFrame(events + events[:3], "k long, e long")
    got = {r["id"]: r["nx"] for r in I.next_at_or_after(df, ev, ["k"], "at", "e", "nx", 64).collect()}
    assert got.pop(9001) is None and got.pop(9002) is None
    assert got == {i: min((e for g, e in events if g == k and e >= at), default=None) for i, k, at in rows}
    sp = spark.createDataFrame(spans, "k long, s long, t long, name string")
    met = Counter((r["id"], r["name"]) for r in I.covering_spans(df, sp, ["k"], "at", "s", "t", 64).collect())
    assert met == Counter((i, n) for i, k, at in rows for g, s, t, n in spans if g == k and s <= at < t)


def test_first_rows_of_a_hot_group(spark):
    df = spark.range(60_000).select(F.col("id"), F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 7).alias("g"), F.md5(F.col("id").cast("string")).alias("d"))
    got = O.first_rows(df, ["g"], [F.col("d"), F.col("id")], 5000, "rank", salts=8).collect()
    groups = defaultdict(list)
    for r in df.collect():
        groups[r["g"]].append((r["d"], r["id"]))
    want = {(g, i, n + 1) for g, rows in groups.items() for n, (_, i) in enumerate(sorted(rows)[:5000])}
    assert {(r["g"], r["id"], r["rank"]) for r in got} == want


def test_column_digests(spark):
    base = [(i, float(i % 5), None if i % 4 else "x") for i in range(500)]
    make = lambda rows: spark.createDataFrame(rows, "id long, a double, b string").repartition(4)

    def differing(rows):
        return {r["column"] for r in C.differing_columns(make(base), make(rows), "id").collect() if not r["equal"]}

    assert differing(base[::-1]) == set()
    assert differing([(0, 9.0, "x"), *base[1:]]) == {"a"}
    assert differing([(0, 0.0, None), *base[1:]]) == {"b"}
    assert differing([*base, base[7]]) == {"id", "a", "b"} and differing(base[1:]) == {"id", "a", "b"}
    swapped = [(0, *base[1][1:]), (1, *base[0][1:]), *base[2:]]
    assert differing(swapped) == {"a", "b"}


def test_subsequence_search(spark):
    rng = random.Random(1)
    rows = []
    for _ in range(60):
        seq = [rng.randrange(3) for _ in range(rng.randrange(0, 40))]
        at = rng.randrange(0, max(1, len(seq)))
        rows.append((seq, seq[at:at + rng.randrange(0, 4)] if rng.random() < 0.7 else [9]))
    long = [rng.randrange(2) for _ in range(20_000)]
    rows.append((long, long[-2000:]))
    got = spark.createDataFrame(rows, "s array<int>, w array<int>").select(A.find_subsequence(F.col("s"), F.col("w")).alias("at")).collect()

    def brute(s, w):
        return next((i for i in range(len(s) - len(w) + 1) if s[i:i + len(w)] == w), -1) if w else -1

    assert [r["at"] for r in got] == [brute(s, w) for s, w in rows]


def test_step_records_are_all_or_nothing(spark, tmp_path):
    Z.register(spark)
    path = str(tmp_path / "steps")
    rows = spark.range(100).repartition(4)

    def save(df, step):
        df.write.format("step_records").option("path", path).option("split", "train").option("step", step).mode("append").save()

    def read():
        back = spark.read.format("step_records").option("path", path).schema("id bigint, split string, step bigint").load()
        return Counter((r["split"], r["step"]) for r in back.collect())

    assert Z.next_step(path, "train") == 1 and read() == {}
    save(rows, 1)
    assert Z.next_step(path, "train") == 2 and Z.next_step(path, "val") == 1 and read() == {("train", 1): 100}
    broken = rows.select(F.when(F.col("id") == 77, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("bigint").alias("id"))
    with pytest.raises(Exception, match="lost"):
        save(broken, 2)
    assert Z.next_step(path, "train") == 2 and read() == {("train", 1): 100}
    save(rows.where("id < 10"), 1)
    assert read() == {("train", 1): 10}
    named = {m for x in Z._manifests(path) for m in x["files"]}
    assert {f"data/{p.name}" for p in (tmp_path / "steps" / "data").iterdir()} >= named


def test_groups_with_late_and_missing_rows(spark, tmp_path):
    at = lambda h: f"2024-01-01 {h:02d}:00:00"
    deliveries = [
        [(1, 1.0, at(0))] * 2 + [(2, 5.0, at(1))],            # group 1 misses one of three, group 2 two
        [(1, 2.0, at(0)), (3, 7.0, at(6))],                   # 1 completes out of order; 6 o'clock closes all before 4
        [(2, 9.0, at(1)), (3, 1.0, at(6)), (4, 4.0, at(20))],  # 2 is late; 3 closes with two rows
    ]
    left = None
    for n, rows in enumerate(deliveries):
        df = spark.createDataFrame(rows, "uid long, score double, t string").withColumn("issued", F.col("t").cast("timestamp")).drop("t")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = P.groups_with_deadline(L.read_files(spark, str(tmp_path / "in"), df.schema), "uid", "score", "issued", 3, "2 hours")
        left = L.run_to_end(stream, str(tmp_path / "check"), path=str(tmp_path / "out"))
    got = {(r["kind"], r["uid"], r["n"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("complete", 1, 3, 4.0), ("timeout", 2, 1, 5.0), ("late", 2, 1, 9.0), ("timeout", 3, 2, 8.0)}
    assert left >= 1  # group 4 is still open
