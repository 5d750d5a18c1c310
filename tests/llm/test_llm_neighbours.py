"""Nearest neighbours against all pairs."""

from __future__ import annotations

import numpy as np

from rollout_lake.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, node long"


def brute(rows, queries, k):
    """Best rows by inner product in double precision, ties to the smaller id; of a repeated id the least vector."""
    own = {}
    for i, v, *_ in rows:
        if i is None or v is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = [float(np.float32(x)) for x in v]
        own[i] = min(own[i], v) if i in own else v
    width = max(map(len, own.values()), default=0)
    x = {i: np.array(v + [0.0] * (width - len(v))) for i, v in own.items()}
    return {q: sorted((-float(x[q] @ v), i) for i, v in x.items() if i != q)[:k] for q in queries if q in x}


def test_neighbours(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((600, 16))
    base[200:300] = base[0] + 0.05 * rng.standard_normal((100, 16))  # a dense group
    base[300:380] = base[1]  # equal vectors
    base[380:400] *= 40  # long ones
    rows = [(i, [float(v) for v in x], 1, 2) for i, x in enumerate(base)]
    inf, nan = float("inf"), float("nan")
    rows += [(1000, None, 1, 2), (1020, [0.0] * 16, 1, 2), (1040, [1.0, None], 1, 2), (1060, [inf, 1.0], 1, 2), (1080, [nan], 1, 2), (1100, [], 1, 2),
             (None, [1.0] * 16, 1, 2), (20, rows[20][1], 1, 2), (1200, [3.0, 1.0], 1, 2), (-40, rows[301][1], 1, 2), (40, [9.0] * 16, 1, 2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index = neighbours.build(df, 20, leaf=128)
    got = {}
    for r in neighbours.nearest(index, df.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    want = brute(rows, sorted({r[0] for r in rows if r[0] is not None and r[0] % 20 == 0}), 20)
    assert got.keys() == want.keys() and 1200 in got and -40 in got and 1000 not in got
    hits = 0
    for q, best in want.items():
        assert [r for r, *_ in got[q]] == list(range(1, 21)) and q not in [v for *_, v in got[q]]
        assert all(a[1] > b[1] or (a[1] == b[1] and a[2] < b[2]) for a, b in zip(got[q], got[q][1:]))
        hits += len({v for *_, v in got[q]} & {v for _, v in best})
    assert hits >= 0.95 * 20 * len(want)
    equal = [v for _, s, v in got[320] if s == got[320][0][1]]
    assert equal == [v for s, v in want[320] if s == want[320][0][0]]  # of equal vectors the smallest ids


def test_few_neighbours(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], 1, 2), (20, [2.0, 1.0], 1, 2), (3, [-1.0, 0.5], 1, 2)], SCHEMA)
    got = neighbours.nearest(neighbours.build(df, 20), df.where("vec_id % 20 = 0"), 20).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [
        (0, 1, 20, 4.0), (0, 2, 3, 0.0), (20, 1, 0, 4.0), (20, 2, 3, -1.5)]
    one = df.where("vec_id = 3")
    assert neighbours.nearest(neighbours.build(one, 20), one, 20).collect() == []
    assert neighbours.nearest(neighbours.build(df.limit(0), 20), df.limit(0), 20).collect() == []
