"""The next event of a row is looked up among the events of its bin; the rows are not sorted."""

import random

from pyspark.sql import functions as F

from rollout_lake.operators import intervals as I


def test_rows_are_not_sorted(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([0, 0, 1, 2]), rng.randrange(-50, 4000)) for i in range(4000)]
    events = [(rng.randrange(0, 4), rng.randrange(-40, 4000)) for _ in range(300)]
    df = spark.createDataFrame([*rows, rows[0], (4000, None, 7), (4001, 1, None)], "id long, k long, at long")
    found = I.next_at_or_after(df, spark.createDataFrame([*events, *events], "k long, e long").unionByName(
        spark.range(1).select(F.lit(None).cast("long").alias("k"), F.lit(9).cast("long").alias("e"))), ["k"], "at", "e", "nx", 16)
    got = sorted(((r["id"], r["nx"]) for r in found.collect()), key=lambda x: x[0])
    want = [(i, min((e for g, e in events if g == k and e >= at), default=None)) for i, k, at in sorted([*rows, rows[0]])]
    assert got == [*want, (4000, None), (4001, None)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and plan.split("Initial Plan")[-1].count("Window [") == 1
