"""Skewed keys: group joins, ranks and running totals must agree with plain windows."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rollout_lake.operators import advantage as G
from rollout_lake.operators import resample as I
from rollout_lake.operators.groups import attach_group_stats, lookup_join
from rollout_lake.operators.ordering import index_by_id, running_total, seeded_index
from rollout_lake.operators.quantiles import exact_quantiles


def skewed(spark, n=30000):
    """A third of all rows belong to one prompt, and ids cluster."""
    ids = F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.col("id") * 1000003 + 7)
    uid = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 4000)
    return spark.range(n).select(
        F.col("id").alias("row"), ids.alias("rid"), uid.alias("uid"),
        (F.col("id") % 7 / 6).alias("score"), (F.col("id") % 50).alias("len"),
    )


def test_group_stats_on_a_hot_key(spark):
    df = skewed(spark)
    w = Window.partitionBy("uid")
    want = {r["row"]: (r["m"], r["n"]) for r in df.withColumns({"m": F.avg("score").over(w), "n": F.count("*").over(w)}).collect()}
    got = attach_group_stats(df, ["uid"], [F.avg("score").alias("m"), F.count(F.lit(1)).alias("n")]).collect()
    assert len(got) == len(want)
    for r in got:
        assert r["n"] == want[r["row"]][1]
        assert abs(r["m"] - want[r["row"]][0]) < 1e-9


def test_hot_rows_are_salted(spark):
    df = attach_group_stats(skewed(spark), ["uid"], [F.avg("score").alias("m")])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "__salt" in plan
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_lookup_join_keeps_rows_without_a_match(spark):
    df = skewed(spark)
    table = spark.createDataFrame([(-1, 5.0), (1, 6.0)], "uid bigint, b double")
    out = lookup_join(df, table, ["uid"])
    assert out.count() == 30000
    assert out.where("uid = -1 and b = 5").count() == 10000
    assert out.where("uid not in (-1, 1) and b is not null").count() == 0


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, None, 3.0), (3, 7, 5.0)], "row int, uid int, score double")
    got = {r["row"]: r["m"] for r in attach_group_stats(df, ["uid"], [F.avg("score").alias("m")]).collect()}
    assert got == {1: 2.0, 2: 2.0, 3: 5.0}


def test_running_total_and_index(spark):
    df = skewed(spark)
    w = Window.partitionBy("uid").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    got = running_total(df, F.col("len"), ["row"], F.floor(F.col("row") / 512), ["uid"], "total")
    bad = got.withColumn("want", F.sum("len").over(w)).where("total <> want").count()
    assert bad == 0
    placed = index_by_id(df, "rid").orderBy("rid").select("row_index").collect()
    assert [r["row_index"] for r in placed] == list(range(30000))


def test_seeded_index_is_a_permutation_and_repeats(spark):
    df = skewed(spark)
    a = seeded_index(df, ["row"], 5, ["uid"]).select("uid", "row", "row_index")
    b = seeded_index(df, ["row"], 5, ["uid"]).select("uid", "row", "row_index")
    assert a.exceptAll(b).count() == 0
    hot = [r["row_index"] for r in a.where("uid = -1").collect()]
    assert sorted(hot) == list(range(10000))
    assert seeded_index(df, ["row"], 6, ["uid"]).select("uid", "row", "row_index").exceptAll(a).count() > 0


def test_exact_quantiles(spark):
    df = spark.range(10001).select((F.col("id") * F.col("id") % 977).cast("double").alias("v"))
    probs = [0.0, 0.01, 0.25, 0.5, 0.333, 0.99, 1.0]
    names = [f"q{i}" for i in range(len(probs))]
    got = exact_quantiles(df, "v", probs, names).first()
    want = df.agg(F.percentile("v", F.array(*[F.lit(p) for p in probs])).alias("q")).first()["q"]
    assert all(abs(got[n] - w) < 1e-9 for n, w in zip(names, want))
    one = exact_quantiles(df.limit(1), "v", [0.5], ["m"]).first()["m"]
    assert one == 0.0


def test_grpo_and_rloo_properties(spark):
    df = skewed(spark)
    g = G.grpo_advantage(df).groupBy("uid").agg(F.abs(F.avg("advantage")).alias("m"), F.count("*").alias("n"))
    assert g.where("n > 1 and m > 1e-6").count() == 0
    r = G.rloo_advantage(df).groupBy("uid").agg(F.abs(F.sum("advantage")).alias("s"), F.count("*").alias("n"))
    assert r.where("n > 1 and s > 1e-6").count() == 0


def test_group_of_one(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.25), (2, 0.75)], "uid bigint, score double")
    got = {(r["uid"], r["score"]): r["advantage"] for r in G.grpo_advantage(df).collect()}
    assert abs(got[(1, 0.5)] - 0.5 / (1 + 1e-6)) < 1e-9
    assert {r["advantage"] for r in G.rloo_advantage(df).where("uid = 1").collect()} == {0.5}


def test_downsample_takes_whole_groups_and_fails_when_short(spark):
    import pytest

    df = skewed(spark)
    kept = I.downsample_groups(df, "uid", 20, 3)
    sizes = {r["uid"]: r["count"] for r in df.groupBy("uid").count().collect()}
    got = {r["uid"]: r["count"] for r in kept.groupBy("uid").count().collect()}
    assert len(got) == 20 and all(sizes[u] == n for u, n in got.items())
    with pytest.raises(Exception, match="fewer than"):
        I.downsample_groups(df, "uid", 10**6, 3).count()


def test_refill_reaches_the_batch_size(spark):
    df = spark.createDataFrame([(u, s) for u in range(3) for s in range(2)], "uid bigint, s int")
    out = I.refill(df, "uid", 8, I.group_count(df, "uid"))
    assert out.select("uid").distinct().count() == 9
    same = I.refill(df, "uid", 3, I.group_count(df, "uid"))
    assert {r["uid"] for r in same.select("uid").distinct().collect()} == {"0", "1", "2"}
