"""Golden arrays, recurrences and properties of token statistics."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollout_lake.functions import arrays as A
from rollout_lake.operators import evaluation as J
from rollout_lake.operators import mismatch as H
from rollout_lake.operators import packing as K
from rollout_lake.operators import tokens as T
from rollout_lake.plans.registry import Tables


def arr(spark, values, fn, kind="array<bigint>"):
    return spark.createDataFrame([(values,)], f"a {kind}").select(fn(F.col("a")).alias("r")).first()["r"]


def test_eos_mask_golden(spark):
    assert arr(spark, [0, 0, 2, 42, 3, 5, 1, 0, 0], lambda a: A.eos_mask(a, [1])) == [1, 1, 1, 1, 1, 1, 1, 0, 0]
    assert arr(spark, [4, 5], lambda a: A.eos_mask(a, [1, 9])) == [1, 1]


def test_pad_move_and_positions(spark):
    assert arr(spark, [0, 5, 0, 6], lambda a: A.move_padding(a, 0)) == [0, 0, 5, 6]
    assert arr(spark, [0, 5, 0, 6], lambda a: A.move_padding(a, 0, False)) == [5, 6, 0, 0]
    assert arr(spark, [1, 2, 3], lambda a: A.pad_left(a, F.lit(0).cast("bigint"), F.lit(5))) == [0, 0, 1, 2, 3]
    assert arr(spark, [1, 2, 3], lambda a: A.truncate(a, 2, "left")) == [2, 3]
    with pytest.raises(Exception, match="longer than"):
        arr(spark, [1, 2, 3], lambda a: A.truncate(a, 2, "error"))
    assert arr(spark, [1, 2, 3, 2, 3], lambda a: A.find_subsequence(a, F.array(F.lit(2), F.lit(3)).cast("array<bigint>"))) == 1
    assert arr(spark, [1], lambda a: A.find_subsequence(a, F.array(F.lit(2), F.lit(3)).cast("array<bigint>"))) == -1
    assert arr(spark, [0, 1, 2], lambda a: A.extend_positions(a, F.lit(2).cast("bigint"))) == [0, 1, 2, 3, 4]


def test_suffix_recurrence_on_ragged_rows(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=n).tolist(), rng.integers(0, 2, n).tolist()) for i, n in enumerate([0, 1, 5, 300, 2, 64])]
    df = spark.createDataFrame(rows, "i int, x array<double>, m array<int>")
    got = {r["i"]: r["y"] for r in df.select("i", A.suffix_recurrence(F.col("x"), F.col("m"), 0.95).alias("y")).collect()}
    for i, x, m in rows:
        want, carry = [0.0] * len(x), 0.0
        for t in range(len(x) - 1, -1, -1):
            want[t] = x[t] + 0.95 * carry
            carry = want[t] * m[t]
        assert np.allclose(got[i], want)


def test_whitening_gives_mean_zero_variance_one(spark, sf):
    tok = T.explode_tokens(Tables(spark, sf).sequences(), ["e", "loss_mask"])
    stats = T.stats_scalar(T.masked_stats(tok, "e", "loss_mask"))
    white = tok.withColumn("s", stats).select(T.whitened(F.col("e"), F.col("s")).alias("w"), "loss_mask").where("loss_mask = 1")
    m, v = white.agg(F.avg("w"), F.var_samp("w")).first()
    assert abs(m) < 1e-6 and abs(v - 1) < 1e-4


def test_equal_policies_have_ratio_one(spark, sf):
    tok = T.explode_tokens(Tables(spark, sf).sequences(), ["old_lp", "loss_mask", "turn_end"], cluster="seq_id")
    for level in H.LEVELS:
        for geometric in (False, True):
            r = H.log_ratio_at(tok, "old_lp", "old_lp", "loss_mask", level, geometric, "turn_end")
            assert r.where("abs(log_w) > 1e-12").count() == 0


def test_one_exchange_serves_the_weights(spark, sf):
    tok = T.explode_tokens(Tables(spark, sf).sequences(), ["old_lp", "rollout_lp", "loss_mask", "turn_end"], cluster="seq_id")
    w = H.rollout_weights(tok, "old_lp", "rollout_lp", "loss_mask", "cum-turn", "mask", 1.1, turn_end="turn_end")
    per_seq = w.groupBy("seq_id").agg(F.sum("weight"))
    plan = per_seq._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_bad_arguments(spark, sf):
    tok = T.explode_tokens(Tables(spark, sf).sequences(), ["old_lp", "rollout_lp", "loss_mask"])
    with pytest.raises(ValueError):
        H.log_ratio_at(tok, "old_lp", "rollout_lp", "loss_mask", "cum-turn")
    with pytest.raises(ValueError):
        H.rollout_weights(tok, "old_lp", "rollout_lp", "loss_mask", "token", "clip", 2.0)
    with pytest.raises(ValueError):
        J.pass_at_k(F.lit(3), F.lit(1), 0)
    with pytest.raises(Exception, match="fewer than k"):
        spark.range(1).select(J.pass_at_k(F.lit(3), F.lit(1), 4)).collect()


def test_pass_at_k_ends(spark):
    rows = [(n, c) for n in range(1, 7) for c in range(n + 1)]
    df = spark.createDataFrame(rows, "n int, c int")
    one = df.select("n", "c", J.pass_at_k(F.col("n"), F.col("c"), 1).alias("p")).collect()
    assert all(abs(r["p"] - r["c"] / r["n"]) < 1e-12 for r in one)
    six = df.where("n = 6").select("c", J.pass_at_k(F.col("n"), F.col("c"), 6).alias("p")).collect()
    assert all(r["p"] == (1.0 if r["c"] else 0.0) for r in six)


def test_partitions_cover_every_row_and_balance(spark):
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 5000, 96).tolist()
    for equal in (False, True):
        bins = K.largest_differencing(lengths, 8, equal)
        assert sorted(i for b in bins for i in b) == list(range(96))
        sums = [sum(lengths[i] for i in b) for b in bins]
        assert max(sums) - min(sums) < max(lengths)
        if equal:
            assert {len(b) for b in bins} == {12}
    greedy = K.greedy_bins([5, 1, 1, 1], 2, False)
    assert greedy == [[0], [1, 2, 3]]
    assert [len(b) for b in K.greedy_bins(lengths, 8, True)] == [12] * 8


def test_micro_batches_and_packs_hold_the_budget(spark):
    df = spark.range(1000).select("id", (F.col("id") * 7919 % 900 + 1).alias("len"))
    packs = K.pack_samples(df, "id", "len", 1000, F.col("id") % 3).groupBy("shard", "partition").agg(F.sum("length").alias("s"), F.count("*").alias("n"))
    assert packs.agg(F.max("s")).first()[0] <= 1000
    assert packs.agg(F.sum("n")).first()[0] == 1000
    with pytest.raises(Exception, match="exceeds the capacity"):
        K.pack_samples(df, "id", "len", 100, F.lit(0)).collect()
    parts = K.balance(df, "id", "len", 100, 4, equal_size=True)
    order = K.balanced_order(parts, 100, 4)
    assert sorted(r["new_pos"] for r in order.collect()) == list(range(1000))


def test_ragged_accuracy_against_brute_force(spark):
    rows = [(0, [True, False, True]), (1, [True]), (2, [False, False]), (3, [True, True, True, False])]
    got = {r["response"]: r["acc"] for r in J.column_accuracy(spark.createDataFrame(rows, "i int, s array<boolean>"), "s").collect()}
    width = 4
    padded = [s + [s[-1]] * (width - len(s)) for _, s in rows]
    want = {p: round(100 * sum(r[p] for r in padded) / len(rows), 1) for p in range(width)}
    assert got == want
