"""Batches whose last one is short: folds, mini-batches and balanced partitions of any row count."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rollout_lake.operators import batch as C
from rollout_lake.operators import packing as K


def test_last_fold_may_be_short(spark):
    df = spark.range(1, 8).select("id", (F.col("id") - 1).alias("row_index"))
    folded = C.fold_rows(df, "row_index", ["id"], 5, short_last=True)
    assert {r["fold"]: [x["id"] for x in r["items"]] for r in folded.collect()} == {0: [1, 2, 3, 4, 5], 1: [6, 7]}
    assert {(r["row_index"], r["id"]) for r in C.unfold_rows(folded, 5).collect()} == {(i - 1, i) for i in range(1, 8)}
    with pytest.raises(Exception, match="not divisible"):
        C.fold_rows(df, "row_index", ["id"], 5).collect()


def test_minibatches_of_any_row_count(spark):
    df = spark.range(107).select("id")
    got = C.minibatches(df, ["id"], 50, 2, 9, full_only=True).collect()
    assert Counter((r["epoch"], r["batch_id"]) for r in got) == {(e, b): 50 for e in (0, 1) for b in (0, 1)}
    for e in (0, 1):
        order = sorted(range(107), key=lambda i: (hashlib.md5(f"{i}-{e}-9".encode()).hexdigest(), i))
        assert {r["id"]: r["position"] for r in got if r["epoch"] == e} == {i: n for n, i in enumerate(order[:100])}
    with pytest.raises(Exception, match="not divisible"):
        C.minibatches(df, ["id"], 50, 2, 9).collect()


@pytest.mark.parametrize("rows", [101, 102, 103, 120, 121])
def test_short_last_batch_is_filled(spark, rows):
    df = spark.range(rows).select((F.col("id") + 2**60).alias("id"), (F.col("id") * 7919 % 900 + 1).alias("len"))
    lengths = [i * 7919 % 900 + 1 for i in range(rows)]
    parts = K.balance(df, "id", "len", 40, 4, equal_size=True, method=K.narrower, fill=True)
    got = parts.collect()
    batches = -(-rows // 40)
    assert Counter((r["batch_id"], r["partition"]) for r in got) == {(b, p): 10 for b in range(batches) for p in range(4)}
    assert sorted((r["id"], r["row_index"], r["length"]) for r in got if r["id"] is not None) == [(2**60 + i, i, n) for i, n in enumerate(lengths)]
    assert all(r["length"] is None for r in got if r["id"] is None)
    order = K.balanced_order(parts, 40, 4)
    assert sorted(r["new_pos"] for r in order.collect()) == list(range(batches * 40))
    for r in K.imbalance(parts, 40, 4).collect():
        own = lengths[r["batch_id"] * 40:][:40]
        sums = [sum(own[i:i + 10]) for i in range(0, len(own), 10)]
        assert (r["min"], r["max"], r["minmax_diff"], r["mean"]) == (min(sums), max(sums), max(sums) - min(sums), sum(own) / 4)
        assert r["balanced_min"] <= r["mean"] <= r["balanced_max"] and r["balanced_max"] - r["balanced_min"] <= r["slice_spread"]


def test_partitions_no_wider_than_slices():
    rng = random.Random(8)
    for _ in range(300):
        lengths = [rng.choice([1, 2, 60, 61, 400]) for _ in range(40)]
        sums = [[sum(lengths[i] for i in b) for b in bins] for bins in (K.narrower(lengths, 4, True), [range(i, i + 10) for i in range(0, 40, 10)])]
        assert max(sums[0]) - min(sums[0]) <= max(sums[1]) - min(sums[1])
