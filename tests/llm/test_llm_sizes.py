"""What is sent and shuffled: no broadcast of a fingerprint's probes, no texts that share a passage only, and suffixes that pack well."""

import random
import zlib

import numpy as np
import pyarrow as pa

from rollout_lake.llm import collocations, near_stage, simhash


def test_probes_are_not_broadcast(spark, tmp_path):
    values = [zlib.crc32(str(i).encode()) << 20 | i for i in range(300)]
    values += [v ^ 1 << i % 40 ^ 1 << 45 for i, v in enumerate(values[:100])]
    spark.createDataFrame([(v,) for v in values], "fp long").coalesce(1).write.parquet(str(tmp_path / "fp"))
    found = simhash.links(spark.read.parquet(str(tmp_path / "fp")))
    assert {(r["a"], r["b"]) for r in found.collect()} == {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_packed_suffixes_come_back():
    rng = np.random.default_rng(2)
    words = rng.integers(1, 1 << 64, 3000, np.uint64)
    for n, kinds, plain in ((0, 1, True), (1, 1, False), (6000, 3000, True), (6000, 3000, False), (40_000, 90_000, True)):
        some = words if kinds <= 3000 else rng.integers(0, 1 << 64, kinds, np.uint64)
        columns = [np.where(rng.random(n) < 0.1 * i, np.uint64(0), some[rng.integers(0, kinds, n) ** 2 % kinds]) for i in range(4)]
        weight = np.ones(n, np.int64) if plain else rng.integers(1, 1 << 40, n)
        back, times = collocations._unpacked(data := collocations._packed(columns, weight))
        assert (back == np.array(columns, np.uint64)).all() and (times == weight).all()
        if n == 6000 and plain:  # less room than words as they are and places compressed as pairs of bytes
            known, places = np.unique(np.concatenate(columns), return_inverse=True)
            assert len(data) < 0.95 * (40 + 8 * len(known) + len(pa.compress(places.astype(np.uint16).tobytes(), "zstd", asbytes=True)))


def edited_and_passage_texts():
    """Texts that differ by an edit, of 1 to 700 words, and groups of 8 that share a passage and no more."""
    pick = random.Random(5)
    fresh = lambda n: [f"w{pick.randrange(10**9)}" for _ in range(n)]
    texts = []
    for n in (*range(1, 13), 20, 50, 67, 68, 69, 100, 132, 133, 200, 400, 700):
        whole = fresh(n)
        for k in {1, n // 20, n // 9, n // 6, n // 4, n // 3}:
            texts += [fresh(k) + whole, whole[k:], whole[:n // 2] + fresh(k) + whole[n // 2 + k:]]
        texts.append(whole)
    for _ in range(30):
        passage = fresh(6)
        texts += [fresh(at := pick.randrange(150)) + passage + fresh(150 - at) for _ in range(8)]
    return {i: " ".join(t) for i, t in enumerate(texts) if t}


def five(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}


def test_texts_that_share_a_passage_are_not_compared(spark):
    texts = edited_and_passage_texts()
    sets = {i: five(t) for i, t in texts.items()}
    passage = max(texts) - 240
    shared = {(a, b): n for a in sets for b in sets if a < b and (n := len(sets[a] & sets[b]))}
    near = {(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)}
    docs = spark.createDataFrame(list(texts.items()), "node long, text string").repartition(5)
    entries = near_stage.written(near_stage.prefixes(docs), "entries")
    no_links = spark.createDataFrame([], "a long, b long")
    crossed = [(r["a"], r["b"]) for r in near_stage._crossed(entries.select("key", "node", "n", "i"), no_links, 0.8).collect()]
    assert len(near) > 100 and sum(a > passage for a, _ in shared) == 30 * 28
    assert len(crossed) == len(set(crossed)) and near <= set(crossed) <= set(shared)
    assert not [a for a, _ in crossed if a > passage]

    bits = near_stage.written(entries.where("i = 0").select("node", "n", "bits"), "bits")
    assert all(64 * len(r["bits"]) < max(65, 2 * r["n"]) for r in bits.collect())
    pairs = near_stage.written(spark.createDataFrame(list(shared), "a long, b long"), "pairs")
    left = {(r["a"], r["b"]) for r in near_stage.plausible(pairs, bits).collect()}
    assert near <= left and not [a for a, _ in left if a > passage]
    assert {(r["a"], r["b"]) for r in near_stage.verified(pairs, bits, docs).collect()} == near
