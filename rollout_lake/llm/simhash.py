"""SimHash near-duplicates: candidates by the pigeonring, then the full Hamming distance.

A fingerprint's 64 bits lie on a ring of four segments. If two fingerprints differ in at most
three bits, some segment starts a chain of 1, 2, 3, 4 consecutive segments with at most 0, 1, 2, 3
differing bits in total (each chain within its share of the budget). The first two segments make a
key: the first one equal and the second one with at most one bit flipped, so candidates share 32
bits; the longer chains are compared before the full distance. Keys that too many fingerprints share
take the third segment in as well, after which no key has more than 65,536 fingerprints.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, rows_each, whole, written
from .components import component_roots

WIDTH = 3
RADIUS = 3
SEGMENTS = 4
BITS = 16
SEED = 42
CROWDED = 2048
"""Fingerprints that may share a 32-bit key before the key is extended to 48 bits."""


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the 64-bit hashes, as a signed number; zero of none."""
    if not len(hashes):
        return 0
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = hashes[at:at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * set_bits > len(hashes)).tobytes()
    return int.from_bytes(bits, "big", signed=True)


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles of the lower-cased words, repeats included."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    n = max(1, len(w) - width + 1)
    shingles = map(b" ".join, zip(*[w[i:] for i in range(width)])) if len(w) >= width else [b" ".join(w)]
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(doc_id, fp)`` of every row; bytes.lower and bytes.split change and split ASCII only, as the rule asks."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([majority(shingle_hashes(t, width)) for t in texts], dtype="int64")

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), simhash(whole(F.col("text"))).alias("fp"))


def _turned(start: int) -> Column:
    """The fingerprint with segment ``start`` in front."""
    shift = BITS * start
    if shift == 0:
        return F.col("fp")
    return F.shiftleft("fp", shift).bitwiseOR(F.shiftrightunsigned("fp", 64 - shift))


def _flips(most: int) -> list[tuple[int, int]]:
    """Masks of at most ``most`` bits within a segment, each with its number of bits."""
    return [(sum(1 << b for b in at), n) for n in range(most + 1) for at in combinations(range(BITS), n)]


def _masks(most: int) -> Column:
    return F.array(*[F.struct(F.lit(m).cast("bigint").alias("mask"), F.lit(n).alias("n")) for m, n in _flips(most)])


def links(prints: DataFrame, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """Pairs ``(a, b)`` of different values of ``fp`` at most ``radius`` (up to 3) bits apart, each once, a < b.

    ``prints`` has every fingerprint once, so copies never meet each other. The work for a
    fingerprint is bounded: at most ``crowded`` others share a 32-bit key; a more frequent key is
    extended, and an extended key holds at most 65,536 fingerprints. Nulls are ignored.
    """
    prints = prints.where("fp is not null")
    starts = F.array(*[F.struct(F.lit(s).cast("bigint").alias("s"), _turned(s).alias("t")) for s in range(SEGMENTS)])
    turned = prints.select("fp", F.explode(starts).alias("x")).select("fp", "x.s", "x.t")
    key = F.shiftleft("s", 32).bitwiseOR(F.shiftrightunsigned("t", 32))
    index = turned.select("fp", "t", key.alias("key"))
    probes = index.withColumn("f", F.explode(_masks(1))).select(
        "fp", "t", F.col("key").bitwiseXOR(F.col("f.mask")).alias("key"), F.col("f.n").alias("n")
    )
    full = written(index.groupBy("key").count().where(F.col("count") > crowded).select("key"), "crowded-keys")
    if rows_each(full):
        third = F.shiftrightunsigned("t", 16).bitwiseAND(F.lit(0xFFFF))
        deep_index = index.join(full, "key", "left_semi").select(
            "fp", "t", F.shiftleft("key", 16).bitwiseOR(third).alias("key")
        )
        reach = probes.join(full, "key", "left_semi").withColumn("f", F.explode(_masks(2)))
        deep_probes = reach.where(F.col("f.n") + F.col("n") <= 2).select(
            "fp", "t", F.shiftleft("key", 16).bitwiseOR(third.bitwiseXOR(F.col("f.mask"))).alias("key"), "n"
        )
        pairs = _meet(index.join(full, "key", "left_anti"), probes.join(full, "key", "left_anti"), radius).unionByName(
            _meet(deep_index, deep_probes, radius)
        )
    else:
        pairs = _meet(index, probes, radius)
    return pairs.distinct()


def _meet(index: DataFrame, probes: DataFrame, radius: int) -> DataFrame:
    """Candidates of one kind of key whose longer chains and whole ring stay within their budgets.

    A fingerprint has many probes, which the planner's sizes do not show: neither side may be broadcast.
    """
    left = probes.select(F.col("fp").alias("a"), F.col("t").alias("ta"), "key")
    right = index.select(F.col("fp").alias("b"), F.col("t").alias("tb"), "key")
    apart = F.col("ta").bitwiseXOR(F.col("tb"))
    budget = lambda n: F.lit(radius * n // SEGMENTS)
    return left.hint("merge").join(right, "key").where(
        (F.col("a") < F.col("b"))
        & (F.bit_count(F.shiftrightunsigned(apart, 32)) <= budget(2))
        & (F.bit_count(F.shiftrightunsigned(apart, 16)) <= budget(3))
        & (F.bit_count(apart) <= budget(4))
    ).select("a", "b")


def near_groups(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, crowded: int = CROWDED) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row: the smallest id reachable over links of at most ``radius`` bits.

    Null text: no words, fingerprint zero, linked like any other. Null id: below all ids in the
    choice of the smallest, and a group whose smallest is such a row has a null component_id.
    Repeated rows: each returned. Empty table: empty result. Further columns are not read.
    """
    prints = written(fingerprints(docs, width), "fingerprints")
    low = F.coalesce(F.col("doc_id"), F.lit(NO_ID))
    classes = written(prints.groupBy("fp").agg(F.min(low).alias("low")), "fp-classes")
    roots = component_roots(links(classes.select("fp"), radius, crowded))
    rooted = written(
        classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
            "fp", "low", F.coalesce("root", "fp").alias("root")
        ), "fp-roots",
    )
    lows = written(rooted.groupBy("root").agg(F.min("low").alias("component_id")), "root-lows")
    named = written(rooted.select("fp", "root").join(lows, "root").select("fp", "component_id"), "fp-components")
    out = prints.join(named, "fp")
    return out.select(
        "doc_id", "fp", F.when(F.col("component_id") == NO_ID, F.lit(None)).otherwise(F.col("component_id")).alias("component_id")
    )
