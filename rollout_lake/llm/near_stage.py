"""Near-duplicate removal for a pipeline: SimHash candidates first, then all others, verified on shingles of five words.

A fingerprint is taken of each text's distinct words. Pairs that the pigeonring links are candidates; they count if the
Jaccard similarity of their word shingles is high enough. That joins most groups at little cost, but misses pairs.

The exact part finds the rest. With the shingles of every text in one order, rare ones first, two texts that
agree to 0.8 share some of the first shingles, at places that leave enough to share. Texts that
share as many such keys and are not joined yet are compared, first by bitmaps of a bit or two a shingle: pairs that
share a passage or a chance key grow faster than texts. Of each group reachable over the pairs one document stays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sketches
from .common import ascii_lower, discard, drop_shuffles, join_hot, rows_each, whole, written
from .components import component_roots
from .simhash import links, majority

WIDTH = 5
SIMILARITY = 0.8

SAMPLE = 20_000
"""Texts, about, whose shingles are counted to tell frequent ones. The count decides on the order only, not on results."""

OFTEN = 8
FREQUENT = 100_000
"""Shingles in more than ``OFTEN`` texts of the sample, ``FREQUENT`` of them at most, come last in the order."""

SHARED, EVERY = 2, 50
"""Two near sets have ``SHARED`` shingles of their prefixes in common and one more for each ``EVERY`` of the smaller set, or all they must share."""

STARS = 2
"""Texts of a key that stand for it, and of those that stand for a text's keys, how many it is compared with at first."""

BAND = 1.05
"""Sizes whose ratio is below this may share a band."""

BROADCAST_IDS = 1_000_000
"""Ids of texts to be compared, up to so many (8 MB), are broadcast to pick the texts; more are joined by shuffle."""

SLICE = 1 << 18
"""Shingles that are sorted at a time."""


def word_prints(text: str | None) -> list[int]:
    """Two hashes of the sequence of lower-cased words, then the fingerprint of the distinct words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    sequence = xxhash.xxh3_128(b" ".join(words)).digest()
    found = set(words)
    h = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    return [*(int.from_bytes(sequence[i:i + 8], "big", signed=True) for i in (0, 8)), majority(h)]


def _text_hashes(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("x1"), F.xxhash64(text, F.lit(1)).alias("x2")]


def _documents(docs: DataFrame) -> DataFrame:
    """``(node, x1, x2, k1, k2, fp)`` per id, narrow; of rows that repeat an id the least stands for all."""

    @F.pandas_udf("array<long>")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([word_prints(t) for t in texts])

    text = whole(F.col("text"))
    rows = docs.where("doc_id is not null").select(
        F.col("doc_id").cast("bigint").alias("node"), *_text_hashes(text), prints(text).alias("x")
    )
    rows = rows.select("node", F.struct("x1", "x2", *[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(("k1", "k2", "fp"))]).alias("x"))
    return written(rows.groupBy("node").agg(F.min("x").alias("x")).select("node", "x.*"), "prints")


def candidates(nodes: DataFrame) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of nodes ``(node, fp)`` with linked fingerprints, each once.

    Nodes of one fingerprint are compared with the smallest of them, and the smallest ones of linked
    fingerprints with each other, so no group is compared pair by pair. Near texts whose heads are not
    near do not meet here; ``all_links`` finds them.
    """
    heads = written(nodes.groupBy("fp").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n")), "heads")
    same = join_hot(nodes.select("node", "fp"), heads, [("fp", "fp")], "n", "inner").where("node <> head").select(
        F.col("head").alias("a"), F.col("node").alias("b"))
    linked = links(heads.select("fp")).join(heads.select(F.col("fp").alias("a"), F.col("head").alias("ha")), "a").join(
        heads.select(F.col("fp").alias("b"), F.col("head").alias("hb")), "b"
    ).select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    return written(same.unionByName(linked), "candidates")


def shingle_sets(texts: DataFrame, width: int = WIDTH) -> DataFrame:
    """``(node, s)``: the distinct shingle hashes of each node's text."""
    return texts.select("node", F.array_distinct(sketches.shingle_hashes(ascii_lower(F.col("text")), width)).alias("s"))


def _chosen(pairs: DataFrame, texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts that occur in a written table of pairs, and the written table of their ids."""
    ids = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    needed = written(ids.distinct(), "needed")
    few = rows_each(needed) <= BROADCAST_IDS
    return texts.join(F.broadcast(needed) if few else needed, "node", "left_semi"), needed


def _ends(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with the other columns of both their ends, as structs ``x`` and ``y``."""
    own = F.struct(*[c for c in sets.columns if c != "node"])
    return pairs.join(sets.select(F.col("node").alias("b"), own.alias("y")), "b").join(
        sets.select(F.col("node").alias("a"), own.alias("x")), "a")


def plausible(pairs: DataFrame, bits: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose sets may be similar enough by their sizes and bitmaps ``(node, n, bits)``.

    Two bitmaps differ in no more bits than there are shingles in one set only. The longer one is folded to the other's length.
    """
    n, m, p, q = F.col("x.n"), F.col("y.n"), F.col("x.bits"), F.col("y.bits")
    size = F.least(F.size(p), F.size(q))
    xor = lambda a, b: a.bitwiseXOR(b)
    folded = lambda t: F.when(F.size(t) > size, F.zip_with(F.slice(t, F.lit(1), size), F.slice(t, size + 1, size), xor)).otherwise(t)
    apart = F.aggregate(F.zip_with(folded(p), folded(q), xor), F.lit(0), lambda total, word: total + F.bit_count(word))
    close = F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6
    few = F.when(close, apart <= (n + m) * ((1 - similarity) / (1 + similarity)) + 1e-6)
    return written(_ends(pairs, bits).where(few).select("a", "b"), "plausible-pairs")


def verified(pairs: DataFrame, bits: DataFrame, texts: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs whose sets of word shingles have a Jaccard similarity of at least ``similarity``.

    Only texts of pairs that their bitmaps let pass are read again, and only their sets are shuffled.
    """
    left = plausible(pairs, bits, similarity)
    some, needed = _chosen(left, texts)
    sets = written(shingle_sets(some, width), "pair-sets")
    n = F.size(F.array_intersect("x.s", "y.s"))
    both = F.size("x.s") + F.size("y.s")
    met = _ends(left, sets).select("a", "b", n.alias("n"), both.alias("both"))
    near = written(met.where(
        (F.col("n") >= similarity * (F.col("both") - F.col("n"))) & (F.col("both") > 0)
    ).select("a", "b"), "near-pairs")
    discard(left, needed, sets)
    return near


def _frequent(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, ascending, and for each its rank by frequency, from 1."""
    share = max(1, rows_each(texts) // SAMPLE)
    some = shingle_sets(texts.where(F.pmod(F.xxhash64("node"), F.lit(share)) == 0), width)
    counts = some.select(F.explode("s").alias("h")).groupBy("h").count()
    top = [r["h"] for r in counts.where(F.col("count") > OFTEN).orderBy(F.desc("count"), "h").limit(FREQUENT).collect()]
    drop_shuffles(texts.sparkSession)
    hashes, ranks = np.array(top, np.int64), np.arange(len(top), 0, -1)
    order = np.argsort(hashes)
    return hashes[order], ranks[order]


def _shared(n: Column | np.ndarray) -> Column | np.ndarray:
    """How many shingles of its prefix a set of ``n`` shares with a near one that is no smaller."""
    return SHARED + (F.floor(n / EVERY).cast("int") if isinstance(n, Column) else n // EVERY)


def _parities(hashes: np.ndarray, row: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bitmaps of sets of ``n`` hashes, one after the other as words of 64 bits, and the number of words of each.

    Each hash flips one bit. A bitmap has the least power of two of bits that is no less than ``n``, 64 at least.
    """
    words = np.where(n > 0, 1 << np.maximum(0, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64) - 6), 0)
    starts = np.cumsum(words) - words
    at = 64 * starts[row] + (hashes & (64 * words[row] - 1))
    return np.packbits(np.bincount(at, minlength=64 * words.sum()).astype(np.uint8) & 1, bitorder="little").view("<i8"), words


def prefixes(texts: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """``(node, n, i, key, bits)``: the first shingles of each set, of ``n`` in all, with their places from 0.

    Two sets with a Jaccard similarity of ``similarity`` have as many of them in common as ``_shared`` says of the smaller set, as the one
    with more shingles shares at least that part of its own; fewer if that part is less. At place 0 ``bits`` is the set's bitmap, else it is empty.
    """
    hashes, ranks = _frequent(texts, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, lists = np.asarray(batch.column(0)), batch.column(1)
            sizes = np.asarray(lists.value_lengths(), np.int64)
            bounds, flat = np.r_[0, np.cumsum(sizes)], np.asarray(lists.flatten())
            runs = np.flatnonzero(np.r_[True, np.diff(bounds[:-1] // SLICE) > 0, True])
            for start, end in zip(runs, runs[1:]):
                s, n = flat[bounds[start]:bounds[end]], sizes[start:end]
                rank = np.zeros(len(s), np.int64)
                if len(hashes):
                    at = np.minimum(np.searchsorted(hashes, s), len(hashes) - 1)
                    rank = np.where(hashes[at] == s, ranks[at], 0)
                row = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((s, rank, row))
                place = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
                first = place < (n - np.ceil(similarity * n - 1e-9).astype(np.int64) + _shared(n))[row]
                bits, words = _parities(s, row, n)
                ends = np.cumsum(np.where(place == 0, words[row], 0)[first])
                yield pa.RecordBatch.from_arrays([
                    pa.array(nodes[start:end][row[first]]), pa.array(n[row[first]].astype(np.int32)),
                    pa.array(place[first].astype(np.int32)), pa.array(s[order][first]),
                    pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(bits)),
                ], ["node", "n", "i", "key", "bits"])

    return shingle_sets(texts, width).mapInArrow(run, "node bigint, n int, i int, key bigint, bits array<bigint>")


def _leaves_enough(n: Column, i: Column, m: Column, j: Column, similarity: float, before: Column | int = 0) -> Column:
    """Whether sets of ``n`` and ``m`` that share their shingles from places ``i`` and ``j`` on, and ``before`` at most ahead of them, can be near."""
    share = similarity / (1 + similarity)
    return (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-6) & (F.least(n - i, m - j) + before >= share * (n + m) - 1e-6)


def _apart(pairs: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The pairs ``(a, b)``, each once, that the links do not join yet."""
    pairs = written(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    roots = written(component_roots(links), "roots-so-far")
    known = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(
        roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    apart = written(known.where("coalesce(ra, a) <> coalesce(rb, b)").select("a", "b"), name)
    discard(pairs, roots)
    return apart


def _crossed(entries: DataFrame, links: DataFrame, similarity: float) -> DataFrame:
    """Pairs that are still apart and can be near by the keys they share, by sizes and places, without meeting all others of a key.

    The larger set looks for smaller ones: its place there bounds their sizes, and theirs must lie in the
    first part of their own prefix. Sizes go into the key as bands. A pair meets once at a key, and counts if enough keys have it.
    """
    roots = written(component_roots(links), "roots-so-far")
    rooted = written(entries.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted-keys")
    groups = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count(F.lit(1)).alias("size"))
    mixed = written(groups.where("low <> high").select("key", "size"), "mixed-keys")
    rows = written(join_hot(rooted, mixed, [("key", "key")], "size", "inner"), "mixed-rows")
    discard(roots, rooted, mixed)
    share = similarity / (1 + similarity)
    band = lambda size: F.floor(F.log(F.greatest(size, F.lit(1.0))) / math.log(BAND))
    n, i = F.col("n"), F.col("i")
    least, most = similarity * n - 1e-6, F.least(n.cast("double"), (n - i + _shared(n) - 1) / share - n + 1e-6)
    probes = rows.where(most >= least).withColumn("band", F.explode(F.sequence(band(least), band(most))))
    stock = rows.where(n - i + _shared(n) - 1 >= 2 * share * n - 1e-6).withColumn("band", band(n.cast("double")))
    left = probes.select("key", "band", *[F.col(c).alias(f"l_{c}") for c in ("node", "n", "i", "root")])
    right = stock.select("key", "band", *[F.col(c).alias(f"r_{c}") for c in ("node", "n", "i", "root")])
    met = left.hint("merge").join(right, ["key", "band"]).where(
        (F.col("l_root") != F.col("r_root"))
        & ((F.col("l_n") > F.col("r_n")) | (F.col("l_n") == F.col("r_n")) & (F.col("l_node") < F.col("r_node")))
        & _leaves_enough(F.col("l_n"), F.col("l_i"), F.col("r_n"), F.col("r_i"), similarity, _shared(F.col("r_n")) - 1)
    )
    ends = [F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b")]
    enough = F.least(_shared(F.col("r_n")), F.ceil(similarity * F.col("l_n") - 1e-9).cast("int"))
    counted = met.select(*ends, enough.alias("enough")).groupBy("a", "b", "enough").agg(F.count(F.lit(1)).alias("keys"))
    pairs = written(counted.where("keys >= enough").select("a", "b"), "crossed-pairs")
    discard(rows)
    return pairs


def all_links(near: DataFrame, entries: DataFrame, bits: DataFrame, texts: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The verified links and as many more as join every two texts of at least ``similarity``, directly or by a path.

    For each key ``STARS`` of its texts stand, and a text is first compared with those that stand for most of its keys, so that
    large groups are joined without comparing them pair by pair. Then those of different groups are compared with each other;
    the first shared shingles of two near sets, as many as ``_shared`` says, pass the test of places.

    Most keys have one text, so keys are counted first and heads are sought for the others only. ``entries`` is a written table
    ``(node, n, i, key)``, deleted once it is read.
    """
    counts = written(entries.groupBy("key").agg(F.count(F.lit(1)).alias("count")).where("count > 1"), "shared-keys")
    kept = join_hot(entries, counts, [("key", "key")], "count", "inner").select("key", "node", "n", "i")
    drop_shuffles(texts.sparkSession)
    shared = written(kept, "shared-entries")
    discard(entries, counts)
    heads = [F.min(F.struct(F.xxhash64(F.col("node"), F.lit(step)).alias("p"), "node", "n", "i")).alias(f"head{step}") for step in range(STARS)]
    keys = written(shared.groupBy("key").agg(F.count(F.lit(1)).alias("count"), *heads), "key-heads")
    headed = join_hot(shared, keys, [("key", "key")], "count", "inner")
    star = headed.withColumn("h", F.explode(F.array(*[f"head{step}" for step in range(STARS)]))).where(
        (F.col("node") != F.col("h.node")) & _leaves_enough(F.col("n"), F.col("i"), F.col("h.n"), F.col("h.i"), similarity))
    met = star.groupBy("node", F.col("h.node").alias("head")).agg(F.count(F.lit(1)).alias("keys"))
    # a text has no more heads than keys in its prefix
    best = met.groupBy("node").agg(F.slice(F.sort_array(F.collect_list(F.struct("keys", "head")), asc=False), 1, STARS).alias("h"))
    apart = _apart(best.select(F.col("node").alias("a"), F.explode("h.head").alias("b")), near, "star-pairs")
    discard(keys)
    joined = written(near.unionByName(verified(apart, bits, texts, width, similarity)), "star-links")
    crossed = _crossed(shared, joined, similarity)
    more = verified(crossed, bits, texts, width, similarity)
    discard(apart, crossed, shared)
    return joined.unionByName(more)


def keep_one(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, own columns, of the smallest id in each group of copies and near-duplicates.

    Every pair of texts whose shingles agree to ``similarity`` is in one group; fingerprints only save comparisons.

    Texts with the same lower-cased words are copies. Null text counts as empty, and texts without
    words are copies of each other. Rows that repeat an id are one document, compared by one of their
    texts, and stay or go together. Rows without an id stay. Empty table: empty result.
    """
    each = _documents(docs)
    firsts = written(
        each.groupBy("k1", "k2").agg(F.min(F.struct("node", "x1", "x2", "fp")).alias("x")).select("x.*"), "first-copies"
    )
    text = whole(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("node"), *_text_hashes(text), text.alias("text"))
    own = rows.join(firsts.select("node", "x1", "x2"), ["node", "x1", "x2"], "left_semi").groupBy("node", "x1", "x2")
    texts = written(own.agg(F.first("text").alias("text")).select("node", "text"), "first-texts")
    drop_shuffles(docs.sparkSession)
    met = candidates(firsts)
    drop_shuffles(docs.sparkSession)
    sets = written(prefixes(texts, width, similarity), "prefixes")
    bits = written(sets.where("i = 0").select("node", "n", "bits"), "bitmaps")
    entries = sets.drop("bits")
    entries._written_to = sets._written_to
    near = verified(met, bits, texts, width, similarity)
    discard(met)
    roots = written(component_roots(all_links(near, entries, bits, texts, width, similarity)), "near-roots")
    discard(bits, texts)
    lows = roots.groupBy("root").agg(F.min("node").alias("low"))
    others = roots.join(lows, "root").where("node <> low").select("node")
    stay = firsts.select("node").join(others, "node", "left_anti")
    gone = written(each.select("node").join(stay, "node", "left_anti").select(F.col("node").alias("__goes")), "near-gone")
    discard(each, firsts, roots)
    return docs.join(gone, docs["doc_id"].cast("bigint") == gone["__goes"], "left_anti")
