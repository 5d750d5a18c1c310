"""Benchmark decontamination by spaced seeds that tolerate substituted words.

The unit of overlap is a window of 13 tokens. Fixed masks pick six of its tokens and ignore the
others; the picked tokens' hash joins test windows with training texts. The masks are such that at
every pattern of two substitutions within a window, one of them avoids both. Around each hit all
13 tokens are compared, and the window counts if at most two differ. A test text of 8 to 12 tokens is one window: one
mask more than the substitutions it may have, each with positions of its own, find it. Shorter ones
are looked for as they are. All of it is column expressions and joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, let, rows_each, whole, written

WINDOW = 13
LEAST = 8
SIMILARITY = 0.8
"""A window of ``LEAST`` tokens or more counts if at least ``ceil(0.8 n)`` of its ``n`` are equal in place, a shorter one if all are."""

MASKS = ((0, 1, 4, 5, 6, 8), (0, 2, 4, 9, 10, 11))
"""Positions that each seed picks; with all their places in a window, two substitutions never hit every one."""

BROADCAST_SEEDS = 500_000
"""Test seeds of up to this many rows (about 90 MB) are broadcast; more are joined by shuffle."""

REACH = max(WINDOW - 1 - m[-1] for m in MASKS)
"""Tokens of a window that can lie before its seed."""

SPLIT_TOKENS = r"[^\p{L}\p{N}]+"


def tokens(text: Column) -> Column:
    """Hashes of the lower-cased runs of letters and digits; the empty pieces at the ends left out."""
    bare = F.regexp_replace(F.lower(whole(text)), rf"^{SPLIT_TOKENS}", "")
    return let(F.transform(F.split(bare, SPLIT_TOKENS), lambda w: F.xxhash64(w)), lambda h: F.when(
        F.element_at(h, -1) == F.xxhash64(F.lit("")), F.slice(h, 1, F.size(h) - 1)
    ).otherwise(h))


def _seed(h: Column, start: Column, mask: tuple[int, ...], number: int) -> Column:
    """The hash of the tokens that a mask picks from ``start`` on, null where they run out."""
    return F.when(start + mask[-1] < F.size(h), F.xxhash64(F.lit(number), *[F.get(h, start + o) for o in mask]))


def equal_tokens(n: int) -> int:
    """How many tokens of a window of ``n`` must be equal."""
    return -(-4 * n // 5) if n >= LEAST else n


def short_masks(n: int) -> list[tuple[tuple[int, ...], list[int]]]:
    """Masks for a window of ``n`` tokens, each from its first position on, with the places it begins at.

    There is one more than substitutions, and no two share a position, so one of them avoids all.
    """
    count = n - equal_tokens(n) + 1
    masks: dict[tuple[int, ...], list[int]] = {}
    for first in range(count):
        masks.setdefault(tuple(range(0, n - first, count)), []).append(first)
    return sorted(masks.items())


def _patterns(lengths: list[int]) -> list[tuple[int, int, tuple[int, ...], list[int]]]:
    """``(number, window, mask, places)`` of all masks for windows of these lengths."""
    found = [(WINDOW, m, list(range(WINDOW - m[-1]))) for m in MASKS]
    found += [(n, mask, at) for n in lengths if n < WINDOW for mask, at in short_masks(n)]
    return [(number, *x) for number, x in enumerate(found)]


def windows(benchmark: DataFrame) -> DataFrame:
    """``(item_id, w)``: the distinct token windows of the test texts, each with its smallest item.

    Texts of up to 12 tokens are one window; those without tokens have none.
    """
    h = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), tokens(F.col("text")).alias("h")).where(F.size("h") > 0)
    start = F.explode(F.sequence(F.lit(0), F.greatest(F.size("h") - WINDOW, F.lit(0))))
    cut = h.select("item_id", "h", start.alias("at")).select("item_id", F.slice("h", F.col("at") + 1, WINDOW).alias("w"))
    return cut.groupBy("w").agg(F.min("item_id").alias("item_id"))


def _keys(docs: DataFrame) -> list[Column]:
    """What tells documents apart: their id, and where it is missing a hash of the text."""
    doc_id = docs["doc_id"].cast("bigint")
    return [F.coalesce(doc_id, F.lit(NO_ID)).alias("doc_id"), F.when(doc_id.isNull(), F.xxhash64(whole(docs["text"]))).otherwise(0).alias("tag")]


def overlaps(docs: DataFrame, benchmark: DataFrame, broadcast_seeds: int = BROADCAST_SEEDS) -> DataFrame:
    """``(doc_id, tag, item_id, start, n_equal)``: token windows of the texts that overlap the test texts.

    For each window of a text with a match, the smallest of the items found there and the most equal tokens.
    """
    found = written(windows(benchmark), "test-windows")
    lengths = sorted(r["n"] for r in found.select(F.size("w").alias("n")).distinct().collect())
    patterns = _patterns(lengths)
    seeds = None
    for number, n, mask, at in patterns:
        part = found.where(F.size("w") == n).select("item_id", "w", F.explode(F.array(*map(F.lit, at))).alias("off")).withColumn(
            "seed", _seed(F.col("w"), F.col("off"), mask, number)
        )
        seeds = part if seeds is None else seeds.unionByName(part)
    seeds = written(seeds, "test-seeds")
    shortest = min(lengths, default=WINDOW)
    h = docs.select(*_keys(docs), tokens(docs["text"]).alias("h")).where(F.size("h") >= shortest).withColumn("n", F.size("h"))
    starts = h.select("doc_id", "tag", "h", "n", F.explode(F.sequence(F.lit(0), F.size("h") - min(shortest, LEAST))).alias("at"))
    own = F.explode(F.array(*[_seed(F.col("h"), F.col("at"), mask, number) for number, _, mask, _ in patterns]))
    if rows_each(seeds) <= broadcast_seeds:
        probes = starts.select("doc_id", "tag", "n", "at", "h", F.lit(0).alias("from"), own.alias("seed"))
        seeds = F.broadcast(seeds)
    else:  # through the shuffle goes what can lie in a window around the seed, not the text
        probes = starts.select("doc_id", "tag", "n", "at", "h", own.alias("seed")).select(
            "doc_id", "tag", "n", "at", F.slice("h", F.greatest(F.col("at") - REACH, F.lit(0)) + 1, WINDOW + REACH).alias("h"),
            F.greatest(F.col("at") - REACH, F.lit(0)).alias("from"), "seed",
        )
    start = F.col("at") - F.col("off")
    hits = probes.join(seeds, "seed").where((start >= 0) & (start + F.size("w") <= F.col("n")))
    same = sum((
        F.coalesce(F.get("h", start - F.col("from") + i) == F.get("w", F.lit(i)), F.lit(False)).cast("int")
        for i in range(WINDOW)
    ), F.lit(0))
    least = F.when(F.size("w") < LEAST, F.size("w")).otherwise(F.ceil(F.size("w") * 4 / 5))
    return hits.select("doc_id", "tag", "item_id", start.alias("start"), same.alias("n_equal"), least.alias("least")).where(
        F.col("n_equal") >= F.col("least")
    ).groupBy("doc_id", "tag", "start").agg(F.min("item_id").alias("item_id"), F.max("n_equal").alias("n_equal"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``(doc_id, tag, n_windows, item_id)`` of each text with an overlap: how many windows, the smallest item."""
    return overlaps(docs, benchmark).groupBy("doc_id", "tag").agg(
        F.count(F.lit(1)).alias("n_windows"), F.min("item_id").alias("item_id")
    )


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per row: ``doc_id, contaminated, n_windows, item_id`` (null where clean).

    Null text: clean. Rows without an id are judged each by its text. Rows that repeat an id count as one document
    and get its verdict. Null item ids still taint. Test texts without tokens are not looked for. Empty tables:
    nothing is contaminated. Further columns are not read.
    """
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("tag").alias("__tag"), "n_windows", "item_id")
    ids = docs.select(*_keys(docs))
    return ids.join(found, (F.col("doc_id") == F.col("__id")) & (F.col("tag") == F.col("__tag")), "left").select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), F.col("__id").isNotNull().alias("contaminated"),
        F.coalesce("n_windows", F.lit(0)).cast("bigint").alias("n_windows"), "item_id",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without any overlap, with their own columns.

    As in ``report``: rows that repeat an id stay or go together, and rows without an id are judged each by its text.
    """
    found = contaminated(docs, benchmark).select(F.col("doc_id").alias("__tainted"), F.col("tag").alias("__tag"))
    doc_id, tag = _keys(docs)
    return docs.join(found, (doc_id == found["__tainted"]) & (tag == found["__tag"]), "left_anti")
