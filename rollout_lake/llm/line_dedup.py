"""Incremental line deduplication: sharded cuckoo filters in front of exact reference counts.

A line's key is the line without blanks at its ends and with A-Z in lower case. The state of a
corpus is a table with one row a key (number of documents, largest document id) and one cuckoo
filter a shard of keys, which holds the keys found in ``min_docs`` documents or more. Documents
can be inserted and deleted; after a deletion the state equals that of a corpus which never had
them. A line is looked up in the filters first; what they may hold is checked in the exact table,
so a filter's false positives never drop a line.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, NO_ID, ascii_lower, empty, join_hot, let, rows_each, whole, written

MIN_CHARS = 20
MIN_DOCS = 3
SHARD_KEYS = 8192
"""Keys a filter is planned for; a shard is built and changed in one task."""

BROADCAST_KEYS = 4_000_000
"""Filters of up to this many keys (about 32 MB) are broadcast, larger ones join by shard."""

SLOTS = 4
MIX = 0x5BD1


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit(NO_ID))


def _hashes(key: Column) -> list[Column]:
    """128 bits of a key."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(key, F.lit(1)).alias("h2")]


class CuckooFilter:
    """A set of 16-bit marks in buckets of four slots; a mark has two buckets it may lie in."""

    def __init__(self, buckets: int, slots: np.ndarray | None = None):
        self.buckets = buckets
        self.slots = np.zeros(buckets * SLOTS, np.int32) if slots is None else np.array(slots, np.int32)

    @staticmethod
    def size_for(keys: int) -> int:
        return max(4, 1 << max(0, int(np.ceil(np.log2(max(keys, 1) / (SLOTS * 0.8))))))

    def _places(self, h2: int) -> tuple[int, int]:
        mark = (h2 & 0xFFFF) or 1
        return mark, (h2 >> 16) & (self.buckets - 1)

    def other(self, bucket: int, mark: int) -> int:
        return bucket ^ ((mark * MIX) & (self.buckets - 1))

    def _put(self, bucket: int, mark: int) -> bool:
        for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.slots[at] == 0:
                self.slots[at] = mark
                return True
        return False

    def insert(self, h2: int) -> bool:
        """False if no place was found; the filter must then be built anew, larger."""
        mark, bucket = self._places(h2)
        if self._put(bucket, mark) or self._put(self.other(bucket, mark), mark):
            return True
        for kick in range(500):
            at = bucket * SLOTS + (kick + mark) % SLOTS
            mark, self.slots[at] = int(self.slots[at]), mark
            bucket = self.other(bucket, mark)
            if self._put(bucket, mark):
                return True
        return False

    def delete(self, h2: int) -> bool:
        mark, bucket = self._places(h2)
        for b in (bucket, self.other(bucket, mark)):
            for at in range(b * SLOTS, b * SLOTS + SLOTS):
                if self.slots[at] == mark:
                    self.slots[at] = 0
                    return True
        return False

    def contains(self, h2: int) -> bool:
        mark, bucket = self._places(h2)
        return any(mark in self.slots[b * SLOTS:(b + 1) * SLOTS] for b in (bucket, self.other(bucket, mark)))


def build_filter(keys: list[int]) -> CuckooFilter:
    """A filter of all keys, doubled until every one has a place."""
    buckets = CuckooFilter.size_for(len(keys))
    while True:
        made = CuckooFilter(buckets)
        if all(made.insert(k) for k in keys):
            return made
        buckets *= 2


FILTER = "shard long, buckets long, slots array<int>, refused long"


def _build(key, frame: pd.DataFrame) -> pd.DataFrame:
    made = build_filter(frame["h2"].astype(np.int64).map(int).tolist())
    return pd.DataFrame({"shard": [key[0]], "buckets": [made.buckets], "slots": [made.slots], "refused": [0]})


def _change(key, filters: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    if len(filters):
        made = CuckooFilter(int(filters["buckets"].iloc[0]), filters["slots"].iloc[0])
    else:
        made = CuckooFilter(CuckooFilter.size_for(SHARD_KEYS))
    refused = 0
    for h2, enters in sorted(zip(changes["h2"].tolist(), changes["enters"].tolist()), key=lambda c: c[1]):
        refused += not (made.insert(int(h2)) if enters else made.delete(int(h2)))
    return pd.DataFrame({"shard": [key[0]], "buckets": [made.buckets], "slots": [made.slots], "refused": [refused]})


@dataclass(frozen=True)
class LineState:
    """Written tables: ``counts`` (h1, h2, n_docs, keeper) and ``filters``; both exact for one corpus."""

    counts: DataFrame
    filters: DataFrame
    shards: int
    keys: int
    min_docs: int = MIN_DOCS
    min_chars: int = MIN_CHARS

    def shared(self) -> DataFrame:
        """The keys of ``min_docs`` documents or more."""
        return self.counts.where(F.col("n_docs") >= self.min_docs)


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Reference count and largest document id of every key of at least ``min_chars`` code points.

    Repeats within a row fold inside it. Where the id of a document is on several rows, its keys
    are counted once; that takes one more shuffle, which a table with unique ids is spared.
    """
    keys = F.array_distinct(F.filter(
        F.transform(F.split(whole(F.col("text")), "\n"), line_key), lambda k: F.length(k) >= min_chars
    ))
    rows = docs.select(_id(F.col("doc_id")).alias("id"), F.explode(keys).alias("k")).select("id", *_hashes(F.col("k")))
    repeated = docs.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    n = F.count_distinct("id") if repeated else F.count(F.lit(1))
    return rows.groupBy("h1", "h2").agg(n.alias("n_docs"), F.max("id").alias("keeper"))


def _with_filters(counts: DataFrame, min_docs: int, min_chars: int) -> LineState:
    state = LineState(counts, counts, 1, 0, min_docs, min_chars)
    keys = rows_each(state.shared())
    shards = max(1, -(-keys // SHARD_KEYS))
    filters = state.shared().select(F.pmod("h1", F.lit(shards)).alias("shard"), "h2").groupBy("shard").applyInPandas(
        _build, FILTER
    )
    return replace(state, filters=written(filters, "line-filters"), shards=shards, keys=keys)


def new_state(docs: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineState:
    """The state of one corpus."""
    return _with_filters(written(line_counts(docs, min_chars), "line-counts"), min_docs, min_chars)


def _moved(state: LineState, counts: DataFrame) -> LineState:
    """The state with new counts; keys that crossed ``min_docs`` enter or leave their shard's filter."""
    before = state.shared().select("h1", "h2", F.lit(-1).alias("d"))
    after = counts.where(F.col("n_docs") >= state.min_docs).select("h1", "h2", F.lit(1).alias("d"))
    crossed = before.unionByName(after).groupBy("h1", "h2").agg(F.sum("d").alias("d")).where("d <> 0").select(
        F.pmod("h1", F.lit(state.shards)).alias("shard"), "h2", (F.col("d") > 0).alias("enters")
    )
    crossed = written(crossed, "line-crossed")
    keys = state.keys + (rows_each(crossed.where("enters")) - rows_each(crossed.where("not enters")))
    if keys > 2 * SHARD_KEYS * state.shards:
        return _with_filters(counts, state.min_docs, state.min_chars)
    filters = written(
        state.filters.groupBy("shard").cogroup(crossed.groupBy("shard")).applyInPandas(_change, FILTER), "line-filters"
    )
    if rows_each(filters, "refused"):
        return _with_filters(counts, state.min_docs, state.min_chars)
    return replace(state, counts=counts, filters=filters, keys=keys)


def insert(state: LineState, docs: DataFrame) -> LineState:
    """The state with further documents, whose ids must be new to it."""
    both = state.counts.unionByName(line_counts(docs, state.min_chars))
    merged = both.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"))
    return _moved(state, written(merged, "line-counts"))


def delete(state: LineState, gone: DataFrame, remaining: DataFrame) -> LineState:
    """The state without the documents ``gone``, which it must hold.

    ``remaining`` are the documents that stay; they are read for the keys that lose their
    largest document id, and for no others.
    """
    minus = line_counts(gone, state.min_chars).select(
        "h1", "h2", (-F.col("n_docs")).alias("n_docs"), F.col("keeper").alias("lost")
    )
    both = state.counts.withColumn("lost", F.lit(None).cast("bigint")).unionByName(
        minus.withColumn("keeper", F.lit(None).cast("bigint"))
    )
    left = written(both.groupBy("h1", "h2").agg(
        F.sum("n_docs").alias("n_docs"), F.max("keeper").alias("keeper"), F.max("lost").alias("lost")
    ).where("n_docs > 0"), "line-left")
    headless = left.where(F.col("lost") == F.col("keeper")).select("h1", "h2", "n_docs")
    again = line_counts(remaining, state.min_chars).join(headless.select("h1", "h2"), ["h1", "h2"], "left_semi")
    kept = left.where(F.col("lost").isNull() | (F.col("lost") < F.col("keeper"))).select("h1", "h2", "n_docs", "keeper")
    return _moved(state, written(kept.unionByName(again.select("h1", "h2", "n_docs", "keeper")), "line-counts"))


def may_contain(h2: Column, slots: Column, buckets: Column) -> Column:
    """A filter's answer for a key, by the rule of ``CuckooFilter.contains``."""
    low = h2.bitwiseAND(F.lit(0xFFFF))
    mark = F.when(low == 0, F.lit(1)).otherwise(low)
    cut = buckets - 1
    first = F.shiftrightunsigned(h2, 16).bitwiseAND(cut)
    second = first.bitwiseXOR((mark * MIX).bitwiseAND(cut))
    hit = F.lit(False)
    for bucket in (first, second):
        for at in range(SLOTS):
            hit |= F.get(slots, (bucket * SLOTS + at).cast("int")) == mark
    return hit


def dropped_lines(docs: DataFrame, state: LineState) -> DataFrame:
    """Row key (``__ld_id``, ``__ld_text``) and the positions of the lines that go, for rows that lose any."""
    lines = docs.select(
        _id(F.col("doc_id")).alias("__ld_id"), F.xxhash64(whole(F.col("text"))).alias("__ld_text"),
        F.posexplode(F.split(whole(F.col("text")), "\n")).alias("pos", "line"),
    ).withColumn("k", line_key(F.col("line"))).where(F.length("k") >= state.min_chars)
    lines = lines.select("__ld_id", "__ld_text", "pos", *_hashes(F.col("k")))
    filters = state.filters.select("shard", "buckets", "slots")
    if state.keys <= BROADCAST_KEYS:
        filters = F.broadcast(filters)
    maybe = lines.join(filters, F.pmod("h1", F.lit(state.shards)) == F.col("shard")).where(
        may_contain(F.col("h2"), F.col("slots"), F.col("buckets"))
    ).select(*lines.columns)
    exact = state.shared().select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), "n_docs", "keeper")
    found = join_hot(maybe, exact, [("h1", "s1"), ("h2", "s2")], "n_docs", "inner")
    return found.where(F.col("__ld_id") != F.col("keeper")).groupBy("__ld_id", "__ld_text").agg(
        F.collect_set("pos").alias("__ld_gone")
    )


def drop_lines(docs: DataFrame, state: LineState) -> DataFrame:
    """All rows and columns of ``docs``, with ``text`` rid of repeated lines, ``n_lines`` and ``n_dropped`` as longs.

    A key of ``min_chars`` code points or more that ``min_docs`` documents hold loses all its
    lines except those of the largest document id that holds it. Lines of other keys stay.

    Null text: one empty line, and the text becomes empty. Null id: all such rows are one
    document, below all ids. Rows that repeat an id count as one document; each loses its lines.
    Empty table: empty result. Columns named ``n_lines`` or ``n_dropped`` are replaced.
    """
    gone = dropped_lines(docs, state)
    keyed = docs.withColumns({
        "__ld_id": _id(F.col("doc_id")), "__ld_text": F.xxhash64(whole(F.col("text"))), "text": whole(F.col("text")),
    })
    lines = F.split(F.col("text"), "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__ld_gone"))
    text = F.when(F.col("__ld_gone").isNull(), F.col("text")).otherwise(
        let(lines, lambda cut: F.array_join(F.transform(stay, lambda i: F.get(cut, i)), "\n"))
    )
    out = keyed.join(gone, ["__ld_id", "__ld_text"], "left").withColumns({
        "n_lines": F.size(lines).cast("bigint"),
        "n_dropped": F.when(F.col("__ld_gone").isNull(), F.lit(0)).otherwise(F.size("__ld_gone")).cast("bigint"),
        "text": text,
    })
    return out.drop("__ld_id", "__ld_text", "__ld_gone")


def empty_state(spark: SparkSession, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS) -> LineState:
    """The state of no documents."""
    counts = empty(spark, "h1 long, h2 long, n_docs long, keeper long")
    return LineState(counts, empty(spark, FILTER), 1, 0, min_docs, min_chars)
