"""Balanced partitions of sequence lengths and packing under a token budget.

A batch is cut to a fixed number of rows before it reaches a grouped function, so the
group one task sees is bounded by the batch size and never by a key.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .ordering import index_by_id, row_index, with_ordered_chunks


def largest_differencing(lengths: Sequence[int], k: int, equal_size: bool) -> list[list[int]]:
    """k bins of item numbers with near-equal sums by the largest differencing method.

    The two states with the widest spread are merged, largest bin onto smallest, until
    one is left. Ties prefer the state with the larger top bin; bins compare by sum, then
    item count, then items.
    """
    n = len(lengths)
    if n < k:
        raise ValueError(f"{n} items cannot fill {k} bins")
    if equal_size and n % k:
        raise ValueError(f"{n} items cannot fill {k} bins equally")
    ranked = sorted(range(n), key=lambda i: (lengths[i], i))
    step = k if equal_size else 1

    def rank(b):
        return (b[0], len(b[1]), b[1])

    def entry(bins, serial):
        bins = sorted(bins, key=rank, reverse=True)
        top = bins[0]
        flipped = [(-i, -v) for i, v in top[1]]
        return (bins[-1][0] - top[0], (-top[0], -len(top[1]), flipped), serial, bins)

    heap = []
    for serial, at in enumerate(range(0, n, step)):
        bins = [(lengths[i], [(i, lengths[i])]) for i in ranked[at:at + step]]
        bins += [(0, []) for _ in range(k - len(bins))]
        heap.append(entry(bins, serial))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[3], heapq.heappop(heap)[3]
        merged = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b))]
        heapq.heappush(heap, entry(merged, serial))
        serial += 1
    return [sorted(i for i, _ in b[1]) for b in heap[0][3]]


def narrower(lengths: Sequence[int], k: int, equal_size: bool) -> list[list[int]]:
    """The bins of ``largest_differencing``, or runs of consecutive items of equal number where their sums are closer."""
    bins = largest_differencing(lengths, k, equal_size)
    size = len(lengths) // k
    runs = [list(range(at, at + size)) for at in range(0, size * k, size)]

    def spread(parts):
        sums = [sum(lengths[i] for i in p) for p in parts]
        return max(sums) - min(sums)

    return runs if len(lengths) % k == 0 and spread(runs) < spread(bins) else bins


def greedy_bins(lengths: Sequence[int], k: int, equal_size: bool) -> list[list[int]]:
    """Each item, in input order, to the lightest bin; a large bias keeps counts equal."""
    bias = sum(lengths) + 1 if equal_size else 0
    heap = [(0, j) for j in range(k)]
    out: list[list[int]] = [[] for _ in range(k)]
    for i, v in enumerate(lengths):
        total, j = heapq.heappop(heap)
        out[j].append(i)
        heapq.heappush(heap, (total + v + bias, j))
    if equal_size and any(len(b) * k != len(lengths) for b in out):
        raise ValueError("the items cannot be shared out equally")
    return out


def _filled(pdf: pd.DataFrame, missing: int) -> pd.DataFrame:
    """The rows of a batch and as many places behind them that hold no row: id and length are null."""
    first = int(pdf["row_index"].iloc[-1]) + 1
    places = pd.DataFrame({"batch_id": pdf["batch_id"].iloc[0], "row_index": range(first, first + missing)}, columns=pdf.columns, dtype=object)
    return pd.concat([pdf.astype(object), places.where(places.notna(), None)], ignore_index=True)


def _assign(method, k: int | None, equal_size: bool, max_tokens: int | None, fill_to: int = 0):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row_index", kind="stable").reset_index(drop=True)
        lengths = [int(v) for v in pdf["length"]]
        if missing := max(0, fill_to - len(lengths)):
            pdf, lengths = _filled(pdf, missing), lengths + [0] * missing
        bins = k if k is not None else max(1, -(-sum(lengths) // max_tokens))
        part = [0] * len(lengths)
        for p, items in enumerate(method(lengths, min(bins, len(lengths)), equal_size)):
            for i in items:
                part[i] = p
        return pdf.assign(partition=part)

    return run


def _with_partition(rows: DataFrame) -> StructType:
    return StructType([*[StructField(f.name, f.dataType) for f in rows.schema.fields], StructField("partition", LongType())])


def _batches(df: DataFrame, id_col: str, length: str, batch_size: int) -> DataFrame:
    placed = index_by_id(df.select(id_col, F.col(length).cast("bigint").alias("length")), id_col)
    return placed.select(id_col, F.floor(F.col("row_index") / batch_size).alias("batch_id"), F.col("row_index").cast("bigint").alias("row_index"), "length")


def balance(df: DataFrame, id_col: str, length: str, batch_size: int, k: int, equal_size: bool = False, method=largest_differencing,
            fill: bool = False) -> DataFrame:
    """Id, batch, row index, length and partition number of every row of every batch of ``batch_size`` rows.

    A last batch with fewer rows may have no partitions of equal size, which fails the query. With ``fill`` it is filled up
    to ``batch_size`` with places of no tokens, whose id and length are null, as the reference pads a batch to its ranks.
    """
    rows = _batches(df, id_col, length, batch_size)
    return rows.groupBy("batch_id").applyInPandas(_assign(method, k, equal_size, None, batch_size if fill else 0), _with_partition(rows))


def micro_batches(df: DataFrame, id_col: str, length: str, batch_size: int, max_tokens: int) -> DataFrame:
    """As many balanced micro-batches per batch as its tokens need under the budget."""
    rows = _batches(df, id_col, length, batch_size)
    return rows.groupBy("batch_id").applyInPandas(_assign(largest_differencing, None, False, max_tokens), _with_partition(rows))


def inverse_order(order: DataFrame, old: str, new: str) -> DataFrame:
    """The permutation that undoes an order."""
    return order.select(F.col(new).alias(old), F.col(old).alias(new))


def balanced_order(parts: DataFrame, batch_size: int, k: int) -> DataFrame:
    """New row positions that put equal-sized balanced partitions one after the other."""
    from pyspark.sql.window import Window

    # a window over one partition of one batch: at most batch_size / k rows
    slot = F.row_number().over(Window.partitionBy("batch_id", "partition").orderBy("row_index")) - 1
    position = F.col("batch_id") * batch_size + F.col("partition") * (batch_size // k) + slot
    return parts.withColumn("new_pos", position)


def imbalance(parts: DataFrame, batch_size: int, k: int) -> DataFrame:
    """Token sums per batch before (consecutive slices) and after balancing.

    ``min``, ``max`` and ``minmax_diff`` are over the slices with rows; ``slice_spread`` takes a slice of places without
    rows as one without tokens, as ``balanced_min`` and ``balanced_max`` do with partitions.
    """
    inside = F.col("row_index") - F.col("batch_id") * batch_size
    sliced = parts.withColumn("slice", F.floor(inside / (batch_size // k)))
    before = sliced.groupBy("batch_id", "slice").agg(F.sum("length").alias("s")).groupBy("batch_id").agg(
        F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("minmax_diff"),
        (F.sum("s") / k).alias("mean"), (F.max(F.coalesce("s", F.lit(0))) - F.min(F.coalesce("s", F.lit(0)))).alias("slice_spread"),
    )
    after = parts.groupBy("batch_id", "partition").agg(F.sum(F.coalesce("length", F.lit(0))).alias("s")).groupBy("batch_id").agg(
        F.min("s").alias("balanced_min"), F.max("s").alias("balanced_max")
    )
    return before.join(after, "batch_id")


def pack_samples(df: DataFrame, id_col: str, length: str, capacity: int, shard: Column) -> DataFrame:
    """Id, shard, length and pack number of every sample; no pack holds more than ``capacity`` tokens.

    Samples are packed within the shards that the caller names, in order of the id: the next sample goes
    into the open pack while it fits. A shard is one task's work, and its samples alone decide
    its packs. A sample longer than the capacity fails the query.
    """
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(id_col, kind="stable").reset_index(drop=True)
        packs, used, pack = [], 0, 0
        for v in pdf["length"]:
            if v > capacity:
                raise ValueError(f"a sample of {v} tokens exceeds the capacity {capacity}")
            if used + v > capacity:
                pack, used = pack + 1, 0
            used += int(v)
            packs.append(pack)
        return pdf.assign(partition=packs)

    rows = df.select(id_col, shard.cast("bigint").alias("shard"), F.col(length).cast("bigint").alias("length"))
    return rows.groupBy("shard").applyInPandas(run, _with_partition(rows))


class Rooms:
    """The free room of packs, in order, as runs of packs with equal room; a tree of maxima finds the first run that fits.

    A run is told by its first pack. Runs split as packs fill up, so their places in the tree are given out in
    blocks with gaps and dealt anew when a gap is used up.
    """

    def __init__(self) -> None:
        self.runs: list[tuple[int, int, int]] = []  # first pack, packs, free room
        self.size, self.tree = 1, [0, 0]

    def _build(self) -> None:
        while self.size < len(self.runs):
            self.size *= 2
        self.tree = [0] * self.size + [r[2] for r in self.runs] + [0] * (self.size - len(self.runs))
        for i in range(self.size - 1, 0, -1):
            self.tree[i] = max(self.tree[2 * i], self.tree[2 * i + 1])

    def first(self, room: int, since: int) -> int:
        """The first run from number ``since`` on with at least this room, or -1."""
        i = since + self.size
        if since >= len(self.runs):
            return -1
        while self.tree[i] < room:
            while i & 1:  # the last of its siblings: go up
                i >>= 1
                if i <= 1:
                    return -1
            i += 1
            if i & (i - 1) == 0:  # wrapped around to the next level: nothing is left to the right
                return -1
        while i < self.size:
            i = 2 * i if self.tree[2 * i] >= room else 2 * i + 1
        return i - self.size

    def fill(self, length: int, count: int, capacity: int) -> list[tuple[int, int, int]]:
        """Place ``count`` samples of one length, each in the first pack with room: ``(first pack, packs, samples in each)``."""
        placed, changed, at = [], {}, 0
        while count and (at := self.first(length, at)) >= 0:
            pack, packs, free = self.runs[at]
            each = free // length
            whole = min(packs, count // each)
            left = min(count - whole * each, each - 1) if whole < packs else 0
            parts = [(pack, whole, free - each * length)] if whole else []
            if whole:
                placed.append((pack, whole, each))
            if left:
                placed.append((pack + whole, 1, left))
                parts.append((pack + whole, 1, free - left * length))
            rest = packs - whole - (left > 0)
            if rest:
                parts.append((pack + whole + (left > 0), rest, free))
            changed[at] = parts
            count -= whole * each + left
            at += 1
        if count:  # new packs behind the last one
            each = capacity // length
            pack = sum(self.runs[-1][:2]) if self.runs else 0
            whole, left = divmod(count, each)
            fresh = [(pack, whole, capacity - each * length, each), (pack + whole, 1, capacity - left * length, left)]
            for first, packs, free, samples in fresh:
                if packs and samples:
                    placed.append((first, packs, samples))
                    self.runs.append((first, packs, free))
        self.runs = [r for i, run in enumerate(self.runs) for r in changed.get(i, [run])]
        self._build()
        return placed


def first_fit(lengths: Sequence[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """``(length, first rank, first pack, packs, samples in each)`` for classes ``(length, count)``, longest first.

    The samples of a class are ranked from 0, in pack order. A length of zero takes no room; one above the capacity is an error.
    """
    rooms, out = Rooms(), []
    for length, count in sorted(lengths, reverse=True):
        if length > capacity:
            raise ValueError(f"a sample of {length} tokens exceeds the capacity {capacity}")
        rank = 0
        placed = rooms.fill(length, count, capacity) if length else [(0, 1, count)]
        for pack, packs, each in placed:
            out.append((length, rank, pack, packs, each))
            rank += packs * each
    return out


def pack_first_fit(df: DataFrame, id_col: str, length: str, capacity: int, shard: Column) -> DataFrame:
    """Id, shard, length and pack number of every sample, each in the first pack of its shard with room, longest samples first.

    A shard's work is one row for each distinct length, at most ``capacity`` of them, however many samples it has. Samples
    of one length are dealt out in order of their ids, which are unique. A sample longer than the capacity fails the query.
    """
    rows = df.select(id_col, shard.cast("bigint").alias("shard"), F.col(length).cast("bigint").alias("length"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        made = first_fit([(int(n), int(c)) for n, c in zip(pdf["length"], pdf["count"])], capacity)
        out = pd.DataFrame(made, columns=["length", "first", "pack", "packs", "each"])
        out["shard"] = pdf["shard"].iloc[0]
        return out

    classes = rows.groupBy("shard", "length").count()
    placed = classes.groupBy("shard").applyInPandas(run, "length bigint, first bigint, pack bigint, packs bigint, each bigint, shard bigint")
    listed = placed.groupBy("shard", "length").agg(F.sort_array(F.collect_list(F.struct("first", "pack", "each"))).alias("at"))
    chunked = with_ordered_chunks(rows, id_col)
    ranked = row_index(chunked, [id_col], F.col("__bucket"), ["shard", "length"], "__rank").drop("__bucket")
    met = ranked.join(listed, ["shard", "length"])
    own = F.element_at(F.filter("at", lambda x: x["first"] <= F.col("__rank")), -1)
    return met.withColumn("__own", own).select(
        id_col, "shard", "length",
        (F.col("__own.pack") + F.floor((F.col("__rank") - F.col("__own.first")) / F.col("__own.each"))).cast("bigint").alias("partition"))
