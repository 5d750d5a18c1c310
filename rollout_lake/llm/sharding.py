"""Shards of nearly equal size in which groups stay together: longest processing time first, over a heap.

Groups, largest first, go to the shard with the least load. Groups of one size are interchangeable, so the schedule
works on the sizes and how many groups have each: as many as lift the lower shards to one level are placed at
once, which is where the heap would put them one by one, and the heap places the rest. The driver sees distinct sizes only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rollout_lake.operators.ordering import row_index

from .common import join_hot, rows_each, whole, written

BROADCAST_SIZES = 200_000
"""Places of up to so many distinct sizes are broadcast to the groups; more are joined by shuffle."""

MOST_CHUNKS = 4096


def _level(loads: list[int], size: int, count: int) -> int:
    """The highest level to which ``count`` items can lift all lower loads, each until it is not below it."""
    low, high = min(loads), max(loads) + size * (count + 1)
    while low < high:
        middle = (low + high + 1) // 2
        if sum(-(-max(0, middle - load) // size) for load in loads) <= count:
            low = middle
        else:
            high = middle - 1
    return low


def schedule(classes: Iterable[tuple[int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """For each ``(size, count)``, largest size first, how many of its groups each shard gets.

    The loads are those of placing all groups one by one, largest first, on the least-loaded shard (ties by number).
    """
    loads, out = [0] * shards, []
    for size, count in sorted(classes, reverse=True):
        if size <= 0:
            out.append((size, [count // shards + (s < count % shards) for s in range(shards)]))
            continue
        level = _level(loads, size, count)
        given = [-(-max(0, level - load) // size) for load in loads]
        heap = [(load + size * n, s) for s, (load, n) in enumerate(zip(loads, given))]
        heapq.heapify(heap)
        for _ in range(count - sum(given)):
            load, s = heap[0]
            given[s] += 1
            heapq.heapreplace(heap, (load + size, s))
        loads = [load + size * n for load, n in zip(loads, given)]
        out.append((size, given))
    return out


def assign_shards(rows: DataFrame, group: list[str], size: str, shards: int) -> DataFrame:
    """All rows and columns and an int ``shard``; rows equal in the columns ``group`` share one.

    What reaches the driver is the distinct sizes of groups, no more than the bytes of the largest group. Null
    groups are equal to each other, a null size counts as zero. Empty table: empty result. ``rows`` is a written table.
    """
    spark = rows.sparkSession
    key = F.concat_ws(":", *[F.coalesce(F.col(g).cast("string"), F.lit("?")) for g in group])
    groups = written(rows.groupBy(key.alias("__g")).agg(
        F.sum(F.coalesce(F.col(size), F.lit(0))).alias("__bytes"), F.count(F.lit(1)).alias("__n")
    ).withColumn("__h", F.xxhash64("__g")), "group-sizes")
    classes = groups.groupBy("__bytes").agg(F.count(F.lit(1)).alias("n")).toPandas()
    placed = []
    for each, given in schedule([(int(b), int(n)) for b, n in zip(classes["__bytes"], classes["n"])], shards):
        upto, total = [], 0
        for n in given:
            total += n
            upto.append(total)
        placed.append((each, upto, total))
    table = pd.DataFrame(placed, columns=["__size", "__upto", "__count"])
    places = spark.createDataFrame(table, "__size bigint, __upto array<bigint>, __count bigint")
    ranked = row_index(groups, ["__h", "__g"], F.shiftright("__h", 52), ["__bytes"], "__rank")
    if len(placed) <= BROADCAST_SIZES:
        met = ranked.join(F.broadcast(places), F.col("__bytes") == F.col("__size"))
    else:
        met = join_hot(ranked, written(places, "size-places"), [("__bytes", "__size")], "__count", "inner")
    shard = F.size(F.filter("__upto", lambda n: n <= F.col("__rank"))).cast("int")
    own = written(met.select(F.col("__g").alias("__own"), shard.alias("__shard"), "__n"), "group-shards")
    return join_hot(rows.withColumn("__g", key), own, [("__g", "__own")], "__n", "inner").drop("__g", "__n").withColumnRenamed("__shard", "shard")


def add_slots(rows: DataFrame, order: list[Column], chunks: int) -> DataFrame:
    """All rows and a long ``slot``, gapless from 0 within each ``shard``.

    A shard is cut into ``chunks`` parts by a hash of the ordering; rows are numbered within a
    part and moved up by the sizes of the parts before it, so no shard is one task's work. The
    rows should be a written table: they are read twice.
    """
    cut = rows.withColumn("__chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    before = Window.partitionBy("shard").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    moved = cut.groupBy("shard", "__chunk").count().select(
        F.col("shard").alias("__s"), F.col("__chunk").alias("__c"),
        F.coalesce(F.sum("count").over(before.partitionBy("shard")), F.lit(0)).alias("__up"),
    )
    within = Window.partitionBy("shard", "__chunk").orderBy(*order)
    numbered = cut.withColumn("__n", F.row_number().over(within) - 1)
    on = (F.col("shard") == F.col("__s")) & (F.col("__chunk") == F.col("__c"))
    return numbered.join(F.broadcast(moved), on).withColumn("slot", (F.col("__n") + F.col("__up")).cast("bigint")).drop(
        "__chunk", "__s", "__c", "__up", "__n"
    )


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` per row; equal texts share a shard, sizes are near equal.

    A row's size is its text in UTF-8 bytes plus 8. A null text has no bytes and is grouped with
    the empty ones. Null ids and repeated rows each get a slot. Empty table: empty result.
    Further columns are not read. Equality of texts is that of 128 hash bits.
    """
    text = whole(F.col("text"))
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), (F.octet_length(text) + 8).cast("bigint").alias("size"),
        F.crc32(text).alias("text_crc32"), F.xxhash64(text).alias("t1"), F.xxhash64(text, F.lit(1)).alias("t2"),
    )
    placed = written(assign_shards(written(rows, "sized"), ["t1", "t2"], "size", shards), "placed")
    chunks = min(MOST_CHUNKS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return add_slots(placed, [F.col("doc_id"), F.col("t1"), F.col("t2")], chunks).select(
        "doc_id", "size", "text_crc32", "shard", "slot"
    )
