"""Joins on order: the next event at or after a place, and the spans that cover it.

Both cut the axis of each sequence into bins. A bin is one group of the join, so a sequence that holds a
third of all rows is spread over its bins; a long span lies in all the bins it crosses.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_at_or_after(rows: DataFrame, events: DataFrame, keys: Sequence[str], at: str, event_at: str, out: str, bin_size: int) -> DataFrame:
    """All rows with ``out``: the least ``event_at`` of the events with equal keys that is not below the row's ``at``; null if there is none.

    A row looks at the events of its own bin, which are an array of ``bin_size`` distinct places at most; rows behind the last
    event of their bin take the first event of the next bin that has one, which is known from one row for each bin. The rows
    themselves are hashed to their bins and never sorted. Rows with a null key or place get null. Events are told by their places only.
    """
    marks = events.where(F.col(event_at).isNotNull()).select(*keys, F.col(event_at).cast("bigint").alias("__p"))
    binned = marks.withColumn("__bin", F.floor(F.col("__p") / bin_size))
    inside = binned.groupBy(*keys, "__bin").agg(F.sort_array(F.collect_set("__p")).alias("__own"))
    staged = rows.withColumn("__at", F.col(at).cast("bigint")).withColumn("__bin", F.floor(F.col("__at") / bin_size))
    # the first event of each later bin, for all bins that rows lie in: a window over bins, not over rows
    used = staged.select(*keys, "__bin").distinct().join(inside, [*keys, "__bin"], "full")
    later = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(1, Window.unboundedFollowing)
    used = used.withColumn("__later", F.min(F.get("__own", F.lit(0))).over(later)).select(*keys, "__bin", "__own", "__later")
    met = staged.join(used.hint("shuffle_hash"), [*keys, "__bin"], "left")
    here = F.get(F.filter("__own", lambda p: p >= F.col("__at")), F.lit(0))
    return met.select(*rows.columns, F.coalesce(here, "__later").alias(out))


def covering_spans(rows: DataFrame, spans: DataFrame, keys: Sequence[str], at: str, start: str, end: str, bin_size: int) -> DataFrame:
    """Every row with every span of equal keys that covers it: ``start <= at < end``; the span's other columns are added.

    A span that crosses several bins is entered in each of them, and a row looks into its own bin only, so no pair is met
    twice. Empty spans, null places and null keys match nothing.
    """
    first, last = F.floor(F.col(start) / bin_size), F.floor((F.col(end) - 1) / bin_size)
    entered = spans.where(F.col(start) < F.col(end)).withColumn("__bin", F.explode(F.sequence(first, last)))
    looking = rows.withColumn("__bin", F.floor(F.col(at) / bin_size))
    met = looking.join(entered, [*keys, "__bin"]).where((F.col(start) <= F.col(at)) & (F.col(at) < F.col(end)))
    return met.drop("__bin")
