"""Document fingerprints: the k smallest distinct hashes of a text's word shingles.

Sketches of parts merge into the sketch of the whole, and estimate resemblance, containment and the
number of distinct shingles. All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import NO_ID, let, whole, words

K = 256
WIDTH = 5
BUCKETS_PER_PARTITION = 4


def shingle_hashes(text: Column, width: int = WIDTH) -> Column:
    """A hash for each shingle of ``width`` words, repeats included; of fewer words, one for the sequence."""

    def grams(h: Column) -> Column:
        n = F.size(h)
        return F.when(n == 0, F.array().cast("array<bigint>")).when(n <= width, F.array(F.xxhash64(h))).otherwise(
            F.transform(F.sequence(F.lit(1), n - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width)))
        )

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), grams)


def sketch(text: Column, k: int = K, width: int = WIDTH) -> Column:
    """The ``k`` smallest distinct shingle hashes in ascending order. Null and empty text: an empty sketch."""
    return F.slice(F.sort_array(F.array_distinct(shingle_hashes(text, width))), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_shingles(s: Column, k: int = K) -> Column:
    """Estimate of the number of distinct shingles; exact below ``k``."""
    share = (F.element_at(s, k).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the shared part of all shingles of two texts, from 0 to 1; 1 if neither has any."""
    return let(merge(a, b, k), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(
        F.size(F.array_intersect(F.array_intersect(u, a), b)) / F.size(u)
    ))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the part of the first text's shingles that the second has; 1 if the first has none."""
    shared = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, k)))


def merge_parts(parts: DataFrame, keys: list[str], column: str, k: int = K) -> DataFrame:
    """One sketch for each key from the sketches of its parts, without gathering a key's parts.

    Keys all of whose parts are null or empty get an empty sketch.
    """
    hashes = parts.select(*keys, F.explode_outer(column).alias("__h")).distinct()
    order = Window.partitionBy(*keys).orderBy(F.col("__h").asc_nulls_last())
    least = hashes.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= k)
    return least.groupBy(*keys).agg(F.sort_array(F.collect_list("__h")).alias(column))


def text_form(s: Column) -> Column:
    """A sketch as text: base64 of its hashes in order, eight bytes each."""
    return F.base64(F.unhex(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def _rank_in(bounds: list[int], value: Column) -> Column:
    """How many of the sorted bounds are at most ``value``, by halving."""
    if not bounds:
        return F.lit(0)
    listed = F.array(*[F.lit(b).cast("bigint") for b in bounds])
    steps = [1 << i for i in reversed(range(len(bounds).bit_length()))]
    return F.aggregate(
        F.array(*[F.lit(s) for s in steps]), F.lit(0),
        lambda at, step: F.when(F.get(listed, at + step - 1) <= value, at + step).otherwise(at),
    )


def with_next(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the window key ``part``, ``guest``, ``tie`` by which each row's successor is found.

    Rows are dealt into ranges of ids, a few for each shuffle partition, with bounds from one
    approximate percentile. The first row of a range is added to the range before as a guest behind its
    last row, and the very first row to the last range. Windows then never span ranges.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"), F.col("doc_id").cast("bigint").alias("doc_id"),
        whole(F.col("text")).alias("text"),
    ).withColumn("tie", F.xxhash64("text"))
    n = BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / n for i in range(1, n)]
    bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("bigint"), cuts, 100 * n).alias("b")).first()["b"] or []
    placed = rows.withColumn("own", _rank_in(sorted(set(bounds)), F.col("id")))
    ids = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("id"))
    firsts = ids.withColumn("own", _rank_in(sorted(set(bounds)), F.col("id"))).groupBy("own").agg(F.min("id").alias("first"))
    seen = sorted((r["own"], r["first"]) for r in firsts.collect())  # one pair of numbers for each range
    before = [(first, seen[i - 1][0]) for i, (_, first) in enumerate(seen)]
    guests = F.broadcast(spark.createDataFrame(before, "first long, before int"))
    return placed.join(guests, F.col("id") == F.col("first"), "left").select(
        "doc_id", "id", "text", "tie",
        F.explode(F.when(F.col("before").isNull(), F.array(F.struct(F.col("own").alias("part"), F.lit(0).alias("guest")))).otherwise(
            F.array(F.struct(F.col("own").alias("part"), F.lit(0).alias("guest")),
                    F.struct(F.col("before").alias("part"), F.lit(1).alias("guest")))
        )).alias("at"),
    ).select("doc_id", "id", "text", "tie", "at.part", "at.guest")


def edited_pairs(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """Per row: the sketches of its text and its edited text, and their likeness, and that to the next row.

    The edited text has its last ``floor(n_chars / 2)`` characters replaced by as many (or all) of the
    next document by ascending id, the first one after the last. Columns: ``doc_id, n_chars,
    edited_sha256, sketch, edited_sketch, near_edited, near_next``.

    Null text: empty. Null ids come first; rows with one id are ordered by a hash of the text. A single
    row is its own successor. Empty table: empty result. Further columns are not read.
    """
    order = Window.partitionBy("part").orderBy("guest", "id", "tie")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    followed = with_next(docs).withColumn("following", F.coalesce(F.lead("text").over(order), F.lit("")))
    edited = followed.select(
        "part", "guest", "id", "tie", "doc_id", n.cast("bigint").alias("n_chars"), "text",
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("following", F.lit(1), half)).alias("edited"),
    )
    sketched = edited.select(
        "part", "guest", "id", "tie", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        sketch(F.col("text"), k, width).alias("sketch"), sketch(F.col("edited"), k, width).alias("edited_sketch"),
    )
    return sketched.withColumn("next_sketch", F.lead("sketch").over(order)).where("guest = 0").select(
        "doc_id", "n_chars", "edited_sha256", "sketch", "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
    )
