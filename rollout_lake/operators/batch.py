"""Batch algebra: columns and rows of row-aligned frames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import index_by_id, seeded_index

METRICS_KEY = "metrics"


def _require(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"missing columns: {missing}")


def select_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    _require(df, names)
    return df.select(*names)


def pop_columns(df: DataFrame, names: Sequence[str], row_id: str) -> tuple[DataFrame, DataFrame]:
    """Named columns and the rest, both with the row id."""
    _require(df, names)
    rest = [c for c in df.columns if c not in names or c == row_id]
    return df.select(row_id, *[n for n in names if n != row_id]), df.select(*rest)


def rename_columns(df: DataFrame, old: Sequence[str], new: Sequence[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError(f"{len(old)} old names but {len(new)} new names")
    _require(df, old)
    return df.withColumnsRenamed(dict(zip(old, new)))


def union_aligned(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Columns of both frames side by side; a shared column must be equal in every row.

    Rows are matched by id. NaN equals NaN and null equals null; any other difference,
    and an id only one side has, fails the query.
    """
    shared = [c for c in left.columns if c in right.columns and c != row_id]
    renamed = right.select(
        F.col(row_id), *[F.col(c).alias(f"__r_{c}") if c in shared else F.col(c) for c in right.columns if c != row_id]
    ).withColumn("__right", F.lit(True))
    joined = left.withColumn("__left", F.lit(True)).join(renamed, row_id, "full")
    aligned = F.col("__left").isNotNull() & F.col("__right").isNotNull()
    equal = F.lit(True)
    for c in shared:
        equal = equal & F.col(c).eqNullSafe(F.col(f"__r_{c}"))
    checked = F.when(aligned & equal, F.col(row_id)).otherwise(
        F.raise_error(F.concat(F.lit("rows differ or are not aligned at id "), F.col(row_id).cast("string")))
    )
    extra = [c for c in right.columns if c not in left.columns]
    return joined.withColumn(row_id, checked).select(*left.columns, *extra)


def _keyed_sums(row_id: str, column: str) -> Column:
    """Two sums of keyed hashes of a column's values and their rows: equal for equal sets of rows in any order.

    A missing, doubled or changed row changes the sums; by chance they agree once in 2^128.
    """
    value = F.struct(F.col(row_id), F.col(column).isNull(), F.col(column))
    sums = [F.sum(F.xxhash64(F.lit(seed), value).cast("decimal(20,0)")) for seed in (11, 29)]
    return F.struct(F.count(F.lit(1)).alias("rows"), *[s.alias(f"s{i}") for i, s in enumerate(sums)])


def batch_digests(df: DataFrame, row_id: str, columns: Sequence[str]) -> DataFrame:
    """One row with a digest for each column, and one for the row ids alone."""
    return df.agg(_keyed_sums(row_id, row_id).alias("__ids"), *[_keyed_sums(row_id, c).alias(c) for c in columns])


def differing_columns(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """``column, equal`` for the row ids and each shared column: whether both batches have the same rows, without a join of rows.

    Each side is one aggregate. Null equals null.
    """
    shared = [c for c in left.columns if c in right.columns and c != row_id]
    sides = [batch_digests(df, row_id, shared) for df in (left, right)]
    names = [f"_{i}" for i in range(len(shared) + 1)]
    packed = [F.struct(*[F.col(c).alias(n) for c, n in zip(["__ids", *shared], names)]).alias(side) for side in ("l", "r")]
    both = sides[0].select(packed[0]).withColumn("r", sides[1].select(packed[1]).scalar())
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")).alias("equal"))
            for c, n in zip([row_id, *shared], names)]
    return both.select(F.explode(F.array(*rows)).alias("x")).select("x.column", "x.equal")


def concat_batches(parts: Sequence[DataFrame]) -> DataFrame:
    """Rows of all parts."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merge_meta(meta: DataFrame) -> DataFrame:
    """One row per meta key, on which all parts must agree; metrics keep a row per value.

    Nothing is gathered into a list: agreement is a comparison of two partial aggregates.
    """
    metrics = meta.where(F.col("key") == METRICS_KEY).select("key", "value")
    others = meta.where(F.col("key") != METRICS_KEY).groupBy("key").agg(
        F.min("value").alias("lo"), F.max("value").alias("hi")
    )
    value = F.when(F.col("lo").eqNullSafe(F.col("hi")), F.col("lo")).otherwise(
        F.raise_error(F.concat(F.lit("parts disagree on meta key "), F.col("key")))
    )
    return others.select("key", value.alias("value")).unionByName(metrics)


def _count(df: DataFrame) -> Column:
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def chunk_rows(df: DataFrame, id_col: str, chunks: int) -> DataFrame:
    """Equal consecutive chunks in id order; fails when the row count is no multiple."""
    placed = index_by_id(df, id_col).withColumn("__n", _count(df))
    size = F.col("__n") / chunks
    chunk = F.when(F.col("__n") % chunks == 0, F.floor(F.col("row_index") / size)).otherwise(
        F.raise_error(F.lit(f"the row count is not divisible by {chunks}"))
    )
    return placed.withColumn("chunk", chunk).drop("__n", "row_index")


def repeat_rows(df: DataFrame, times: int, row_index: str, interleave: bool = True, out: str = "position") -> DataFrame:
    """Every row ``times`` times: AABB (interleaved) or ABAB (tiled); ``out`` is the new position."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(times - 1).cast("bigint"))))
    if interleave:
        return copies.withColumn(out, F.col(row_index) * times + F.col("copy"))
    return copies.withColumn("__n", _count(df)).withColumn(out, F.col("copy") * F.col("__n") + F.col(row_index)).drop("__n")


def repeat_with_suffix(df: DataFrame, times: int, uid: str) -> DataFrame:
    """Repeated rows whose group id carries the copy number."""
    copies = df.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(times - 1).cast("bigint"))))
    return copies.withColumn(uid, F.concat(F.col(uid).cast("string"), F.lit("_"), F.col("copy").cast("string")))


def reorder_rows(df: DataFrame, order: DataFrame, row_id: str, position: str = "new_pos") -> DataFrame:
    """Rows at the positions another table gives them, sorted."""
    return df.join(order.select(row_id, position), row_id).orderBy(position)


def take_rows(df: DataFrame, row_index: str, start: int, stop: int, step: int = 1) -> DataFrame:
    """Slice by row position."""
    i = F.col(row_index)
    return df.where((i >= start) & (i < stop) & ((i - start) % step == 0))


def fold_rows(df: DataFrame, row_index: str, columns: Sequence[str], size: int, short_last: bool = False) -> DataFrame:
    """[b] to [g, size]: every folded row holds exactly ``size`` consecutive rows.

    If ``size`` does not divide the row count, the query fails, or with ``short_last`` the last fold holds the rows that are left.
    """
    group = F.floor(F.col(row_index) / size).alias("fold")
    items = F.sort_array(F.collect_list(F.struct(row_index, *columns)))
    folded = df.groupBy(group).agg(items.alias("items"))
    whole = F.col("items") if short_last else F.when(F.size("items") == size, F.col("items")).otherwise(
        F.raise_error(F.lit(f"the row count is not divisible by {size}"))
    )
    return folded.select("fold", F.transform(whole, lambda r: F.struct(*[r[c].alias(c) for c in columns])).alias("items"))


def unfold_rows(folded: DataFrame, size: int, row_index: str = "row_index") -> DataFrame:
    out = folded.select("fold", F.posexplode("items").alias("slot", "r"))
    return out.select((F.col("fold") * size + F.col("slot")).alias(row_index), "r.*")


def minibatches(df: DataFrame, keys: Sequence[str], size: int, epochs: int, seed: int, full_only: bool = False) -> DataFrame:
    """Seeded mini-batches over epochs.

    If the size does not divide the row count, the query fails, or with ``full_only`` an epoch ends with its last full batch.
    """
    runs = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    placed = seeded_index(runs, [*keys, "epoch"], seed, group_by=["epoch"], out="position").withColumn("__n", _count(df))
    batch = F.floor(F.col("position") / size)
    if full_only:
        placed = placed.where(batch < F.floor(F.col("__n") / size))
    else:
        batch = F.when(F.col("__n") % size == 0, batch).otherwise(F.raise_error(F.lit(f"the row count is not divisible by {size}")))
    return placed.withColumn("batch_id", batch).drop("__n")


def consistency_report(df: DataFrame, arrays: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Counts of missing values and of rows whose arrays differ in length."""
    first = F.size(arrays[0])
    ragged = F.lit(False)
    for a in arrays[1:]:
        ragged = ragged | (F.size(a) != first)
    nulls = [F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in required]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(ragged).alias("ragged_rows"), *nulls)


def check_consistency(df: DataFrame, arrays: Sequence[str], required: Sequence[str]) -> DataFrame:
    """The report, failing on any finding."""
    report = consistency_report(df, arrays, required)
    bad = F.col("ragged_rows")
    for c in required:
        bad = bad + F.col(f"null_{c}")
    return report.withColumn("rows", F.when(bad == 0, F.col("rows")).otherwise(F.raise_error(F.lit("the batch is not consistent"))))
