"""Exact quantiles of a column of any size, by radix selection.

The bits of a double, read as a number, order as the doubles do once those of negative ones are turned over. A counting pass
over the leading bits tells in which part each wanted rank lies; the next pass counts only those parts, by
further bits. All ranks are narrowed at once, and a pass shuffles nothing but partial counts.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

DIGIT = 16
"""Bits that a pass tells apart; at most 2^16 counts for each wanted rank come back from it."""

FEW = 50_000
"""Once so few rows are left in the parts at hand, the next pass tells all their bits apart."""


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = np.asarray(batch.column(0)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(bits ^ ((bits >> 63) & np.int64(2**63 - 1)))], ["b"])


def _value(code: int) -> float:
    bits = np.array([code], np.int64)
    return float((bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.float64)[0])


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """One row with the linearly interpolated quantiles of the non-null values; nulls if there are none."""
    spark = df.sparkSession
    schema = ", ".join(f"`{name}` double" for name in names)
    path = scratch_path(spark, "quantile-bits")
    values = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    values.mapInArrow(_ordered, "b bigint").write.parquet(path)
    bits = spark.read.schema("b bigint").parquet(path)

    def counted(shift: int, parts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """The parts by the bits above ``shift``, in order, with their counts; only of the parts at hand."""
        rows = bits
        if parts:
            listed, above = next(iter(parts.values())), sorted(parts)
            rows = bits.where(F.shiftright("b", listed).isin(above))
        table = rows.groupBy(F.shiftright("b", shift).alias("p")).agg(F.count(F.lit(1)).alias("n")).toArrow().sort_by("p")
        return np.asarray(table.column("p").to_numpy()), np.asarray(table.column("n").to_numpy())

    shift = 64 - DIGIT
    part, n = counted(shift, {})
    total = int(n.sum())
    if not total:
        return spark.createDataFrame([tuple(None for _ in names)], schema)
    exact = [(total - 1) * float(p) for p in probs]
    ranks = sorted({r for x in exact for r in (int(x), min(total - 1, int(x) + (x > int(x))))})
    inside = dict.fromkeys(ranks, (0, 0))  # the part each rank lies in, and how many rows lie before that part

    def narrow(part: np.ndarray, n: np.ndarray, before: dict[int, int], wide: int) -> int:
        """Find each rank's part; the rows of all parts found."""
        for rank in ranks:
            own = slice(0, len(part)) if not before else slice(*np.searchsorted(part >> wide, [inside[rank][0], inside[rank][0] + 1]))
            upto = inside[rank][1] + np.cumsum(n[own])
            at = int(np.searchsorted(upto, rank, "right"))
            inside[rank] = (int(part[own][at]), int(upto[at] - n[own][at]))
        return int(n[np.isin(part, [p for p, _ in inside.values()])].sum())

    left = narrow(part, n, {}, 0)
    while shift:
        below = 0 if left <= FEW else shift - DIGIT
        parts = {p: shift for p, _ in inside.values()}
        part, n = counted(below, parts)
        left = narrow(part, n, parts, shift - below)
        shift = below
    found = {rank: _value(p) for rank, (p, _) in inside.items()}
    out = []
    for x in exact:
        low, high = found[int(x)], found[min(total - 1, int(x) + (x > int(x)))]
        out.append(low + (high - low) * (x - int(x)) if high > low else low)
    return spark.createDataFrame([tuple(out)], schema)
