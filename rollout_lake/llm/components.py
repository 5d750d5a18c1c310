"""Connected components of a table of links, by rounds of contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_each, written


def component_roots(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; two nodes share a root if a path joins them.

    Each round a node joins its neighbour of least priority (a hash, new each round), or stays if
    it has less itself; the links between the merged nodes go on to the next round. A constant
    share of the nodes goes each round whatever the graph's form. Minima are aggregated partially
    and every round's tables are written, so joins on a node with many links can be split by
    adaptive execution, and lost executors cost no more than a round.

    Self-links and repeated links are ignored; links with a null end too. No links: no rows.
    """
    ends = written(
        links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links"
    )
    roots = None
    step = 0
    while rows_each(ends):
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(step)).alias("p"), F.col(c).alias("n"))  # noqa: B023,E731
        both = ends.select("a", rank("b").alias("r")).unionByName(ends.select(F.col("b").alias("a"), rank("a").alias("r")))
        least = both.groupBy("a").agg(F.min("r").alias("r"))
        heads = written(least.select(F.col("a").alias("node"), F.least(F.col("r"), rank("a"))["n"].alias("head")), "heads")
        moved = (
            ends.join(heads.select(F.col("node").alias("a"), F.col("head").alias("ha")), "a")
            .join(heads.select(F.col("node").alias("b"), F.col("head").alias("hb")), "b")
            .where("ha <> hb").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b")).distinct()
        )
        ends = written(moved, "links")
        if roots is None:
            roots = heads.withColumnRenamed("head", "root")
        else:
            roots = written(
                roots.join(heads.select(F.col("node").alias("root"), "head"), "root", "left").select(
                    "node", F.coalesce("head", "root").alias("root")
                ), "roots",
            )
        step += 1
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0) if roots is None else roots
