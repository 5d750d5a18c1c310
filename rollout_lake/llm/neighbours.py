"""Approximate nearest neighbours by inner product: a neighbour graph built by NN-descent, searched greedily.

Equal vectors are one node. Every node gets a list of its nearest nodes. A few random trees give
first lists: the nodes of a leaf are compared with each other. Then NN-descent joins neighbours of
neighbours: the nodes that are in a node's list, or have it in theirs, are compared with each other if
one of them is new there, and every node keeps the nearest it has met, until few lists change.
A search keeps the best nodes found so far for its query and expands all of them that it has
not expanded yet, round by round, until none is left. Both are joins on node ids; no task holds the graph.

Comparisons use vectors rounded to eight bits with a scale of their own. For the graph each vector has
one more coordinate that makes all lengths equal, so that near by angle is near by inner product.
The scores returned are computed in double precision from the vectors as given.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_hot, let, rows_each, written

DEGREE = 32
"""Neighbours that a node keeps."""

TREES = 12
LEAF = 1024
"""Nodes in a tree's leaf, about; leaves of more than twice as many are split by a hash."""

SAMPLE = 65_536
"""Nodes, about, that the trees' splits are fitted on; all nodes are placed in them."""

JOINED = 12
"""New and old neighbours of a node, and as many of those it is a neighbour of, that meet in a round."""

ROUNDS = 4
STOP = 0.02
"""The descent ends once a round changes less than this part of all places in the lists."""

BEAM = 192
"""Nodes that a search keeps for its query."""

HUBS = 4096
"""Nodes that most lists name; their vectors (of a fixed number) go to every task."""

PIVOTS = 256
"""Hubs that every search is compared with at its start, the best ``ENTRIES`` of which are entries."""

ENTRIES = 8
BLOCK = 1024
"""Nodes, about, whose vectors answer together."""

NEAR = "array<struct<s:float,v:bigint>>"


@dataclass(frozen=True)
class Index:
    """``rows`` (vec_id, x, h1, h2), ``classes`` (h1, h2, node, ids), ``graph`` and ``links`` as written tables."""

    rows: DataFrame
    classes: DataFrame
    graph: DataFrame
    links: DataFrame
    width: int


def usable(vectors: DataFrame) -> DataFrame:
    """``(vec_id, x, h1, h2)``: the vectors that take part, in double precision, with 128 bits that tell them apart."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"), finite.alias("fine"),
                          F.exists(x, lambda v: v != 0).alias("some"))
    rows = rows.where("vec_id is not null and fine and some").groupBy("vec_id").agg(F.min("x").alias("x"))
    return rows.select("vec_id", "x", F.xxhash64("x").alias("h1"), F.xxhash64("x", F.lit(1)).alias("h2"))


def _runs(lists: pa.Array) -> np.ndarray:
    """Where each list begins in the flattened values, and the end."""
    return np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64))])


def _dense(lists: pa.Array, width: int) -> np.ndarray:
    """Number lists as rows, short ones filled with zeros."""
    sizes = np.diff(_runs(lists))
    out = np.zeros((len(lists), width))
    out[np.arange(width) < sizes[:, None]] = np.asarray(lists.flatten(), np.float64)
    return out


def _small(column: pa.Array, width: int) -> np.ndarray:
    """Binary values of equal length as rows of eight-bit numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(len(column), width)


def _rounded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    scale = np.abs(x).max(axis=1) / 127
    return np.rint(x / scale[:, None]).astype(np.int8), scale


def _lists(bounds: np.ndarray, s: np.ndarray, v: np.ndarray) -> pa.Array:
    pairs = pa.StructArray.from_arrays([pa.array(s.astype(np.float32)), pa.array(v.astype(np.int64))], names=["s", "v"])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pairs)


def _keep(a: np.ndarray, b: np.ndarray, s: np.ndarray, k: int) -> pa.RecordBatch:
    """For each ``a`` its ``k`` best different ``b``, as lists."""
    order = np.lexsort((b, a))
    a, b, s = a[order], b[order], s[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    a, b, s = a[new], b[new], s[new]
    order = np.lexsort((-s, a))
    a, b, s = a[order], b[order], s[order]
    first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(a)])
    kept = np.arange(len(a)) - np.repeat(first, sizes) < k
    bounds = np.r_[0, np.cumsum(np.minimum(sizes, k))]
    return pa.RecordBatch.from_arrays([pa.array(a[first].astype(np.int64)), _lists(bounds, s[kept], b[kept])], ["node", "near"])


def _likeness(q: np.ndarray, s: np.ndarray, e: np.ndarray, most: float) -> np.ndarray:
    """Inner products of rounded vectors that the last coordinate made ``most`` long, less its square.

    The products of eight-bit numbers are exact, so a pair has the same value wherever it meets.
    """
    f = q.astype(np.float32 if q.shape[1] <= 1024 else np.float64)
    return ((s[:, None] * s) * (f @ f.T) + (e[:, None] * e - most * most)).astype(np.float32)


def grow(sample: np.ndarray, depth: int, trees: int) -> tuple[np.ndarray, np.ndarray]:
    """Planes and cuts of the inner nodes of random trees, level by level.

    Each splits its part of the sample at the median along a line through two points of it.
    """
    rng = np.random.default_rng(7)
    inner = (1 << depth) - 1
    planes = np.zeros((trees, inner, sample.shape[1]), np.float32)
    cuts = np.zeros((trees, inner), np.float32)
    for tree in range(trees):
        parts = [np.arange(len(sample))]
        for at in range(inner):
            own = parts[at]
            if len(own) > 1:
                a, b = rng.choice(own, 2, replace=False)
                planes[tree, at] = sample[a] - sample[b]
            along = sample[own] @ planes[tree, at]
            cuts[tree, at] = np.median(along) if len(own) else 0.0
            parts += [own[along <= cuts[tree, at]], own[along > cuts[tree, at]]]
    return planes, cuts


def _fall(planes: np.ndarray, cuts: np.ndarray, depth: int, points: np.ndarray) -> np.ndarray:
    """The leaf of a tree that each point falls into."""
    at = np.zeros(len(points), np.int64)
    for _ in range(depth):
        at = 2 * at + 1 + (np.einsum("ij,ij->i", points, planes[at]) > cuts[at])
    return at - ((1 << depth) - 1)


def _nodes(vectors: DataFrame, width: int) -> DataFrame:
    """``(node, q, s, n)``: rounded vectors, their scales and squared lengths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _dense(batch.column(1), width)
            q, s = _rounded(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(s), pa.array((x * x).sum(axis=1))],
                ["node", "q", "s", "n"],
            )

    return vectors.select("node", "x").mapInArrow(run, "node bigint, q binary, s double, n double")


def _leaves(nodes: DataFrame, count: int, width: int, most: float, trees: int, leaf: int, degree: int) -> DataFrame:
    """``(node, near)``: the best in each leaf that a node lies in."""
    spark = nodes.sparkSession
    share = min(1.0, SAMPLE / max(count, 1))
    drawn = nodes.where(F.pmod(F.xxhash64("node", F.lit("sample")), F.lit(1 << 30)) < int(share * (1 << 30))).select(
        "q", "s", "e").toArrow().combine_chunks()
    table = drawn.to_batches()[0] if drawn.num_rows else None
    sample = np.zeros((0, width + 1), np.float32) if table is None else np.c_[
        _small(table.column(0), width) * np.asarray(table.column(1))[:, None], np.asarray(table.column(2))].astype(np.float32)
    depth = max(0, math.ceil(math.log2(max(count, 1) / leaf)))
    depth = min(depth, int(math.log2(SAMPLE // 16)))
    forest = spark.sparkContext.broadcast(grow(sample, depth, trees if depth else 1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, cuts = forest.value
        for batch in batches:
            points = np.c_[_small(batch.column(1), width) * np.asarray(batch.column(2))[:, None],
                           np.asarray(batch.column(3))].astype(np.float32)
            for tree in range(len(planes)):
                where = _fall(planes[tree], cuts[tree], depth, points)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(where), tree), pa.int32()), pa.array(where), *batch.columns],
                    ["tree", "leaf", "node", "q", "s", "e"],
                )

    placed = nodes.select("node", "q", "s", "e").mapInArrow(
        place, "tree int, leaf bigint, node bigint, q binary, s double, e double")
    sizes = written(placed.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * leaf), "ann-crowded")
    parts = F.broadcast(sizes.select("tree", "leaf", F.ceil(F.col("n") / leaf).alias("parts")))  # at most trees * SAMPLE / 16 rows
    placed = placed.join(parts, ["tree", "leaf"], "left").withColumn(
        "part", F.pmod(F.xxhash64("node", "tree"), F.coalesce("parts", F.lit(1))))
    k = degree // 2 if depth else degree

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, flat = _runs(batch.column(0)), batch.column(0).flatten()
            ids, q, s, e = (flat.field(i) for i in range(4))
            ids, q, s, e = np.asarray(ids), _small(q, width), np.asarray(s), np.asarray(e)
            for start, end in zip(runs, runs[1:]):
                like = _likeness(q[start:end], s[start:end], e[start:end], most)
                n = end - start
                if n < 2:
                    continue
                np.fill_diagonal(like, -np.inf)
                m = min(k, n - 1)
                best = np.argpartition(-like, m - 1, axis=1)[:, :m]
                scores = np.take_along_axis(like, best, 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[start:end]), _lists(np.arange(n + 1) * m, scores.ravel(), ids[start:end][best].ravel())],
                    ["node", "near"],
                )

    groups = placed.groupBy("tree", "leaf", "part").agg(F.collect_list(F.struct("node", "q", "s", "e")).alias("m"))
    return groups.select("m").mapInArrow(compare, f"node bigint, near {NEAR}")


def _best(lists: DataFrame, key: str, k: int) -> DataFrame:
    """One list for each key, of the ``k`` best different entries."""
    return lists.groupBy(key).agg(F.flatten(F.collect_list("near")).alias("all")).select(key, let(
        F.sort_array("all", asc=False),
        lambda a: F.slice(F.filter(a, lambda x, i: (i == 0) | (x["v"] != F.get(a, i - 1)["v"])), 1, k),
    ).alias("near"))


def _ids(near: str) -> Column:
    return F.transform(near, lambda x: x["v"])


def _back(edges: DataFrame, keys: list[str], count: int, step: int) -> DataFrame:
    """At most ``count`` edges ``(node, v)`` for each ``v`` (and further key), by a hash."""
    rank = Window.partitionBy(*keys).orderBy(F.xxhash64("node", "v", F.lit(step)), "node")
    return edges.withColumn("r", F.row_number().over(rank)).where(F.col("r") <= count).drop("r")


def _met(graph: DataFrame, step: int, joined: int, degree: int, width: int, most: float) -> DataFrame:
    """``(node, near)`` from one join of neighbours of neighbours: what is better than a node's worst neighbour."""

    def pick(ids: Column, new: bool) -> Column:
        mixed = F.array_sort(F.transform(ids, lambda v: F.struct(F.xxhash64(v, "node", F.lit(step)).alias("h"), v.alias("v"))))
        return F.transform(F.slice(mixed, 1, joined), lambda x: F.struct(x["v"].alias("v"), F.lit(new).alias("new")))

    chosen = graph.select("node", F.explode(F.concat(
        pick(F.col("fresh"), True), pick(F.array_except(_ids("near"), F.col("fresh")), False)
    )).alias("x")).select("node", "x.v", "x.new")
    back = _back(chosen, ["v", "new"], joined, step)
    members = chosen.select(F.col("node").alias("target"), F.col("v").alias("member"), "new").unionByName(
        back.select(F.col("v").alias("target"), F.col("node").alias("member"), "new")
    ).groupBy("target", "member").agg(F.max("new").alias("new"))
    worst = F.when(F.size("near") >= degree, F.get("near", F.lit(degree - 1))["s"]).otherwise(F.lit(float("-inf")))
    own = graph.select(F.col("node").alias("member"), "q", "s", "e", worst.cast("float").alias("worst"))
    groups = members.join(own, "member").groupBy("target").agg(
        F.collect_list(F.struct("member", "new", "q", "s", "e", "worst")).alias("m")
    ).where(F.exists("m", lambda x: x["new"]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs, flat = _runs(batch.column(0)), batch.column(0).flatten()
            ids, new, q, s, e, worst = (flat.field(i) for i in range(6))
            ids, new, q, s = np.asarray(ids), new.to_numpy(zero_copy_only=False), _small(q, width), np.asarray(s)
            e, worst = np.asarray(e), np.asarray(worst)
            found: list[tuple[np.ndarray, ...]] = []
            held = 0
            for start, end in zip(runs, runs[1:]):
                cut = slice(start, end)
                like = _likeness(q[cut], s[cut], e[cut], most)
                good = (like > worst[cut][:, None]) & (new[cut][:, None] | new[cut])
                np.fill_diagonal(good, False)
                a, b = np.nonzero(good)
                found.append((ids[cut][a], ids[cut][b], like[a, b]))
                held += len(a)
                if held > 1_000_000:
                    yield _keep(*map(np.concatenate, zip(*found)), degree)
                    found, held = [], 0
            if held:
                yield _keep(*map(np.concatenate, zip(*found)), degree)

    return groups.select("m").mapInArrow(compare, f"node bigint, near {NEAR}")


def build(vectors: DataFrame, k: int, degree: int = DEGREE, trees: int = TREES, leaf: int = LEAF, joined: int = JOINED,
          rounds: int = ROUNDS, stop: float = STOP) -> Index:
    """The index of all usable rows of ``(vec_id, embedding)``, for results of up to ``k`` rows.

    Left out: null ids, null and zero vectors, vectors with null or non-finite components. Rows that
    repeat an id are one, with the least of their vectors. Vectors of unequal length count as filled with zeros. Of equal vectors
    the ``k`` + 1 smallest ids are kept by name, as no result can hold another. Empty table: an empty index.
    """
    rows = written(usable(vectors), "ann-rows")
    width = max(1, rows.agg(F.max(F.size("x")).alias("w")).first()["w"] or 1)
    order = Window.partitionBy("h1", "h2").orderBy("vec_id")
    named = rows.select("h1", "h2", "vec_id").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    classes = written(named.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        "h1", "h2", F.get("ids", F.lit(0)).alias("node"), "ids"), "ann-classes")
    nodes = written(_nodes(rows.join(
        classes.select("node"), F.col("vec_id") == F.col("node"), "left_semi").withColumnRenamed("vec_id", "node"), width), "ann-nodes")
    first = nodes.agg(F.count(F.lit(1)).alias("count"), F.max("n").alias("n")).first()
    count, most = first["count"], math.sqrt(min(first["n"] or 0.0, 1e300))
    nodes = nodes.select("node", "q", "s", F.sqrt(F.greatest(F.lit(most * most) - F.col("n"), F.lit(0.0))).alias("e"))

    near = _best(_leaves(nodes, count, width, most, trees, leaf, degree), "node", degree)
    graph = written(nodes.join(near, "node", "left").withColumn(
        "near", F.coalesce("near", F.array().cast(NEAR))).withColumn("fresh", _ids("near")), "ann-graph")
    for step in range(rounds):
        merged = _best(graph.select("node", "near").unionByName(_met(graph, step, joined, degree, width, most)), "node", degree)
        before = graph.select("node", "q", "s", "e", _ids("near").alias("had"))
        graph = written(before.join(merged, "node").withColumn("fresh", F.array_except(_ids("near"), "had")).drop("had"), "ann-graph")
        if rows_each(graph.select(F.size("fresh").alias("n")), "n") <= stop * degree * count:
            break
    edges = graph.select("node", F.explode(_ids("near")).alias("v"))
    links = edges.unionByName(_back(edges, ["v"], degree, rounds).select(F.col("v").alias("node"), F.col("node").alias("v")))
    links = written(links.groupBy("node").agg(F.collect_set("v").alias("to")), "ann-links")
    return Index(rows, classes, graph.select("node", "q", "s"), links, width)


def _block(ids: np.ndarray, blocks: int) -> np.ndarray:
    mixed = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)


def _products(q: np.ndarray, s: np.ndarray, own: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Row by row the inner products of rounded vectors."""
    out = np.empty(len(q), np.float32)
    for at in range(0, len(q), 65536):
        cut = slice(at, at + 65536)
        out[cut] = np.einsum("ij,ij->i", q[cut].astype(np.float32), own[cut].astype(np.float32)) * (s[cut] * scale[cut])
    return out


ASKED = f"query bigint, block bigint, q binary, s double, worst float, ids array<bigint>, near {NEAR}"


def search(index: Index, queries: DataFrame, beam: int = BEAM) -> DataFrame:
    """``(query, near)``: for each row of ``(query, x)`` the best ``beam`` nodes that a greedy search meets, by rounded vectors.

    A search begins at the node whose id is ``query``, if there is one, and at the pivots that suit it best.
    """
    spark, width = queries.sparkSession, index.width
    nodes = index.graph
    count = rows_each(nodes)
    blocks = max(1, count // BLOCK)
    loved = index.links.select(F.explode("to").alias("node")).groupBy("node").count().orderBy(F.desc("count"), "node").limit(HUBS)
    hubs = nodes.join(loved, "node").orderBy(F.desc("count"), "node").select("node", "q", "s").limit(HUBS).toArrow()
    hub_ids = np.asarray(hubs.column(0).combine_chunks(), np.int64) if hubs.num_rows else np.zeros(0, np.int64)
    hub_q = np.frombuffer(b"".join(hubs.column(1).to_pylist()), np.int8).reshape(-1, width)
    hub_s = np.asarray(hubs.column(2).combine_chunks(), np.float64) if hubs.num_rows else np.zeros(0)
    order = np.argsort(hub_ids)
    sent = spark.sparkContext.broadcast((hub_ids[order], hub_q[order], hub_s[order], (hub_ids[:PIVOTS], hub_q[:PIVOTS], hub_s[:PIVOTS])))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0), np.int64)
            where = _block(ids, blocks)
            yield pa.RecordBatch.from_arrays([pa.array(where), *batch.columns], ["block", "node", "q", "s"])

    stock = nodes.select("node", "q", "s").mapInArrow(gather, "block bigint, node bigint, q binary, s double")
    stock = written(stock.groupBy("block").agg(F.collect_list(F.struct("node", "q", "s")).alias("m")), "ann-blocks")

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hq, hs = sent.value[3]
        for batch in batches:
            q, s = _rounded(_dense(batch.column(1), width))
            like = (q.astype(np.float32) @ hq.astype(np.float32).T) * (s[:, None] * hs)
            m = min(ENTRIES, len(ids))
            best = np.argsort(-like, axis=1, kind="stable")[:, :m]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([r.tobytes() for r in q], pa.binary()), pa.array(s),
                 _lists(np.arange(len(q) + 1) * m, np.take_along_axis(like, best, 1).ravel(), ids[best].ravel() if m else ids[:0])],
                ["query", "q", "s", "near"],
            )

    started = queries.select("query", "x").mapInArrow(begin, f"query bigint, q binary, s double, near {NEAR}")
    # the own node comes first whatever its product, so that its neighbours are looked at
    start = F.array(F.struct(F.lit(float("inf")).cast("float").alias("s"), F.col("query").alias("v")))
    known = nodes.select(F.col("node").alias("query"), F.lit(1).alias("own"))
    state = written(started.join(known, "query", "left").select(
        "query", "q", "s", F.when(F.col("own") == 1, F.concat(start, F.filter("near", lambda x: x["v"] != F.col("query")))).otherwise(
            F.col("near")).alias("near"), F.lit(True).alias("open"),
    ).select("query", "q", "s", "near", _ids("near").alias("open")), "ann-state")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Answers for hubs, and one request for each block that holds some of a query's candidates."""
        own_ids, own_q, own_s, _ = sent.value
        for batch in batches:
            query, q, s, worst, lists = batch.columns
            runs, flat = _runs(lists), np.asarray(lists.flatten(), np.int64)
            row = np.repeat(np.arange(len(lists)), np.diff(runs))
            at = np.minimum(np.searchsorted(own_ids, flat), max(len(own_ids) - 1, 0))
            hub = own_ids[at] == flat if len(own_ids) else np.zeros(len(flat), bool)
            like = _products(own_q[at[hub]], own_s[at[hub]], _small(q, width)[row[hub]], np.asarray(s)[row[hub]])
            good = like > np.asarray(worst)[row[hub]]
            r, v, like = row[hub][good], flat[hub][good], like[good]
            bounds = np.searchsorted(r, np.arange(len(lists) + 1))
            n = len(lists)
            nothing = pa.array([[]] * n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [query, pa.array(np.full(n, -1)), pa.array([b""] * n, pa.binary()), s, worst, nothing, _lists(bounds, like, v)],
                ["query", "block", "q", "s", "worst", "ids", "near"],
            )
            row, flat = row[~hub], flat[~hub]
            where = _block(flat, blocks)
            order = np.lexsort((where, row))
            row, flat, where = row[order], flat[order], where[order]
            first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (where[1:] != where[:-1])]) if len(row) else np.zeros(0, np.int64)
            taken = pa.array(row[first])
            ids = pa.ListArray.from_arrays(pa.array(np.r_[first, len(row)].astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays(
                [query.take(taken), pa.array(where[first]), q.take(taken), s.take(taken), worst.take(taken), ids,
                 _lists(np.zeros(len(first) + 1), np.zeros(0), np.zeros(0))],
                ["query", "block", "q", "s", "worst", "ids", "near"],
            )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The products of each block's vectors with the requests behind it."""
        held = (np.zeros(0, np.int64), np.zeros((0, width), np.int8), np.zeros(0))
        for batch in batches:
            block, kind = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (kind[1:] != kind[:-1])])
            for start, end in zip(cuts, np.r_[cuts[1:], len(block)]):
                part = batch.slice(start, end - start)
                if kind[start] == 0:
                    flat = part.column(7).flatten()
                    ids = np.asarray(flat.field(0))
                    order = np.argsort(ids)
                    held = ids[order], _small(flat.field(1), width)[order], np.asarray(flat.field(2))[order]
                    continue
                runs, wanted = _runs(part.column(6)), np.asarray(part.column(6).flatten(), np.int64)
                row = np.repeat(np.arange(len(part)), np.diff(runs))
                at = np.searchsorted(held[0], wanted)
                like = _products(held[1][at], held[2][at], _small(part.column(3), width)[row], np.asarray(part.column(4))[row])
                good = like > np.asarray(part.column(5))[row]
                bounds = np.searchsorted(row[good], np.arange(len(part) + 1))
                yield pa.RecordBatch.from_arrays([part.column(2), _lists(bounds, like[good], wanted[good])], ["query", "near"])

    done = None
    while True:
        finished = state.where(F.size("open") == 0).select("query", "near")
        done = finished if done is None else done.unionByName(finished)
        active = state.where(F.size("open") > 0)
        if not rows_each(active):
            return written(done, "ann-found")
        hops = active.select("query", F.explode("open").alias("node")).join(index.links, "node").groupBy("query").agg(
            F.array_distinct(F.flatten(F.collect_list("to"))).alias("to"))
        worst = F.when(F.size("near") >= beam, F.get("near", F.lit(beam - 1))["s"]).otherwise(F.lit(float("-inf"))).cast("float")
        wanted = active.join(hops, "query").select("query", "q", "s", worst.alias("worst"), F.array_except("to", _ids("near")).alias("ids"))
        asked = written(wanted.mapInArrow(ask, ASKED), "ann-asked")
        requests = asked.where("block >= 0").select(
            "block", F.lit(1).alias("kind"), "query", "q", "s", "worst", "ids", F.lit(None).cast(stock.schema["m"].dataType).alias("m"))
        blocks_first = stock.select(
            "block", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("query"), F.lit(b"").alias("q"), F.lit(0.0).alias("s"),
            F.lit(0.0).cast("float").alias("worst"), F.array().cast("array<bigint>").alias("ids"), "m")
        dealt = blocks_first.unionByName(requests).repartition("block").sortWithinPartitions("block", "kind")
        answers = dealt.mapInArrow(answer, f"query bigint, near {NEAR}").unionByName(
            asked.where("block < 0").select("query", "near"))
        merged = _best(active.select("query", "near").unionByName(answers), "query", beam)
        state = written(active.select("query", "q", "s", _ids("near").alias("had")).join(merged, "query").withColumn(
            "open", F.array_except(_ids("near"), "had")).drop("had"), "ann-state")


def nearest(index: Index, queries: DataFrame, k: int, beam: int = BEAM) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` best rows found for each row of ``queries`` (vec_id), not the row itself.

    Scores are inner products of the vectors as given, in double precision; ties go to the smaller id. Queries without a usable
    vector have no rows; fewer than ``k`` other rows: all that were found. Equal vectors are searched for once.
    """
    asking = queries.select(F.col("vec_id").cast("bigint").alias("query_id")).where("query_id is not null").distinct()
    own = index.rows.join(asking, F.col("vec_id") == F.col("query_id")).select("query_id", "h1", "h2")
    own = written(own, "ann-queries")
    per = written(own.groupBy("h1", "h2").count().join(index.classes.select("h1", "h2", "node"), ["h1", "h2"]), "ann-asking")
    vectors = index.rows.select(F.col("vec_id").alias("node"), "x")
    texts = per.select("node").join(vectors, "node").select(F.col("node").alias("query"), "x")
    found = search(index, texts, beam)
    pairs = found.select("query", F.explode(_ids("near")).alias("node"))
    scored = pairs.join(vectors, "node").join(texts.withColumnRenamed("x", "y"), "query")
    product = F.aggregate(F.zip_with("x", "y", lambda a, b: F.coalesce(a * b, F.lit(0.0))), F.lit(0.0), lambda t, v: t + v)
    scored = scored.select("query", "node", product.alias("score"))
    members = index.classes.select("node", "ids")
    top = scored.join(members, "node").select("query", "score", F.explode("ids").alias("vec_id"))
    # at most beam * (k + 1) rows a query
    ranked = top.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1).alias("best"))
    answers = written(per.join(ranked, per["node"] == ranked["query"]).select("h1", "h2", "count", "best"), "ann-answers")
    each = join_hot(own, answers, [("h1", "h1"), ("h2", "h2")], "count", "inner")
    kept = F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return each.select("query_id", F.posexplode(kept).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", (-F.col("x.s")).alias("score"))
