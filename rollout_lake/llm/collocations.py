"""Phrase collocation mining: counts by a multikey three-way quicksort of suffix pointers.

Every place in a piece of text where a word begins is a suffix. Suffixes are routed by their language and
leading word, so all that begin alike meet in one place; there a three-way quicksort by one word
after the other splits pointers into less, equal and greater. The equal part's size is the count of a phrase; parts
below the least count are abandoned at once, and no part is sorted beyond the longest phrase.

Words are 64-bit hashes of language and bytes. The word table shows whether two words share a
hash; if so, everything is counted anew with another seed, so counts are exact. Very frequent leading words
are routed by two words, and very frequent pairs by three; the counts of the shorter prefixes are then added up.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import rows_each, whole, written

LONGEST = 4
LEAST = 30
SHARE = 80
"""A phrase is dropped if a longer one with its words has this percentage of its count, or more."""

TOP = 2000
SLICE_BYTES = 1 << 20
"""Texts of about so many bytes are split into words together."""

HELD_WORDS = 1 << 19
"""Suffixes that a task gathers before it deals them out."""

ROUTE_WORDS = 1_000_000
"""Words, about, whose suffixes are sorted together."""

HOT = 1024
"""A leading word or pair is hot with more than 1/HOT of all words."""

FILTER_BITS = 26
"""The filter of frequent words has 2^26 bits (8 MB); one word's bit may be another's, which costs work only."""

FILTER_WORDS = 8_000_000
"""Beyond so many frequent words no filter is sent, and no suffix is left out before the sort."""

SMALL = 4096
"""Parts of up to so many pointers are split by one sort of the word at hand."""

BETWEEN = re.compile(rb"[.,;:!?\x0A-\x0D]")

KIND = np.ones(256, np.uint8)
"""Of each byte: 1 within words, 0 between words, 2 between pieces."""
KIND[[0x20, 0x09]] = 0
KIND[[*b".,;:!?\n\x0b\x0c\r"]] = 2

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words:
    """The words of texts: where they are in the joined bytes, their hashes, and which follow one another in a piece."""

    def __init__(self, texts: list[bytes], langs: list[str], seed: int, twice: bool = False):
        self.raw = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
        kind = KIND[self.raw]
        inside = np.r_[0, kind == 1, 0].astype(np.int8)
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sizes = self.end - self.start
        first = np.cumsum(sizes) - sizes
        place = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat(first.astype(np.int32), sizes)
        letters = self.raw[kind == 1]
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.start, "right")

        def hashed(seed: int) -> np.ndarray:
            """A polynomial in the bytes of each word, mixed with its language; never 0."""
            rng = np.random.default_rng(seed)
            values = rng.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
            powers = np.ones(int(sizes.max()) + 1 if len(sizes) else 1, np.uint64)
            powers[1:] = int(rng.integers(1 << 58, 1 << 60)) * 8 + 5
            terms = values[letters] * np.multiply.accumulate(powers)[place]
            total = np.add.reduceat(terms, first) if len(first) else np.zeros(0, np.uint64)
            salt = np.array([_lang_code(x, seed) for x in langs], np.uint64)[self.text] if len(langs) else total
            h = _mixed(_mixed(total + np.uint64(seed)) ^ (salt * np.uint64(0x9E3779B97F4A7C15)))
            return np.where(h == 0, np.uint64(1), h)

        self.hash = hashed(seed)
        self.second = hashed(seed + 1_000_003) if twice else None
        breaks = np.cumsum(kind == 2)
        piece = breaks[self.start] if len(self.start) else breaks[:0]
        self.follows = np.r_[piece[1:] == piece[:-1], False] if len(piece) else np.zeros(0, bool)


def _parts(text: bytes) -> Iterator[bytes]:
    """The text in parts of about ``SLICE_BYTES``, cut between pieces."""
    at = 0
    while found := BETWEEN.search(text, at + SLICE_BYTES):
        yield text[at:found.end()]
        at = found.end()
    yield text[at:]


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[str]]]:
    """Runs of texts, or parts of long ones, of about ``SLICE_BYTES``, with their languages."""
    texts, langs, size = [], [], 0
    for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
        for part in _parts(text.as_py()):
            texts.append(part)
            langs.append(lang)
            size += len(part)
            if size >= SLICE_BYTES:
                yield texts, langs
                texts, langs, size = [], [], 0
    if texts:
        yield texts, langs


def _lang_code(lang: str, seed: int) -> int:
    raw = lang.encode()
    return zlib.crc32(raw, seed) << 32 | zlib.crc32(raw[::-1], seed + 1)


def _counted(docs: DataFrame, seed: int) -> DataFrame:
    """``(lang, word, h, n, pair)``: occurrences of words and, with ``pair`` not null, of the frequent pairs within a task's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, langs in _texts(batch):
                own = Words(texts, langs, seed, True)
                if not len(own.hash):
                    continue
                h, at, inverse, n = np.unique(own.hash, return_index=True, return_inverse=True, return_counts=True)
                other = np.flatnonzero(own.second != own.second[at][inverse])[:1]  # another word of the same hash is shown, too
                h, at, n = np.r_[h, own.hash[other]], np.r_[at, other], np.r_[n, np.ones(len(other), np.int64)]
                raw = own.raw.tobytes()
                words = [raw[s:e] for s, e in zip(own.start[at].tolist(), own.end[at].tolist())]
                names = [langs[i] for i in own.text[at].tolist()]
                follow = own.follows
                pairs = _mixed(own.hash[:-1][follow[:-1]]) + own.hash[1:][follow[:-1]]
                twice, times = np.unique(pairs, return_counts=True)
                hot = times * HOT > len(own.hash)
                some = int(hot.sum())
                yield pa.RecordBatch.from_arrays([
                    pa.array([*names, *["" for _ in range(some)]], pa.string()),
                    pa.array([*[w.decode("utf-8", "replace") for w in words], *["" for _ in range(some)]], pa.string()),
                    pa.array(np.r_[h, twice[hot]].view(np.int64)), pa.array(np.r_[n, times[hot]].astype(np.int64)),
                    pa.array(np.r_[np.zeros(len(h), bool), np.ones(some, bool)]),
                ], ["lang", "word", "h", "n", "pair"])

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, h bigint, n bigint, pair boolean")


def words(docs: DataFrame, seed: int = 0) -> tuple[DataFrame, DataFrame, int]:
    """``(lang, word, h, n)`` of every word, the hot pairs' hashes, and the seed that keeps all words apart."""
    while True:
        found = written(_counted(docs, seed).groupBy("pair", "lang", "word", "h").agg(F.sum("n").alias("n")), "phrase-words")
        own = found.where("not pair").select("lang", "word", "h", "n")
        if not rows_each(own.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")):
            return own, found.where("pair").select("h", "n"), seed
        seed += 1


def frequent_prefixes(columns: list[np.ndarray], weight: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """``(length, pointer, count)`` of every prefix of two or more words that ``least`` rows begin with.

    ``columns`` are the words by place, 0 behind a suffix's end; ``weight`` is how often a row counts.
    """
    stack = [(np.arange(len(weight)), 0)]
    while stack:
        rows, depth = stack.pop()
        if not len(rows) or int(weight[rows].sum()) < least:
            continue  # abandoned: no phrase in this part is frequent
        key = columns[depth][rows]
        if len(rows) <= SMALL:
            order = np.argsort(key, kind="stable")
            rows, key = rows[order], key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            counts = np.add.reduceat(weight[rows], first)
            ends = np.r_[first[1:], len(rows)]
            good = np.flatnonzero((counts >= least) & (key[first] != 0))
            parts = [(rows[first[i]:ends[i]], int(counts[i])) for i in good.tolist()]
        else:
            some = np.sort(key[::len(key) // 999])
            pivot = some[len(some) // 2]
            stack += [(rows[key < pivot], depth), (rows[key > pivot], depth)]
            equal = rows[key == pivot]
            count = int(weight[equal].sum())
            parts = [(equal, count)] if pivot and count >= least else []
        for equal, count in parts:
            if depth:
                yield depth + 1, int(equal[0]), count
            if depth + 1 < len(columns):
                stack.append((equal, depth + 1))


def _planes(x: np.ndarray) -> bytes:
    """The numbers' lowest bytes, then their second ones, and so on: alike bytes side by side take less room."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(data: bytes, kind: type, count: int, at: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8, count * size, at).reshape(size, count).T.copy().view(kind).reshape(count)


def _packed(columns: list[np.ndarray], weight: np.ndarray) -> bytes:
    """Suffixes as bytes: gaps of their distinct words, then places among them, in the smallest type that holds all, compressed."""
    known, places = np.unique(np.concatenate(columns), return_inverse=True)
    kind = np.uint16 if len(known) <= 1 << 16 else np.uint32
    plain = bool((weight == 1).all())
    gaps = np.diff(known, prepend=known.dtype.type(0))
    body = _planes(gaps) + _planes(places.astype(kind)) + (b"" if plain else weight.tobytes())
    head = np.array([len(weight), len(known), kind().itemsize, plain, len(body)], np.int64)
    return b"".join([head.tobytes(), pa.compress(body, "zstd", asbytes=True)])


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, known, size, plain, length = np.frombuffer(data, np.int64, 5).tolist()
    body = pa.decompress(data[40:], length, "zstd", asbytes=True)
    values = np.cumsum(_numbers(body, np.uint64, known, 0), dtype=np.uint64)
    places = _numbers(body, np.uint16 if size == 2 else np.uint32, LONGEST * n, 8 * known)
    weight = np.ones(n, np.int64) if plain else np.frombuffer(body, np.int64, n, 8 * known + size * LONGEST * n)
    return values[places].reshape(LONGEST, n), weight


def _dealt(docs: DataFrame, seed: int, routes: int, hot: np.ndarray, pairs: np.ndarray, known: np.ndarray | None) -> DataFrame:
    """``(route, suffixes)``: the suffixes that begin with two words, packed by route."""
    sent = docs.sparkSession.sparkContext.broadcast((hot, pairs, known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, pairs, known = sent.value
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            for texts, langs in _texts(batch):
                own = Words(texts, langs, seed)
                h, goes_on = own.hash, own.follows
                if known is not None:  # a phrase with an infrequent word is infrequent, so such words end suffixes
                    bit = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
                    often = (known[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                    goes_on = goes_on & often & np.r_[often[1:], False]
                columns, alive = [h], goes_on
                for step in range(1, LONGEST):
                    columns.append(np.where(alive, np.r_[h[step:], np.zeros(step, np.uint64)][:len(h)], np.uint64(0)))
                    alive = alive & np.r_[goes_on[step:], np.zeros(step, bool)][:len(h)]
                two = np.flatnonzero(goes_on)
                held.append([c[two] for c in columns])
                size += len(two)
                if size >= HELD_WORDS:
                    yield _routed(held, routes, hot, pairs)
                    held, size = [], 0
        if size:
            yield _routed(held, routes, hot, pairs)

    return docs.select("lang", "text").mapInArrow(run, "route bigint, suffixes binary")


def _routed(held: list[list[np.ndarray]], routes: int, hot: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    columns = [np.concatenate(c) for c in zip(*held)]
    weight = np.ones(len(columns[0]), np.int64)
    lead = np.isin(columns[0], hot)
    if lead.any():  # equal suffixes of hot words are counted before they are sent
        rows = np.flatnonzero(lead)
        order = rows[np.lexsort([c[rows] for c in columns[::-1]])]
        new = np.zeros(len(order), bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
        first = np.flatnonzero(new)
        kept = np.r_[np.flatnonzero(~lead), order[first]]
        weight = np.r_[weight[~lead], np.diff(np.r_[first, len(order)])]
        columns = [c[kept] for c in columns]
        lead = np.isin(columns[0], hot)
    key = _mixed(columns[0])
    both = key + columns[1]
    crowd = lead & np.isin(both, pairs)
    key = np.where(crowd, _mixed(both) + columns[2], np.where(lead, both, key))
    route = (_mixed(key) % np.uint64(routes)).astype(np.int64)
    order = np.lexsort((columns[1], columns[0], route))  # sorted words take less room
    first = np.flatnonzero(np.r_[True, route[order][1:] != route[order][:-1]])
    parts = [order[s:e] for s, e in zip(first, np.r_[first[1:], len(order)])]
    packed = [_packed([c[p] for c in columns], weight[p]) for p in parts]
    return pa.RecordBatch.from_arrays([pa.array(route[order][first]), pa.array(packed, pa.binary())], ["route", "suffixes"])


COUNTED = "h1 bigint, h2 bigint, h3 bigint, h4 bigint, a bigint"


def _sorted(dealt: DataFrame, least: int, hot: np.ndarray, pairs: np.ndarray) -> DataFrame:
    """Counts of the phrases of each route: those of ``least`` and more, and all parts of counts that several routes hold."""
    sent = dealt.sparkSession.sparkContext.broadcast((hot, pairs))

    def count(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hot, pairs = sent.value
        columns = list(np.concatenate([x[0] for x in found], axis=1))
        weight = np.concatenate([x[1] for x in found])
        out = [(n, at, c) for n, at, c in frequent_prefixes(columns, weight, least)]
        length, at, counts = (np.array(x, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
        made = [np.where(length > i, columns[i][at], np.uint64(0)) for i in range(LONGEST)]
        # a hot pair lies in several routes: its own count is a sum over all of them
        spread = np.isin(made[0], hot) & np.isin(_mixed(made[0]) + made[1], pairs) & (made[2] == 0)
        rows = np.flatnonzero(np.isin(columns[0], hot) & np.isin(_mixed(columns[0]) + columns[1], pairs))
        both, first, inverse = np.unique(np.stack([columns[0][rows], columns[1][rows]]), axis=1, return_index=True, return_inverse=True)
        parts = np.bincount(inverse.ravel(), weight[rows], both.shape[1]).astype(np.int64)
        nothing = np.zeros(both.shape[1], np.uint64)
        columns = [np.r_[m[~spread], x] for m, x in zip(made, [*both, nothing, nothing])]
        return pa.RecordBatch.from_arrays(
            [*[pa.array(c.view(np.int64)) for c in columns], pa.array(np.r_[counts[~spread], parts])], ["h1", "h2", "h3", "h4", "a"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, found = None, []
        for batch in batches:
            for route, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if route != at and found:
                    yield count(found)
                    found = []
                at = route
                found.append(_unpacked(data))
        if found:
            yield count(found)

    return dealt.repartition("route").sortWithinPartitions("route").mapInArrow(run, COUNTED)


def phrases(docs: DataFrame, least: int = LEAST, seed: int = 0, hot: int = HOT,
            filter_words: int = FILTER_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Phrases ``(h1, h2, h3, h4, a)`` with their counts, frequent words ``(h, word, lang, n)``, words per language ``(lang, n)``.

    Columns behind a phrase's end are 0. ``docs`` has ``lang`` and ``text``, both not null.
    """
    spark = docs.sparkSession
    every, pairs, seed = words(docs, seed)
    totals = written(every.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    often = written(every.where(F.col("n") >= least), "phrase-often")
    total = rows_each(totals, "n")
    leading = [r["h"] for r in often.where(F.col("n") * hot > total).select("h").collect()]  # at most ``hot``
    leading = np.array(sorted(leading), np.int64).view(np.uint64)
    crowded = pairs.where(F.col("n") * hot > total).orderBy(F.desc("n"), "h").limit(hot).collect()
    crowded = np.array([r["h"] for r in crowded], np.int64).view(np.uint64)
    known = None
    if rows_each(often) <= filter_words:
        bits = often.select("h").toArrow().column(0)
        h = np.concatenate([np.asarray(c, np.int64) for c in bits.chunks] or [np.zeros(0, np.int64)]).view(np.uint64)
        at = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        known = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
        np.bitwise_or.at(known, at >> 3, (1 << (at & 7)).astype(np.uint8))
    routes = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // ROUTE_WORDS, 1)
    counted = _sorted(_dealt(docs, seed, routes, leading, crowded, known), least, leading, crowded)
    counted = counted.groupBy("h1", "h2", "h3", "h4").agg(F.sum("a").alias("a")).where(F.col("a") >= least)
    return written(counted, "phrases"), often, totals


def _size() -> Column:
    return F.when(F.col("h3") == 0, 2).when(F.col("h4") == 0, 3).otherwise(4)


def scored(found: DataFrame, often: DataFrame, share: int = SHARE) -> DataFrame:
    """``(h1, h2, h3, h4, a, l, r, score)``: the phrases that no longer one stands for, with their lowest-scoring cut.

    All arithmetic on counts is in 38-digit decimals, so products beyond 64 bits are exact.
    """
    zero = F.lit(0).cast("bigint")
    h = [F.col(f"h{i}") for i in range(1, LONGEST + 1)]
    exact = lambda c: c.cast("decimal(38,0)")

    def part(start: int, end: int) -> Column:
        return F.struct(*[(h[start + i] if start + i < end else zero).alias(f"p{i + 1}") for i in range(LONGEST)])

    parts = found.select(*h, "a", F.explode(F.concat(*[
        F.when(_size() == n, F.array(*[F.struct(F.lit(e - s).alias("n"), part(s, e).alias("p"), F.lit(s).alias("s"))
                                      for s in range(n) for e in range(s + 1, n + 1) if e - s < n])).otherwise(F.array())
        for n in range(2, LONGEST + 1)
    ])).alias("x")).select(*h, "a", "x.n", "x.s", "x.p.*")
    longer = parts.where("n >= 2").join(
        found.select(*[c.alias(f"p{i + 1}") for i, c in enumerate(h)], F.col("a").alias("own")), ["p1", "p2", "p3", "p4"]
    ).where(exact(F.col("a")) * 100 >= exact(F.col("own")) * share)
    gone = longer.select("p1", "p2", "p3", "p4").distinct()
    kept = found.join(gone, [c == F.col(f"p{i + 1}") for i, c in enumerate(h)], "left_anti")

    counts = found.select(*h, "a").unionByName(
        often.select(F.col("h").alias("h1"), *[zero.alias(f"h{i}") for i in range(2, LONGEST + 1)], F.col("n").alias("a")))
    counts = counts.select(*[c.alias(f"p{i + 1}") for i, c in enumerate(h)], F.col("a").alias("f"))
    edges = parts.where((F.col("s") == 0) | (F.col("s") + F.col("n") == _size()))
    edges = edges.join(counts, ["p1", "p2", "p3", "p4"]).withColumn("k", F.when(F.col("s") == 0, F.col("n")).otherwise(F.col("s")))
    cuts = edges.groupBy(*h, "a", "k").agg(
        F.max(F.when(F.col("s") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("s") > 0, F.col("f"))).alias("r"))
    score = F.expr("cast(floor(cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))) as bigint)")
    best = cuts.withColumn("score", score).groupBy(*h, "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    return kept.join(best.drop("a"), [f"h{i}" for i in range(1, LONGEST + 1)]).select(*h, "a", "x.l", "x.r", "x.score")


def report(docs: DataFrame, least: int = LEAST, top: int = TOP, share: int = SHARE, seed: int = 0, hot: int = HOT,
           filter_words: int = FILTER_WORDS) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's best phrases of two to four words.

    ``a`` is the phrase's count, ``l`` and ``r`` those of its two parts at the lowest-scoring cut (the first on ties), ``n`` the
    words of the language and ``score`` is ``floor(2000000 a / (l + r))``. Order: score and count descending, then the phrase's bytes.

    Null languages are ``und``; null and empty texts have no words. Ids are not read; rows that repeat count each time.
    Empty table: empty result. Further columns are not read.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole(F.col("text")).alias("text"))
    found, often, totals = phrases(rows, least, seed, hot, filter_words)
    named = written(scored(found, often, share), "phrase-scores")
    for i in range(1, LONGEST + 1):
        word = often.select(F.col("h").alias(f"h{i}"), F.col("word").alias(f"w{i}"), *([F.col("lang")] if i == 1 else []))
        named = named.join(word, f"h{i}", "inner" if i <= 2 else "left")
    named = named.select("lang", F.concat_ws(" ", *[f"w{i}" for i in range(1, LONGEST + 1)]).alias("phrase"), "a", "l", "r", "score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    first = Window.partitionBy("lang", part).orderBy(*order)
    some = named.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= top)  # of a language, at most 64 * top are left
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(totals) if rows_each(totals) <= 100_000 else totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
