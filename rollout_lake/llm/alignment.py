"""Cross-tokenizer alignment: where the tokens of two vocabularies end together, in texts of any length.

Byte offsets at which a token of both tokenizers ends cut a text's tokens into groups; the last tokens
of a group are linked. Texts of more than ``CHUNK`` bytes are cut into byte ranges. A range yields a fragment:
an open prefix (tokens up to its first common end), closed groups, and an open suffix (tokens behind its last
common end). Fragments compose associatively, a suffix and the prefix behind it closing one group, so
a tree of groupings joins the fragments of a text whose ranges were encoded in different tasks.

A range is encoded together with the rest of the words that its borders cut. Words are told by single spaces between
other characters: no token of either vocabulary holds such a space anywhere but in front.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _slices, byte_letters, default_vocabulary
from .common import join_hot, rows_each, whole, written

CHUNK = 1 << 16
"""Bytes of a text that one fragment covers; longer texts are cut."""

SLICE_BYTES = 1 << 18
"""Stretches of about so many bytes are encoded together, which bounds what a task holds at a time."""

FAN = 8
"""Fragments that are composed at a time."""

BLOCK_BYTES = 16 << 20
"""Links that a task holds before it writes them."""

BROADCAST_PAIRS = 3_000_000
"""Counts of up to this many pairs of ids (48 MB) go to every task; more are joined by shuffle."""

CUT = regex.compile(r"(?<=[^\s▁])(?= [^\s▁])")
DIGITS = 10


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Both tokenizers, the bytes of their tokens, and the decimal digits of ids."""

    def __init__(self, vocabulary: str, pieces: str):
        import sentencepiece
        import tiktoken

        with open(vocabulary, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        ranks = {bytes(letters[c] for c in t): i for t, i in spec["model"]["vocab"].items()
                 if t not in {x["content"] for x in spec["added_tokens"]}}
        made = [spec["model"]["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("the vocabulary's ids are not in the order of its merges")
        words = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.a = tiktoken.Encoding("a", pat_str=words, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces)
        self.bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.bytes_a[i] = token
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in ((i, self.b.id_to_piece(i)) for i in range(self.b.vocab_size()))
        ]
        self.size_a = np.array([len(t) for t in self.bytes_a], np.int64)
        self.size_b = np.array([len(t) for t in self.bytes_b], np.int64)
        if not self.size_a.all() or not self.size_b.all():
            raise ValueError("a token without bytes")
        most = max(len(self.bytes_a), len(self.bytes_b))
        self.digits = np.array([list(f"{i:0{DIGITS}d}".encode()) for i in range(most)], np.uint8)
        self.decimals = np.array([len(str(i)) for i in range(most)], np.int64)

    def encode(self, stretches: list[str]) -> list[tuple[list[int], list[int]] | None]:
        """Ids of stretches that begin with a space; None where a tokenizer does not give a stretch's bytes back."""
        second = self.b.encode([t[1:] for t in stretches], num_threads=1)
        out: list[tuple[list[int], list[int]] | None] = []
        for t, b in zip(stretches, second):
            a = self.a.encode_ordinary(t)
            raw = t.encode()
            same = b"".join(map(self.bytes_a.__getitem__, a)) == raw == b"".join(map(self.bytes_b.__getitem__, b))
            out.append((a, b) if same else None)
        return out

    def rendered(self, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> tuple[bytes, np.ndarray]:
        """``a1,a2|b1;`` for each group, and where each group's text ends. ``last_``: the index of its last token."""
        if not len(last_a):
            return b"", np.zeros(0, np.int64)
        end_a, end_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        end_a[last_a], end_b[last_b] = 1, 1
        at_a = np.arange(len(a)) + np.r_[0, last_b + 1][np.cumsum(end_a) - end_a]
        at_b = np.arange(len(b)) + (last_a + 1)[np.cumsum(end_b) - end_b]
        n = len(a) + len(b)
        width = int(max(self.decimals[a].max(), self.decimals[b].max()))
        cells, size = np.empty((n, width + 1), np.uint8), np.empty(n, np.int64)
        cells[at_a, :width], cells[at_b, :width] = self.digits[a, DIGITS - width:], self.digits[b, DIGITS - width:]
        cells[at_a, width], cells[at_b, width] = np.where(end_a, ord("|"), ord(",")), np.where(end_b, ord(";"), ord(","))
        size[at_a], size[at_b] = self.decimals[a], self.decimals[b]
        text = cells[np.arange(width + 1) >= (width - size)[:, None]].tobytes()
        ends = np.cumsum(self.decimals[a] + 1)[last_a] + np.cumsum(self.decimals[b] + 1)[last_b]
        return text, ends


def _common(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices in both ascending arrays of what they have in common."""
    at = np.searchsorted(ends_b, ends_a)
    found = np.flatnonzero((at < len(ends_b)) & (ends_b[np.minimum(at, max(len(ends_b) - 1, 0))] == ends_a)) if len(ends_b) else at[:0]
    return found, at[found]


def _codes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << 32) | b


ALIGNED = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, codes array<bigint>"


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum())), sizes


def _short(docs: DataFrame, vocabulary: str, pieces: str) -> DataFrame:
    """``ALIGNED`` rows of whole texts, many of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(vocabulary, pieces)
        for part in (part for batch in batches for part in _slices(batch, 1, SLICE_BYTES)):
            texts = part.column(1).to_pylist()
            encoded = [x or ([], []) for x in pair.encode([" " + t for t in texts])]
            a, n_a = _flat([x[0] for x in encoded])
            b, n_b = _flat([x[1] for x in encoded])
            ends_a, ends_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
            last_a, last_b = _common(ends_a, ends_b)
            text, upto = pair.rendered(a, b, last_a, last_b)
            # the tokens of a text without any take no bytes, so all others end at their own places
            groups = np.searchsorted(last_a, np.cumsum(n_a) - 1, "right")
            upto = np.r_[0, upto]
            bounds = np.r_[0, groups]
            shas = [hashlib.sha256(text[upto[s]:upto[e] - 1]).hexdigest() if e > s else "" for s, e in zip(bounds, bounds[1:])]
            codes = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(_codes(a[last_a], b[last_b])))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n_a), pa.array(n_b), pa.array(np.diff(bounds)), pa.array(shas, pa.string()), codes],
                ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "codes"],
            )

    return docs.mapInArrow(run, ALIGNED)


class Fragment(NamedTuple):
    """The tokens of a byte range. ``cut``: some end is common; without one all tokens are in the prefix."""

    good: bool
    cut: bool
    n_a: int
    n_b: int
    head_a: bytes
    head_b: bytes
    text: bytes
    codes: bytes
    tail_a: bytes
    tail_b: bytes


FRAGMENT = ("good boolean, cut boolean, n_a bigint, n_b bigint, head_a binary, head_b binary, text binary, codes binary, "
            "tail_a binary, tail_b binary")


def group_text(a: bytes, b: bytes) -> bytes:
    """One closed group as text."""
    return b"|".join(",".join(map(str, np.frombuffer(x, "<i8").tolist())).encode() for x in (a, b)) + b";"


def group_code(a: bytes, b: bytes) -> bytes:
    return _codes(np.frombuffer(a, "<i8")[-1:], np.frombuffer(b, "<i8")[-1:]).tobytes()


def fragment(pair: Pair, encoded: tuple[list[int], list[int]] | None, offset: int, start: int, end: int) -> Fragment:
    """Of tokens that begin at ``offset``, those that end behind ``start`` and not behind ``end``."""
    if encoded is None:
        return Fragment(False, False, 0, 0, b"", b"", b"", b"", b"", b"")
    a, b = (np.array(x, np.int64) for x in encoded)
    ends_a, ends_b = offset + np.cumsum(pair.size_a[a]), offset + np.cumsum(pair.size_b[b])
    in_a, in_b = (ends_a > start) & (ends_a <= end), (ends_b > start) & (ends_b <= end)
    a, b, ends_a, ends_b = a[in_a], b[in_b], ends_a[in_a], ends_b[in_b]
    last_a, last_b = _common(ends_a, ends_b)
    if not len(last_a):
        return Fragment(True, False, len(a), len(b), a.tobytes(), b.tobytes(), b"", b"", b"", b"")
    at_a, at_b, to_a, to_b = last_a[0] + 1, last_b[0] + 1, last_a[-1] + 1, last_b[-1] + 1
    text, _ = pair.rendered(a[at_a:to_a], b[at_b:to_b], last_a[1:] - at_a, last_b[1:] - at_b)
    return Fragment(
        True, True, len(a), len(b), a[:at_a].tobytes(), b[:at_b].tobytes(), text, _codes(a[last_a[1:]], b[last_b[1:]]).tobytes(),
        a[to_a:].tobytes(), b[to_b:].tobytes(),
    )


def compose(x: Fragment, y: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges; associative."""
    good, n_a, n_b = x.good and y.good, x.n_a + y.n_a, x.n_b + y.n_b
    if not x.cut:
        return Fragment(good, y.cut, n_a, n_b, x.head_a + y.head_a, x.head_b + y.head_b, y.text, y.codes, y.tail_a, y.tail_b)
    if not y.cut:
        return Fragment(good, True, n_a, n_b, x.head_a, x.head_b, x.text, x.codes, x.tail_a + y.head_a, x.tail_b + y.head_b)
    a, b = x.tail_a + y.head_a, x.tail_b + y.head_b
    return Fragment(good, True, n_a, n_b, x.head_a, x.head_b, x.text + group_text(a, b) + y.text, x.codes + group_code(a, b) + y.codes,
                    y.tail_a, y.tail_b)


def ranges(text: bytes, cuts: np.ndarray, chunk: int) -> list[tuple[int, int, int, int]]:
    """``(offset, until, start, end)``: the byte ranges of a text and the whole words that cover each.

    ``cuts`` are the places before words, 0 and the length. No border lies in a word of more than ``chunk`` bytes.
    """
    lines = np.arange(chunk, len(text), chunk)
    word = np.searchsorted(cuts, lines, "right")
    lines = lines[cuts[np.minimum(word, len(cuts) - 1)] - cuts[word - 1] <= chunk]
    borders = [0, *lines.tolist(), len(text)]
    return [
        (int(cuts[np.searchsorted(cuts, s, "right") - 1]), int(cuts[np.searchsorted(cuts, e, "left")]), s, e)
        for s, e in zip(borders, borders[1:])
    ]


def _long(docs: DataFrame, vocabulary: str, pieces: str, chunk: int) -> DataFrame:
    """``ALIGNED`` rows of texts that are cut into ranges; rows that repeat id and text are encoded per row and composed once."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, h1, h2 in zip(*[c.to_pylist() for c in batch.columns]):
                raw = (" " + text).encode()
                words = [len(w.encode()) for w in CUT.split(" " + text)]
                found = ranges(raw, np.r_[0, np.cumsum(words)], chunk)
                n = len(found)
                yield pa.RecordBatch.from_arrays([
                    pa.array([doc_id] * n, pa.int64()), pa.array([h1] * n, pa.int64()), pa.array([h2] * n, pa.int64()),
                    pa.array(range(n), pa.int64()), *[pa.array([f[i] for f in found], pa.int64()) for i in (0, 2, 3)],
                    pa.array([raw[f[0]:f[1]].decode() for f in found], pa.string()),
                ], ["doc_id", "h1", "h2", "chunk", "offset", "start", "end", "stretch"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(vocabulary, pieces)
        for part in (part for batch in batches for part in _slices(batch, 7, SLICE_BYTES)):
            offset, start, end, stretch = (part.column(i).to_pylist() for i in range(4, 8))
            made = [fragment(pair, x, o, s, e) for x, o, s, e in zip(pair.encode(stretch), offset, start, end)]
            yield _rows(part.columns[:4], made)

    keys = ["doc_id", "h1", "h2"]
    parts = docs.select("doc_id", "text", F.xxhash64("text").alias("h1"), F.xxhash64("text", F.lit(1)).alias("h2")).mapInArrow(
        cut, "doc_id bigint, h1 bigint, h2 bigint, chunk bigint, offset bigint, start bigint, end bigint, stretch string")
    key_schema = "doc_id bigint, h1 bigint, h2 bigint, chunk bigint, "
    parts = parts.repartition(*keys, "chunk").mapInArrow(encode, key_schema + FRAGMENT)
    fields = list(Fragment._fields)
    parts = written(parts.groupBy(*keys, "chunk").agg(
        F.min(F.struct(*fields)).alias("f"), F.count(F.lit(1)).alias("copies")), "align-fragments")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for members in batch.column(4).to_pylist():
                ordered = [Fragment(**m["f"]) for m in sorted(members, key=lambda m: m["chunk"])]
                total = ordered[0]
                for one in ordered[1:]:
                    total = compose(total, one)
                made.append(total)
            yield _rows([*batch.columns[:4], batch.column(5)], made)

    levels, most = 0, (parts.agg(F.max("chunk").alias("m")).first()["m"] or 0)
    while most:
        most //= FAN
        levels += 1
    tree = parts.select(*keys, "chunk", "copies", "f.*")
    for level in range(levels):
        groups = tree.groupBy(*keys, F.floor(F.col("chunk") / FAN).alias("chunk")).agg(
            F.collect_list(F.struct("chunk", F.struct(*fields).alias("f"))).alias("members"), F.min("copies").alias("copies"))
        tree = written(groups.mapInArrow(join, key_schema + "copies bigint, " + FRAGMENT), "align-level")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, copies, *f in zip(*[c.to_pylist() for c in batch.columns]):
                f = Fragment(*f)
                if f.good:
                    text = (group_text(f.head_a, f.head_b) + f.text)[:-1]
                    codes = np.frombuffer(group_code(f.head_a, f.head_b) + f.codes, "<i8")
                    row = (doc_id, f.n_a, f.n_b, len(codes), hashlib.sha256(text).hexdigest(), codes)
                else:
                    row = (doc_id, 0, 0, 0, "", np.zeros(0, np.int64))
                out += [row] * copies
            columns = list(zip(*out)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)],
                                             ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "codes"])

    return tree.select("doc_id", "copies", *fields).mapInArrow(finish, ALIGNED)


def _rows(keys: list[pa.Array], made: list[Fragment]) -> pa.RecordBatch:
    """Fragments behind their keys; a fifth key is the number of copies."""
    types = [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.binary()] * 6
    names = ["doc_id", "h1", "h2", "chunk", *(["copies"] if len(keys) > 4 else []), *Fragment._fields]
    columns = [pa.array([f[i] for f in made], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([*keys, *columns], names)


def aligned(docs: DataFrame, vocabulary: str | None = None, pieces: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``(row, doc_id, n_a, n_b, n_groups, groups_sha256, codes)`` as a written table; ``codes`` are the links in order, ``a << 32 | b``."""
    vocabulary, pieces = vocabulary or default_vocabulary(), pieces or default_pieces()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole(F.col("text")).alias("text"))
    long = F.octet_length("text") >= chunk
    none = rows.where(F.col("text") == "").select("doc_id", *[F.lit(0).cast("bigint").alias(c) for c in ("n_a", "n_b", "n_groups")],
                                                  F.lit("").alias("groups_sha256"), F.array().cast("array<bigint>").alias("codes"))
    each = _short(rows.where(~long & (F.col("text") != "")), vocabulary, pieces).unionByName(
        _long(rows.where(long), vocabulary, pieces, chunk)).unionByName(none)
    return written(each.withColumn("row", F.monotonically_increasing_id()), "aligned", BLOCK_BYTES)


def pair_counts(each: DataFrame) -> DataFrame:
    """``(code, n, best)``: how many links hold each pair of ids, and whether no pair with the same second id has more."""
    pairs = written(each.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n")), "align-pairs")
    second = F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))
    most = pairs.groupBy(second.alias("b")).agg(F.max("n").alias("most"))
    return written(pairs.join(most, second == F.col("b")).select("code", "n", (F.col("n") == F.col("most")).alias("best")), "align-counts")


def report(docs: DataFrame, vocabulary: str | None = None, pieces: str | None = None, chunk: int = CHUNK,
           broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``n_best`` counts links whose pair is held by as many links of the corpus as any pair with the same second id, and
    ``count_sum`` adds up the pairs' counts over the links. Null and empty texts, and those that a
    tokenizer does not give back byte by byte, have no tokens: zeros, and '' for the digest.

    Null ids and repeated rows come through and count in the corpus. Empty table: empty result. Further columns are not read.
    """
    each = aligned(docs, vocabulary, pieces, chunk)
    counts = pair_counts(each)
    if rows_each(counts) <= broadcast_pairs:
        table = counts.toArrow()
        code = np.asarray(table.column("code").combine_chunks() if table.num_rows else pa.array([], pa.int64()), np.int64)
        order = np.argsort(code)
        n = np.asarray(table.column("n").combine_chunks() if table.num_rows else pa.array([], pa.int64()), np.int64)[order]
        best = np.array(table.column("best").to_pylist(), bool)[order]
        sent = docs.sparkSession.sparkContext.broadcast((code[order], np.where(best, -n, n)))

        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, number = sent.value
            for batch in batches:
                lists = batch.column(5)
                sizes = np.asarray(lists.value_lengths(), np.int64)
                found = number[np.searchsorted(known, np.asarray(lists.flatten(), np.int64))] if len(known) else number
                bounds = np.r_[0, np.cumsum(sizes)]
                total, most = np.r_[0, np.cumsum(np.abs(found))][bounds], np.r_[0, np.cumsum(found < 0)][bounds]
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:5], pa.array(np.diff(most)), pa.array(np.diff(total))],
                    ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "n_best", "count_sum"],
                )

        out = each.select("doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "codes").mapInArrow(
            look, "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, groups_sha256 string, n_best bigint, count_sum bigint")
    else:
        links = each.select("row", F.explode("codes").alias("code")).groupBy("row", "code").agg(F.count(F.lit(1)).alias("times"))
        met = join_hot(links, counts, [("code", "code")], "n", "inner")
        sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
                                      F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        out = each.join(sums, "row", "left").withColumn("n_best", F.coalesce("n_best", F.lit(0))).withColumn(
            "count_sum", F.coalesce("count_sum", F.lit(0)))
    return out.select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
                      F.col("n_best").cast("bigint").alias("n_best"), F.col("count_sum").cast("bigint").alias("count_sum"), "groups_sha256")
