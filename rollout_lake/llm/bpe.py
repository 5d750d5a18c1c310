"""Byte-level BPE encoding by an index of pair occurrences, and decoding.

The distinct words of a batch form one array of symbols. An index maps each pair of adjacent symbols
to all its positions; merge ranks that are active are applied in ascending order to all positions
of their pair at once, and the lists of the pairs beside each merge are brought up to date.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole

WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
"""The vocabulary's split of a text into words (fixed value)."""

WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
NEAR_SPACE = ["  ", *[c + " " for c in WHITE if c != " "], *[" " + c for c in WHITE if c != " "]]
CUT = "\ue000"
MARKS = frozenset(".,:;!?\"()|*#$%&-")
BETWEEN = regex.compile(r"(?<=\S)(?= \S)")

KEPT_PIECES = 100_000
"""Encoded pieces of text a Python worker remembers; beyond, it begins anew, so its memory is bounded."""

BATCH_BYTES = 1 << 21
"""Texts of about so many bytes are encoded together, and handed on before the next ones are taken up."""


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Bpe:
    """A vocabulary with its merges, read from a ``tokenizers`` file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        vocab: dict[str, int] = spec["model"]["vocab"]
        tokens: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens |= {i: t.encode() for t, i in self.special.items()}
        listed = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.flat = np.frombuffer(b"".join(listed), np.uint8)
        self.size = np.array([len(t) for t in listed], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.letter = np.zeros(256, np.int64)
        for c, b in letters.items():
            self.letter[b] = vocab[c]
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.left = np.array([vocab[a] for a, _ in merges], np.int64)
        self.right = np.array([vocab[b] for _, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        codes = (self.left << 32) | self.right
        order = np.argsort(codes, kind="stable")
        self.codes, self.ranks = codes[order], order
        pair = np.arange(65536)
        self.byte_rank = self._rank(self.letter[pair >> 8], self.letter[pair & 255]).astype(np.int32)
        self.known: dict[str, bytes] = {}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where there is no merge."""
        code = (left << 32) | right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.ranks[at], -1)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """The token ids of each word, as little-endian unsigned 32-bit numbers."""
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        symbol = self.letter[data]
        n = len(symbol)
        if not n:
            return [b"" for _ in words]
        ends = np.cumsum(sizes)
        after = np.arange(1, n + 1)
        after[ends[sizes > 0] - 1] = -1
        before = np.arange(-1, n - 1)
        before[(ends - sizes)[sizes > 0]] = -1

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(at: np.ndarray, rank: np.ndarray) -> None:
            """Enter the pairs that begin at these positions and have a merge."""
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            bounds = [0, *(np.flatnonzero(rank[1:] != rank[:-1]) + 1).tolist(), len(at)]
            for start, end in zip(bounds, bounds[1:]) if len(at) else ():
                r = int(rank[start])
                if r not in index:
                    index[r] = []
                    heapq.heappush(active, r)
                index[r].append(at[start:end])

        first = np.flatnonzero(after >= 0)
        note(first, self.byte_rank[(data[first].astype(np.int64) << 8) | data[first + 1]])
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = _distinct(np.concatenate(lists))
            left, right, made = self.left[r], self.right[r], self.made[r]
            follow = after[at]
            good = (symbol[at] == left) & (follow >= 0)
            good &= symbol[np.maximum(follow, 0)] == right
            at = at[good]
            if left == right and len(at) > 1:
                at = _apart(at, after)
            if not len(at):
                continue
            gone = after[at]
            beyond = after[gone]
            symbol[at] = made
            symbol[gone] = -1
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            prior = before[at]
            beside = np.concatenate([at[beyond >= 0], prior[prior >= 0]])
            note(beside, self._rank(symbol[beside], symbol[after[beside]]))
        alive = symbol >= 0
        ids = symbol[alive].astype("<u4").tobytes()
        bounds = (4 * np.r_[0, np.cumsum(alive)][np.r_[0, ends]]).tolist()
        return [ids[s:e] for s, e in zip(bounds, bounds[1:])]

    def learn(self, found: set[str]) -> None:
        """Encode the pieces that are not known yet, by way of their distinct words."""
        if len(self.known) > KEPT_PIECES:
            self.known.clear()
        new = {p: split_words(p) for p in found.difference(self.known)}
        words = list(set().union(*new.values()))
        ids = dict(zip(words, self.merge_words([w.encode("utf-8", "surrogatepass") for w in words])))
        for piece, parts in new.items():
            self.known[piece] = ids[parts[0]] if len(parts) == 1 else b"".join([ids[w] for w in parts])

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of every text; the vocabulary's special tokens are cut out of it first.

        Between two other characters a space always begins a word, so texts fall into pieces
        there, and only distinct pieces are split and encoded.
        """
        cut = [[(p, pieces(p)) for p in self.cut.split(t) if p] for t in texts]
        ordinary = [found for parts in cut for p, found in parts if p not in self.special]
        self.learn(set().union(*ordinary))
        known = self.known
        out = []
        for parts in cut:
            coded = b"".join([
                self.special[p].to_bytes(4, "little") if p in self.special else b"".join(map(known.__getitem__, found))
                for p, found in parts
            ])
            out.append(np.frombuffer(coded, "<u4"))
        return out

    def decode(self, ids: np.ndarray) -> str:
        size = self.size[ids]
        ends = np.cumsum(size, dtype=np.int64)
        total = int(ends[-1]) if len(ends) else 0
        places = np.repeat(self.start[ids] - (ends - size), size) + np.arange(total)
        return self.flat[places].tobytes().decode("utf-8", "replace")


def pieces(text: str) -> list[str]:
    """The text cut before every space that stands between two other characters than white space."""
    if CUT in text or text[:1] == " " or text[-1:] == " " or any(x in text for x in NEAR_SPACE):
        return BETWEEN.split(text)
    return text.replace(" ", CUT + " ").split(CUT)


def split_words(piece: str) -> list[str]:
    """The words of a piece; most are letters with at most one mark behind them."""
    bare = piece[1:] if piece[:1] == " " else piece
    if bare.isalpha():
        return [piece]
    if bare[-1:] in MARKS and bare[:-1].isalpha():
        return [piece[:-1], piece[-1]]
    return WORDS.findall(piece)


def _distinct(at: np.ndarray) -> np.ndarray:
    at = np.sort(at)
    return at[np.r_[True, at[1:] != at[:-1]]] if len(at) else at


def _apart(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Of overlapping places of a pair of equal symbols, the first, third and so on from the left."""
    kept, taken = [], -1
    for p in at.tolist():
        if p != taken:
            kept.append(p)
            taken = int(after[p])
    return np.array(kept, np.int64)


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    return Bpe(path)


def _slices(batch: pa.RecordBatch, place: int, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose texts have about ``limit`` bytes."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(place)), 0), np.int64)
    run = (np.cumsum(sizes) - sizes) // limit
    bounds = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(sizes)]
    for start, end in zip(bounds, bounds[1:]):
        yield batch.slice(start, end - start)


def encode(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """All rows and columns of ``docs`` and ``n_tokens``, ``token_ids`` (if asked), ``ids_sha256``, ``decoded_sha256``.

    The ids equal those of the ``tokenizers`` library without added special tokens; a special
    token's own text becomes its id. ``ids_sha256`` digests the ids as little-endian unsigned 32-bit
    numbers, ``decoded_sha256`` the text decoded from them. ``vocabulary`` is a path every executor has.

    Null and empty text: no tokens. Null ids and repeated rows come through. Empty table: empty
    result. A column of ``docs`` named like an added one is replaced. No shuffle.
    """
    vocabulary = vocabulary or default_vocabulary()
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
             T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        added.append(T.StructField("token_ids", T.ArrayType(T.IntegerType())))
    names = {f.name for f in added}
    kept = [f for f in docs.schema.fields if f.name not in names]
    place = [f.name for f in kept].index("text")
    schema = T.StructType(kept + added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(vocabulary)
        for part in (part for batch in batches for part in _slices(batch, place)):
            counts, digests, decoded, ids = [], [], [], []
            for coded in bpe.encode_batch([t or "" for t in part.column(place).to_pylist()]):
                counts.append(len(coded))
                digests.append(hashlib.sha256(coded.tobytes()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(coded).encode("utf-8", "surrogatepass")).hexdigest())
                if with_ids:
                    ids.append(coded.astype(np.int32))
            out = [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat)))
            yield pa.RecordBatch.from_arrays([*part.columns, *out], names=[*part.schema.names, *[f.name for f in added]])

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, schema)


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``encode`` without the ids, for ``doc_id`` and whole texts only."""
    return encode(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole(F.col("text")).alias("text")), vocabulary, False
    ).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
