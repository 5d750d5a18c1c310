"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features of a text are its lower-cased words, pairs of words, and the same of the words' forms (letters
folded to their kind, runs shortened, repeats of the word before marked), each hashed
into one table of weights. Each kind of feature is weighted by its share of the text, so that long
texts score like short ones. Training runs on a bounded sample in a fixed number of parts, each with
its own pass of updates; their weights are averaged.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole

BUCKETS = 1 << 18
SAMPLE = 24_000
"""Labelled rows that training uses at most (expected number); the choice is by a hash of the id."""

PARTS = 6
EPOCHS = 2
THRESHOLD = 0.7
KNOWN_WORDS = 200_000
KINDS = 4
SCALE = 4.0


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 4 == 2


_FORM = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + bytes(range(128, 256)),
    b"A" * 26 + b"a" * 26 + b"0" * 10 + b"a" * 128,
)


def _form(word: bytes) -> bytes:
    """Letters and digits of a word folded to their kinds, runs of letters shortened."""
    folded = word.translate(_FORM)
    for run in (b"aaaa", b"aa", b"aa", b"AAAA", b"AA", b"AA"):
        folded = folded.replace(run, run[:1])
    return folded


def _mixed(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    x = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) + np.uint64(salt))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return ((x >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)


class Features:
    """Turns texts into feature places; the words it has met are remembered up to a bound."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _look(self, word: bytes) -> int:
        found = zlib.crc32(word.lower()) << 32 | zlib.crc32(_form(word))
        if len(self.known) >= KNOWN_WORDS:
            self.known.clear()
        self.known[word] = found
        return found

    def places(self, text: str | None) -> list[np.ndarray]:
        """For each kind of feature, the place of every occurrence."""
        words = (text or "").encode("utf-8", "surrogatepass").split()
        known, look = self.known.get, self._look
        both = np.fromiter([known(w) or look(w) for w in words], np.uint64, len(words))
        word, form = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        again = np.r_[False, word[1:] == word[:-1]] if len(word) else np.zeros(0, bool)
        form = form + again.astype(np.uint64)
        zero = np.zeros(1, np.uint64)
        return [
            _mixed(word, zero, 1), _mixed(word[:-1], word[1:], 2), _mixed(form, zero, 3), _mixed(form[:-1], form[1:], 4),
        ]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, places: list[np.ndarray]) -> float:
        """The sparse dot product, as a probability."""
        total = self.bias + sum(SCALE * float(self.weights[p].sum()) / len(p) for p in places if len(p))
        return float(1 / (1 + np.exp(-np.clip(total, -35, 35))))


def train_part(texts: list[str], labels: list[int], alpha: float = 3.0, beta: float = 1.0, l1: float = 1e-5,
               l2: float = 0.001, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the bias last, after follow-the-regularised-leader updates in the given order."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)
    features = Features()
    rows = []
    for text in texts:
        at, value = [np.array([BUCKETS])], [np.ones(1)]
        for p in features.places(text):
            if len(p):
                at.append(p)
                value.append(np.full(len(p), SCALE / len(p)))
        places, inverse = np.unique(np.concatenate(at), return_inverse=True)
        rows.append((places.astype(np.int32), np.bincount(inverse, np.concatenate(value)).astype(np.float32)))

    def leader(at: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for (at, x), y in zip(rows, labels):
            w = leader(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return leader(np.arange(BUCKETS + 1))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``labels.quality`` from rows that are not held out.

    Labelled rows beyond ``sample`` are left out by a hash of the id (the bound is in expectation). Rows
    without an id, a text or a label are not learned from; a label given twice counts once if the two
    agree, and not at all otherwise. Without any row the score is 0.5 everywhere.
    """
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(
        F.min("quality").alias("y"), F.max("quality").alias("__most")
    ).where("y = __most").drop("__most").where(~held_out(F.col("doc_id")))
    count = known.count()
    rank = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30))
    chosen = known.where(rank < int(min(1.0, sample / max(count, 1)) * (1 << 30)))
    rows = docs.where("text is not null").select("doc_id", "text").join(chosen, "doc_id").select(
        "text", "y", F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PARTS)).alias("part"),
        F.xxhash64("doc_id", F.lit("order")).alias("o"),
    )

    def fit(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["o", "text"])
        w = train_part(frame["text"].tolist(), frame["y"].tolist())
        return pd.DataFrame({"n": [len(frame)], "w": [w.astype("<f4").tobytes()]})

    parts = rows.groupBy("part").applyInPandas(fit, "n long, w binary").collect()
    total = sum(p["n"] for p in parts)
    if not total:
        return Model(np.zeros(BUCKETS, np.float32), 0.0)
    parts.sort(key=lambda p: (p["n"], p["w"]))
    w = sum(np.frombuffer(p["w"], "<f4").astype(np.float64) * (p["n"] / total) for p in parts)
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All rows and columns of ``docs``, a double ``score`` and an int ``predicted`` (1 from ``threshold`` on).

    Only the text is read for the score. Null and empty texts get the score of a text without words.
    The model, of a fixed size, goes to every task. Columns named like the added ones are replaced. No shuffle.
    """
    return _scored(docs, model, "score").withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def _scored(docs: DataFrame, model: Model, name: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        features, own = Features(), sent.value
        for texts in batches:
            yield pd.Series([own.score(features.places(t)) for t in texts], dtype="float64")

    return docs.withColumn(name, scored(whole(F.col("text"))))


def keep_good(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that ``score`` predicts as good, with their own columns."""
    names = set(docs.columns)
    own = next(n for n in (f"__quality_{i}" for i in range(len(names) + 1)) if n not in names)
    return _scored(docs, model, own).where(F.col(own) >= threshold).drop(own)
