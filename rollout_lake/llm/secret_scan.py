"""Secret scans: a trigram inverted index picks the texts on which a rule's regex is run.

From each rule's regex a Boolean query over trigrams is derived which every matching text satisfies.
Each batch of texts is a segment with postings of its own, for the trigrams the queries name;
intersecting and uniting postings gives the candidates, and the regex verifies them. Rules from
which no mandatory trigram follows run over every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as sc
from re import _parser as sp

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``group`` must have ``least`` characters, else the match counts as none."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    any_case: bool = False
    base: bool = False

    def regex(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0))


RULES: tuple[Rule, ...] = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, False, True),
    Rule("hex", r"[0-9a-f]+", 0, 24, False, True),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[oprsu]_[A-Za-z0-9]+", 0, 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    Rule("url_login", r"[a-z]+://[A-Za-z0-9._-]+:[^\x20\x09-\x0D@/:]+@"),
)

ALL = ("all",)
MOST_TEXTS = 64
"""Alternatives that are followed through a regex before its parts are turned into a query."""

Query = tuple


def _grams(texts: set[str]) -> Query:
    """Every one of the texts' trigrams, for one of the texts."""
    if not texts or any(len(t) < 3 for t in texts):
        return ALL
    return _either([("and", frozenset(t[i:i + 3] for i in range(len(t) - 2)), ()) for t in texts])


def _either(parts: Sequence[Query]) -> Query:
    if any(p == ALL for p in parts):
        return ALL
    parts = list(dict.fromkeys(parts))
    return parts[0] if len(parts) == 1 else ("or", frozenset(), tuple(parts))


def _both(a: Query, b: Query) -> Query:
    if a == ALL:
        return b
    if b == ALL or a == b:
        return a
    flat = [a, b]
    grams = frozenset().union(*[q[1] for q in flat if q[0] == "and"])
    rest = [q for q in flat if q[0] == "or"] + [s for q in flat if q[0] == "and" for s in q[2]]
    return ("and", grams, tuple(rest))


@dataclass(frozen=True)
class _Part:
    """What is known of a piece of a regex: all texts it can match, or a query and the texts at its ends."""

    texts: frozenset[str] | None
    query: Query = ALL
    first: frozenset[str] = frozenset({""})
    last: frozenset[str] = frozenset({""})

    def ends(self) -> tuple[frozenset[str], frozenset[str]]:
        return (self.texts, self.texts) if self.texts is not None else (self.first, self.last)

    def needs(self) -> Query:
        return self.query if self.texts is None else _grams(set(self.texts))


def _cross(a: frozenset[str], b: frozenset[str]) -> frozenset[str] | None:
    return None if len(a) * len(b) > MOST_TEXTS else frozenset(x + y for x in a for y in b)


def _follow(a: _Part, b: _Part) -> _Part:
    if a.texts is not None and b.texts is not None and (texts := _cross(a.texts, b.texts)) is not None:
        return _Part(texts)
    query = _both(a.needs(), b.needs())
    (a_first, a_last), (b_first, b_last) = a.ends(), b.ends()
    seam = _cross(frozenset(t[-2:] for t in a_last), frozenset(t[:2] for t in b_first))
    if seam is not None:
        query = _both(query, _grams(set(seam)))
    first = _cross(a.texts, b_first) if a.texts is not None else a_first
    last = _cross(a_last, b.texts) if b.texts is not None else b_last
    return _Part(None, query, first or a_first, last or b_last)


def _choice(parts: list[_Part]) -> _Part:
    if all(p.texts is not None for p in parts) and sum(len(p.texts) for p in parts) <= MOST_TEXTS:
        return _Part(frozenset().union(*[p.texts for p in parts]))
    first = frozenset().union(*[p.ends()[0] for p in parts])
    last = frozenset().union(*[p.ends()[1] for p in parts])
    few = len(first) <= MOST_TEXTS and len(last) <= MOST_TEXTS
    return _Part(None, _either([p.needs() for p in parts]), *((first, last) if few else ()))


ANYTHING = _Part(None)


def _part(node) -> _Part:
    op, arg = node
    if op is sc.LITERAL:
        return _Part(frozenset({chr(arg).lower()})) if arg < 128 else ANYTHING
    if op is sc.IN:
        chars: set[str] = set()
        for kind, what in arg:
            if kind is sc.LITERAL and what < 128:
                chars.add(chr(what).lower())
            elif kind is sc.RANGE and what[1] < 128:
                chars |= {chr(c).lower() for c in range(what[0], what[1] + 1)}
            else:
                return ANYTHING
        return _Part(frozenset(chars)) if len(chars) <= 8 else ANYTHING
    if op is sc.SUBPATTERN:
        return _sequence(arg[3])
    if op is sc.BRANCH:
        return _choice([_sequence(x) for x in arg[1]])
    if op in (sc.MAX_REPEAT, sc.MIN_REPEAT):
        least, most, inner = arg
        once = _sequence(inner)
        if (least, most) == (0, 1):
            return _choice([once, _Part(frozenset({""}))])
        if least == 0:
            return ANYTHING
        if least == most == 1:
            return once
        first, last = once.ends()
        return _Part(None, once.needs(), first, last)
    if op is sc.AT:
        return _Part(frozenset({""}))
    return ANYTHING


def _sequence(nodes) -> _Part:
    out = _Part(frozenset({""}))
    for node in nodes:
        out = _follow(out, _part(node))
    return out


def trigram_query(rule: Rule) -> Query:
    """A query on lower-cased trigrams which every text that the rule matches satisfies; ``ALL`` if none follows.

    ``("and", trigrams, subqueries)`` asks for all of them, ``("or", {}, subqueries)`` for one.
    """
    return _sequence(sp.parse(rule.pattern, re.ASCII)).needs()


def trigrams_of(query: Query) -> set[str]:
    return set() if query == ALL else set(query[1]).union(*[trigrams_of(q) for q in query[2]])


class Segment:
    """Postings of one batch of texts: for each wanted trigram, the sorted rows that hold it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: Sequence[str]):
        self.rows = len(offsets) - 1
        codes = {g: int.from_bytes(g.encode("ascii"), "big") for g in wanted}
        self.postings: dict[str, np.ndarray] = {}
        table = _wanted_table(tuple(sorted(codes.values())))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, max(len(data) - 2, 0), 1 << 22):
            piece = _LOWER[data[at:at + (1 << 22) + 2]].astype(np.uint32)
            code = (piece[:-2] << 16) | (piece[1:-1] << 8) | piece[2:]
            where = np.flatnonzero(table[code])
            found.append((code[where], where + at))
        code = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.uint32)
        where = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
        row = np.searchsorted(offsets, where, side="right") - 1
        inside = where + 2 < offsets[np.minimum(row + 1, self.rows)]
        code, row = code[inside], row[inside]
        for gram, value in codes.items():
            self.postings[gram] = np.unique(row[code == value])

    def rows_for(self, query: Query) -> np.ndarray:
        if query == ALL:
            return np.arange(self.rows)
        if query[0] == "or":
            return np.unique(np.concatenate([self.rows_for(q) for q in query[2]]))
        lists = sorted([self.postings[g] for g in query[1]], key=len) + [self.rows_for(q) for q in query[2]]
        out = lists[0]
        for other in lists[1:]:
            if not len(out):
                break
            out = np.intersect1d(out, other, assume_unique=True)
        return out


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=4)
def _wanted_table(codes: tuple[int, ...]) -> np.ndarray:
    table = np.zeros(1 << 24, bool)
    table[list(codes)] = True
    return table


def matches(rule: Rule, regex: re.Pattern, text: str) -> Iterator[tuple[int, int]]:
    """Spans of the leftmost non-overlapping matches, those that are too short left out."""
    for m in regex.finditer(text):
        if len(m[rule.group]) >= rule.least:
            yield m.span()


def _listed(spans: list[tuple[int, int, int]], rules: Sequence[Rule]) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in sorted(spans))


def find_secrets(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per row: ``doc_id``, a count ``n_<kind>`` of each base rule, ``base_sha256``, ``spans`` and ``n_candidates``.

    Spans are ``kind:start:end`` in code points, ordered by start, then by the order of the rules.
    ``base_sha256`` digests those of the base rules, ``n_candidates`` counts the regex runs that the
    index could not spare. Null text: empty, no spans. Null ids and repeated rows are returned as
    they come. Empty table: empty result. Further columns are not read. No shuffle.
    """
    rules = tuple(rules)
    base = [k for k, r in enumerate(rules) if r.base]
    counts = "".join(f", n_{rules[k].kind} long" for k in base)
    schema = f"doc_id long{counts}, base_sha256 string, spans string, n_candidates int"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = [trigram_query(r) for r in rules]
        compiled = [r.regex() for r in rules]
        wanted = sorted(set().union(*[trigrams_of(q) for q in queries]))
        for batch in batches:
            column = batch.column("text").cast(pa.large_string())
            size = len(column)
            bounds = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + size + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
            segment = Segment(data, bounds - bounds[0], wanted)
            spans: list[list[tuple[int, int, int]]] = [[] for _ in range(size)]
            tried = np.zeros(size, np.int32)
            texts = column.to_pylist()
            for k, rule in enumerate(rules):
                rows = segment.rows_for(queries[k])
                tried[rows] += 1
                for row in rows.tolist():
                    spans[row].extend((s, k, e) for s, e in matches(rule, compiled[k], texts[row]))
            out = [batch.column("doc_id").cast(pa.int64())]
            for k in base:
                out.append(pa.array([sum(x[1] == k for x in row) for row in spans], pa.int64()))
            listed = [_listed([x for x in row if rules[x[1]].base], rules) for row in spans]
            out.append(pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed], pa.string()))
            out.append(pa.array([_listed(row, rules) for row in spans], pa.string()))
            out.append(pa.array(tried))
            names = ["doc_id", *[f"n_{rules[k].kind}" for k in base], "base_sha256", "spans", "n_candidates"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole(F.col("text")).alias("text")).mapInArrow(scan, schema)
