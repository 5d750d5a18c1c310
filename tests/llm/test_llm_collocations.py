"""Collocations against plain counters."""

from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pytest

from rollout_lake.llm import collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top, share=80):
    words, counts = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(UPPER)):
            w = re.findall("[^ \t]+", piece)
            words[lang] += len(w)
            for n in range(1, 5):
                counts.update((lang, *w[i:i + n]) for i in range(len(w) - n + 1))
    found = {p: c for p, c in counts.items() if len(p) > 2 and c >= least}
    gone = set()
    for p, c in found.items():
        w = p[1:]
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                part = (p[0], *w[i:i + n])
                if 100 * c >= share * counts[part]:
                    gone.add(part)
    out = []
    for p, a in found.items():
        if p in gone:
            continue
        cuts = []
        for k in range(1, len(p) - 1):
            left, right = counts[p[:k + 1]], counts[(p[0], *p[k + 1:])]
            cuts.append((2000000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out.append((p[0], " ".join(p[1:]), a, left, right, words[p[0]], score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranked, at = [], Counter()
    for r in out:
        at[r[0]] += 1
        if at[r[0]] <= top:
            ranked.append((r[0], at[r[0]], *r[1:]))
    return ranked


def plain(df):
    return sorted(((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in df.collect()),
                  key=lambda r: (r[0], r[1]))


def frame(spark, rows):
    return spark.createDataFrame([(i, lang, text, 1, "x") for i, (lang, text) in enumerate(rows)],
                                 "doc_id long, lang string, text string, n long, phrase string").repartition(3)


@pytest.mark.parametrize("hot,filter_words", [(1024, 10**6), (20, 10**6), (1, 0)])
def test_phrases(spark, docs, hot, filter_words):
    rng = random.Random(5)
    rows = [(r["lang"], r["text"]) for r in docs.collect()]
    rows += [(None, None), ("en", ""), ("en", " \t\n.,;"), (None, "New York. New York! new\tyork, NEW YORK City"), ("", "é É é É x"), ("de", "a " * 3000)]
    rows += [("xx", " ".join(rng.choice("the of and to".split() + ["w%d" % rng.randrange(9)]) for _ in range(3000)))]
    rows += [("zz", ("one very common passage here of many words. " * 20))] * 3
    want = brute(rows, 6, 50)
    assert len(want) > 150
    assert plain(collocations.report(frame(spark, rows), least=6, top=50, hot=hot, filter_words=filter_words)) == sorted(want, key=lambda r: (r[0], r[1]))


def test_no_phrases(spark, nothing):
    df = nothing.selectExpr("doc_id", "text", "'en' as lang")
    assert collocations.report(df).collect() == []
    assert collocations.report(frame(spark, [("en", None), ("en", "few words")])).collect() == []


def test_words_with_one_hash_are_told_apart(spark, monkeypatch):
    rows = [("en", "alpha beta. gamma delta. " * 9)]
    real = collocations._lang_code
    monkeypatch.setattr(collocations, "_lang_code", lambda lang, seed: 7 if seed == 0 else real(lang, seed))
    # languages that share a code share their words' hashes; the next seed tells them apart
    both = rows + [("fr", rows[0][1])]
    for parts in (1, 2):
        got = plain(collocations.report(frame(spark, both).repartition(parts), least=6))
        assert got == sorted(brute(both, 6, 2000))


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(2)
    data = np.sort(rng.integers(0, 6, (4, 20_000)).astype(np.uint64), axis=0)[::-1]  # zeros come last
    weight = rng.integers(1, 4, 20_000)
    got = {tuple(int(c[at]) for c in data[:n]): count for n, at, count in collocations.frequent_prefixes(list(data), weight, 500)}
    want = Counter()
    for row, w in zip(data.T.tolist(), weight.tolist()):
        for n in (2, 3, 4):
            if 0 not in row[:n]:
                want[tuple(row[:n])] += w
    assert got == {p: c for p, c in want.items() if c >= 500}


def test_long_texts_are_cut_between_pieces(monkeypatch):
    monkeypatch.setattr(collocations, "SLICE_BYTES", 10)
    text = b"one two three. four five six seven eight nine ten, eleven"
    assert list(collocations._parts(text)) == [b"one two three.", b" four five six seven eight nine ten,", b" eleven"]
