"""Cross-tokenizer alignment against whole-text encoding and plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from rollout_lake.llm import alignment


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(alignment.default_vocabulary())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())


def brute(rows, libraries):
    """Every contract column by plain loops over whole texts."""
    lib_a, lib_b = libraries
    letters = {c: b for c, b in alignment.byte_letters().items()}
    vocab = {i: bytes(letters[c] for c in t) for t, i in lib_a.get_vocab().items() if all(c in letters for c in t)}
    made = []
    for doc_id, text in rows:
        made.append((doc_id, [], 0, 0))
        if not text:
            continue
        a = lib_a.encode(" " + text, add_special_tokens=False).ids
        b = lib_b.encode(text)
        raw_a = [vocab[i] for i in a]
        raw_b = [bytes([int(lib_b.id_to_piece(i)[3:5], 16)]) if lib_b.is_byte(i) else lib_b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(raw_a) == b"".join(raw_b) == (" " + text).encode():
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            k, m = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((a[i:k], b[j:m]))
            i, j = k, m
        made[-1] = (doc_id, groups, len(a), len(b))
    counts = Counter((g[0][-1], g[1][-1]) for m in made for g in m[1])
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for doc_id, groups, n_a, n_b in made:
        links = [(g[0][-1], g[1][-1]) for g in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links),
                    hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def plain(df):
    return sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"], r["groups_sha256"])
                   for r in df.collect()), key=str)


MIXED = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "▁ literal"), (6, "x▁y z"), (7, "<|endoftext|> and <unk> </s> <0x41>"), (8, "tab\tand\r\nlines\n\n  deep"),
    (9, "日本語 の テキスト 😀 emoji 👩‍👩‍👧 done"), (9, "日本語 の テキスト 😀 emoji 👩‍👩‍👧 done"), (None, "no id here"), (10, "  two lead and trail  "),
    (11, "nb sp 　 wide em \x85 next"), (12, "\x00 nul \x1c fs it's we'll I'm"), (13, "longword" * 300), (14, "7" * 500 + " " + "é" * 400),
]


@pytest.mark.parametrize("chunk", [1 << 16, 200, 23])
def test_alignment(spark, docs, libraries, chunk):
    base = [(r["doc_id"], r["text"]) for r in docs.collect()][:60 if chunk < 100 else 200]
    rows = base + MIXED + [(20, base[0][1]), (20, base[0][1])]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, codes string, row int").repartition(3)
    want = brute(rows, libraries)
    assert plain(alignment.report(df, chunk=chunk)) == want
    if chunk == 200:
        assert plain(alignment.report(df, chunk=chunk, broadcast_pairs=0)) == want


def test_alignment_of_nothing(spark, nothing):
    assert alignment.report(nothing).collect() == []
    assert alignment.report(nothing, broadcast_pairs=-1).collect() == []


def test_fragments_compose_associatively(libraries):
    pair = alignment.Pair(alignment.default_vocabulary(), alignment.default_pieces())
    rng = random.Random(3)
    text = " " + " ".join(rng.choice(["unbelievable", "naïveté", "token", "日本", "x-ray's", "9081"]) for _ in range(60))
    whole = pair.encode([text])
    raw = len(text.encode())
    want = alignment.fragment(pair, whole[0], 0, 0, raw)
    for _ in range(50):
        borders = sorted({0, raw, *rng.sample(range(1, raw), 9)})
        parts = [alignment.fragment(pair, whole[0], 0, s, e) for s, e in zip(borders, borders[1:])]
        while len(parts) > 1:
            at = rng.randrange(len(parts) - 1)
            parts[at:at + 2] = [alignment.compose(parts[at], parts[at + 1])]
        assert parts[0] == want


def test_both_byte_level_libraries_agree_on_every_character(libraries):
    pair = alignment.Pair(alignment.default_vocabulary(), alignment.default_pieces())
    texts = []
    for start in range(0, 0x110000, 64):
        chars = [chr(c) for c in range(start, min(start + 64, 0x110000)) if not 0xD800 <= c < 0xE000]
        texts.append(" " + "".join(f"a{c}b {c}{c} 1{c}" for c in chars))
    want = libraries[0].encode_batch(texts, add_special_tokens=False)
    assert all(pair.a.encode_ordinary(t) == w.ids for t, w in zip(texts, want))
