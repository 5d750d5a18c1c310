"""Line dedup, fingerprints, secrets and SimHash against brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import struct
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rollout_lake.llm import components, line_dedup, secret_scan, simhash, sketches

BLANK = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def brute_lines(rows):
    holders = defaultdict(set)
    key = lambda line: line.strip(BLANK).translate(LOWER)
    low = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders[key(line)].add(low(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < 3 or max(holders[key(x)]) == low(i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("which", ["docs", "tricky", "nothing"])
def test_lines(request, which):
    df = request.getfixturevalue(which)
    got = line_dedup.drop_lines(df, line_dedup.new_state(df)).select("doc_id", "n_lines", "n_dropped", "text").collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(pairs(df))
    if which == "docs":
        assert sum(r["n_dropped"] for r in got)


def as_sets(state):
    counts = {(r["h1"], r["h2"]): (r["n_docs"], r["keeper"]) for r in state.counts.collect()}
    held = {r["shard"]: line_dedup.CuckooFilter(r["buckets"], np.array(r["slots"])) for r in state.filters.collect()}
    return counts, held


def test_line_state_is_reversible(docs, nothing, spark):
    first, second = docs.where("doc_id % 3 <> 1"), docs.where("doc_id % 3 = 1")
    start = line_dedup.new_state(first)
    grown = line_dedup.insert(start, second)
    whole = line_dedup.new_state(docs)
    assert as_sets(grown)[0] == as_sets(whole)[0]
    back = line_dedup.delete(grown, second, first)
    assert as_sets(back)[0] == as_sets(start)[0]
    for state in (start, grown, back):
        counts, held = as_sets(state)
        inside = [k for k, (n, _) in counts.items() if n >= 3]
        assert inside and all(held[k[0] % state.shards].contains(k[1]) for k in inside)
        assert sum((f.slots > 0).sum() for f in held.values()) == len(inside) == state.keys
    got = line_dedup.drop_lines(docs, grown).select("doc_id", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, line_dedup.drop_lines(docs, whole).select("doc_id", "text").collect()))
    from_none = line_dedup.insert(line_dedup.empty_state(spark), first)
    assert as_sets(from_none)[0] == as_sets(start)[0]


def test_cuckoo_filter():
    rng = random.Random(1)
    keys = [rng.getrandbits(64) - 2**63 for _ in range(5000)]
    made = line_dedup.build_filter(keys)
    assert all(made.contains(k) for k in keys)
    others = [rng.getrandbits(64) - 2**63 for _ in range(5000)]
    assert sum(made.contains(k) for k in others) < 20
    assert all(made.delete(k) for k in keys) and not made.slots.any()


def test_filter_rule_in_columns(spark):
    rng = random.Random(2)
    keys = [rng.getrandbits(64) - 2**63 for _ in range(3000)]
    made = line_dedup.build_filter(keys[:1500])
    df = spark.createDataFrame([(k,) for k in keys], "h2 long").crossJoin(
        spark.createDataFrame([(made.slots.tolist(), made.buckets)], "slots array<int>, buckets long")
    )
    got = {r["h2"]: r["m"] for r in df.select("h2", line_dedup.may_contain(F.col("h2"), F.col("slots"), F.col("buckets")).alias("m")).collect()}
    assert got == {k: made.contains(k) for k in keys}


def brute_sketch(text, k=256, width=5):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    h = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    grams = [h[i:i + width] for i in range(max(1, len(h) - width + 1))] if h else []
    out = set()
    for g in grams:
        seed = 42
        for v in g:
            seed = xxhash.xxh64_intdigest(struct.pack("<Q", v), seed)
        out.add(seed - 2**64 if seed >= 2**63 else seed)
    return sorted(out)[:k]


def brute_likeness(a, b, k=256):
    union = sorted(set(a) | set(b))[:k]
    return len(set(union) & set(a) & set(b)) / len(union) if union else 1.0


@pytest.mark.parametrize("which", ["docs", "tricky", "nothing"])
def test_fingerprints(request, which):
    df = request.getfixturevalue(which)
    got = sketches.edited_pairs(df).collect()
    tie = {t: h for t, h in df.select(F.coalesce("text", F.lit("")), F.xxhash64(F.coalesce("text", F.lit("")))).collect()}
    rows = sorted([(-(2**63) if i is None else i, tie[t or ""], i, t or "") for i, t in pairs(df)])
    want = []
    for n, (_, _, i, t) in enumerate(rows):
        after = rows[(n + 1) % len(rows)][3]
        half = len(t) // 2
        edited = t[:len(t) - half] + after[:half]
        a, b, c = brute_sketch(t), brute_sketch(edited), brute_sketch(after)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, brute_likeness(a, b), brute_likeness(a, c)))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_sketch_estimates(spark, docs):
    a, b = " ".join(f"w{i}" for i in range(4000)), " ".join(f"w{i}" for i in range(1000, 5000))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(
        sketches.sketch(F.col("a")).alias("x"), sketches.sketch(F.col("b")).alias("y"), sketches.sketch(F.concat_ws(" ", "a", "b")).alias("z")
    )
    r = df.select(
        sketches.resemblance(F.col("x"), F.col("y")).alias("j"), sketches.containment(F.col("x"), F.col("y")).alias("c"),
        sketches.distinct_shingles(F.col("x")).alias("n"), sketches.text_form(F.col("x")).alias("t"), "x",
    ).first()
    assert abs(r["j"] - 0.6) < 0.12 and abs(r["c"] - 0.75) < 0.15 and abs(r["n"] / 3996 - 1) < 0.25
    assert base64.b64decode(r["t"]) == b"".join(struct.pack(">q", v) for v in r["x"])
    parts = docs.select("source", sketches.sketch(F.col("text")).alias("s"))
    merged = {r["source"]: r["s"] for r in sketches.merge_parts(parts, ["source"], "s").collect()}
    for source, s in merged.items():
        every = {h for r in parts.where(F.col("source") == source).collect() for h in r["s"]}
        assert s == sorted(every)[:256]


BASE = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
]


def brute_secrets(t):
    spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(BASE) for m in p.finditer(t) if len(m[g]) >= n)
    text = ",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in spans)
    return [sum(x[1] == k for x in spans) for k in range(3)], hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("which", ["docs", "tricky", "nothing"])
def test_secrets(request, which):
    df = request.getfixturevalue(which)
    got = secret_scan.find_secrets(df).collect()
    want = [(i, *brute_secrets(t or "")[0], brute_secrets(t or "")[1]) for i, t in pairs(df)]
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)


def test_trigram_queries_lose_nothing(spark):
    samples = [
        "x API_KEY='abc123xyz' y", "apikey: zzzzzz", 'Passwd="hunter22"', "toKen=......", "ſecret=abcdefg", "secret = abc",
        "-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----", "ghp_" + "a" * 40, "xoxb-12345678901234", "AIza" + "b" * 36,
        "eyJabc.eyJdef.ghi", "postgres://me:pw@host", "AKIA" + "Z" * 16, "f" * 24, "nothing here", "", "é" * 30, "to\nken=abcdefgh",
    ]
    rng = random.Random(5)
    texts = samples + ["".join(rng.choices(samples + [" ", "\n", "a"], k=4)) for _ in range(300)]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.find_secrets(
        spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        spans = sorted((s, k, e) for k, r in enumerate(secret_scan.RULES) for s, e in secret_scan.matches(r, r.regex(), t))
        assert got[i] == ",".join(f"{secret_scan.RULES[k].kind}:{s}:{e}" for s, k, e in spans), t
    by_kind = {r.kind: secret_scan.trigram_query(r) for r in secret_scan.RULES}
    assert by_kind["hex"] == secret_scan.ALL and all(q != secret_scan.ALL for k, q in by_kind.items() if k != "hex")
    assert secret_scan.trigrams_of(by_kind["access"]) == {"aki", "kia"}


def brute_print(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(nodes, edges):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


@pytest.mark.parametrize("which", ["docs", "tricky", "nothing"])
def test_simhash_groups(request, which):
    df = request.getfixturevalue(which)
    got = sorted([(r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_groups(df).collect()], key=str)
    rows = [(-(2**63) if i is None else i, i, brute_print(t)) for i, t in pairs(df)]
    prints = sorted({f for *_, f in rows})
    root = brute_components(prints, [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3])
    low = {r: min(n for n, _, f in rows if root[f] == r) for r in root.values()}
    assert got == sorted([(i, f, None if low[root[f]] == -(2**63) else low[root[f]]) for _, i, f in rows], key=str)


@pytest.mark.parametrize("crowded", [1, 4, 2048])
def test_simhash_links_are_all_pairs(spark, crowded):
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for centre in list(prints)[:6]:
        prints |= {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5))) for _ in range(60)}
    signed = sorted(p - 2**64 if p >= 2**63 else p for p in prints)
    got = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), crowded=crowded)
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) % 2**64).bit_count() <= 3}
    listed = [tuple(r) for r in got.collect()]
    assert len(listed) == len(set(listed)) and set(listed) == want and len(want) > 1000


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1200)] + [
        (2000 + rng.randrange(400), 2000 + rng.randrange(400)) for _ in range(250)] + [(5, 5), (None, 3)]
    got = components.component_roots(spark.createDataFrame(edges, "a long, b long")).collect()
    real = [(a, b) for a, b in edges if a is not None and a != b]
    want = brute_components({x for e in real for x in e}, real)
    groups = defaultdict(set)
    for r in got:
        groups[r["root"]].add(r["node"])
    expected = defaultdict(set)
    for n, t in want.items():
        expected[t].add(n)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert components.component_roots(spark.createDataFrame([], "a long, b long")).count() == 0
