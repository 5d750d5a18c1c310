"""Decontamination, sharding, encoding, quality, chat, archives and the pipeline."""

from __future__ import annotations

import hashlib
import heapq
import io
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rollout_lake.llm import bpe, chat, decontaminate, line_dedup, near_stage, quality, sharding, warc


def tokens(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute_overlap(doc, items):
    t, at = tokens(doc), set()
    for item in items:
        b = tokens(item)
        if not b:
            continue
        n = min(13, len(b))
        least = -(-4 * n // 5) if n >= 8 else n
        for w in {tuple(b[i:i + n]) for i in range(len(b) - n + 1)}:
            at |= {s for s in range(len(t) - n + 1) if sum(x == y for x, y in zip(t[s:s + n], w)) >= least}
    return len(at)


def test_masks_survive_two_substitutions():
    places = [(m, o) for m in decontaminate.MASKS for o in range(decontaminate.WINDOW - m[-1])]
    for n in (0, 1, 2):
        for hit in combinations(range(decontaminate.WINDOW), n):
            assert any(not {o + x for x in m} & set(hit) for m, o in places)


@pytest.mark.parametrize("n", range(1, 13))
def test_short_masks_survive_substitutions(n):
    most = n - decontaminate.equal_tokens(n)
    places = [(m, o) for m, at in decontaminate.short_masks(n) for o in at]
    assert all(o + m[-1] < n for m, o in places) and (n >= 8 or places == [(tuple(range(n)), 0)])
    for hit in combinations(range(n), most):
        assert any(not {o + x for x in m} & set(hit) for m, o in places)


def test_short_items_with_substitutions(spark):
    rng = random.Random(21)
    items, texts = [], []
    for n in range(1, 14):
        for k in range(3):
            words = [f"i{n}x{k}y{j}" for j in range(n)]
            items.append((100 * n + k, " ".join(words)))
            for changes in range(4):
                w = list(words)
                for j in rng.sample(range(n), min(n, changes)):
                    w[j] = "changed"
                texts.append((len(texts), " ".join(["before"] * rng.randrange(3) + w + ["after"] * rng.randrange(3))))
    nameless = [(None, items[-1][1]), (None, "a clean text without a name"), (None, None), (None, "another clean one")]
    docs = spark.createDataFrame([(*t, 7) for t in texts + nameless], "doc_id long, text string, tag int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [brute_overlap(t, [i[1] for i in items]) for _, t in texts + nameless]
    for most in (10**6, 0):
        found = decontaminate.overlaps(docs, bench, most).where("tag = 0").groupBy("doc_id").count().collect()
        assert {r["doc_id"]: r["count"] for r in found} == {i: n for i, n in zip(range(len(texts)), want) if n}
    got = Counter((r["doc_id"], r["n_windows"]) for r in decontaminate.report(docs, bench).collect())
    assert got == Counter((i, n) for (i, _), n in zip(texts + nameless, want))
    kept = decontaminate.keep_clean(docs, bench)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter(t for t, n in zip(texts + nameless, want) if not n)


def test_decontamination(spark, sf, docs):
    items = spark.read.parquet(f"{sf}/benchmark.parquet")
    tests = [r["text"] for r in items.collect()]
    rng = random.Random(4)
    planted = []
    for i in range(60):
        w = rng.choice(tests).split()
        k = rng.randrange(8, len(w) + 1)
        part = w[:k]
        for j in rng.sample(range(k), min(k, rng.randrange(0, 5))):
            part[j] = "changed"
        planted.append((10_000 + i, " ".join(["before"] * rng.randrange(3) + part + ["after"] * rng.randrange(3))))
    planted += [(20_000, None), (20_001, ""), (None, tests[0]), (20_002, tests[1].upper() + " x" * 30_000), (20_003, tests[2]), (20_003, tests[2])]
    extra = [(900, "exactly nine words of a short test item here"), (901, "too short"), (902, None), (903, tests[0]), (None, None)]
    planted.append((20_004, "so EXACTLY nine words, of a short test item here!"))
    planted.append((20_005, "so exactly nine words of a short other item here"))
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    bench = items.select("item_id", "text").unionByName(spark.createDataFrame(extra, "item_id long, text string"))
    got = decontaminate.report(more, bench).collect()
    want = [(r["doc_id"], brute_overlap(r["text"], tests + [e[1] for e in extra])) for r in more.collect()]
    assert sorted([(r["doc_id"], r["n_windows"]) for r in got], key=str) == sorted(want, key=str)
    assert all(r["contaminated"] == (r["n_windows"] > 0) for r in got) and 20 < sum(r["contaminated"] for r in got) < len(got)
    ways = [decontaminate.overlaps(more, bench, most) for most in (10**6, 0)]
    assert len({frozenset(map(tuple, w.collect())) for w in ways}) == 1
    clean = decontaminate.keep_clean(more, bench)
    assert clean.columns == more.columns
    assert sorted([r["doc_id"] for r in clean.collect()], key=str) == sorted([i for i, n in want if not n], key=str)
    assert decontaminate.report(more.limit(0), bench).count() == 0
    assert decontaminate.report(more, bench.limit(0)).where("contaminated").count() == 0


def heap_loads(sizes, shards):
    heap = [(0, i) for i in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, i = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, i))
    return [load for load, _ in sorted(heap, key=lambda x: x[1])]


@pytest.mark.parametrize("seed", range(8))
def test_schedule_is_that_of_a_heap(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(0 if seed == 3 else 1, rng.choice([4, 50, 3000])) for _ in range(rng.choice([5, 400, 3000]))]
    sizes += [10**6] * (seed % 3) + [17] * 5000 * (seed % 2)
    made = sharding.schedule(Counter(sizes).items(), 7)
    assert [sum(size * given[i] for size, given in made) for i in range(7)] == heap_loads(sizes, 7)
    assert all(sum(given) == Counter(sizes)[size] for size, given in made)


@pytest.mark.parametrize("which", ["docs", "tricky", "nothing"])
def test_sharding(request, which):
    df = request.getfixturevalue(which)
    got = sharding.shard_documents(df, 24).collect()
    rows = df.select("doc_id", "text").collect()
    sized = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sized
    slots, groups, loads = defaultdict(list), defaultdict(set), Counter()
    for r in got:
        slots[r["shard"]].append(r["slot"])
        groups[r["text_crc32"], r["size"]].add(r["shard"])
        loads[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in groups.values())
    groups_of = Counter()
    for r in rows:
        groups_of[r["text"] or ""] += len((r["text"] or "").encode()) + 8
    assert sorted(loads[i] for i in range(24)) == sorted(heap_loads(groups_of.values(), 24))


@pytest.mark.parametrize("which", ["docs", "tricky", "nothing"])
def test_bpe_equals_the_library(request, which):
    from tokenizers import Tokenizer

    df = request.getfixturevalue(which)
    library = Tokenizer.from_file(bpe.default_vocabulary())
    want = []
    for r in df.select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, bpe.digests(df).collect()), key=str) == sorted(want, key=str)
    full = bpe.encode(df)
    assert full.columns[:len(df.columns)] == df.columns
    assert all(len(r["token_ids"]) == r["n_tokens"] for r in full.collect())


def test_bpe_on_random_characters():
    from tokenizers import Tokenizer

    path = bpe.default_vocabulary()
    library, own, rng = Tokenizer.from_file(path), bpe.Bpe(path), random.Random(1)
    odd = ["  \n\n x \x1c\x1d\x85 y　​", "it's we'll I'M 'sx", "aaaaaaaaaaaaa", "<|endoftext", "<|endoftext|><|endoftext|>", " a "]
    kinds = [lambda: chr(rng.randrange(32, 127)), lambda: chr(rng.randrange(0x300)), lambda: chr(rng.randrange(0x2000, 0x3100)), lambda: rng.choice(" \n\tae1'")]
    texts = odd + ["".join(rng.choice(kinds)() for _ in range(rng.randrange(50))) for _ in range(2000)]
    for text, got, want in zip(texts, own.encode_batch(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert got.tolist() == want.ids, repr(text)
        assert own.decode(got) == library.decode(want.ids, skip_special_tokens=False)


def test_quality(spark, tricky, nothing):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    scored = quality.score(docs, model).join(labels.select("doc_id", "quality"), "doc_id").where(
        quality.held_out(F.col("doc_id"))
    ).select("score", "predicted", "quality").collect()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in docs.select("doc_id", quality.held_out(F.col("doc_id"))).collect())
    assert len(scored) > 50 and sum(r["predicted"] == r["quality"] for r in scored) / len(scored) > 0.95
    moved = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.train(docs, moved)
    assert np.array_equal(model.weights, again.weights) and model.bias == again.bias
    odd = quality.score(tricky, model).collect()
    assert len(odd) == tricky.count() and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in odd)
    assert quality.score(nothing, model).count() == 0
    blank = quality.train(nothing, labels.limit(0))
    assert {r["score"] for r in quality.score(tricky, blank).collect()} == {0.5}
    kept = quality.keep_good(tricky, model)
    assert kept.columns == tricky.columns


def plain_leader(z, n, alpha=3.0, beta=1.0, l1=1e-5, l2=0.001):
    return 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((beta + math.sqrt(n)) / alpha + l2)


def plain_ftrl(rows, labels, epochs, alpha=3.0):
    """Follow-the-regularised-leader over dictionaries, one feature at a time."""
    z, n = defaultdict(float), defaultdict(float)
    for _ in range(epochs):
        for x, y in zip(rows, labels):
            w = {f: plain_leader(z[f], n[f]) for f in x}
            p = 1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items())))
            for f, v in x.items():
                g = (p - y) * v
                sigma = (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / alpha
                z[f] += g - sigma * w[f]
                n[f] += g * g
    return {f: plain_leader(z[f], n[f]) for f in z}


def test_classifier_equals_a_plain_one(docs):
    rng = random.Random(3)
    texts = [r["text"] for r in docs.collect()][:198] + ["", "one"]
    labels = [rng.randrange(2) for _ in texts]
    features = quality.Features()
    rows = []
    for t in texts:
        x = defaultdict(float, {"bias": 1.0})
        for kind in features.places(t):
            for at in kind.tolist():
                x[at] += quality.SCALE / len(kind)
        rows.append(x)
    want = plain_ftrl(rows, labels, quality.EPOCHS)
    got = quality.train_part(texts, labels)
    assert got[-1] == pytest.approx(want.pop("bias"), rel=1e-4)
    assert np.count_nonzero(got[:-1]) <= len(want)
    assert [got[f] for f in want] == pytest.approx(list(want.values()), rel=1e-3, abs=1e-5)
    model = quality.Model(got[:-1].astype(np.float32), float(got[-1]))
    for x, t in list(zip(rows, texts))[::20]:
        total = model.bias + sum(float(model.weights[f]) * v for f, v in x.items() if f != "bias")
        assert model.score(features.places(t)) == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-5)


def brute_chat(turns):
    grouped = defaultdict(list)
    for c, t, r, x in turns:
        grouped[c].append((t is not None, t or 0, r or "", x or ""))
    whole = {c: tuple((r, x) for *_, r, x in sorted(v)) for c, v in grouped.items()}
    prefixes = {v[:n] for v in whole.values() for n in range(1, len(v))}
    low = lambda c: -(2**63) if c is None else c
    out = {}
    for c, v in whole.items():
        same = [d for d, w in whole.items() if w == v]
        if v not in prefixes and min(same, key=low) == c:
            out[c] = (len(v), len(same), "".join(f"<|{r}|>\n{x}\n" for r, x in v))
    return out


def test_chat(spark, sf):
    rng = random.Random(6)
    talk = [(f"r{i % 2}", f"text {i % 5}") for i in range(2600)]
    rows = [(c, t, *talk[t]) for c, n in ((1, 3), (2, 2), (3, 3), (4, 2600), (5, 1025), (-7, 1)) for t in range(n)]
    rows += [(9, 0, None, None), (9, 0, None, None), (9, None, "r", "x"), (None, 1, "r0", "solo"), (None, 1, "r0", "solo"), (10, 5, "other", "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "p") for r in rows], "conv_id long, turn long, role string, text string, pos int, p1 string").repartition(5)
    got = defaultdict(dict)
    for r in chat.render(df, parted=True).collect():
        got[r["conv_id"]][r["part"]] = r
    flat = {c: (p[0]["n_turns"], p[0]["n_copies"], "".join(p[i]["text"] for i in sorted(p))) for c, p in got.items()}
    assert flat == brute_chat(rows)
    assert sorted(got[4]) == [0, 1, 2]
    assert [(r["conv_id"], r["n_turns"], r["n_copies"], r["text"]) for r in chat.render(df).orderBy("conv_id").collect()] == [
        (c, *flat[c]) for c in sorted(flat, key=lambda c: (c is not None, c))]
    real = spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert {r["conv_id"]: (r["n_turns"], r["n_copies"], r["text"]) for r in chat.render(real).collect()} == brute_chat(map(tuple, real.collect()))
    assert chat.render(df.limit(0)).count() == 0


def test_warc_round_trip(spark, tmp_path):
    long = "é<p>" * 400
    pages = [(1, "http://a", long), (2, "http://b\r\nX: y", long), (3, None, long), (4, "u", "short"), (5, "u", "short"), (6, "u", None),
             (7, "u", ""), (8, "u", "a\r\n\r\nb" * 200_000), (None, "u", "none"), (9, "u", long + "x"), (9, "u", long + "x")]
    df = spark.createDataFrame([(*p, 1, "z") for p in pages], "page_id long, url string, html string, size int, sha1 string").repartition(3)
    manifest = warc.write_archives(df, str(tmp_path / "w"), archive_bytes=2000)
    assert manifest.agg(F.sum("n_records")).first()[0] == len(pages) and manifest.count() > 2
    got = warc.read_archives(manifest, keep_payload=True).collect()
    digest = lambda h: hashlib.sha1((h or "").encode()).hexdigest()
    want = [(i, len((h or "").encode()), digest(h), "revisit" if i in (1, 2) else "response", 3 if i in (1, 2) else None) for i, _, h in pages]
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=str) == sorted(want, key=str)
    assert all(r["verified"] for r in got)
    texts = {r["page_id"]: r["payload"].decode() for r in got if r["record_type"] == "response"}
    assert texts[8] == pages[7][2] and texts[6] == "" and texts[3] == long
    assert warc.round_trip(df.limit(0)).count() == 0


def member(lines, block):
    whole = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(whole) + packer.flush()


def test_warc_reader_takes_records_of_other_writers():
    http = b"HTTP/1.0 200 OK\r\nSERVER: x\r\nodd line\r\ncontent-length: 5\r\n\r\nhello"
    sha = hashlib.sha1(http).hexdigest()
    records = [
        (["WARC/1.0", "WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>", "Content-Type: application/warc-fields", "Content-Length: 13"], b"software: x\r\n"),
        (["WARC/1.0", "warc-type: response", "WARC-Record-ID: <urn:uuid:2>", "content-type: application/http;msgtype=response", f"WARC-Block-Digest: sha1:{sha}",
          f"content-length:{len(http)}"], http),
        (["WARC/1.1", "WARC-Type: request", "Content-Type: application/http; msgtype=request", "Content-Length: 18"], b"GET / HTTP/1.1\r\n\r\n"),
        (["WARC/1.1", "WARC-Type: metadata", "X-Long: one", " two", "WARC-Block-Digest: sha256:00", "Content-Length: 0"], b""),
        (["WARC/1.1", "WARC-Type: resource", "WARC-Payload-Digest: sha1:" + "A" * 32, "Content-Length: 3"], b"abc"),
    ]
    got = list(warc.Reader(io.BytesIO(b"".join(member(*r) for r in records)), keep_payload=True))
    assert [r.headers["WARC-Type"] for r in got] == ["warcinfo", "response", "request", "metadata", "resource"]
    assert [r.payload for r in got] == [b"software: x\r\n", b"hello", b"", b"", b"abc"]
    assert [r.verified for r in got] == [None, True, None, None, False] and got[3].headers["x-long"] == "one two"
    assert got[1].http_size == 5 and got[1].headers["Content-Length"] == str(len(http))
    for bad in (["WARC/1.1", "WARC-Type: resource", "Content-Length: 9"], ["WARC/1.1", "Content-Length: x"], ["WARC/1.1", "WARC-Type: resource"],
                ["HTTP/1.1 200", "Content-Length: 3"], ["WARC/1.1", "no colon", "Content-Length: 3"]):
        with pytest.raises(ValueError):
            list(warc.Reader(io.BytesIO(member(bad, b"abc"))))


def test_archives_of_other_writers_become_rows(spark, tmp_path):
    path = tmp_path / "other.warc.gz"
    path.write_bytes(member(["WARC/1.0", "WARC-Type: warcinfo", "WARC-Record-ID: <urn:uuid:1>", "Content-Length: 2"], b"ab")
                     + member(["WARC/1.0", "WARC-Type: revisit", "WARC-Refers-To: <urn:uuid:9>", "Content-Length: 0"], b""))
    rows = warc.read_archives(spark.createDataFrame([(str(path), 2, 0)], warc.MANIFEST), keep_payload=True).collect()
    assert [(r["page_id"], r["record_type"], r["payload_bytes"], r["refers_to"], r["verified"]) for r in rows] == [
        (None, "warcinfo", 2, None, None), (None, "revisit", 0, None, None)]


def test_warc_reader_finds_damage():
    whole = b"".join(warc.record(str(i), "u", 5, hashlib.sha1(b"hello").hexdigest(), b"hello", None) for i in range(3))
    assert [r.headers["WARC-Record-ID"] for r in warc.Reader(io.BytesIO(whole))] == [f"<urn:page:{i}>" for i in range(3)]
    with pytest.raises(ValueError):
        list(warc.Reader(io.BytesIO(whole[:-15])))
    with pytest.raises(ValueError):
        list(warc.Reader(io.BytesIO(whole[3:])))
    other = warc.record("1", "u", 5, hashlib.sha1(b"other").hexdigest(), b"hello", None)
    assert [r.verified for r in warc.Reader(io.BytesIO(other))] == [False]


def shingles(text, n=5):
    w = (text or "").lower().split()
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_near_stage(spark, docs, tricky, nothing):
    rng = random.Random(8)
    base = [f"word{rng.randrange(5000)}" for _ in range(400)]
    rows = [(1, " ".join(base)), (2, " ".join(base)), (3, None), (4, ""), (None, " ".join(base))]
    for i in range(40):
        w = list(base)
        for j in rng.sample(range(400), 2):
            w[j] = f"new{i}"
        rows.append((10 + i, " ".join(w)))
    rows += [(100 + i, " ".join(f"word{rng.randrange(5000)}" for _ in range(300))) for i in range(50)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, node int")
    kept = near_stage.keep_one(df)
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == df.columns
    assert {None, 1, 3, *range(100, 150)} <= ids and not {2, 4} & ids and len([i for i in ids if i and 10 <= i < 50]) <= 6
    assert near_stage.keep_one(nothing).count() == 0 and near_stage.keep_one(tricky).count() > 8
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    left = {r["doc_id"] for r in near_stage.keep_one(docs).collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    near = {i: {j for j in texts if j != i and sets[i] | sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in texts}
    assert all(near[i] or not sets[i] for i in texts if i not in left)
    twice = sum(1 for i in left for j in near[i] if j in left and i < j)
    assert twice <= 0.1 * sum(map(len, near.values())) / 2


def kept_by_brute_force(texts):
    """The smallest id of each group of texts linked by shingles that agree to 0.8 or by the same words."""
    sets = {i: shingles(t) for i, t in texts.items()}
    low = {i: i for i in texts}

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i, j in combinations(sorted(texts), 2):
        both = len(sets[i] & sets[j])
        if both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
            a, b = sorted((root(i), root(j)))
            low[b] = a
    return {i for i in texts if root(i) == i}


def test_near_stage_finds_every_contiguous_edit(spark):
    rng = random.Random(11)
    new = lambda n: [f"word{rng.randrange(20_000)}" for _ in range(n)]
    texts = {}
    for i in range(90):
        base = new(rng.choice([5, 9, 40, 150, 600]))
        k = round(len(base) * rng.uniform(0.08, 0.27))
        texts[2 * i] = " ".join(base)
        texts[2 * i + 1] = " ".join([base + new(k), new(k) + base, base[:len(base) - k]][i % 3])
    passage = " ".join(new(60))
    texts |= {1000 + i: f"{passage} {' '.join(new(rng.choice([8, 30])))}" for i in range(40)}
    left = near_stage.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    want = kept_by_brute_force(texts)
    assert 20 < len(texts) - len(want) and {r["doc_id"] for r in left} == want


def test_near_stage_does_not_stop_at_the_head_of_a_fingerprint(spark):
    rng = random.Random(12)
    w = [f"word{i}" for i in range(200)]
    other = rng.sample(w, 200)
    texts = {1: other, 2: w, 3: w[20:] + w[:20]}
    base = [f"star{i}" for i in range(200)]
    for i, at in enumerate((10, 70, 130)):  # each near the base, none near another
        texts[31 + i] = base[:at] + base[at + 20:at + 40] + base[at:at + 20] + base[at + 40:]
    texts = {i: " ".join(x) for i, x in (texts | {34: base}).items()}
    left = near_stage.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in left} == kept_by_brute_force(texts) == {1, 2, 31}


def test_pipeline(spark, sf, docs):
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = now
        now = corpus_pipeline.written(stage(spark, before, sf), "test-stage")
        ids = [r["doc_id"] for r in now.select("doc_id").collect()]
        assert len(ids) == len(set(ids))
        if name != names[-1]:
            assert now.dtypes == docs.dtypes
        if name in ("line dedup", names[-1]):
            assert len(ids) == before.count()
        if name == "line dedup":
            want = line_dedup.drop_lines(before, line_dedup.new_state(before))
            assert {tuple(r) for r in now.select("doc_id", "text").collect()} == {tuple(r) for r in want.select("doc_id", "text").collect()}
            assert now.where("n_chars <> length(text)").count() == 0
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert all(not brute_overlap(r["text"], items) for r in now.collect())
    result = corpus_pipeline.run(spark, sf)
    assert {(r["doc_id"], r["ids_sha256"]) for r in result.collect()} == {(r["doc_id"], r["ids_sha256"]) for r in now.collect()}


def test_pipeline_on_odd_rows(spark, sf, tricky, nothing):
    """Null ids and texts, repeated rows and columns named like the stages' own come through the whole chain."""
    rows = tricky.selectExpr("*", "99L as n_lines", "'mine' as n_dropped", "1 as tag", "2 as node")
    now = rows
    for name, stage in corpus_pipeline.STAGES:
        if name == "quality classifier":  # it may reject any of these rows
            assert stage(spark, now, sf).columns == now.columns
            continue
        now = corpus_pipeline.written(stage(spark, now, sf), "odd-stage")
        assert now.columns[:len(rows.columns)] == rows.columns
        assert {(r["n_lines"], r["n_dropped"], r["tag"], r["node"]) for r in now.collect()} == {(99, "mine", 1, 2)}
    ids = [r["doc_id"] for r in now.collect()]
    assert None in ids and {-3, 6, 12, 13}.issubset(ids) and 4 in ids and 5 not in ids  # 5 has the text of 4
    empty = nothing
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.written(stage(spark, empty, sf), "empty-stage")
        assert empty.count() == 0


@pytest.mark.parametrize("name", ["op1_line_dedup", "op9_chat", "op10_warc"])
def test_registered_queries_exist(name):
    import __spark_entry__ as entry

    assert name in entry.queries() and name in entry.oracle_sql() and "pipeline" in entry.queries()
