"""Operators against brute force, on small tables with nulls, empty and long texts, ties, repeats and clashing names."""

import hashlib
import pickle
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from granary.llm import decontam, hilbert, langid, mixing, quality, sharding, simhash, suffix, toolchat, toxicity
from granary.llm.common import Scratch, places
from granary.llm.components import connected
from granary.llm.sql import ORACLE

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, size int, shard int, row string, fp string"
WORDS = [f"w{i}" for i in range(400)]


def prose(rng, n, words=WORDS):
    return " ".join(rng.choice(words) for _ in range(n))


def corpus():
    rng = random.Random(5)
    base = [prose(rng, rng.randint(5, 120)) for _ in range(40)]
    passage = prose(rng, 60)
    texts = [None, None, "", "", " \n ", "one", "Ünïcödé wörds ÄÖ", "é" * 300, "a" * 900, prose(rng, 9000), base[0] + "!", *base, *base[:5], base[1], base[1]]
    texts += [f"{base[i]} {passage} {base[i + 1]}" for i in range(6)]
    for i in range(8):  # near copies: one word changed
        words = (base[10] + " " + base[11]).split()
        words[rng.randrange(len(words))] = "zz"
        texts.append(" ".join(words))
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "B", None, "ä"]), None if t is None else len(t), "k", 1, 2, "r", "f") for i, t in enumerate(texts)]
    rows += [(None, "null id", "en", "a", 7, "k", 1, 2, "r", "f"), (None, None, None, None, None, None, None, None, None, None), rows[20], rows[20]]
    return rows


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def raw(text):
    return (text or "").encode()


# ---- sharding


def least_capacity(sizes, shards):
    low, high = max(sizes, default=0), sum(sizes)
    while low < high:
        mid, used, room = (low + high) // 2, 1, 0
        room = mid
        for s in sizes:
            if s > room:
                used, room = used + 1, mid
            room -= s
        low, high = (low, mid) if used <= shards else (mid + 1, high)
    return low


def test_sharding(docs, empty):
    rows = sharding.shard_documents(docs, shards=7, cell_rows=5).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in corpus())
    groups = defaultdict(int)
    of = defaultdict(set)
    by_id = {r[0]: r[1] for r in corpus() if r[0] is not None}
    for r in rows:
        if r.doc_id is not None:
            text = by_id[r.doc_id]
            assert r.size == len(raw(text)) + 16 and r.text_crc32 == zlib.crc32(raw(text))
            of[raw(text)].add(r.shard)
    assert all(len(s) == 1 for s in of.values()), "equal texts stay together"
    for r in corpus():
        groups[hashlib.sha256(raw(r[1])).hexdigest()] += len(raw(r[1])) + 16
    best = least_capacity([groups[k] for k in sorted(groups)], 7)
    load = defaultdict(int)
    slots = defaultdict(list)
    for r in rows:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert max(load.values()) == best
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).count() == 0
    assert {r.shard for r in sharding.shard_of(docs, 7).collect()} == set(load)


def test_sharding_refines_to_single_groups(spark):
    rng = random.Random(1)
    rows = [(hashlib.sha256(str(i).encode()).hexdigest(), rng.choice([1, 2, 500])) for i in range(3000)]
    got, starts = sharding.partition(spark.createDataFrame(rows, "digest string, size long"), 9)
    assert got == least_capacity([s for _, s in sorted(rows)], 9) and len(starts) == 8


# ---- mixing


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    again = mixing.mix(docs).collect()
    key = lambda r: (r.doc_id is None, r.doc_id, r.size, r.taken)
    assert sorted(map(key, rows), key=str) == sorted(map(key, again), key=str)
    assert Counter(r.doc_id for r in rows) == Counter(r[0] for r in corpus())
    sizes = defaultdict(int)
    for r in corpus():
        sizes[r[3]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(target[s] for s in over)
        open_ -= over
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert r.taken == r.copies * r.size <= 2 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= max(r.size for r in rows if r.source == s) + 1e-6
    assert mixing.mix(empty).count() == 0 and mixing.take(empty).count() == 0


def test_mix_is_taken(docs):
    copies = Counter()
    for r in mixing.mix(docs).collect():
        copies[r.doc_id] += r.copies
    assert Counter(r.doc_id for r in mixing.take(docs).collect()) == +copies


def test_pivotal_rounding_keeps_mass_in_a_hot_source(spark, tmp_path):
    rng = random.Random(2)
    rows = [("hot" if i % 3 else f"s{i % 7}", rng.getrandbits(62), float(rng.randint(1, 50)), rng.uniform(0.01, 0.99)) for i in range(5000)]
    rows = [(s, r, int(n), p) for s, r, n, p in rows]
    df = spark.createDataFrame(rows, "source string, row long, size long, p double")
    out = mixing.pivotal_round(df, Scratch(spark, "test")).collect()
    assert len(out) == len(rows) and {r.p for r in out} == {0.0, 1.0}
    for s in {r[0] for r in rows}:
        assert abs(sum(r.p * r.size for r in out if r.source == s) - sum(n * p for t, _, n, p in rows if t == s)) <= 50


# ---- decontamination


def brute_report(text, items):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hit, names = set(), set()
    for name, item in items:
        other = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), item or ""))
        n = min(10, len(other))
        windows = {tuple(other[i : i + n]) for i in range(max(1, len(other) - 9))} if other else set()
        for i in range(len(words) - n + 1):
            if windows and tuple(words[i : i + n]) in windows:
                hit |= set(range(i, i + n))
                names.add(str(name))
    ids = ",".join(sorted(names))
    return len(words), len(hit), len(names), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_decontamination(spark, docs, empty, block):
    texts = [r[1] for r in corpus() if r[1]]
    items = [(1, texts[15]), (2, texts[16][:80].upper()), (3, "w1 w2"), (4, None), (5, "... !"), (6, "one"), (7, " ".join(texts[17].split()[3:15])), (8, prose(random.Random(9), 50)), (10, texts[15])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontam.report(docs, bench, block_words=block, pass_words=4 * block).collect())
    assert got == Counter(brute_report(r[1], items) for r in corpus())
    assert decontam.report(empty, bench).count() == 0
    assert not any(r.contaminated for r in decontam.report(docs, bench.limit(0)).collect())


def test_automaton_by_chance():
    rng = random.Random(4)
    for _ in range(60):
        words = [bytes([97 + i]) for i in range(3)]
        items = [(str(i), [rng.choice(words) for _ in range(rng.randint(1, 15))]) for i in range(rng.randint(1, 5))]
        text = [rng.choice([*words, b"z"]) for _ in range(60)]
        spans, found = decontam.Automaton(items, 4).match(text)
        hit = {k for a, b in spans for k in range(a, b)}
        want, names = set(), set()
        for k, item in items:
            n = min(4, len(item))
            for i in range(len(text) - n + 1):
                if any(text[i : i + n] == item[j : j + n] for j in range(len(item) - n + 1)):
                    want |= set(range(i, i + n))
                    names.add(int(k))
        assert hit == want and found == names and sum(b - a for a, b in spans) == len(hit)


def test_passages_are_cut(spark, docs):
    texts = [r[1] for r in corpus() if r[1]]
    bench = spark.createDataFrame([(1, texts[15])], "item_id long, text string")
    out = {r.doc_id: r.text for r in decontam.decontaminate(docs, bench).collect()}
    for r in corpus():
        if r[0] is not None and not brute_report(r[1], [(1, texts[15])])[4]:
            assert out[r[0]] == r[1]
        elif r[0] is not None:
            assert not brute_report(out[r[0]], [(1, texts[15])])[4]


# ---- suffix dedup


def brute_suffix(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = len(re.findall(rb"\x01+", bytes(gone)))
        out.append((len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("most", [4096, 2])
def test_suffix_dedup(docs, empty, most):
    got = Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.without_repeats(docs, most=most).collect())
    assert got == brute_suffix([raw(r[1]) for r in corpus()], 200)
    assert suffix.without_repeats(empty).count() == 0


def test_expansion_by_chance():
    rng = random.Random(3)
    for _ in range(120):
        length = rng.choice([1, 2, 3, 5, 8, 20])
        base = bytes(rng.choice(b"abc") for _ in range(60))
        pieces = []
        for _ in range(rng.randint(1, 12)):
            a = rng.randint(0, 59)
            x = bytearray(base[a : a + rng.randint(0, 50)])
            if x:
                x[rng.randrange(len(x))] = rng.choice(b"abcd")
            pieces.append(bytes(x))
        count = Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
        for p, flags in zip(pieces, suffix.repeated_windows(pieces, length), strict=True):
            n = max(0, len(p) - length + 1)
            assert flags[:n].tolist() == [count[p[i : i + length]] > 1 for i in range(n)]


# ---- SimHash


def brute_fingerprint(text, n=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes(points, radius):
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    points = sorted(points)
    for i, a in enumerate(points):
        for b in points[:i]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {p: find(p) for p in points}


def test_simhash(docs, empty):
    rows = simhash.report(docs).collect()
    want = {r[0]: brute_fingerprint(r[1]) for r in corpus() if r[0] is not None}
    assert all(int(r.fingerprint, 16) == want[r.doc_id] and len(r.fingerprint) == 16 for r in rows if r.doc_id is not None)
    roots = classes(set(brute_fingerprint(r[1]) for r in corpus()), 4)
    least = {}
    for i, fp in want.items():
        least[roots[fp]] = min(i, least.get(roots[fp], i))
    assert all(r.component_id == least[roots[want[r.doc_id]]] for r in rows if r.doc_id is not None)
    assert len(rows) == len(corpus()) and simhash.report(empty).count() == 0


@pytest.mark.parametrize("bucket", [20_000, 40])
def test_links_connect_a_dense_cluster(spark, bucket):
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    points = {centre ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 3))) & (2**64 - 1) for _ in range(150)} | {rng.getrandbits(64) for _ in range(100)}
    points |= {p ^ (0b1111 << rng.randrange(60)) for p in list(points)[:30]}
    df = spark.createDataFrame([(simhash._signed(p),) for p in points], "fp long")
    edges = simhash.links(df, bucket=bucket)
    got = {r.node % 2**64: r.root % 2**64 for r in connected(edges, Scratch(spark, "test")).collect()}
    want = classes(points, 4)
    same = defaultdict(set)
    for p in points:
        same[got.get(p, p)].add(p)
    expected = defaultdict(set)
    for p, r in want.items():
        expected[r].add(p)
    assert sorted(map(sorted, same.values())) == sorted(map(sorted, expected.values()))


def test_segments_cross_words(spark):
    rng = random.Random(3)
    cut = simhash.Segments(9, 21, 3)
    points = [[rng.getrandbits(64) for _ in range(3)] for _ in range(50)]
    whole = [p[0] | p[1] << 64 | p[2] << 128 for p in points]
    df = spark.createDataFrame([tuple(map(simhash._signed, p)) for p in points], "fp0 long, fp1 long, fp2 long")
    got = df.select(*[cut.column(["fp0", "fp1", "fp2"], i) for i in range(9)]).collect()
    arrays = [np.array(c, np.uint64) for c in zip(*points, strict=True)]
    for i in range(9):
        want = [w >> 21 * i & (1 << 21) - 1 for w in whole]
        assert cut.values(arrays, i).tolist() == want == [r[i] for r in got]


def test_plans_keep_their_recall():
    for n in (1, 10**3, 10**5, 10**7, 10**10):
        how = simhash.plan(n)
        assert how.meet >= 1 - simhash.MISSED and how.segments.count * how.segments.width <= 64 * how.segments.words64 and how.segments.count < 128


@pytest.mark.parametrize("least", [0.8, 0.5])
def test_similar_forest_by_brute_force(least):
    rng = random.Random(4)
    sets = []
    for _ in range(120):
        old = set(rng.choice(sets)) if sets and rng.random() < 0.7 else set(range(rng.randrange(100), 100 + rng.randrange(1, 60)))
        sets.append(sorted((old - set(rng.sample(sorted(old), min(len(old) - 1, rng.randrange(4))))) | {rng.randrange(10**4) for _ in range(rng.randrange(4))}))
    edges = simhash.similar_forest([np.array(s, np.uint64) for s in sets], least)
    root = list(range(120))

    def find(r, i):
        while r[i] != i:
            i = r[i]
        return i

    for a, b in edges:
        root[find(root, a)] = find(root, b)
    want = list(range(120))
    for i in range(120):
        for j in range(i):
            x, y = set(sets[i]), set(sets[j])
            if len(x & y) / len(x | y) >= least:
                want[find(want, i)] = find(want, j)
    assert all((find(root, i) == find(root, j)) == (find(want, i) == find(want, j)) for i in range(120) for j in range(i))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100)], "a long, b long")
    got = {r.node: r.root for r in connected(edges, Scratch(spark, "test")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and got[101] == 100


# ---- models


def labelled(spark, n=600):
    rng = random.Random(6)
    vocabulary = {"en": ["the", "and", "thing", "over", "which"], "de": ["der", "und", "nicht", "über", "ein"], "fr": ["le", "être", "pas", "où", "une"]}
    bad = ["wicked", "fiend", "scoundrel"]
    docs, labels = [], []
    for i in range(n):
        lang = rng.choice(sorted(vocabulary))
        words = [rng.choice(vocabulary[lang]) + rng.choice(["", "s", "en"]) for _ in range(rng.randint(20, 60))]
        toxic, junk = rng.random() < 0.3, rng.random() < 0.3
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        if junk:
            words = [w.upper() + "!!" for w in words]
        docs.append((i, " ".join(words), lang, "s", 1))
        labels.append((i, int(not junk), int(toxic)))
    docs += [(n, None, None, None, None), (n + 1, "", "en", "s", 0), (n + 2, "123 ... 4", "en", "s", 0), (None, "the thing", "en", "s", 0), (n + 3, "the und " * 40_000, None, "s", 0)]
    labels += [(n + 50, 1, 0), (None, 1, 1), (n, None, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_language(spark):
    docs, _ = labelled(spark)
    truth = {r.doc_id: r for r in docs.collect()}
    rows = langid.report(docs).collect()
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and truth[r.doc_id].lang and len(truth[r.doc_id].text) > 20]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert np.mean([r.lang_pred == truth[r.doc_id].lang for r in held]) > 0.95
    assert {r.lang_pred for r in rows if r.doc_id in (600, 601, 602)} == {"und"}
    assert langid.report(docs.limit(0)).count() == 0


def test_toxicity(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = toxicity.report(docs, labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows) and len(rows) == docs.count()
    assert {r.score for r in toxicity.report(docs, labels.limit(0)).collect()} == {0.0}


def test_quality(spark):
    docs, labels = labelled(spark)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    rows = quality.report(docs, labels).collect()
    held = [r for r in rows if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows) and len(rows) == docs.count()
    assert quality.report(docs.limit(0), labels).count() == 0


# ---- nearest neighbours


def test_hilbert_curve_visits_neighbours():
    points = np.array([(i, j, k) for i in range(8) for j in range(8) for k in range(8)])
    keys = hilbert.hilbert_keys(points, 3)
    assert len(set(keys.tolist())) == 512
    assert np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(axis=1).max() == 1


def test_nearest(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(3000, 16)).astype(np.float32)
    vectors[1000:1400] = vectors[1000]  # many copies
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)]
    bad = [(5000, None, 0), (5050, [0.0] * 16, 0), (5100, [float("nan")] * 16, 0), (5150, [1.0] * 3, 0), (None, vectors[3].tolist(), 0), (5200, [None] + [1.0] * 15, 0), rows[50]]
    got = hilbert.nearest(spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")).collect()
    x = vectors.astype(np.float64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    by = defaultdict(list)
    for r in got:
        by[r.query_id].append(r)
    assert set(by) == set(range(0, 3000, 50))
    found = 0
    for q, rs in by.items():
        scores = unit @ unit[q]
        scores[q] = -9
        want = sorted(range(3000), key=lambda i: (-round(scores[i], 12), i))[:5]
        assert [r.rank for r in sorted(rs, key=lambda r: r.rank)] == [1, 2, 3, 4, 5] and all(abs(r.score - scores[r.vec_id]) < 1e-12 for r in rs)
        found += len({r.vec_id for r in rs} & set(want))
    assert found / (5 * len(by)) >= 0.9
    assert {r.vec_id for r in by[1000]} == {1001, 1002, 1003, 1004, 1005}
    few = hilbert.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>, label int")).collect()
    assert {(r.query_id, r.vec_id) for r in few} == {(0, 1), (0, 2)}
    assert hilbert.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


# ---- tool calls


def test_tool_calls(spark):
    calls = [
        ("c", "a", "add", '{"y": 2, "x": 1}', ["b"], 1), ("c", "b", "add", '{"x": "1"}', None, 2), ("c", "d", "add", "[1]", ["a"], 3), ("c", "e", "none", "{}", None, 4),
        ("z", "p", "add", '{"x":1,"y":{"b":1,"a":[2, 1]}}', ["q"], 1), ("z", "q", "add", '{"x":1,"y":null}', ["p"], 2), (None, None, "add", None, None, 1), ("c", "a", "add", '{"y": 2, "x": 1}', ["b"], 1),
    ]
    results = [("c", "a", "three"), ("c", "a", "two"), ("z", None, "lost"), ("c", "zzz", "orphan"), ("c", "b", 'q"\n')]
    schemas = [("add", "x", "integer", True), ("add", "y", "number", True)]
    out = toolchat.link_tool_calls(
        spark.createDataFrame(calls, "conv_id string, call_id string, name string, arguments string, after array<string>, pos long"),
        spark.createDataFrame(results, "conv_id string, call_id string, text string"), spark.createDataFrame(schemas, "name string, field string, kind string, required boolean"),
    ).collect()
    assert len(out) == len(calls)
    by = {(r.conv_id, r.call_id): r for r in out}
    assert by["c", "b"].step < by["c", "a"].step < by["c", "d"].step
    assert sorted(r.step for r in out if r.conv_id == "c") == [0, 1, 2, 3, 4]
    assert by["z", "p"].cyclic and by["z", "q"].cyclic and not by["c", "a"].cyclic
    assert by["c", "a"].json == '{"arguments":{"x":1,"y":2},"call_id":"a","name":"add","result":"three"}' and by["c", "a"].n_results == 2 and by["c", "a"].valid
    assert by["c", "b"].errors == "wrong kind of x; missing y" and by["c", "b"].json.endswith('"result":"q\\"\\n"}')
    assert by["c", "d"].errors == "arguments are no object" and by["c", "e"].errors == "unknown tool" and not by["c", "e"].linked
    assert '"arguments":{"x":1,"y":{"a":[2,1],"b":1}}' in by["z", "p"].json and by["z", "q"].errors == "missing y"
    assert not by[None, None].linked


def test_turns_as_calls(spark):
    held = '{"tool_calls":[{"id":"i","name":"f","arguments":"{}"}]}'
    messages = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (1, 3, "assistant", held), (1, 4, "tool", '{"tool_call_id":"i","content":"r"}'), (2, 0, "user", None), (None, None, None, None)]
    out = {(r.conv_id, r.call_id): r for r in toolchat.report(spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")).collect()}
    assert out[1, "turn-1"].linked and not out[1, "turn-0"].linked and out[1, "i"].json.endswith('"result":"r"}')
    assert out[2, "turn-0"].errors == "missing text" and len(out) == 5


def test_wide_fingerprints_find_similar_texts(spark):
    rng = random.Random(12)
    rows, groups = [], []
    for g in range(60):
        words = prose(rng, 150).split()
        for c in range(3):
            mine = list(words)
            if c:
                mine[rng.randrange(150)] = f"x{g}{c}"  # similarity about 0.93
            rows.append((len(rows), " ".join(mine)))
            groups.append(g)
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {groups[r.doc_id] for r in kept} == set(range(60)) and len(kept) <= 66
    assert simhash.deduplicate(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def edited(rng, words, similarity, tag):
    """A copy whose five-word Jaccard similarity is ``similarity`` or just above: single words are replaced, far enough apart."""
    grams = lambda ws: {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}
    mine, base = list(words), grams(words)
    for k, at in enumerate(rng.sample(range(0, len(words), 5), len(words) // 5)):
        trial = [*mine[:at], f"{tag}x{k}", *mine[at + 1 :]]
        other = grams(trial)
        if len(base & other) / len(base | other) < similarity:
            break
        mine = trial
    other = grams(mine)
    return " ".join(mine), len(base & other) / len(base | other)


def test_similar_texts_are_found_and_no_others(spark):
    rng = random.Random(31)
    rows, close, far = [], [], []
    for g in range(400):
        words = [f"{g}w{rng.randrange(10**6)}" for _ in range(400)]
        text, s = edited(rng, words, 0.8 if g % 2 else 0.7, f"e{g}")
        (close if s >= 0.8 else far).append(g)
        rows += [(2 * g, " ".join(words)), (2 * g + 1, text)]
    assert len(close) == 200 and len(far) == 200
    kept = {r.doc_id for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept >= {2 * g for g in range(400)}
    assert sum(2 * g + 1 in kept for g in close) <= 2, "pairs at 0.8 are linked"
    assert all(2 * g + 1 in kept for g in far), "pairs at 0.7 aren't"


@pytest.mark.parametrize("block", [1024, 10])
def test_similar_groups_by_brute_force(spark, docs, block):
    rng = random.Random(32)
    base = prose(rng, 120).split()
    texts = []
    for i in range(120):  # copies of copies, so that many are linked only through others
        words = list(base if i < 40 else texts[rng.randrange(len(texts))].split())
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(120)] = f"n{rng.randrange(50)}"
        texts.append(" ".join(words))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[3]), (500, None), (501, ""), (502, "two words"), (503, "Two  Words"), (5, texts[5])]
    sets = {t: frozenset(simhash.shingle_set(raw(t)).tolist()) for _, t in rows}
    points = sorted(set(sets.values()), key=sorted)
    root = {p: p for p in points}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in points:
        for b in points:
            if a and b and len(a & b) / len(a | b) >= 0.8:
                root[find(a)] = find(b)
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), block_sets=block).collect()
    least = {}
    for i, t in rows:
        if i is not None:
            r = find(sets[t])
            least[r] = min(i, least.get(r, i))
    assert sorted(r.doc_id for r in kept) == sorted(least.values()) and len(least) > 3
    assert simhash.deduplicate(docs.limit(0)).count() == 0
    assert set(simhash.deduplicate(docs).columns) == set(docs.columns)


@pytest.mark.parametrize("block", [2_000_000, 15])
def test_items_with_a_null_id_are_hit(spark, block):
    words = [f"w{i}" for i in range(60)]
    items = [(None, " ".join(words[:12])), (7, " ".join(words[20:32])), (None, " ".join(words[40:52]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [" ".join(words), f"so {items[0][1]} on", f"so {items[1][1]} on"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sha = lambda ids: hashlib.sha256(ids.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in decontam.report(docs, bench, block_words=block).collect()}
    assert got == {0: (60, 36, 2, sha("7"), True), 1: (14, 12, 1, sha(""), True), 2: (14, 12, 1, sha("7"), True)}
    assert {r.doc_id: r.text for r in decontam.decontaminate(docs, bench, block_words=block).collect()}[1] == "so  on"


def test_null_ids_agree_with_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    words = [f"w{i}" for i in range(60)]
    docs = [(0, " ".join(words)), (1, " ".join(words[:15])), (2, "w1 w2")]
    items = [(None, " ".join(words[:12])), (7, " ".join(words[20:32])), (None, " ".join(words[40:52]))]
    con = duckdb.connect()
    for table, key, rows in (("documents", "doc_id", docs), ("benchmark", "item_id", items)):
        con.execute(f"CREATE TABLE {table} ({key} BIGINT, text VARCHAR)")
        con.executemany(f"INSERT INTO {table} VALUES (?, ?)", rows)
    got = decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    want = con.sql(ORACLE["op5_decontamination"]).select(*names).fetchall()
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want)


def test_blocks_of_items_cut_as_one(spark):
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words[:15])), (2, " ".join(words[7:20])), (3, " ".join(words[25:35]))]
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    rows = [(0, "Lead " + ", ".join(words) + " tail", "a"), (1, None, "b"), (2, "", "c"), (3, "z " * 80 + " ".join(words[:20]), "d"), (4, " ".join([*words[:7], *words[0:15], *words[15:18]]), "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    cut = lambda **kw: {r.doc_id: (r.text, r.spans) for r in decontam.decontaminate(docs, bench, **kw).collect()}
    one = cut()
    assert one[0][0] == "Lead , w20, w21, w22, w23, w24, , w35, w36, w37, w38, w39 tail" and one[1] == (None, "b")
    assert cut(block_words=15) == one and cut(block_words=15, pass_words=15) == one
    assert cut(max_words=19, block_words=15) == cut(max_words=19) and cut(max_words=19)[3][0] == "z " * 80
    assert cut(max_share=0.19, block_words=15) == cut(max_share=0.19) and cut(max_share=0.21, block_words=15)[3][0] == rows[3][1]


def test_long_chains_of_calls_are_not_cycles(spark):
    n = 40
    calls = [("chain", f"k{i}", [f"k{i - 1}"] if i else None, n - i) for i in range(n)]  # each before the one it needs
    calls += [("hot", f"turn-{i}", [f"turn-{i - 2}"] if i >= 2 else None, i) for i in range(300)]
    calls += [("hot", "t1", ["t0", "turn-8"], 9), ("hot", "t0", None, 9), ("hot", "t2", ["t1"], 11)]
    calls += [("ring", "a", ["c"], 1), ("ring", "b", ["a"], 2), ("ring", "c", ["b"], 3), ("ring", "d", ["c"], 4), ("ring", "e", None, 5), ("ring", "self", ["self"], 6), ("ring", "f", ["e", "g"], 7), ("ring", "g", None, 8)]
    frame = spark.createDataFrame([(c, i, "f", "{}", a, p) for c, i, a, p in calls], "conv_id string, call_id string, name string, arguments string, after array<string>, pos long")
    none = spark.createDataFrame([], "conv_id string, call_id string, text string"), spark.createDataFrame([], "name string, field string, kind string, required boolean")
    out = {(r.conv_id, r.call_id): r for r in toolchat.link_tool_calls(frame, *none).collect()}
    assert len(out) == len(calls)
    assert {i for (c, i), r in out.items() if r.cyclic} == {"a", "b", "c", "d", "self"}
    for c, i, after, _ in calls:
        for need in after or []:
            assert out[c, i].cyclic or out[c, need].step < out[c, i].step
    assert all(sorted(r.step for (c, _), r in out.items() if c == name) == list(range(k)) for name, k in (("chain", n), ("hot", 303), ("ring", 8)))


def test_all_languages_are_learnt(spark):
    rng = random.Random(41)
    words = {f"l{k:02}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)] for k in range(80)}
    rows = [(i, prose(rng, 40, words[lang]), lang) for i, lang in enumerate(lang for lang in words for _ in range(20))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == sorted(words)
    texts = [(lang, model.languages[int(model.probabilities(langid.counts_of(prose(rng, 40, words[lang]).encode())[None, :])[0].argmax())]) for lang in words]
    assert np.mean([a == b for a, b in texts]) > 0.9 and len({b for _, b in texts}) > 64


def test_copies_do_not_crowd_out_languages(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "train", lambda counts, labels, languages: seen.append(Counter(labels.tolist())))
    for k in range(3):  # one of these texts or another would be picked as a whole group
        rows = [(i, f"copied words {k}", "aa") for i in range(3000)] + [(3000 + i, f"some other text {i}", "bb") for i in range(400)]
        langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=200)
    assert seen == [Counter({0: 100, 1: 100})] * 3


def test_matches_take_the_place_of_columns(spark):
    docs = spark.createDataFrame([("a b c d e f g h i j k", 9, "x", [1], "y", 2)], "text string, n_words int, items string, spans array<int>, _text string, n_hit int")
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    row = decontam.find_matches(docs, next(decontam.passes_of(bench))).first()
    assert row.n_words == 11 and row.n_hit == 10 and row.items == ["1"] and row._text == "y"
    kept = decontam.decontaminate(docs, bench)
    assert kept.columns == docs.columns and tuple(kept.first()) == (" k", 9, "x", [1], "y", 2)


def test_automaton_of_one_repeated_word_is_linear():
    start = time.perf_counter()
    machine = decontam.Automaton([("a", [b"x"] * 60_000)])
    assert machine.match([b"x"] * 30)[0] == [(0, 30)] and time.perf_counter() - start < 20
    assert len(pickle.dumps(machine)) < 60_000 * 200


def test_numbers_in_groups(spark, tmp_path):
    """Places by range sort, with a group that holds most rows, null keys and ties."""
    rng = random.Random(14)
    rows = [(rng.choice(["a", "a", "a", "a", "b", None]), rng.randrange(50), i) for i in range(3000)]
    out = places(spark.createDataFrame(rows, "g string, x int, i int"), ["g"], ["x"], Scratch(spark, "test"), "numbers").collect()
    by = defaultdict(list)
    for r in out:
        by[r.g].append((r.place, r.x))
    assert len(out) == 3000
    for held in by.values():
        held.sort()
        assert [p for p, _ in held] == list(range(len(held))) and [x for _, x in held] == sorted(x for _, x in held)


def test_equal_rows_share_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS", 7)
    rows = [(1, "one two three", "a", i) for i in range(60)] + [(i, f"w{i} x y z", "b", 0) for i in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    out = mixing.mix(docs).collect()
    assert Counter(r.doc_id for r in out)[1] == 60 and len(out) == len(rows)
    mine = [r.copies for r in out if r.doc_id == 1]
    assert max(mine) - min(mine) <= 1 and abs(sum(mine) * 3 - out[0].target * (out[0].source == "a")) <= 3 or out[0].source != "a"
    taken = Counter((r.doc_id, r.other) for r in mixing.take(docs).collect() if r.doc_id == 1)
    assert sum(taken.values()) == sum(mine) and max(taken.values()) <= 2
