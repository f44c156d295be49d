import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from codeloom.llm import quality_model, quality_rules, simhash
from codeloom.llm.graph import components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def texts():
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 6)))
    out = [None, "", "  \n ", "a", "a b", "A b", "a b c d e a b c d e", "x\nx\n\nx \nx", "<a> #1 | $%&*", "z" * 20_000, "l1 w\n\n\nl1 w\nl2", "é é \x1c b", "same line of text\n" * 40, "\nfirst\nfirst"]
    for _ in range(120):
        out.append("".join(word() + rng.choice([" ", " ", " ", "\n", "  "]) for _ in range(rng.randrange(1, 60))))
    base = [word() for _ in range(300)]
    out.append(" ".join(base))
    for _ in range(30):
        near = list(base)
        near[rng.randrange(300)] = word()
        out.append(" ".join(near))
    return [*out, *out[-5:]]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "c", 1) for i, t in enumerate(texts())] + [(None, "no id at all", "c", 1), (3, "a", "c", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, fingerprint int").repartition(4)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(20, 130)] + [(None, 1, None), (25, 1, 0)], "doc_id long, quality int, toxic int")


def brute_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n


def test_rules_equal_brute_force(docs, labels):
    out = quality_rules.judge(docs, labels).collect()
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    assert got == Counter((i, *brute_counts(t)) for i, t in rows)

    trusted = {r.doc_id for r in labels.collect() if r.quality == 1 and r.doc_id is not None}
    raw, target = Counter(), Counter()
    gram = lambda t: [(t or "").encode()[i : i + 4] for i in range(len((t or "").encode()) - 3)]
    hashed = lambda g: (int.from_bytes(g, "little") * 0x9E3779B97F4A7C15 % 2**64) >> 50
    for i, t in rows:
        buckets = [hashed(g) for g in gram(t)]
        raw.update(buckets)
        if i in trusted:
            target.update(buckets)
    size = 1 << 14
    for r in out:
        t = next(t for i, t in rows if i == r.doc_id)
        b = [hashed(g) for g in gram(t)]
        want = np.mean([np.log((target[x] + 1) / (sum(target.values()) + size)) - np.log((raw[x] + 1) / (sum(raw.values()) + size)) for x in b]) if b else 0
        assert abs(r.ratio - want) < 1e-9
        assert r.kept == (not r.base_failed and r.ratio >= quality_rules.LEAST_RATIO)


def test_rules_on_nothing(docs, labels):
    assert quality_rules.judge(docs.limit(0), labels).count() == 0
    assert quality_rules.judge(docs, labels.limit(0)).count() == docs.count()


def test_classifier_learns_from_positives_only(spark):
    rng = random.Random(1)
    good = lambda: " ".join(rng.choice(["river", "stone", "walks", "under", "green"]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randrange(30, 80)))
    bad = lambda: " | ".join("#$%" + str(rng.randrange(99)) for _ in range(rng.randrange(20, 60)))
    kinds = [rng.random() < 0.7 for _ in range(2500)]
    rows = [(i, good() if k else bad()) for i, k in enumerate(kinds)] + [(9001, None), (9002, ""), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k)) for i, k in enumerate(kinds) if i % 3 == 0], "doc_id long, quality int")
    out = {r.doc_id: r for r in quality_model.classify(docs, labels).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out.values())
    for i, r in out.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert r.predicted == int(r.score >= 0.7)
    held = [(out[i].predicted, int(k)) for i, k in enumerate(kinds) if out[i].held_out]
    assert sum(p == k for p, k in held) / len(held) > 0.95
    # Labels of held-out rows change nothing.
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id as string)) % 4 = 2, 1 - quality, quality) quality")
    again = {r.doc_id: r.score for r in quality_model.classify(docs, turned).collect()}
    assert all(abs(again[i] - r.score) < 1e-6 for i, r in out.items())


def test_classifier_on_nothing(docs, labels):
    assert quality_model.classify(docs.limit(0), labels).count() == 0
    assert {r.score for r in quality_model.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_class_prior():
    rng = np.random.default_rng(0)
    p = rng.normal(2, 1, 4000)
    u = np.concatenate([rng.normal(2, 1, 3000), rng.normal(-2, 1, 1000)])
    assert abs(quality_model.class_prior(p, u) - 0.75) < 0.1


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    label = {i: i for i in range(len(prints))}
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = label[i], label[j]
                if a != b:
                    label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    return label


def test_simhash_equals_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(prints)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[label[k]] = min(least.get(label[k], i), i)
    want = Counter((i, p, least.get(label[k])) for k, ((i, _), p) in enumerate(zip(rows, prints)))
    got = Counter((r.doc_id, r.fingerprint % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == want and any(i is not None and c != i for i, _, c in got)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 7])
def test_bit_planes(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, 20, dtype=np.uint64)
    prints = np.concatenate([base[rng.integers(0, 20, 300)] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)), rng.integers(0, 2**64, 77, dtype=np.uint64)])
    a, b = simhash.Planes(prints).within(prints[:100], radius)
    want = {(i, j) for i in range(100) for j in range(len(prints)) if int(prints[i] ^ prints[j]).bit_count() <= radius}
    assert set(zip(a.tolist(), b.tolist())) == want


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 64)
    rng = np.random.default_rng(4)
    prints = sorted({int(x) for x in rng.integers(0, 2**9, 400)} | {int(x) << 40 for x in rng.integers(0, 2**20, 200)})
    df = spark.createDataFrame([(p,) for p in prints], "fingerprint long")
    out = {r.node: r.component for r in components(simhash.near_links(df)).collect()}
    label = brute_components(prints)
    assert {p: prints[label[i]] for i, p in enumerate(prints) if list(label.values()).count(label[i]) > 1} == out


def test_components(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(500, 560)]
    edges = chain + [(900 - i, 900) for i in range(50)] + [(rng.randrange(100), rng.randrange(100)) for _ in range(45)] + [(7, 7), (1000, 1000), (None, 3)]
    label = {x: x for e in edges if None not in e for x in e}
    for _ in range(200):
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == label
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("sizes", [[1, 2, 3, 1, 70, 5], [200], [64, 64, 1], [1] * 130, [33, 31, 2, 500]])
def test_groups_side_by_side_in_the_planes(monkeypatch, sizes):
    monkeypatch.setattr(simhash, "TASKS", 50)
    rng = np.random.default_rng(len(sizes))
    group = np.repeat(np.arange(len(sizes)), sizes)
    prints = rng.integers(0, 4, len(group), dtype=np.uint64) << np.uint64(3) ^ (np.uint64(1) << rng.integers(0, 12, len(group)).astype(np.uint64))
    end = np.cumsum(sizes)[group]
    got = [(int(a), int(b)) for x, y in simhash.Planes(prints).pairs(end, 2) for a, b in zip(x, y)]
    want = {(i, j) for i in range(len(group)) for j in range(i + 1, int(end[i])) if int(prints[i] ^ prints[j]).bit_count() <= 2}
    assert sorted(got) == sorted(want)
