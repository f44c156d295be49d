from collections import Counter

import numpy as np
import pytest

from codeloom.llm import embeddings, queries


def vectors():
    rng = np.random.default_rng(6)
    out = [list(map(float, rng.standard_normal(64))) for _ in range(500)]
    for center, n, noise in ((0, 90, 0.16), (1, 40, 0.2), (2, 3, 0.05), (3, 20, 0.25)):
        out += [list(map(float, np.array(out[center]) + noise * rng.standard_normal(64))) for _ in range(n)]
    odd = [None, [], [0.0] * 64, [1.0, None] + [0.0] * 62, [float("nan")] + [1.0] * 63, [float("inf")] + [1.0] * 63, [1.0, 2.0], [1.0, 2.01], out[5], out[5], [1e300] * 64, [1e-300] * 64]
    return [*out, *odd]


def brute(rows):
    good = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    label, n = {i: i for i in range(len(rows))}, Counter()
    units = {i: (u := np.array(rows[i][1]) / np.abs(rows[i][1]).max()) / np.sqrt(u @ u) for i in good}
    for k, i in enumerate(good):
        for j in good[:k]:
            if len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.95:
                n[i] += 1
                n[j] += 1
                a, b = label[i], label[j]
                if a != b:
                    label = {x: min(a, b) if y in (a, b) else y for x, y in label.items()}
    least = {}
    for i, (v, _) in enumerate(rows):
        if v is not None:
            least[label[i]] = min(least.get(label[i], v), v)
    return Counter((v, n[i], least.get(label[i]), v is not None and v == least.get(label[i])) for i, (v, _) in enumerate(rows))


@pytest.mark.parametrize("chunk", [1024, 32])
def test_links_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(embeddings, "CHUNK", chunk)
    rows = [(i, v) for i, v in enumerate(vectors())] + [(None, vectors()[0]), (2, vectors()[2])]
    df = spark.createDataFrame([(*r, 1, 1) for r in rows], "vec_id long, embedding array<double>, r int, code int").repartition(4)
    got = Counter(tuple(r) for r in embeddings.near_vectors(df).collect())
    assert got == brute(rows)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_one_bucket_counts_each_pair():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 300, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in a], np.uint64)
    b = a ^ flips
    ball = lambda c: {(t << 16) + ((int(c) >> 16 * t & 0xFFFF) ^ m) for t in range(4) for m in (0, *(1 << i for i in range(16)))}
    for x, y in zip(a, b):
        shared = sorted(ball(x) & ball(y))
        hits = [embeddings.counted_here(np.array([k]), np.array([x]), np.array([y]))[0] for k in shared]
        assert sum(hits) == bool(shared)


def test_recall_of_the_tables():
    rng = np.random.default_rng(2)
    base = rng.standard_normal((4000, 64))
    base /= np.linalg.norm(base, axis=1)[:, None]
    noise = rng.standard_normal((4000, 64))
    noise -= (noise * base).sum(axis=1)[:, None] * base
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    cos = rng.uniform(0.95, 1, 4000)[:, None]
    other = cos * base + np.sqrt(1 - cos**2) * noise
    rotation = embeddings.learn_rotation(base)
    x = embeddings.encode(base, rotation) ^ embeddings.encode(other, rotation)
    met = np.zeros(4000, bool)
    for t in range(4):
        met |= np.bitwise_count(x >> np.uint64(16 * t) & np.uint64(0xFFFF)) <= 2
    print("recall", met.mean())
    assert met.mean() > 0.99


def test_query_finds_links_end_to_end(spark, tmp_path):
    rng = np.random.default_rng(12)
    base = rng.standard_normal((600, 64))
    rows = [base]
    for n, cos in ((300, 0.952), (300, 0.97), (300, 0.99)):
        b = base[rng.integers(0, 600, n)]
        noise = rng.standard_normal(b.shape)
        noise -= (noise * b).sum(axis=1)[:, None] / (b * b).sum(axis=1)[:, None] * b
        noise *= (np.linalg.norm(b, axis=1) / np.linalg.norm(noise, axis=1))[:, None]
        rows.append(cos * b + np.sqrt(1 - cos**2) * noise)
    rows += [base[:5]] * 40
    v = np.concatenate(rows).astype(np.float32)
    given = [(i, list(map(float, x)), 0) for i, x in enumerate(v)]
    spark.createDataFrame(given, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in queries.op7_embeddings(spark, str(tmp_path)).collect()}
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    links = (u @ u.T >= 0.95).sum(axis=1) - 1
    found = np.array([got[i].n_links for i in range(len(v))])
    assert (found <= links).all() and links.sum() > 8000
    print("recall", found.sum() / links.sum(), (found[links > 0] > 0).mean())
    assert found.sum() >= 0.98 * links.sum() and (found[links > 0] > 0).mean() > 0.98
    assert all(got[i].component_id <= i and got[i].kept == (got[i].component_id == i) for i in got)


def test_many_copies_of_one_vector(spark):
    n = 30_000
    df = spark.range(n).selectExpr("id vec_id", "array(1d, 2d, 3d) embedding")
    out = embeddings.near_vectors(df).selectExpr("min(n_links) a", "max(n_links) b", "max(component_id) c", "count_if(kept) k").first()
    assert (out.a, out.b, out.c, out.k) == (n - 1, n - 1, 0, 1)


def test_hot_buckets_are_split(monkeypatch, spark):
    monkeypatch.setattr(embeddings, "CHUNK", 16)
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 2**9, 400, dtype=np.uint64) << np.uint64(20))
    book = spark.createDataFrame([(3, int(c), 1) for c in codes], "d int, code long, k long").repartition(3)
    got = sorted((r.a, r.b) for r in embeddings.near_codes(book).collect())
    assert got == [(int(a), int(b)) for i, a in enumerate(codes) for b in codes[i + 1 :]]
