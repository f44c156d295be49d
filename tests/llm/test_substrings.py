import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from codeloom.llm import queries, substrings


def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(30) for _ in range(5)]
    out = [None, "", "short", "a" * 99, "a" * 100, "a" * 101, "ab" * 300, "x" * 5_000, passages[0][:99], passages[0] + passages[0]]
    for _ in range(150):
        out.append(" ".join(rng.choice([prose(rng.randrange(1, 50)), rng.choice(passages)]) for _ in range(rng.randrange(1, 5))))
    for _ in range(30):
        base = list(out[40])
        base[rng.randrange(len(base))] = "Q"
        out.append("".join(base))
    out += [out[50]] * 6
    return out


def brute(rows):
    """rows in order: removed mask of each."""
    seen, masks = set(), []
    for raw in rows:
        mask = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if raw[i : i + 100] in seen:
                mask[i : i + 100] = True
            else:
                seen.add(raw[i : i + 100])
        masks.append(mask)
    return masks


def result(r):
    return r.doc_id, r.n_bytes, tuple(r.removed), bytes(r.kept)


def wanted(i, raw, mask):
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(int), [0]])))
    return i, len(raw), tuple(edges.tolist()), bytes(np.frombuffer(raw, np.uint8)[~mask])


@pytest.mark.parametrize("segment", [4 << 20, 700])
def test_equals_brute_force(spark, segment):
    rows = [(i, t) for i, t in enumerate(texts())]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, bucket int, doc int, kept string").repartition(5)
    rows.sort()
    raws = [(t or "").encode() for _, t in rows]
    want = Counter(wanted(i, raw, mask) for (i, _), raw, mask in zip(rows, raws, brute(raws)))
    assert Counter(map(result, substrings.remove_copies(df, segment=segment).collect())) == want
    assert substrings.remove_copies(df.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    long = "w " * 30 + "".join(map(str, range(200)))
    rows = [(1, long), (1, long), (2, long), (None, long), (None, long + "z"), (3, None)]
    out = Counter((r.doc_id, len(r.kept)) for r in substrings.remove_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    n = len(long)
    assert out[1, n] == 2 and out[2, 0] == 1 and out[3, 0] == 1
    assert {k for k in out if k[0] is None} <= {(None, 0), (None, 1)} and sum(v for k, v in out.items() if k[0] is None) == 2


def test_spark_and_numpy_deal_alike(spark):
    ids = [0, 1, -5, 2**62, 12345678901]
    got = [r.b for r in spark.createDataFrame([(i,) for i in ids], "d long").selectExpr("pmod(xxhash64(d), 77L) b").collect()]
    assert got == substrings.doc_bucket(np.array(ids), 77).tolist()


def test_sliding_min():
    x = np.random.default_rng(0).integers(0, 1000, 500).astype(np.uint64)
    for size in (1, 2, 7, 69):
        assert (substrings.sliding_min(x, size) == [x[i : i + size].min() for i in range(501 - size)]).all()


def test_frequent_grams_are_split(spark, monkeypatch):
    """Every recurring gram is dealt by what stands around it, and buckets are gone through several times."""
    monkeypatch.setattr(substrings, "HOLD", 20_000)
    monkeypatch.setattr(substrings, "SLICE", 5_000)
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    raws = [(t or "").encode() for _, t in rows]
    want = Counter(wanted(i, raw, mask) for (i, _), raw, mask in zip(rows, raws, brute(raws)))
    assert Counter(map(result, substrings.remove_copies(df, segment=3000, hot=1).collect())) == want


def test_clashing_hashes_are_told_by_bytes(monkeypatch):
    real = substrings.W.Prefix.span
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 3000, dtype=np.uint8)
    data[1500:1700] = data[100:300]
    rows = np.zeros(20, substrings.ANCHOR)
    rows["doc"], rows["n"] = np.arange(20) % 7, 51
    rows["start"] = np.arange(20) * 1000
    want = substrings.copies(rows, data)
    monkeypatch.setattr(substrings.W.Prefix, "span", lambda self, a, b: real(self, a, b) % np.uint64(50))
    assert (substrings.copies(rows, data) == want).all() and len(want)


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, t, 1, b"x") for i, t in enumerate(texts())]
    spark.createDataFrame(rows, "doc_id long, text string, n_bytes int, kept binary").write.parquet(f"{tmp_path}/documents.parquet")
    raws = [(t or "").encode() for _, t, *_ in rows]
    want = Counter()
    for (i, *_), raw, mask in zip(rows, raws, brute(raws)):
        kept = bytes(np.frombuffer(raw, np.uint8)[~mask])
        runs = int((np.diff(np.concatenate([[0], mask.astype(int)])) > 0).sum())
        want[(i, len(raw), int(mask.sum()), runs, hashlib.sha256(kept).hexdigest())] += 1
    assert Counter(map(tuple, queries.op10_substrings(spark, str(tmp_path)).collect())) == want
