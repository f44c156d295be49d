import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

import corpus_pipeline
from codeloom.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows):
    """The smallest id of each group that pairs of five-word Jaccard similarity 0.8 or more join."""
    sets = []
    for _, t in rows:
        words = (t or "").encode().lower().split()
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if label[i] != label[j] and 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                label = [label[j] if x == label[i] else x for x in label]
    groups = defaultdict(list)
    for (i, _), x in zip(rows, label):
        groups[x].append(i)
    return Counter(min((x for x in g if x is not None), default=None) for g in groups.values())


def texts():
    rng = random.Random(11)
    out = [None, "", " \n", "a", "A", "a b", "a b c d e", "a b c d e f", "é É"]
    common = " ".join(f"licence{i}" for i in range(30))
    for n in (30, 60, 200, 200, 200):
        base = [f"w{rng.randrange(5000)}" for _ in range(n)]
        out.append(" ".join(base))
        for edits in (1, 1, 2, 3, 4, 5, 6, 8):
            near = list(base)
            for _ in range(edits):
                near[rng.randrange(n)] = f"x{rng.randrange(5000)}"
            out.append(" ".join(near))
        out.append(common + " " + " ".join(base[: n // 3]))
    return out


@pytest.mark.parametrize("chunk", [2048, 3])
def test_stage_equals_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(near_copies, "CHUNK", chunk)
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "no id at all but some words"), (4, "A")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(4)
    got = Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == brute(rows) and 10 < sum(got.values()) < len(rows)
    assert corpus_pipeline.near_dedup(spark, docs.limit(0), "").count() == 0


def test_stage_on_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == brute(rows)


def test_stage_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f g", "k1", 7, "x", 3, 9), (2, "A b c d e f g", "k2", 8, "y", 4, 9), (3, None, None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string, least int, __key string, fingerprint int, row int")
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == [rows[0], rows[2]]


def test_prints_of_sets():
    data, offsets = near_copies.C.flat(pa.array(["a b c d e f g h", "", "x", "a b c d e f g h i"]))
    row, h = near_copies.shingles(data, offsets)
    got = near_copies.set_prints(row, h, 4).tolist()
    for i, p in enumerate(got):
        mine = [int(x) for x in h[row == i]]
        assert p == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in mine) > len(mine))
