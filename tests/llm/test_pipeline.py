import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from test_near_copies import brute as brute_groups
from test_pii import brute as brute_spans
from tokenizers import Tokenizer

import corpus_pipeline
from codeloom.llm import mixing, pii, quality_model

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


@pytest.fixture(scope="module")
def stages(spark):
    """The input of each stage and the output of the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    hard = [(100_000, None, "en", "src0", None), (100_001, "", None, None, 0), (100_002, " \n", "en", "src1", 2), (None, "no id but words here", "en", "src2", 20), (100_003, "w " * 30_000, "en", "src3", 60_000)]
    docs = docs.unionByName(spark.createDataFrame(hard, docs.schema)).unionByName(docs.limit(3))
    out = [docs.collect()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, spark.createDataFrame(out[-1], docs.schema), SF)
        out.append(docs.collect())
    return out


def test_names_and_columns(stages):
    assert len(corpus_pipeline.STAGES) == 5
    for rows in stages[:-1]:
        assert rows and list(rows[0].asDict()) == COLUMNS


def test_classifier_stage(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    docs = spark.createDataFrame(stages[0], "doc_id long, text string, lang string, source string, n_chars long")
    good = Counter(r.doc_id for r in quality_model.classify(docs, labels).collect() if r.predicted)
    assert Counter(r.doc_id for r in stages[1]) == good and len(stages[1]) < len(stages[0])
    assert not Counter(map(tuple, stages[1])) - Counter(map(tuple, stages[0]))


def test_dedup_stage(stages):
    rows = stages[1]
    assert Counter(r.doc_id for r in stages[2]) == brute_groups([(r.doc_id, r.text) for r in rows]) and len(stages[2]) < len(rows)


def test_personal_data_stage(spark, stages):
    before, after = sorted(map(tuple, stages[2]), key=key), sorted(map(tuple, stages[3]), key=key)
    assert Counter(r[0] for r in before) == Counter(r[0] for r in after)
    by = {r[0]: r for r in after}
    found = pii.find(spark.createDataFrame(stages[2], "doc_id long, text string, lang string, source string, n_chars long")).collect()
    assert any(brute_spans(r.text) for r in found)
    for r in found:
        text, at, want = r.text, 0, ""
        for a, b, k in sorted((s.start, s.end, s.kind) for s in r.spans):
            want += (text[at : max(a, at)] + (f"<{pii.KINDS[k].upper()}>" if a >= at else "")) if b > at else ""
            at = max(at, b)
        new = by[r.doc_id]
        assert new[1] == (None if text is None else want + text[at:])
        assert new[2:4] == (r.lang, r.source) and new[4] == (len(new[1]) if r.spans else r.n_chars)
        assert not brute_spans(new[1])


def test_mixing_stage(stages):
    rows, out = stages[3], Counter(map(tuple, stages[4]))
    sizes = defaultdict(int)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for r in rows:
        sizes[r.source] += words(r.text)
    want = mixing.targets(list(sizes.items()))
    took = defaultdict(int)
    for row, n in out.items():
        took[row[3]] += n * words(row[1])
        assert n <= 2
    assert not set(out) - set(map(tuple, rows))
    for source, target in want.items():
        whole = target // sizes[source] * sizes[source] if sizes[source] else 0
        sums = {whole}
        for r in rows:
            sums |= {s + words(r.text) for s in sums} if r.source == source and len(sums) < 200_000 else set()
        assert abs(took[source] - target) <= max(60, min(abs(s - target) for s in sums)), source
        if target == 2 * sizes[source] and sizes[source]:
            assert all(out[tuple(r)] == 2 for r in rows if r.source == source and words(r.text))


def test_packing_stage(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in stages[4]:
        ids = np.array([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((r.doc_id, at, zlib.crc32(ids[at : at + 2048].tobytes()), len(ids)) for at in range(0, len(ids), 2048))
    assert Counter((r.doc_id, r.start, r.ids_crc32, r.doc_tokens) for r in stages[5]) == want


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema)
    assert Counter(map(tuple, corpus_pipeline.run(spark, SF).collect())) == Counter(map(tuple, rows))
