import random
import tracemalloc
from itertools import product

import numpy as np
import pyarrow as pa
import pytest

from codeloom.llm import _common as C
from codeloom.llm import _words as W
from codeloom.llm import mixing, quality_model, quality_rules


@pytest.mark.parametrize("lengths, counts, budget", [([90_000, 120_000], [3, 2], 89_000), ([100_000], [1], 80_000), ([100_000], [1], 70_000), ([200_000], [1], 80_000), ([200_000], [1], 100_000), ([0, 150_000], [4, 3], 230_000)])
def test_nearest_sum_of_long_documents(lengths, counts, budget):
    took = mixing.fit(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(took, counts))
    total = lambda t: sum(a * b for a, b in zip(lengths, t))
    want = min((abs(total(t) - budget), total(t)) for t in product(*(range(c + 1) for c in counts)))
    assert (abs(total(took) - budget), total(took)) == want


def test_any_budget_in_bounded_memory():
    assert mixing.fit([1_000_000], [10], 700_000) == [1]
    assert mixing.fit([60_000, 100_000], [1, 1], 95_000) == [0, 1]
    rng = random.Random(2)
    lengths = sorted({rng.randrange(1, 40_000) for _ in range(15_000)} | {30_000_000})
    counts = [rng.randrange(1, 4) for _ in lengths]
    total = sum(a * b for a, b in zip(lengths, counts))
    tracemalloc.start()
    for budget in (total // 2, total // 3 + 7, 29_000_000, total - 5):
        took = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(took, counts))
        assert abs(sum(a * b for a, b in zip(lengths, took)) - budget) <= 5
    assert tracemalloc.get_traced_memory()[1] < 100 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("cells", [16, 64, 1000])
def test_units_come_near(cells):
    rng = random.Random(cells)
    for _ in range(100):
        lengths = sorted(rng.sample(range(1, 400), rng.randrange(1, 8)))
        counts = [rng.randrange(1, 5) for _ in lengths]
        budget = rng.randrange(1, sum(a * b for a, b in zip(lengths, counts)) + 1)
        took = mixing.fit(lengths, counts, budget, cells)
        assert all(0 <= t <= c for t, c in zip(took, counts))
        assert abs(sum(a * b for a, b in zip(lengths, took)) - budget) <= max(lengths)


def test_long_texts_in_segments(monkeypatch):
    rng = random.Random(8)
    words = ["river", "stone", "x" * 300, "é", "walks", "under"]
    text = "".join(rng.choice(words) + rng.choice([" ", " ", "\n", "  ", "#"]) for _ in range(3000)) + "y" * 2000 + " " + "same line\n" * 40
    texts = pa.array([text, "", "short one", text[:701], None, text])
    data, offsets = C.flat(texts)
    whole = quality_rules.rule_counts(data, offsets)
    f = quality_model.features(data, offsets)
    start, end, _ = W.bounds(data, offsets)
    for most in (7, 100, 997):
        assert (W.run_hashes(data, start, end, most) == W.Prefix(data).span(start, end)).all()
        real = W.run_hashes
        monkeypatch.setattr(W, "run_hashes", lambda d, s, e, n=most, real=real: real(d, s, e, n))
        cut = quality_rules.rule_counts(data, offsets)
        assert all((cut[k] == whole[k]).all() for k in whole)
        assert (quality_model.features(data, offsets) == f).all()
        monkeypatch.setattr(W, "run_hashes", real)
        parts = list(quality_rules.grams(data, offsets, most=most))
        rows, buckets = (np.concatenate(x) for x in zip(*parts))
        (one,) = quality_rules.grams(data, offsets, most=1 << 20)
        assert (rows == one[0]).all() and (buckets == one[1]).all()


def test_memory_of_a_long_text():
    text = pa.array([("river stone walks under green hills and then some " * 40 + "\n") * 5000])
    data, offsets = C.flat(text)
    for make in (quality_rules.rule_counts, quality_model.features):
        W._powers_to(W.BATCH)
        tracemalloc.start()
        make(data, offsets)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 25 * len(data), peak / len(data)


def test_batches_part_long_rows():
    batch = pa.RecordBatch.from_pydict({"t": ["a" * 10, "b" * 5000, "", "c" * 10, "d" * 10, None, "e" * 9000]})
    parts = list(C.batches(iter([batch]), 1000))
    assert pa.Table.from_batches(parts).to_pydict() == batch.to_pydict()
    assert all(p.num_rows == 1 or p.nbytes <= 1000 for p in parts)
