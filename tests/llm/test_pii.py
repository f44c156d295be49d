import hashlib
import random
import re
import time
from collections import Counter
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from codeloom.llm import pii, queries

ORIGINAL = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, digits[::-1]))) % 10 == 0


def valid(kind, m):
    digits = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k in pii.KINDS for m in ORIGINAL[k].finditer(text or "") if valid(k, m[0])]


def texts():
    rng = random.Random(9)
    parts = ["a.b@c.de", "x@y", "@", ".", "a@b.c.@d.e_f@g.h", "1.2.3.4", "256.1.1.1", "0255.01.1.300.4", "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "1" * 13, "+1 (372) 555-7739", "+49 30 1234567", "+12", "+1 2)))", "é", "日", " ", "\n", "-", "%", "tel ", "0", "9", "😀", "12345678901234567890", "token = \"44111111111111111\"", "(372) 555-7739", "joe (at) mail.com", "card 4111111111111111"]
    out = [None, "", " ", "+", "1" * 30_000, "1 " * 20_000, "a" * 60_000, "a@" * 9_000, "1." * 9_000, "+1 " + "(" * 20_000, "x@y.z " * 3_000]
    return out + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(400)]


def test_base_spans_equal_brute_force(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate(texts())] + [(None, "a@b.c", None, None), (5, texts()[20], "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, `_x` string").repartition(4)
    out = pii.find(docs).select("doc_id", "text", "base_spans", "spans", pii.written(F.col("base_spans")).alias("w"), pii.redact(F.coalesce("text", F.lit("")), F.col("base_spans")).alias("clean")).collect()
    assert Counter((r.doc_id, r.w) for r in out) == Counter((i, ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t))) for i, t, *_ in rows)
    for r in out:
        assert set(r.base_spans) <= set(r.spans)
        assert [(s.kind, s.start) for s in r.spans] == sorted((s.kind, s.start) for s in r.spans)
        for s in set(r.spans) - set(r.base_spans):
            assert not any(b.start < s.end and s.start < b.end for b in r.base_spans)
        want, at = "", 0
        for a, b, k in sorted((s.start, s.end, s.kind) for s in r.base_spans):
            if b > at:
                want += (r.text or "")[at : max(a, at)] + (f"<{pii.KINDS[k].upper()}>" if a >= at else "")
                at = b
        assert r.clean == want + (r.text or "")[at:]
    assert pii.find(docs.limit(0)).count() == 0


def test_the_method_adds_likely_spans(spark):
    rng = random.Random(2)
    number = lambda: f"({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    rows = [(i, f"please call +1 {number()} today") for i in range(150)] + [(1000 + i, f"phone {number()} now") for i in range(60)]
    rows += [(2000 + i, f"section {rng.randrange(10, 99)}.{rng.randrange(100, 999)}.{rng.randrange(100, 999)} of it") for i in range(80)] + [(3000, "write to joe (at) mail (dot) com please")]
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    added = {i for i, r in out.items() if len(r.spans) > len(r.base_spans)}
    assert len([i for i in added if 1000 <= i < 2000]) == 60
    assert not [i for i in added if 2000 <= i < 3000 or i < 1000]


def test_reliabilities_find_the_noisy_labeler():
    rng = random.Random(3)
    patterns = Counter()
    for _ in range(5000):
        truth = rng.random() < 0.4
        vote = lambda right: (1 if truth else -1) * (1 if rng.random() < right else -1)
        patterns[vote(0.95), vote(0.9), vote(0.5), vote(0.85)] += 1
    share, chance, _ = pii.reliabilities(dict(patterns))
    assert abs(share - 0.4) < 0.05
    assert abs(chance[0][True, 1] - 0.95) < 0.04 and abs(chance[2][True, 1] - 0.5) < 0.05


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    found = docs.withColumn("x", F.concat(*(pii._candidates(F.col("text"), k, i) for i, k in enumerate(pii.KINDS))))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert hashlib.sha256(b"").hexdigest() == docs.select(F.sha2(F.lit("").cast("binary"), 256)).first()[0]


def test_spans_of_a_long_text_in_time(spark):
    n = 200_000
    docs = spark.createDataFrame([(1, "ab@cd.ef or 10.2.3.4 " * n, "user's", n)], "doc_id long, text string, spans string, n_chars long")
    began = time.monotonic()
    (r,) = pii.cleaned(docs).selectExpr("doc_id", "spans", "n_chars", "text = repeat('<EMAIL> or <IP> ', 200000) same").collect()
    assert (r.doc_id, r.spans, r.n_chars, r.same) == (1, "user's", 16 * n, True)
    assert time.monotonic() - began < 60


@pytest.mark.parametrize("n", [0, 1, 2, 255, 256, 257, 700])
def test_running(spark, n):
    rng = random.Random(n)
    items = [rng.randrange(100) for _ in range(n)]
    df = spark.createDataFrame([(items,)], "a array<int>")
    sums, most = df.select(pii.running(F.col("a"), "int", pii._add, F.lit(0)), pii.running(F.col("a"), "int", F.greatest, F.lit(0))).first()
    assert sums == list(accumulate(items)) and most == list(accumulate(items, max))


def test_clear_spans(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(200):
        made = lambda k: sorted({(rng.randrange(4), a, a + rng.randrange(1, 9)) for a in rng.sample(range(60), k)})
        rows.append((made(rng.randrange(1, 9)) * rng.choice([1, 2]), made(rng.randrange(0, 9))))
    df = spark.createDataFrame(rows, f"more {pii.SPAN}, base {pii.SPAN}")
    for r in df.withColumn("out", pii._clear(F.col("more"), F.col("base"))).collect():
        want = {m for m in map(tuple, r.more) if not any(b.start < m[2] and m[1] < b.end for b in r.base)}
        assert sorted(map(tuple, r.out)) == sorted(want)


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, t, f"n{i}", "x") for i, t in enumerate(texts())] + [(7, texts()[40], "a", "b"), (None, "a@b.c", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_email string, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.op6_pii(spark, str(tmp_path)).collect()
    want = Counter()
    for i, t, *_ in rows:
        found = brute(t)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()
        want[(i, *(sum(k == x for x, *_ in found) for k in pii.KINDS), digest)] += 1
    assert Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == want
    assert any(r.n_card != r.n_ip for r in out)


def test_the_method_finds_what_a_rule_swallows(spark):
    rng = random.Random(4)
    number = lambda: f"+1 ({rng.randrange(200, 999)}) {rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    rows = [(i, f"so {number()} it is") for i in range(100)] + [(500, f"so {number()} 190.137.223.204 it is")]
    out = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(s.kind, s.start, s.end) for s in out[500].spans] == [(1, 21, 36), (3, 3, 20)]
    assert all(r.spans == r.base_spans for i, r in out.items() if i < 500)
