import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import analyzers, graph, imports, symbols
from codeloom.plans import changes
from codeloom.sources.tables import cut
from codeloom.streaming import watch

DIAMOND = [("p1", "p2"), ("p1", "p3"), ("p2", "p4"), ("p3", "p4")]


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src string, dst string")


def pairs(df):
    return {tuple(r) for r in df.collect()}


def test_diamond(spark):
    e = edges(spark, DIAMOND)
    assert pairs(graph.levels(e)) == {("p4", 0), ("p2", 1), ("p3", 1), ("p1", 2)}
    assert pairs(graph.closure(e)) == {*DIAMOND, ("p1", "p4")}
    assert graph.cycles(e).count() == 0
    assert pairs(graph.would_create_cycle(e, edges(spark, [("p4", "p1"), ("p1", "p4"), ("p4", "p2")]))) == {("p4", "p1"), ("p4", "p2")}


def test_cycles(spark):
    e = edges(spark, [*DIAMOND, ("p4", "p2"), ("x", "x2"), ("x2", "x3"), ("x3", "x"), ("p1", "x")])
    assert pairs(graph.cycles(e)) == {("p2", "p2,p4", 2), ("x", "x,x2,x3", 3)}
    with pytest.raises(ValueError, match="cycle"):
        graph.levels(e)
    reach = graph.closure(e)
    assert pairs(graph.closure(reach)) == pairs(reach)
    assert not {r for r in pairs(graph.remove_node(e, spark.createDataFrame([("p4",)], "node string"))) if "p4" in r}


def test_levels_rise_along_edges(spark):
    rng = random.Random(4)
    e = list({(f"n{max(a, b):02}", f"n{min(a, b):02}") for a, b in [(rng.randrange(30), rng.randrange(30)) for _ in range(60)] if a != b})
    level = dict(pairs(graph.levels(edges(spark, e))))
    assert all(level[s] > level[d] for s, d in e)
    assert all(level[s] == 1 + max(level[d] for x, d in e if x == s) for s in {s for s, _ in e})


def test_overlap_rules(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), i, s := rng.randrange(400), s + rng.choice([0, 1, 5, 90, 200])) for i in range(120)]
    df = spark.createDataFrame(rows, "file int, seq int, start int, end int")
    both = [(a, b) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]]
    assert pairs(changes.overlaps(df)) == {(a[0], a[1], b[1]) for a, b in both if a[2] < b[3] and b[2] < a[3]}
    assert pairs(changes.conflicts(df)) == {(a[0], a[1], b[1]) for a, b in both if a[2] <= b[2] < a[3] or b[2] <= a[2] < b[3]}
    merged = changes.merged(df).collect()
    assert sum(r.changes for r in merged) == len(rows)
    for f in (0, 1):
        spans = sorted((r.start, r.end) for r in merged if r.file == f)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_thresholds(spark):
    levels = spark.createDataFrame([(x,) for x in (4, 5, 9, 10, 14, 15, 19, 20)], "n int").select("n", analyzers.complexity_level(F.col("n")))
    assert dict(pairs(levels)) == {4: "low", 5: "moderate", 9: "moderate", 10: "high", 14: "high", 15: "very_high", 19: "very_high", 20: "extreme"}


def test_text(spark):
    lines = spark.createDataFrame([(1, 1, "é"), (1, 2, ""), (1, 3, "x")], "file int, line int, text string")
    assert pairs(text.line_offsets(lines)) == {(1, 1, 0), (1, 2, 3), (1, 3, 4)}
    df = spark.createDataFrame([("a\t\n b",), ("x" * 80,), ("x" * 81,)], "t string").select(text.preview(F.col("t")))
    assert {r[0] for r in df.collect()} == {"a b", "x" * 80, "x" * 77 + "..."}
    df = spark.createDataFrame([("the then the_the (the) xthe the",)], "t string").select(text.rename_token(F.col("t"), "the", "a"))
    assert df.first()[0] == "a then the_the (a) xthe a"


def test_symbols(spark):
    methods = spark.createDataFrame([("A", "Get"), ("A", "Set"), ("B", "Get"), ("C", "Put")], "type string, method string")
    wanted = spark.createDataFrame([("Get",), ("Set",)], "method string")
    assert pairs(symbols.implementations(methods, wanted)) == {("A", 2)}
    assert pairs(symbols.missing_methods(methods, wanted)) == {("B", "Set"), ("C", "Get"), ("C", "Set")}
    embeds = spark.createDataFrame([("C", "A")], "type string, embedded string")
    assert pairs(symbols.method_set(methods, embeds)) == {*pairs(methods), ("C", "Get"), ("C", "Set")}
    names = spark.createDataFrame([("load",), ("loads",), ("lead",), ("other",)], "name string")
    assert {r[:2] for r in pairs(symbols.similar_names(names))} == {("load", "loads"), ("loads", "load"), ("load", "lead"), ("lead", "load"), ("loads", "lead"), ("lead", "loads")}


def test_import_tiers(spark):
    df = spark.createDataFrame([("a/x",), ("b",), ("c",)], "path string")
    assert dict(pairs(df.select("path", imports.tier(F.col("path"), [("a", 2), ("", 9), ("b", 3)], 0)))) == {"a/x": 2, "b": 3, "c": 0}


def events():
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    out, at = [], {p: start for p in range(5)}
    for i in range(300):
        p = rng.randrange(5)
        at[p] += dt.timedelta(seconds=rng.choice([1, 20, 59, 60, 61, 500]))
        out.append((p, rng.choice(["write", "remove"]), at[p], i))
    return sorted(out, key=lambda r: r[2])


def test_stream_equals_batch(spark, tmp_path):
    df = spark.createDataFrame(events(), "path int, op string, ts timestamp, event_id long")
    df.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "events"))
    run = watch.debounce_stream(stream).writeStream.format("memory").queryName("debounced").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    run.awaitTermination()
    got = {(r.path, r.session_start, r.events, r.last_op) for r in spark.table("debounced").collect()}
    want = {(r.path, r.session_start, r.events, r.last_op) for r in watch.sessions(df).collect()}
    assert got and got <= want
    end = max(e[2] for e in events())
    assert {w for w in want if w[1] < end - dt.timedelta(hours=1)} <= got


def test_updates_by_batch(spark, tmp_path):
    df = spark.createDataFrame(events(), "path int, op string, ts timestamp, event_id long")
    df.write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    watch.run_updates(watch.accepted(stream, ("write", "remove")), lambda d, n: seen.extend(d.collect()), str(tmp_path / "ck")).awaitTermination()
    assert {(r.path, r.op) for r in seen} == {(r.path, r.op) for r in watch.last_op(df).collect()}
    current = spark.createDataFrame([(0, "old"), (99, "old")], "path int, state string")
    updates = watch.last_op(df).select("path", F.col("op").alias("state"))
    now = dict(pairs(watch.upserted(current, updates, "path", F.col("state") == "remove")))
    assert now[99] == "old" and "remove" not in now.values() and now.get(0) != "old"


def test_cut_keeps_rows(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2)
    assert pairs(cut(df)) == pairs(df)
