import time
from collections import Counter

import pytest

from codeloom.golang import facts
from codeloom.sources import workspace
from codeloom.streaming import watch


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for path, content in {"go.mod": "module example.org/w\n", "a/a.go": "package a\n\nfunc A() {}\n", "b/b.go": "package b\n", "vendor/v.go": "package v\n", "a/a.txt": "no"}.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    return root


def change(tree):
    (tree / "a/a.go").write_text("package a\n\nfunc A2() {}\n")
    (tree / "b/b.go").unlink()
    (tree / "c").mkdir()
    (tree / "c/c.go").write_text("package c\n")


def test_differences_of_listings(spark, tree):
    before = spark.createDataFrame(watch.listing(spark, str(tree)).collect())
    assert {r.path for r in before.collect()} == {"a/a.go", "b/b.go"}
    assert watch.differences(before, watch.listing(spark, str(tree))).count() == 0
    change(tree)
    found = watch.differences(before, watch.listing(spark, str(tree)))
    assert {(r.path, r.op) for r in found.collect()} == {("a/a.go", "write"), ("b/b.go", "remove"), ("c/c.go", "create")}
    assert {(r.dir, r.files, r.creates, r.writes, r.removes) for r in watch.changed_packages(found).collect()} == {("a", 1, 0, 1, 0), ("b", 1, 0, 0, 1), ("c", 1, 1, 0, 0)}


def test_accepted(spark):
    rows = [("a.go", "write"), ("a.txt", "write"), ("b.go", "chmod"), ("c.go", "rename")]
    got = watch.accepted(spark.createDataFrame(rows, "path string, op string"), suffix=".go").collect()
    assert [tuple(r) for r in got] == [("a.go", "write"), ("c.go", "rename")]


def test_workspace_follows_events(spark, tree):
    ws = workspace.load(spark, str(tree))
    change(tree)
    events = spark.createDataFrame([("a/a.go", "write"), ("a/a.go", "write"), ("b/b.go", "remove"), ("c/c.go", "create"), ("a/a.txt", "write")], "path string, op string")
    for new in (watch.updated(ws, spark, events), watch.synced(ws, spark)):
        assert {r.dir for r in new.packages.collect()} == {"a", "c"}
        assert [r.name for r in facts.symbols(new).collect()] == ["A2"]
    # An event of one file leaves the others as they were read.
    part = watch.updated(ws, spark, events.where("path = 'c/c.go'"))
    assert {r.dir for r in part.packages.collect()} == {"a", "b", "c"} and [r.name for r in facts.symbols(part).collect()] == ["A"]


def test_watched_tree(spark, tree, tmp_path):
    seen = []
    stream = watch.watched(spark, str(tree), lambda df, n: seen.append(Counter((r.path, r.op) for r in df.collect())), f"{tmp_path}/check")
    try:
        wait = time.monotonic() + 120
        while not seen and time.monotonic() < wait:
            time.sleep(0.2)
        assert seen[0] == Counter([("a/a.go", "create"), ("b/b.go", "create")])
        time.sleep(1.1)
        change(tree)
        while sum(map(len, seen)) < 5 and time.monotonic() < wait:
            time.sleep(0.2)
    finally:
        stream.stop()
    assert sum(seen[1:], Counter()) == Counter([("a/a.go", "write"), ("b/b.go", "remove"), ("c/c.go", "create")])
