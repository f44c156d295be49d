import random

import pytest

from codeloom.operators import graph as G


def brute(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: set() for n in nodes}
    for n in nodes:
        todo = [b for a, b in edges if a == n]
        while todo:
            x = todo.pop()
            if x not in reach[n]:
                reach[n].add(x)
                todo += [b for a, b in edges if a == x]
    return nodes, reach


def frame(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


@pytest.mark.parametrize("most", [2_000_000, 0])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_and_cycles(spark, monkeypatch, most, seed):
    monkeypatch.setattr(G, "MOST_IN_TASK", most)
    rng = random.Random(seed)
    edges = list({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(16)})
    nodes, reach = brute(edges)
    root = {n: min([m for m in nodes if m in reach[n] and n in reach[m]] + [n]) for n in nodes}
    assert {r.node: r.root for r in G.strong_components(frame(spark, edges)).collect()} == root
    want = {}
    for n in nodes:
        if n in reach[n]:
            want.setdefault(root[n], set()).add(n)
    assert {(r.cycle, r.members, r["size"]) for r in G.cycles(frame(spark, edges)).collect()} == {(c, ",".join(sorted(m)), len(m)) for c, m in want.items()}
    assert {tuple(r) for r in G.cyclic_edges(frame(spark, edges)).collect()} == {(a, b) for a, b in edges if root[a] == root[b]}
    candidates = [(a, b) for a in nodes for b in nodes if rng.random() < 0.2]
    if candidates and most:
        got = {tuple(r) for r in G.would_create_cycle(frame(spark, edges), frame(spark, candidates)).collect()}
        assert got == {(a, b) for a, b in candidates if a in reach[b]}
        assert {tuple(r) for r in G.closure(frame(spark, edges)).collect()} == {(a, b) for a in nodes for b in reach[a]}


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_levels(spark, monkeypatch, most):
    monkeypatch.setattr(G, "MOST_IN_TASK", most)
    rng = random.Random(4)
    edges = list({(f"n{a:02}", f"n{b:02}") for a, b in (sorted((rng.randrange(12), rng.randrange(12)), reverse=True) for _ in range(25)) if a != b})
    level = {}
    for n in sorted({x for e in edges for x in e}):
        level[n] = max((level[b] + 1 for a, b in edges if a == n), default=0)
    assert {r.node: r.level for r in G.levels(frame(spark, edges)).collect()} == level
    order = [r.node for r in G.topological_order(frame(spark, edges)).orderBy("place").collect()]
    assert order == sorted(level, key=lambda n: (-level[n], n))
    with pytest.raises(Exception, match="cycle"):
        G.levels(frame(spark, [*edges, ("a", "b"), ("b", "a")])).collect()


def test_large_graph_with_a_long_path(spark):
    n = 100_000
    wide = spark.range(n).selectExpr("concat('w', id) src", "concat('w', (id * 7919 + 13) % 100000) dst").where("src <> dst")
    path = spark.range(1000).selectExpr("concat('p', lpad(id, 4, '0')) src", "concat('p', lpad(id + 1, 4, '0')) dst")
    ring = path.union(frame(spark, [("p1000", "p0000")]))
    (r,) = G.cycles(ring).collect()
    assert (r.cycle, r["size"]) == ("p0000", 1001)
    assert G.levels(path).agg({"level": "max"}).first()[0] == 1000
    found = G.strong_components(wide.union(path))
    assert found.count() == found.select("node").distinct().count() >= n
    assert G.closure(path.where("src < 'p0100'")).count() == 100 * 101 // 2
