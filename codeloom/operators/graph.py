"""Package graphs: neighbours, closure, cycles, levels and metrics over edges (src, dst)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.tables import cut

#: Edges up to which cycles and levels are found in one task, in linear time; a larger graph takes rounds of joins over
#: the whole cluster, as many as its longest shortest path.
MOST_IN_TASK = 2_000_000

Adjacent = dict[str, list[str]]


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()


def _fits(edges: DataFrame) -> bool:
    return edges.limit(MOST_IN_TASK + 1).count() <= MOST_IN_TASK


def _in_task(edges: DataFrame, find: Callable[[Adjacent], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that `find` makes of all edges, by source, in one task."""
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in schema.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: Adjacent = {}
        for batch in parts:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.setdefault(a, []).append(b)
                out.setdefault(b, [])
        found = list(find(out))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    return edges.select("src", "dst").repartition(1).mapInArrow(run, schema)


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) with a path from src to dst; nodes on a cycle reach themselves. Each round joins the paths known to
    one another, so that their length doubles."""
    known = cut(edges.select("src", "dst").distinct())
    n = known.count()
    while True:
        longer = known.toDF("src", "via").join(known.toDF("via", "dst"), "via").select("src", "dst")
        known = cut(known.union(longer).distinct())
        if (more := known.count()) == n:
            return known
        n = more


def transitive_deps(edges: DataFrame) -> DataFrame:
    return closure(edges).where("src <> dst")


def _strong(out: Adjacent) -> Iterator[tuple[str, str]]:
    """(node, smallest node of its strongly connected component), by one depth-first walk: a component ends where a node
    reaches nothing older than itself that is still open."""
    seen: dict[str, int] = {}
    low: dict[str, int] = {}
    place: dict[str, int] = {}
    open_: list[str] = []
    closed: set[str] = set()
    for start in out:
        if start in seen:
            continue
        path = [(start, iter(out[start]))]
        seen[start] = low[start] = len(seen)
        place[start] = len(open_)
        open_.append(start)
        while path:
            node, rest = path[-1]
            ahead = next(rest, None)
            if ahead is None:
                path.pop()
                if path:
                    low[path[-1][0]] = min(low[path[-1][0]], low[node])
                if low[node] == seen[node]:
                    members = open_[place[node] :]
                    del open_[place[node] :]
                    closed.update(members)
                    least = min(members)
                    yield from ((m, least) for m in members)
            elif ahead not in seen:
                seen[ahead] = low[ahead] = len(seen)
                place[ahead] = len(open_)
                open_.append(ahead)
                path.append((ahead, iter(out[ahead])))
            elif ahead not in closed:
                low[node] = min(low[node], seen[ahead])


def _settled(start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What step leaves unchanged, starting from `start`."""
    now = cut(start)
    while True:
        new = cut(step(now))
        if not new.exceptAll(now).limit(1).count():
            return new
        now = new


def _strong_in_rounds(edges: DataFrame) -> DataFrame:
    """(node, root) by colours: each node takes the smallest node that reaches it; what a colour's own node is reached
    from inside the colour is its component. Components go, and the rest is coloured anew."""
    left, done = cut(edges), None
    while left.limit(1).count():
        start = nodes(left).withColumn("c", F.col("node"))

        def spread(now: DataFrame, left: DataFrame = left) -> DataFrame:
            sent = left.join(now, left["src"] == now["node"]).select(F.col("dst").alias("node"), "c")
            return now.union(sent).groupBy("node").agg(F.min("c").alias("c"))

        colour = _settled(start, spread)
        inside = left.join(colour.toDF("src", "cs"), "src").join(colour.toDF("dst", "cd"), "dst").where("cs = cd").select("src", "dst")

        def back(now: DataFrame, inside: DataFrame = inside) -> DataFrame:
            return now.union(inside.join(now.toDF("dst", "c"), "dst").select(F.col("src").alias("node"), "c")).distinct()

        found = _settled(colour.where("node = c"), back)
        done = found if done is None else done.union(found)
        gone = found.select("node")
        left = cut(left.join(gone.toDF("src"), "src", "left_anti").join(gone.toDF("dst"), "dst", "left_anti").select("src", "dst"))
    return done.groupBy("node").agg(F.min("c").alias("root")) if done is not None else edges.select(F.col("src").alias("node"), F.col("dst").alias("root"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node: root is the smallest node of its strongly connected component."""
    edges = cut(edges.select("src", "dst").distinct())
    if _fits(edges):
        return _in_task(edges, _strong, "node string, root string")
    # A node whose neighbours have all gone is a component of its own.
    return nodes(edges).join(_strong_in_rounds(edges), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """Edges that lie on a cycle: both ends are in one component."""
    root = cut(strong_components(edges))
    rows = edges.join(root.toDF("src", "rs"), "src").join(root.toDF("dst", "rd"), "dst")
    return rows.where("rs = rd").select(*edges.columns)


def cycles(edges: DataFrame) -> DataFrame:
    """Strongly connected components of more than one node, and nodes with an edge to themselves: cycle (smallest
    member), members, size."""
    out = strong_components(edges).groupBy("root").agg(F.array_sort(F.collect_set("node")).alias("m"))
    own = edges.where("src = dst").select(F.col("src").alias("root")).distinct().withColumn("own", F.lit(True))
    out = out.join(own, "root", "left").where("size(m) > 1 or own")
    return out.select(F.col("root").alias("cycle"), F.array_join("m", ",").alias("members"), F.size("m").cast("long").alias("size"))


def would_create_cycle(edges: DataFrame, candidates: DataFrame) -> DataFrame:
    """Candidate edges (src, dst) for which src is already reachable from dst. The search goes out from the candidates'
    ends alone; a round takes one more edge."""
    edges = cut(edges.select("src", "dst").distinct())
    wanted = cut(candidates.select("src", "dst").distinct())
    step = edges.toDF("at", "next")
    front = known = cut(wanted.select(F.col("dst").alias("origin"), F.col("dst").alias("at")).distinct())
    while True:
        found = front.join(step, "at").select("origin", F.col("next").alias("at")).distinct()
        front = cut(found.join(known, ["origin", "at"], "left_anti"))
        if not front.limit(1).count():
            break
        known = cut(known.union(front))
    back = known.where("origin <> at").select(F.col("at").alias("src"), F.col("origin").alias("dst"))
    own = wanted.where("src = dst")
    if own.limit(1).count():
        back = back.union(own.join(cyclic_edges(edges).select("src").distinct(), "src", "left_semi").select("src", "dst"))
    return candidates.join(back, ["src", "dst"], "left_semi")


def _levels(out: Adjacent) -> Iterator[tuple[str, int | None]]:
    """(node, level): a node is settled once all that it leads to is; those that never are have no level."""
    into: Adjacent = {n: [] for n in out}
    waiting = {n: len(ends) for n, ends in out.items()}
    for n, ends in out.items():
        for e in ends:
            into[e].append(n)
    level = {n: 0 for n, k in waiting.items() if not k}
    todo = list(level)
    for n in todo:
        for above in into[n]:
            level[above] = max(level.get(above, 0), level[n] + 1)
            waiting[above] -= 1
            if not waiting[above]:
                todo.append(above)
    yield from ((n, level[n] if not waiting[n] else None) for n in out)


def levels(edges: DataFrame) -> DataFrame:
    """(node, level): leaves are 0, others one above their highest dependency; a cycle is an error."""
    edges = cut(edges.select("src", "dst").distinct())
    if not _fits(edges):
        return _levels_in_rounds(edges)
    found = cut(_in_task(edges, _levels, "node string, level long"))
    if found.where("level is null").limit(1).count():
        raise ValueError("the graph has a cycle")
    return found


def _levels_in_rounds(edges: DataFrame) -> DataFrame:
    """Peels off the nodes without remaining edges, round by round."""
    left, waiting, done, level = edges, nodes(edges), None, 0
    while True:
        free = waiting.join(left.select(F.col("src").alias("node")).distinct(), "node", "left_anti")
        free = cut(free.withColumn("level", F.lit(level).cast("long")))
        if not free.limit(1).count():
            if waiting.limit(1).count():
                raise ValueError("the graph has a cycle")
            return done if done is not None else free
        done = free if done is None else done.union(free)
        waiting = cut(waiting.join(free, "node", "left_anti"))
        left = cut(left.join(free.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"))
        level += 1


def topological_order(edges: DataFrame) -> DataFrame:
    """node, level, place: nodes before all that they lead to, those of one level by name. Places are numbered within
    each level; the levels' sizes, one row for each, are added up to put them behind one another."""
    found = levels(edges)
    size = found.groupBy("level").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = size.select("level", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("level").orderBy("node"))
    return found.withColumn("rank", rank).join(F.broadcast(base), "level").select("node", "level", (F.col("before") + F.col("rank")).cast("long").alias("place"))


def dependencies(edges: DataFrame, node: str) -> DataFrame:
    """What a node leads to directly: package and the edges' other columns."""
    return edges.where(F.col("src") == node).drop("src").withColumnRenamed("dst", "package")


def dependents(edges: DataFrame, node: DataFrame) -> DataFrame:
    """What leads directly to the nodes of a table (dst)."""
    return edges.join(node, "dst", "left_semi").drop("dst").withColumnRenamed("src", "package")


def degrees(edges: DataFrame) -> DataFrame:
    """node, incoming, outgoing."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("outgoing"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("incoming"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.join(into, "node", "full_outer").select("node", zero("incoming"), zero("outgoing"))


def metrics(edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    d = all_nodes.join(degrees(edges), "node", "left").fillna(0)
    return d.agg(F.count("*").alias("total_nodes"), F.sum("outgoing").alias("total_edges"), F.round(F.avg("outgoing"), 6).alias("average_deps"), F.max("outgoing").alias("max_deps"), F.count_if(F.col("outgoing") == 0).alias("nodes_without_deps"))


def import_metrics(edges: DataFrame, all_nodes: DataFrame) -> DataFrame:
    """Metrics with the number of edges that lie on cycles. The edges are written first, as three plans read them."""
    edges = cut(edges)
    inside = cyclic_edges(edges).agg(F.count("*").alias("cyclical_edges"))
    return metrics(edges, all_nodes).join(F.broadcast(inside))


def remove_node(edges: DataFrame, node: DataFrame) -> DataFrame:
    """Edges without those at the nodes."""
    kept = edges.join(node.select(F.col("node").alias("src")), "src", "left_anti")
    return kept.join(node.select(F.col("node").alias("dst")), "dst", "left_anti")


def backwards(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Edges that lead to a higher tier."""
    tier = lambda end: layers.select(F.col("package").alias(end), F.col("tier").alias(f"{end}_tier"))
    return edges.join(tier("src"), "src").join(tier("dst"), "dst").where("dst_tier > src_tier and src_tier >= 0")
