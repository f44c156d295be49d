"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import _common as C

#: More rounds than any input needs: the number grows with the square of the logarithm of a component's size.
MOST_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the edges (a, b): component is the smallest node reachable.

    Edges may repeat, run both ways or join a node to itself; nulls are ignored. Every step is a join or a minimum
    by key, so no component meets in one task; each round's edges are written to the shared folder.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null")
    # Written once, so that whatever finds the edges runs once.
    given = C.cut(pairs.distinct(), "edges")
    loops, pairs = given.where("u = v"), given.where("u > v")
    for n in range(MOST_ROUNDS):
        if star(pairs):
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs, last = C.cut(small.unionByName(least.toDF("u", "v")).distinct(), "edges"), pairs
        if n:
            C.drop_table(last)
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select("v").union(loops.select("v")).distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    leaves = pairs.toDF("node", "component")
    return leaves.unionByName(roots.join(leaves, "node", "left_anti"))


def star(pairs: DataFrame) -> bool:
    """Whether each u has one v and no v is a u."""
    several = pairs.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    inner = pairs.select("u").join(pairs.select(F.col("v").alias("u")), "u", "left_semi")
    return several.union(inner).limit(1).count() == 0
