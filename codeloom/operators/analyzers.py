"""Code-quality measures over the nodes of functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = ((20, "extreme"), (15, "very_high"), (10, "high"), (5, "moderate"))


def complexity_level(value: Column) -> Column:
    out = F.when(value >= LEVELS[0][0], LEVELS[0][1])
    for least, name in LEVELS[1:]:
        out = out.when(value >= least, name)
    return out.otherwise("low")


def complexity(nodes: DataFrame) -> DataFrame:
    """Cyclomatic and cognitive complexity and depth of each function."""
    branch = F.col("branch")
    return nodes.groupBy("func_id").agg(
        (F.count_if(branch) + 1).alias("cyclomatic_complexity"),
        F.sum(F.when(branch, 1 + F.col("depth")).otherwise(0)).cast("long").alias("cognitive_complexity"),
        F.max("depth").cast("long").alias("max_nesting_depth"),
        F.count("*").alias("lines_of_code"),
    )


def boolean_groups(assigns: DataFrame, least: int = 2) -> DataFrame:
    """Values that at least `least` distinct flags of a function are taken from: func_id, source, branch_count."""
    groups = assigns.groupBy("func_id", "source").agg(F.countDistinct("variable").alias("branch_count"))
    return groups.where(F.col("branch_count") >= least)


def propagation(steps: DataFrame, least: int = 1) -> DataFrame:
    """Chains of steps (batch, step, op) in their order, with depth one less than their length."""
    chains = steps.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("step", "op"))).alias("c"))
    out = chains.select("batch", F.array_join(F.col("c.op"), ">").alias("call_chain"), (F.size("c") - 1).cast("long").alias("propagation_depth"))
    return out.where(F.col("propagation_depth") >= least)
