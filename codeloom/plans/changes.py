"""Change sets (file, seq, start, end): overlaps, conflicts, merging, order and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width of the stretches that changes are dealt to before they are compared, in bytes.
STRETCH = 64


def _pairs(changes: DataFrame, condition: str) -> DataFrame:
    """Pairs (a, b) with a.seq < b.seq in one file that meet the condition. Changes are dealt to fixed stretches of the
    file, so only near ones are compared, however many a file has; a pair counts in the first stretch both touch."""
    cells = F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor(F.greatest("start", "end") / STRETCH))).alias("cell")
    spread = changes.select("file", "seq", "start", "end", F.floor(F.col("start") / STRETCH).alias("first"), cells)
    a = spread.toDF("file", "a_seq", "a_start", "a_end", "a_first", "cell")
    b = spread.toDF("file", "b_seq", "b_start", "b_end", "b_first", "cell")
    met = a.join(b, ["file", "cell"]).where("a_seq < b_seq and cell = greatest(a_first, b_first)").where(condition)
    return met.select("file", "a_seq", "b_seq")


def overlaps(changes: DataFrame) -> DataFrame:
    """Half-open overlap; an insertion at a range's start does not overlap it."""
    return _pairs(changes, "a_start < b_end and b_start < a_end")


def conflicts(changes: DataFrame) -> DataFrame:
    """The stricter rule: a start that lies inside the other, its start included."""
    return _pairs(changes, "(a_start <= b_start and b_start < a_end) or (b_start <= a_start and a_start < b_end)")


def innermost(positions: DataFrame, spans: DataFrame) -> DataFrame:
    """file, pos_id, span: the narrowest span (file, seq, start, end) around each position (file, pos_id, p), of equally
    narrow ones the first by seq; a position's own span doesn't count. Spans are dealt to the stretches that they touch."""
    cells = F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor(F.col("end") / STRETCH))).alias("cell")
    dealt = spans.where("end >= start").select("file", "seq", "start", "end", cells)
    at = positions.withColumn("cell", F.floor(F.col("p") / STRETCH))
    met = at.join(dealt, ["file", "cell"]).where("start <= p and p < end and seq <> pos_id")
    best = F.min_by("seq", F.struct(F.col("end") - F.col("start"), "seq"))
    return met.groupBy("file", "pos_id").agg(best.alias("span"))


def merged(changes: DataFrame) -> DataFrame:
    """Overlapping or adjacent changes of a file as one, islands between gaps: file, start, end, changes, and where
    changes have descriptions these, joined in the changes' order."""
    order = Window.partitionBy("file").orderBy("start", "end", "seq")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = changes.withColumn("new", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    islands = flagged.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    made = [F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("changes")]
    if "description" in changes.columns:
        told = F.array_sort(F.collect_list(F.struct("start", "end", "seq", "description")))
        made.append(F.array_join(F.transform(told, lambda x: x["description"]), "; ").alias("description"))
    return islands.groupBy("file", "island").agg(*made).drop("island")


def apply_order(changes: DataFrame) -> DataFrame:
    """Place of each change when a file's changes are applied from its end."""
    order = Window.partitionBy("file").orderBy(F.desc("start"), F.desc("seq"))
    return changes.select("file", "seq", F.row_number().over(order).cast("long").alias("apply_order"))


def invalid(changes: DataFrame, shortest: int = 0) -> DataFrame:
    """Changes with impossible bounds or shorter than a length."""
    return changes.where((F.col("start") < 0) | (F.col("end") < F.col("start") + shortest)).select("file", "seq", F.lit("invalid position").alias("issue"))


def affected_files(changes: DataFrame) -> DataFrame:
    return changes.groupBy("file").agg(F.count("*").alias("change_count"))


def line_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Lines of two versions (file, line, text) that differ by position; blank ones count as absent."""
    solid = lambda df, name: df.where(F.trim("text") != "").select("file", "line", F.col("text").alias(name))
    both = solid(old, "old_text").join(solid(new, "new_text"), ["file", "line"], "full_outer")
    return both.where(~F.col("old_text").eqNullSafe(F.col("new_text")))


def step_conflicts(changes: DataFrame) -> DataFrame:
    """file, a_step, b_step, conflicts: how many changes (file, start, end, step) of two steps of a batch overlap."""
    numbered = changes.withColumn("seq", F.xxhash64("file", "start", "end", "step", "new_text") if "new_text" in changes.columns else F.col("seq"))
    step = lambda end: numbered.select("file", F.col("seq").alias(f"{end}_seq"), F.col("step").alias(f"{end}_step")).distinct()
    rows = overlaps(numbered).join(step("a"), ["file", "a_seq"]).join(step("b"), ["file", "b_seq"]).where("a_step <> b_step")
    return rows.groupBy("file", F.least("a_step", "b_step").alias("a_step"), F.greatest("a_step", "b_step").alias("b_step")).agg(F.count("*").alias("conflicts"))
