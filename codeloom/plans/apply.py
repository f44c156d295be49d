"""Change sets (file, start, end, old_text, new_text, description) on source files: validation, preview, application."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import preview
from codeloom.plans.changes import overlaps

CHANGE = "file string, start int, end int, old_text string, new_text string, description string"


def changes(rows: DataFrame, description: str) -> DataFrame:
    """The columns of a change set, out of rows that have file (or file_path), start, end, old_text and new_text."""
    file = F.col("file") if "file" in rows.columns else F.col("file_path")
    return rows.select(file.alias("file"), F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), "old_text", "new_text", F.lit(description).alias("description"))


def issues(plan: DataFrame, files: DataFrame) -> DataFrame:
    """What is wrong with a plan: type, severity, description, file, start. Impossible or overlapping positions, files
    that don't exist, and old text that isn't there are errors."""
    row = lambda df, kind, text: df.select(F.lit(kind).alias("type"), F.lit("Error").alias("severity"), F.lit(text).alias("description"), "file", "start")
    held = files.select(F.col("file_path").alias("file"), "content")
    known = plan.join(held, "file")
    bounds = plan.where("start < 0 or end < start")
    beyond = known.where(F.col("end") > F.octet_length("content"))
    there = F.decode(F.substring("content", F.col("start") + 1, F.col("end") - F.col("start")), "UTF-8")
    differs = known.where((F.col("old_text") != "") & (there != F.col("old_text")) & (F.col("end") <= F.octet_length("content")))
    # Numbered by place, so that equal changes are told apart.
    numbered = plan.withColumn("seq", F.xxhash64("file", "start", "end", "new_text"))
    over = overlaps(numbered).select("file", F.col("a_seq").alias("seq")).join(numbered.select("file", "seq", "start"), ["file", "seq"])
    missing = plan.where("start > 0").join(held.select("file"), "file", "left_anti")
    out = row(bounds, "InvalidPosition", "start and end are no range")
    for df, kind, text in ((beyond, "InvalidPosition", "the range ends behind the file"), (differs, "TextMismatch", "the old text is not there"), (over, "Overlap", "changes overlap"), (missing, "MissingFile", "no such file")):
        out = out.unionByName(row(df, kind, text))
    return out.distinct()


def applied(plan: DataFrame, files: DataFrame) -> DataFrame:
    """(file, content) of each file that the plan changes, changes taken from the file's end. Files are joined to their
    changes by path, and each is edited as bytes in one pass. A file that doesn't exist starts out empty. Equal changes
    count once; changes at one place keep the order of their new text."""
    edits = plan.distinct().groupBy("file").agg(F.collect_list(F.struct("start", "end", "new_text")).alias("edits"))
    rows = edits.join(files.select(F.col("file_path").alias("file"), "content"), "file", "left")

    def edit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for content, changes_ in zip(part["content"], part["edits"]):
                raw = bytes(content) if content is not None else b""
                pieces, at = [], 0
                for start, end, text in sorted((c["start"], c["end"], c["new_text"]) for c in changes_):
                    if start < at or end > len(raw):
                        raise ValueError(f"change at {start} overlaps another or ends behind the file")
                    pieces += [raw[at:start], text.encode()]
                    at = end
                out.append(b"".join([*pieces, raw[at:]]))
            yield pd.DataFrame({"file": part["file"], "content": out})

    return rows.select("file", "content", "edits").mapInPandas(edit, "file string, content binary")


def updated(files: DataFrame, plan: DataFrame) -> DataFrame:
    """All files, changed ones with their new content; files that a plan empties are gone."""
    new = applied(plan, files).select(F.col("file").alias("file_path"), F.col("content").alias("new"))
    rows = files.select("file_path", "content").join(new, "file_path", "full_outer")
    rows = rows.select("file_path", F.coalesce("new", "content").alias("content"), F.col("new").isNotNull().alias("changed"))
    return rows.where((F.octet_length("content") > 0) | ~F.col("changed"))


def previewed(plan: DataFrame) -> DataFrame:
    """One line for each change, in the order of files and places."""
    return plan.select("file", "start", "end", preview(F.col("old_text")).alias("old"), preview(F.col("new_text")).alias("new"), "description").orderBy("file", "start", "end")


def summary(plan: DataFrame) -> DataFrame:
    return plan.groupBy("file").agg(F.count("*").alias("change_count"))
