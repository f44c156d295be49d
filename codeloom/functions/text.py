"""Lines, offsets and tokens of file contents."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREVIEW = 80
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"


def line_offsets(lines: DataFrame) -> DataFrame:
    """Byte offset at which each line starts."""
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return lines.select("file", "line", F.coalesce(F.sum(F.octet_length("text") + 1).over(before), F.lit(0)).cast("long").alias("offset"))


def preview(text: Column, most: int = PREVIEW) -> Column:
    """Text on one line, cut to `most` characters."""
    flat = F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most - 3), F.lit("..."))).otherwise(flat)


def inverted_index(files: DataFrame) -> DataFrame:
    """Identifiers of files (file, content), with the number of their occurrences and of the files that have them:
    counted for each file first, where most of it happens before anything is dealt, then added up."""
    found = files.select("file", F.explode(F.regexp_extract_all("content", F.lit(f"({IDENTIFIER})"), F.lit(1))).alias("name"))
    counts = found.groupBy("name", "file").agg(F.count("*").alias("n"))
    return counts.groupBy("name").agg(F.sum("n").alias("occurrences"), F.count("*").alias("files"))


def rename_token(text: Column, old: str, new: str) -> Column:
    """Replace an identifier where it stands alone."""
    pattern = f"(?<![A-Za-z0-9_]){re.escape(old)}(?![A-Za-z0-9_])"
    return F.regexp_replace(text, pattern, new.replace("\\", "\\\\").replace("$", "\\$"))
