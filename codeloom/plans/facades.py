"""Facades: packages that only re-export, found, generated for many packages and brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.golang import facts
from codeloom.plans.apply import changes
from codeloom.plans.refactor import RefactorError
from codeloom.sources.workspace import Workspace

FILE = "facade.go"


def detected(ws: Workspace) -> DataFrame:
    """dir of the packages all of whose lines, but for clauses, comments, brackets and blank ones, re-export something
    (`type`, `var` or `const` with ` = `), and that have a file that isn't empty."""
    rows = ws.files.where(~F.col("is_test") & (F.octet_length("content") > 0)).select("dir", F.explode(F.split(F.decode("content", "UTF-8"), "\n")).alias("line"))
    rows = rows.withColumn("line", F.trim(F.regexp_replace("line", r"[\t\r]", " ")))
    plain = (F.col("line") == "") | F.col("line").rlike(r'^(//|package |import)') | F.col("line").isin("(", ")")
    re_export = F.col("line").rlike("^(type|var|const) ") & F.col("line").contains(" = ")
    return rows.groupBy("dir").agg(F.bool_and(plain | re_export).alias("only")).where("only").select("dir")


def source_imports(ws: Workspace) -> DataFrame:
    """dir, path: what each facade re-exports from."""
    return facts.imports(ws).join(ws.files.select("file_path", "dir"), "file_path").join(detected(ws), "dir", "left_semi").select("dir", "path").distinct()


def exports(ws: Workspace, only: list[str] | None = None) -> DataFrame:
    """dir, name, word of what packages export, methods excluded; `only`: names that contain one of these, whatever
    their case."""
    rows = facts.symbols(ws).where("exported and kind <> 'Method' and not is_test")
    if only:
        match = F.lit(False)
        for x in only:
            match = match | F.lower("name").contains(x.lower())
        rows = rows.where(match)
    word = F.when(F.col("kind").isin("Function", "Variable"), "var").when(F.col("kind") == "Constant", "const").otherwise("type")
    return rows.select("dir", "name", word.alias("word")).distinct()


def _text(rows: DataFrame, package: str | None = None) -> DataFrame:
    """new_text per target of rows (target, facade, import_path, name, word, source): a whole file."""
    line = F.concat("word", F.lit(" "), "name", F.lit(" = "), "source", F.lit("."), "name")
    made = rows.groupBy("target", "facade").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("lines"), F.array_join(F.transform(F.array_sort(F.collect_set("import_path")), lambda x: F.concat(F.lit('import "'), x, F.lit('"'))), "\n").alias("imports"))
    return made.withColumn("new_text", F.concat(F.lit("package "), "facade", F.lit("\n\n"), "imports", F.lit("\n\n"), "lines", F.lit("\n")))


def generate_facades(ws: Workspace, modules_dir: str, target_dir: str, only: list[str] | None = None) -> DataFrame:
    """A facade below target_dir for each package at or below modules_dir that exports something: one new file each, in
    a folder of the package's name. A folder that has such a file already is left alone."""
    inside = (F.col("dir") == modules_dir) | F.col("dir").startswith(f"{modules_dir}/")
    source = ws.packages.where(inside).select("dir", F.col("name").alias("source"), "import_path")
    rows = exports(ws, only).join(source, "dir").withColumn("target", F.concat(F.lit(f"{target_dir}/"), "source", F.lit(f"/{FILE}"))).withColumn("facade", F.col("source"))
    rows = rows.join(ws.files.select(F.col("file_path").alias("target")), "target", "left_anti")
    text = _text(rows)
    if not text.limit(1).count():
        raise RefactorError(f"no package below {modules_dir} exports anything new")
    return changes(text.select(F.col("target").alias("file"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("old_text"), "new_text"), "generate facades")


def update_facades(ws: Workspace, folders: list[str] | None = None) -> DataFrame:
    """Facades (the given folders, or all that are found) written anew from what their sources export now. A facade of
    several files keeps its first one."""
    found = detected(ws)
    found = found.where(F.col("dir").isin(folders)) if folders is not None else found
    named = ws.packages.select(F.col("dir").alias("f_dir"), F.col("name").alias("facade"))
    files = ws.files.where(~F.col("is_test")).select("dir", "file_path", "basename", F.decode("content", "UTF-8").alias("old_text"), F.octet_length("content").alias("size"))
    first = files.join(found, "dir", "left_semi").groupBy(F.col("dir").alias("f_dir")).agg(F.min_by("file_path", "basename").alias("target"))
    source = ws.packages.select("dir", F.col("name").alias("source"), "import_path")
    use = source_imports(ws).select(F.col("dir").alias("f_dir"), F.col("path").alias("import_path"))
    rows = use.join(source, "import_path").join(exports(ws), "dir").join(first, "f_dir").join(named, "f_dir")
    text = _text(rows).select("target", "new_text")
    # The first file gets the new text, the others of the facade go.
    old = files.join(found, "dir", "left_semi").join(first.select("f_dir").withColumnRenamed("f_dir", "dir"), "dir", "left_semi")
    own = rows.select("f_dir").distinct().withColumnRenamed("f_dir", "dir")
    plan = old.join(own, "dir", "left_semi").join(text.withColumnRenamed("target", "file_path"), "file_path", "left")
    plan = plan.select("file_path", F.lit(0).alias("start"), F.col("size").alias("end"), "old_text", F.coalesce("new_text", F.lit("")).alias("new_text")).where("old_text <> new_text")
    return changes(plan, "update facades")
