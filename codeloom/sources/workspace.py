"""A source tree as tables: files, their syntax nodes, packages and modules."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.sources.tables import cut

NODES = "file_path string, node_id int, parent_id int, edge string, ord int, kind string, tok string, start int, end int, line int, col int, end_line int, func_id int, cx_depth int, cond_id int, text string, error string"
_COLUMNS = ["node_id", "parent_id", "edge", "ord", "kind", "tok", "start", "end", "line", "col", "end_line", "func_id", "cx_depth", "cond_id", "text"]


@dataclass
class Workspace:
    """The tables of one loaded tree."""

    root: str
    modules: DataFrame
    packages: DataFrame
    files: DataFrame
    nodes: DataFrame
    errors: DataFrame
    #: Tables derived from these, each written once, by name.
    derived: dict[tuple, DataFrame] = field(default_factory=dict)

    def once(self, name: tuple, make: Callable[[], DataFrame]) -> DataFrame:
        """A derived table, made and written at its first use: whatever asks for it later reads it."""
        if name not in self.derived:
            self.derived[name] = cut(make(), name[0])
        return self.derived[name]


def described(rows: DataFrame) -> DataFrame:
    """file_path (below the root), dir, basename, is_test, content of rows (file_path, content)."""
    folder = F.regexp_extract("file_path", r"^(.*)/[^/]*$", 1)
    return rows.select("file_path", F.when(folder == "", ".").otherwise(folder).alias("dir"), F.regexp_extract("file_path", r"([^/]*)$", 1).alias("basename"), F.col("file_path").endswith("_test.go").alias("is_test"), "content")


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    at = F.regexp_replace("path", r"^\w+:/*(?=/)", "")
    return raw.select(F.substring(at, len(root.rstrip("/")) + 2, 1_000_000).alias("file_path"), "content").where(~F.col("file_path").rlike(HIDDEN))


#: Hidden and vendored folders, which are left out.
HIDDEN = r"(^|/)(\.[^/]*|vendor)/"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """file_path (below the root), dir, basename, is_test, content of all Go files."""
    return described(_read(spark, root, "*.go"))


def parse(files: DataFrame) -> DataFrame:
    """Syntax nodes of all files; a file that can't be parsed is one row with its error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from codeloom.golang.lexer import SyntaxProblem
        from codeloom.golang.parser import rows

        for part in parts:
            for path, content in zip(part["file_path"], part["content"]):
                try:
                    out = pd.DataFrame(rows(bytes(content)), columns=_COLUMNS).assign(error=None)
                except SyntaxProblem as e:
                    out = pd.DataFrame([[None] * len(_COLUMNS)], columns=_COLUMNS).assign(error=str(e))
                out = out.astype({c: "Int32" for c in ("node_id", "parent_id", "ord", "start", "end", "line", "col", "end_line", "func_id", "cx_depth", "cond_id")})
                yield out.assign(file_path=path)[["file_path", *_COLUMNS, "error"]]

    return files.select("file_path", "content").mapInPandas(run, NODES)


def modules(spark: SparkSession, root: str) -> DataFrame:
    """dir, module_path of each go.mod: its first line that begins with `module`."""
    return modules_of(_read(spark, root, "go.mod"))


def modules_of(mods: DataFrame) -> DataFrame:
    """dir, module_path of rows (file_path, content) of go.mod files."""
    path = F.regexp_extract(F.decode("content", "UTF-8"), r"(?m)^module[ \t]+(\S+)", 1)
    return described(mods).select("dir", path.alias("module_path"))


def used_folders(text: str) -> list[str]:
    """Folders that a go.work file uses, one by one or in a block; comments and blank lines don't count."""
    plain = "\n".join(line.partition("//")[0].strip() for line in text.split("\n"))
    blocks = re.findall(r"^use\s*\(([^)]*)\)", plain, re.M)
    single = re.findall(r"^use[ \t]+([^\s(]+)$", plain, re.M)
    found = [x for b in blocks for x in b.split()] + single
    return [posixpath.normpath(x.strip('"`')) for x in found]


def work_modules(spark: SparkSession, root: str) -> DataFrame:
    """dir (below the folder of go.work), module_path of the modules that the nearest go.work at or above the root uses;
    folders without a go.mod are left out. Without a go.work no rows."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(root)
    system = at.getFileSystem(conf)
    at = system.makeQualified(at)
    while at is not None and not system.exists(jvm.org.apache.hadoop.fs.Path(at, "go.work")):
        at = at.getParent()
    if at is None:
        return spark.createDataFrame([], "dir string, module_path string")
    folder = at.toString()
    text = spark.read.text(f"{folder}/go.work", wholetext=True).first()[0]
    used = spark.createDataFrame([(d,) for d in dict.fromkeys(used_folders(text))], "dir string")
    return modules(spark, at.toUri().getPath()).join(F.broadcast(used), "dir", "left_semi")


def packages(files: DataFrame, nodes: DataFrame, mods: DataFrame) -> DataFrame:
    """dir, name (of the first file that is no test), import_path: below the nearest module at or above the folder; the
    folder itself where there is none."""
    top = nodes.where("kind = 'Ident' and edge = 'name'").join(nodes.where("kind = 'File'").select("file_path", F.col("node_id").alias("parent_id")), ["file_path", "parent_id"])
    named = files.where(~F.col("is_test")).join(top.select("file_path", F.col("text").alias("name")), "file_path")
    out = named.groupBy("dir").agg(F.min_by("name", "basename").alias("name"))
    # Every folder with those above it, so that modules are found by an equality.
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))
    each = out.select("dir", F.explode(F.array_distinct(F.concat(F.array(F.lit(".")), above))).alias("up"))
    held = each.join(mods.select(F.col("dir").alias("up"), "module_path"), "up").groupBy("dir").agg(F.max_by(F.struct("up", "module_path"), F.when(F.col("up") == ".", 0).otherwise(F.length("up"))).alias("m"))
    rows = out.join(held, "dir", "left")
    rest = F.when(F.col("m.up") == ".", F.concat(F.lit("/"), "dir")).otherwise(F.expr("substring(dir, length(m.up) + 1)"))
    path = F.when(F.col("m").isNull(), F.when(F.col("dir") == ".", "").otherwise(F.col("dir"))).when(F.col("dir") == F.col("m.up"), F.col("m.module_path")).otherwise(F.concat("m.module_path", rest))
    return rows.select("dir", "name", path.alias("import_path"))


def _assembled(root: str, mods: DataFrame, files: DataFrame, nodes: DataFrame) -> Workspace:
    good = nodes.where("error is null")
    return Workspace(root, mods, cut(packages(files, good, mods), "packages"), files, good, nodes.where("error is not null").select("file_path", "error"))


def load(spark: SparkSession, root: str) -> Workspace:
    """Read, parse and cut a tree; parse errors don't stop it."""
    files = cut(scan(spark, root), "files")
    return _assembled(root, cut(modules(spark, root), "modules"), files, cut(parse(files), "nodes"))


def from_contents(spark: SparkSession, contents: dict[str, str]) -> Workspace:
    """A workspace of files given by path, go.mod files among them, as load() would read them from a folder."""
    rows = spark.createDataFrame([(p, c.encode()) for p, c in sorted(contents.items())], "file_path string, content binary").where(~F.col("file_path").rlike(HIDDEN))
    files = cut(described(rows.where(F.col("file_path").endswith(".go"))), "files")
    return _assembled("", modules_of(rows.where(F.col("file_path").rlike("(^|/)go\\.mod$"))), files, cut(parse(files), "nodes"))


def refreshed(ws: Workspace, changed: DataFrame) -> Workspace:
    """The workspace after rows (file_path, content; null: the file is gone). Only these files are parsed again; nodes of
    all others stay, and files that aren't Go source take no part."""
    rows = changed.where(F.col("file_path").endswith(".go") & ~F.col("file_path").rlike(HIDDEN))
    rows = cut(rows.select("file_path", "content"), "changed")
    new = described(rows.where("content is not null"))
    files = cut(ws.files.join(rows, "file_path", "left_anti").unionByName(new), "files")
    bad = ws.errors.select("file_path", *(F.lit(None).cast(ws.nodes.schema[c].dataType).alias(c) for c in _COLUMNS), "error")
    held = ws.nodes.unionByName(bad).join(rows, "file_path", "left_anti")
    return _assembled(ws.root, ws.modules, files, cut(held.unionByName(parse(new)), "nodes"))


def resolve_package(ws: Workspace, name: str) -> str:
    """The folder that a name for a package means: a folder or import path as it stands, a path below the root, or the
    name of a single package; else the name as given."""
    root = ws.root.rstrip("/")
    inner = posixpath.normpath(name.removeprefix(root).lstrip("/") or ".") if root and name.startswith(root) else posixpath.normpath(name)
    ranked = F.when(F.col("dir") == inner, 0).when(F.col("import_path") == name, 1).when(F.col("name") == name, 2)
    found = ws.packages.select("dir", ranked.alias("rank")).where("rank is not null").orderBy("rank", "dir").limit(2).collect()
    if not found or found[0].rank == 2 and len(found) > 1:
        return name
    return found[0].dir


def resolve_file(ws: Workspace, path: str) -> str:
    """A file's path below the root, of a path that is relative to the root or absolute."""
    root = ws.root.rstrip("/")
    return posixpath.normpath(path.removeprefix(root + "/") if root and path.startswith(root + "/") else path)


def numbered_lines(ws: Workspace, path: str, first: int, last: int) -> DataFrame:
    """line, text (`n: text`) of the lines first to last of a file."""
    rows = ws.files.where(F.col("file_path") == path).select(F.posexplode(F.split(F.decode("content", "UTF-8"), "\n")).alias("at", "t"))
    line = F.col("at") + 1
    return rows.where(line.between(first, last)).select(line.alias("line"), F.format_string("%d: %s", line, F.col("t")).alias("text")).orderBy("line")


def status(ws: Workspace) -> DataFrame:
    """One row per package: package, name, import_path, files, test_files, errors, in the packages' order."""
    count = ws.files.groupBy("dir").agg(F.count_if(~F.col("is_test")).alias("files"), F.count_if("is_test").alias("test_files"))
    bad = described(ws.errors.withColumn("content", F.lit(None).cast("binary"))).groupBy("dir").agg(F.count("*").alias("errors"))
    rows = ws.packages.join(count, "dir").join(bad, "dir", "left")
    return rows.select(F.col("dir").alias("package"), "name", "import_path", "files", "test_files", F.coalesce("errors", F.lit(0)).alias("errors")).orderBy("package")
