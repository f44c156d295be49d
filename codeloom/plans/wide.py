"""Refactorings over whole trees: aliases, signatures, interfaces' methods, several packages; plans as files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.golang import facts
from codeloom.operators import imports as imports_of
from codeloom.plans.apply import CHANGE, changes
from codeloom.plans.refactor import RefactorError, _identifier, move_package
from codeloom.sources.workspace import Workspace

PLAN_VERSION = "1.0"
ALIAS_CHARS = 3


def _uses_of_alias(ws: Workspace, renamed: DataFrame) -> DataFrame:
    """Edits of selectors' left sides; renamed: (file_path, alias, new_alias)."""
    sel = ws.nodes.where("kind = 'SelectorExpr'").select("file_path", F.col("node_id").alias("parent_id"))
    left = ws.nodes.where("edge = 'x' and kind = 'Ident'").join(sel, ["file_path", "parent_id"], "left_semi").select("file_path", F.col("text").alias("alias"), "start", "end")
    return left.join(renamed, ["file_path", "alias"]).select("file_path", "start", "end", F.col("alias").alias("old_text"), F.col("new_alias").alias("new_text"))


def _specs(ws: Workspace, rows: DataFrame) -> DataFrame:
    """Edits of import specifications; rows: imports with new_alias (null: none)."""
    text = F.concat(F.when(F.col("new_alias").isNotNull(), F.concat("new_alias", F.lit(" "))).otherwise(F.lit("")), F.lit('"'), "path", F.lit('"'))
    return facts.source_text(ws.files, rows, "start", "end", "old_text").select("file_path", "start", "end", "old_text", text.alias("new_text"))


def resolve_alias_conflicts(ws: Workspace) -> DataFrame:
    """Where a file imports several paths under one name, all but the first get the name and a number. Which of them
    a use means can't be told without types, so uses keep the first."""
    rows = facts.imports(ws).where("coalesce(given, '') not in ('_', '.')")
    clash = imports_of.alias_conflicts(rows.withColumnRenamed("file_path", "file")).select(F.col("file").alias("file_path"), "alias")
    place = F.row_number().over(Window.partitionBy("file_path", "alias").orderBy("ord"))
    later = rows.join(clash, ["file_path", "alias"], "left_semi").withColumn("n", place).where("n > 1")
    return changes(_specs(ws, later.withColumn("new_alias", F.concat("alias", F.col("n").cast("string")))), "part equal aliases")


def convert_aliases(ws: Workspace, explicit: bool) -> DataFrame:
    """explicit: give imports of other hosts without an alias the first letters of their last segment; else drop
    aliases. Uses follow; imports whose new name the file already has stay as they are."""
    rows = facts.imports(ws).where("coalesce(given, '') not in ('_', '.')")
    last = F.element_at(F.split("path", "/"), -1)
    if explicit:
        rows = rows.where("given is null").where(F.split("path", "/")[0].contains(".")).withColumn("new_name", F.lower(F.left(F.regexp_replace(last, r"[^\p{L}\p{Nd}]", ""), F.lit(ALIAS_CHARS))))
    else:
        rows = rows.where("given is not null").where(last.rlike(r"^[\p{L}_][\p{L}\p{Nd}_]*$")).withColumn("new_name", last)
    taken = facts.occurrences(ws).where("not is_selector").select("file_path", F.col("name").alias("new_name")).union(facts.imports(ws).select("file_path", F.col("alias").alias("new_name"))).distinct()
    same = F.count("*").over(Window.partitionBy("file_path", "new_name"))
    moved = rows.where("alias <> new_name and new_name rlike '^[^0-9]'").join(taken, ["file_path", "new_name"], "left_anti").withColumn("n", same).where("n = 1")
    kept = rows.where("alias = new_name and given is not null")
    alias = F.col("new_name") if explicit else F.lit(None).cast("string")
    specs = _specs(ws, moved.drop("n").unionByName(kept.select(*rows.columns)).withColumn("new_alias", alias))
    return changes(specs.unionByName(_uses_of_alias(ws, moved.select("file_path", "alias", F.col("new_name").alias("new_alias")))), "convert aliases")


def remove_parameter(ws: Workspace, package: str, name: str, param: str) -> DataFrame:
    """Drop a parameter that the function's body doesn't use, and its argument in every call."""
    own = ws.files.where(F.col("dir") == package).select("file_path")
    decl = facts.functions(ws).where((F.col("name") == name) & F.col("recv").isNull()).join(own, "file_path", "left_semi").first()
    if decl is None or param not in decl["params"]:
        raise RefactorError(f"{package} has no function {name} with a parameter {param}")
    nodes = ws.nodes.where((F.col("file_path") == decl["file_path"]) & (F.col("func_id") == decl["func_node"]))
    if nodes.where((F.col("kind") == "Ident") & (F.col("text") == param) & ~F.col("edge").isin("name", "sel", "key")).limit(1).count():
        raise RefactorError(f"{name} uses {param}")
    position = list(decl["params"]).index(param)
    everyone = facts.parameters(ws).where((F.col("file_path") == decl["file_path"]) & (F.col("func_node") == decl["func_node"])).orderBy("ord").collect()
    sig = nodes.where((F.col("kind") == "FuncType") & (F.col("parent_id") == decl["func_node"])).first()
    params = nodes.where((F.col("edge") == "params") & (F.col("parent_id") == sig["node_id"])).first()
    kept = ", ".join(f"{p['name']} {p['type_text']}" for p in everyone if p["name"] != param)
    content = bytes(ws.files.where(F.col("file_path") == decl["file_path"]).first()["content"])
    head = ws.nodes.sparkSession.createDataFrame([(decl["file_path"], params["start"], params["end"], content[params["start"] : params["end"]].decode(), f"({kept})")], "file_path string, start int, end int, old_text string, new_text string")
    calls = facts.references(ws).where((F.col("dir") == package) & (F.col("name") == name) & (F.col("kind") == "Function")).select("file_path", F.col("end").alias("fun_end"))
    fun = ws.nodes.where("edge = 'fun'").select("file_path", F.col("parent_id").alias("node_id"), F.col("end").alias("fun_end"))
    args = ws.nodes.where("edge = 'arg'").groupBy("file_path", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("a"))
    rows = calls.join(fun, ["file_path", "fun_end"]).join(args, ["file_path", "node_id"]).where(F.size("a") > position)
    at, after, before = F.get("a", F.lit(position)), F.get("a", F.lit(position + 1)), F.get("a", F.lit(position - 1)) if position else None
    start = F.when(after.isNotNull(), at["start"]).otherwise(before["end"] if position else at["start"])
    rows = rows.select("file_path", start.alias("start"), F.coalesce(after["start"], at["end"]).alias("end"))
    rows = facts.source_text(ws.files, rows, "start", "end", "old_text").withColumn("new_text", F.lit(""))
    return changes(head.unionByName(rows.select(*head.columns)), f"drop {param} of {name}")


def rename_interface_method(ws: Workspace, old: str, new: str) -> DataFrame:
    """Rename a method on every interface and type that has it, and in every call of it."""
    _identifier(new)
    sym = facts.symbols(ws).where((F.col("kind") == "Method") & (F.col("name") == old))
    inter = facts.symbols(ws).where("kind = 'Interface'").select("dir", F.col("name").alias("recv"))
    if not sym.join(inter, ["dir", "recv"], "left_semi").limit(1).count():
        raise RefactorError(f"no interface has {old}")
    size = len(old.encode())
    declared = sym.select("file_path", F.col("pos").alias("start"), (F.col("pos") + size).alias("end"))
    used = facts.references(ws).where((F.col("kind") == "Method") & (F.col("name") == old)).select("file_path", F.col("pos").alias("start"), "end")
    rows = declared.union(used).distinct().withColumn("old_text", F.lit(old)).withColumn("new_text", F.lit(new))
    return changes(rows, f"rename method {old} to {new}")


def move_packages(ws: Workspace, moves: dict[str, str]) -> DataFrame:
    """Move several packages at once. Imports in files that move themselves are edited where those files go."""
    if len(set(moves.values())) != len(moves):
        raise RefactorError("two packages would move to one folder")
    plans = [move_package(ws, a, b) for a, b in sorted(moves.items())]
    out = reduce(DataFrame.unionByName, plans)
    for a, b in moves.items():
        # A moved file is written anew as a whole: edits of its old text must go into the new one.
        inner = out.where(F.col("file").startswith(f"{a}/") & (F.regexp_extract("file", r"^(.*)/[^/]*$", 1) == a) & (F.col("new_text") != "") & (F.col("start") > 0))
        if inner.limit(1).count():
            raise RefactorError(f"files of {a} import packages that move too; move these one after another")
    return out


def move_dir(ws: Workspace, folder: str, target: str) -> DataFrame:
    """Move all packages at or below a folder."""
    inside = [r["dir"] for r in ws.packages.where((F.col("dir") == folder) | F.col("dir").startswith(f"{folder}/")).select("dir").collect()]
    if not inside:
        raise RefactorError(f"no package below {folder}")
    return move_packages(ws, {d: target + d.removeprefix(folder) for d in inside})


def write_plan(plan: DataFrame, folder: str) -> None:
    """A plan as JSON lines, with the version of their format."""
    plan.select(F.lit(PLAN_VERSION).alias("version"), "file", "start", "end", "old_text", "new_text", "description").write.json(folder)


def read_plan(spark: SparkSession, folder: str) -> DataFrame:
    """A plan that write_plan() wrote; lines of another version are an error."""
    rows = spark.read.schema(f"version string, {CHANGE}").json(folder)
    wrong = rows.where(~F.col("version").eqNullSafe(PLAN_VERSION)).first()
    if wrong is not None:
        raise RefactorError(f"plan of version {wrong['version']}")
    return rows.drop("version")


def layer_report(breaks: DataFrame) -> DataFrame:
    """One Markdown text (column report) of imports against the layers (src, dst, src_tier, dst_tier), in order."""
    line = F.format_string("- `%s` (tier %d) imports `%s` (tier %d)", "src", "src_tier", "dst", "dst_tier")
    lines = F.array_join(F.array_sort(F.collect_list(line)), "\n")
    return breaks.agg(F.concat(F.lit("# Imports against the layers\n\n"), F.when(F.count("*") > 0, lines).otherwise(F.lit("none")), F.lit("\n")).alias("report"))
