"""Refactorings as plans: each reads a workspace and returns a change set."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.golang import analyze, facts
from codeloom.golang.lexer import KEYWORDS
from codeloom.golang.scope import around
from codeloom.operators import imports as imports_of
from codeloom.plans.apply import changes
from codeloom.sources.workspace import Workspace


class RefactorError(ValueError):
    """The refactoring can't be done as asked."""


def _identifier(name: str) -> str:
    if not re.fullmatch(r"[^\W\d]\w*", name) or name in KEYWORDS:
        raise RefactorError(f"{name!r} is no identifier")
    return name


def _symbol(ws: Workspace, package: str, name: str, recv: str | None = None) -> DataFrame:
    found = facts.symbols(ws).where((F.col("dir") == package) & (F.col("name") == name))
    return found.where(F.col("recv") == recv if recv else F.col("kind") != "Method")


def rename_symbol(ws: Workspace, package: str, old: str, new: str, recv: str | None = None) -> DataFrame:
    """Rename a symbol of a package (a folder) where it is declared and where it is used. A method (recv given) is
    renamed on that type and at every call of a method of its name."""
    _identifier(new)
    found = _symbol(ws, package, old, recv)
    if not found.limit(1).count():
        raise RefactorError(f"{package} has no {old}")
    if _symbol(ws, package, new, recv).limit(1).count():
        raise RefactorError(f"{package} already has {new}")
    size = len(old.encode())
    declared = found.select("file_path", F.col("pos").alias("start"), (F.col("pos") + size).alias("end"))
    used = facts.references(ws).where((F.col("dir") == package) & (F.col("name") == old) & (F.col("recv") == recv if recv else F.col("kind") != "Method")).select("file_path", F.col("pos").alias("start"), "end")
    rows = declared.union(used).distinct().withColumn("old_text", F.lit(old)).withColumn("new_text", F.lit(new))
    return changes(rows, f"rename {old} to {new}")


def rename_package(ws: Workspace, package: str, new: str) -> DataFrame:
    """Rename a package in its clauses and where other files select from it under its own name. Its path stays."""
    _identifier(new)
    named = ws.packages.where(F.col("dir") == package).first()
    if named is None:
        raise RefactorError(f"no package {package}")
    size = len(named["name"].encode())
    top = ws.nodes.where("kind = 'Ident' and edge = 'name'").join(ws.nodes.where("kind = 'File'").select("file_path", F.col("node_id").alias("parent_id")), ["file_path", "parent_id"], "left_semi")
    clause = top.where(F.col("text") == named["name"]).join(ws.files.where(F.col("dir") == package).select("file_path"), "file_path", "left_semi").select("file_path", "start")
    importing = facts.imports(ws).where((F.col("path") == named["import_path"]) & F.col("given").isNull()).select("file_path")
    uses = ws.nodes.where((F.col("edge") == "x") & (F.col("kind") == "Ident") & (F.col("text") == named["name"])).join(ws.nodes.where("kind = 'SelectorExpr'").select("file_path", F.col("node_id").alias("parent_id")), ["file_path", "parent_id"], "left_semi")
    rows = clause.union(uses.join(importing, "file_path", "left_semi").select("file_path", "start")).distinct()
    return changes(rows.withColumn("end", F.col("start") + size).withColumn("old_text", F.lit(named["name"])).withColumn("new_text", F.lit(new)), f"rename package {named['name']} to {new}")


def move_package(ws: Workspace, package: str, target: str) -> DataFrame:
    """Move a package's files to another folder and import it by its new path. Old files end up empty."""
    named = ws.packages.where(F.col("dir") == package).first()
    if named is None or package == ".":
        raise RefactorError(f"no package {package}")
    path = named["import_path"].removesuffix(package) + target
    text = F.decode("content", "UTF-8")
    own = ws.files.where(F.col("dir") == package)
    gone = own.select("file_path", F.lit(0).alias("start"), F.octet_length("content").alias("end"), text.alias("old_text"), F.lit("").alias("new_text"))
    made = own.select(F.concat(F.lit(f"{target}/"), "basename").alias("file_path"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("old_text"), text.alias("new_text"))
    spec = ws.nodes.where((F.col("edge") == "path") & (F.regexp_replace("text", "[\"`]", "") == named["import_path"])).select("file_path", "start", "end", F.col("text").alias("old_text"), F.lit(f'"{path}"').alias("new_text"))
    return changes(gone.unionByName(made).unionByName(spec), f"move {package} to {target}")


def move_symbol(ws: Workspace, package: str, name: str, target_file: str) -> DataFrame:
    """Move a function or type to a file of the same package."""
    decl = _declaration(ws, package, name).first()
    if decl is None:
        raise RefactorError(f"{package} has no {name}")
    to = ws.files.where(F.col("file_path") == target_file).first()
    if to is None or to["dir"] != package:
        raise RefactorError(f"{target_file} is no file of {package}")
    size = len(bytes(to["content"]))
    rows = [(decl["file_path"], decl["start"], decl["end"], decl["old_text"], ""), (target_file, size, size, "", "\n" + decl["old_text"] + "\n")]
    return changes(ws.nodes.sparkSession.createDataFrame(rows, "file string, start int, end int, old_text string, new_text string"), f"move {name} to {target_file}")


def _declaration(ws: Workspace, package: str, name: str) -> DataFrame:
    """file_path, start, end and text of the whole declaration of a package-level symbol that has one to itself."""
    own = ws.files.where(F.col("dir") == package).select("file_path")
    funcs = facts.functions(ws).where((F.col("name") == name) & F.col("recv").isNull()).select("file_path", "start", "end")
    spec = ws.nodes.where((F.col("edge") == "name") & (F.col("text") == name)).join(ws.nodes.where("edge = 'spec'").select("file_path", F.col("node_id").alias("parent_id"), F.col("parent_id").alias("decl_id")), ["file_path", "parent_id"])
    alone = ws.nodes.where("edge = 'spec'").groupBy("file_path", F.col("parent_id").alias("decl_id")).agg(F.count("*").alias("n")).where("n = 1")
    decl = ws.nodes.where("kind = 'GenDecl' and edge = 'decl' and func_id is null").select("file_path", F.col("node_id").alias("decl_id"), F.col("start").alias("s"), F.col("end").alias("e"))
    specs = spec.join(alone, ["file_path", "decl_id"]).join(decl, ["file_path", "decl_id"]).select("file_path", F.col("s").alias("start"), F.col("e").alias("end"))
    rows = funcs.union(specs).join(own, "file_path", "left_semi")
    return facts.source_text(ws.files, rows, "start", "end", "old_text")


def add_imports(ws: Workspace, wanted: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """Edits that import a path in each file (file_path, path) that doesn't yet: into its first block of imports, after
    its first single one, or after the package clause. Imports that go (dropped: file_path, start, end of their
    specifications) are no place to put others."""
    missing = wanted.distinct().join(facts.imports(ws).select("file_path", "path"), ["file_path", "path"], "left_anti")
    paths = missing.groupBy("file_path").agg(F.array_sort(F.collect_set("path")).alias("p"))
    decl = ws.nodes.where("kind = 'GenDecl' and tok = 'import'").select("file_path", "node_id", "start", "end")
    if dropped is not None:
        spec = ws.nodes.where("kind = 'ImportSpec'").select("file_path", F.col("parent_id").alias("node_id"), "start", "end")
        gone = spec.join(dropped.withColumn("gone", F.lit(True)), ["file_path", "start", "end"], "left").groupBy("file_path", "node_id").agg(F.count("*").alias("n"), F.count("gone").alias("k"))
        decl = decl.join(gone.where("n = 1 and k = 1"), ["file_path", "node_id"], "left_anti")
    decl = decl.groupBy("file_path").agg(F.min_by(F.struct("start", "end"), "start").alias("d"))
    top = ws.nodes.where("kind = 'File'").select("file_path", F.col("node_id").alias("parent_id"))
    clause = ws.nodes.where("edge = 'name'").join(top, ["file_path", "parent_id"]).select("file_path", F.col("end").alias("clause_end"))
    rows = paths.join(clause, "file_path").join(decl, "file_path", "left")
    rows = facts.source_text(ws.files, rows.withColumn("a", F.coalesce("d.start", F.lit(0))).withColumn("b", F.coalesce("d.end", F.lit(0))), "a", "b", "block")
    lines = F.array_join(F.transform("p", lambda x: F.concat(F.lit('\n\t"'), x, F.lit('"'))), "")
    single = F.array_join(F.transform("p", lambda x: F.concat(F.lit('\nimport "'), x, F.lit('"'))), "")
    grouped = F.col("block").contains("(")
    at = F.when(F.col("d").isNull(), F.col("clause_end")).when(grouped, F.col("a") + F.locate("(", F.col("block"))).otherwise(F.col("b"))
    new = F.when(F.col("d").isNull(), F.concat(F.lit("\n"), single)).when(grouped, lines).otherwise(single)
    return rows.select("file_path", at.alias("start"), at.alias("end"), F.lit("").alias("old_text"), new.alias("new_text"))


def with_margins(ws: Workspace, decl: DataFrame) -> DataFrame:
    """Declarations (file_path, start, end) with the comments right before them and one blank line behind them:
    file_path, start, end (of the declaration), stop, text (up to the end), old_text (up to stop)."""
    rows = decl.select("file_path", "start", "end").distinct().join(ws.files.select("file_path", "content"), "file_path")
    before = F.decode(F.expr("substring(content, 1, start)"), "ISO-8859-1")
    lead = F.octet_length(F.regexp_extract(before, r"((?:(?<=\n)|^)(?:[ \t]*//[^\n]*\n)+)$", 1))
    rows = rows.withColumn("start", F.col("start") - lead)
    after = F.octet_length(F.regexp_extract(F.decode(F.expr("substring(content, end + 1)"), "ISO-8859-1"), r"^([ \t]*\n?\n?)", 1))
    rows = rows.withColumn("stop", F.col("end") + after)
    text = lambda a, b: F.decode(F.expr(f"substring(content, {a} + 1, {b} - {a})"), "UTF-8")
    return rows.select("file_path", "start", "end", "stop", text("start", "end").alias("text"), text("start", "stop").alias("old_text"))


def safe_delete(ws: Workspace, package: str, name: str, force: bool = False) -> DataFrame:
    """Delete a declaration that nothing refers to. `force` deletes it all the same, with the statements that refer to
    it; a reference outside statements, in another declaration, stands in the way."""
    decl = _declaration(ws, package, name)
    if not decl.limit(1).count():
        raise RefactorError(f"{package} has no {name} with a declaration of its own")
    own = with_margins(ws, decl)
    gone = own.select("file_path", "start", F.col("stop").alias("end"), "old_text", F.lit("").alias("new_text"))
    used = facts.references(ws).where((F.col("dir") == package) & (F.col("name") == name) & (F.col("kind") != "Method"))
    # Uses inside the declaration itself go with it.
    inside = used.join(own.select("file_path", F.col("start").alias("a"), F.col("stop").alias("b")), "file_path").where("a <= pos and pos < b").select("file_path", "pos")
    used = used.join(inside, ["file_path", "pos"], "left_anti")
    n = used.count()
    if n and not force:
        raise RefactorError(f"{name} has {n} references")
    if n:
        spans = ws.nodes.where("edge = 'stmt' and kind not in ('BlockStmt', 'CaseClause', 'CommClause')").select("file_path", "start", "end")
        met = around(used.select("file_path", "pos"), spans)
        narrow = met.groupBy("file_path", "pos").agg(F.min_by(F.struct("start", "end"), F.col("end") - F.col("start")).alias("s"))
        if narrow.count() < used.select("file_path", "pos").distinct().count():
            raise RefactorError(f"{name} is used outside statements")
        whole = narrow.select("file_path", "s.start", "s.end").distinct()
        outer = whole.select("file_path", F.col("start").alias("a"), F.col("end").alias("b"))
        whole = whole.join(whole.join(outer, "file_path").where("a <= start and end <= b and (a < start or end < b)").select("file_path", "start", "end"), ["file_path", "start", "end"], "left_anti")
        gone = gone.unionByName(facts.source_text(ws.files, whole, "start", "end", "old_text").withColumn("new_text", F.lit("")).select(*gone.columns))
    return changes(gone, f"delete {name}")


def add_context_parameter(ws: Workspace, package: str, name: str) -> DataFrame:
    """Give a function a first parameter `ctx context.Context`, its calls `context.TODO()`, and their files the import."""
    plan = add_parameter(ws, package, name, "ctx", "context.Context", "context.TODO()", 0)
    wanted = plan.select(F.col("file").alias("file_path"), F.lit("context").alias("path")).distinct()
    return plan.unionByName(changes(add_imports(ws, wanted), f"add ctx to {name}"))


def add_parameter(ws: Workspace, package: str, name: str, param: str, kind: str, default: str, position: int) -> DataFrame:
    """Add a parameter to a function at a position and its default value to every call."""
    _identifier(param)
    decl = facts.functions(ws).where((F.col("name") == name) & F.col("recv").isNull()).join(ws.files.where(F.col("dir") == package).select("file_path"), "file_path", "left_semi").select("file_path", F.col("func_node").alias("node_id"))
    if not decl.limit(1).count():
        raise RefactorError(f"{package} has no function {name}")
    sig = facts.children(decl, ws.nodes, "type", "t").select("file_path", F.col("t_node_id").alias("node_id"))
    lists = facts.children(sig, ws.nodes, "params", "l").select("file_path", F.col("l_node_id").alias("list_id"), (F.col("l_start") + 1).alias("open"))
    calls = facts.references(ws).where((F.col("dir") == package) & (F.col("name") == name) & (F.col("kind") == "Function")).select("file_path", F.col("end").alias("fun_end"))
    fun = ws.nodes.where("edge = 'fun'").select("file_path", F.col("parent_id").alias("list_id"), F.col("end").alias("fun_end"))
    args = calls.join(fun, ["file_path", "fun_end"]).select("file_path", "list_id", (F.col("fun_end") + 1).alias("open"))

    def inserted(owners: DataFrame, edge: str, text: str) -> DataFrame:
        items = ws.nodes.where(F.col("edge") == edge).select("file_path", F.col("parent_id").alias("list_id"), F.col("start").alias("at"), F.col("end").alias("till"))
        rows = owners.join(items.groupBy("file_path", "list_id").agg(F.array_sort(F.collect_list(F.struct("at", "till"))).alias("a")), ["file_path", "list_id"], "left")
        n = F.coalesce(F.size("a"), F.lit(0))
        n = F.when(n < 0, 0).otherwise(n)
        before = n > position
        place = F.when(before, F.get("a", F.lit(position))["at"]).when(n > 0, F.element_at("a", -1)["till"]).otherwise(F.col("open"))
        new = F.when(before, F.lit(f"{text}, ")).when(n > 0, F.lit(f", {text}")).otherwise(F.lit(text))
        return rows.select("file_path", place.alias("start"), place.alias("end"), F.lit("").alias("old_text"), new.alias("new_text"))

    return changes(inserted(lists, "field", f"{param} {kind}").unionByName(inserted(args, "arg", default)), f"add {param} to {name}")


def clean_aliases(ws: Workspace) -> DataFrame:
    """Drop import aliases that equal their path's last segment and that nothing else of the file competes for."""
    rows = facts.imports(ws).where("given is not null")
    last = F.element_at(F.split("path", "/"), -1)
    clash = facts.imports(ws).where("given is null").select("file_path", "alias").distinct()
    rows = rows.where(F.col("given") == last).join(clash, ["file_path", "alias"], "left_anti")
    return changes(facts.source_text(ws.files, rows, "start", "end", "old_text").withColumn("new_text", F.concat(F.lit('"'), "path", F.lit('"'))), "drop a redundant alias")


def standardise_imports(ws: Workspace, rules: list[tuple[str, str]]) -> DataFrame:
    """Give imports the alias of the first rule (pattern, alias) that their path contains, there and where it is used."""
    spark = ws.nodes.sparkSession
    table = spark.createDataFrame([(i, p, a) for i, (p, a) in enumerate(rules)], "rule int, pattern string, new_alias string")
    named = facts.imports(ws).withColumnRenamed("file_path", "file")
    met = imports_of.standardised(named, table).join(named.select("file", "ord", "alias", "start", "end"), ["file", "ord"]).where("alias <> new_alias").withColumnRenamed("file", "file_path")
    spec = facts.source_text(ws.files, met, "start", "end", "old_text").withColumn("new_text", F.concat("new_alias", F.lit(' "'), "path", F.lit('"'))).select("file_path", "start", "end", "old_text", "new_text")
    inner = ws.nodes.where("edge = 'x' and kind = 'Ident'").join(ws.nodes.where("kind = 'SelectorExpr'").select("file_path", F.col("node_id").alias("parent_id")), ["file_path", "parent_id"], "left_semi").select("file_path", F.col("text").alias("alias"), "start", "end")
    uses = inner.join(met.select("file_path", "alias", "new_alias"), ["file_path", "alias"]).select("file_path", "start", "end", F.col("alias").alias("old_text"), F.col("new_alias").alias("new_text"))
    return changes(spec.unionByName(uses), "standardise an import alias")


def organise_imports(ws: Workspace, prefixes: list[tuple[str, int]] | None = None) -> DataFrame:
    """Sort each file's single import block by tier, then path: C, the standard library, others, then the given prefixes."""
    rows = facts.imports(ws)
    outside = F.when(F.element_at(F.split("path", "/"), 1).contains("."), 1).otherwise(0)
    tier = F.when(F.col("path") == "C", -1).otherwise(F.greatest(outside, imports_of.tier(F.col("path"), prefixes or [], 0)))
    blocks = ws.nodes.where("kind = 'GenDecl' and tok = 'import'").select("file_path", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    only = blocks.withColumn("n", F.count("*").over(Window.partitionBy("file_path"))).where("n = 1").drop("n")
    line = F.concat(F.lit("\t"), F.when(F.col("given").isNotNull(), F.concat("given", F.lit(" "))).otherwise(""), F.lit('"'), "path", F.lit('"'))
    parts = rows.withColumn("tier", tier).groupBy("file_path", "tier").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", line.alias("line")))), lambda x: x["line"]), "\n").alias("part"))
    text = parts.groupBy("file_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tier", "part"))), lambda x: x["part"]), "\n\n").alias("body"))
    rows = facts.source_text(ws.files, only.join(text, "file_path").select("file_path", F.col("b_start").alias("start"), F.col("b_end").alias("end"), "body"), "start", "end", "old_text")
    new = F.concat(F.lit("import (\n"), "body", F.lit("\n)"))
    return changes(rows.where(F.col("old_text").startswith("import (")).withColumn("new_text", new).where("old_text <> new_text"), "organise imports")


def extract_constant(ws: Workspace, file: str, func: str, literal: str, name: str, scope: str = "function") -> DataFrame:
    """Put a literal that a function uses into a constant before the function. scope: equal literals of the `function`,
    of all functions of the `file` or of the `package` get the name."""
    _identifier(name)
    f = facts.functions(ws).where((F.col("file_path") == file) & (F.col("name") == func))
    head = f.first()
    if head is None:
        raise RefactorError(f"{file} has no {func}")
    folder = ws.files.where(F.col("file_path") == file).first()["dir"]
    own = ws.files.where(F.col("dir") == folder).select("file_path")
    if _symbol(ws, folder, name).limit(1).count():
        raise RefactorError(f"{folder} already has {name}")
    lits = ws.nodes.where((F.col("kind") == "BasicLit") & (F.col("text") == literal) & F.col("func_id").isNotNull() & (F.col("edge") != "tag"))
    here = (F.col("file_path") == file) & (F.col("func_id") == head["func_node"])
    if not lits.where(here).limit(1).count():
        raise RefactorError(f"{func} has no {literal}")
    scopes = {"function": lits.where(here), "file": lits.where(F.col("file_path") == file), "package": lits.join(own, "file_path", "left_semi")}
    if scope not in scopes:
        raise RefactorError(f"no scope {scope}")
    uses = scopes[scope].select("file_path", "start", "end", F.lit(literal).alias("old_text"), F.lit(name).alias("new_text"))
    made = ws.nodes.sparkSession.createDataFrame([(file, head["start"], head["start"], "", f"const {name} = {literal}\n\n")], "file_path string, start int, end int, old_text string, new_text string")
    return changes(uses.unionByName(made), f"extract {name}")


def extract_interface(ws: Workspace, package: str, type_name: str, name: str, target_file: str) -> DataFrame:
    """An interface of a type's exported methods, at the end of a file (or in a new one)."""
    _identifier(name)
    f = facts.functions(ws).where((F.col("recv") == type_name) & facts.exported(F.col("name"))).join(ws.files.where(F.col("dir") == package).select("file_path"), "file_path", "left_semi").select("file_path", F.col("func_node").alias("node_id"), "name")
    sig = facts.children(f, ws.nodes, "type", "t")
    methods = sorted((r["name"], r["s"]) for r in facts.source_text(ws.files, sig, "t_start", "t_end", "s").select("name", "s").collect())
    if not methods:
        raise RefactorError(f"{type_name} has no exported methods")
    to = ws.files.where(F.col("file_path") == target_file).first()
    clause = "" if to else f"package {ws.packages.where(F.col('dir') == package).first()['name']}\n"
    size = len(bytes(to["content"])) if to else 0
    text = f"{clause}\ntype {name} interface {{\n" + "".join(f"\t{m}{s}\n" for m, s in methods) + "}\n"
    return changes(ws.nodes.sparkSession.createDataFrame([(target_file, size, size, "", text)], "file string, start int, end int, old_text string, new_text string"), f"extract {name}")


def inline_variable(ws: Workspace, file: str, func: str, name: str) -> DataFrame:
    """Put a variable's value where the variable is used in its function, and drop its declaration."""
    head = facts.functions(ws).where((F.col("file_path") == file) & (F.col("name") == func)).first()
    if head is None:
        raise RefactorError(f"{file} has no {func}")
    nodes = ws.nodes.where((F.col("file_path") == file) & (F.col("func_id") == head["func_node"]))
    assign = nodes.where("kind = 'AssignStmt' and tok = ':='").select("file_path", "node_id", "start", "end")
    left = facts.children(assign, nodes.where((F.col("kind") == "Ident") & (F.col("text") == name)), "lhs", "l")
    whole = facts.children(left, nodes, "rhs", "r").collect()
    if len(whole) != 1 or nodes.where((F.col("parent_id") == whole[0]["node_id"]) & (F.col("edge") == "lhs")).count() != 1:
        raise RefactorError(f"{func} doesn't set {name} just once and alone")
    (a,) = whole
    content = bytes(ws.files.where(F.col("file_path") == file).first()["content"])
    value = content[a["r_start"] : a["r_end"]].decode()
    value = f"({value})" if a["r_kind"] == "BinaryExpr" else value
    uses = nodes.where((F.col("kind") == "Ident") & (F.col("text") == name) & ~F.col("edge").isin("sel", "label", "key") & (F.col("start") > a["end"])).select("file_path", "start", "end", F.lit(name).alias("old_text"), F.lit(value).alias("new_text"))
    stop = content.find(b"\n", a["end"])
    begin = content.rfind(b"\n", 0, a["start"]) + 1
    line = (begin, stop + 1) if stop >= 0 and not content[begin : a["start"]].strip() and not content[a["end"] : stop].strip() else (a["start"], a["end"])
    gone = ws.nodes.sparkSession.createDataFrame([(file, line[0], line[1], content[line[0] : line[1]].decode(), "")], "file_path string, start int, end int, old_text string, new_text string")
    return changes(uses.unionByName(gone), f"inline {name}")


def create_facade(ws: Workspace, package: str, target_file: str, facade_package: str) -> DataFrame:
    """A new file that re-exports what a package exports: functions and variables as var, constants as const, types as
    aliases."""
    named = ws.packages.where(F.col("dir") == package).first()
    if named is None:
        raise RefactorError(f"no package {package}")
    rows = facts.symbols(ws).where((F.col("dir") == package) & F.col("exported") & (F.col("kind") != "Method") & ~F.col("is_test"))
    word = F.when(F.col("kind").isin("Function", "Variable"), "var").when(F.col("kind") == "Constant", "const").otherwise("type")
    lines = F.array_join(F.array_sort(F.collect_list(F.concat(word, F.lit(" "), "name", F.lit(f" = {named['name']}."), "name"))), "\n")
    head = f'package {facade_package}\n\nimport "{named["import_path"]}"\n\n'
    text = rows.agg(F.concat(F.lit(head), lines, F.lit("\n")).alias("new_text"), F.count("*").alias("n")).where("n > 0")
    return changes(text.select(F.lit(target_file).alias("file"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("old_text"), "new_text"), f"re-export {package}")


def fix_if_init(ws: Workspace) -> DataFrame:
    return changes(analyze.if_init(ws), "declare before the if")


def fix_error_wrapping(ws: Workspace, severity: str = "critical") -> DataFrame:
    rows = analyze.error_wrapping(ws, severity).withColumnRenamed("current_code", "old_text")
    return changes(rows.where("old_text <> new_text"), "wrap the error")


OPERATIONS = {f.__name__: f for f in (rename_symbol, rename_package, move_package, move_symbol, safe_delete, add_context_parameter, add_parameter, clean_aliases, standardise_imports, organise_imports, extract_constant, extract_interface, inline_variable, create_facade, fix_if_init, fix_error_wrapping)}


def batch(ws: Workspace, steps: list[tuple[str, dict]], operations: dict[str, Callable[..., DataFrame]] = OPERATIONS) -> DataFrame:
    """The changes of several operations against one state of the workspace, with the step that each comes from."""
    out = None
    for i, (name, arguments) in enumerate(steps):
        if name not in operations:
            raise RefactorError(f"no operation {name}")
        plan = operations[name](ws, **arguments).withColumn("step", F.lit(i))
        out = plan if out is None else out.unionByName(plan)
    if out is None:
        raise RefactorError("no steps")
    return out
