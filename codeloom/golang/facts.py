"""Facts as queries over syntax nodes: imports, functions, symbols, occurrences, references."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.sources.workspace import Workspace

KIND_ORDER = ("Function", "Type", "Interface", "Variable", "Constant", "Method")
# Methods that well-known interfaces of the standard library ask for.
BUILTIN_METHODS = tuple("String Error Read Write Close Len Less Swap MarshalJSON UnmarshalJSON MarshalBinary UnmarshalBinary ServeHTTP RoundTrip".split())


def derived(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A fact that a workspace works out once for each choice of arguments."""

    @wraps(f)
    def run(ws: Workspace, *args) -> DataFrame:
        return ws.once((f.__name__, *args), lambda: f(ws, *args))

    return run


def renamed(nodes: DataFrame, prefix: str, *columns: str) -> DataFrame:
    """The given columns of nodes under a prefix, with the file."""
    return nodes.select("file_path", *[F.col(c).alias(f"{prefix}_{c}") for c in columns])


def children(parents: DataFrame, nodes: DataFrame, edge: str, prefix: str, how: str = "inner") -> DataFrame:
    """parents (with node_id) joined to their children on an edge; the child's columns get the prefix."""
    kid = renamed(nodes.where(F.col("edge") == edge), prefix, "parent_id", "node_id", "kind", "tok", "start", "end", "line", "col", "text", "ord")
    return parents.join(kid.withColumnRenamed(f"{prefix}_parent_id", "node_id"), ["file_path", "node_id"], how)


def source_text(files: DataFrame, rows: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """rows with the source between two byte offsets."""
    text = F.decode(F.substring("content", F.col(start) + 1, F.col(end) - F.col(start)), "UTF-8")
    return rows.join(files.select("file_path", "content"), "file_path").withColumn(name, text).drop("content")


def exported(name: Column) -> Column:
    return name.rlike(r"^\p{Lu}")


@derived
def imports(ws: Workspace) -> DataFrame:
    """file_path, ord, path, given (alias or null), alias (as used), start, end."""
    specs = ws.nodes.where("kind = 'ImportSpec'").select("file_path", "node_id", "start", "end")
    rows = children(specs, ws.nodes, "path", "p")
    alias = ws.nodes.where("edge = 'alias'").select("file_path", F.col("parent_id").alias("node_id"), F.col("text").alias("given"))
    rows = rows.join(alias, ["file_path", "node_id"], "left")
    path = F.regexp_replace("p_text", "[\"`]", "")
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("start"))
    return rows.select("file_path", place.alias("ord"), path.alias("path"), "given", F.coalesce("given", F.element_at(F.split(path, "/"), -1)).alias("alias"), "start", "end")


@derived
def receivers(ws: Workspace) -> DataFrame:
    """file_path, node_id (of the FuncDecl), recv: the receiver's type without pointer; null for generic ones."""
    lists = ws.nodes.where("edge = 'recv'").select("file_path", F.col("parent_id").alias("node_id"), F.col("node_id").alias("list_id"))
    field = ws.nodes.where("kind = 'Field'").select("file_path", F.col("parent_id").alias("list_id"), F.col("node_id").alias("field_id"))
    kind = ws.nodes.where("edge = 'type'").select("file_path", F.col("parent_id").alias("field_id"), F.col("node_id").alias("type_id"), F.col("kind").alias("type_kind"), F.col("text").alias("type_text"))
    star = ws.nodes.where("edge = 'x' and kind = 'Ident'").select("file_path", F.col("parent_id").alias("type_id"), F.col("text").alias("base"))
    rows = lists.join(field, ["file_path", "list_id"]).join(kind, ["file_path", "field_id"]).join(star, ["file_path", "type_id"], "left")
    recv = F.when(F.col("type_kind") == "Ident", F.col("type_text")).when(F.col("type_kind") == "StarExpr", F.col("base"))
    return rows.select("file_path", "node_id", recv.alias("recv"))


@derived
def parameters(ws: Workspace, which: str = "params") -> DataFrame:
    """file_path, func_node, ord, name, type_text, type_start, type_end: one row per parameter (or result) of each
    declared function, unnamed ones with a null name."""
    sig = ws.nodes.where("kind = 'FuncType' and edge = 'type'").select("file_path", F.col("parent_id").alias("func_node"), F.col("node_id").alias("sig_id"))
    decl = ws.nodes.where("kind = 'FuncDecl'").select("file_path", F.col("node_id").alias("func_node"))
    lists = ws.nodes.where(F.col("edge") == which).select("file_path", F.col("parent_id").alias("sig_id"), F.col("node_id").alias("list_id"))
    field = ws.nodes.where("kind = 'Field'").select("file_path", F.col("parent_id").alias("list_id"), F.col("node_id").alias("field_id"))
    kind = ws.nodes.where("edge = 'type'").select("file_path", F.col("parent_id").alias("field_id"), F.col("start").alias("type_start"), F.col("end").alias("type_end"))
    name = ws.nodes.where("edge = 'name'").select("file_path", F.col("parent_id").alias("field_id"), F.col("text").alias("name"), F.col("node_id").alias("name_id"), F.col("line").alias("name_line"), F.col("col").alias("name_col"))
    rows = sig.join(decl, ["file_path", "func_node"], "left_semi").join(lists, ["file_path", "sig_id"]).join(field, ["file_path", "list_id"]).join(kind, ["file_path", "field_id"]).join(name, ["file_path", "field_id"], "left")
    rows = source_text(ws.files, rows, "type_start", "type_end", "type_text")
    place = F.row_number().over(Window.partitionBy("file_path", "func_node").orderBy("field_id", "name_id"))
    return rows.select("file_path", "func_node", place.alias("ord"), "name", "type_text", "type_start", "type_end", "name_line", "name_col")


@derived
def functions(ws: Workspace) -> DataFrame:
    """file_path, func_node, name, recv, start, end, line, col (of the name), body_line, body_end_line, params (names)."""
    decl = ws.nodes.where("kind = 'FuncDecl'").select("file_path", "node_id", "start", "end")
    rows = children(decl, ws.nodes, "name", "n").join(receivers(ws), ["file_path", "node_id"], "left")
    body = ws.nodes.where("edge = 'body' and kind = 'BlockStmt'").select("file_path", F.col("parent_id").alias("node_id"), F.col("line").alias("body_line"), F.col("end_line").alias("body_end_line"))
    names = parameters(ws).where("name is not null").groupBy("file_path", F.col("func_node").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("p"))
    rows = rows.join(body, ["file_path", "node_id"], "left").join(names, ["file_path", "node_id"], "left")
    params = F.coalesce(F.col("p.name"), F.array().cast("array<string>"))
    return rows.select("file_path", F.col("node_id").alias("func_node"), F.col("n_text").alias("name"), "recv", "start", "end", F.col("n_line").alias("line"), F.col("n_col").alias("col"), F.col("n_start").alias("name_start"), "body_line", "body_end_line", params.alias("params"))


@derived
def symbols(ws: Workspace) -> DataFrame:
    """dir, file_path, is_test, name, kind, recv, pos, end, line, col, exported, signature: one row per declared symbol,
    interface methods included; of equal names of a kind the one outside tests, then the last declared."""
    f = functions(ws)
    signature = F.concat("name", F.lit("("), F.array_join("params", ", "), F.lit(")"))
    funcs = f.select("file_path", "name", F.when(F.col("recv").isNull(), "Function").otherwise("Method").alias("kind"), "recv", F.col("name_start").alias("pos"), "end", "line", "col", signature.alias("signature"))
    spec = ws.nodes.where("kind in ('ValueSpec', 'TypeSpec')").select("file_path", "node_id", "parent_id", F.col("kind").alias("spec"), "end")
    decl = ws.nodes.where("kind = 'GenDecl'").select("file_path", F.col("node_id").alias("parent_id"), F.col("tok").alias("decl"))
    named = children(spec.join(decl, ["file_path", "parent_id"]), ws.nodes, "name", "n")
    body = ws.nodes.where("edge = 'type'").select("file_path", F.col("parent_id").alias("node_id"), F.col("kind").alias("type_kind"), F.col("node_id").alias("type_id"))
    named = named.join(body, ["file_path", "node_id"], "left")
    kind = F.when(F.col("spec") == "TypeSpec", F.when(F.col("type_kind") == "InterfaceType", "Interface").otherwise("Type")).when(F.col("decl") == "const", "Constant").otherwise("Variable")
    plain = named.select("file_path", F.col("n_text").alias("name"), kind.alias("kind"), F.lit(None).cast("string").alias("recv"), F.col("n_start").alias("pos"), "end", F.col("n_line").alias("line"), F.col("n_col").alias("col"), F.col("n_text").alias("signature"))
    field = ws.nodes.where("kind = 'Field'").select("file_path", F.col("parent_id").alias("type_id"), F.col("node_id").alias("field_id"), F.col("end").alias("field_end"))
    inner = named.where("type_kind = 'InterfaceType'").select("file_path", "type_id", F.col("n_text").alias("recv")).join(field, ["file_path", "type_id"])
    inner = children(inner.withColumnRenamed("field_id", "node_id"), ws.nodes, "name", "n")
    methods = inner.select("file_path", F.col("n_text").alias("name"), F.lit("Method").alias("kind"), "recv", F.col("n_start").alias("pos"), F.col("field_end").alias("end"), F.col("n_line").alias("line"), F.col("n_col").alias("col"), F.col("n_text").alias("signature"))
    rows = funcs.unionByName(plain).unionByName(methods).where("name <> '_'").join(ws.files.select("file_path", "dir", "is_test"), "file_path")
    last = F.row_number().over(Window.partitionBy("dir", "kind", "recv", "name").orderBy("is_test", F.desc("file_path"), F.desc("pos")))
    return rows.withColumn("n", last).where("n = 1").drop("n").withColumn("exported", exported(F.col("name")))


@derived
def occurrences(ws: Workspace) -> DataFrame:
    """file_path, node_id, name, pos, end, line, col, is_decl, is_selector, qualifier, is_call: every identifier, whether
    it is declared there, and what it is selected from."""
    ident = ws.nodes.where("kind = 'Ident' and edge <> 'label'")
    parent = renamed(ws.nodes, "p", "node_id", "kind", "edge", "parent_id").withColumnRenamed("p_node_id", "parent_id")
    rows = ident.join(parent, ["file_path", "parent_id"])
    qualifier = ws.nodes.where("edge = 'x' and kind = 'Ident'").select("file_path", "parent_id", F.col("text").alias("qualifier"))
    rows = rows.join(qualifier, ["file_path", "parent_id"], "left")
    selected = (F.col("edge") == "sel") & (F.col("p_kind") == "SelectorExpr")
    declared = (F.col("edge") == "name") & F.col("p_kind").isin("FuncDecl", "TypeSpec", "ValueSpec", "Field", "File")
    called = F.when(selected, F.col("p_edge") == "fun").otherwise(F.col("edge") == "fun")
    return rows.select("file_path", "node_id", F.col("text").alias("name"), F.col("start").alias("pos"), "end", "line", "col", declared.alias("is_decl"), selected.alias("is_selector"), F.when(selected, F.col("qualifier")).alias("qualifier"), called.alias("is_call"), "func_id")


@derived
def variable_types(ws: Workspace) -> DataFrame:
    """(file_path, func_id, name, type_dir, type): names in a function whose own declaration tells a type of the tree:
    receivers, parameters and `var x T` of a named type or a pointer to one, `T{}`, `&T{}` and `new(T)`. A name that a
    function declares with several types tells none."""
    nodes = ws.nodes.where("func_id is not null")
    up = lambda p: nodes.select("file_path", F.col("node_id").alias(f"{p}_id"), F.col("kind").alias(f"{p}_kind"), F.col("tok").alias(f"{p}_tok"), F.col("parent_id").alias(f"{p}_up"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"), F.col("edge").alias(f"{p}_edge"), F.col("ord").alias(f"{p}_ord"), F.col("text").alias(f"{p}_text"))
    name = nodes.where("edge = 'name' and kind = 'Ident'").select("file_path", "func_id", F.col("parent_id").alias("holder"), F.col("text").alias("name"))
    kind = up("t").where("t_edge = 'type'").withColumnRenamed("t_up", "holder")
    given = name.join(kind, ["file_path", "holder"])
    left = nodes.where("edge = 'lhs' and kind = 'Ident'").select("file_path", "func_id", F.col("parent_id").alias("stmt_id"), F.col("text").alias("name"), F.col("ord").alias("place"))
    stmt = up("stmt").where("stmt_kind = 'AssignStmt' and stmt_tok = ':='").select("file_path", "stmt_id")
    right = up("r").where("r_edge = 'rhs'").withColumnRenamed("r_up", "stmt_id")
    sides = right.groupBy("file_path", "stmt_id").agg(F.count("*").alias("n"))
    value = left.join(stmt, ["file_path", "stmt_id"]).join(sides, ["file_path", "stmt_id"]).join(right, ["file_path", "stmt_id"]).where("r_ord = place + n")
    # &T{} is a level above T{}; new(T) names the type as its argument.
    inner = up("x").where("x_edge in ('x', 'arg', 'type')")
    pointed = value.where("r_kind = 'UnaryExpr' and r_tok = '&'").join(inner.where("x_edge = 'x' and x_kind = 'CompositeLit'").withColumnRenamed("x_up", "r_id"), ["file_path", "r_id"]).select("file_path", "func_id", "name", F.col("x_id").alias("lit_id"))
    plain = value.where("r_kind = 'CompositeLit'").select("file_path", "func_id", "name", F.col("r_id").alias("lit_id"))
    made = pointed.unionByName(plain).join(kind.withColumnRenamed("holder", "lit_id"), ["file_path", "lit_id"])
    fun = up("f").where("f_edge = 'fun' and f_kind = 'Ident' and f_text = 'new'").select("file_path", F.col("f_up").alias("r_id"))
    fresh = value.where("r_kind = 'CallExpr'").join(fun, ["file_path", "r_id"], "left_semi").join(up("t").where("t_edge = 'arg'").withColumnRenamed("t_up", "r_id"), ["file_path", "r_id"])
    keep = ["file_path", "func_id", "name", "t_start", "t_end"]
    rows = source_text(ws.files, given.select(*keep).unionByName(made.select(*keep)).unionByName(fresh.select(*keep)), "t_start", "t_end", "t")
    rows = rows.withColumn("t", F.regexp_replace("t", r"^\*", "")).where(r"t rlike '^[\\p{L}_][\\p{L}\\p{Nd}_]*([.][\\p{L}_][\\p{L}\\p{Nd}_]*)?$'")
    alone = rows.groupBy("file_path", "func_id", "name").agg(F.collect_set("t").alias("ts")).where("size(ts) = 1").select("file_path", "func_id", "name", F.col("ts")[0].alias("t"))
    known = imports(ws).join(ws.packages.select(F.col("import_path").alias("path"), F.col("dir").alias("target")), "path").select("file_path", F.col("alias").alias("q"), "target")
    alone = alone.withColumn("q", F.when(F.col("t").contains("."), F.split("t", "[.]")[0])).withColumn("type", F.element_at(F.split("t", "[.]"), -1))
    rows = alone.join(known, ["file_path", "q"], "left").join(ws.files.select("file_path", "dir"), "file_path")
    out = rows.select("file_path", "func_id", "name", F.when(F.col("q").isNull(), F.col("dir")).otherwise(F.col("target")).alias("type_dir"), "type").where("type_dir is not null")
    named = ws.nodes.where("kind = 'TypeSpec'").select("file_path", F.col("node_id").alias("parent_id"))
    types = ws.nodes.where("edge = 'name'").join(named, ["file_path", "parent_id"]).join(ws.files.select("file_path", "dir"), "file_path").select(F.col("dir").alias("type_dir"), F.col("text").alias("type")).distinct()
    return out.join(types, ["type_dir", "type"], "left_semi")


@derived
def method_calls(ws: Workspace) -> DataFrame:
    """(file_path, fun_end, pos, name, type_dir, type): selections of a method from a name whose type its function tells."""
    occ = occurrences(ws).where("is_selector and qualifier is not null and func_id is not null").select("file_path", "func_id", "name", "pos", F.col("end").alias("fun_end"), "qualifier")
    return occ.join(variable_types(ws).withColumnRenamed("name", "qualifier"), ["file_path", "func_id", "qualifier"]).select("file_path", "fun_end", "pos", "name", "type_dir", "type")


def references(ws: Workspace, packages: list[str] | None = None) -> DataFrame:
    """All references, or those that stand in the given folders."""
    rows = _references(ws)
    return rows if packages is None else rows.join(ws.files.where(F.col("dir").isin(packages)).select("file_path"), "file_path", "left_semi")


@derived
def _references(ws: Workspace) -> DataFrame:
    """Occurrences joined to the package symbols that they name: a bare name to its own package, a qualified one to the
    package that the file imports under the qualifier. A method call whose receiver's type the text tells goes to that
    type's method, or where it has none (an interface's or an embedded type's) to every method of the name, as does a
    call that doesn't tell."""
    sym = symbols(ws).select("dir", "name", "kind", "recv", F.col("file_path").alias("decl_file"), F.col("pos").alias("decl_pos"))
    files = ws.files.select("file_path", F.col("dir").alias("own_dir"))
    occ = occurrences(ws).where(~F.col("is_decl")).join(files, "file_path")
    found = imports(ws)
    known = found.join(ws.packages.select(F.col("import_path").alias("path"), F.col("dir").alias("target")), "path").select("file_path", F.col("alias").alias("qualifier"), "target")
    alias = found.select("file_path", F.col("alias").alias("qualifier"), F.lit(True).alias("is_import")).distinct()
    occ = occ.join(known, ["file_path", "qualifier"], "left").join(alias, ["file_path", "qualifier"], "left")
    bare = occ.where(~F.col("is_selector")).withColumn("dir", F.col("own_dir"))
    through = occ.where("is_selector and target is not null").withColumn("dir", F.col("target"))
    plain = bare.unionByName(through).join(sym.where("kind <> 'Method'"), ["dir", "name"])
    method = sym.where("kind = 'Method'")
    told = method_calls(ws).select("file_path", "pos", "type_dir", "type").distinct()
    owner = method.select(F.col("dir").alias("type_dir"), F.col("recv").alias("type"), "name").distinct().withColumn("has", F.lit(True))
    picked = occ.where("is_selector and is_import is null").join(told, ["file_path", "pos"], "left").join(owner, ["type_dir", "type", "name"], "left")
    exact = picked.where("has").join(method.withColumnRenamed("recv", "type").withColumnRenamed("dir", "type_dir"), ["type_dir", "type", "name"]).withColumnRenamed("type", "recv").withColumnRenamed("type_dir", "dir")
    loose = picked.where("has is null").drop("type_dir", "type").join(method, "name")
    keep = ["dir", "name", "kind", "recv", "decl_file", "decl_pos", "file_path", "pos", "end", "line", "col"]
    return plain.select(*keep).unionByName(exact.select(*keep)).unionByName(loose.select(*keep)).distinct()


def unused(ws: Workspace, with_exported: bool = False) -> DataFrame:
    """Symbols that nothing references, with the reason and whether they can go."""
    sym = symbols(ws)
    exempt = sym.where("kind = 'Method'").join(sym.where("kind = 'Interface'").select("dir", F.col("name").alias("recv")), ["dir", "recv"], "left_semi").select("name").union(ws.nodes.sparkSession.createDataFrame([(m,) for m in BUILTIN_METHODS], "name string")).distinct()
    tests = (F.col("kind") == "Function") & (F.col("is_test") | F.col("name").rlike("^(Test|Benchmark|Example|Fuzz)"))
    rows = sym.where(~F.col("name").isin("main", "init") & ~tests)
    if not with_exported:
        rows = rows.where(~F.col("exported"))
    rows = rows.where("kind <> 'Method'").unionByName(rows.where("kind = 'Method'").join(exempt, "name", "left_anti").select(*rows.columns))
    ref = references(ws).select("dir", "name", F.coalesce("recv", F.lit("")).alias("r")).distinct()
    free = rows.withColumn("r", F.coalesce("recv", F.lit(""))).join(ref, ["dir", "name", "r"], "left_anti")
    # Whether the package declares the name once more, elsewhere than where this symbol stands.
    declared = occurrences(ws).where("is_decl").join(ws.files.select("file_path", "dir"), "file_path").groupBy("dir", "name").agg(F.count("*").alias("declared"))
    free = free.join(declared, ["dir", "name"], "left")
    reason = F.when(F.col("declared") > 1, "Only referenced in declarations").otherwise("No references found")
    return free.select("name", "kind", F.col("dir").alias("package"), F.col("file_path").alias("file"), "line", "exported", (~F.col("exported")).alias("safe_to_delete"), reason.alias("reason"))


@derived
def import_edges(ws: Workspace) -> DataFrame:
    """src, dst (folders of packages of this tree), is_test."""
    to = ws.packages.select(F.col("import_path").alias("path"), F.col("dir").alias("dst"))
    return imports(ws).join(to, "path").join(ws.files.select("file_path", F.col("dir").alias("src"), "is_test"), "file_path").select("src", "dst", "is_test").distinct()


def unused_imports(ws: Workspace) -> DataFrame:
    """Imports whose name the file never selects from."""
    used = occurrences(ws).where("qualifier is not null").select("file_path", F.col("qualifier").alias("alias")).distinct()
    return imports(ws).where("coalesce(given, '') not in ('_', '.') and path <> 'C'").join(used, ["file_path", "alias"], "left_anti")
