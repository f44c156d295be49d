"""Scopes: spans of a file that names are declared in, the names of each, and lookup through the chain of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.golang import facts
from codeloom.golang.resolve import BUILTINS
from codeloom.sources.workspace import Workspace

#: Nodes that open a scope of their own, and its kind.
OPENING = {"FuncDecl": "function", "FuncLit": "function", "BlockStmt": "block", "IfStmt": "if", "ForStmt": "for", "RangeStmt": "for", "SwitchStmt": "switch", "TypeSwitchStmt": "switch", "CaseClause": "case", "CommClause": "case"}
#: Bytes of the stretches that scopes and positions are dealt to before they are compared.
STRETCH = 1024


@facts.derived
def scopes(ws: Workspace) -> DataFrame:
    """(file_path, scope_id, kind, start, end, func_id): the file's own span and one for each node that opens a scope.
    scope_id is the node's."""
    kind = F.when(F.col("kind") == "File", "file")
    for node, name in OPENING.items():
        kind = kind.when(F.col("kind") == node, name)
    rows = ws.nodes.withColumn("scope_kind", kind).where("scope_kind is not null")
    return rows.select("file_path", F.col("node_id").alias("scope_id"), F.col("scope_kind").alias("kind"), "start", "end", "func_id")


def tree(ws: Workspace) -> DataFrame:
    """scopes() with parent_id, the narrowest scope around each; null for files."""
    rows = scopes(ws)
    inner = rows.select("file_path", F.col("scope_id").alias("pos_id"), F.col("start").alias("pos"), F.col("end").alias("upto"))
    met = around(inner, rows).where("scope_id <> pos_id and end >= upto and (start < pos or end > upto or scope_id < pos_id)")
    best = F.row_number().over(Window.partitionBy("file_path", "pos_id").orderBy(F.col("end") - F.col("start"), F.desc("scope_id")))
    up = met.withColumn("n", best).where("n = 1").select("file_path", F.col("pos_id").alias("scope_id"), F.col("scope_id").alias("parent_id"))
    return rows.join(up, ["file_path", "scope_id"], "left")


def around(places: DataFrame, spans: DataFrame) -> DataFrame:
    """places (file_path, pos, ...) joined to the spans (file_path, start, end, ...) that hold them. Spans are dealt to
    the stretches that they touch, so a place meets only those of its own stretch."""
    cells = F.explode(F.sequence(F.floor(F.col("start") / STRETCH), F.floor(F.col("end") / STRETCH))).alias("cell")
    dealt = spans.select("*", cells)
    at = places.withColumn("cell", F.floor(F.col("pos") / STRETCH))
    return at.join(dealt, ["file_path", "cell"]).where("start <= pos and pos < end").drop("cell")


@facts.derived
def declared(ws: Workspace) -> DataFrame:
    """(file_path, scope_id, name, kind, pos, from): names that a scope inside a function declares, and the place from
    which on they hold: parameters, receivers and results, `:=` (also of ranges and type switches), var, const and type."""
    nodes = ws.nodes
    up = nodes.select("file_path", F.col("node_id").alias("parent_id"), F.col("kind").alias("up_kind"), F.col("tok").alias("up_tok"), F.col("end").alias("up_end"), F.col("parent_id").alias("up_parent"), F.col("edge").alias("up_edge"))
    ident = nodes.where("kind = 'Ident' and text <> '_' and func_id is not null").select("file_path", "parent_id", "edge", F.col("text").alias("name"), F.col("start").alias("pos"), "end")
    rows = ident.join(up, ["file_path", "parent_id"])
    short = rows.where("(up_kind = 'AssignStmt' and up_tok = ':=' and edge = 'lhs') or (up_kind = 'RangeStmt' and up_tok = ':=' and edge in ('key', 'value'))")
    spec = rows.where("edge = 'name' and up_kind in ('ValueSpec', 'TypeSpec')")
    field = rows.where("edge = 'name' and up_kind = 'Field'")
    gen = nodes.where("kind = 'GenDecl'").select("file_path", F.col("node_id").alias("up_parent"), F.col("tok").alias("word"))
    # Fields count where their list is a function's: parameters, results and receivers, not those of structs.
    lists = nodes.where("kind = 'FieldList'").select("file_path", F.col("node_id").alias("up_parent"), F.col("edge").alias("list_edge"), F.col("parent_id").alias("sig"))
    of = nodes.where("kind = 'FuncType' and edge = 'type'").select("file_path", F.col("node_id").alias("sig"), F.col("parent_id").alias("owner"))
    funcs = nodes.where("kind in ('FuncDecl', 'FuncLit')").select("file_path", F.col("node_id").alias("owner"))
    held = field.join(lists, ["file_path", "up_parent"]).join(of, ["file_path", "sig"], "left")
    held = held.withColumn("owner", F.when(F.col("list_edge") == "recv", F.col("sig")).otherwise(F.col("owner"))).join(funcs, ["file_path", "owner"], "left_semi")
    params = held.select("file_path", F.col("owner").alias("scope_id"), "name", F.lit("Parameter").alias("kind"), "pos", F.col("pos").alias("from"))
    word = spec.join(gen, ["file_path", "up_parent"], "left")
    kind = F.when(F.col("up_kind") == "TypeSpec", "Type").when(F.col("word") == "const", "Constant").otherwise("Variable")
    # A variable holds from behind its statement on; a type already in its own declaration.
    local = word.select("file_path", "name", kind.alias("kind"), "pos", F.when(F.col("up_kind") == "TypeSpec", F.col("pos")).otherwise(F.col("up_end")).alias("from"))
    body = F.when(F.col("up_kind") == "RangeStmt", F.col("end")).otherwise(F.col("up_end"))
    local = local.unionByName(short.select("file_path", "name", F.lit("Variable").alias("kind"), "pos", body.alias("from")))
    rows = around(local, scopes(ws).withColumnRenamed("kind", "scope_kind"))
    best = F.row_number().over(Window.partitionBy("file_path", "pos").orderBy(F.col("end") - F.col("start"), F.desc("scope_id")))
    inner = rows.withColumn("n", best).where("n = 1").select("file_path", "scope_id", "name", "kind", "pos", "from")
    return params.unionByName(inner)


def scope_at(ws: Workspace, file: str, offset: int) -> DataFrame:
    """The scopes around a place, narrowest first: scope_id, kind, start, end."""
    place = ws.nodes.sparkSession.createDataFrame([(file, offset)], "file_path string, pos int")
    return around(place, scopes(ws).where(F.col("file_path") == file)).select("scope_id", "kind", "start", "end").orderBy(F.col("end") - F.col("start"), F.desc("scope_id"))


def resolved(ws: Workspace, uses: DataFrame | None = None) -> DataFrame:
    """What each bare name stands for: (file_path, pos, name, level, kind, decl_file, decl_pos). level is `local`
    (narrowest scope that declares it before), `package`, `import` or `builtin`, in that order; `unresolved` where none
    does. uses: (file_path, pos, name), by default all bare names inside functions."""
    if uses is None:
        occ = facts.occurrences(ws).where("not is_decl and not is_selector and func_id is not null and name <> '_'")
        uses = occ.select("file_path", "pos", "name")
    local = around(uses, scopes(ws).select("file_path", "scope_id", "start", "end"))
    names = declared(ws).select("file_path", "scope_id", "name", F.col("kind").alias("l_kind"), F.col("pos").alias("decl_pos"), "from")
    met = local.join(names, ["file_path", "scope_id", "name"]).where("pos >= `from` or pos = decl_pos")
    best = F.row_number().over(Window.partitionBy("file_path", "pos").orderBy(F.col("end") - F.col("start"), F.desc("decl_pos")))
    inner = met.withColumn("n", best).where("n = 1").select("file_path", "pos", "l_kind", F.col("decl_pos").alias("l_pos"))
    own = ws.files.select("file_path", "dir")
    order = F.array_position(F.array(*map(F.lit, facts.KIND_ORDER)), F.col("kind"))
    sym = facts.symbols(ws).where("kind <> 'Method'").groupBy("dir", "name").agg(F.min_by(F.struct("kind", F.col("file_path").alias("file"), "pos"), order).alias("p"))
    imported = facts.imports(ws).where("coalesce(given, '') not in ('_', '.')").groupBy("file_path", F.col("alias").alias("name")).agg(F.min(F.struct("start", "path")).alias("i"))
    built = ws.nodes.sparkSession.createDataFrame([(n, k.capitalize()) for k, v in BUILTINS.items() for n in v.split()], "name string, b string")
    rows = uses.join(inner, ["file_path", "pos"], "left").join(own, "file_path").join(sym, ["dir", "name"], "left").join(imported, ["file_path", "name"], "left").join(F.broadcast(built), "name", "left")
    level = F.when(F.col("l_kind").isNotNull(), "local").when(F.col("p").isNotNull(), "package").when(F.col("i").isNotNull(), "import").when(F.col("b").isNotNull(), "builtin").otherwise("unresolved")
    kind = F.coalesce("l_kind", "p.kind", F.when(F.col("i").isNotNull(), "Package"), "b")
    file = F.when(F.col("l_kind").isNotNull(), F.col("file_path")).otherwise(F.coalesce("p.file", F.when(F.col("i").isNotNull(), F.col("file_path"))))
    place = F.coalesce("l_pos", "p.pos", "i.start")
    return rows.select("file_path", "pos", "name", level.alias("level"), kind.alias("kind"), file.alias("decl_file"), place.alias("decl_pos"))


def visible(ws: Workspace, file: str, offset: int) -> DataFrame:
    """Names that can be used at a place: name, kind, level, those of narrower scopes first."""
    at = scope_at(ws, file, offset).select("scope_id", (F.col("end") - F.col("start")).alias("size"))
    local = declared(ws).where((F.col("file_path") == file) & (F.col("from") <= offset)).join(F.broadcast(at), "scope_id").select("name", "kind", F.lit("local").alias("level"), F.col("size").cast("long").alias("size"))
    folder = ws.files.where(F.col("file_path") == file).select("dir")
    far = F.lit(2**62).cast("long")
    sym = facts.symbols(ws).where("kind <> 'Method'").join(F.broadcast(folder), "dir", "left_semi").select("name", "kind", F.lit("package").alias("level"), far.alias("size"))
    imp = facts.imports(ws).where(F.col("file_path") == file).select(F.col("alias").alias("name"), F.lit("Package").alias("kind"), F.lit("import").alias("level"), (far + 1).alias("size"))
    rows = local.unionByName(sym).unionByName(imp)
    first = F.row_number().over(Window.partitionBy("name").orderBy("size", "kind"))
    return rows.withColumn("n", first).where("n = 1").orderBy("size", "name").select("name", "kind", "level")
