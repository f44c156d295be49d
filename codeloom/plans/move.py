"""Moving symbols between packages: the declaration with its methods, every use, and the imports on both sides."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.golang import facts
from codeloom.operators import graph
from codeloom.plans.apply import changes
from codeloom.plans.refactor import RefactorError, _declaration, add_imports, with_margins
from codeloom.sources.tables import cut
from codeloom.sources.workspace import Workspace

EDIT = "file_path string, start int, end int, old_text string, new_text string"
#: Kinds that may move on their own; methods go with their type, interfaces and fields stay.
MOVEABLE = ("Function", "Type", "Variable", "Constant")


def movable(ws: Workspace, package: str, name: str) -> str:
    """The kind of a symbol that may move."""
    found = facts.symbols(ws).where((F.col("dir") == package) & (F.col("name") == name) & (F.col("kind") != "Method")).select("kind").first()
    if found is None:
        raise RefactorError(f"{package} has no {name}")
    if found.kind not in MOVEABLE:
        raise RefactorError(f"{name} is of kind {found.kind}, which doesn't move")
    return found.kind


def drop_imports(ws: Workspace, specs: DataFrame) -> DataFrame:
    """Edits that delete whole lines of import specifications (file_path, start, end); an import that stands alone goes
    with its keyword."""
    decl = ws.nodes.where("kind = 'GenDecl' and tok = 'import'").select("file_path", F.col("start").alias("d_start"), F.col("end").alias("d_end"))
    held = ws.nodes.where("kind = 'ImportSpec'").select("file_path", F.col("start").alias("s"), F.col("end").alias("e"))
    rows = specs.join(decl, "file_path").where("d_start <= start and end <= d_end")
    alone = rows.join(held, "file_path").where("d_start <= s and e <= d_end").groupBy("file_path", "start", "end", "d_start", "d_end").agg(F.count("*").alias("n"))
    one = F.col("n") == 1
    alone = alone.select("file_path", F.when(one, F.col("d_start")).otherwise(F.col("start")).alias("from"), F.when(one, F.col("d_end")).otherwise(F.col("end")).alias("to"))
    rows = alone.join(ws.files.select("file_path", "content"), "file_path")
    before = F.expr("substring(content, 1, from)")
    lead = F.octet_length(F.regexp_extract(F.decode(before, "ISO-8859-1"), r"([ \t]*)$", 1))
    after = F.octet_length(F.regexp_extract(F.decode(F.expr("substring(content, to + 1)"), "ISO-8859-1"), r"^([ \t]*\n?)", 1))
    rows = rows.withColumn("start", F.col("from") - lead).withColumn("end", F.col("to") + after)
    text = F.decode(F.expr("substring(content, start + 1, end - start)"), "UTF-8")
    return rows.select("file_path", "start", "end", text.alias("old_text"), F.lit("").alias("new_text"))


def _pieces(ws: Workspace, package: str, name: str, kind: str) -> list:
    """The declaration and, for a type, its methods, with their margins."""
    decl = _declaration(ws, package, name).select("file_path", "start", "end")
    if kind == "Type":
        own = ws.files.where(F.col("dir") == package).select("file_path")
        methods = facts.functions(ws).where(F.col("recv") == name).select("file_path", "start", "end")
        decl = decl.unionByName(methods.join(own, "file_path", "left_semi"))
    return with_margins(ws, decl).orderBy("file_path", "start").collect()


def move_symbol_to(ws: Workspace, package: str, name: str, target: str) -> DataFrame:
    """Move a package-level function, type (with its methods), variable or constant to another package of the tree.

    Uses in the old package and elsewhere are qualified by the new one, uses in the new package lose their qualifier;
    imports that this asks for are added, and imports that nothing is selected from any more go. What the moved text
    itself uses of its old package must be exported; it is qualified, and uses of the new package are not. A move is
    refused where the new package has the name, where an unexported symbol would be used across packages, and where
    packages would import each other."""
    kind = movable(ws, package, name)
    named = {r.dir: r for r in ws.packages.where(F.col("dir").isin(package, target)).collect()}
    if target not in named or target == package:
        raise RefactorError(f"no other package {target}")
    old, new = named[package], named[target]
    sym = facts.symbols(ws)
    if sym.where((F.col("dir") == target) & (F.col("name") == name) & (F.col("kind") != "Method")).limit(1).count():
        raise RefactorError(f"{target} already has {name}")
    pieces = _pieces(ws, package, name, kind)
    if not pieces:
        raise RefactorError(f"{package} has no {name} with a declaration of its own")
    spark = ws.nodes.sparkSession
    spans = F.broadcast(spark.createDataFrame([(p.file_path, p.start, p.end) for p in pieces], "file_path string, m_start int, m_end int"))
    ref = facts.references(ws).where("kind <> 'Method'")
    place = ref.join(spans, "file_path", "left").withColumn("inside", F.coalesce((F.col("m_start") <= F.col("pos")) & (F.col("end") <= F.col("m_end")), F.lit(False)))
    place = place.groupBy("dir", "name", "file_path", "pos", "end").agg(F.max("inside").alias("inside")).join(ws.files.select("file_path", F.col("dir").alias("own_dir")), "file_path")
    sel = ws.nodes.where("kind = 'SelectorExpr'").select("file_path", "end", F.col("start").alias("sel_start"))
    place = cut(place.join(sel, ["file_path", "end"], "left").withColumn("from", F.coalesce("sel_start", "pos")))
    uses = place.where((F.col("dir") == package) & (F.col("name") == name) & ~F.col("inside"))
    inner = place.where(F.col("inside") & ~((F.col("dir") == package) & (F.col("name") == name)))
    exported = facts.exported(F.lit(name))
    outside = uses.where(F.col("own_dir") != target)
    if outside.where(~exported).limit(1).count():
        raise RefactorError(f"{name} is not exported and is used outside {target}")
    own = inner.where(F.col("dir") == package)
    hidden = own.where(~facts.exported(F.col("name"))).select("name").distinct().orderBy("name").collect()
    if hidden:
        raise RefactorError(f"{name} uses {', '.join(r.name for r in hidden)} of {package}, not exported")
    back, there = own.limit(1).count() > 0, outside.where(F.col("own_dir") == package).limit(1).count() > 0
    edges = facts.import_edges(ws).where(~F.col("is_test")).select("src", "dst").distinct()
    more = [(target, package)] * back + [(r.own_dir, target) for r in outside.select("own_dir").distinct().collect()]
    if back and there or more and graph.would_create_cycle(edges.unionByName(spark.createDataFrame(more, "src string, dst string")), spark.createDataFrame(more, "src string, dst string")).limit(1).count():
        raise RefactorError(f"moving {name} would make packages import each other")
    # The name that each file imports the target under.
    given = facts.imports(ws).where(F.col("path") == new.import_path).select("file_path", F.col("alias").alias("local"))
    qualified = outside.join(given, "file_path", "left").withColumn("new_text", F.concat(F.coalesce("local", F.lit(new.name)), F.lit(f".{name}")))
    edits = qualified.select("file_path", F.col("from").alias("start"), "end", "new_text").unionByName(uses.where(F.col("own_dir") == target).select("file_path", F.col("from").alias("start"), "end", F.lit(name).alias("new_text")))
    edits = facts.source_text(ws.files, edits.distinct(), "start", "end", "old_text").select("file_path", "start", "end", "old_text", "new_text")
    # Inside the moved text: what it uses of the old package and of the new one.
    turned = [(r.file_path, r["from"], r.end, f"{old.name}.{r.name}" if r.dir == package else r.name) for r in inner.where(F.col("dir").isin(package, target)).collect()]
    to = ws.files.where((F.col("dir") == target) & ~F.col("is_test")).orderBy("basename").first()
    size = len(bytes(to.content))
    lead = "" if bytes(to.content).endswith(b"\n") else "\n"
    text = "".join(f"\n// {name} was moved from {old.import_path}\n" * (i == 0) + "\n" * (i > 0) + _rewritten(p, turned) + "\n" for i, p in enumerate(pieces))
    rows = [(p.file_path, p.start, p.stop, p.old_text, "") for p in pieces] + [(to.file_path, size, size, "", lead + text)]
    moved = spark.createDataFrame(rows, EDIT)
    # Imports: of the target where it is used now, of what the moved text needs, and away with those left unused.
    occ = facts.occurrences(ws).where("qualifier is not null").join(spans, "file_path", "left")
    occ = occ.withColumn("inside", F.coalesce((F.col("m_start") <= F.col("pos")) & (F.col("end") <= F.col("m_end")), F.lit(False)))
    occ = cut(occ.groupBy("file_path", "qualifier", "pos", "name").agg(F.max("inside").alias("inside")))
    imports = facts.imports(ws).where("coalesce(given, '') not in ('_', '.')")
    needs = occ.where("inside").join(imports.withColumnRenamed("alias", "qualifier"), ["file_path", "qualifier"]).select("path", "given").distinct().collect()
    needed = [r.path for r in needs if r.path != new.import_path] + [old.import_path] * back
    if any(r.given for r in needs):
        raise RefactorError("the moved text uses an import under another name")
    wanted = outside.select("file_path", F.lit(new.import_path).alias("path")).unionByName(spark.createDataFrame([(to.file_path, p) for p in needed], "file_path string, path string"))
    gone = occ.join(imports.withColumnRenamed("alias", "qualifier"), ["file_path", "qualifier"]).join(uses.select("file_path", "pos", F.lit(True).alias("moves")).distinct(), ["file_path", "pos"], "left")
    left = gone.groupBy("file_path", "start", "end").agg(F.min((F.col("inside") | F.coalesce("moves", F.lit(False))).cast("int")).alias("all"), F.first("path").alias("path"))
    dropped = cut(left.where("all = 1").where((F.col("path") != new.import_path) | (F.col("file_path") == to.file_path)).select("file_path", "start", "end"))
    parts = [edits, moved, add_imports(ws, wanted, dropped), drop_imports(ws, dropped)]
    return changes(reduce(DataFrame.unionByName, parts), f"move {name} to {target}")


def _rewritten(piece, turned: list[tuple]) -> str:
    raw, out, at = piece.text.encode(), b"", 0
    for file, start, end, new in sorted(turned):
        if file == piece.file_path and piece.start <= start and end <= piece.end:
            out += raw[at : start - piece.start] + new.encode()
            at = end - piece.start
    return (out + raw[at:]).decode()


def move_by_dependencies(ws: Workspace, target: str, keep: list[str] | None = None) -> DataFrame:
    """Move every symbol that several packages share to one package: as one plan where the moves don't meet, else the
    first that stands in the way is named."""
    from codeloom.golang.resolve import shared_symbols

    found = shared_symbols(ws, keep).where(F.col("dir") != target).orderBy("dir", "name").collect()
    if not found:
        raise RefactorError("no symbol is shared")
    return reduce(DataFrame.unionByName, [move_symbol_to(ws, r.dir, r.name, target) for r in found]).distinct()
