"""What names stand for: definitions, method sets, interfaces and their implementations, suggestions, dependencies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.golang import facts
from codeloom.operators import graph
from codeloom.operators import imports as imports_of
from codeloom.operators.symbols import MOST_DISTANCE, MOST_SIMILAR
from codeloom.sources.tables import cut
from codeloom.sources.workspace import Workspace

#: Embedding deeper than this is an error, as is embedding in a circle.
MOST_EMBEDDING = 20
SHARED_PACKAGES = 2
#: Names that a package's code may use without declaring or importing them (fixed values of the language).
BUILTINS = {
    "type": "any bool byte comparable complex64 complex128 error float32 float64 int int8 int16 int32 int64 rune string uint uint8 uint16 uint32 uint64 uintptr",
    "constant": "true false iota nil",
    "function": "append cap clear close complex copy delete imag len make max min new panic print println real recover",
}


def definition(ws: Workspace, package: str, name: str) -> DataFrame:
    """Where a name leads from a package, best first: rank 0 a symbol of the package, 1 an exported one elsewhere, 2 a
    built-in name. `T.M` asks for a method; a bare method name gives a row for each type that has it."""
    recv, _, method = name.rpartition(".")
    sym = facts.symbols(ws).where(F.col("name") == method)
    sym = sym.where(F.col("recv") == recv) if recv else sym
    kinds = [(n, k) for k, names in BUILTINS.items() for n in names.split() if n == name]
    own = F.col("dir") == package
    order = F.array_position(F.array(*map(F.lit, facts.KIND_ORDER)), F.col("kind")).cast("int")
    found = sym.where(own | F.col("exported")).select(F.when(own, 0).otherwise(1).alias("rank"), order.alias("kind_rank"), "dir", "name", "kind", "recv", F.col("file_path").alias("file"), "line", "col")
    built = ws.nodes.sparkSession.createDataFrame(kinds, "name string, kind string").select(F.lit(2).alias("rank"), F.lit(0).alias("kind_rank"), F.lit(None).cast("string").alias("dir"), "name", "kind", *(F.lit(None).cast(t).alias(c) for c, t in (("recv", "string"), ("file", "string"), ("line", "int"), ("col", "int"))))
    return found.unionByName(built).orderBy("rank", "kind_rank", "dir", "recv").drop("kind_rank")


def suggestions(ws: Workspace, name: str, most: int = MOST_DISTANCE, limit: int = MOST_SIMILAR) -> DataFrame:
    """Nearest declared names within an edit distance, whatever their case: name, kind, package, distance."""
    near = F.levenshtein(F.lower("name"), F.lit(name.lower()), most)
    rows = facts.symbols(ws).withColumn("distance", near).where(f"distance >= 0 and (distance > 0 or name <> '{name}')" if name.isidentifier() else "distance >= 0")
    return rows.select("name", "kind", F.col("dir").alias("package"), "distance").distinct().orderBy("distance", "name", "package").limit(limit)


@facts.derived
def embeds(ws: Workspace) -> DataFrame:
    """dir, type, embedded: named types and interfaces without a field name inside a type, of the same package."""
    spec = ws.nodes.where("kind = 'TypeSpec'").select("file_path", "node_id")
    named = facts.children(spec, ws.nodes, "name", "n").select("file_path", "node_id", F.col("n_text").alias("type"))
    body = facts.children(named, ws.nodes.where("kind in ('StructType', 'InterfaceType')"), "type", "t").select("file_path", "type", F.col("t_node_id").alias("type_id"))
    lists = ws.nodes.where("kind = 'FieldList'").select("file_path", F.col("parent_id").alias("type_id"), F.col("node_id").alias("list_id"))
    direct = body.withColumn("list_id", F.col("type_id"))
    owner = body.join(lists, ["file_path", "type_id"]).select("file_path", "type", "list_id").union(direct.select("file_path", "type", "list_id"))
    field = ws.nodes.where("kind = 'Field'").select("file_path", F.col("parent_id").alias("list_id"), F.col("node_id").alias("node_id"))
    bare = owner.join(field, ["file_path", "list_id"]).join(ws.nodes.where("edge = 'name'").select("file_path", F.col("parent_id").alias("node_id")), ["file_path", "node_id"], "left_anti")
    kind = facts.children(bare, ws.nodes, "type", "k")
    star = ws.nodes.where("edge = 'x' and kind = 'Ident'").select("file_path", F.col("parent_id").alias("k_node_id"), F.col("text").alias("base"))
    kind = kind.join(star, ["file_path", "k_node_id"], "left")
    base = F.when(F.col("k_kind") == "Ident", F.col("k_text")).when(F.col("k_kind") == "StarExpr", F.col("base"))
    return kind.select("file_path", "type", base.alias("embedded")).where("embedded is not null").join(ws.files.select("file_path", "dir"), "file_path").select("dir", "type", "embedded").distinct()


@facts.derived
def method_sets(ws: Workspace) -> DataFrame:
    """dir, type, method, depth: own methods (depth 0) and those promoted from embedded types; the shallowest counts."""
    own = facts.symbols(ws).where("kind = 'Method' and recv is not null").select("dir", F.col("recv").alias("type"), F.col("name").alias("method"))
    inner = embeds(ws)
    out = level = cut(own.distinct().withColumn("depth", F.lit(0)))
    for depth in range(1, MOST_EMBEDDING + 1):
        up = inner.join(level.select("dir", F.col("type").alias("embedded"), "method"), ["dir", "embedded"]).select("dir", "type", "method").distinct()
        level = cut(up.join(out, ["dir", "type", "method"], "left_anti").withColumn("depth", F.lit(depth)))
        if not level.limit(1).count():
            return out
        out = out.unionByName(level)
    raise ValueError(f"types embed each other more than {MOST_EMBEDDING} deep")


@facts.derived
def implementations(ws: Workspace) -> DataFrame:
    """interface_dir, interface, dir, type, missing: how each type meets each interface that it shares a method with.
    A type implements an interface where `missing` is empty; methods are matched by name. Interfaces without methods
    are left out, as every type has none of theirs missing."""
    sets = method_sets(ws)
    inter = facts.symbols(ws).where("kind = 'Interface'").select("dir", F.col("name").alias("type"))
    types = facts.symbols(ws).where("kind = 'Type'").select("dir", F.col("name").alias("type"))
    wanted = sets.join(inter, ["dir", "type"], "left_semi").select(F.col("dir").alias("interface_dir"), F.col("type").alias("interface"), "method")
    have = sets.join(types, ["dir", "type"], "left_semi").select("dir", "type", "method")
    wide = wanted.groupBy("interface_dir", "interface").agg(F.collect_set("method").alias("all"))
    met = wanted.join(have, "method").groupBy("interface_dir", "interface", "dir", "type").agg(F.collect_set("method").alias("own"))
    return met.join(wide, ["interface_dir", "interface"]).select("interface_dir", "interface", "dir", "type", F.array_sort(F.array_except("all", "own")).alias("missing"))


def symbol_report(ws: Workspace, package: str, name: str) -> DataFrame:
    """A symbol with how often and from how many files and packages it is referenced."""
    ref = facts.references(ws).where((F.col("dir") == package) & (F.col("name") == name)).join(ws.files.select("file_path", F.col("dir").alias("from_dir")), "file_path")
    counts = ref.groupBy("kind", F.coalesce("recv", F.lit("")).alias("r")).agg(F.count("*").alias("references"), F.countDistinct("file_path").alias("files"), F.countDistinct("from_dir").alias("packages"))
    sym = facts.symbols(ws).where((F.col("dir") == package) & (F.col("name") == name)).withColumn("r", F.coalesce("recv", F.lit("")))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return sym.join(counts, ["kind", "r"], "left").select("dir", "name", "kind", "recv", F.col("file_path").alias("file"), "line", "exported", "signature", zero("references"), zero("files"), zero("packages"))


def shared_symbols(ws: Workspace, keep: list[str] | None = None, least: int = SHARED_PACKAGES) -> DataFrame:
    """Exported symbols that at least `least` other packages use: candidates for a package of their own. Packages
    below the prefixes `keep` stay as they are."""
    ref = facts.references(ws).where("kind <> 'Method'").join(ws.files.select("file_path", F.col("dir").alias("from_dir")), "file_path").where("from_dir <> dir and name rlike '^\\\\p{Lu}'")
    for prefix in keep or []:
        ref = ref.where(~F.col("dir").startswith(prefix))
    used = ref.groupBy("dir", "name", "kind").agg(F.array_sort(F.collect_set("from_dir")).alias("packages"))
    return used.where(F.size("packages") >= least)


def dependencies(ws: Workspace) -> DataFrame:
    """Each package with its imports inside the tree, who imports it, its exported symbols and its level (null where
    imports go in a circle)."""
    edges = cut(facts.import_edges(ws).where(~F.col("is_test")).select("src", "dst"))
    count = facts.symbols(ws).where("exported and kind <> 'Method'").groupBy(F.col("dir").alias("node")).agg(F.count("*").alias("exported_symbols"))
    rows = ws.packages.select(F.col("dir").alias("node")).join(graph.degrees(edges), "node", "left").join(count, "node", "left")
    loops = graph.cycles(edges).limit(1).count() if edges.limit(1).count() else 0
    levels = None if loops else graph.levels(edges)
    rows = rows.join(levels, "node", "left") if levels is not None else rows.withColumn("level", F.lit(None).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    level = F.lit(None).cast("long") if loops else zero(F.col("level"))
    return rows.select(F.col("node").alias("package"), zero(F.col("outgoing")).alias("imports"), zero(F.col("incoming")).alias("imported_by"), zero(F.col("exported_symbols")).alias("exported_symbols"), level.alias("level"))


def layer_breaks(ws: Workspace, layers: list[tuple[str, int]]) -> DataFrame:
    """Imports that point from an inner layer to an outer one. layers: (prefix of a folder, tier), inner tiers smaller;
    the longest prefix counts, and folders without a layer take no part."""
    table = ws.nodes.sparkSession.createDataFrame(layers, "prefix string, tier int")
    best = F.row_number().over(Window.partitionBy("dir").orderBy(F.desc(F.length("prefix"))))
    tiers = ws.packages.select("dir").join(F.broadcast(table), F.col("dir").startswith(F.col("prefix"))).withColumn("n", best).where("n = 1").select("dir", "tier")
    edges = facts.import_edges(ws).select("src", "dst").distinct()
    rows = edges.join(tiers.toDF("src", "src_tier"), "src").join(tiers.toDF("dst", "dst_tier"), "dst")
    return rows.where("dst_tier > src_tier").select("src", "dst", "src_tier", "dst_tier")


def cycle_report(ws: Workspace) -> DataFrame:
    """The import cycles of a tree: cycle, members, size."""
    return graph.cycles(facts.import_edges(ws).where(~F.col("is_test")).select("src", "dst"))


def interfaces_for_method(ws: Workspace, package: str, recv: str, method: str) -> DataFrame:
    """interface_dir, interface: interfaces that a type meets in full and that ask for one of its methods."""
    met = implementations(ws).where((F.col("dir") == package) & (F.col("type") == recv) & (F.size("missing") == 0))
    asks = method_sets(ws).where(F.col("method") == method).select(F.col("dir").alias("interface_dir"), F.col("type").alias("interface"))
    return met.select("interface_dir", "interface").join(asks, ["interface_dir", "interface"], "left_semi")


def identifier_type(ws: Workspace, file: str, offset: int) -> DataFrame:
    """name, type_dir, type of the identifier at a place, where its function tells it."""
    at = ws.nodes.where((F.col("file_path") == file) & (F.col("kind") == "Ident") & (F.col("start") <= offset) & (F.col("end") > offset)).select("file_path", "func_id", F.col("text").alias("name"))
    return facts.variable_types(ws).join(at, ["file_path", "func_id", "name"], "left_semi").select("name", "type_dir", "type")


def external_dependencies(ws: Workspace) -> DataFrame:
    """path, importers: paths outside the tree with the number of files that import them."""
    inside = ws.packages.select(F.col("import_path").alias("path"))
    rows = facts.imports(ws).withColumnRenamed("file_path", "file").join(inside, "path", "left_anti")
    return imports_of.external_dependencies(rows)


def shortened(kind: Column, own: str, aliases: dict[str, str]) -> Column:
    """Types written with whole import paths as a file would write them: without the path of its own package, with the
    aliases of those that it imports, and with the last segment of all others. aliases: path to alias."""
    quoted = lambda path: re.escape(path)
    out = F.regexp_replace(kind, rf"(?<![\w./-]){quoted(own)}\.", "") if own else kind
    for path, alias in sorted(aliases.items(), key=lambda x: -len(x[0])):
        out = F.regexp_replace(out, rf"(?<![\w./-]){quoted(path)}\.", f"{alias}.")
    return F.regexp_replace(out, r"(?<![\w./-])(?:[\w.~-]+/)+([\w-]+)\.", "$1.")


def import_metrics(ws: Workspace) -> DataFrame:
    """One row over the tree's imports outside tests: total_packages, external_packages (distinct paths that lead out of
    the tree), total_imports (distinct pairs of a package and a path), average_imports, max_imports and
    cyclical_imports (members of import cycles)."""
    rows = facts.imports(ws).join(ws.files.where(~F.col("is_test")).select("file_path", "dir"), "file_path").select("dir", "path").distinct()
    inside = ws.packages.select(F.col("import_path").alias("path"), F.lit(True).alias("own"))
    rows = cut(rows.join(inside, "path", "left"))
    each = ws.packages.select("dir").join(rows.groupBy("dir").agg(F.count("*").alias("n")), "dir", "left").fillna(0)
    counts = each.agg(F.count("*").alias("total_packages"), F.sum("n").alias("total_imports"), F.round(F.avg("n"), 6).alias("average_imports"), F.max("n").alias("max_imports"))
    outside = rows.where("own is null").agg(F.countDistinct("path").alias("external_packages"))
    loops = cycle_report(ws).agg(F.coalesce(F.sum("size"), F.lit(0)).alias("cyclical_imports"))
    return counts.crossJoin(outside).crossJoin(loops).select("total_packages", "external_packages", "total_imports", "average_imports", "max_imports", "cyclical_imports")


def package_metrics(ws: Workspace) -> DataFrame:
    """package, internal_imports, external_imports, imported_by: distinct paths outside tests."""
    rows = facts.imports(ws).join(ws.files.where(~F.col("is_test")).select("file_path", "dir"), "file_path").select("dir", "path").distinct()
    to = ws.packages.select(F.col("import_path").alias("path"), F.col("dir").alias("target"))
    rows = cut(rows.join(to, "path", "left"))
    out = rows.groupBy("dir").agg(F.count("target").alias("internal_imports"), F.count_if(F.col("target").isNull()).alias("external_imports"))
    into = rows.where("target is not null").groupBy(F.col("target").alias("dir")).agg(F.countDistinct("dir").alias("imported_by"))
    return ws.packages.select("dir").join(out, "dir", "left").join(into, "dir", "left").fillna(0).withColumnRenamed("dir", "package")
