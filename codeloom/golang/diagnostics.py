"""What to say about names that don't resolve: kind of problem, message and suggestions, as rows and as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.golang import facts, scope
from codeloom.golang.resolve import MOST_DISTANCE, MOST_SIMILAR, suggestions
from codeloom.sources.workspace import Workspace

# Packages of the standard library that a misspelt path is compared with.
COMMON = "fmt os io net http json time strings strconv context sync errors log path filepath bufio".split()
#: Names that a message lists before it counts the rest.
MOST_LISTED = 20


def _near(column, name: str):
    return F.levenshtein(F.lower(column), F.lit(name.lower()), MOST_DISTANCE)


def _rows(ws: Workspace, problem: str, message: str, hints: list[str]) -> DataFrame:
    return ws.nodes.sparkSession.createDataFrame([(problem, message, hints)], "problem string, message string, suggestions array<string>")


def unresolved(ws: Workspace) -> DataFrame:
    """Bare names inside functions that nothing declares: file_path, line, col, name, function, scope (the narrowest
    one's kind), suggestions (at most MOST_SIMILAR names of the package within the edit distance, nearest first)."""
    found = scope.resolved(ws).where("level = 'unresolved'")
    keys = ws.nodes.where("kind = 'KeyValueExpr'").select("file_path", F.col("node_id").alias("parent_id"))
    place = ws.nodes.where("kind = 'Ident'").join(keys.withColumn("in_literal", F.lit(True)), ["file_path", "parent_id"], "left")
    # A key of a composite literal may be a field, which needs types to tell.
    place = place.where("not (edge = 'key' and coalesce(in_literal, false))").select("file_path", F.col("start").alias("pos"), "line", "col", "func_id")
    rows = found.join(place, ["file_path", "pos"]).join(ws.files.select("file_path", "dir"), "file_path")
    names = facts.functions(ws).select("file_path", F.col("func_node").alias("func_id"), F.col("name").alias("function"))
    spans = scope.around(rows.select("file_path", "pos"), scope.scopes(ws).select("file_path", F.col("kind").alias("scope"), "start", "end"))
    narrow = spans.groupBy("file_path", "pos").agg(F.min_by("scope", F.col("end") - F.col("start")).alias("scope"))
    sym = facts.symbols(ws).select("dir", F.col("name").alias("other")).distinct()
    near = rows.select("dir", "name").distinct().join(sym, "dir").withColumn("distance", F.levenshtein(F.lower("name"), F.lower("other"), MOST_DISTANCE)).where("distance >= 0")
    rank = F.row_number().over(Window.partitionBy("dir", "name").orderBy("distance", "other"))
    near = near.withColumn("n", rank).where(F.col("n") <= MOST_SIMILAR).groupBy("dir", "name").agg(F.array_sort(F.collect_list(F.struct("n", "other"))).alias("s"))
    rows = rows.join(names, ["file_path", "func_id"], "left").join(narrow, ["file_path", "pos"], "left").join(near, ["dir", "name"], "left")
    hints = F.coalesce(F.col("s.other"), F.array().cast("array<string>"))
    return rows.select("file_path", "line", "col", "name", "function", "scope", hints.alias("suggestions"))


def resolution_failure(ws: Workspace, package: str, name: str) -> DataFrame:
    """A name that a package doesn't have: similar names anywhere, and the names that the package does have."""
    similar = [f"Did you mean '{r.name}' ({r.kind} in {r.package})?" for r in suggestions(ws, name).collect()]
    own = facts.symbols(ws).where((F.col("dir") == package) & (F.col("kind") != "Method")).select("name").distinct()
    n = own.count()
    listed = [r.name for r in own.orderBy("name").limit(MOST_LISTED).collect()]
    more = f" ... and {n - len(listed)} more" if n > len(listed) else ""
    return _rows(ws, "SymbolNotFound", f"symbol '{name}' not found in {package}", [*similar, *([f"Available: {', '.join(listed)}{more}"] if listed else [])])


def type_error(ws: Workspace, package: str, name: str, expected: str) -> DataFrame:
    """A symbol of another kind than expected: symbols of its name that are of that kind."""
    rows = facts.symbols(ws).where(F.col("name") == name)
    own = rows.where(F.col("dir") == package).select("kind").first()
    others = rows.where(F.col("kind") == expected).select("dir").distinct().orderBy("dir").collect()
    hints = [f"Expected {expected}, but '{name}' is {own.kind}"] if own else []
    return _rows(ws, "InvalidOperation", f"symbol '{name}' has wrong type", hints + [f"Found {expected} '{name}' in {r.dir}" for r in others])


def visibility_error(ws: Workspace, package: str, name: str, accessing: str) -> DataFrame:
    """An unexported symbol used from another package: its exported name, and exported functions and types like it."""
    hints = [f"Symbol '{name}' is not exported from package '{package}'"]
    if package == accessing:
        hints.append("It is visible within its own package: look at its scope")
    else:
        title = name[:1].upper() + name[1:].lower()
        hints += [f"To make it accessible, rename it to '{title}'"] if title != name else []
        like = facts.symbols(ws).where((F.col("dir") == package) & F.col("exported") & F.col("kind").isin("Function", "Type")).withColumn("d", _near("name", name)).where("d >= 0")
        hints += [f"Did you mean the exported {r.kind.lower()} '{r.name}'?" for r in like.select("kind", "name").distinct().orderBy("kind", "name").collect()]
    return _rows(ws, "VisibilityViolation", f"cannot access unexported symbol '{name}'", hints)


def import_error(ws: Workspace, path: str) -> DataFrame:
    """A path that no package has: packages of the tree and of the standard library with similar names."""
    inside = ws.packages.where((_near("import_path", path) >= 0) | (_near("dir", path) >= 0)).select("dir").orderBy("dir").collect()
    common = ws.nodes.sparkSession.createDataFrame([(i, n) for i, n in enumerate(COMMON)], "i int, name string").where(_near("name", path) >= 0).orderBy("i").collect()
    hints = [f"Package '{path}' not found", *(f"Did you mean '{r.dir}'?" for r in inside), *(f"Did you mean the standard library package '{r.name}'?" for r in common)]
    return _rows(ws, "SymbolNotFound", f"package '{path}' not found", hints)


def formatted(rows: DataFrame) -> DataFrame:
    """report: a problem's message with its suggestions below it."""
    lines = F.array_join(F.transform("suggestions", lambda x: F.concat(F.lit("    - "), x)), "\n")
    return rows.select(F.concat(F.col("problem"), F.lit(": "), F.col("message"), F.when(F.size("suggestions") > 0, F.concat(F.lit("\n  Suggestions:\n"), lines)).otherwise("")).alias("report"))
