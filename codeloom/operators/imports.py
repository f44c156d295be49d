"""Import specifications: layers, order, aliases and unused ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tier(path: Column, layers: list[tuple[str, int]], default: int) -> Column:
    """Tier of the first layer whose prefix the path has."""
    out = F.when(F.lit(False), F.lit(0))
    for prefix, level in layers:
        out = out.when(path.startswith(prefix), F.lit(level)) if prefix else out
    return out.otherwise(F.lit(default))


def ordered(imports: DataFrame, layers: list[tuple[str, int]], default: int) -> DataFrame:
    """Imports with their tier and their place in the organised block of their file."""
    rows = imports.withColumn("tier", tier(F.col("path"), layers, default))
    place = F.row_number().over(Window.partitionBy("file").orderBy("tier", "path", "ord")).cast("long")
    return rows.select("file", "path", "ord", "tier", place.alias("place"))


def alias_conflicts(imports: DataFrame) -> DataFrame:
    """Aliases that stand for several paths in one file."""
    return imports.groupBy("file", "alias").agg(F.countDistinct("path").alias("paths")).where("paths > 1")


def redundant(imports: DataFrame, own_alias: Column) -> DataFrame:
    """Imports whose given alias says no more than the path's last segment and meets no other import of the file."""
    rows = imports.withColumn("given", own_alias)
    clash = rows.where("given is null").select("file", F.col("alias").alias("given")).distinct()
    return rows.where(F.col("given") == F.col("alias")).join(clash, ["file", "given"], "left_anti").select("file", "ord", "path", "given")


def standardised(imports: DataFrame, rules: DataFrame) -> DataFrame:
    """The alias of the first rule whose pattern the path contains. Rules are few: (rule, pattern, new_alias)."""
    met = imports.join(F.broadcast(rules), F.expr("contains(path, pattern)"))
    first = F.row_number().over(Window.partitionBy("file", "ord").orderBy("rule"))
    return met.withColumn("n", first).where("n = 1").select("file", "ord", "path", "new_alias")


def unused(imports: DataFrame, used: DataFrame) -> DataFrame:
    """Imports whose alias the file never uses; used: (file, alias)."""
    return imports.join(used, ["file", "alias"], "left_anti").select("file", "ord", "path", "alias")


# Words in a package's path that tell its tier, outer tiers looked for first.
TIER_WORDS = {
    2: "handler controller http api grpc infra adapter repository persistence delivery transport".split(),
    1: "service usecase application /app/".split(),
    0: "domain core model entity".split(),
}
#: Hosts whose packages lie outside a tree whatever its module is called.
HOSTS = ("github.com", "golang.org", "google.golang.org")


def package_tier(path: Column) -> Column:
    """2 outer, 1 middle, 0 inner, -1 none of them, by the words in a path."""
    low, out = F.lower(path), F.when(F.lit(False), F.lit(0))
    for level, words in TIER_WORDS.items():
        for word in words:
            out = out.when(low.contains(word), F.lit(level))
    return out.otherwise(F.lit(-1))


def import_class(path: Column, module: str | None, work_modules: list[str] | None = None) -> Column:
    """`module` (the tree's own), `workspace` (another module of it), `stdlib` (no dot in the first segment) or
    `external`."""
    below = lambda m: (path == m) | path.startswith(f"{m}/")
    out = F.when(below(module) if module else F.lit(False), "module")
    for m in work_modules or []:
        out = out.when(below(m) if m else F.lit(False), "workspace")
    return out.when(~F.split(path, "/")[0].contains("."), "stdlib").otherwise("external")


def is_external(path: Column) -> Column:
    """Whether a path leads out of the tree: no relative or absolute path, and either without a dot or on a known host."""
    hosted = F.lit(False)
    for host in HOSTS:
        hosted = hosted | path.contains(host)
    return ~path.rlike("^[./]") & (~path.contains(".") | hosted)


def external_dependencies(imports: DataFrame) -> DataFrame:
    """path, importers: external paths with the number of files that import them."""
    return imports.where(is_external(F.col("path"))).groupBy("path").agg(F.countDistinct("file").alias("importers"))
