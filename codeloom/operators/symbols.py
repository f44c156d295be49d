"""Symbol tables, references and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARED_PACKAGES = 2
SHARED_TARGET = "pkg/shared"
MOST_SIMILAR = 5
MOST_DISTANCE = 2


def symbol_table(symbols: DataFrame) -> DataFrame:
    """Symbols with their signature and visibility."""
    return symbols.withColumns({"signature": F.concat("name", F.lit("("), F.lower("kind"), F.lit(")")), "visibility": F.when(F.col("exported"), "public").otherwise("internal")})


def count_by(symbols: DataFrame, key: str) -> DataFrame:
    return symbols.groupBy(key).agg(F.count("*").alias("symbols"), F.count_if("exported").alias("exported_symbols"))


def find_references(symbols: DataFrame, references: DataFrame, visible: Column) -> DataFrame:
    """References joined to their symbols where the residual condition holds."""
    return references.withColumnRenamed("package", "ref_package").join(symbols, "symbol_id").where(visible)


def reference_counts(symbols: DataFrame, references: DataFrame) -> DataFrame:
    counts = references.groupBy("symbol_id").agg(F.count("*").alias("n"), F.countDistinct("package").alias("p"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return symbols.join(counts, "symbol_id", "left").select("symbol_id", "name", zero(F.col("n")).alias("reference_count"), zero(F.col("p")).alias("ref_packages"))


def has_reference(symbols: DataFrame, references: DataFrame) -> DataFrame:
    return symbols.join(references, "symbol_id", "left_semi")


def unused(symbols: DataFrame, references: DataFrame, declarations: DataFrame) -> DataFrame:
    """Symbols without references, why they count as unused, and whether they can go."""
    free = symbols.join(references, "symbol_id", "left_anti").join(declarations.withColumn("declared", F.lit(True)), "symbol_id", "left")
    reason = F.when(F.col("declared"), "Only referenced in declarations").otherwise("No references found")
    return free.select("symbol_id", "name", "kind", "package", "exported", (~F.col("exported")).alias("safe_to_delete"), reason.alias("reason"))


def shared(references: DataFrame, least: int = SHARED_PACKAGES) -> DataFrame:
    """Symbols that at least `least` packages use."""
    used = references.groupBy("symbol_id").agg(F.array_sort(F.collect_set("package")).alias("p")).where(F.size("p") >= least)
    return used.select("symbol_id", F.size("p").cast("long").alias("packages"), F.array_join("p", ",").alias("package_list"))


def suggested_moves(symbols: DataFrame, references: DataFrame) -> DataFrame:
    moves = shared(references).join(symbols.where("exported"), "symbol_id")
    reason = F.concat(F.lit("used by "), F.col("packages").cast("string"), F.lit(" packages"))
    return moves.select("symbol_id", "name", F.col("package").alias("from_package"), F.lit(SHARED_TARGET).alias("to_package"), reason.alias("reason"), F.col("package_list").alias("referencing_packages"))


def implementations(methods: DataFrame, wanted: DataFrame) -> DataFrame:
    """Relational division: types that have all wanted methods."""
    n = wanted.agg(F.countDistinct("method").alias("n"))
    have = methods.join(wanted, "method", "left_semi").groupBy("type").agg(F.countDistinct("method").alias("methods"))
    return have.join(n, F.col("methods") == F.col("n")).select("type", "methods")


def missing_methods(methods: DataFrame, wanted: DataFrame) -> DataFrame:
    """(type, method) that a type lacks, by counting down from the wanted ones: no pairs of types are formed."""
    names = wanted.agg(F.array_sort(F.collect_set("method")).alias("all"))
    have = methods.groupBy("type").agg(F.collect_set("method").alias("own"))
    return have.join(F.broadcast(names)).select("type", F.explode(F.array_except("all", "own")).alias("method"))


def method_set(own: DataFrame, embeds: DataFrame) -> DataFrame:
    """Own and promoted methods: those of embedded types count as the type's."""
    promoted = embeds.join(own.withColumnRenamed("type", "embedded"), "embedded").select("type", "method")
    return own.union(promoted).distinct()


def similar_names(names: DataFrame, most: int = MOST_DISTANCE, limit: int = MOST_SIMILAR) -> DataFrame:
    """Nearest distinct names within an edit distance. A name is cut into most + 1 parts; of these one stands whole, and
    shifted by at most `most` places, in any name that near. So names meet by parts, and only those shorter than their
    number of parts meet by length alone."""
    n = names.select("name").distinct().withColumn("size", F.length("name"))
    i = F.col("i")
    begin, stop = F.floor(F.col("of") * i / (most + 1)).cast("int"), F.floor(F.col("of") * (i + 1) / (most + 1)).cast("int")
    each = n.withColumn("of", F.col("size")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(most))))
    parts = each.select(F.col("name").alias("similar"), "of", "i", F.substring("name", begin + 1, stop - begin).alias("part"))
    probe = n.withColumn("of", F.explode(F.sequence(F.greatest(F.col("size") - most, F.lit(0)), F.col("size") + most))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(most))))
    probe = probe.withColumn("b", begin).withColumn("w", stop - begin)
    shift = F.sequence(F.greatest(F.col("b") - most, F.lit(0)), F.greatest(F.col("b") - most, F.lit(0), F.least(F.col("b") + most, F.col("size") - F.col("w"))))
    probe = probe.withColumn("at", F.explode(shift)).select("name", "of", "i", F.substring("name", F.col("at") + 1, F.col("w")).alias("part")).distinct()
    met = probe.join(parts, ["of", "i", "part"]).where("name <> similar").select("name", "similar").distinct()
    near = met.withColumn("distance", F.levenshtein("name", "similar").cast("long")).where(F.col("distance") <= most)
    rank = F.row_number().over(Window.partitionBy("name").orderBy("distance", "similar"))
    return near.withColumn("rank", rank).where(F.col("rank") <= limit).select("name", "similar", "distance")


def affected_by_move(symbols: DataFrame, references: DataFrame, target: Column) -> DataFrame:
    """symbol_id, file, line, package, why: references that moving their symbols to the target package affects: those of
    unexported symbols, and all from a third package."""
    out = find_references(symbols, references, F.col("ref_package") != target)
    row = lambda df, why: df.select("symbol_id", "file", "line", F.col("ref_package").alias("package"), F.lit(why).alias("why"))
    return row(out.where(~F.col("exported")), "unexported").unionAll(row(out, "third package"))


def affected_by_rename(symbols: DataFrame, references: DataFrame, name: Column) -> DataFrame:
    """symbol_id, file, line, package of the references to symbols of a name."""
    out = find_references(symbols, references, F.col("name") == name)
    return out.select("symbol_id", "file", "line", F.col("ref_package").alias("package"))


def cross_package_edges(symbols: DataFrame, references: DataFrame) -> DataFrame:
    """src_package (of the symbol), dst_package (of the reference), refs."""
    out = find_references(symbols, references, F.col("package") != F.col("ref_package"))
    return out.groupBy(F.col("package").alias("src_package"), F.col("ref_package").alias("dst_package")).agg(F.count("*").alias("refs"))


def facade(symbols: DataFrame) -> DataFrame:
    """The re-exports of each package."""
    word = F.when(F.col("kind").isin("SMALL", "MEDIUM"), "var").when(F.col("kind") == "LARGE", "const").otherwise("type")
    line = F.concat(word, F.lit(" "), F.regexp_replace("name", " ", "_"), F.lit(" = "), F.col("package"))
    found = symbols.where("exported").select("package", line.alias("line")).distinct()
    return found.groupBy("package").agg(F.array_join(F.array_sort(F.collect_list("line")), ";").alias("exports"), F.count("*").alias("export_count"))
