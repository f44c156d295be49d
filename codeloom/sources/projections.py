"""Facts of the code model, projected from tables that hold no source code: symbols, references, package edges, lines,
imports, changes, file events, batches, functions and methods."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.sources.tables import table

EXPORTED_PRICE = 950.0
#: Edges kept for each package: those with the most references.
EDGES_PER_PACKAGE = 2
HREF = 'href="([^"]*)"'


def symbols(spark: SparkSession, folder: str) -> DataFrame:
    """symbol_id, name, kind, package, size, exported."""
    p = table(spark, folder, "part")
    return p.select(F.col("p_partkey").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("package"), F.col("p_size").alias("size"), (F.col("p_retailprice") >= EXPORTED_PRICE).alias("exported"))


def references(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    """symbol_id, package (of the occurrence), file, line: few lineitems, so that some symbols are unused, or all."""
    rows = table(spark, folder, "lineitem")
    rows = rows if whole else rows.where("l_returnflag = 'R' and l_linenumber = 1 and l_quantity < 10")
    s = table(spark, folder, "supplier").select("s_suppkey", "s_nationkey")
    n = table(spark, folder, "nation").select("n_nationkey", "n_name")
    rows = rows.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber").join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("l_partkey").alias("symbol_id"), F.col("n_name").alias("package"), F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("line"))


def declarations(spark: SparkSession, folder: str) -> DataFrame:
    """symbol_id of symbols that further declarations mention."""
    return table(spark, folder, "lineitem").where("l_returnflag = 'N' and l_linenumber = 2 and l_quantity < 4").select(F.col("l_partkey").alias("symbol_id")).distinct()


def package_edges(spark: SparkSession, folder: str, most: int | None = EDGES_PER_PACKAGE) -> DataFrame:
    """src, dst, weight: where customers of one nation buy from suppliers of another, the strongest edges of each, or
    all (None)."""
    c = table(spark, folder, "customer").select("c_custkey", F.col("c_nationkey").alias("src"))
    o = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    s = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey")
    rows = lines.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    counted = rows.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("weight"))
    place = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    top = counted if most is None else counted.withColumn("place", place).where(F.col("place") <= most)
    name = lambda c: F.concat(F.lit("NATION_"), F.col(c).cast("string")).alias(c)
    return top.select(name("src"), name("dst"), "weight", F.col("src").alias("src_key"), F.col("dst").alias("dst_key"))


def dag_edges(spark: SparkSession, folder: str) -> DataFrame:
    return package_edges(spark, folder).where("src_key > dst_key")


def layers(spark: SparkSession, folder: str) -> DataFrame:
    """package, layer, tier."""
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("package"), F.col("r_name").alias("layer"), F.col("r_regionkey").cast("int").alias("tier"))


def files(spark: SparkSession, folder: str) -> DataFrame:
    """file, path, content."""
    d = table(spark, folder, "documents")
    return d.select(F.col("doc_id").alias("file"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("content"))


def lines(spark: SparkSession, folder: str) -> DataFrame:
    """file, line (from 1), text."""
    return files(spark, folder).select("file", F.posexplode(F.split("content", "\n")).alias("at", "text")).select("file", (F.col("at") + 1).alias("line"), "text")


def imports(spark: SparkSession, folder: str) -> DataFrame:
    """file, ord (from 1), path, alias: the links of a page; the alias is the path's last segment."""
    found = table(spark, folder, "pages").select(F.col("page_id").alias("file"), F.posexplode(F.regexp_extract_all("html", F.lit(HREF), F.lit(1))).alias("at", "path"))
    return found.select("file", (F.col("at") + 1).alias("ord"), "path", F.element_at(F.split("path", "/"), -1).alias("alias"))


def changes(spark: SparkSession, folder: str) -> DataFrame:
    """file, seq, start, end."""
    e = table(spark, folder, "events")
    start = F.floor(F.round(F.col("value") * 10, 3)).cast("long")
    size = F.get_json_object("props", "$.k").cast("long") % 7
    return e.select(F.col("user_id").alias("file"), F.col("event_id").alias("seq"), start.alias("start"), (start + size).alias("end"), F.col("event_type").alias("description"))


def file_events(spark: SparkSession, folder: str) -> DataFrame:
    """path, op, ts, event_id."""
    return table(spark, folder, "events").select(F.col("user_id").alias("path"), F.col("event_type").alias("op"), "ts", "event_id")


def batches(spark: SparkSession, folder: str) -> DataFrame:
    """batch, step, op."""
    return table(spark, folder, "conversations").select(F.col("conv_id").alias("batch"), F.col("turn").alias("step"), F.col("role").alias("op"))


def functions(spark: SparkSession, folder: str) -> DataFrame:
    """func_id, branch (whether the node branches), depth, kind: one row for each node."""
    line = table(spark, folder, "lineitem")
    return line.select(F.col("l_orderkey").alias("func_id"), (F.col("l_returnflag") != "N").alias("branch"), F.col("l_linenumber").alias("depth"), F.col("l_returnflag").alias("kind"), "l_suppkey")


def methods(spark: SparkSession, folder: str, whole: bool = False) -> DataFrame:
    """type, method: distinct, of few lineitems or of all."""
    line = table(spark, folder, "lineitem")
    line = (line if whole else line.where("l_quantity < 3")).select("l_suppkey", "l_partkey")
    part = table(spark, folder, "part").select("p_partkey", "p_type")
    return line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_suppkey").alias("type"), F.col("p_type").alias("method")).distinct()
