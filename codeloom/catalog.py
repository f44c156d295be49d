"""The query catalogue over the given tables, each query with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import analyzers as A
from codeloom.operators import graph as G
from codeloom.operators import imports as I
from codeloom.operators import symbols as S
from codeloom.plans import changes as C
from codeloom.sources import projections as P
from codeloom.streaming import watch as W

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

LAYERS = [("/The", 1), ("/the", 2), ("/de", 2), ("/in", 3)]
RULES = [(1, "tion", "t_alias"), (2, "er", "er_alias"), (3, "a", "a_alias")]
TARGET = "NATION_3"
SYM = f"sym AS (SELECT p_partkey AS symbol_id, p_name AS name, p_type AS kind, p_brand AS package, p_size AS size, p_retailprice >= {P.EXPORTED_PRICE} AS exported FROM part)"
REF = "ref AS (SELECT l_partkey AS symbol_id, n_name AS package, l_orderkey AS file, l_linenumber AS line FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE l_returnflag = 'R' AND l_linenumber = 1 AND l_quantity < 10)"
DECL = "decl AS (SELECT DISTINCT l_partkey AS symbol_id FROM lineitem WHERE l_returnflag = 'N' AND l_linenumber = 2 AND l_quantity < 4)"
EDGE = f"""cnt AS (SELECT c_nationkey AS s, s_nationkey AS d, count(*) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
edge AS (SELECT 'NATION_' || s AS src, 'NATION_' || d AS dst, weight, s, d FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY weight DESC, d) AS r FROM cnt) WHERE r <= {P.EDGES_PER_PACKAGE})"""
REACH = f"{EDGE}, reach AS (SELECT src, dst FROM edge UNION SELECT r.src, e.dst FROM reach r JOIN edge e ON r.dst = e.src)"
DAG = f"{EDGE}, dag AS (SELECT src, dst FROM edge WHERE s > d), nodes AS (SELECT src AS node FROM dag UNION SELECT dst FROM dag)"
WALK = f"{DAG}, walk AS (SELECT node, 0 AS level FROM nodes UNION SELECT g.src, w.level + 1 FROM dag g JOIN walk w ON g.dst = w.node), lev AS (SELECT node, CAST(max(level) AS BIGINT) AS level FROM walk GROUP BY node)"
LAY = "lay AS (SELECT n_name AS package, r_name AS layer, CAST(r_regionkey AS INTEGER) AS tier FROM nation JOIN region ON n_regionkey = r_regionkey)"
LINE = "ls AS (SELECT doc_id AS file, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL), line AS (SELECT file, CAST(unnest(range(1, len(a) + 1)) AS INTEGER) AS line, unnest(a) AS text FROM ls)"
IMP = f"ia AS (SELECT page_id AS file, regexp_extract_all(html, '{P.HREF}', 1) AS a FROM pages), ip AS (SELECT file, CAST(unnest(range(1, len(a) + 1)) AS INTEGER) AS ord, unnest(a) AS path FROM ia), imp AS (SELECT file, ord, path, string_split(path, '/')[-1] AS alias FROM ip)"
CHG = "chg AS (SELECT user_id AS file, event_id AS seq, CAST(floor(round(value * 10, 3)) AS BIGINT) AS start, CAST(floor(round(value * 10, 3)) AS BIGINT) + CAST(json_extract_string(props, '$.k') AS BIGINT) % 7 AS \"end\", event_type AS description FROM events)"
FN = "fn AS (SELECT l_orderkey AS func_id, l_returnflag <> 'N' AS branch, l_linenumber AS depth, l_returnflag AS kind, l_suppkey FROM lineitem)"
MET = "met AS (SELECT DISTINCT l_suppkey AS type, p_type AS method FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity < 3)"


def query(sql: str | None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {SYM} SELECT *, name || '(' || lower(kind) || ')' AS signature, CASE WHEN exported THEN 'public' ELSE 'internal' END AS visibility FROM sym")
def q01_symbol_table(spark, d):
    return S.symbol_table(P.symbols(spark, d))


@query(f"WITH {SYM} SELECT package, count(*) AS symbols, count(*) FILTER (WHERE exported) AS exported_symbols FROM sym GROUP BY package")
def q02_symbols_by_package(spark, d):
    return S.count_by(P.symbols(spark, d), "package")


@query(f"WITH {SYM} SELECT kind, count(*) AS symbols, count(*) FILTER (WHERE exported) AS exported_symbols FROM sym GROUP BY kind")
def q03_symbols_by_kind(spark, d):
    return S.count_by(P.symbols(spark, d), "kind")


@query(f"WITH {SYM}, {REF} SELECT symbol_id, name, ref.package AS ref_package, file, line, CASE WHEN exported THEN 'public' ELSE 'internal' END AS visibility FROM ref JOIN sym USING (symbol_id)")
def q04_find_references(spark, d):
    out = S.find_references(S.symbol_table(P.symbols(spark, d)), P.references(spark, d), F.lit(True))
    return out.select("symbol_id", "name", "ref_package", "file", "line", "visibility")


@query(f"WITH {SYM}, {REF} SELECT sym.symbol_id, name, count(ref.symbol_id) AS reference_count, count(DISTINCT ref.package) AS ref_packages FROM sym LEFT JOIN ref ON sym.symbol_id = ref.symbol_id GROUP BY 1, 2")
def q05_reference_counts(spark, d):
    return S.reference_counts(P.symbols(spark, d), P.references(spark, d))


@query(f"WITH {SYM}, {REF} SELECT symbol_id, name FROM sym WHERE symbol_id IN (SELECT symbol_id FROM ref)")
def q06_has_reference(spark, d):
    return S.has_reference(P.symbols(spark, d), P.references(spark, d)).select("symbol_id", "name")


UNUSED = f"WITH {SYM}, {REF}, {DECL}, un AS (SELECT symbol_id, name, kind, package, exported, NOT exported AS safe_to_delete, CASE WHEN symbol_id IN (SELECT symbol_id FROM decl) THEN 'Only referenced in declarations' ELSE 'No references found' END AS reason FROM sym WHERE symbol_id NOT IN (SELECT symbol_id FROM ref))"


@query(f"{UNUSED} SELECT * FROM un")
def q07_unused_symbols(spark, d):
    return S.unused(P.symbols(spark, d), P.references(spark, d), P.declarations(spark, d))


@query(f"{UNUSED} SELECT * FROM un WHERE NOT exported")
def q08_unused_unexported(spark, d):
    return q07_unused_symbols(spark, d).where(~F.col("exported"))


SHARED = f"WITH {SYM}, {REF}, sh AS (SELECT symbol_id, count(DISTINCT package) AS packages, string_agg(DISTINCT package, ',' ORDER BY package) AS package_list FROM ref GROUP BY symbol_id HAVING count(DISTINCT package) >= 2)"


@query(f"{SHARED} SELECT * FROM sh")
def q09_shared_symbols(spark, d):
    return S.shared(P.references(spark, d))


@query(f"{SHARED} SELECT symbol_id, name, package AS from_package, 'pkg/shared' AS to_package, 'used by ' || packages || ' packages' AS reason, package_list AS referencing_packages FROM sh JOIN sym USING (symbol_id) WHERE exported")
def q10_suggested_moves(spark, d):
    return S.suggested_moves(P.symbols(spark, d), P.references(spark, d))


DEGREES = f"WITH {EDGE}, o AS (SELECT src AS node, count(*) AS outgoing FROM edge GROUP BY 1), i AS (SELECT dst AS node, count(*) AS incoming FROM edge GROUP BY 1), deg AS (SELECT node, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing FROM o FULL JOIN i USING (node))"


@query(f"{DEGREES}, k AS (SELECT n_name AS node, count(*) AS symbol_count FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1) SELECT node AS package, incoming AS incoming_deps, outgoing AS outgoing_deps, coalesce(symbol_count, 0) AS symbol_count FROM deg LEFT JOIN k USING (node)")
def q11_package_coupling(spark, d):
    n = P.table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("node"))
    counts = P.table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("node").agg(F.count("*").alias("symbol_count"))
    deg = G.degrees(P.package_edges(spark, d)).join(counts, "node", "left")
    return deg.select(F.col("node").alias("package"), F.col("incoming").alias("incoming_deps"), F.col("outgoing").alias("outgoing_deps"), F.coalesce("symbol_count", F.lit(0)).cast("long").alias("symbol_count"))


@query(f"WITH {EDGE} SELECT dst AS package, weight FROM edge WHERE src = '{TARGET}'")
def q12_direct_deps(spark, d):
    return G.dependencies(P.package_edges(spark, d), TARGET).select("package", "weight")


@query(f"WITH {EDGE}, t AS (SELECT dst AS t, count(*) AS n FROM edge GROUP BY 1 ORDER BY n DESC, t LIMIT 1) SELECT src AS package, weight FROM edge WHERE dst = (SELECT t FROM t)")
def q13_dependents(spark, d):
    e = P.package_edges(spark, d)
    most = e.groupBy("dst").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dst").limit(1)
    return G.dependents(e, most).select("package", "weight")


@query(f"WITH RECURSIVE {REACH} SELECT src, dst FROM reach WHERE src <> dst")
def q14_transitive_deps(spark, d):
    return G.transitive_deps(P.package_edges(spark, d))


@query(f"WITH RECURSIVE {REACH}, m AS (SELECT a.src AS node, min(a.dst) AS cycle FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1) SELECT cycle, string_agg(node, ',' ORDER BY node) AS members, count(*) AS size FROM m GROUP BY cycle")
def q15_cycles(spark, d):
    return G.cycles(P.package_edges(spark, d))


@query(f"WITH RECURSIVE {REACH}, pk AS (SELECT n_name AS package, n_regionkey FROM nation), cand AS (SELECT a.package AS src, b.package AS dst FROM pk a JOIN pk b ON a.n_regionkey = b.n_regionkey AND a.package <> b.package) SELECT src, dst FROM cand WHERE EXISTS (SELECT 1 FROM reach r WHERE r.src = cand.dst AND r.dst = cand.src)")
def q16_would_create_cycle(spark, d):
    n = P.table(spark, d, "nation")
    a, b = n.select("n_regionkey", F.col("n_name").alias("src")), n.select("n_regionkey", F.col("n_name").alias("dst"))
    return G.would_create_cycle(P.package_edges(spark, d), a.join(b, "n_regionkey").where("src <> dst").select("src", "dst"))


@query(f"WITH RECURSIVE {WALK} SELECT * FROM lev")
def q17_levels(spark, d):
    return G.levels(P.dag_edges(spark, d))


@query(f"WITH RECURSIVE {WALK} SELECT node, level, row_number() OVER (ORDER BY level DESC, node) AS place FROM lev")
def q18_topo_order(spark, d):
    return G.topological_order(P.dag_edges(spark, d))


METRICS = f"{DEGREES}, al AS (SELECT n_name AS node FROM nation), m AS (SELECT count(*) AS total_nodes, CAST(sum(coalesce(outgoing, 0)) AS BIGINT) AS total_edges, round(avg(coalesce(outgoing, 0)), 6) AS average_deps, max(coalesce(outgoing, 0)) AS max_deps, count(*) FILTER (WHERE coalesce(outgoing, 0) = 0) AS nodes_without_deps FROM al LEFT JOIN deg USING (node))"


@query(f"{METRICS} SELECT * FROM m")
def q19_graph_metrics(spark, d):
    return G.metrics(P.package_edges(spark, d), P.table(spark, d, "nation").select(F.col("n_name").alias("node")))


@query(METRICS.replace("WITH", "WITH RECURSIVE", 1) + ", reach AS (SELECT src, dst FROM edge UNION SELECT r.src, e.dst FROM reach r JOIN edge e ON r.dst = e.src) SELECT m.*, (SELECT count(*) FROM edge e WHERE EXISTS (SELECT 1 FROM reach r WHERE r.src = e.dst AND r.dst = e.src)) AS cyclical_edges FROM m")
def q20_import_metrics(spark, d):
    return G.import_metrics(P.package_edges(spark, d), P.table(spark, d, "nation").select(F.col("n_name").alias("node")))


@query(f"WITH {SYM}, {REF} SELECT sym.package AS src_package, ref.package AS dst_package, count(*) AS refs FROM ref JOIN sym USING (symbol_id) WHERE sym.package <> ref.package GROUP BY 1, 2")
def q21_cross_package_edges(spark, d):
    return S.cross_package_edges(P.symbols(spark, d), P.references(spark, d))


@query(f"WITH {SYM}, {REF}, j AS (SELECT symbol_id, exported, file, line, ref.package AS p FROM ref JOIN sym USING (symbol_id)) SELECT symbol_id, file, line, p AS package, 'unexported' AS why FROM j WHERE NOT exported AND p <> '{TARGET}' UNION ALL SELECT symbol_id, file, line, p, 'third package' FROM j WHERE p <> '{TARGET}'")
def q22_affected_by_move(spark, d):
    return S.affected_by_move(P.symbols(spark, d), P.references(spark, d), F.lit(TARGET))


@query(f"WITH {SYM}, {REF} SELECT symbol_id, file, line, ref.package AS package FROM ref JOIN sym USING (symbol_id) WHERE name = 'small ring'")
def q23_affected_by_rename(spark, d):
    return S.affected_by_rename(P.symbols(spark, d), P.references(spark, d), F.lit("small ring"))


@query(f"WITH {EDGE} SELECT src, dst, weight FROM edge WHERE src <> '{TARGET}' AND dst <> '{TARGET}'")
def q24_remove_node(spark, d):
    return G.remove_node(P.package_edges(spark, d), spark.createDataFrame([(TARGET,)], "node string")).select("src", "dst", "weight")


@query(f"WITH {EDGE}, {LAY} SELECT src, dst, a.tier AS src_tier, b.tier AS dst_tier FROM edge JOIN lay a ON src = a.package JOIN lay b ON dst = b.package WHERE b.tier > a.tier AND a.tier >= 0")
def q25_backwards_deps(spark, d):
    return G.backwards(P.package_edges(spark, d), P.layers(spark, d)).select("src", "dst", "src_tier", "dst_tier")


TIER = "CASE " + " ".join(f"WHEN starts_with(path, '{p}') THEN {n}" for p, n in LAYERS) + " ELSE 0 END"


@query(f"WITH {IMP} SELECT tier, count(*) AS imports FROM (SELECT {TIER} AS tier FROM imp) GROUP BY tier")
def q26_layer_classify(spark, d):
    return P.imports(spark, d).groupBy(I.tier(F.col("path"), LAYERS, 0).alias("tier")).agg(F.count("*").alias("imports"))


@query(f"WITH {IMP}, t AS (SELECT file, path, ord, {TIER} AS tier FROM imp) SELECT *, row_number() OVER (PARTITION BY file ORDER BY tier, path, ord) AS place FROM t")
def q27_import_order(spark, d):
    return I.ordered(P.imports(spark, d), LAYERS, 0)


@query(f"WITH {LINE} SELECT file, line, CAST(coalesce(sum(octet_length(encode(text)) + 1) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM line")
def q28_line_offsets(spark, d):
    return T.line_offsets(P.lines(spark, d))


@query(f"WITH {LINE} SELECT file, line, trim(text, ' ') AS context FROM line WHERE contains(text, '@')")
def q29_context_lines(spark, d):
    return P.lines(spark, d).where(F.col("text").contains("@")).select("file", "line", F.trim("text").alias("context"))


@query(f"WITH {LINE}, t AS (SELECT file, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)', 1)) AS name FROM line) SELECT name, count(*) AS occurrences, count(DISTINCT file) AS files FROM t GROUP BY name")
def q30_inverted_index(spark, d):
    return T.inverted_index(P.files(spark, d))


@query(f"WITH {CHG}, pos AS (SELECT file, seq AS pos_id, start AS p FROM chg), e AS (SELECT pos.file, pos_id, seq, row_number() OVER (PARTITION BY pos_id ORDER BY \"end\" - start, seq) AS r FROM pos JOIN chg ON pos.file = chg.file AND start <= p AND p < \"end\" AND seq <> pos_id) SELECT file, pos_id, seq AS span FROM e WHERE r = 1")
def q31_enclosing_span(spark, d):
    spans = P.changes(spark, d)
    return C.innermost(spans.select("file", F.col("seq").alias("pos_id"), F.col("start").alias("p")), spans)


@query(f"WITH {IMP}, a AS (SELECT file, left(alias, 1) AS alias, path FROM imp) SELECT file, alias, count(DISTINCT path) AS paths FROM a GROUP BY file, alias HAVING count(DISTINCT path) > 1")
def q32_import_alias_conflicts(spark, d):
    return I.alias_conflicts(P.imports(spark, d).withColumn("alias", F.left("alias", F.lit(1))))


@query(f"WITH {IMP}, g AS (SELECT *, CASE WHEN ord % 2 = 0 THEN alias END AS given FROM imp) SELECT file, ord, path, given FROM g WHERE given = alias AND NOT EXISTS (SELECT 1 FROM g h WHERE h.file = g.file AND h.given IS NULL AND h.alias = g.given)")
def q33_redundant_alias(spark, d):
    return I.redundant(P.imports(spark, d), F.when(F.col("ord") % 2 == 0, F.col("alias")))


@query(f"WITH {IMP}, rules(rule, pattern, new_alias) AS (VALUES {', '.join(map(str, RULES))}), m AS (SELECT file, ord, path, new_alias, row_number() OVER (PARTITION BY file, ord ORDER BY rule) AS n FROM imp JOIN rules ON contains(path, pattern)) SELECT file, ord, path, new_alias FROM m WHERE n = 1")
def q34_standardise_imports(spark, d):
    return I.standardised(P.imports(spark, d), spark.createDataFrame(RULES, "rule int, pattern string, new_alias string"))


@query(f"WITH {IMP}, u AS (SELECT doc_id AS file, unnest(regexp_extract_all(text, '([A-Za-z_][A-Za-z0-9_]*)', 1)) AS alias FROM documents) SELECT file, ord, path, alias FROM imp WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.file = imp.file AND u.alias = imp.alias)")
def q35_unused_imports(spark, d):
    imports = P.imports(spark, d)
    # Only files that import something are looked at, and each identifier of theirs once.
    files = P.files(spark, d).join(imports.select("file").distinct(), "file", "left_semi")
    names = F.array_distinct(F.regexp_extract_all("content", F.lit(f"({T.IDENTIFIER})"), F.lit(1)))
    return I.unused(imports, files.select("file", F.explode(names).alias("alias")))


@query(f"WITH {CHG} SELECT a.file, a.seq AS a_seq, b.seq AS b_seq FROM chg a JOIN chg b ON a.file = b.file AND a.seq < b.seq AND a.start < b.\"end\" AND b.start < a.\"end\"")
def q36_change_overlaps(spark, d):
    return C.overlaps(P.changes(spark, d))


@query(f"WITH {CHG} SELECT a.file, a.seq AS a_seq, b.seq AS b_seq FROM chg a JOIN chg b ON a.file = b.file AND a.seq < b.seq AND ((a.start <= b.start AND b.start < a.\"end\") OR (b.start <= a.start AND a.start < b.\"end\"))")
def q37_conflict_rule_b(spark, d):
    return C.conflicts(P.changes(spark, d))


@query(f"WITH {CHG}, f AS (SELECT *, CASE WHEN start > max(\"end\") OVER (PARTITION BY file ORDER BY start, \"end\", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 WHEN row_number() OVER (PARTITION BY file ORDER BY start, \"end\", seq) = 1 THEN 1 ELSE 0 END AS new FROM chg), i AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY start, \"end\", seq) AS island FROM f) SELECT file, min(start) AS start, max(\"end\") AS \"end\", count(*) AS changes, string_agg(description, '; ' ORDER BY start, \"end\", seq) AS description FROM i GROUP BY file, island")
def q38_merge_changes(spark, d):
    return C.merged(P.changes(spark, d))


@query(f"WITH {CHG} SELECT file, seq, row_number() OVER (PARTITION BY file ORDER BY start DESC, seq DESC) AS apply_order FROM chg")
def q39_sort_changes(spark, d):
    return C.apply_order(P.changes(spark, d))


@query(f"WITH {CHG} SELECT file, seq, 'invalid position' AS issue FROM chg WHERE start < 0 OR \"end\" < start + 1")
def q40_invalid_bounds(spark, d):
    return C.invalid(P.changes(spark, d), shortest=1)


@query("WITH f AS (SELECT doc_id AS file, trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g'), ' ') AS t FROM documents) SELECT file, CASE WHEN length(t) > 80 THEN substr(t, 1, 77) || '...' ELSE t END AS preview FROM f")
def q41_preview_text(spark, d):
    return P.files(spark, d).select("file", T.preview(F.col("content")).alias("preview"))


@query(f"WITH {LINE}, s AS (SELECT * FROM line WHERE trim(text, ' ') <> ''), o AS (SELECT file, line, text AS old_text FROM s WHERE file + 1 IN (SELECT doc_id FROM documents)), n AS (SELECT file - 1 AS file, line, text AS new_text FROM s WHERE file - 1 IN (SELECT doc_id FROM documents)) SELECT file, line, old_text, new_text FROM o FULL JOIN n USING (file, line) WHERE old_text IS DISTINCT FROM new_text")
def q42_line_diff(spark, d):
    """Each document against the next, where there is one."""
    lines, ids = P.lines(spark, d), P.files(spark, d).select("file")
    old = lines.join(ids.select((F.col("file") - 1).alias("file")), "file", "left_semi")
    new = lines.join(ids.select((F.col("file") + 1).alias("file")), "file", "left_semi").withColumn("file", F.col("file") - 1)
    return C.line_diff(old, new)


@query(f"WITH {CHG} SELECT file, count(*) AS change_count FROM chg GROUP BY file")
def q43_affected_files(spark, d):
    return C.affected_files(P.changes(spark, d))


CPX = f"WITH {FN}, c AS (SELECT func_id, count(*) FILTER (WHERE branch) + 1 AS cyclomatic_complexity, CAST(sum(CASE WHEN branch THEN 1 + depth ELSE 0 END) AS BIGINT) AS cognitive_complexity, CAST(max(depth) AS BIGINT) AS max_nesting_depth, count(*) AS lines_of_code FROM fn GROUP BY func_id)"
LEVEL = "CASE WHEN cyclomatic_complexity >= 20 THEN 'extreme' WHEN cyclomatic_complexity >= 15 THEN 'very_high' WHEN cyclomatic_complexity >= 10 THEN 'high' WHEN cyclomatic_complexity >= 5 THEN 'moderate' ELSE 'low' END"


@query(f"{CPX} SELECT * FROM c WHERE cyclomatic_complexity >= 5")
def q44_complexity(spark, d):
    return A.complexity(P.functions(spark, d)).where("cyclomatic_complexity >= 5")


@query(f"{CPX} SELECT {LEVEL} AS level, count(*) AS functions FROM c GROUP BY 1")
def q45_complexity_levels(spark, d):
    return A.complexity(P.functions(spark, d)).groupBy(A.complexity_level(F.col("cyclomatic_complexity")).alias("level")).agg(F.count("*").alias("functions"))


@query(f"{CPX} SELECT func_id, cognitive_complexity FROM c WHERE cognitive_complexity >= 20")
def q46_cognitive(spark, d):
    return A.complexity(P.functions(spark, d)).where("cognitive_complexity >= 20").select("func_id", "cognitive_complexity")


@query(f"WITH {FN} SELECT func_id, kind AS source, count(DISTINCT l_suppkey) AS branch_count FROM fn GROUP BY 1, 2 HAVING count(DISTINCT l_suppkey) >= 3")
def q47_boolean_groups(spark, d):
    assigns = P.functions(spark, d).select("func_id", F.col("kind").alias("source"), F.col("l_suppkey").alias("variable"))
    return A.boolean_groups(assigns, 3)


@query("SELECT conv_id AS batch, string_agg(role, '>' ORDER BY turn, role) AS call_chain, count(*) - 1 AS propagation_depth FROM conversations GROUP BY conv_id HAVING count(*) >= 2")
def q48_env_propagation(spark, d):
    return A.propagation(P.batches(spark, d))


@query(f"WITH {MET} SELECT type, count(DISTINCT method) AS methods FROM met GROUP BY type HAVING count(DISTINCT method) = (SELECT count(DISTINCT p_type) FROM part)")
def q49_interface_impls(spark, d):
    return S.implementations(P.methods(spark, d), P.table(spark, d, "part").select(F.col("p_type").alias("method")))


@query(f"WITH {MET} SELECT t.type, m.method FROM (SELECT DISTINCT type FROM met) t, (SELECT DISTINCT p_type AS method FROM part) m WHERE NOT EXISTS (SELECT 1 FROM met x WHERE x.type = t.type AND x.method = m.method)")
def q50_missing_methods(spark, d):
    return S.missing_methods(P.methods(spark, d), P.table(spark, d, "part").select(F.col("p_type").alias("method")))


@query(f"WITH {MET} SELECT type, method FROM met UNION SELECT s_suppkey, method FROM supplier JOIN met ON type = s_suppkey + 1")
def q51_method_set_union(spark, d):
    embeds = P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("type"), (F.col("s_suppkey") + 1).alias("embedded"))
    return S.method_set(P.methods(spark, d), embeds)


@query(f'''WITH {SYM}, n AS (SELECT DISTINCT name FROM sym), x AS (SELECT a.name, b.name AS "similar", levenshtein(a.name, b.name) AS distance FROM n a, n b WHERE a.name <> b.name), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY distance, "similar") AS k FROM x WHERE distance <= 4) SELECT name, "similar", distance FROM r WHERE k <= 5''')
def q52_similar_names(spark, d):
    return S.similar_names(P.symbols(spark, d), most=4)


@query("SELECT conv_id AS batch, turn AS step, role AS op, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS place FROM conversations")
def q53_batch_steps(spark, d):
    place = F.row_number().over(Window.partitionBy("batch").orderBy("step", "op")).cast("long")
    return P.batches(spark, d).withColumn("place", place)


@query(f"WITH {CHG}, p AS (SELECT a.seq AS x, b.seq AS y, a.file FROM chg a JOIN chg b ON a.file = b.file AND a.seq < b.seq AND a.start < b.\"end\" AND b.start < a.\"end\") SELECT file, count(*) AS conflicts FROM p WHERE x % 10 <> y % 10 GROUP BY file")
def q54_batch_conflicts(spark, d):
    return C.overlaps(P.changes(spark, d)).where("a_seq % 10 <> b_seq % 10").groupBy("file").agg(F.count("*").alias("conflicts"))


@query("WITH l AS (SELECT user_id AS path, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (ORDER BY ts, event_id) <= 60000000 THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, CAST(sum(new) OVER (ORDER BY ts, event_id) AS BIGINT) AS session FROM l) SELECT session, min(ts) AS session_start, max(ts) AS session_end, count(*) AS events, count(DISTINCT path) AS paths FROM s GROUP BY session")
def q55_debounce_sessions(spark, d):
    return W.debounced(P.file_events(spark, d))


@query("SELECT user_id AS path, arg_max(event_type, (ts, event_id)) AS op, max(ts) AS ts FROM events GROUP BY user_id")
def q56_last_op_per_path(spark, d):
    return W.last_op(P.file_events(spark, d))


@query("WITH l AS (SELECT user_id AS file, arg_max(event_type, (ts, event_id)) AS op FROM events GROUP BY user_id) SELECT doc_id AS file, 'kept' AS state FROM documents WHERE doc_id NOT IN (SELECT file FROM l) UNION ALL SELECT file, op FROM l WHERE op <> 'error'")
def q57_incremental_upsert(spark, d):
    updates = W.last_op(P.file_events(spark, d)).select(F.col("path").alias("file"), F.col("op").alias("state"))
    return W.upserted(P.files(spark, d).select("file", F.lit("kept").alias("state")), updates, "file", F.col("state").isin(*W.REMOVING))


@query("SELECT conv_id AS batch, '{\"type\":\"' || role || '\",\"step\":' || turn || '}' AS plan, role AS type, turn AS step FROM conversations")
def q58_plan_json(spark, d):
    plan = P.batches(spark, d).select("batch", F.to_json(F.struct(F.col("op").alias("type"), F.col("step"))).alias("plan"))
    read = plan.withColumn("x", F.from_json("plan", "type string, step long"))
    return read.select("batch", "plan", "x.type", "x.step")


@query(f"WITH {SYM}, l AS (SELECT DISTINCT package, CASE WHEN kind IN ('SMALL', 'MEDIUM') THEN 'var' WHEN kind = 'LARGE' THEN 'const' ELSE 'type' END || ' ' || replace(name, ' ', '_') || ' = ' || package AS line FROM sym WHERE exported) SELECT package, string_agg(line, ';' ORDER BY line) AS exports, count(*) AS export_count FROM l GROUP BY package")
def q59_facade_exports(spark, d):
    return S.facade(P.symbols(spark, d))


@query("WITH t AS (SELECT doc_id AS file, regexp_replace(text, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_])', '\\1Renamed\\2', 'g') AS a FROM documents WHERE contains(text, 'the')), u AS (SELECT file, regexp_replace(a, '(^|[^A-Za-z0-9_])the([^A-Za-z0-9_])', '\\1Renamed\\2', 'g') AS a FROM t) SELECT file, regexp_replace(a, '(^|[^A-Za-z0-9_])the$', '\\1Renamed') AS content FROM u")
def q60_rename_apply(spark, d):
    return P.files(spark, d).where(F.col("content").contains("the")).select("file", T.rename_token(F.col("content"), "the", "Renamed").alias("content"))


# The same reports over all edges and rows, which the projections above cut as the survey's catalogue has them.

REF_ALL = REF.replace(" WHERE l_returnflag = 'R' AND l_linenumber = 1 AND l_quantity < 10", "")
MET_ALL = MET.replace(" WHERE l_quantity < 3", "")
EDGE_ALL = EDGE.replace(f" WHERE r <= {P.EDGES_PER_PACKAGE}", "")


@query(DEGREES.replace(EDGE, EDGE_ALL) + " SELECT node AS package, incoming AS incoming_deps, outgoing AS outgoing_deps FROM deg")
def q61_coupling_all_edges(spark, d):
    deg = G.degrees(P.package_edges(spark, d, None))
    return deg.select(F.col("node").alias("package"), F.col("incoming").alias("incoming_deps"), F.col("outgoing").alias("outgoing_deps"))


@query(f"WITH {SYM}, {REF_ALL} SELECT sym.symbol_id, name, count(ref.symbol_id) AS reference_count, count(DISTINCT ref.package) AS ref_packages FROM sym LEFT JOIN ref ON sym.symbol_id = ref.symbol_id GROUP BY 1, 2")
def q62_reference_counts_all_rows(spark, d):
    return S.reference_counts(P.symbols(spark, d), P.references(spark, d, whole=True))


@query(f"WITH {SYM}, {REF_ALL} SELECT sym.package AS src_package, ref.package AS dst_package, count(*) AS refs FROM ref JOIN sym USING (symbol_id) WHERE sym.package <> ref.package GROUP BY 1, 2")
def q63_cross_package_edges_all_rows(spark, d):
    return S.cross_package_edges(P.symbols(spark, d), P.references(spark, d, whole=True))


@query(f"WITH RECURSIVE {EDGE_ALL}, reach AS (SELECT src, dst FROM edge UNION SELECT r.src, e.dst FROM reach r JOIN edge e ON r.dst = e.src), m AS (SELECT a.src AS node, min(a.dst) AS cycle FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src GROUP BY 1) SELECT cycle, string_agg(node, ',' ORDER BY node) AS members, count(*) AS size FROM m GROUP BY cycle")
def q64_cycles_all_edges(spark, d):
    return G.cycles(P.package_edges(spark, d, None))


@query(METRICS.replace("WITH", "WITH RECURSIVE", 1).replace(EDGE, EDGE_ALL) + ", reach AS (SELECT src, dst FROM edge UNION SELECT r.src, e.dst FROM reach r JOIN edge e ON r.dst = e.src) SELECT m.*, (SELECT count(*) FROM edge e WHERE EXISTS (SELECT 1 FROM reach r WHERE r.src = e.dst AND r.dst = e.src)) AS cyclical_edges FROM m")
def q65_import_metrics_all_edges(spark, d):
    return G.import_metrics(P.package_edges(spark, d, None), P.table(spark, d, "nation").select(F.col("n_name").alias("node")))


@query(SHARED.replace(REF, REF_ALL) + " SELECT * FROM sh")
def q66_shared_symbols_all_rows(spark, d):
    return S.shared(P.references(spark, d, whole=True))


@query(f"WITH {MET_ALL} SELECT type, count(DISTINCT method) AS methods FROM met GROUP BY type HAVING count(DISTINCT method) = (SELECT count(DISTINCT p_type) FROM part)")
def q67_interface_impls_all_rows(spark, d):
    return S.implementations(P.methods(spark, d, whole=True), P.table(spark, d, "part").select(F.col("p_type").alias("method")))


@query(f"WITH {EDGE_ALL}, {LAY} SELECT src, dst, a.tier AS src_tier, b.tier AS dst_tier FROM edge JOIN lay a ON src = a.package JOIN lay b ON dst = b.package WHERE b.tier > a.tier AND a.tier >= 0")
def q68_backwards_deps_all_edges(spark, d):
    return G.backwards(P.package_edges(spark, d, None), P.layers(spark, d)).select("src", "dst", "src_tier", "dst_tier")
