"""Analyzers: tree patterns over syntax nodes."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.golang.facts import children, functions, parameters, source_text
from codeloom.operators.analyzers import complexity_level
from codeloom.sources.workspace import Workspace

MIN_COMPLEXITY = 10
MIN_BRANCHES = 2
MAX_NESTING = 2
MIN_ELSE_LINES = 3
MIN_DEPTH = 1
SEVERITIES = ("critical", "warning", "info")
# Parameter names that stand for an environment, and messages that say nothing.
ENV_NAMES = tuple("istest isprod isproduction isdev isdevelopment islocal isstaging isdebug testmode devmode debugmode prodmode production debug testing".split())
GENERIC = ("", "error", "err", "failed", "failure", "fail", "something went wrong", "unexpected error")


def _in_code(ws: Workspace) -> DataFrame:
    return ws.nodes.join(ws.files.where(~F.col("is_test")).select("file_path"), "file_path", "left_semi")


def _named(ws: Workspace) -> DataFrame:
    return functions(ws).select("file_path", F.col("func_node").alias("func_id"), F.col("name").alias("function"))


def complexity(ws: Workspace, least: int = MIN_COMPLEXITY) -> DataFrame:
    """Functions from `least` on: function, file, line, cyclomatic_complexity, cognitive_complexity, lines_of_code,
    parameters, max_nesting_depth, level."""
    nodes = _in_code(ws).where("func_id is not null and cx_depth is not null")
    one = lambda *kinds: F.col("kind").isin(*kinds).cast("int")
    other = F.when((F.col("edge") == "else") & (F.col("kind") != "IfStmt"), 1).otherwise(0)
    case = F.when((F.col("kind") == "CaseClause") & (F.col("tok") == "case"), 1).otherwise(0)
    clause = one("CommClause")
    default = nodes.where("kind = 'CaseClause' and tok = 'default'").select("file_path", F.col("parent_id").alias("node_id"))
    whole = nodes.where("edge = 'body' and kind = 'BlockStmt'").select("file_path", "node_id", "parent_id")
    closed = whole.join(default, ["file_path", "node_id"], "left_semi").select("file_path", F.col("parent_id").alias("node_id"), F.lit(1).alias("closed"))
    nodes = nodes.join(closed, ["file_path", "node_id"], "left")
    open_switch = F.when(F.col("kind").isin("SwitchStmt", "TypeSwitchStmt") & F.col("closed").isNull(), 1).otherwise(0)
    nested = F.when(F.col("kind").isin("IfStmt", "ForStmt", "RangeStmt", "SwitchStmt", "TypeSwitchStmt", "SelectStmt", "GoStmt", "DeferStmt"), 1 + F.col("cx_depth")).otherwise(0)
    counts = nodes.groupBy("file_path", "func_id").agg((1 + F.sum(one("IfStmt", "ForStmt", "RangeStmt") + other + case + clause + open_switch)).alias("cyclomatic_complexity"), F.sum(nested).alias("cognitive_complexity"), F.max("cx_depth").alias("max_nesting_depth"))
    f = functions(ws).withColumnRenamed("func_node", "func_id")
    rows = counts.join(f, ["file_path", "func_id"]).where(F.col("cyclomatic_complexity") >= least)
    return rows.select(F.col("name").alias("function"), F.col("file_path").alias("file"), "line", "cyclomatic_complexity", "cognitive_complexity", (F.col("body_end_line") - F.col("body_line") + 1).alias("lines_of_code"), F.size("params").alias("parameters"), "max_nesting_depth", complexity_level(F.col("cyclomatic_complexity")).alias("level"))


def if_init(ws: Workspace) -> DataFrame:
    """`if x := f(); cond`: file, line, column, variables, expression, function, and the edit that splits it."""
    nodes = _in_code(ws)
    ifs = nodes.where("kind = 'IfStmt'").select("file_path", "node_id", "line", "col", "start", "func_id")
    rows = children(ifs, nodes.where("kind = 'AssignStmt' and tok = ':='"), "init", "i")
    body = nodes.where("edge = 'body'").select("file_path", F.col("parent_id").alias("node_id"), F.col("start").alias("brace"))
    cond = nodes.where("edge = 'cond'").select("file_path", F.col("parent_id").alias("node_id"), F.col("start").alias("cond_start"))
    side = lambda edge: nodes.where(F.col("edge") == edge).groupBy("file_path", F.col("parent_id").alias("i_node_id")).agg(F.min("start").alias(f"{edge}_start"), F.max("end").alias(f"{edge}_end"))
    rows = rows.join(body, ["file_path", "node_id"]).join(cond, ["file_path", "node_id"]).join(side("lhs"), ["file_path", "i_node_id"]).join(side("rhs"), ["file_path", "i_node_id"])
    rows = rows.join(_named(ws), ["file_path", "func_id"], "left").join(ws.files.select("file_path", "content"), "file_path")
    text = lambda a, b: F.decode(F.substring("content", F.col(a) + 1, F.col(b) - F.col(a)), "UTF-8")
    new = F.concat(text("i_start", "i_end"), F.lit("\n"), F.repeat(F.lit("\t"), F.col("col") - 1), F.lit("if "), F.rtrim(text("cond_start", "brace")), F.lit(" "))
    return rows.select(F.col("file_path").alias("file"), "line", F.col("col").alias("column"), F.split(text("lhs_start", "lhs_end"), r"\s*,\s*").alias("variables"), text("rhs_start", "rhs_end").alias("expression"), "function", "start", F.col("brace").alias("end"), text("start", "brace").alias("old_text"), new.alias("new_text"))


def missing_context(ws: Workspace) -> DataFrame:
    """Functions without a context parameter that make one: file, line, column, function_name, signature, context_calls."""
    nodes = _in_code(ws)
    call = nodes.where("kind = 'CallExpr'").select("file_path", "node_id", "func_id", "start")
    fun = children(call, nodes.where("kind = 'SelectorExpr'"), "fun", "f").select("file_path", "func_id", F.col("f_node_id").alias("node_id"), "start")
    sel = children(fun, nodes.where("text in ('TODO', 'Background')"), "sel", "s").join(nodes.where("edge = 'x' and text = 'context'").select("file_path", F.col("parent_id").alias("node_id")), ["file_path", "node_id"], "left_semi")
    calls = sel.where("func_id is not null").groupBy("file_path", "func_id").agg(F.array_sort(F.collect_list(F.struct("start", F.concat(F.lit("context."), "s_text").alias("t")))).alias("c"))
    f = functions(ws).where("name not in ('main', 'init')").withColumnRenamed("func_node", "func_id")
    has = parameters(ws).where("type_text = 'context.Context'").select("file_path", F.col("func_node").alias("func_id")).distinct()
    rows = f.join(calls, ["file_path", "func_id"]).join(has, ["file_path", "func_id"], "left_anti")
    brace = nodes.where("edge = 'body'").select("file_path", F.col("parent_id").alias("func_id"), F.col("start").alias("brace"))
    rows = source_text(ws.files, rows.join(brace, ["file_path", "func_id"]), "start", "brace", "head")
    return rows.select(F.col("file_path").alias("file"), "line", F.col("col").alias("column"), F.col("name").alias("function_name"), F.rtrim("head").alias("signature"), F.col("c.t").alias("context_calls"))


def boolean_branching(ws: Workspace, least: int = MIN_BRANCHES) -> DataFrame:
    """Booleans compared out of one expression that conditions then branch on."""
    nodes = _in_code(ws)
    assign = nodes.where("kind = 'AssignStmt' and tok in (':=', '=')").select("file_path", "node_id", "func_id", "line", "col", "start")
    single = nodes.where("edge in ('lhs', 'rhs')").groupBy("file_path", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("n")).where("n = 2").select("file_path", "node_id")
    left = children(assign.join(single, ["file_path", "node_id"], "left_semi"), nodes.where("kind = 'Ident'"), "lhs", "l")
    right = nodes.where("edge = 'rhs' and kind = 'BinaryExpr' and tok in ('==', '!=')").select("file_path", F.col("parent_id").alias("node_id"), F.col("node_id").alias("cmp_id"))
    x = nodes.where("edge = 'x'").select("file_path", F.col("parent_id").alias("cmp_id"), F.col("start").alias("x_start"), F.col("end").alias("x_end"))
    rows = left.join(right, ["file_path", "node_id"]).join(x, ["file_path", "cmp_id"])
    rows = source_text(ws.files, rows, "x_start", "x_end", "source")
    groups = rows.groupBy("file_path", "func_id", "source").agg(F.array_sort(F.collect_list(F.struct("start", F.col("l_text").alias("v")))).alias("g"), F.min(F.struct("start", "line", "col")).alias("first")).where(F.size("g") >= least)
    tested = condition_names(nodes)
    members = groups.select("file_path", "func_id", "source", F.explode("g.v").alias("name")).join(tested, ["file_path", "func_id", "name"], "left_semi").select("file_path", "func_id", "source").distinct()
    rows = groups.join(members, ["file_path", "func_id", "source"], "left_semi").join(_named(ws), ["file_path", "func_id"], "left")
    advice = F.concat(F.lit("switch on "), "source", F.lit(" instead of "), F.size("g").cast("string"), F.lit(" booleans"))
    return rows.select(F.col("file_path").alias("file"), F.col("first.line").alias("line"), F.col("first.col").alias("column"), "function", F.col("source").alias("source_variable"), F.col("g.v").alias("boolean_variables"), F.size("g").alias("branch_count"), advice.alias("suggestion"))


def condition_names(nodes: DataFrame) -> DataFrame:
    """(file_path, func_id, name) of identifiers that if-conditions mention through negation, operators and parentheses,
    however deep: the parser marks every node that a condition reaches that way with the condition's statement."""
    return nodes.where("kind = 'Ident' and cond_id is not null").select("file_path", "func_id", F.col("text").alias("name")).distinct()


def error_wrapping(ws: Workspace, severity: str = "critical") -> DataFrame:
    """Returned errors that lose their context, in functions that return an error."""
    nodes = _in_code(ws)
    results = parameters(ws, "results").where("type_text = 'error'").select("file_path", F.col("func_node").alias("func_id")).distinct()
    ret = nodes.where("kind = 'ReturnStmt'").select("file_path", "node_id", "func_id", "line", "col").join(results, ["file_path", "func_id"], "left_semi")
    expr = children(ret, nodes, "result", "r")
    err = lambda c: F.lower(c).rlike("(err|error)$|^err")
    bare = expr.where((F.col("r_kind") == "Ident") & err(F.col("r_text"))).select("file_path", "func_id", "line", "col", "r_start", "r_end", F.lit("bare_return").alias("violation_type"), F.lit("critical").alias("severity"))
    calls = expr.where("r_kind = 'CallExpr'").select("file_path", "func_id", "line", "col", "r_start", "r_end", F.col("r_node_id").alias("node_id"))
    fun = nodes.where("edge = 'fun' and kind = 'SelectorExpr'").select("file_path", F.col("parent_id").alias("node_id"), F.col("node_id").alias("sel_id"))
    which = nodes.where("edge = 'sel' and text = 'Errorf'").select("file_path", F.col("parent_id").alias("sel_id")).join(nodes.where("edge = 'x' and text = 'fmt'").select("file_path", F.col("parent_id").alias("sel_id")), ["file_path", "sel_id"], "left_semi")
    args = nodes.where("edge = 'arg'").groupBy("file_path", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "tok", "text"))).alias("a")).where("size(a) >= 2")
    calls = calls.join(fun, ["file_path", "node_id"]).join(which, ["file_path", "sel_id"], "left_semi").join(args, ["file_path", "node_id"])
    form, last = F.element_at("a", 1), F.element_at("a", -1)
    calls = calls.where((form["kind"] == "BasicLit") & (form["tok"] == "string") & (last["kind"] == "Ident") & err(last["text"])).withColumn("f", form["text"])
    plain = F.rtrim(F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace("f", "^[\"`]|[\"`]$", ""), "%w", "")), "[: ]+$", ""))
    kind = F.when(F.col("f").contains("%v") & ~F.col("f").contains("%w"), "format_verb_v_instead_of_w").when(F.col("f").contains("%w") & F.lower(plain).isin(*GENERIC), "no_context")
    worded = calls.withColumn("violation_type", kind).where("violation_type is not null").select("file_path", "func_id", "line", "col", "r_start", "r_end", "violation_type", F.when(F.col("violation_type") == "no_context", "warning").otherwise("critical").alias("severity"))
    rows = bare.unionByName(worded).where(F.col("severity").isin(*SEVERITIES[: SEVERITIES.index(severity) + 1]))
    rows = source_text(ws.files, rows, "r_start", "r_end", "current_code").join(_named(ws), ["file_path", "func_id"])
    hint = F.lower(F.regexp_replace("function", "(?<=[a-z0-9])(?=[A-Z])", " "))
    fixed = F.when(F.col("violation_type") == "bare_return", F.concat(F.lit('fmt.Errorf("'), hint, F.lit(': %w", '), "current_code", F.lit(")"))).when(F.col("violation_type") == "format_verb_v_instead_of_w", F.replace("current_code", F.lit("%v"), F.lit("%w"))).otherwise(F.col("current_code"))
    return rows.select(F.col("file_path").alias("file"), "line", F.col("col").alias("column"), F.col("function").alias("function_name"), "violation_type", "current_code", hint.alias("context_suggestion"), "severity", F.col("r_start").alias("start"), F.col("r_end").alias("end"), fixed.alias("new_text"))


@dataclass
class Nest:
    """An if statement with else, and what nests in it."""

    node: dict
    depth: int
    happy_depth: int
    else_lines: int
    error_branches: int


def nests(nodes: list[dict], most: int, else_lines: int) -> list[Nest]:
    """The outermost if statements of a function that nest deeper than `most` and have `else_lines` lines of else. An if
    nests in another as a statement of its body or of its else block, or as its else, and counts if it has an else
    itself; lines and branches that return are counted along bodies and chains of else-if."""
    kids: dict[int, list[dict]] = defaultdict(list)
    for n in nodes:
        kids[n["parent_id"]].append(n)
    edge = lambda n, e: next((k for k in kids[n["node_id"]] if k["edge"] == e), None)
    inner = lambda block, kind: [k for k in kids[block["node_id"]] if k["edge"] == "stmt" and k["kind"] == kind] if block is not None else []
    size = lambda block: block["end_line"] - block["line"] + 1
    found: dict[int, Nest] = {}
    # Nodes are numbered from the outside in, so what nests in an if is known before it.
    for n in sorted((n for n in nodes if n["kind"] == "IfStmt"), key=lambda n: -n["node_id"]):
        other, body = edge(n, "else"), edge(n, "body")
        in_body = [found[k["node_id"]] for k in inner(body, "IfStmt")]
        chained = found[other["node_id"]] if other is not None and other["kind"] == "IfStmt" else None
        block = other if other is not None and chained is None else None
        counted = [x for x in [*in_body, *([chained] if chained else []), *(found[k["node_id"]] for k in inner(block, "IfStmt"))] if edge(x.node, "else") is not None]
        lines = 0
        if other is not None:
            lines = (size(block) if block else size(edge(other, "body")) + chained.else_lines) + sum(x.else_lines for x in in_body)
        errors = int(bool(inner(block, "ReturnStmt"))) + (chained.error_branches if chained else 0) + sum(x.error_branches for x in in_body)
        happy = [x.happy_depth for x in in_body if edge(x.node, "else") is not None]
        found[n["node_id"]] = Nest(n, 1 + max((x.depth for x in counted), default=0), 1 + max(happy, default=0), lines, errors)
    out: list[Nest] = []
    for _, nest in sorted(found.items()):
        n = nest.node
        hit = edge(n, "else") is not None and nest.depth > most and nest.else_lines >= else_lines
        if hit and not (out and n["start"] < out[-1].node["end"]):
            out.append(nest)
    return out


def deep_if_else(ws: Workspace, most: int = MAX_NESTING, else_lines: int = MIN_ELSE_LINES) -> DataFrame:
    """If statements that nest deeper than `most`: file, line, column, function_name, nesting_depth, happy_path_depth,
    error_branches, complexity_reduction_estimate, suggestion. Only functions with enough else branches are looked into,
    each in one piece; of a nest the outermost is reported."""
    nodes = _in_code(ws).where("func_id is not null")
    enough = nodes.where("edge = 'else'").groupBy("file_path", "func_id").agg(F.count("*").alias("n")).where(F.col("n") > most)
    rows = nodes.where("kind in ('IfStmt', 'BlockStmt', 'ReturnStmt')").join(enough, ["file_path", "func_id"], "left_semi")
    rows = rows.select("file_path", "func_id", "node_id", "parent_id", "edge", "kind", "start", "end", "line", "col", "end_line")

    def find(part: pd.DataFrame) -> pd.DataFrame:
        file, func = part["file_path"].iloc[0], part["func_id"].iloc[0]
        out = [(file, func, x.node["line"], x.node["col"], x.depth, x.happy_depth, x.error_branches) for x in nests(part.to_dict("records"), most, else_lines)]
        return pd.DataFrame(out, columns=["file_path", "func_id", "line", "col", "depth", "happy", "errors"])

    found = rows.groupBy("file_path", "func_id").applyInPandas(find, "file_path string, func_id int, line int, col int, depth int, happy int, errors int")
    found = found.join(_named(ws), ["file_path", "func_id"], "left")
    gain = F.floor((F.col("depth") - 1) * 100 / F.col("depth")).cast("int")
    return found.select(F.col("file_path").alias("file"), "line", F.col("col").alias("column"), F.col("function").alias("function_name"), F.col("depth").alias("nesting_depth"), F.col("happy").alias("happy_path_depth"), F.col("errors").alias("error_branches"), gain.alias("complexity_reduction_estimate"), F.lit("return early instead of nesting").alias("suggestion"))


def environment_booleans(ws: Workspace, least: int = MIN_DEPTH) -> DataFrame:
    """Boolean parameters named after an environment that are handed on to other functions."""
    nodes = _in_code(ws)
    flags = parameters(ws).where((F.col("type_text") == "bool") & F.lower("name").isin(*ENV_NAMES)).select("file_path", F.col("func_node").alias("func_id"), F.col("name").alias("parameter_name"), "type_text", "name_line", "name_col")
    args = nodes.where("edge = 'arg' and kind = 'Ident'").select("file_path", "func_id", F.col("text").alias("parameter_name"), F.col("parent_id").alias("call_id"))
    fun = nodes.where("edge = 'fun'").select("file_path", F.col("parent_id").alias("call_id"), "start", "end")
    handed = source_text(ws.files, args.join(fun, ["file_path", "call_id"]), "start", "end", "callee")
    chain = flags.join(handed, ["file_path", "func_id", "parameter_name"]).groupBy("file_path", "func_id", "parameter_name", "type_text", "name_line", "name_col").agg(F.array_sort(F.collect_list(F.struct("start", "callee"))).alias("c"))
    rows = chain.join(_named(ws), ["file_path", "func_id"]).where(F.size("c") >= least)
    return rows.select(F.col("file_path").alias("file"), F.col("name_line").alias("line"), F.col("name_col").alias("column"), F.col("function").alias("function_name"), "parameter_name", F.col("type_text").alias("parameter_type"), F.size("c").alias("propagation_depth"), F.concat(F.array("function"), F.col("c.callee")).alias("call_chain"), F.lit("pass behaviour, not the environment's name").alias("suggestion"))


ANALYZERS = {"complexity": complexity, "if_init": if_init, "missing_context": missing_context, "boolean_branching": boolean_branching, "error_wrapping": error_wrapping, "deep_if_else": deep_if_else, "environment_booleans": environment_booleans}
