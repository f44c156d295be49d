"""Changes of signatures: parameters and results of a function, or of a method with its interfaces and
implementations, and every call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.golang import facts
from codeloom.plans.apply import changes
from codeloom.plans.refactor import RefactorError, _identifier
from codeloom.sources.workspace import Workspace

#: Types whose zero value is a number (fixed values of the language).
NUMBERS = "int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 uintptr byte rune float32 float64 complex64 complex128".split()


def zero_value(kind: str) -> str:
    """The text of a type's zero value."""
    kind = kind.strip()
    if kind in NUMBERS:
        return "0"
    if kind in ("string", "bool"):
        return '""' if kind == "string" else "false"
    if kind in ("error", "any") or kind.startswith(("*", "[]", "map[", "chan ", "<-chan", "func(", "interface{", "context.Context")):
        return "nil"
    return f"{kind}{{}}"


def _lists(ws: Workspace, owners: DataFrame) -> DataFrame:
    """owners (file_path, node_id of what has a signature) with sig_start, sig_end, p_start, p_end of the list of
    parameters, r_start, r_end of the results (null: none) and the names and texts of the parameters."""
    sig = facts.children(owners, ws.nodes.where("kind = 'FuncType'"), "type", "sig").withColumnRenamed("node_id", "owner").withColumnRenamed("sig_node_id", "node_id")
    side = lambda edge, p: ws.nodes.where(F.col("edge") == edge).select("file_path", F.col("parent_id").alias("node_id"), F.col("node_id").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"))
    return sig.join(side("params", "p"), ["file_path", "node_id"]).join(side("results", "r"), ["file_path", "node_id"], "left")


def _parameters(ws: Workspace, lists: DataFrame) -> DataFrame:
    """(file_path, owner, names): parameters of each list in order; fields without a name count as one."""
    field = ws.nodes.where("kind = 'Field'").select("file_path", F.col("parent_id").alias("p_id"), F.col("node_id").alias("field_id"), F.col("start").alias("at"))
    name = ws.nodes.where("edge = 'name'").select("file_path", F.col("parent_id").alias("field_id"), F.col("text").alias("name"), F.col("start").alias("n_at"))
    rows = lists.join(field, ["file_path", "p_id"], "left").join(name, ["file_path", "field_id"], "left")
    found = F.array_sort(F.collect_list(F.when(F.col("field_id").isNotNull(), F.struct(F.coalesce("n_at", "at").alias("at"), F.coalesce("name", F.lit("_")).alias("name")))))
    return rows.groupBy("file_path", "owner").agg(found.alias("f")).select("file_path", "owner", F.col("f.name").alias("names"))


def change_signature(ws: Workspace, package: str, name: str, params: list[tuple[str, str]], results: list[str] | None = None, defaults: dict[str, str] | None = None, recv: str | None = None) -> DataFrame:
    """Give a function, a method (recv: its type) or an interface's method (recv: the interface) new parameters (name,
    type) and, unless None, new results (types).

    Parameters keep their arguments by name, in whatever order; a new one gets its text in `defaults` or its type's zero
    value. Added results are returned as zero values, and assignments from the call take `_` for them; dropped ones must
    be the last. Methods change on every interface and type that has one of this name with as many parameters, and at
    every call of the name. Refused: dropping a parameter that a body uses, calls that spread a slice, and uses of a
    changed number of results in the middle of an expression."""
    for n, _ in params:
        _identifier(n) if n != "_" else None
    defaults = defaults or {}
    own = ws.files.where(F.col("dir") == package).select("file_path")
    funcs = facts.functions(ws).select("file_path", F.col("func_node").alias("node_id"), "name", "recv").where(F.col("name") == name)
    first = funcs.where(F.col("recv") == recv if recv else F.col("recv").isNull()).join(own, "file_path", "left_semi").select("file_path", "node_id")
    fields = ws.nodes.where("kind = 'Field'").select("file_path", "node_id")
    inter = facts.children(fields, ws.nodes.where(F.col("text") == name), "name", "n").join(ws.nodes.where("kind = 'FuncType' and edge = 'type'").select("file_path", F.col("parent_id").alias("node_id")), ["file_path", "node_id"], "left_semi").select("file_path", "node_id")
    owner = ws.nodes.where("kind = 'InterfaceType'").select("file_path", F.col("node_id").alias("parent_id"))
    inter = inter.join(ws.nodes.select("file_path", "node_id", "parent_id"), ["file_path", "node_id"]).join(owner, ["file_path", "parent_id"], "left_semi").select("file_path", "node_id")
    if recv and not first.limit(1).count():
        first = inter.join(own, "file_path", "left_semi")
    if not first.limit(1).count():
        raise RefactorError(f"{package} has no {f'{recv}.' if recv else ''}{name}")
    lists = _lists(ws, funcs.where("recv is not null").select("file_path", "node_id").unionByName(inter) if recv else first)
    old = _parameters(ws, _lists(ws, first)).first().names
    known = _parameters(ws, lists).where(F.size("names") == len(old)).select("file_path", "owner")
    lists = lists.join(known, ["file_path", "owner"], "left_semi")
    dropped = [n for n in old if n != "_" and n not in [p for p, _ in params]]
    bodies = lists.select("file_path", F.col("owner").alias("func_id"))
    if dropped:
        inside = ws.nodes.where((F.col("kind") == "Ident") & F.col("text").isin(dropped) & ~F.col("edge").isin("name", "sel", "key")).join(bodies, ["file_path", "func_id"], "left_semi")
        if inside.limit(1).count():
            raise RefactorError(f"{name} uses {', '.join(dropped)}")
    made = f"({', '.join(f'{n} {t}' for n, t in params)})"
    head = facts.source_text(ws.files, lists.select("file_path", F.col("p_start").alias("start"), F.col("p_end").alias("end")), "start", "end", "old_text").withColumn("new_text", F.lit(made))
    parts = [head.select("file_path", "start", "end", "old_text", "new_text")]
    calls = _calls(ws, package, name, recv, len(old))
    if calls.where("spread").limit(1).count():
        raise RefactorError(f"a call of {name} spreads a slice")
    parts.append(_arguments(ws, calls, old, params, defaults))
    if results is not None:
        parts += _results(ws, lists, bodies, calls, name, results)
    edits = reduce(DataFrame.unionByName, parts).where("old_text <> new_text or start = end and new_text <> ''")
    return changes(edits, f"change the signature of {name}")


def _calls(ws: Workspace, package: str, name: str, recv: str | None, n: int) -> DataFrame:
    """(file_path, call_id, start, end, edge, parent_id, fun_end, spread, args) of the calls, those of methods with n arguments."""
    ref = facts.references(ws).where((F.col("name") == name) & (F.col("kind") == "Method" if recv else (F.col("dir") == package) & (F.col("kind") == "Function")))
    fun = ws.nodes.where("edge = 'fun'").select("file_path", F.col("parent_id").alias("call_id"), F.col("end").alias("fun_end"))
    call = ws.nodes.where("kind = 'CallExpr'").select("file_path", F.col("node_id").alias("call_id"), "start", "end", "edge", "parent_id", (F.coalesce("tok", F.lit("")) == "...").alias("spread"))
    args = ws.nodes.where("edge = 'arg'").select("file_path", F.col("parent_id").alias("call_id"), F.col("start").alias("a"), F.col("end").alias("b"))
    rows = ref.select("file_path", F.col("end").alias("fun_end")).distinct().join(fun, ["file_path", "fun_end"]).join(call, ["file_path", "call_id"]).join(args, ["file_path", "call_id"], "left")
    keys = ["file_path", "call_id", "start", "end", "edge", "parent_id", "fun_end", "spread"]
    rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", "b")))).alias("args"))
    return rows.where(F.size("args") == n) if recv else rows


def _arguments(ws: Workspace, calls: DataFrame, old: list[str], params: list[tuple[str, str]], defaults: dict[str, str]) -> DataFrame:
    """Edits of everything between a call's parentheses. Calls that lie in one another's arguments are edited around
    the inner ones: an argument's text is only moved where no other call of the kind stands in it."""
    order = [old.index(p) if p in old and p != "_" else None for p, _ in params]
    rows = calls.join(ws.files.select("file_path", "content"), "file_path")
    text = lambda i: F.decode(F.expr(f"substring(content, args[{i}].a + 1, args[{i}].b - args[{i}].a)"), "UTF-8")
    if [i for i in order if i is not None] == list(range(len(old))):
        # All old arguments stay in their order: new ones are put between them, which nested calls don't mind.
        parts = []
        before: list[str] = []
        for place, i in enumerate(order):
            value = defaults.get(params[place][0], zero_value(params[place][1]))
            if i is None:
                before.append(value)
            elif before:
                at = F.expr(f"args[{i}].a")
                parts.append(rows.where(F.size("args") > i).select("file_path", at.alias("start"), at.alias("end"), F.lit("").alias("old_text"), F.lit(", ".join(before) + ", ").alias("new_text")))
                before = []
        if before:
            at = F.coalesce(F.element_at("args", -1)["b"], F.col("fun_end") + 1) if old else F.col("fun_end") + 1
            lead = ", " if old else ""
            parts.append(rows.select("file_path", at.alias("start"), at.alias("end"), F.lit("").alias("old_text"), F.lit(lead + ", ".join(before)).alias("new_text")))
        empty = rows.select("file_path", "start", "end", F.lit("").alias("old_text"), F.lit("").alias("new_text")).where(F.lit(False))
        return reduce(DataFrame.unionByName, parts, empty)
    inner = calls.select("file_path", F.col("start").alias("i_start"), F.col("end").alias("i_end"))
    if calls.join(inner, "file_path").where("start < i_start and i_end < end and i_start > fun_end").limit(1).count():
        raise RefactorError("calls stand in one another's arguments")
    made = [F.lit(defaults.get(p, zero_value(t))) if i is None else text(i) for (p, t), i in zip(params, order)]
    pieces = [x for m in made for x in (F.lit(", "), m)][1:]
    new = F.concat(*pieces) if pieces else F.lit("")
    a, b = F.col("fun_end") + 1, F.coalesce(F.element_at("args", -1)["b"], F.col("fun_end") + 1)
    rows = rows.withColumn("from", a).withColumn("to", b)
    return rows.select("file_path", F.col("from").alias("start"), F.col("to").alias("end"), F.decode(F.expr("substring(content, from + 1, to - from)"), "UTF-8").alias("old_text"), new.alias("new_text"))


def _last_returns(ws: Workspace, bodies: DataFrame, values: str) -> DataFrame:
    """Edits that return the values at the end of bodies that end in no return statement."""
    block = ws.nodes.where("edge = 'body' and kind = 'BlockStmt'").select("file_path", F.col("parent_id").alias("func_id"), F.col("node_id").alias("block_id"), "line", "end_line", "end").join(bodies, ["file_path", "func_id"], "left_semi")
    stmt = ws.nodes.where("edge = 'stmt'").groupBy("file_path", F.col("parent_id").alias("block_id")).agg(F.max_by("kind", "start").alias("last"))
    rows = block.join(stmt, ["file_path", "block_id"], "left").where("last is null or last <> 'ReturnStmt'")
    one_line = F.col("line") == F.col("end_line")
    after = F.when(F.col("last").isNotNull(), "; ").otherwise(" ")
    new = F.when(one_line, F.concat(after, F.lit(f"return {values} "))).otherwise(F.lit(f"\treturn {values}\n"))
    at = F.col("end") - 1
    return rows.select("file_path", at.alias("start"), at.alias("end"), F.lit("").alias("old_text"), new.alias("new_text"))


def _results(ws: Workspace, lists: DataFrame, bodies: DataFrame, calls: DataFrame, name: str, results: list[str]) -> list[DataFrame]:
    """Edits of result types, of return statements and of the left sides that take a call's results."""
    kinds = ws.nodes.where("kind = 'Field'").select("file_path", F.col("parent_id").alias("r_id"), F.col("node_id").alias("field_id"))
    names = ws.nodes.where("edge = 'name'").groupBy("file_path", F.col("parent_id").alias("field_id")).agg(F.count("*").alias("k"))
    count = lists.join(kinds, ["file_path", "r_id"], "left").join(names, ["file_path", "field_id"], "left").groupBy("file_path", "owner").agg(F.sum(F.when(F.col("field_id").isNotNull(), F.coalesce("k", F.lit(1))).otherwise(0)).alias("n"))
    found = [r.n for r in count.select("n").distinct().collect()]
    if len(found) != 1:
        raise RefactorError(f"declarations of {name} differ in their results")
    had, want = int(found[0]), len(results)
    text = "" if not results else results[0] if want == 1 else f"({', '.join(results)})"
    place = lists.select("file_path", F.coalesce("r_start", "p_end").alias("start"), F.coalesce("r_end", "p_end").alias("end"))
    head = facts.source_text(ws.files, place, "start", "end", "old_text").withColumn("new_text", F.when(F.col("start") == F.col("end"), f" {text}" if text else "").otherwise(text))
    out = [head.select("file_path", "start", "end", "old_text", "new_text")]
    # Return statements of the bodies themselves, closures apart.
    closure = ws.nodes.where("kind = 'FuncLit'").select("file_path", F.col("func_id"), F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    ret = ws.nodes.where("kind = 'ReturnStmt'").join(bodies, ["file_path", "func_id"], "left_semi").select("file_path", "func_id", "node_id", "start", "end")
    ret = ret.join(ret.join(closure, ["file_path", "func_id"]).where("c_start < start and end < c_end").select("file_path", "node_id"), ["file_path", "node_id"], "left_anti")
    values = ws.nodes.where("edge = 'result'").select("file_path", F.col("parent_id").alias("node_id"), F.col("start").alias("a"), F.col("end").alias("b"))
    ret = ret.join(values, ["file_path", "node_id"], "left").groupBy("file_path", "node_id", "start", "end").agg(F.array_sort(F.collect_list(F.when(F.col("a").isNotNull(), F.struct("a", "b")))).alias("v"))
    if ret.where((F.size("v") > 0) & (F.size("v") != had)).limit(1).count():
        raise RefactorError(f"{name} returns another call's results")
    if want > had:
        more = ", ".join(zero_value(t) for t in results[had:])
        at = F.col("end")
        new = F.lit(f" {more}" if had == 0 else f", {more}")
        out.append(ret.where(F.size("v") == had).select("file_path", at.alias("start"), at.alias("end"), F.lit("").alias("old_text"), new.alias("new_text")))
        if had == 0:
            out.append(_last_returns(ws, bodies, more))
    elif want < had:
        keep_to = F.when(F.lit(want == 0), F.col("start") + 6).otherwise(F.expr(f"v[{max(want - 1, 0)}].b"))
        cut = ret.where(F.size("v") == had).withColumn("from", keep_to)
        out.append(facts.source_text(ws.files, cut.select("file_path", F.col("from").alias("start"), "end"), "start", "end", "old_text").withColumn("new_text", F.lit("")).select("file_path", "start", "end", "old_text", "new_text"))
    if want == had:
        return out
    # Calls as statements take any number of results; assignments take more or fewer names; other uses are refused.
    up = ws.nodes.select("file_path", F.col("node_id").alias("parent_id"), F.col("kind").alias("up_kind"))
    uses = calls.join(up, ["file_path", "parent_id"])
    lhs = ws.nodes.where("edge in ('lhs', 'name')").groupBy("file_path", "parent_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "text"))).alias("l"))
    uses = uses.join(lhs, ["file_path", "parent_id"], "left")
    assigned = F.col("edge").isin("rhs", "value") & F.col("up_kind").isin("AssignStmt", "ValueSpec") & (F.size("l") == had)
    statement = F.col("up_kind").isin("ExprStmt", "GoStmt", "DeferStmt")
    if uses.where(~assigned & ~statement).limit(1).count():
        raise RefactorError(f"a call of {name} stands in an expression or in another number of assignments")
    assigned_rows = uses.where(assigned)
    if want > had:
        at = F.element_at("l", -1)["end"]
        out.append(assigned_rows.select("file_path", at.alias("start"), at.alias("end"), F.lit("").alias("old_text"), F.lit(", _" * (want - had)).alias("new_text")))
    else:
        kept = F.exists(F.slice("l", want + 1, had - want), lambda x: F.coalesce(x["text"], F.lit("")) != "_")
        if want == 0 or assigned_rows.where(kept).limit(1).count():
            raise RefactorError(f"a dropped result of {name} is used")
        cut = assigned_rows.select("file_path", F.expr(f"l[{want - 1}].end").alias("start"), F.element_at("l", -1)["end"].alias("end"))
        out.append(facts.source_text(ws.files, cut, "start", "end", "old_text").withColumn("new_text", F.lit("")).select("file_path", "start", "end", "old_text", "new_text"))
    return out
