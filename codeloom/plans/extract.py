"""Refactorings that look into bodies: extract functions, methods and variables, inline functions and constants."""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from codeloom.golang import facts
from codeloom.plans.apply import changes
from codeloom.plans.refactor import RefactorError, _declaration, _identifier
from codeloom.sources.workspace import Workspace

EDIT = "file string, start int, end int, old_text string, new_text string"
#: Types of literals that start a variable.
LITERALS = {"string": "string", "char": "rune"}
COMPARING = ("==", "!=", "<", "<=", ">", ">=", "&&", "||")
SIMPLE = ("Ident", "BasicLit", "CallExpr", "SelectorExpr", "ParenExpr", "IndexExpr", "CompositeLit")


@dataclass
class Body:
    """One function with all its nodes: a request looks at a single function, whose size bounds what is gathered."""

    file: str
    content: bytes
    head: Row
    nodes: list[Row]
    kids: dict[int, list[Row]]

    def text(self, node: Row) -> str:
        return self.content[node["start"] : node["end"]].decode()

    def child(self, node: Row, edge: str) -> Row | None:
        return next((k for k in self.kids[node["node_id"]] if k["edge"] == edge), None)

    def children(self, node: Row, edge: str) -> list[Row]:
        return [k for k in self.kids[node["node_id"]] if k["edge"] == edge]

    def below(self, node: Row) -> list[Row]:
        out, todo = [], [node]
        while todo:
            out.append(todo.pop())
            todo += self.kids[out[-1]["node_id"]]
        return out

    def indent(self, at: int) -> str:
        begin = self.content.rfind(b"\n", 0, at) + 1
        lead = self.content[begin:at].decode()
        return lead if not lead.strip() else lead[: len(lead) - len(lead.lstrip())]


def _body(ws: Workspace, file: str, where) -> Body:
    head = facts.functions(ws).where((F.col("file_path") == file) & where).first()
    if head is None:
        raise RefactorError(f"{file} has no such function")
    nodes = sorted(ws.nodes.where((F.col("file_path") == file) & (F.col("func_id") == head["func_node"])).collect(), key=lambda n: n["node_id"])
    kids: dict[int, list[Row]] = defaultdict(list)
    for n in nodes:
        kids[n["parent_id"]].append(n)
    return Body(file, bytes(ws.files.where(F.col("file_path") == file).first()["content"]), head, nodes, kids)


def _names(body: Body) -> list[tuple[str, int, str | None]]:
    """(name, place, type or null) of each declaration in a function: receiver, parameters, `:=`, var and range."""
    out: list[tuple[str, int, str | None]] = []
    for n in body.nodes:
        if n["kind"] == "Field":
            kind = body.child(n, "type")
            out += [(k["text"], k["start"], body.text(kind) if kind else None) for k in body.children(n, "name")]
        elif n["kind"] == "AssignStmt" and n["tok"] == ":=":
            left, right = body.children(n, "lhs"), body.children(n, "rhs")
            kinds = [_type(body, r, out) for r in right] if len(left) == len(right) else [None] * len(left)
            out += [(x["text"], x["start"], t) for x, t in zip(left, kinds) if x["kind"] == "Ident"]
        elif n["kind"] == "ValueSpec":
            kind, values = body.child(n, "type"), body.children(n, "value")
            kinds = [_type(body, v, out) for v in values]
            for i, x in enumerate(body.children(n, "name")):
                out.append((x["text"], x["start"], body.text(kind) if kind else kinds[i] if i < len(kinds) else None))
        elif n["kind"] == "RangeStmt" and n["tok"] == ":=":
            out += [(x["text"], x["start"], None) for x in body.kids[n["node_id"]] if x["edge"] in ("key", "value") and x["kind"] == "Ident"]
    return [x for x in out if x[0] != "_"]


def _type(body: Body, value: Row, known: list[tuple[str, int, str | None]]) -> str | None:
    """The type of a value, as far as its own text and the names declared before it tell."""
    inner = lambda edge: _type(body, x, known) if (x := body.child(value, edge)) is not None else None
    match value["kind"]:
        case "BasicLit":
            return LITERALS.get(value["tok"]) or ("float64" if any(c in value["text"] for c in ".eE") and not value["text"].lower().startswith("0x") else "int")
        case "Ident":
            return "bool" if value["text"] in ("true", "false") else next((t for n, _, t in reversed(known) if n == value["text"]), None)
        case "CompositeLit":
            kind = body.child(value, "type")
            return body.text(kind) if kind else None
        case "ParenExpr":
            return inner("x")
        case "UnaryExpr" if value["tok"] in ("&", "!", "-", "+"):
            return f"*{found}" if (found := inner("x")) and value["tok"] == "&" else found
        case "BinaryExpr":
            return "bool" if value["tok"] in COMPARING else inner("x") or inner("y")
    return None


def _own_returns(body: Body, nodes: list[Row]) -> list[Row]:
    """Nodes that leave the function or a loop around them, closures apart."""
    by_id = {n["node_id"]: n for n in body.nodes}
    chosen = {n["node_id"] for n in nodes}

    def leaves(n: Row) -> bool:
        up, loops = by_id.get(n["parent_id"]), n["kind"] == "BranchStmt"
        while up is not None and up["node_id"] in chosen:
            if up["kind"] == "FuncLit" or loops and up["kind"] in ("ForStmt", "RangeStmt", "SwitchStmt", "TypeSwitchStmt", "SelectStmt"):
                return False
            up = by_id.get(up["parent_id"])
        return True

    return [n for n in nodes if n["kind"] in ("ReturnStmt", "BranchStmt") and leaves(n)]


def extract_function(ws: Workspace, file: str, first_line: int, last_line: int, name: str, types: dict[str, str] | None = None, as_method: bool = False) -> DataFrame:
    """Put whole statements of one block, on the given lines, into a function of their own behind the one that they
    come from. Its parameters are the names that they use and that are declared before, its results those that they
    set and that are used afterwards. A type that the text doesn't tell must be given in `types`. Statements that
    return may only do so at their end; then the call is returned. as_method: a method on the same receiver."""
    _identifier(name)
    inside = (F.col("line") <= first_line) & (F.col("body_end_line") >= last_line)
    body = _body(ws, file, inside)
    chosen = [n for n in body.nodes if n["edge"] == "stmt" and n["line"] >= first_line and n["end_line"] <= last_line]
    top = [n for n in chosen if n["parent_id"] not in {k["node_id"] for c in chosen for k in body.below(c)}]
    if not top or len({n["parent_id"] for n in top}) != 1:
        raise RefactorError(f"lines {first_line} to {last_line} are no statements of one block")
    start, end = top[0]["start"], top[-1]["end"]
    within_lines = lambda line: first_line <= line <= last_line
    if any(n["edge"] == "stmt" and n not in chosen and (within_lines(n["line"]) or within_lines(n["end_line"])) for n in body.nodes):
        raise RefactorError("a statement is on these lines only in part")
    nodes = [k for n in top for k in body.below(n)]
    leaving = _own_returns(body, nodes)
    tail = len(leaving) == 1 and leaving[0]["node_id"] == top[-1]["node_id"] and leaving[0]["kind"] == "ReturnStmt"
    if leaving and not tail:
        raise RefactorError("the statements leave their function or loop before their end")
    declared = _names(body)
    ident = lambda n: n["kind"] == "Ident" and n["edge"] not in ("sel", "label")
    before = {n: t for n, at, t in declared if at < start}
    within = {n: t for n, at, t in declared if start <= at < end}
    assigned = {x["text"] for n in nodes if n["kind"] == "AssignStmt" for x in body.children(n, "lhs") if x["kind"] == "Ident"} | {k["text"] for n in nodes if n["kind"] == "IncDecStmt" for k in body.kids[n["node_id"]] if k["kind"] == "Ident"}
    after = {n["text"] for n in body.nodes if ident(n) and n["start"] >= end}
    used = {n["text"] for n in nodes if ident(n)}
    looped = any(n["kind"] in ("ForStmt", "RangeStmt") and n["start"] < start and n["end"] > end for n in body.nodes)
    kinds = before | {k: v for k, v in within.items() if v} | (types or {})
    receiver = next((k["text"] for n in body.nodes if n["edge"] == "recv" for k in body.below(n) if k["edge"] == "name"), None)
    if as_method and not receiver:
        raise RefactorError("the function has no named receiver")
    params = sorted(n for n in used if n in before and not (as_method and n == receiver))
    results = [] if tail else sorted(n for n in {*assigned, *within} - {"_"} if (n in after or looped and n in before) and (n in before or n in within))
    untold = [n for n in [*params, *results] if not kinds.get(n)]
    if untold:
        raise RefactorError(f"the types of {', '.join(dict.fromkeys(untold))} must be given")
    new = [n for n in results if n in within and n not in before]
    given = ", ".join(f"{n} {kinds[n]}" for n in params)
    sig = next((n for n in body.nodes if n["kind"] == "FuncType" and n["parent_id"] == body.head["func_node"]), None)
    if tail:
        out = body.child(sig, "results")
        kind = f" {body.text(out)}" if out else ""
    else:
        kind = "" if not results else f" {kinds[results[0]]}" if len(results) == 1 else f" ({', '.join(kinds[n] for n in results)})"
    owner = body.content[body.head["start"] :].decode().partition(")")[0].removeprefix("func ") + ") " if as_method else ""
    call = f"{receiver}.{name}({', '.join(params)})" if as_method else f"{name}({', '.join(params)})"
    lead = body.indent(start)
    source = body.content[start:end].decode()
    lines = [source.split("\n")[0], *(x.removeprefix(lead[1:]) for x in source.split("\n")[1:])]
    inner = "\n".join(["\t" + lines[0], *lines[1:]]) + (f"\n\treturn {', '.join(results)}" if results else "")
    made = f"\n\nfunc {owner}{name}({given}){kind} {{\n{inner}\n}}"
    if tail:
        site = f"return {call}" if kind else f"{call}\n{lead}return"
    else:
        # A mix of new and old names is declared first: `:=` could hide the old ones.
        mixed = new and len(new) < len(results)
        site = "".join(f"var {n} {kinds[n]}\n{lead}" for n in new if mixed) + (f"{', '.join(results)} {':=' if new and not mixed else '='} {call}" if results else call)
    close = body.head["end"]
    rows = [(file, start, end, source, site), (file, close, close, "", made)]
    return changes(ws.nodes.sparkSession.createDataFrame(rows, EDIT), f"extract {name}")


def extract_block(ws: Workspace, file: str, line: int, name: str, types: dict[str, str] | None = None) -> DataFrame:
    """Put the statements of the innermost block around a line (of an if, a loop or a clause) into a function."""
    body = _body(ws, file, (F.col("line") <= line) & (F.col("body_end_line") >= line))
    inner = [n for n in body.nodes if n["kind"] in ("BlockStmt", "CaseClause", "CommClause") and n["line"] <= line <= n["end_line"] and n["parent_id"] != body.head["func_node"] and body.children(n, "stmt")]
    inner = [n for n in inner if not any(k["kind"] in ("CaseClause", "CommClause") for k in body.children(n, "stmt"))]
    if not inner:
        raise RefactorError(f"line {line} lies in no block inside a function")
    block = min(inner, key=lambda n: n["end"] - n["start"])
    stmts = body.children(block, "stmt")
    return extract_function(ws, file, stmts[0]["line"], stmts[-1]["end_line"], name, types)


def extract_method(ws: Workspace, file: str, first_line: int, last_line: int, name: str, types: dict[str, str] | None = None) -> DataFrame:
    """Statements of a method as a method of the same type."""
    return extract_function(ws, file, first_line, last_line, name, types, as_method=True)


def extract_variable(ws: Workspace, file: str, line: int, expression: str, name: str) -> DataFrame:
    """Name the first expression on a line that reads so, in a declaration before its statement."""
    _identifier(name)
    body = _body(ws, file, (F.col("body_line") <= line) & (F.col("body_end_line") >= line))
    found = [n for n in body.nodes if n["line"] == line and n["edge"] in ("rhs", "arg", "result", "cond", "x", "y", "value", "fun", "tag") and body.text(n) == expression]
    if not found:
        raise RefactorError(f"line {line} has no expression {expression}")
    by_id, n = {k["node_id"]: k for k in body.nodes}, found[0]
    at = n
    while at["edge"] != "stmt":
        at = by_id[at["parent_id"]]
        if at["kind"] == "FuncLit" or at["edge"] == "cond" and at["line"] != line:
            raise RefactorError(f"{expression} has no statement of its own")
    rows = [(file, at["start"], at["start"], "", f"{name} := {expression}\n{body.indent(at['start'])}"), (file, n["start"], n["end"], expression, name)]
    return changes(ws.nodes.sparkSession.createDataFrame(rows, EDIT), f"extract {name}")


def inline_function(ws: Workspace, package: str, name: str) -> DataFrame:
    """Put a function's single returned expression in place of every call, arguments for parameters; of a function of
    several statements, these stand in place of calls that are statements of their own. The function stays. Arguments
    used more than once must be names or literals."""
    own = ws.files.where(F.col("dir") == package).select("file_path")
    file = facts.functions(ws).where((F.col("name") == name) & F.col("recv").isNull()).join(own, "file_path", "left_semi").first()
    if file is None:
        raise RefactorError(f"{package} has no function {name}")
    calls = facts.references(ws).where((F.col("dir") == package) & (F.col("name") == name) & (F.col("kind") == "Function")).select("file_path", F.col("end").alias("fun_end"))
    return _inlined(ws, name, file, calls, None)


def inline_method(ws: Workspace, package: str, recv: str, name: str, file: str | None = None) -> DataFrame:
    """The same for a method of a type: what calls are selected from stands for the receiver. Calls are those of the
    name, in one file or all, on a name whose declaration in its function tells the type (a receiver or parameter of
    it, `T{}`, `&T{}` or `new(T)`); other calls stay, and none at all is an error."""
    own = ws.files.where(F.col("dir") == package).select("file_path")
    decl = facts.functions(ws).where((F.col("name") == name) & (F.col("recv") == recv)).join(own, "file_path", "left_semi").first()
    if decl is None:
        raise RefactorError(f"{package} has no method {recv}.{name}")
    calls = facts.method_calls(ws).where((F.col("name") == name) & (F.col("type_dir") == package) & (F.col("type") == recv))
    calls = calls.where(F.col("file_path") == file) if file else calls
    if not calls.limit(1).count():
        raise RefactorError(f"no call of {recv}.{name} tells its receiver's type")
    receiver = next((k["text"] for k in _body(ws, decl["file_path"], F.col("func_node") == decl["func_node"]).nodes if k["edge"] == "name" and k["kind"] == "Ident" and k["start"] < decl["name_start"]), None)
    return _inlined(ws, name, decl, calls.select("file_path", "fun_end"), receiver or "_")


def _inlined(ws: Workspace, name: str, decl: Row, calls: DataFrame, receiver: str | None) -> DataFrame:
    """Edits of calls (file_path, fun_end). receiver: the receiver's name for methods."""
    body = _body(ws, decl["file_path"], F.col("func_node") == decl["func_node"])
    block = next(n for n in body.nodes if n["edge"] == "body" and n["parent_id"] == decl["func_node"])
    stmts = body.children(block, "stmt")
    results = body.children(stmts[0], "result") if len(stmts) == 1 and stmts[0]["kind"] == "ReturnStmt" else []
    params = ([receiver] if receiver else []) + list(decl["params"])
    whole_body = len(results) != 1
    if whole_body:
        inside = [n for s in stmts for n in body.below(s)]
        if not stmts or any(n["kind"] == "ReturnStmt" for n in inside) or any(n["kind"] == "DeferStmt" for n in inside):
            raise RefactorError(f"{name} is neither one returned expression nor statements without a return")
        if [x for x, at, _ in _names(body) if at > block["start"]]:
            raise RefactorError(f"{name} declares names of its own, which could meet those around a call")
    first, last = (stmts[0], stmts[-1]) if whole_body else (results[0], results[0])
    value = {"start": first["start"], "end": last["end"]}
    below = [n for s in (stmts if whole_body else results) for n in body.below(s)]
    set_ = {k["text"] for n in below if n["kind"] == "AssignStmt" for k in body.children(n, "lhs")} | {k["text"] for n in below if n["kind"] == "IncDecStmt" for k in body.kids[n["node_id"]]}
    if set_ & set(params):
        raise RefactorError(f"{name} sets its parameters")
    spots = sorted((n["start"], n["end"], params.index(n["text"])) for n in below if n["kind"] == "Ident" and n["edge"] not in ("sel", "key") and n["text"] in params)
    fun = ws.nodes.where("edge = 'fun'").select("file_path", F.col("parent_id").alias("node_id"), F.col("node_id").alias("fun_id"), F.col("end").alias("fun_end"))
    call = ws.nodes.where("kind = 'CallExpr'").select("file_path", "node_id", F.col("parent_id").alias("up_id"), "start", "end", "edge")
    up = ws.nodes.select("file_path", F.col("node_id").alias("up_id"), F.col("kind").alias("up_kind"))
    whole = calls.distinct().join(fun, ["file_path", "fun_end"]).join(call, ["file_path", "node_id"]).join(up, ["file_path", "up_id"])
    if whole_body and whole.where("up_kind <> 'ExprStmt'").limit(1).count():
        raise RefactorError(f"a call of {name} is no statement of its own")
    args = ws.nodes.where("edge = 'arg'").select("file_path", F.col("parent_id").alias("node_id"), "ord", "kind", F.col("start").alias("a"), F.col("end").alias("b"))
    if receiver:
        of = ws.nodes.where("edge = 'x'").select("file_path", F.col("parent_id").alias("fun_id"), "kind", F.col("start").alias("a"), F.col("end").alias("b"))
        args = args.unionByName(of.join(whole.select("file_path", "fun_id", "node_id"), ["file_path", "fun_id"]).select("file_path", "node_id", F.lit(0).alias("ord"), "kind", "a", "b"))
    text = facts.source_text(ws.files, args.join(whole.select("file_path", "node_id"), ["file_path", "node_id"], "left_semi"), "a", "b", "t")
    held = F.when(F.col("kind").isin(*SIMPLE), F.col("t")).otherwise(F.concat(F.lit("("), "t", F.lit(")")))
    given = text.groupBy("file_path", "node_id").agg(F.array_sort(F.collect_list(F.struct("ord", held.alias("t"), F.col("kind").isin("Ident", "BasicLit").alias("plain")))).alias("args"))
    rows = whole.join(given, ["file_path", "node_id"], "left")
    several = [i for i in range(len(params)) if sum(s[2] == i for s in spots) > 1]
    if several and rows.where(F.array_contains(F.array(*[F.coalesce(F.get("args", F.lit(i))["plain"], F.lit(True)) for i in several]), False)).limit(1).count():
        raise RefactorError(f"an argument of {name} would be evaluated more than once")
    nested = rows.select("file_path", F.col("node_id").alias("parent_id")).join(ws.nodes.where("edge = 'arg' and kind = 'CallExpr'").select("file_path", "parent_id", "node_id"), ["file_path", "parent_id"]).join(rows.select("file_path", "node_id"), ["file_path", "node_id"], "left_semi")
    if nested.limit(1).count():
        raise RefactorError(f"calls of {name} stand in one another")
    pieces, at = [], value["start"]
    for s, e, i in spots:
        pieces += [F.lit(body.content[at:s].decode()), F.get("args", F.lit(i))["t"]]
        at = e
    pieces.append(F.lit(body.content[at : value["end"]].decode()))
    new = F.concat(*pieces)
    if not whole_body and results[0]["kind"] not in SIMPLE:
        new = F.when(F.col("edge").isin("rhs", "arg", "result", "value"), new).otherwise(F.concat(F.lit("("), new, F.lit(")")))
    return changes(facts.source_text(ws.files, rows, "start", "end", "old_text").withColumn("new_text", new), f"inline {name}")


def inline_constant(ws: Workspace, package: str, name: str) -> DataFrame:
    """Put a constant's value where it is used and drop its declaration, which must be one of its own."""
    decl = _declaration(ws, package, name)
    spec = ws.nodes.where("kind = 'ValueSpec'").select("file_path", "node_id", "start", "end")
    value = facts.children(spec, ws.nodes, "value", "v").join(facts.children(spec, ws.nodes.where(F.col("text") == name), "name", "n").select("file_path", "node_id"), ["file_path", "node_id"], "left_semi")
    value = value.join(ws.files.where(F.col("dir") == package).select("file_path"), "file_path", "left_semi")
    found = facts.source_text(ws.files, value, "v_start", "v_end", "t").select("t", "v_kind").collect()
    if len(found) != 1 or not decl.where(F.col("old_text").startswith("const")).limit(1).count():
        raise RefactorError(f"{package} has no constant {name} with a declaration of its own")
    text = found[0]["t"] if found[0]["v_kind"] in SIMPLE else f"({found[0]['t']})"
    ref = facts.references(ws).where((F.col("dir") == package) & (F.col("name") == name) & (F.col("kind") == "Constant"))
    sel = ws.nodes.where("kind = 'SelectorExpr'").select("file_path", "end", F.col("start").alias("sel_start"))
    uses = ref.select("file_path", "pos", "end").join(sel, ["file_path", "end"], "left").select("file_path", F.coalesce("sel_start", "pos").alias("start"), "end")
    uses = facts.source_text(ws.files, uses, "start", "end", "old_text").withColumn("new_text", F.lit(text))
    return changes(uses.select("file_path", "start", "end", "old_text", "new_text").unionByName(decl.select("file_path", "start", "end", "old_text", F.lit("").alias("new_text"))), f"inline {name}")
