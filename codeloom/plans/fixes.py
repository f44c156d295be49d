"""Fixes of what the analyzers report, one function at a time in parallel: boolean branching and deep if-else."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.golang import analyze
from codeloom.plans.apply import changes
from codeloom.sources.workspace import Workspace

#: The comparison that holds where another doesn't (fixed values of the language).
OPPOSITE = {"==": "!=", "!=": "==", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


class Function:
    """One function's nodes with their file's bytes."""

    def __init__(self, nodes: list[dict], content: bytes):
        self.content, self.nodes = content, sorted(nodes, key=lambda n: n["node_id"])
        self.kids: dict[int, list[dict]] = defaultdict(list)
        for n in self.nodes:
            self.kids[n["parent_id"]].append(n)

    def text(self, start: int, end: int) -> str:
        return self.content[start:end].decode()

    def of(self, node: dict) -> str:
        return self.text(node["start"], node["end"])

    def child(self, node: dict, edge: str) -> dict | None:
        return next((k for k in self.kids[node["node_id"]] if k["edge"] == edge), None)

    def statements(self, block: dict) -> list[dict]:
        return [k for k in self.kids[block["node_id"]] if k["edge"] == "stmt"]

    def inner(self, block: dict) -> str:
        """The text of a block's statements."""
        found = self.statements(block)
        return self.text(found[0]["start"], found[-1]["end"]) if found else ""

    def line(self, start: int, end: int) -> tuple[int, int]:
        """The whole lines around a stretch, the last line's end included."""
        stop = self.content.find(b"\n", end)
        return self.content.rfind(b"\n", 0, start) + 1, len(self.content) if stop < 0 else stop + 1

    def indent(self, at: int) -> str:
        lead = self.text(self.content.rfind(b"\n", 0, at) + 1, at)
        return lead[: len(lead) - len(lead.lstrip())]


Edit = tuple[int, int, str]


def by_function(ws: Workspace, chosen: DataFrame, edits: Callable[[Function], Iterator[Edit]]) -> DataFrame:
    """(file_path, start, end, old_text, new_text) that `edits` yields for each chosen function (file_path, func_id).
    A function's nodes meet in one task, its file's content once among them."""
    nodes = ws.nodes.join(chosen.distinct(), ["file_path", "func_id"], "left_semi")
    nodes = nodes.select("file_path", "func_id", "node_id", "parent_id", "edge", "kind", "tok", "start", "end", "line", "col", "end_line", "text")
    head = ws.files.select("file_path", "content").withColumn("kind", F.lit("FuncDecl"))
    rows = nodes.join(head, ["file_path", "kind"], "left")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        content = next(bytes(c) for c in part["content"] if c is not None)
        whole = Function(part.drop(columns="content").to_dict("records"), content)
        out = [(part["file_path"].iloc[0], a, b, whole.text(a, b), new) for a, b, new in edits(whole)]
        return pd.DataFrame(out, columns=["file_path", "start", "end", "old_text", "new_text"])

    return rows.groupBy("file_path", "func_id").applyInPandas(run, "file_path string, start int, end int, old_text string, new_text string")


def _flagged(ws: Workspace, found: DataFrame) -> DataFrame:
    """(file_path, func_id) of the functions that an analyzer's rows (file, line) lie in."""
    spans = ws.nodes.where("kind = 'FuncDecl'").select("file_path", F.col("node_id").alias("func_id"), "line", "end_line")
    at = found.select(F.col("file").alias("file_path"), F.col("line").alias("at"))
    return spans.join(at, "file_path").where("line <= at and at <= end_line").select("file_path", "func_id")


def fix_boolean_branching(ws: Workspace, least: int = analyze.MIN_BRANCHES) -> DataFrame:
    """Switches in place of booleans that compare one expression and that an if chain then branches on. Only booleans
    set by statements of the function's own block are replaced, each used by the chain alone; a chain whose conditions
    are anything but such booleans stays, as do comparisons by `!=`."""

    def edits(f: Function) -> Iterator[Edit]:
        body = next((n for n in f.nodes if n["edge"] == "body" and n["parent_id"] == f.nodes[0]["node_id"]), None)
        if body is None:
            return
        groups: dict[str, dict[str, tuple[dict, str]]] = defaultdict(dict)
        for n in f.statements(body):
            sides = [k for k in f.kids[n["node_id"]] if k["edge"] in ("lhs", "rhs")]
            if n["kind"] == "AssignStmt" and n["tok"] in (":=", "=") and [(k["edge"], k["kind"]) for k in sides] == [("lhs", "Ident"), ("rhs", "BinaryExpr")] and sides[1]["tok"] == "==":
                groups[f.of(f.child(sides[1], "x"))][sides[0]["text"]] = (n, f.of(f.child(sides[1], "y")))
        uses = defaultdict(int)
        for n in f.nodes:
            if n["kind"] == "Ident" and n["edge"] not in ("sel", "key", "label"):
                uses[n["text"]] += 1
        for source, flags in groups.items():
            if len(flags) < least:
                continue
            chain = next((n for n in f.statements(body) if n["kind"] == "IfStmt" and (c := f.child(n, "cond"))["kind"] == "Ident" and c["text"] in flags), None)
            cases, at, other = [], chain, None
            while at is not None and at["kind"] == "IfStmt":
                cond = f.child(at, "cond")
                if cond["kind"] != "Ident" or cond["text"] not in flags or f.child(at, "init") is not None:
                    cases = []
                    break
                cases.append((cond["text"], f.child(at, "body")))
                at = f.child(at, "else")
                other = at if at is not None and at["kind"] == "BlockStmt" else None
            named = [c for c, _ in cases]
            if not cases or len(set(named)) != len(named) or any(uses[c] != 2 for c in named):
                continue
            lead = f.indent(chain["start"])
            parts = [f"switch {source} {{\n"]
            for name, block in cases:
                parts.append(f"{lead}case {flags[name][1]}:\n{_indented(f, block, lead)}")
            if other is not None:
                parts.append(f"{lead}default:\n{_indented(f, other, lead)}")
            yield chain["start"], chain["end"], "".join(parts) + f"{lead}}}"
            for name in named:
                a, b = f.line(flags[name][0]["start"], flags[name][0]["end"])
                yield a, b, ""

    found = by_function(ws, _flagged(ws, analyze.boolean_branching(ws, least)), edits)
    return changes(found, "switch instead of booleans")


def _indented(f: Function, block: dict, lead: str) -> str:
    """A block's statements one level below `lead`."""
    found = f.statements(block)
    if not found:
        return ""
    own = f.indent(found[0]["start"])
    lines = f.inner(block).split("\n")
    return "".join(f"{lead}\t{x.removeprefix(own)}\n" if x.strip() else "\n" for x in lines)


def fix_deep_if_else(ws: Workspace, most: int = analyze.MAX_NESTING, else_lines: int = analyze.MIN_ELSE_LINES) -> DataFrame:
    """Early returns in place of nested if-else whose else blocks all return: each condition is turned round and guards
    its else block, and what the innermost if does follows them. Chains of another form stay."""

    def edits(f: Function) -> Iterator[Edit]:
        for nest in analyze.nests(f.nodes, most, else_lines):
            n = nest.node
            guards, happy = chain(f, n)
            if not guards or n["edge"] != "stmt":
                continue
            lead = f.indent(n["start"])
            out = "".join(f"if {cond} {{\n{_indented(f, block, lead)}{lead}}}\n{lead}" for cond, block in guards)
            yield n["start"], n["end"], out + (_indented(f, happy, lead).replace(f"\n{lead}\t", f"\n{lead}").removeprefix(f"{lead}\t").rstrip("\n"))

    def chain(f: Function, at: dict | None) -> tuple[list[tuple[str, dict]], dict | None]:
        guards: list[tuple[str, dict]] = []
        happy = None
        while at is not None:
            other, body = f.child(at, "else"), f.child(at, "body")
            if other is None or other["kind"] != "BlockStmt" or f.child(at, "init") is not None or not any(s["kind"] == "ReturnStmt" for s in f.statements(other)):
                return [], None
            guards.append((turned(f, f.child(at, "cond")), other))
            inside = f.statements(body)
            nested = len(inside) == 1 and inside[0]["kind"] == "IfStmt" and f.child(inside[0], "else") is not None
            happy, at = body, inside[0] if nested else None
        return guards, happy

    found = by_function(ws, _flagged(ws, analyze.deep_if_else(ws, most, else_lines)), edits)
    return changes(found, "return early")


def turned(f: Function, cond: dict) -> str:
    """A condition that holds where the given one doesn't."""
    while cond["kind"] == "ParenExpr":
        cond = f.child(cond, "x")
    if cond["kind"] == "BinaryExpr" and cond["tok"] in OPPOSITE:
        return f"{f.of(f.child(cond, 'x'))} {OPPOSITE[cond['tok']]} {f.of(f.child(cond, 'y'))}"
    if cond["kind"] == "UnaryExpr" and cond["tok"] == "!":
        return f.of(f.child(cond, "x"))
    return f"!{f.of(cond)}" if cond["kind"] in ("Ident", "SelectorExpr", "CallExpr", "IndexExpr") else f"!({f.of(cond)})"


def results(ws: Workspace) -> DataFrame:
    """fix, file, line, edits, message: what each fix that needs no argument would change, by file."""
    from codeloom.plans import refactor

    made = {"fix_boolean_branching": fix_boolean_branching(ws), "fix_deep_if_else": fix_deep_if_else(ws), "fix_if_init": refactor.fix_if_init(ws), "fix_error_wrapping": refactor.fix_error_wrapping(ws, "info")}
    rows = reduce(DataFrame.unionByName, [p.withColumn("fix", F.lit(n)) for n, p in made.items()])
    text = F.decode("content", "ISO-8859-1")
    rows = rows.groupBy("fix", "file").agg(F.min("start").alias("start"), F.count("*").alias("edits"), F.first("description").alias("message"))
    rows = rows.join(ws.files.select(F.col("file_path").alias("file"), "content"), "file")
    line = F.regexp_count(F.substring(text, F.lit(1), F.col("start")), F.lit("\n")) + 1
    return rows.select("fix", "file", line.alias("line"), "edits", "message")
