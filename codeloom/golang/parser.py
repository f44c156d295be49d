"""Syntax nodes of a Go file, by recursive descent.

Every node has its place among its parent's children (edge), so that queries over the flat table can tell a callee from
an argument or a body from an else branch.
"""

from __future__ import annotations

import bisect

from codeloom.golang.lexer import SyntaxProblem, Token, tokens

_LEVEL = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
_ASSIGN = frozenset({"=", ":=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="})


class Node:
    __slots__ = ("kind", "start", "end", "tok", "text", "children")

    def __init__(self, kind: str, start: int, tok: str = "", text: str | None = None):
        self.kind, self.start, self.end, self.tok, self.text = kind, start, start, tok, text
        self.children: list[tuple[str, Node]] = []

    def add(self, edge: str, *nodes: Node | None) -> Node:
        self.children += [(edge, n) for n in nodes if n is not None]
        return self

    def child(self, edge: str) -> Node | None:
        return next((n for e, n in self.children if e == edge), None)

    def all(self, edge: str) -> list[Node]:
        return [n for e, n in self.children if e == edge]


class Parser:
    def __init__(self, source: str):
        self.toks, self.comments = tokens(source)
        self.i = 0
        #: Below zero in the headers of statements, where `x {` opens a block and no literal.
        self.depth = 0

    # Tokens

    @property
    def tok(self) -> Token:
        return self.toks[self.i]

    def at(self, *texts: str) -> bool:
        t = self.tok
        return t.kind in ("op", "keyword") and t.text in texts

    def peek(self, k: int = 1) -> Token:
        return self.toks[min(self.i + k, len(self.toks) - 1)]

    def next(self) -> Token:
        t = self.tok
        self.i += 1
        return t

    def want(self, text: str) -> Token:
        if not self.at(text):
            raise SyntaxProblem(f"offset {self.tok.start}: expected {text!r}, found {self.tok.text!r}")
        return self.next()

    def took(self, text: str) -> bool:
        if self.at(text):
            self.i += 1
            return True
        return False

    def semi(self) -> None:
        if not self.at(")", "}"):
            if self.tok.kind == "end":
                return
            self.want(";")

    def done(self, node: Node) -> Node:
        node.end = self.toks[self.i - 1].end
        return node

    def name(self) -> Node:
        t = self.next()
        if t.kind != "name":
            raise SyntaxProblem(f"offset {t.start}: expected a name, found {t.text!r}")
        return self.done(Node("Ident", t.start, text=t.text))

    def literal(self) -> Node:
        t = self.next()
        return self.done(Node("BasicLit", t.start, tok=t.kind, text=t.text))

    # Declarations

    def file(self) -> Node:
        out = Node("File", 0)
        self.want("package")
        out.add("name", self.name())
        self.semi()
        while self.tok.kind != "end":
            out.add("decl", self.func_decl() if self.at("func") else self.gen_decl())
            self.semi()
        out.end = self.toks[-1].end
        return out

    def gen_decl(self) -> Node:
        if not self.at("import", "const", "var", "type"):
            raise SyntaxProblem(f"offset {self.tok.start}: expected a declaration, found {self.tok.text!r}")
        t = self.next()
        out = Node("GenDecl", t.start, tok=t.text)
        spec = {"import": self.import_spec, "type": self.type_spec}.get(t.text, self.value_spec)
        if self.took("("):
            while not self.at(")"):
                out.add("spec", spec())
                self.semi()
            self.want(")")
        else:
            out.add("spec", spec())
        return self.done(out)

    def import_spec(self) -> Node:
        out = Node("ImportSpec", self.tok.start)
        if self.tok.kind == "name":
            out.add("alias", self.name())
        elif self.at("."):
            t = self.next()
            out.add("alias", self.done(Node("Ident", t.start, text=".")))
        if self.tok.kind != "string":
            raise SyntaxProblem(f"offset {self.tok.start}: expected an import path")
        return self.done(out.add("path", self.literal()))

    def value_spec(self) -> Node:
        out = Node("ValueSpec", self.tok.start)
        out.add("name", self.name())
        while self.took(","):
            out.add("name", self.name())
        if not self.at("=", ";", ")"):
            out.add("type", self.type())
        if self.took("="):
            out.add("value", *self.exprs())
        return self.done(out)

    def type_spec(self) -> Node:
        out = Node("TypeSpec", self.tok.start)
        out.add("name", self.name())
        if self.at("[") and self.peek().kind == "name" and self.peek(2).text not in ("]", "+", "-", "*", "/", "."):
            out.add("typeparams", self.params("[", "]"))
        if self.took("="):
            out.tok = "="
        return self.done(out.add("type", self.type()))

    def func_decl(self) -> Node:
        out = Node("FuncDecl", self.want("func").start)
        if self.at("("):
            out.add("recv", self.params())
        out.add("name", self.name())
        if self.at("["):
            out.add("typeparams", self.params("[", "]"))
        out.add("type", self.signature())
        if self.at("{"):
            out.add("body", self.body())
        return self.done(out)

    def signature(self) -> Node:
        out = Node("FuncType", self.tok.start)
        out.add("params", self.params())
        if self.at("("):
            out.add("results", self.params())
        elif self.type_begins():
            field = Node("Field", self.tok.start)
            fields = Node("FieldList", self.tok.start)
            field.add("type", self.type())
            out.add("results", self.done(fields.add("field", self.done(field))))
        return self.done(out)

    def params(self, left: str = "(", right: str = ")") -> Node:
        out = Node("FieldList", self.want(left).start)
        entries: list[tuple[Node, Node | None]] = []
        while not self.at(right):
            first = self.param_type(left == "[")
            second = None if self.at(",", right, ";") else self.param_type(left == "[")
            entries.append((first, second))
            if not self.took(","):
                break
        self.took(";")
        self.want(right)
        if any(b is not None for _, b in entries):
            waiting: list[Node] = []
            for first, kind in entries:
                waiting.append(first)
                if kind is not None:
                    field = Node("Field", waiting[0].start).add("name", *waiting).add("type", kind)
                    field.end = kind.end
                    out.add("field", field)
                    waiting = []
        else:
            for first, _ in entries:
                field = Node("Field", first.start).add("type", first)
                field.end = first.end
                out.add("field", field)
        return self.done(out)

    def param_type(self, constraint: bool) -> Node:
        if self.at("..."):
            out = Node("Ellipsis", self.next().start)
            return self.done(out.add("elem", self.type()))
        return self.constraint() if constraint else self.type()

    def constraint(self) -> Node:
        """A type, or a union of types with or without tildes."""

        def term() -> Node:
            if self.at("~"):
                out = Node("UnaryExpr", self.next().start, tok="~")
                return self.done(out.add("x", self.type()))
            return self.type()

        out = term()
        while self.took("|"):
            out = self.done(Node("BinaryExpr", out.start, tok="|").add("x", out).add("y", term()))
        return out

    # Types

    def type_begins(self) -> bool:
        return self.tok.kind == "name" or self.at("*", "[", "(", "map", "chan", "func", "struct", "interface", "<-")

    def type(self) -> Node:
        t = self.tok
        if t.kind == "name":
            out = self.name()
            if self.at("."):
                self.next()
                out = self.done(Node("SelectorExpr", out.start).add("x", out).add("sel", self.name()))
            if self.at("[") and self.peek().text != "]":
                out = self.type_args(out)
            return out
        out = Node("", t.start)
        if self.took("*"):
            out.kind = "StarExpr"
            out.add("x", self.type())
        elif self.took("("):
            out.kind = "ParenExpr"
            out.add("x", self.type())
            self.want(")")
        elif self.took("["):
            out.kind = "ArrayType"
            if self.at("..."):
                self.next()
                out.tok = "..."
            elif not self.at("]"):
                out.add("len", self.nested(self.expr))
            self.want("]")
            out.add("elem", self.type())
        elif self.took("map"):
            out.kind = "MapType"
            self.want("[")
            out.add("key", self.type())
            self.want("]")
            out.add("value", self.type())
        elif self.took("chan"):
            out.kind = "ChanType"
            self.took("<-")
            out.add("value", self.type())
        elif self.took("<-"):
            out.kind = "ChanType"
            self.want("chan")
            out.add("value", self.type())
        elif self.took("func"):
            out = self.signature()
            out.start = t.start
        elif self.at("struct"):
            return self.struct_type()
        elif self.at("interface"):
            return self.interface_type()
        else:
            raise SyntaxProblem(f"offset {t.start}: expected a type, found {t.text!r}")
        return self.done(out)

    def type_args(self, base: Node) -> Node:
        self.want("[")
        args = [self.type()]
        while self.took(","):
            if self.at("]"):
                break
            args.append(self.type())
        self.want("]")
        kind = "IndexExpr" if len(args) == 1 else "IndexListExpr"
        return self.done(Node(kind, base.start).add("x", base).add("index", *args))

    def struct_type(self) -> Node:
        out = Node("StructType", self.want("struct").start)
        self.want("{")
        while not self.at("}"):
            field = Node("Field", self.tok.start)
            if self.tok.kind == "name" and not (self.peek().text in (".", ";", "}") or self.peek().kind == "string"):
                if self.peek().text == "[" and self.embedded_generic():
                    field.add("type", self.type())
                else:
                    field.add("name", self.name())
                    while self.took(","):
                        field.add("name", self.name())
                    field.add("type", self.type())
            else:
                field.add("type", self.type())
            if self.tok.kind == "string":
                field.add("tag", self.literal())
            out.add("field", self.done(field))
            self.semi()
        self.want("}")
        return self.done(out)

    def embedded_generic(self) -> bool:
        """Whether `T[...]` here is an embedded type: nothing but the line's end follows the bracket."""
        depth, k = 0, 1
        while True:
            text = self.peek(k).text
            depth += text == "["
            depth -= text == "]"
            k += 1
            if not depth:
                return self.peek(k).text in (";", "}") and self.peek(2).text != "]"

    def interface_type(self) -> Node:
        out = Node("InterfaceType", self.want("interface").start)
        self.want("{")
        while not self.at("}"):
            field = Node("Field", self.tok.start)
            if self.tok.kind == "name" and self.peek().text == "(":
                field.add("name", self.name())
                field.add("type", self.signature())
            else:
                field.add("type", self.constraint())
            out.add("field", self.done(field))
            self.semi()
        self.want("}")
        return self.done(out)

    # Expressions

    def nested(self, parse):
        """Parse inside brackets, where literals may open braces again."""
        held, self.depth = self.depth, 0
        out = parse()
        self.depth = held
        return out

    def exprs(self) -> list[Node]:
        out = [self.expr()]
        while self.took(","):
            out.append(self.expr())
        return out

    def expr(self, least: int = 1) -> Node:
        out = self.unary()
        while self.tok.kind == "op" and _LEVEL.get(self.tok.text, 0) >= least:
            op = self.next().text
            out = self.done(Node("BinaryExpr", out.start, tok=op).add("x", out).add("y", self.expr(_LEVEL[op] + 1)))
        return out

    def unary(self) -> Node:
        t = self.tok
        if self.at("+", "-", "!", "^", "&", "<-", "~"):
            if t.text == "<-" and self.peek().text == "chan":
                return self.primary(self.type())
            self.next()
            return self.done(Node("UnaryExpr", t.start, tok=t.text).add("x", self.unary()))
        if self.took("*"):
            return self.done(Node("StarExpr", t.start).add("x", self.unary()))
        return self.primary(self.operand())

    def operand(self) -> Node:
        t = self.tok
        if t.kind == "name":
            return self.name()
        if t.kind in ("number", "string", "char"):
            return self.literal()
        if self.took("("):
            inner = self.nested(lambda: self.type() if self.at("map", "chan", "struct", "interface", "[") and not self.literal_follows() else self.expr())
            self.want(")")
            return self.done(Node("ParenExpr", t.start).add("x", inner))
        if self.at("func"):
            self.next()
            kind = self.signature()
            kind.start = t.start
            if not self.at("{"):
                return kind
            return self.done(Node("FuncLit", t.start).add("type", kind).add("body", self.nested(self.body)))
        if self.at("[", "map", "chan", "struct", "interface"):
            return self.type()
        raise SyntaxProblem(f"offset {t.start}: expected an expression, found {t.text!r}")

    def literal_follows(self) -> bool:
        held = self.i
        try:
            self.type()
            return not self.at(")")
        except SyntaxProblem:
            return True
        finally:
            self.i = held

    def primary(self, out: Node) -> Node:
        while True:
            if self.took("."):
                if self.took("("):
                    node = Node("TypeAssertExpr", out.start).add("x", out)
                    if not self.took("type"):
                        node.add("type", self.type())
                    else:
                        node.tok = "type"
                    self.want(")")
                    out = self.done(node)
                else:
                    out = self.done(Node("SelectorExpr", out.start).add("x", out).add("sel", self.name()))
            elif self.at("["):
                out = self.nested(lambda: self.index(out))
            elif self.at("("):
                out = self.nested(lambda: self.call(out))
            elif self.at("{") and self.literal_type(out):
                out = self.nested(lambda: self.composite(out))
            else:
                return out

    def literal_type(self, x: Node) -> bool:
        if x.kind in ("ArrayType", "MapType", "StructType"):
            return True
        base = x.child("x") if x.kind in ("IndexExpr", "IndexListExpr") else x
        named = base.kind == "Ident" or base.kind == "SelectorExpr" and base.child("x").kind == "Ident"
        return named and self.depth >= 0

    def index(self, x: Node) -> Node:
        self.want("[")
        parts: list[Node | None] = []
        colons = 0
        while not self.at("]"):
            if self.took(":"):
                colons += 1
            elif self.took(","):
                continue
            else:
                parts.append(self.type() if self.at("map", "chan", "struct", "interface", "[") and not self.literal_in_index() else self.expr())
        self.want("]")
        kind = "SliceExpr" if colons else "IndexExpr" if len(parts) == 1 else "IndexListExpr"
        return self.done(Node(kind, x.start).add("x", x).add("index", *parts))

    def literal_in_index(self) -> bool:
        held = self.i
        try:
            self.type()
            return not self.at("]", ",")
        except SyntaxProblem:
            return True
        finally:
            self.i = held

    def call(self, fun: Node) -> Node:
        self.want("(")
        out = Node("CallExpr", fun.start).add("fun", fun)
        while not self.at(")"):
            out.add("arg", self.expr())
            if self.at("..."):
                self.next()
                out.tok = "..."
            if not self.took(","):
                break
        self.took(";")
        self.want(")")
        return self.done(out)

    def composite(self, kind: Node | None) -> Node:
        start = self.want("{").start
        out = Node("CompositeLit", kind.start if kind else start).add("type", kind)
        while not self.at("}"):
            x = self.composite(None) if self.at("{") else self.expr()
            if self.took(":"):
                value = self.composite(None) if self.at("{") else self.expr()
                x = self.done(Node("KeyValueExpr", x.start).add("key", x).add("value", value))
            out.add("elt", x)
            if not self.took(","):
                break
        self.took(";")
        self.want("}")
        return self.done(out)

    # Statements

    def body(self) -> Node:
        held, self.depth = self.depth, 0
        out = Node("BlockStmt", self.want("{").start)
        self.stmts(out)
        self.want("}")
        self.depth = held
        return self.done(out)

    def stmts(self, out: Node) -> None:
        while not self.at("}", "case", "default") and self.tok.kind != "end":
            if self.took(";"):
                continue
            out.add("stmt", self.stmt())
            if not self.at("}", "case", "default"):
                self.semi()

    def stmt(self) -> Node:
        t = self.tok
        if t.kind == "name" and self.peek().text == ":" and self.peek().kind == "op":
            out = Node("LabeledStmt", t.start).add("label", self.name())
            self.want(":")
            return self.done(out if self.at("}", ";") else out.add("stmt", self.stmt()))
        if t.kind != "keyword" or t.text in ("func", "struct", "map", "chan", "interface"):
            return self.body() if self.at("{") else self.simple()
        if t.text in ("const", "type", "var"):
            return self.done(Node("DeclStmt", t.start).add("decl", self.gen_decl()))
        if t.text in ("go", "defer"):
            self.next()
            return self.done(Node("GoStmt" if t.text == "go" else "DeferStmt", t.start).add("call", self.expr()))
        if t.text == "return":
            self.next()
            out = Node("ReturnStmt", t.start)
            if not self.at(";", "}"):
                out.add("result", *self.exprs())
            return self.done(out)
        if t.text in ("break", "continue", "goto", "fallthrough"):
            self.next()
            out = Node("BranchStmt", t.start, tok=t.text)
            return self.done(out.add("label", self.name()) if self.tok.kind == "name" else out)
        if t.text in ("if", "for", "switch", "select"):
            return getattr(self, f"{t.text}_stmt")()
        raise SyntaxProblem(f"offset {t.start}: unexpected {t.text!r}")

    def simple(self) -> Node:
        start = self.tok.start
        if self.at("range"):
            self.next()
            return self.done(Node("RangeStmt", start).add("x", self.expr()))
        left = self.exprs()
        if self.tok.kind == "op" and self.tok.text in _ASSIGN:
            op = self.next().text
            if self.at("range"):
                self.next()
                out = Node("RangeStmt", start, tok=op)
                for edge, x in zip(("key", "value"), left):
                    out.add(edge, x)
                return self.done(out.add("x", self.expr()))
            out = Node("AssignStmt", start, tok=op).add("lhs", *left)
            return self.done(out.add("rhs", *self.exprs()))
        if self.at("++", "--"):
            return self.done(Node("IncDecStmt", start, tok=self.next().text).add("x", left[0]))
        if self.took("<-"):
            return self.done(Node("SendStmt", start).add("chan", left[0]).add("value", self.expr()))
        return self.done(Node("ExprStmt", start).add("x", left[0]))

    def header(self) -> tuple[Node | None, Node | None]:
        """(init, the rest) of a header up to its block."""
        held, self.depth = self.depth, -1
        init = cond = None
        if not self.at("{"):
            if not self.at(";"):
                cond = self.simple()
            if self.took(";"):
                init, cond = cond, None
                if not self.at("{"):
                    cond = self.simple()
        self.depth = held
        return init, cond

    def if_stmt(self) -> Node:
        out = Node("IfStmt", self.next().start)
        init, cond = self.header()
        out.add("init", init)
        out.add("cond", cond.child("x") if cond and cond.kind == "ExprStmt" else cond)
        out.add("body", self.body())
        if self.took("else"):
            out.add("else", self.if_stmt() if self.at("if") else self.body())
        return self.done(out)

    def for_stmt(self) -> Node:
        start = self.next().start
        held, self.depth = self.depth, -1
        parts: list[Node | None] = []
        while not self.at("{"):
            if self.took(";"):
                parts.append(None)
            else:
                x = self.simple()
                if parts and parts[-1] is None:
                    parts[-1] = x
                else:
                    parts.append(x)
                if not self.at("{"):
                    self.want(";")
                    parts.append(None)
        self.depth = held
        if len(parts) == 1 and parts[0] is not None and parts[0].kind == "RangeStmt":
            out = parts[0]
            out.start = start
        else:
            out = Node("ForStmt", start)
            names = ("cond",) if len(parts) == 1 else ("init", "cond", "post")
            for edge, x in zip(names, parts):
                out.add(edge, x.child("x") if edge == "cond" and x is not None and x.kind == "ExprStmt" else x)
        return self.done(out.add("body", self.body()))

    def switch_stmt(self) -> Node:
        start = self.next().start
        init, tag = self.header()
        guard = tag.all("rhs")[0] if tag and tag.kind == "AssignStmt" else tag.child("x") if tag and tag.kind == "ExprStmt" else None
        typed = guard is not None and guard.kind == "TypeAssertExpr" and guard.tok == "type"
        out = Node("TypeSwitchStmt" if typed else "SwitchStmt", start).add("init", init)
        out.add("assign" if typed else "tag", tag if typed else tag.child("x") if tag and tag.kind == "ExprStmt" else tag)
        return self.clauses(out, "CaseClause", typed)

    def select_stmt(self) -> Node:
        return self.clauses(Node("SelectStmt", self.next().start), "CommClause", False)

    def clauses(self, out: Node, kind: str, typed: bool) -> Node:
        block = Node("BlockStmt", self.want("{").start)
        while not self.at("}"):
            clause = Node(kind, self.tok.start)
            if self.took("default"):
                clause.tok = "default"
            else:
                self.want("case")
                clause.tok = "case"
                if kind == "CommClause":
                    clause.add("comm", self.simple())
                elif typed:
                    clause.add("list", self.type())
                    while self.took(","):
                        clause.add("list", self.type())
                else:
                    clause.add("list", *self.exprs())
            self.want(":")
            self.stmts(clause)
            block.add("stmt", self.done(clause))
        self.want("}")
        return self.done(out.add("body", self.done(block)))


def rows(source: bytes) -> list[tuple]:
    """The flat nodes of a file: node_id, parent_id, edge, ord, kind, tok, start, end, line, col, end_line, func_id,
    cx_depth, cond_id, text. Ids follow the source; parents come first. cx_depth is the nesting that complexity counts,
    null where it doesn't look: inside expressions and function literals. cond_id is the if statement whose condition
    reaches the node through operators and parentheses alone."""
    text = source.decode("latin-1")
    tree = Parser(text).file()
    breaks = [-1, *(i for i, c in enumerate(text) if c == "\n")]
    out: list[tuple] = []
    stack: list[tuple[Node, int | None, str, int, int | None, int | None, int | None]] = [(tree, None, "", 0, None, None, None)]
    while stack:
        node, parent, edge, place, func, depth, cond = stack.pop()
        me = len(out)
        if node.kind == "FuncDecl":
            func, depth = me, 0
        line = bisect.bisect_left(breaks, node.start)
        col = node.start - breaks[line - 1]
        end_line = bisect.bisect_left(breaks, max(node.end - 1, node.start))
        words = node.text.encode("latin-1").decode("utf-8", "replace") if node.text is not None else None
        out.append((me, parent, edge, place, node.kind, node.tok, node.start, node.end, line, col, end_line, func, depth, cond, words))
        for k in range(len(node.children) - 1, -1, -1):
            e, child = node.children[k]
            inner = me if node.kind == "IfStmt" and e == "cond" else cond if node.kind in _OPERATORS and e in ("x", "y") else None
            stack.append((child, me, e, k, func, _depth(node, e, child, depth), inner))
    return out


_OPERATORS = frozenset({"BinaryExpr", "UnaryExpr", "ParenExpr"})
_STATEMENTS = frozenset({"stmt", "body", "else", "init", "decl", "call"})


def _depth(node: Node, edge: str, child: Node, depth: int | None) -> int | None:
    """Depth of a child: bodies, else blocks, if initialisers and clauses lie one deeper; an else-if doesn't."""
    if depth is None or edge not in _STATEMENTS or node.kind == "FuncLit":
        return None
    if node.kind == "FuncDecl":
        return depth
    if edge == "call":
        return None
    if edge == "body":
        return depth if node.kind in ("SwitchStmt", "TypeSwitchStmt", "SelectStmt") else depth + 1
    if edge == "else":
        return depth if child.kind == "IfStmt" else depth + 1
    if edge == "init":
        return depth + 1 if node.kind == "IfStmt" else None
    if node.kind in ("CaseClause", "CommClause"):
        return depth + 1
    return depth
