"""Refactorings that reach over packages, and what becomes of the tree."""

import json

import pytest

from codeloom import tools
from codeloom.golang import analyze, diagnostics, facts, scope
from codeloom.golang.parser import rows
from codeloom.operators import imports as I
from codeloom.plans import apply, execute, facades, fixes, move, signature
from codeloom.plans.extract import inline_function, inline_method
from codeloom.plans.refactor import RefactorError
from codeloom.sources import workspace
from codeloom.sources.tables import cut
from pyspark.sql import functions as F


def made(spark, files):
    return workspace.from_contents(spark, {"go.mod": "module example.org/m\n\ngo 1.22\n"} | files)


def result(ws, plan):
    plan = cut(plan)
    assert apply.issues(plan, ws.files).collect() == []
    out = {r.file: bytes(r.content).decode() for r in apply.applied(plan, ws.files).collect()}
    for text in out.values():
        if text:
            rows(text.encode())
    return out


MATH = """package main

import "example.org/m/pkg/target"

// Scale scales.
func Scale(a, b int) int {
	return b * a
}

func main() {
	_ = Scale(2, 3)
	_ = target.Greet()
}
"""
TARGET = 'package target\n\nfunc Greet() string {\n\treturn "hello"\n}\n'


def test_move_function(spark):
    ws = made(spark, {"source.go": MATH, "pkg/target/target.go": TARGET})
    out = result(ws, move.move_symbol_to(ws, ".", "Scale", "pkg/target"))
    assert out["source.go"] == 'package main\n\nimport "example.org/m/pkg/target"\n\nfunc main() {\n\t_ = target.Scale(2, 3)\n\t_ = target.Greet()\n}\n'
    assert out["pkg/target/target.go"] == TARGET + "\n// Scale was moved from example.org/m\n// Scale scales.\nfunc Scale(a, b int) int {\n\treturn b * a\n}\n"


def test_move_type_with_methods_and_imports(spark):
    a = 'package a\n\nimport (\n\t"fmt"\n\t"strings"\n)\n\ntype Box struct{ N int }\n\nfunc (b *Box) Show() string { return fmt.Sprint(b.N, Limit) }\n\nconst Limit = 3\n\nfunc Up(s string) string { return strings.ToUpper(s) }\n'
    b = "package b\n\nfunc Other() {}\n"
    c = 'package c\n\nimport "example.org/m/a"\n\nfunc Use() string {\n\tx := &a.Box{N: 1}\n\treturn x.Show()\n}\n'
    ws = made(spark, {"a/a.go": a, "b/b.go": b, "c/c.go": c})
    out = result(ws, move.move_symbol_to(ws, "a", "Box", "b"))
    assert "type Box" not in out["a/a.go"] and "Show" not in out["a/a.go"] and '"fmt"' not in out["a/a.go"] and '"strings"' in out["a/a.go"]
    assert "a.Limit" in out["b/b.go"] and 'import "example.org/m/a"' in out["b/b.go"] and 'import "fmt"' in out["b/b.go"] and "func (b *Box) Show" in out["b/b.go"]
    assert "&b.Box{N: 1}" in out["c/c.go"] and '"example.org/m/b"' in out["c/c.go"] and '"example.org/m/a"' not in out["c/c.go"]


@pytest.mark.parametrize(
    "package, name, target, why",
    [(".", "Scale", ".", "no other"), (".", "Nothing", "pkg/target", "has no"), (".", "hidden", "pkg/target", "not exported"), (".", "Uses", "pkg/target", "not exported"), (".", "Far", "pkg/target", "import each other"), (".", "Shape", "pkg/target", "doesn't move"), (".", "Greet", "pkg/target", "already")],
)
def test_moves_refused(spark, package, name, target, why):
    more = "\nfunc hidden() {}\n\nfunc Uses() { hidden() }\n\ntype Shape interface{ Area() }\n\nfunc Greet() {}\n\nfunc call() { hidden(); _ = target.Greet() }\n\nconst Limit = 1\n\nfunc Far() int { return Limit }\n\nfunc again() int { return Far() }\n"
    far = 'package far\n\nimport m "example.org/m/pkg/target"\n\nvar X = m.Greet()\n'
    ws = made(spark, {"source.go": MATH + more, "pkg/target/target.go": TARGET, "far/far.go": far})
    with pytest.raises(RefactorError, match=why):
        move.move_symbol_to(ws, package, name, target).count()


GREET = 'package main\n\nimport "fmt"\n\nfunc Greet(name string) string {\n\treturn "Item " + name\n}\n\nfunc main() {\n\tfmt.Println(Greet("Ann"))\n\tfmt.Println(Greet(Greet("Ben")))\n}\n'


def test_add_parameter(spark):
    ws = made(spark, {"main.go": GREET})
    out = result(ws, signature.change_signature(ws, ".", "Greet", [("label", "string"), ("name", "string")], defaults={"label": '"Box"'}))["main.go"]
    assert "func Greet(label string, name string) string {" in out and 'Greet("Box", "Ann")' in out and 'Greet("Box", Greet("Box", "Ben"))' in out
    out = result(ws, signature.change_signature(ws, ".", "Greet", [("name", "string"), ("n", "int"), ("p", "*T")]))["main.go"]
    assert 'Greet("Ann", 0, nil)' in out


SHAPES = """package main

type Shape interface {
	Area(scale int, unit string) float64
}

type Square struct{ a float64 }

func (s Square) Area(scale int, unit string) float64 {
	if scale == 0 {
		return 0
	}
	f := func() float64 { return 1 }
	return s.a * f() * float64(scale)
}

func Use(s Shape) float64 {
	x := s.Area(2, "cm")
	s.Area(3, "mm")
	return x
}
"""


def test_change_method_everywhere(spark):
    ws = made(spark, {"main.go": SHAPES})
    out = result(ws, signature.change_signature(ws, ".", "Area", [("unit", "string"), ("scale", "int64")], ["float64", "error"], recv="Shape"))["main.go"]
    assert "Area(unit string, scale int64) (float64, error)\n}" in out and "func (s Square) Area(unit string, scale int64) (float64, error) {" in out
    assert "return 0, nil" in out and "float64(scale), nil" in out and "func() float64 { return 1 }" in out
    assert 'x, _ := s.Area("cm", 2)' in out and '\ts.Area("mm", 3)' in out
    with pytest.raises(RefactorError, match="uses scale"):
        signature.change_signature(ws, ".", "Area", [("unit", "string")], recv="Square")
    one = made(spark, {"main.go": "package main\n\nfunc two(a int) (int, error) {\n\treturn a, nil\n}\n\nfunc main() {\n\tx, _ := two(1)\n\t_ = x\n\ttwo(2)\n}\n"})
    out = result(one, signature.change_signature(one, ".", "two", [("a", "int")], ["int"]))["main.go"]
    assert "func two(a int) int {\n\treturn a\n}" in out and "x := two(1)" in out and "\ttwo(2)" in out
    with pytest.raises(RefactorError, match="expression"):
        signature.change_signature(made(spark, {"main.go": GREET}), ".", "Greet", [("name", "string")], ["string", "error"])


@pytest.mark.parametrize("kind, value", [("int", "0"), ("string", '""'), ("bool", "false"), ("error", "nil"), ("[]int", "nil"), ("*T", "nil"), ("map[string]int", "nil"), ("T", "T{}"), ("p.T", "p.T{}")])
def test_zero_values(kind, value):
    assert signature.zero_value(kind) == value


FORMATS = """package main

import "fmt"

func handle(format string) {
	plain := format == "txt"
	rich := format == "rtf"

	if plain {
		fmt.Println("txt")
		fmt.Println("more")
	} else if rich {
		fmt.Println("rtf")
	} else {
		fmt.Println("unknown")
	}
}

func kept(x string) {
	a := x == "a"
	b := x == "b"
	if a || b {
		fmt.Println(a)
	}
}
"""


def test_boolean_branching(spark):
    ws = made(spark, {"main.go": FORMATS})
    out = result(ws, fixes.fix_boolean_branching(ws))["main.go"]
    want = 'func handle(format string) {\n\n\tswitch format {\n\tcase "txt":\n\t\tfmt.Println("txt")\n\t\tfmt.Println("more")\n\tcase "rtf":\n\t\tfmt.Println("rtf")\n\tdefault:\n\t\tfmt.Println("unknown")\n\t}\n}\n'
    assert want in out and "a || b" in out
    assert fixes.fix_boolean_branching(made(spark, {"main.go": GREET})).count() == 0


def test_conditions_of_any_depth(spark):
    many = "package p\n\nfunc f(x string, y int) {\n" + "".join(f'\tv{i} := x == "{i}"\n' for i in range(2)) + "\tif " + " || ".join([f"v{i}" for i in range(2)] + [f"y == {i}" for i in range(60)]) + " {\n\t}\n}\n"
    (r,) = analyze.boolean_branching(made(spark, {"p.go": many})).collect()
    assert (r.function, r.branch_count) == ("f", 2)


DEEP = """package main

func f(x, y int, ok bool) string {
	if x > 0 {
		if !ok {
			if y == 1 && x < 9 {
				z := x
				return "in" + string(rune(z))
			} else {
				return "c"
			}
		} else {
			y++
			return "b"
		}
	} else {
		return "a"
	}
}
"""


def test_deep_if_else(spark):
    ws = made(spark, {"main.go": DEEP})
    out = result(ws, fixes.fix_deep_if_else(ws))["main.go"]
    assert out == 'package main\n\nfunc f(x, y int, ok bool) string {\n\tif x <= 0 {\n\t\treturn "a"\n\t}\n\tif ok {\n\t\ty++\n\t\treturn "b"\n\t}\n\tif !(y == 1 && x < 9) {\n\t\treturn "c"\n\t}\n\tz := x\n\treturn "in" + string(rune(z))\n}\n'
    assert fixes.fix_deep_if_else(made(spark, {"main.go": DEEP.replace("if !ok {", "for {").replace("} else {\n\t\t\ty++\n\t\t\treturn \"b\"\n\t\t}", "}")})).count() == 0


def test_inline_method(spark):
    text = "package main\n\ntype Math struct{ k int }\n\nfunc (m *Math) Square(n int) int {\n\treturn n * n * m.k\n}\n\ntype Other struct{}\n\nfunc (o Other) Square(n int) int { return 0 }\n\nfunc main() {\n\tm := &Math{}\n\to := Other{}\n\t_ = m.Square(4)\n\t_ = 1 + m.Square(2)\n\t_ = o.Square(4)\n}\n"
    ws = made(spark, {"main.go": text})
    out = result(ws, inline_method(ws, ".", "Math", "Square"))["main.go"]
    assert "_ = 4 * 4 * m.k" in out and "_ = 1 + (2 * 2 * m.k)" in out and "_ = o.Square(4)" in out
    body = "package main\n\nfunc log(s string) {\n\tprintln(s)\n\tprintln(\"-\", s)\n}\n\nfunc main() {\n\tlog(\"a\")\n}\n"
    ws = made(spark, {"main.go": body})
    assert 'main() {\n\tprintln("a")\n\tprintln("-", "a")\n}' in result(ws, inline_function(ws, ".", "log"))["main.go"]


def test_methods_of_one_name_are_told_apart(spark):
    text = "package main\n\ntype A struct{}\n\nfunc (a A) String() string { return \"\" }\n\ntype B struct{}\n\nfunc (b *B) String() string { return \"\" }\n\nfunc f(x A, i interface{ String() string }) {\n\ty := new(B)\n\tx.String()\n\ty.String()\n\ti.String()\n}\n"
    ws = made(spark, {"main.go": text})
    found = sorted((r.line, r.recv) for r in facts.references(ws).where("name = 'String'").collect())
    assert found == [(13, "A"), (14, "B"), (15, "A"), (15, "B")]


def test_fixed_values(spark):
    text = 'package p\n\nfunc f(isDebug bool, local bool, prodMode bool) {\n\tuse(isDebug)\n\tuse(local)\n\tuse(prodMode)\n}\n\nfunc use(b bool) {}\n\nvar ErrGone error\n\nfunc g() error { return ErrGone }\n\nfunc h(err error) error { return fmt.Errorf("fail: %w", err) }\n\nfunc k(err error) error { return fmt.Errorf("operation failed: %w", err) }\n\ntype T struct{}\n\nfunc (t T) Scan() {}\n\nfunc (t T) RoundTrip() {}\n\nconst twice = 1\n\nfunc twice2(twice int) {}\n'
    ws = made(spark, {"p.go": text})
    assert {r.parameter_name for r in analyze.environment_booleans(ws).collect()} == {"isDebug", "prodMode"}
    assert {(r.function_name, r.violation_type) for r in analyze.error_wrapping(ws, "warning").collect()} == {("g", "bare_return"), ("h", "no_context")}
    found = {r.name: r.reason for r in facts.unused(ws, with_exported=True).collect()}
    assert "RoundTrip" not in found and found["Scan"] == "No references found" and found["twice"] == "Only referenced in declarations"


def test_execution(spark, tmp_path):
    files = {"go.mod": "module example.org/m\n", "source.go": MATH, "pkg/target/target.go": TARGET}
    for path, content in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    ws = workspace.load(spark, str(tmp_path))
    plan = move.move_symbol_to(ws, ".", "Scale", "pkg/target")
    new = execute.execute(ws, plan, write=True, backup=True)
    assert "target.Scale(2, 3)" in (tmp_path / "source.go").read_text() and (tmp_path / "source.go.backup").read_text() == MATH
    assert {(r.dir, r.name) for r in facts.symbols(new).where("kind = 'Function'").collect()} == {(".", "main"), ("pkg/target", "Greet"), ("pkg/target", "Scale")}
    assert execute.restore(ws) == ["pkg/target/target.go", "source.go"] and (tmp_path / "source.go").read_text() == MATH
    assert not list(tmp_path.rglob("*.backup"))
    undone = execute.execute(new, execute.reverse(ws, plan))
    assert {r.file_path: bytes(r.content).decode() for r in undone.files.collect()} == {"source.go": MATH, "pkg/target/target.go": TARGET}
    assert {(r.kind, r.name, r.direct) for r in execute.impact(ws, plan).collect()} == {("file", "source.go", True), ("file", "pkg/target/target.go", True), ("package", ".", True), ("package", "pkg/target", True)}
    bad = spark.createDataFrame([("source.go", 0, 7, "package", "pakage", "")], apply.CHANGE)
    with pytest.raises(RefactorError, match="expected 'package'"):
        execute.execute(ws, bad)
    assert execute.execute(ws, bad, allow_breaking=True).errors.count() == 1
    loop = spark.createDataFrame([("pkg/target/target.go", 14, 14, "", '\n\nimport "example.org/m"\n', "")], apply.CHANGE)
    with pytest.raises(RefactorError, match="import each other"):
        execute.execute(ws, loop)
    wrong = spark.createDataFrame([("source.go", 0, 7, "nothing", "x", "")], apply.CHANGE)
    with pytest.raises(RefactorError, match="old text"):
        execute.execute(ws, wrong, allow_breaking=True)


def test_steps(spark):
    ws = made(spark, {"main.go": GREET})
    text = json.dumps({"operations": [{"operation": "rename_symbol", "package": ".", "old": "Greet", "new": "Hail"}, {"operation": "rename_symbol", "arguments": {"package": ".", "old": "Hail", "new": "Call"}}]})
    new, report = execute.run_steps(ws, execute.parsed_steps(text), tools.OPERATIONS)
    assert [r["error"] for r in report] == [None, None] and "Call(Call(" in bytes(new.files.first().content).decode()
    same, report = execute.Steps().rename_symbol(package=".", old="Greet", new="Hail").rename_symbol(package=".", old="Greet", new="X").run(ws, tools.OPERATIONS)
    assert same is ws and report[1]["error"]
    assert execute.rename_everywhere(ws, "Greet", "Hi") == [("rename_symbol", {"package": ".", "old": "Greet", "new": "Hi"})]
    for bad in ("[1]", '[{"a": 1}]'):
        with pytest.raises(RefactorError):
            execute.parsed_steps(bad)


def test_modules(spark, tmp_path):
    files = {"go.work": "go 1.22\n\nuse (\n\t./one // first\n\t./two\n)\nuse ./none\n", "one/go.mod": "module example.org/one\n", "one/a/a.go": "package a\n", "two/go.mod": "module example.org/two\n", "two/b.go": "package b\n", "two/in/go.mod": "module example.org/inner\n", "two/in/x/x.go": "package x\n", "loose/l.go": "package l\n"}
    for path, content in files.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(content)
    ws = workspace.load(spark, str(tmp_path))
    assert {(r.dir, r.import_path) for r in ws.packages.collect()} == {("one/a", "example.org/one/a"), ("two", "example.org/two"), ("two/in/x", "example.org/inner/x"), ("loose", "loose")}
    assert {(r.dir, r.module_path) for r in workspace.work_modules(spark, str(tmp_path / "one")).collect()} == {("one", "example.org/one"), ("two", "example.org/two")}
    assert workspace.resolve_package(ws, str(tmp_path / "one/a")) == "one/a" and workspace.resolve_package(ws, "example.org/inner/x") == "two/in/x" and workspace.resolve_package(ws, "b") == "two" and workspace.resolve_package(ws, "zzz") == "zzz"
    assert workspace.resolve_file(ws, str(tmp_path / "two/b.go")) == "two/b.go"
    assert [r.text for r in workspace.numbered_lines(ws, "two/b.go", 1, 1).collect()] == ["1: package b"]
    assert [(r.package, r.files, r.errors) for r in workspace.status(ws).collect()] == [("loose", 1, 0), ("one/a", 1, 0), ("two", 1, 0), ("two/in/x", 1, 0)]


def test_refresh_parses_changed_files_alone(spark):
    ws = made(spark, {"a/a.go": "package a\n\nfunc A() {}\n", "b/b.go": "package b\n", "c/c.go": "package c\n"})
    changed = spark.createDataFrame([("a/a.go", b"package a\n\nfunc B() {}\n"), ("b/b.go", None), ("d/d.go", b"package d\n\nfunc {"), ("x.txt", b"no")], "file_path string, content binary")
    new = workspace.refreshed(ws, changed)
    assert {r.file_path for r in new.files.collect()} == {"a/a.go", "c/c.go", "d/d.go"} and [r.file_path for r in new.errors.collect()] == ["d/d.go"]
    assert [r.name for r in facts.symbols(new).collect()] == ["B"] and {r.dir for r in new.packages.collect()} == {"a", "c"}
    again = workspace.refreshed(new, spark.createDataFrame([("d/d.go", b"package d\n")], "file_path string, content binary"))
    assert again.errors.count() == 0 and {r.dir for r in again.packages.collect()} == {"a", "c", "d"}


SCOPED = """package p

import "fmt"

var x = 1

func f(a int) (r int) {
	x := a
	if y := x; y > 0 {
		x := y
		fmt.Println(x, missing)
	} else {
		_ = y
	}
	for i, v := range []int{x} {
		g := func(q int) int { return q + i + v }
		r += g(x)
	}
	return len(helpr)
}

func helper() int { return x }
"""


def test_scopes(spark):
    ws = made(spark, {"p.go": SCOPED})
    found = {(r.name, SCOPED[: r.pos].count("\n") + 1): (r.level, SCOPED[: r.decl_pos].count("\n") + 1 if r.decl_pos is not None else None) for r in scope.resolved(ws).collect()}
    assert found["a", 8] == ("local", 7) and found["x", 9] == ("local", 8) and found["y", 10] == ("local", 9) and found["x", 11] == ("local", 10) and found["y", 13] == ("local", 9)
    assert found["x", 15] == ("local", 8) and found["i", 16] == ("local", 15) and found["q", 16] == ("local", 16) and found["r", 17] == ("local", 7) and found["x", 22] == ("package", 5)
    assert found["fmt", 11] == ("import", 3) and found["len", 19][0] == "builtin" and found["missing", 11][0] == "unresolved"
    at = SCOPED.index("missing")
    assert [r.kind for r in scope.scope_at(ws, "p.go", at).collect()] == ["block", "if", "block", "function", "file"]
    names = [r.name for r in scope.visible(ws, "p.go", at).collect()]
    assert names[0] == "x" and set(names) == {"x", "y", "a", "r", "f", "helper", "fmt"}
    up = {r.scope_id: r.parent_id for r in scope.tree(ws).collect()}
    assert sum(p is None for p in up.values()) == 1 and all(p is None or p < s for s, p in up.items())
    wrong = {r.name: (r.function, r.scope, r.suggestions) for r in diagnostics.unresolved(ws).collect()}
    assert wrong["helpr"] == ("f", "block", ["helper"]) and wrong["missing"][:2] == ("f", "block") and set(wrong) == {"helpr", "missing"}


def test_diagnostics(spark):
    ws = made(spark, {"lib/lib.go": "package lib\n\nfunc openFile() {}\n\nfunc OpenFile() {}\n\ntype Thing struct{}\n", "main.go": "package main\n\nfunc Thing() {}\n"})
    first = lambda df: df.first()
    assert first(diagnostics.visibility_error(ws, "lib", "openFile", ".")).suggestions == ["Symbol 'openFile' is not exported from package 'lib'", "To make it accessible, rename it to 'Openfile'", "Did you mean the exported function 'OpenFile'?"]
    assert first(diagnostics.type_error(ws, ".", "Thing", "Type")).suggestions == ["Expected Type, but 'Thing' is Function", "Found Type 'Thing' in lib"]
    assert first(diagnostics.import_error(ws, "lob")).suggestions == ["Package 'lob' not found", "Did you mean 'lib'?", "Did you mean the standard library package 'os'?", "Did you mean the standard library package 'io'?", "Did you mean the standard library package 'log'?"]
    r = first(diagnostics.formatted(diagnostics.resolution_failure(ws, "lib", "OpenFil")))
    assert r.report == "SymbolNotFound: symbol 'OpenFil' not found in lib\n  Suggestions:\n    - Did you mean 'OpenFile' (Function in lib)?\n    - Did you mean 'openFile' (Function in lib)?\n    - Available: OpenFile, Thing, openFile"


def test_facades(spark):
    ws = made(spark, {"mods/a/a.go": "package a\n\nfunc Open() {}\n\nconst Max = 1\n\nfunc hid() {}\n", "mods/b/b.go": "package b\n\ntype T struct{}\n", "api/old/f.go": 'package old\n\nimport "example.org/m/mods/a"\n\nvar Open = a.Open\n', "api/old/g.go": "package old\n\n// nothing\n"})
    assert [r.dir for r in facades.detected(ws).collect()] == ["api/old"]
    out = result(ws, facades.generate_facades(ws, "mods", "api"))
    assert out == {"api/a/facade.go": 'package a\n\nimport "example.org/m/mods/a"\n\nconst Max = a.Max\nvar Open = a.Open\n', "api/b/facade.go": 'package b\n\nimport "example.org/m/mods/b"\n\ntype T = b.T\n'}
    assert set(result(ws, facades.generate_facades(ws, "mods", "api", ["OPEN"]))) == {"api/a/facade.go"}
    out = result(ws, facades.update_facades(ws))
    assert out == {"api/old/f.go": 'package old\n\nimport "example.org/m/mods/a"\n\nconst Max = a.Max\nvar Open = a.Open\n', "api/old/g.go": ""}


def test_import_classes(spark):
    df = spark.createDataFrame([("fmt",), ("example.org/m/x",), ("example.org/other",), ("github.com/a/b",), ("./x",), ("my.io/api/handler",), ("a/service",), ("a/domain",), ("a/z",)], "path string")
    got = {r.path: (r.c, r.t, r.e) for r in df.select("path", I.import_class(F.col("path"), "example.org/m", ["example.org/other"]).alias("c"), I.package_tier(F.col("path")).alias("t"), I.is_external(F.col("path")).alias("e")).collect()}
    assert got == {"fmt": ("stdlib", -1, True), "example.org/m/x": ("module", -1, False), "example.org/other": ("workspace", -1, False), "github.com/a/b": ("external", -1, True), "./x": ("external", -1, False), "my.io/api/handler": ("external", 2, False), "a/service": ("stdlib", 1, True), "a/domain": ("stdlib", 0, True), "a/z": ("stdlib", -1, True)}


def test_engine(spark, tmp_path):
    (tmp_path / "go.mod").write_text("module example.org/e\n")
    (tmp_path / "main.go").write_text(GREET)
    engine = tools.Engine(spark, str(tmp_path))
    rename = tools.Operation("rename_symbol", {"package": ".", "old": "Greet", "new": "Hail"})
    assert rename.description == "rename_symbol(new='Hail', old='Greet', package='.')" and rename.validate(engine.workspace).count() == 0
    assert engine.preview(rename).count() == 4 and engine.impact(rename).count() == 2
    engine.execute(rename)
    assert "Hail(Hail(" in (tmp_path / "main.go").read_text() and engine.report("status").count() == 1
    engine.rollback()
    assert (tmp_path / "main.go").read_text() == GREET
    with pytest.raises(RefactorError):
        engine.rollback()
    engine.save_plan(rename, f"{tmp_path}/plan")
    engine.run_plan(f"{tmp_path}/plan")
    (tmp_path / "main.go").write_text(GREET.replace("Greet", "Meet"))
    assert engine.sync().files.count() == 1 and "Meet" in {r.name for r in engine.report("symbols").collect()}
    assert [r["error"] for r in engine.run_steps([("rename_symbol", {"package": ".", "old": "Meet", "new": "Greet"})])] == [None]
    assert (tmp_path / "main.go").read_text() == GREET
    assert json.loads(tools.answer(engine.workspace, "status"))["rows"][0]["package"] == "."
    assert json.loads(tools.answer(engine.workspace, "nothing")) == {"ok": False, "error": "no tool nothing"}
    loose = tools.Engine(spark, str(tmp_path), allow_breaking=True)
    bad = spark.createDataFrame([("main.go", 0, 7, "package", "pakage", "")], apply.CHANGE)
    assert loose.execute_plan(bad, write=False).errors.count() == 1


def test_more_reports(spark):
    ws = made(spark, {"main.go": SHAPES, "a/a.go": 'package a\n\nimport (\n\t"fmt"\n\t"github.com/x/y"\n)\n\nvar X = fmt.Sprint(y.Z)\n'})
    assert [tuple(r) for r in tools.run(ws, "interfaces_for_method", package=".", recv="Square", method="Area").collect()] == [(".", "Shape")]
    at = SHAPES.index("s.a * f()")
    assert [tuple(r) for r in tools.run(ws, "identifier_type", file="main.go", offset=at).collect()] == [("s", ".", "Square")]
    assert {tuple(r) for r in tools.run(ws, "external_dependencies").collect()} == {("fmt", 1), ("github.com/x/y", 1)}
    kinds = ["example.org/m/a.T", "*example.org/q/b.T", "map[string][]net/http.Handler", "int", "func(example.org/m/a.T) deep/er/z.U"]
    from codeloom.golang.resolve import shortened

    got = [r.s for r in spark.createDataFrame([(k,) for k in kinds], "k string").select(shortened(F.col("k"), "example.org/m/a", {"example.org/q/b": "bb"}).alias("s")).collect()]
    assert got == ["T", "*bb.T", "map[string][]http.Handler", "int", "func(T) z.U"]
    fixed = {(r.fix, r.file, r.line, r.edits) for r in tools.run(made(spark, {"f.go": FORMATS, "d.go": DEEP}), "fix_results").collect()}
    assert fixed == {("fix_boolean_branching", "f.go", 6, 3), ("fix_deep_if_else", "d.go", 4, 1)}


def test_extract_block_and_constants(spark):
    text = 'package main\n\nfunc f(n int) {\n\tif n > 7 {\n\t\tm := n + 7\n\t\tprintln(m)\n\t}\n}\n\nfunc g() { println(7) }\n'
    other = "package main\n\nfunc h() { println(7) }\n"
    ws = made(spark, {"main.go": text, "h.go": other})
    out = result(ws, tools.run(ws, "extract_block", file="main.go", line=5, name="more"))["main.go"]
    assert "\tif n > 7 {\n\t\tmore(n)\n\t}\n}\n\nfunc more(n int) {\n\tm := n + 7\n\tprintln(m)\n}\n" in out
    one = result(ws, tools.run(ws, "extract_constant", file="main.go", func="f", literal="7", name="seven"))
    assert set(one) == {"main.go"} and "println(7)" in one["main.go"] and "n > seven" in one["main.go"]
    assert "println(seven)" in result(ws, tools.run(ws, "extract_constant", file="main.go", func="f", literal="7", name="seven", scope="file"))["main.go"]
    assert "println(seven)" in result(ws, tools.run(ws, "extract_constant", file="main.go", func="f", literal="7", name="seven", scope="package"))["h.go"]
    with pytest.raises(RefactorError):
        tools.run(ws, "extract_constant", file="main.go", func="f", literal="7", name="g")


def test_forced_delete(spark):
    text = "package main\n\n// old does nothing.\nfunc old() int { return 1 }\n\nfunc main() {\n\told()\n\tif true {\n\t\tx := old()\n\t\t_ = x\n\t}\n\tprintln(2)\n}\n"
    ws = made(spark, {"main.go": text})
    with pytest.raises(RefactorError, match="2 references"):
        tools.run(ws, "safe_delete", package=".", name="old")
    out = result(ws, tools.run(ws, "safe_delete", package=".", name="old", force=True))["main.go"]
    assert "old" not in out and "println(2)" in out
    bad = made(spark, {"main.go": text + "\nvar y = old()\n"})
    with pytest.raises(RefactorError, match="outside statements"):
        tools.run(bad, "safe_delete", package=".", name="old", force=True)


NESTS = """package p

func loops(a int) int {
	if a > 0 {
		for {
			if a > 1 {
				if a > 2 {
					return 1
				} else {
					return 2
				}
			} else {
				return 3
			}
		}
	} else {
		return 4
	}
}

func chained(a int) int {
	if a > 0 {
		return 1
	} else if a > 1 {
		return 2
	} else if a > 2 {
		return 3
	} else {
		if a > 3 {
			a++
		} else {
			a--
		}
	}
	return a
}
"""


def test_what_counts_as_nesting(spark):
    """A loop between two ifs parts them; else-if and else blocks nest."""
    (r,) = analyze.deep_if_else(made(spark, {"p.go": NESTS})).collect()
    assert (r.function_name, r.line, r.nesting_depth, r.happy_path_depth, r.error_branches, r.complexity_reduction_estimate) == ("chained", 22, 4, 1, 0, 75)
    assert analyze.deep_if_else(made(spark, {"p.go": NESTS}), most=1).count() == 2
