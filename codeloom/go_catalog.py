"""Catalogue queries over Go trees: facts, reports, analyzers and refactorings, from source text to rows.

The trees are written below; a query reads none of the given tables. Its SQL states the rows that it must give, worked
out by hand from the trees: changed files are the tree's text with the lines that a refactoring has to change replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.golang import analyze, diagnostics, facts, resolve, scope
from codeloom.operators import graph
from codeloom.operators import imports as imports_of
from codeloom.plans import apply, changes, execute, extract, facades, fixes, move, refactor, signature, wide
from codeloom.sources import workspace
from codeloom.sources.workspace import Workspace

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DEPOT = {
    "go.mod": "module example.org/depot\n\ngo 1.22\n",
    "main.go": """package main

import (
	"fmt"
	"os"

	"example.org/depot/stock"
)

const limit = 3

func main() {
	s := &stock.Shelf{}
	fmt.Println(s.Count(), twice(limit))
	show(s)
}

func twice(n int) int {
	return n * 2
}

func show(c stock.Counter) {
	fmt.Println(c.Count())
}

func orphan() {}
""",
    "stock/stock.go": """package stock

type Counter interface {
	Count() int
}

type Base struct{ total int }

func (b *Base) Count() int { return b.total }

type Shelf struct {
	*Base
	name string
}

func (s Shelf) Label() string { return s.name }

var hidden = 1
""",
    "report/report.go": """package report

import "example.org/depot/stock"

func Total(c stock.Counter) int {
	return c.Count()
}
""",
}
CHECKS = {
    "go.mod": "module example.org/checks\n",
    "checks.go": """package checks

import (
	"context"
	"fmt"
)

func Load(kind string, isProd bool) (string, error) {
	isFile := kind == "file"
	isNet := kind == "net"
	if isFile {
		return read(context.Background(), isProd)
	} else if isNet {
		return "", fmt.Errorf("no net: %v", errNet)
	}
	if v, err := read(context.TODO(), false); err != nil {
		return "", err
	} else {
		fmt.Println(v)
	}
	return "", nil
}

var errNet error

func read(ctx context.Context, isProd bool) (string, error) {
	for i := 0; i < 3; i++ {
		switch {
		case isProd:
			fmt.Println(i)
		}
	}
	return "", ctx.Err()
}

func nested(a, b, c int) int {
	if a > 0 {
		if b > 0 {
			if c > 0 {
				return 1
			} else {
				return 2
			}
		} else {
			return 3
		}
	} else {
		return 4
	}
}
""",
}
WORK = {
    "go.mod": "module example.org/work\n",
    "main.go": """package main

import (
	"fmt"

	"example.org/work/calc"
	tools "example.org/work/tools"
)

const rate = 7

func Double(n int) int {
	return n * 2
}

func run() int {
	x := 12
	y := 30
	total := x - y
	fmt.Println(total)
	return Double(x) + rate
}

func main() {
	c := &calc.Calc{}
	c.Add(5)
	fmt.Println(run(), c.Cube(4), tools.Up("a"), Sign("Bo"))
}

func Sign(name string) string {
	text := "Yours, " + name
	return text
}

func unused() string {
	return "never"
}
""",
    "calc/calc.go": """package calc

type Adder interface {
	Add(n int)
}

type Calc struct {
	value int
}

func (c *Calc) Add(n int) {
	total := n + 1
	c.value += total
}

func (c *Calc) Cube(n int) int {
	return n * n * n
}
""",
    "tools/tools.go": """package tools

import "strings"

const Limit = 3

func Up(s string) string {
	return strings.ToUpper(s)
}
""",
}
FACADES = {
    "go.mod": "module example.org/f\n",
    "mods/a/a.go": "package a\n\nfunc Open() {}\n\nconst Max = 1\n\nfunc hidden() {}\n",
    "mods/b/b.go": "package b\n\ntype Thing struct{}\n\nvar Now = 1\n",
    "api/old.go": 'package api\n\nimport "example.org/f/mods/a"\n\nvar Open = a.Open\n',
}
LOOP = {
    "go.mod": "module example.org/l\n",
    "a/a.go": 'package a\n\nimport "example.org/l/b"\n\nvar X = b.X\n',
    "b/b.go": 'package b\n\nimport "example.org/l/c"\n\nvar X = c.X\n',
    "c/c.go": 'package c\n\nimport "example.org/l/a"\n\nvar X = a.X\n',
    "d/d.go": 'package d\n\nimport (\n\t"example.org/l/a"\n\tq "example.org/l/b"\n\tq "example.org/l/c"\n)\n\nvar X = a.X + q.X\n',
}
MESSY = {"m.go": 'package m\n\nimport (\n\t"strings"\n\t"example.org/x/b"\n\t"fmt"\n\ta "example.org/x/a"\n)\n\nvar X = fmt.Sprint(strings.Title, b.X, a.X)\n'}
_loaded: dict[tuple[str, int], Workspace] = {}


def loaded(spark: SparkSession, tree: dict[str, str]) -> Workspace:
    """A tree's workspace, parsed once for each session."""
    key = spark.sparkContext.applicationId, id(tree)
    if key not in _loaded:
        _loaded[key] = workspace.from_contents(spark, tree)
    return _loaded[key]


def _literal(x: object) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, (bool, int)):
        return str(x).lower()
    return "'" + str(x).replace("'", "''") + "'"


def _values(columns: str, rows: list[tuple]) -> str:
    """SQL of the given rows; columns: names with their SQL types."""
    named = [c.split() for c in columns.split(", ")]
    cast = ", ".join(f'CAST("{n}" AS {t}) AS "{n}"' for n, t in named)
    listed = ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in rows)
    return f"SELECT {cast} FROM (VALUES {listed}) t({', '.join(f'"{n}"' for n, _ in named)})"


def query(tree: dict[str, str], columns: str, rows: list[tuple]) -> Callable[[Callable[[Workspace], DataFrame]], None]:
    """Register a query over a tree with the rows that it must give. Its columns are cast to the named types."""

    def add(f: Callable[[Workspace], DataFrame]) -> None:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            named = [c.split() for c in columns.split(", ")]
            types = {"VARCHAR": "string", "BIGINT": "long", "BOOLEAN": "boolean"}
            return f(loaded(spark, tree)).select(*[F.col(n).cast(types[t]).alias(n) for n, t in named])

        QUERIES[f.__name__], SQL[f.__name__] = run, _values(columns, rows)

    return add


def changed(tree: dict[str, str], **edits) -> Callable[[Callable[[Workspace], DataFrame]], None]:
    """Register a refactoring with what becomes of each file: a list of (old, new) replacements in the tree's text, or
    the whole new text."""
    rows = []
    for file, made in edits["files"].items():
        text = tree.get(file, "")
        if isinstance(made, list):
            for old, new in made:
                assert old in text, (file, old)
                text = text.replace(old, new)
        else:
            text = made
        rows.append((file, text))

    def add(f: Callable[[Workspace], DataFrame]) -> None:
        def result(ws: Workspace) -> DataFrame:
            plan = f(ws)
            return apply.applied(plan, ws.files).select("file", F.decode("content", "UTF-8").alias("content"))

        result.__name__ = f.__name__
        query(tree, "file VARCHAR, content VARCHAR", rows)(result)

    return add


# Facts


@query(DEPOT, "package VARCHAR, name VARCHAR, import_path VARCHAR, files BIGINT, test_files BIGINT, errors BIGINT", [(".", "main", "example.org/depot", 1, 0, 0), ("report", "report", "example.org/depot/report", 1, 0, 0), ("stock", "stock", "example.org/depot/stock", 1, 0, 0)])
def g01_workspace_status(ws):
    return workspace.status(ws)


@query(
    DEPOT,
    "dir VARCHAR, name VARCHAR, kind VARCHAR, recv VARCHAR, line BIGINT, exported BOOLEAN, signature VARCHAR",
    [
        (".", "limit", "Constant", None, 10, False, "limit"),
        (".", "main", "Function", None, 12, False, "main()"),
        (".", "twice", "Function", None, 18, False, "twice(n)"),
        (".", "show", "Function", None, 22, False, "show(c)"),
        (".", "orphan", "Function", None, 26, False, "orphan()"),
        ("stock", "Counter", "Interface", None, 3, True, "Counter"),
        ("stock", "Count", "Method", "Counter", 4, True, "Count"),
        ("stock", "Base", "Type", None, 7, True, "Base"),
        ("stock", "Count", "Method", "Base", 9, True, "Count()"),
        ("stock", "Shelf", "Type", None, 11, True, "Shelf"),
        ("stock", "Label", "Method", "Shelf", 16, True, "Label()"),
        ("stock", "hidden", "Variable", None, 18, False, "hidden"),
        ("report", "Total", "Function", None, 5, True, "Total(c)"),
    ],
)
def g02_symbols(ws):
    return facts.symbols(ws)


# Shelf has no method Count of its own, so that call may mean any; c is a Counter.
@query(
    DEPOT,
    "dir VARCHAR, name VARCHAR, recv VARCHAR, file_path VARCHAR, line BIGINT",
    [
        (".", "limit", None, "main.go", 14),
        (".", "twice", None, "main.go", 14),
        (".", "show", None, "main.go", 15),
        ("stock", "Shelf", None, "main.go", 13),
        ("stock", "Counter", None, "main.go", 22),
        ("stock", "Count", "Counter", "main.go", 14),
        ("stock", "Count", "Base", "main.go", 14),
        ("stock", "Count", "Counter", "main.go", 23),
        ("stock", "Base", None, "stock/stock.go", 9),
        ("stock", "Base", None, "stock/stock.go", 12),
        ("stock", "Shelf", None, "stock/stock.go", 16),
        ("stock", "Counter", None, "report/report.go", 5),
        ("stock", "Count", "Counter", "report/report.go", 6),
    ],
)
def g03_references(ws):
    return facts.references(ws)


@query(DEPOT, "name VARCHAR, kind VARCHAR, package VARCHAR, file VARCHAR, line BIGINT, safe_to_delete BOOLEAN, reason VARCHAR", [("orphan", "Function", ".", "main.go", 26, True, "No references found"), ("hidden", "Variable", "stock", "stock/stock.go", 18, True, "No references found")])
def g04_unused(ws):
    return facts.unused(ws)


@query(DEPOT, "file_path VARCHAR, ord BIGINT, path VARCHAR, given VARCHAR, alias VARCHAR", [("main.go", 1, "fmt", None, "fmt"), ("main.go", 2, "os", None, "os"), ("main.go", 3, "example.org/depot/stock", None, "stock"), ("report/report.go", 1, "example.org/depot/stock", None, "stock")])
def g05_imports(ws):
    return facts.imports(ws)


@query(DEPOT, "file_path VARCHAR, path VARCHAR", [("main.go", "os")])
def g06_unused_imports(ws):
    return facts.unused_imports(ws)


@query(DEPOT, "src VARCHAR, dst VARCHAR, is_test BOOLEAN", [(".", "stock", False), ("report", "stock", False)])
def g07_import_edges(ws):
    return facts.import_edges(ws)


@query(DEPOT, "dir VARCHAR, type VARCHAR, method VARCHAR, depth BIGINT", [("stock", "Counter", "Count", 0), ("stock", "Base", "Count", 0), ("stock", "Shelf", "Label", 0), ("stock", "Shelf", "Count", 1)])
def g08_method_sets(ws):
    return resolve.method_sets(ws)


@query(DEPOT, "interface VARCHAR, type VARCHAR, missing VARCHAR", [("Counter", "Base", ""), ("Counter", "Shelf", "")])
def g09_implementations(ws):
    return resolve.implementations(ws).withColumn("missing", F.array_join("missing", ","))


@query(DEPOT, "rank BIGINT, dir VARCHAR, name VARCHAR, kind VARCHAR, file VARCHAR, line BIGINT", [(1, "stock", "Shelf", "Type", "stock/stock.go", 11)])
def g10_definition(ws):
    return resolve.definition(ws, ".", "Shelf")


@query(DEPOT, "name VARCHAR, kind VARCHAR, package VARCHAR, distance BIGINT", [("twice", "Function", ".", 1)])
def g11_suggestions(ws):
    return resolve.suggestions(ws, "twise")


@query(
    DEPOT,
    "name VARCHAR, level VARCHAR, kind VARCHAR, uses BIGINT",
    [
        ("s", "local", "Variable", 3),
        ("s", "local", "Parameter", 1),
        ("stock", "import", "Package", 3),
        ("fmt", "import", "Package", 2),
        ("twice", "package", "Function", 1),
        ("limit", "package", "Constant", 1),
        ("show", "package", "Function", 1),
        ("int", "builtin", "Type", 4),
        ("string", "builtin", "Type", 1),
        ("n", "local", "Parameter", 1),
        ("c", "local", "Parameter", 2),
        ("b", "local", "Parameter", 1),
        ("Base", "package", "Type", 1),
        ("Shelf", "package", "Type", 1),
    ],
)
def g12_scopes(ws):
    return scope.resolved(ws).groupBy("name", "level", "kind").agg(F.count("*").alias("uses"))


@query(DEPOT, "problem VARCHAR, message VARCHAR, hints VARCHAR", [("VisibilityViolation", "cannot access unexported symbol 'hidden'", "Symbol 'hidden' is not exported from package 'stock'|To make it accessible, rename it to 'Hidden'"), ("SymbolNotFound", "package 'ox' not found", "Package 'ox' not found|Did you mean '.'?|Did you mean the standard library package 'os'?|Did you mean the standard library package 'io'?|Did you mean the standard library package 'log'?")])
def g13_diagnostics(ws):
    rows = diagnostics.visibility_error(ws, "stock", "hidden", ".").unionByName(diagnostics.import_error(ws, "ox"))
    return rows.withColumn("hints", F.array_join("suggestions", "|"))


@query(DEPOT, "dir VARCHAR, name VARCHAR, kind VARCHAR, used_by VARCHAR", [("stock", "Counter", "Interface", ".,report")])
def g14_shared_symbols(ws):
    return resolve.shared_symbols(ws).withColumn("used_by", F.array_join("packages", ","))


@query(DEPOT, "package VARCHAR, imports BIGINT, imported_by BIGINT, exported_symbols BIGINT, level BIGINT", [(".", 1, 0, 0, 1), ("report", 1, 0, 1, 1), ("stock", 0, 2, 3, 0)])
def g15_dependencies(ws):
    return resolve.dependencies(ws)


@query(LOOP, "cycle VARCHAR, members VARCHAR, size BIGINT", [("a", "a,b,c", 3)])
def g16_import_cycles(ws):
    return resolve.cycle_report(ws)


@query(DEPOT, "src VARCHAR, dst VARCHAR, src_tier BIGINT, dst_tier BIGINT", [("report", "stock", 1, 2)])
def g17_layer_breaks(ws):
    return resolve.layer_breaks(ws, [("report", 1), ("stock", 2)])


@query(DEPOT, "path VARCHAR, class VARCHAR, external BOOLEAN", [("fmt", "stdlib", True), ("os", "stdlib", True), ("example.org/depot/stock", "module", False)])
def g18_import_classes(ws):
    rows = facts.imports(ws).select("path").distinct()
    return rows.select("path", imports_of.import_class(F.col("path"), "example.org/depot").alias("class"), imports_of.is_external(F.col("path")).alias("external"))


@query(DEPOT, "name VARCHAR, references BIGINT, files BIGINT, packages BIGINT", [("Counter", 2, 2, 2)])
def g19_symbol_report(ws):
    return resolve.symbol_report(ws, "stock", "Counter")


# Analyzers


@query(CHECKS, "function VARCHAR, line BIGINT, cyclomatic_complexity BIGINT, cognitive_complexity BIGINT, lines_of_code BIGINT, parameters BIGINT, max_nesting_depth BIGINT, level VARCHAR", [("Load", 8, 5, 3, 15, 2, 1, "moderate"), ("read", 26, 4, 3, 9, 2, 2, "low"), ("nested", 36, 7, 6, 15, 3, 3, "moderate")])
def g20_complexity(ws):
    return analyze.complexity(ws, 1)


@query(CHECKS, "line BIGINT, variables VARCHAR, expression VARCHAR, function VARCHAR", [(16, "v,err", "read(context.TODO(), false)", "Load")])
def g21_if_init(ws):
    return analyze.if_init(ws).withColumn("variables", F.array_join("variables", ","))


@query(CHECKS, "line BIGINT, function_name VARCHAR, signature VARCHAR, calls VARCHAR", [(8, "Load", "func Load(kind string, isProd bool) (string, error)", "context.Background,context.TODO")])
def g22_missing_context(ws):
    return analyze.missing_context(ws).withColumn("calls", F.array_join("context_calls", ","))


@query(CHECKS, "line BIGINT, function VARCHAR, source_variable VARCHAR, variables VARCHAR, branch_count BIGINT", [(9, "Load", "kind", "isFile,isNet", 2)])
def g23_boolean_branching(ws):
    return analyze.boolean_branching(ws).withColumn("variables", F.array_join("boolean_variables", ","))


@query(CHECKS, "line BIGINT, function_name VARCHAR, nesting_depth BIGINT, error_branches BIGINT, complexity_reduction_estimate BIGINT", [(37, "nested", 3, 3, 66)])
def g24_deep_if_else(ws):
    return analyze.deep_if_else(ws)


@query(CHECKS, "line BIGINT, function_name VARCHAR, violation_type VARCHAR, severity VARCHAR, new_text VARCHAR", [(14, "Load", "format_verb_v_instead_of_w", "critical", 'fmt.Errorf("no net: %w", errNet)'), (17, "Load", "bare_return", "critical", 'fmt.Errorf("load: %w", err)')])
def g25_error_wrapping(ws):
    return analyze.error_wrapping(ws, "warning")


@query(CHECKS, "line BIGINT, function_name VARCHAR, parameter_name VARCHAR, propagation_depth BIGINT, chain VARCHAR", [(8, "Load", "isProd", 1, "Load>read")])
def g26_environment_booleans(ws):
    return analyze.environment_booleans(ws).withColumn("chain", F.array_join("call_chain", ">"))


@changed(CHECKS, files={"checks.go": [('\tif v, err := read(context.TODO(), false); err != nil {\n', '\tv, err := read(context.TODO(), false)\n\tif err != nil {\n')]})
def g27_fix_if_init(ws):
    return refactor.fix_if_init(ws)


@changed(CHECKS, files={"checks.go": [('\tisFile := kind == "file"\n\tisNet := kind == "net"\n\tif isFile {\n\t\treturn read(context.Background(), isProd)\n\t} else if isNet {\n\t\treturn "", fmt.Errorf("no net: %v", errNet)\n\t}\n', '\tswitch kind {\n\tcase "file":\n\t\treturn read(context.Background(), isProd)\n\tcase "net":\n\t\treturn "", fmt.Errorf("no net: %v", errNet)\n\t}\n')]})
def g28_fix_boolean_branching(ws):
    return fixes.fix_boolean_branching(ws)


@changed(CHECKS, files={"checks.go": [("\tif a > 0 {\n\t\tif b > 0 {\n\t\t\tif c > 0 {\n\t\t\t\treturn 1\n\t\t\t} else {\n\t\t\t\treturn 2\n\t\t\t}\n\t\t} else {\n\t\t\treturn 3\n\t\t}\n\t} else {\n\t\treturn 4\n\t}\n", "\tif a <= 0 {\n\t\treturn 4\n\t}\n\tif b <= 0 {\n\t\treturn 3\n\t}\n\tif c <= 0 {\n\t\treturn 2\n\t}\n\treturn 1\n")]})
def g29_fix_deep_if_else(ws):
    return fixes.fix_deep_if_else(ws)


@changed(CHECKS, files={"checks.go": [('"no net: %v"', '"no net: %w"'), ('return "", err\n', 'return "", fmt.Errorf("load: %w", err)\n')]})
def g30_fix_error_wrapping(ws):
    return refactor.fix_error_wrapping(ws)


# Refactorings


@changed(WORK, files={"main.go": [("Double", "Twofold")]})
def g31_rename_symbol(ws):
    return refactor.rename_symbol(ws, ".", "Double", "Twofold")


@changed(WORK, files={"main.go": [("c.Cube(", "c.Power(")], "calc/calc.go": [(") Cube(", ") Power(")]})
def g32_rename_method(ws):
    return refactor.rename_symbol(ws, "calc", "Cube", "Power", "Calc")


@changed(WORK, files={"main.go": [("c.Add(", "c.Plus(")], "calc/calc.go": [("Add(n int)", "Plus(n int)")]})
def g33_rename_interface_method(ws):
    return wide.rename_interface_method(ws, "Add", "Plus")


@changed(WORK, files={"main.go": [("&calc.Calc", "&count.Calc")], "calc/calc.go": [("package calc", "package count")]})
def g34_rename_package(ws):
    return refactor.rename_package(ws, "calc", "count")


@changed(WORK, files={"main.go": [("func Double(n int) int {\n\treturn n * 2\n}\n\n", ""), ("Double(x)", "calc.Double(x)")], "calc/calc.go": [("\treturn n * n * n\n}\n", "\treturn n * n * n\n}\n\n// Double was moved from example.org/work\nfunc Double(n int) int {\n\treturn n * 2\n}\n")]})
def g35_move_symbol(ws):
    return move.move_symbol_to(ws, ".", "Double", "calc")


@changed(WORK, files={"main.go": [('"example.org/work/tools"', '"example.org/work/pkg/tools"')], "tools/tools.go": "", "pkg/tools/tools.go": WORK["tools/tools.go"]})
def g36_move_package(ws):
    return refactor.move_package(ws, "tools", "pkg/tools")


@changed(WORK, files={"main.go": [('"example.org/work/calc"', '"example.org/work/lib"')], "calc/calc.go": "", "lib/calc.go": WORK["calc/calc.go"]})
def g37_move_dir(ws):
    return wide.move_dir(ws, "calc", "lib")


@changed(WORK, files={"main.go": [("\ttotal := x - y\n\tfmt.Println(total)\n", "\tshowTotal(x, y)\n"), ("\treturn Double(x) + rate\n}\n", "\treturn Double(x) + rate\n}\n\nfunc showTotal(x int, y int) {\n\ttotal := x - y\n\tfmt.Println(total)\n}\n")]})
def g38_extract_function(ws):
    return extract.extract_function(ws, "main.go", 19, 20, "showTotal")


@changed(WORK, files={"calc/calc.go": [("\ttotal := n + 1\n\tc.value += total\n}\n", "\tc.grow(n)\n}\n\nfunc (c *Calc) grow(n int) {\n\ttotal := n + 1\n\tc.value += total\n}\n")]})
def g39_extract_method(ws):
    return extract.extract_method(ws, "calc/calc.go", 12, 13, "grow")


@changed(WORK, files={"main.go": [("\treturn Double(x) + rate\n", "\tbig := Double(x)\n\treturn big + rate\n")]})
def g40_extract_variable(ws):
    return extract.extract_variable(ws, "main.go", 21, "Double(x)", "big")


@changed(WORK, files={"main.go": [("func run() int {\n\tx := 12\n", "const dozen = 12\n\nfunc run() int {\n\tx := dozen\n")]})
def g41_extract_constant(ws):
    return refactor.extract_constant(ws, "main.go", "run", "12", "dozen")


@changed(WORK, files={"calc/shape.go": "package calc\n\ntype Shape interface {\n\tAdd(n int)\n\tCube(n int) int\n}\n"})
def g42_extract_interface(ws):
    return refactor.extract_interface(ws, "calc", "Calc", "Shape", "calc/shape.go")


@changed(WORK, files={"main.go": [("return Double(x) + rate", "return (x * 2) + rate")]})
def g43_inline_function(ws):
    return extract.inline_function(ws, ".", "Double")


@changed(WORK, files={"main.go": [("c.Cube(4)", "4 * 4 * 4")]})
def g44_inline_method(ws):
    return extract.inline_method(ws, "calc", "Calc", "Cube")


@changed(WORK, files={"main.go": [('\ttext := "Yours, " + name\n\treturn text\n', '\treturn ("Yours, " + name)\n')]})
def g45_inline_variable(ws):
    return refactor.inline_variable(ws, "main.go", "Sign", "text")


@changed(WORK, files={"main.go": [("const rate = 7", ""), ("+ rate", "+ 7")]})
def g46_inline_constant(ws):
    return extract.inline_constant(ws, ".", "rate")


@changed(WORK, files={"main.go": [('Sign("Bo")', 'Sign("Dear", "Bo")'), ("func Sign(name string) string", "func Sign(prefix string, name string) string")]})
def g47_change_signature(ws):
    return signature.change_signature(ws, ".", "Sign", [("prefix", "string"), ("name", "string")], defaults={"prefix": '"Dear"'})


@changed(WORK, files={"calc/calc.go": [("Add(n int)", "Add(n int, by string) error"), ("c.value += total\n}", "c.value += total\n\treturn nil\n}")], "main.go": [("c.Add(5)", 'c.Add(5, "")')]})
def g48_change_method_signature(ws):
    return signature.change_signature(ws, "calc", "Add", [("n", "int"), ("by", "string")], ["error"], recv="Adder")


@changed(WORK, files={"main.go": [("import (\n", 'import (\n\t"context"\n'), ('Sign("Bo")', 'Sign(context.TODO(), "Bo")'), ("func Sign(name string)", "func Sign(ctx context.Context, name string)")]})
def g49_add_context_parameter(ws):
    return refactor.add_context_parameter(ws, ".", "Sign")


@changed(WORK, files={"main.go": [('\nfunc unused() string {\n\treturn "never"\n}\n', "\n")]})
def g50_safe_delete(ws):
    return refactor.safe_delete(ws, ".", "unused")


@changed(WORK, files={"main.go": [('\ttools "example.org/work/tools"', '\t"example.org/work/tools"')]})
def g51_clean_aliases(ws):
    return refactor.clean_aliases(ws)


@changed(WORK, files={"main.go": [('"example.org/work/calc"', 'totals "example.org/work/calc"'), ("&calc.Calc", "&totals.Calc")]})
def g52_standardise_imports(ws):
    return refactor.standardise_imports(ws, [("work/calc", "totals")])


@changed(LOOP, files={"d/d.go": [('q "example.org/l/c"', 'q2 "example.org/l/c"')]})
def g53_resolve_alias_conflicts(ws):
    return wide.resolve_alias_conflicts(ws)


@changed(WORK, files={"main.go": [('\t"example.org/work/calc"', '\tcal "example.org/work/calc"'), ("&calc.Calc", "&cal.Calc")]})
def g54_convert_aliases(ws):
    return wide.convert_aliases(ws, explicit=True)


@changed(MESSY, files={"m.go": [('\t"strings"\n\t"example.org/x/b"\n\t"fmt"\n\ta "example.org/x/a"\n', '\t"fmt"\n\t"strings"\n\n\ta "example.org/x/a"\n\t"example.org/x/b"\n')]})
def g55_organise_imports(ws):
    return refactor.organise_imports(ws)


@changed(FACADES, files={"face/face.go": 'package face\n\nimport "example.org/f/mods/a"\n\nconst Max = a.Max\nvar Open = a.Open\n'})
def g56_create_facade(ws):
    return refactor.create_facade(ws, "mods/a", "face/face.go", "face")


@changed(FACADES, files={"gen/a/facade.go": 'package a\n\nimport "example.org/f/mods/a"\n\nconst Max = a.Max\nvar Open = a.Open\n', "gen/b/facade.go": 'package b\n\nimport "example.org/f/mods/b"\n\ntype Thing = b.Thing\nvar Now = b.Now\n'})
def g57_generate_facades(ws):
    return facades.generate_facades(ws, "mods", "gen")


@changed(FACADES, files={"api/old.go": 'package api\n\nimport "example.org/f/mods/a"\n\nconst Max = a.Max\nvar Open = a.Open\n'})
def g58_update_facades(ws):
    return facades.update_facades(ws)


# Plans


BAD = [("main.go", 0, 7, "package", "x", ""), ("main.go", 3, 9, "", "y", ""), ("main.go", 5, 2, "", "z", ""), ("main.go", 20, 23, "nop", "", ""), ("none.go", 4, 5, "", "", "")]


@query(WORK, "type VARCHAR, file VARCHAR", [("Overlap", "main.go"), ("InvalidPosition", "main.go"), ("TextMismatch", "main.go"), ("MissingFile", "none.go")])
def g59_plan_issues(ws):
    plan = ws.nodes.sparkSession.createDataFrame(BAD, apply.CHANGE)
    return apply.issues(plan, ws.files).select("type", "file").distinct()


@query(WORK, "type VARCHAR, file VARCHAR", [("SyntaxError", "tools/tools.go")])
def g60_result_syntax(ws):
    plan = ws.nodes.sparkSession.createDataFrame([("tools/tools.go", 0, 7, "package", "pkg", "")], apply.CHANGE)
    return execute.checked(ws, plan)[0]


@query(DEPOT, "type VARCHAR, description VARCHAR", [("ImportCycle", "stock and report would import each other")])
def g61_result_cycles(ws):
    at = len("package stock\n")
    plan = ws.nodes.sparkSession.createDataFrame([("stock/stock.go", at, at, "", '\nimport _ "example.org/depot/report"\n', "")], apply.CHANGE)
    return execute.checked(ws, plan)[0]


@query(WORK, "kind VARCHAR, name VARCHAR, direct BOOLEAN", [("file", "calc/calc.go", True), ("file", "main.go", True), ("package", "calc", True), ("package", ".", True)])
def g62_impact(ws):
    return execute.impact(ws, refactor.rename_symbol(ws, "calc", "Cube", "Power", "Calc"))


@query(WORK, "file VARCHAR, old VARCHAR, new VARCHAR", [("calc/calc.go", "Cube", "Power"), ("main.go", "Cube", "Power")])
def g63_preview(ws):
    return apply.previewed(refactor.rename_symbol(ws, "calc", "Cube", "Power", "Calc"))


@query(WORK, "name VARCHAR, kind VARCHAR, dir VARCHAR", [("Limit", "Constant", "tools"), ("Up", "Function", "tools"), ("Late", "Function", "new")])
def g64_refresh(ws):
    rows = [("main.go", None), ("calc/calc.go", None), ("new/n.go", b"package new\n\nfunc Late() {}\n")]
    return facts.symbols(workspace.refreshed(ws, ws.nodes.sparkSession.createDataFrame(rows, "file_path string, content binary")))


@query(WORK, "file VARCHAR, content VARCHAR", [("calc/calc.go", WORK["calc/calc.go"]), ("main.go", WORK["main.go"]), ("tools/tools.go", WORK["tools/tools.go"])])
def g65_undo(ws):
    plan = refactor.rename_symbol(ws, "calc", "Cube", "Power", "Calc")
    back = execute.after(execute.after(ws, plan), execute.reverse(ws, plan))
    return back.files.select(F.col("file_path").alias("file"), F.decode("content", "UTF-8").alias("content"))


@query(WORK, "file VARCHAR, content VARCHAR", [("main.go", WORK["main.go"].replace("Double", "Twofold").replace('\nfunc unused() string {\n\treturn "never"\n}\n', "\n").replace('\ttools "example.org/work/tools"', '\t"example.org/work/tools"'))])
def g66_steps(ws):
    steps = '[{"operation": "rename_symbol", "package": ".", "old": "Double", "new": "Twofold"}, {"operation": "safe_delete", "package": ".", "name": "unused"}, {"operation": "clean_aliases"}]'
    new, _ = execute.run_steps(ws, execute.parsed_steps(steps), refactor.OPERATIONS)
    return new.files.where("file_path = 'main.go'").select(F.col("file_path").alias("file"), F.decode("content", "UTF-8").alias("content"))


# Renaming a function and deleting it meet at its name.
@query(WORK, "file VARCHAR, a_step BIGINT, b_step BIGINT, conflicts BIGINT", [("main.go", 0, 1, 1)])
def g67_step_conflicts(ws):
    plan = refactor.batch(ws, [("rename_symbol", {"package": ".", "old": "unused", "new": "used"}), ("safe_delete", {"package": ".", "name": "unused"})])
    return changes.step_conflicts(plan)


@query(LOOP, "total_packages BIGINT, external_packages BIGINT, total_imports BIGINT, max_imports BIGINT, cyclical_imports BIGINT", [(4, 0, 6, 3, 3)])
def g68_import_metrics(ws):
    return resolve.import_metrics(ws)


@query(DEPOT, "package VARCHAR, internal_imports BIGINT, external_imports BIGINT, imported_by BIGINT", [(".", 1, 2, 0), ("report", 1, 0, 0), ("stock", 0, 0, 2)])
def g69_package_metrics(ws):
    return resolve.package_metrics(ws)


@query(LOOP, "src VARCHAR, dst VARCHAR", [("c", "d")])
def g70_would_create_cycle(ws):
    edges = facts.import_edges(ws).select("src", "dst")
    return graph.would_create_cycle(edges, ws.nodes.sparkSession.createDataFrame([("c", "d"), ("d", "e"), ("e", "a")], "src string, dst string"))


@query(DEPOT, "node VARCHAR, level BIGINT, place BIGINT", [(".", 1, 1), ("report", 1, 2), ("stock", 0, 3)])
def g71_topological_order(ws):
    return graph.topological_order(facts.import_edges(ws).select("src", "dst"))


@query(DEPOT, "interface_dir VARCHAR, interface VARCHAR", [("stock", "Counter")])
def g72_interfaces_for_method(ws):
    return resolve.interfaces_for_method(ws, "stock", "Shelf", "Count")


@query(DEPOT, "name VARCHAR, type_dir VARCHAR, type VARCHAR", [("c", "stock", "Counter")])
def g73_identifier_type(ws):
    return resolve.identifier_type(ws, "main.go", DEPOT["main.go"].index("c.Count()"))


@query(DEPOT, "kind VARCHAR, place BIGINT", [("block", 1), ("function", 2), ("file", 3)])
def g74_scope_at(ws):
    rows = scope.scope_at(ws, "main.go", DEPOT["main.go"].index("show(s)"))
    return rows.select("kind", F.row_number().over(Window.orderBy(F.col("end") - F.col("start"), F.desc("scope_id"))).alias("place"))


@query(DEPOT, "name VARCHAR, level VARCHAR", [("s", "local"), ("limit", "package"), ("main", "package"), ("twice", "package"), ("show", "package"), ("orphan", "package"), ("fmt", "import"), ("os", "import"), ("stock", "import")])
def g75_visible_names(ws):
    return scope.visible(ws, "main.go", DEPOT["main.go"].index("show(s)"))


@query(CHECKS, "fix VARCHAR, file VARCHAR, line BIGINT, edits BIGINT", [("fix_boolean_branching", "checks.go", 9, 3), ("fix_deep_if_else", "checks.go", 37, 1), ("fix_error_wrapping", "checks.go", 14, 2), ("fix_if_init", "checks.go", 16, 1)])
def g76_fix_results(ws):
    return fixes.results(ws)


@query(DEPOT, "path VARCHAR, importers BIGINT", [("fmt", 1), ("os", 1)])
def g77_external_dependencies(ws):
    return resolve.external_dependencies(ws)


@changed(WORK, files={"main.go": [("\tx := 12\n\ty := 30\n\ttotal := x - y\n\tfmt.Println(total)\n\treturn Double(x) + rate\n", "\treturn inner()\n"), ("func main() {", "func inner() int {\n\tx := 12\n\ty := 30\n\ttotal := x - y\n\tfmt.Println(total)\n\treturn Double(x) + rate\n}\n\nfunc main() {")]})
def g78_extract_returning(ws):
    return extract.extract_function(ws, "main.go", 17, 21, "inner")


@query(WORK, "problem VARCHAR, report VARCHAR", [("SymbolNotFound", "SymbolNotFound: symbol 'Sgin' not found in tools\n  Suggestions:\n    - Did you mean 'Sign' (Function in .)?\n    - Did you mean 'main' (Function in .)?\n    - Available: Limit, Up")])
def g79_formatted_error(ws):
    rows = diagnostics.resolution_failure(ws, "tools", "Sgin")
    return diagnostics.formatted(rows).crossJoin(rows.select("problem"))


@query(WORK, "line BIGINT, text VARCHAR", [(10, "10: const rate = 7"), (11, "11: "), (12, "12: func Double(n int) int {")])
def g80_file_lines(ws):
    return workspace.numbered_lines(ws, "main.go", 10, 12)
