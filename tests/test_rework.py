import pytest

from codeloom import tools
from codeloom.golang import resolve
from codeloom.golang.parser import rows
from codeloom.plans import apply, extract, wide
from codeloom.plans.refactor import RefactorError
from codeloom.sources import workspace

TREE = {
    "go.mod": "module example.org/app\n\ngo 1.22\n",
    "main.go": """package main

import (
	"fmt"
	short "example.org/app/lib"
	"example.org/app/api"
	"github.com/x/yonder"
)

const limit = 3

func main() {
	a := 1
	b := a + limit
	fmt.Println(b, twice(a+b), short.Size(2, 3))
	c := 0
	for i := 0; i < 2; i++ {
		c += a
		c += b
	}
	fmt.Println(c, yonder.Far, api.Run(nil))
}

func twice(n int) int {
	return n * 2
}
""",
    "lib/lib.go": """package lib

type Runner interface {
	Run() int
	Stop()
}

type Base struct{ n int }

func (b *Base) Stop() {}

type Full struct {
	*Base
	name string
}

func (f Full) Run() int {
	x := f.n
	return x + 1
}

func Size(w, h int) int { return w }
""",
    "api/api.go": 'package api\n\nimport "example.org/app/lib"\n\nfunc Run(r lib.Runner) int {\n\tlib.Size(1, 2)\n\treturn r.Run()\n}\n',
}


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("rework")
    for path, content in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    return workspace.load(spark, str(root))


def result(ws, plan):
    out = {r.file: bytes(r.content).decode() for r in apply.applied(plan, ws.files).collect()}
    for text in out.values():
        if text:
            rows(text.encode())
    return out


def test_extract_function(ws):
    out = result(ws, extract.extract_function(ws, "main.go", 18, 19, "add"))["main.go"]
    assert "\t\tc = add(a, b, c)\n\t}" in out and "func add(a int, b int, c int) int {\n\tc += a\n\tc += b\n\treturn c\n}" in out
    out = result(ws, extract.extract_function(ws, "main.go", 13, 14, "start"))["main.go"]
    assert "\ta, b := start()\n" in out and "func start() (int, int) {\n\ta := 1\n\tb := a + limit\n\treturn a, b\n}" in out
    with pytest.raises(RefactorError):
        extract.extract_function(ws, "main.go", 17, 18, "half")


def test_extract_method(ws):
    with pytest.raises(RefactorError, match="must be given"):
        extract.extract_method(ws, "lib/lib.go", 18, 18, "first")
    out = result(ws, extract.extract_method(ws, "lib/lib.go", 18, 18, "first", {"x": "int"}))["lib/lib.go"]
    assert "\tx := f.first()\n" in out and "func (f Full) first() int {\n\tx := f.n\n\treturn x\n}" in out
    out = result(ws, extract.extract_method(ws, "lib/lib.go", 18, 19, "all"))["lib/lib.go"]
    assert "\treturn f.all()\n}" in out and "func (f Full) all() int {\n\tx := f.n\n\treturn x + 1\n}" in out


def test_extract_variable_and_inline(ws):
    out = result(ws, extract.extract_variable(ws, "main.go", 14, "a + limit", "sum"))["main.go"]
    assert "\tsum := a + limit\n\tb := sum\n" in out
    out = result(ws, extract.inline_function(ws, ".", "twice"))["main.go"]
    assert "fmt.Println(b, (a+b) * 2, short" in out
    out = result(ws, extract.inline_function(ws, "lib", "Size"))
    assert "short" not in out["main.go"].split("func main")[1] and "\t1\n" in out["api/api.go"]
    out = result(ws, extract.inline_constant(ws, ".", "limit"))["main.go"]
    assert "b := a + 3" in out and "const" not in out


def test_signatures_and_aliases(ws):
    out = result(ws, wide.remove_parameter(ws, "lib", "Size", "h"))
    assert "func Size(w int) int" in out["lib/lib.go"] and "short.Size(2)" in out["main.go"] and "lib.Size(1)" in out["api/api.go"]
    with pytest.raises(RefactorError, match="uses"):
        wide.remove_parameter(ws, "lib", "Size", "w")
    out = result(ws, wide.convert_aliases(ws, explicit=False))["main.go"]
    assert '\n\t"example.org/app/lib"' in out and "lib.Size(2, 3)" in out
    out = result(ws, wide.convert_aliases(ws, explicit=True))["main.go"]
    assert 'yon "github.com/x/yonder"' in out and "yon.Far" in out
    assert wide.resolve_alias_conflicts(ws).count() == 0
    out = result(ws, wide.rename_interface_method(ws, "Run", "Go"))
    assert "Go() int\n" in out["lib/lib.go"] and "func (f Full) Go()" in out["lib/lib.go"] and "r.Go()" in out["api/api.go"] and "func Run(" in out["api/api.go"]


def test_moves_and_plan_files(spark, ws, tmp_path):
    out = result(ws, wide.move_dir(ws, "lib", "core/lib"))
    assert out["lib/lib.go"] == "" and '"example.org/app/core/lib"' in out["api/api.go"]
    with pytest.raises(RefactorError, match="one after another"):
        wide.move_packages(ws, {"lib": "core/lib", "api": "core/api"})
    plan = wide.move_dir(ws, "lib", "core/lib")
    wide.write_plan(plan, str(tmp_path / "plan"))
    assert sorted(map(tuple, wide.read_plan(spark, str(tmp_path / "plan")).collect())) == sorted(map(tuple, plan.collect()))


def test_resolution(ws):
    full = {(r.interface, r.type): list(r.missing) for r in resolve.implementations(ws).collect()}
    assert full == {("Runner", "Full"): [], ("Runner", "Base"): ["Run"]}
    assert {(r.type, r.method, r.depth) for r in resolve.method_sets(ws).collect()} == {("Runner", "Run", 0), ("Runner", "Stop", 0), ("Base", "Stop", 0), ("Full", "Run", 0), ("Full", "Stop", 1)}
    assert [(r["rank"], r.dir, r.kind) for r in resolve.definition(ws, "lib", "Size").collect()] == [(0, "lib", "Function")]
    assert [r["rank"] for r in resolve.definition(ws, ".", "len").collect()] == [2]
    assert [r.recv for r in resolve.definition(ws, "lib", "Full.Run").collect()] == ["Full"]
    assert resolve.suggestions(ws, "Sizes").first().name == "Size"
    r = resolve.symbol_report(ws, "lib", "Size").first()
    assert (r.references, r.files, r.packages) == (2, 2, 2)
    assert {(r["name"], tuple(r.packages)) for r in resolve.shared_symbols(ws).collect()} == {("Size", (".", "api"))}
    assert {r.package: (r.imports, r.imported_by, r.level) for r in resolve.dependencies(ws).collect()} == {".": (2, 0, 2), "api": (1, 1, 1), "lib": (0, 2, 0)}
    assert resolve.cycle_report(ws).count() == 0
    breaks = resolve.layer_breaks(ws, [("api", 0), ("lib", 1)])
    assert [tuple(r) for r in breaks.collect()] == [("api", "lib", 0, 1)]
    assert "- `api` (tier 0) imports `lib` (tier 1)" in wide.layer_report(breaks).first().report


def test_tools(ws):
    assert not set(tools.REPORTS) & set(tools.OPERATIONS)
    plan = tools.batch(ws, [("inline_function", {"package": ".", "name": "twice"}), ("remove_parameter", {"package": "lib", "name": "Size", "param": "h"})])
    assert {r.step for r in plan.select("step").distinct().collect()} == {0, 1}
    assert tools.run(ws, "unused_imports").count() == 0
    with pytest.raises(RefactorError):
        tools.run(ws, "nothing")
