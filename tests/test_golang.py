import pytest

from codeloom.golang import analyze, facts
from codeloom.golang.lexer import SyntaxProblem, tokens
from codeloom.golang.parser import rows
from codeloom.sources import workspace

TREE = {
    "go.mod": "module example.org/shop\n\ngo 1.22\n",
    "main.go": """package main

import (
	"fmt"
	"os"
	st "example.org/shop/store"
)

var unusedCount = 3

func main() {
	s := st.Open("x")
	if v, err := s.Get("k"); err != nil {
		fmt.Println(v)
	}
	helper(1, 2)
}

func helper(a, b int) int { return a + b }

func orphan() {}
""",
    "store/store.go": """package store

import (
	"context"
	"fmt"
)

type Getter interface {
	Get(key string) (string, error)
}

type Box[T any] struct{ item T }

type Store struct {
	path string
	rows map[string][]byte
}

func Open(path string) *Store { return &Store{path: path} }

func (s *Store) Get(key string) (string, error) {
	v, err := s.load(key)
	if err != nil {
		return "", err
	}
	if key == "" {
		return "", fmt.Errorf("bad key: %v", err)
	} else if key == "?" {
		return "", fmt.Errorf("failed: %w", err)
	}
	return v, nil
}

func (s *Store) load(key string) (string, error) {
	ctx := context.Background()
	_ = ctx
	for i := range s.rows {
		switch {
		case i == key && len(key) > 1 || key[0:1] == "a":
			go func() { _ = []int{1, 2}[0] }()
		default:
		}
	}
	return string(s.rows[key]), nil
}

func Mode(isProd bool, name string) {
	a := name == "a"
	b := name == "b"
	if a || !b {
		use(isProd)
	}
}

func use(f bool) {}

func Deep(x int) error {
	if x > 0 {
		if x > 1 {
			if x > 2 {
				use(true)
			} else {
				return nil
			}
		} else {
			return nil
		}
	} else {
		return nil
	}
	return nil
}
""",
    "store/store_test.go": 'package store\n\nimport "testing"\n\nfunc TestGet(t *testing.T) { Open("x") }\n',
    "vendor/v/v.go": "package v\n",
    "broken/b.go": "package broken\n\nfunc {\n",
}


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, content in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content)
    return workspace.load(spark, str(root))


def test_semicolons():
    found, comments = tokens("a\n/* x\n */ b++ // c\nreturn\n)\n+\n")
    assert [t.text for t in found] == ["a", ";", "b", "++", ";", "return", ";", ")", ";", "+", ""]
    assert len(comments) == 2


@pytest.mark.parametrize(
    "source",
    [
        "type A[K comparable, V any] map[K]V",
        "type B [4]int",
        "type N interface{ ~int | ~string; M() }",
        "func f(a, b int, c ...string) (x int, err error) { return }",
        "func g(int, string) func(int) chan<- int { return nil }",
        "func h() { for i := 0; i < 3; i++ { continue }; for range xs {}; for k, v := range m {}; for { break } }",
        "func h() { switch x := y.(type) { case int, *T: default: } }",
        "func h() { select { case v := <-c: _ = v; case c <- 1: default: } }",
        "func h() { L: for { break L }; if x := (T{1}); x.ok {} }",
        "func h() { a := map[string][]int{\"k\": {1, 2}}; b := &T{x: 1}; _ = a[\"k\"][1:2:3]; c.(*T).f(b...) }",
        "func h() { f := F[int, string](1); _ = []byte(s); _ = (*T)(nil); _ = <-c; x <<= 2; go f(); defer func() {}() }",
        "const (\n\tA = iota\n\tB\n)\nvar x, y = 1, 'a'",
        "type S struct { T; *p.Q; G[int]; a, b [2]int `json:\"x\"`; f func() }",
    ],
)
def test_grammar(source):
    nodes = rows(f"package p\n{source}\n".encode())
    assert nodes[0][4] == "File" and all(n[1] is None or n[1] < n[0] for n in nodes)
    spans = {n[0]: (n[6], n[7]) for n in nodes}
    assert all(n[1] is None or spans[n[1]][0] <= n[6] and n[7] <= spans[n[1]][1] for n in nodes)


@pytest.mark.parametrize("source", ["func {", "var", "package", "func f() { if { }", "x := 1"])
def test_errors_are_reported(source):
    with pytest.raises(SyntaxProblem):
        rows(f"package p\n{source}\n".encode())


def test_scan_and_packages(ws):
    assert {r.file_path for r in ws.files.collect()} == {"main.go", "store/store.go", "store/store_test.go", "broken/b.go"}
    assert [r.file_path for r in ws.errors.collect()] == ["broken/b.go"]
    assert {(r.dir, r.name, r.import_path) for r in ws.packages.collect()} == {(".", "main", "example.org/shop"), ("store", "store", "example.org/shop/store")}


def test_imports_and_edges(ws):
    found = {(r.file_path, r.path, r.given, r.alias) for r in facts.imports(ws).collect()}
    assert ("main.go", "example.org/shop/store", "st", "st") in found and ("main.go", "os", None, "os") in found
    assert [(r.src, r.dst, r.is_test) for r in facts.import_edges(ws).collect()] == [(".", "store", False)]
    assert [(r.file_path, r.path) for r in facts.unused_imports(ws).collect()] == [("main.go", "os")]


def test_symbols(ws):
    found = {(r.dir, r.kind, r.name, r.recv): r for r in facts.symbols(ws).collect()}
    assert found["store", "Method", "Get", "Store"].signature == "Get(key)"
    assert {k[1] for k in found} >= {"Function", "Method", "Type", "Interface", "Variable"}
    assert ("store", "Method", "Get", "Getter") in found and found[".", "Function", "helper", None].exported is False
    assert found["store", "Type", "Box", None].exported


def test_references_and_unused(ws):
    found = {(r.name, r.file_path, r.line) for r in facts.references(ws).where("name in ('Open', 'helper', 'use')").collect()}
    assert found == {("Open", "main.go", 12), ("Open", "store/store_test.go", 5), ("helper", "main.go", 16), ("use", "store/store.go", 51), ("use", "store/store.go", 61)}
    unused = {r.name for r in facts.unused(ws).collect()}
    assert "orphan" in unused and "helper" not in unused and "load" not in unused and "main" not in unused


def test_complexity(ws):
    found = {r.function: r for r in analyze.complexity(ws, 1).collect()}
    assert found["helper"].cyclomatic_complexity == 1 and found["helper"].parameters == 2
    assert found["Get"].cyclomatic_complexity == 1 + 3
    # A loop and a case; the switch has a default. The loop counts 1, the switch 2, the goroutine 3.
    assert found["load"].cyclomatic_complexity == 3 and found["load"].cognitive_complexity == 1 + 2 + 3
    # Three ifs, each with an else block.
    assert found["Deep"].cyclomatic_complexity == 7 and found["Deep"].level == "moderate"


def test_other_analyzers(ws):
    (split,) = analyze.if_init(ws).collect()
    assert (split.file, split.variables, split.expression, split.function) == ("main.go", ["v", "err"], 's.Get("k")', "main")
    assert split.new_text == 'v, err := s.Get("k")\n\tif err != nil '
    assert [(r.function_name, r.context_calls) for r in analyze.missing_context(ws).collect()] == [("load", ["context.Background"])]
    (flags,) = analyze.boolean_branching(ws).collect()
    assert (flags.function, flags.source_variable, flags.boolean_variables) == ("Mode", "name", ["a", "b"])
    bad = {(r.violation_type, r.new_text) for r in analyze.error_wrapping(ws, "warning").collect()}
    assert bad == {("bare_return", 'fmt.Errorf("get: %w", err)'), ("format_verb_v_instead_of_w", 'fmt.Errorf("bad key: %w", err)'), ("no_context", 'fmt.Errorf("failed: %w", err)')}
    (deep,) = analyze.deep_if_else(ws).collect()
    assert (deep.function_name, deep.nesting_depth, deep.error_branches, deep.complexity_reduction_estimate) == ("Deep", 3, 3, 66)
    (env,) = analyze.environment_booleans(ws).collect()
    assert (env.function_name, env.parameter_name, env.call_chain) == ("Mode", "isProd", ["Mode", "use"])
