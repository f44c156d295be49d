import pytest

from codeloom.golang.parser import rows
from codeloom.plans import apply, refactor
from codeloom.sources import workspace
from test_golang import TREE


@pytest.fixture(scope="module")
def ws(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("plans")
    for path, content in TREE.items():
        if not path.startswith("broken"):
            (root / path).parent.mkdir(parents=True, exist_ok=True)
            (root / path).write_text(content)
    return workspace.load(spark, str(root))


def result(ws, plan):
    """The changed files, each of which still parses."""
    assert apply.issues(plan, ws.files).count() == 0
    out = {r.file: bytes(r.content).decode() for r in apply.applied(plan, ws.files).collect()}
    for text in out.values():
        if text:
            rows(text.encode())
    return out


def test_rename_symbol(ws):
    out = result(ws, refactor.rename_symbol(ws, "store", "Open", "Create"))
    assert set(out) == {"main.go", "store/store.go", "store/store_test.go"}
    assert 'st.Create("x")' in out["main.go"] and "func Create(path" in out["store/store.go"] and "Open" not in "".join(out.values()).replace("Open(\"", "")
    with pytest.raises(refactor.RefactorError):
        refactor.rename_symbol(ws, "store", "Open", "Store")
    with pytest.raises(refactor.RefactorError):
        refactor.rename_symbol(ws, "store", "Open", "func")
    with pytest.raises(refactor.RefactorError):
        refactor.rename_symbol(ws, "store", "Nothing", "X")


def test_rename_method(ws):
    out = result(ws, refactor.rename_symbol(ws, "store", "load", "fetch", "Store"))
    assert out["store/store.go"].count("fetch") == 2 and "s.load" not in out["store/store.go"]


def test_rename_and_move_package(ws):
    out = result(ws, refactor.rename_package(ws, "store", "shelf"))
    assert out["store/store.go"].startswith("package shelf") and out["store/store_test.go"].startswith("package shelf") and "main.go" not in out
    out = result(ws, refactor.move_package(ws, "store", "pkg/shelf"))
    assert out["store/store.go"] == "" and out["pkg/shelf/store.go"] == TREE["store/store.go"] and 'st "example.org/shop/pkg/shelf"' in out["main.go"]
    after = {r.file_path for r in apply.updated(ws.files, refactor.move_package(ws, "store", "pkg/shelf")).collect()}
    assert after == {"main.go", "pkg/shelf/store.go", "pkg/shelf/store_test.go"}


def test_delete(ws):
    assert "orphan" not in result(ws, refactor.safe_delete(ws, ".", "orphan"))["main.go"]
    assert "unusedCount" not in result(ws, refactor.safe_delete(ws, ".", "unusedCount"))["main.go"]
    with pytest.raises(refactor.RefactorError, match="references"):
        refactor.safe_delete(ws, ".", "helper")


def test_parameters(ws):
    out = result(ws, refactor.add_context_parameter(ws, ".", "helper"))["main.go"]
    assert "helper(context.TODO(), 1, 2)" in out and "func helper(ctx context.Context, a, b int)" in out
    out = result(ws, refactor.add_parameter(ws, ".", "helper", "c", "string", '"x"', 9))["main.go"]
    assert 'helper(1, 2, "x")' in out and "func helper(a, b int, c string)" in out
    assert "func orphan(n int)" in result(ws, refactor.add_parameter(ws, ".", "orphan", "n", "int", "0", 0))["main.go"]


def test_imports(ws):
    out = result(ws, refactor.standardise_imports(ws, [("shop/store", "shelf")]))["main.go"]
    assert 'shelf "example.org/shop/store"' in out and 'shelf.Open("x")' in out
    out = result(ws, refactor.organise_imports(ws))["main.go"]
    assert 'import (\n\t"fmt"\n\t"os"\n\n\tst "example.org/shop/store"\n)' in out
    assert refactor.clean_aliases(ws).count() == 0


def test_extract_and_inline(ws):
    out = result(ws, refactor.extract_constant(ws, "main.go", "main", '"k"', "key"))["main.go"]
    assert 'const key = "k"\n\nfunc main' in out and "s.Get(key)" in out
    out = result(ws, refactor.extract_interface(ws, "store", "Store", "Reader", "store/reader.go"))
    assert out["store/reader.go"] == "package store\n\ntype Reader interface {\n\tGet(key string) (string, error)\n}\n"
    out = result(ws, refactor.inline_variable(ws, "main.go", "main", "s"))["main.go"]
    assert 'st.Open("x").Get("k")' in out and "s :=" not in out
    out = result(ws, refactor.create_facade(ws, "store", "api/api.go", "api"))["api/api.go"]
    assert "var Open = store.Open" in out and "type Store = store.Store" in out


def test_move_symbol_and_fixes(ws):
    out = result(ws, refactor.move_symbol(ws, "store", "use", "store/store_test.go"))
    assert "func use" not in out["store/store.go"] and out["store/store_test.go"].endswith("\nfunc use(f bool) {}\n")
    assert 'v, err := s.Get("k")\n\tif err != nil {' in result(ws, refactor.fix_if_init(ws))["main.go"]
    assert 'return "", fmt.Errorf("get: %w", err)' in result(ws, refactor.fix_error_wrapping(ws))["store/store.go"]


def test_batch_and_issues(spark, ws):
    plan = refactor.batch(ws, [("safe_delete", {"package": ".", "name": "orphan"}), ("fix_if_init", {})])
    assert {r.step for r in plan.collect()} == {0, 1}
    with pytest.raises(refactor.RefactorError):
        refactor.batch(ws, [("nothing", {})])
    bad = spark.createDataFrame([("main.go", 0, 7, "package", "x", ""), ("main.go", 3, 9, "", "y", ""), ("main.go", 5, 2, "", "z", ""), ("main.go", 0, 3, "nop", "", ""), ("none.go", 4, 5, "", "", ""), ("main.go", 0, 9999, "", "", "")], apply.CHANGE)
    assert {r.type for r in apply.issues(bad, ws.files).collect()} == {"Overlap", "InvalidPosition", "TextMismatch", "MissingFile"}
    lines = apply.previewed(plan).collect()
    assert [(r.file, r.start) for r in lines] == sorted((r.file, r.start) for r in lines) and all(len(r.new) <= 80 for r in lines)
