"""All tools by name: reports return rows about a workspace, operations return change sets."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.golang import analyze, diagnostics, facts, resolve, scope
from codeloom.plans import apply, execute, extract, facades, fixes, move, refactor, signature, wide
from codeloom.sources.workspace import Workspace, load
from codeloom.sources.workspace import status as workspace_status
from codeloom.streaming import watch

Tool = Callable[..., DataFrame]

REPORTS: dict[str, Tool] = analyze.ANALYZERS | {
    "analyze_dependencies": resolve.dependencies,
    "analyze_symbol": resolve.symbol_report,
    "cycles": resolve.cycle_report,
    "definition": resolve.definition,
    "implementations": resolve.implementations,
    "layer_breaks": resolve.layer_breaks,
    "method_sets": resolve.method_sets,
    "package_metrics": resolve.package_metrics,
    "references": facts.references,
    "external_dependencies": resolve.external_dependencies,
    "facades": facades.detected,
    "fix_results": fixes.results,
    "identifier_type": resolve.identifier_type,
    "impact": execute.impact,
    "import_error": diagnostics.import_error,
    "import_metrics": resolve.import_metrics,
    "interfaces_for_method": resolve.interfaces_for_method,
    "issues": lambda ws, plan: execute.checked(ws, plan)[0],
    "resolution_failure": diagnostics.resolution_failure,
    "scope_at": scope.scope_at,
    "scopes": scope.tree,
    "status": workspace_status,
    "type_error": diagnostics.type_error,
    "unresolved": diagnostics.unresolved,
    "visibility_error": diagnostics.visibility_error,
    "visible": scope.visible,
    "shared_symbols": resolve.shared_symbols,
    "suggestions": resolve.suggestions,
    "symbols": facts.symbols,
    "unused": facts.unused,
    "unused_imports": facts.unused_imports,
}
_IN_BODIES = (extract.extract_function, extract.extract_block, extract.extract_method, extract.extract_variable, extract.inline_function, extract.inline_method, extract.inline_constant)
_OVER_TREES = (wide.resolve_alias_conflicts, wide.convert_aliases, wide.remove_parameter, wide.rename_interface_method, wide.move_packages, wide.move_dir, move.move_symbol_to, move.move_by_dependencies, signature.change_signature, facades.generate_facades, facades.update_facades, fixes.fix_boolean_branching, fixes.fix_deep_if_else)
OPERATIONS: dict[str, Tool] = refactor.OPERATIONS | {f.__name__: f for f in (*_IN_BODIES, *_OVER_TREES)}


def run(ws: Workspace, tool: str, **arguments) -> DataFrame:
    """The rows of a report or the change set of an operation."""
    known = REPORTS | OPERATIONS
    if tool not in known:
        raise refactor.RefactorError(f"no tool {tool}")
    return known[tool](ws, **arguments)


def batch(ws: Workspace, steps: list[tuple[str, dict]]) -> DataFrame:
    """The changes of several operations against one state of the workspace, with the step that each comes from."""
    return refactor.batch(ws, steps, OPERATIONS)


def json_rows(rows: DataFrame) -> list[str]:
    """Rows as JSON objects, for a client; a report is small, or is asked for with a limit."""
    return [r.value for r in rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).collect()]


def answer(ws: Workspace, tool: str, **arguments) -> str:
    """What a tool gives as one JSON text: its rows, or the error that it ended in."""
    try:
        return f'{{"ok":true,"rows":[{",".join(json_rows(run(ws, tool, **arguments)))}]}}'
    except (refactor.RefactorError, ValueError, TypeError) as e:
        return json.dumps({"ok": False, "error": str(e)})


@dataclass(frozen=True)
class Operation:
    """An operation with its arguments, before it meets a workspace."""

    type: str
    arguments: dict = field(default_factory=dict)

    def execute(self, ws: Workspace) -> DataFrame:
        """The change set."""
        if self.type not in OPERATIONS:
            raise refactor.RefactorError(f"no operation {self.type}")
        return OPERATIONS[self.type](ws, **self.arguments)

    def validate(self, ws: Workspace) -> DataFrame:
        """What is wrong with the change set, the result's syntax and its imports."""
        return execute.checked(ws, self.execute(ws))[0]

    @property
    def description(self) -> str:
        return f"{self.type}({', '.join(f'{k}={v!r}' for k, v in sorted(self.arguments.items()))})"


class Engine:
    """A tree that operations are carried out on, one state after another. `skip_compilation` leaves out the checks of
    the result's syntax and imports, `allow_breaking` goes on in spite of them; `backup` keeps former contents."""

    def __init__(self, spark: SparkSession, root: str, skip_compilation: bool = False, allow_breaking: bool = False, backup: bool = False):
        self.spark, self.skip_compilation, self.allow_breaking, self.backup = spark, skip_compilation, allow_breaking, backup
        self.workspace = load(spark, root)
        self.undone: list[tuple[Workspace, DataFrame]] = []

    def report(self, tool: str, **arguments) -> DataFrame:
        return run(self.workspace, tool, **arguments)

    def plan(self, operation: Operation) -> DataFrame:
        return operation.execute(self.workspace)

    def preview(self, operation: Operation) -> DataFrame:
        return apply.previewed(self.plan(operation))

    def impact(self, operation: Operation) -> DataFrame:
        return execute.impact(self.workspace, self.plan(operation))

    def execute(self, operation: Operation, write: bool = True) -> Workspace:
        """Check an operation, carry it out and write the tree."""
        return self.execute_plan(self.plan(operation), write)

    def execute_plan(self, plan: DataFrame, write: bool = True) -> Workspace:
        before = self.workspace
        self.workspace = execute.execute(before, plan, write, self.backup, self.allow_breaking, self.skip_compilation)
        self.undone.append((before, plan))
        return self.workspace

    def rollback(self, write: bool = True) -> Workspace:
        """Undo the last operation."""
        if not self.undone:
            raise refactor.RefactorError("nothing to undo")
        before, plan = self.undone.pop()
        back = execute.reverse(before, plan)
        self.workspace = execute.execute(self.workspace, back, write, False, True, True)
        return self.workspace

    def run_steps(self, steps: list[tuple[str, dict]], write: bool = True, stop: bool = True) -> list[dict]:
        self.workspace, report = execute.run_steps(self.workspace, steps, OPERATIONS, write, self.backup, stop)
        return report

    def save_plan(self, operation: Operation, folder: str) -> None:
        wide.write_plan(self.plan(operation), folder)

    def run_plan(self, folder: str, write: bool = True) -> Workspace:
        return self.execute_plan(wide.read_plan(self.spark, folder), write)

    def sync(self) -> Workspace:
        """Take over what others have changed in the tree."""
        self.workspace = watch.synced(self.workspace, self.spark)
        return self.workspace
