"""Plans carried out: checks, the workspace after them, files written back, backups and restoring."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.golang import facts
from codeloom.operators import graph
from codeloom.plans import apply, changes
from codeloom.plans.refactor import RefactorError
from codeloom.sources.tables import cut
from codeloom.sources.workspace import Workspace, refreshed

BACKUP = ".backup"
#: Kinds of issues that stop a plan; others are reported and let it go on.
CRITICAL = ("InvalidPosition", "TextMismatch", "Overlap", "MissingFile", "SyntaxError", "ImportCycle")


def after(ws: Workspace, plan: DataFrame) -> Workspace:
    """The workspace that a plan leaves; only files that it changes are parsed again."""
    plan = cut(plan, "plan")
    new = apply.applied(plan, ws.files)
    content = F.when(F.octet_length("content") > 0, F.col("content"))
    return refreshed(ws, new.select(F.col("file").alias("file_path"), content.alias("content")))


def checked(ws: Workspace, plan: DataFrame) -> tuple[DataFrame, Workspace | None]:
    """What is wrong with a plan (type, severity, description, file, start) and the workspace after it. Positions and old
    texts are looked at first; if they hold, the result's syntax and its import cycles."""
    plan = cut(plan, "plan")
    found = cut(apply.issues(plan, ws.files), "issues")
    if found.limit(1).count():
        return found, None
    new = after(ws, plan)
    touched = plan.select("file").distinct()
    broken = new.errors.join(touched.withColumnRenamed("file", "file_path"), "file_path", "left_semi")
    row = lambda kind, text, file: [F.lit(kind).alias("type"), F.lit("Error").alias("severity"), text.alias("description"), file.alias("file"), F.lit(0).alias("start")]
    none = F.lit(None).cast("string")
    found = broken.select(*row("SyntaxError", F.col("error"), F.col("file_path")))
    before, edges = (facts.import_edges(w).where(~F.col("is_test")).select("src", "dst").distinct() for w in (ws, new))
    added = cut(edges.join(before, ["src", "dst"], "left_anti"))
    if added.limit(1).count():
        text = F.concat(F.col("src"), F.lit(" and "), F.col("dst"), F.lit(" would import each other"))
        found = found.unionByName(graph.would_create_cycle(edges, added).select(*row("ImportCycle", text, none)))
    return found, new


def critical(found: DataFrame) -> DataFrame:
    return found.where(F.col("type").isin(*CRITICAL))


def execute(ws: Workspace, plan: DataFrame, write: bool = False, backup: bool = False, allow_breaking: bool = False, skip_checks: bool = False) -> Workspace:
    """Check a plan, carry it out and return the workspace after it. `write` puts the changed files back into the tree,
    `backup` keeps their former content beside them; `allow_breaking` goes on in spite of what breaks the result's
    syntax or imports, never in spite of positions that don't fit; `skip_checks` looks at positions alone."""
    plan = cut(plan, "plan")
    if skip_checks:
        found, new = apply.issues(plan, ws.files), None
    else:
        found, new = checked(ws, plan)
    stops = critical(found)
    if allow_breaking:
        stops = stops.where(~F.col("type").isin("SyntaxError", "ImportCycle"))
    wrong = stops.orderBy("file", "start").limit(20).collect()
    if wrong:
        raise RefactorError("; ".join(f"{r.file or 'tree'}: {r.description}" for r in wrong))
    new = new or after(ws, plan)
    if write:
        write_back(ws, plan, backup)
    return new


def _files(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if "://" in root else f"file://{root.removeprefix('file:')}")


def write_back(ws: Workspace, plan: DataFrame, backup: bool = False) -> list[str]:
    """Write what a plan changes into the tree, which all executors must reach. Each file is written under another name
    first and then put in place, so that a task may run twice; files that a plan empties go. The paths written."""
    root = ws.root.rstrip("/")
    if not root:
        raise RefactorError("the workspace was not read from a folder")

    def write(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, base = _files(root)
        for part in parts:
            for path, content, old in zip(part["file"], part["content"], part["old"]):
                at = f"{base}/{path}"
                system.create_dir(at.rpartition("/")[0], recursive=True)
                if backup:
                    # An empty backup marks a file that the plan made; a backup that a first attempt left stays.
                    if system.get_file_info(at + BACKUP).type == fs.FileType.NotFound:
                        _put(system, at + BACKUP, bytes(old) if old is not None else b"")
                if len(content):
                    _put(system, at, bytes(content))
                elif system.get_file_info(at).type != fs.FileType.NotFound:
                    system.delete_file(at)
            yield part[["file"]]

    new = apply.applied(plan, ws.files).join(ws.files.select(F.col("file_path").alias("file"), F.col("content").alias("old")), "file", "left")
    return sorted(r.file for r in new.mapInPandas(write, "file string").collect())


def _put(system, at: str, content: bytes) -> None:
    made = f"{at}.{uuid.uuid4().hex}"
    with system.open_output_stream(made) as out:
        out.write(content)
    system.move(made, at)


def restore(ws: Workspace) -> list[str]:
    """Put back what backups hold and delete them; files whose backup is empty go. The paths restored."""
    from pyarrow import fs

    system, base = _files(ws.root.rstrip("/"))
    held = [i.path for i in system.get_file_info(fs.FileSelector(base, recursive=True)) if i.path.endswith(BACKUP)]
    for path in held:
        at = path.removesuffix(BACKUP)
        if system.get_file_info(path).size:
            system.move(path, at)
        else:
            system.delete_file(path)
            if system.get_file_info(at).type != fs.FileType.NotFound:
                system.delete_file(at)
    return sorted(p.removesuffix(BACKUP).removeprefix(base + "/") for p in held)


def reverse(ws: Workspace, plan: DataFrame) -> DataFrame:
    """The plan that undoes a plan: what each file held, in place of what it holds after it."""
    new = apply.applied(plan, ws.files).select("file", F.col("content").alias("new"))
    old = ws.files.select(F.col("file_path").alias("file"), F.col("content").alias("old"))
    text = lambda c: F.coalesce(F.decode(F.col(c), "UTF-8"), F.lit(""))
    rows = new.join(old, "file", "left").select("file", F.lit(0).alias("start"), F.octet_length("new").alias("end"), text("new").alias("old_text"), text("old").alias("new_text"))
    return apply.changes(rows, "undo")


def impact(ws: Workspace, plan: DataFrame) -> DataFrame:
    """Files and packages that a plan touches or whose imports lead to a touched package: kind, name, direct."""
    files = changes.affected_files(plan).select(F.col("file").alias("name"))
    folder = F.regexp_extract("name", r"^(.*)/[^/]*$", 1)
    own = files.select(F.when(folder == "", ".").otherwise(folder).alias("name")).distinct()
    users = facts.import_edges(ws).join(own.withColumnRenamed("name", "dst"), "dst", "left_semi").select(F.col("src").alias("name")).distinct().join(own, "name", "left_anti")
    row = lambda df, kind, direct: df.select(F.lit(kind).alias("kind"), "name", F.lit(direct).alias("direct"))
    return row(files, "file", True).unionByName(row(own, "package", True)).unionByName(row(users, "package", False))


def run_steps(ws: Workspace, steps: list[tuple[str, dict]], operations: dict, write: bool = False, backup: bool = False, stop: bool = True) -> tuple[Workspace, list[dict]]:
    """Carry out operations one after another, each on what the one before it left: the workspace at the end and a
    report for each step. `stop`: the first step that fails ends the run and nothing is written; else later steps go on."""
    at, report, plans = ws, [], []
    for i, (name, arguments) in enumerate(steps):
        try:
            if name not in operations:
                raise RefactorError(f"no operation {name}")
            plan = operations[name](at, **arguments)
            at, before = execute(at, plan), at
            plans.append((before, plan))
            report.append({"step": i, "operation": name, "changes": plan.count(), "error": None})
        except RefactorError as e:
            report.append({"step": i, "operation": name, "changes": 0, "error": str(e)})
            if stop:
                return ws, report
    if write:
        for before, plan in plans:
            before.root = ws.root
            write_back(before, plan, backup)
    return at, report


def parsed_steps(text: str) -> list[tuple[str, dict]]:
    """Steps of a JSON text: a list of objects with `operation` and its arguments under `arguments`, or `name(a=1)`-less
    objects whose other keys are the arguments."""
    given = json.loads(text)
    given = given["operations"] if isinstance(given, dict) else given
    out = []
    for x in given:
        if not isinstance(x, dict) or "operation" not in x:
            raise RefactorError(f"no operation in {json.dumps(x)}")
        out.append((x["operation"], x.get("arguments", {k: v for k, v in x.items() if k != "operation"})))
    return out


class Steps:
    """Operations gathered one by one: Steps().rename_symbol(package=".", old="a", new="b").run(ws, operations)."""

    def __init__(self) -> None:
        self.steps: list[tuple[str, dict]] = []

    def add(self, name: str, **arguments) -> Steps:
        self.steps.append((name, arguments))
        return self

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        return lambda **arguments: self.add(name, **arguments)

    def run(self, ws: Workspace, operations: dict, **how) -> tuple[Workspace, list[dict]]:
        return run_steps(ws, self.steps, operations, **how)


def clean_up(ws: Workspace) -> list[tuple[str, dict]]:
    """Canned steps: drop redundant aliases, then sort the imports."""
    return [("clean_aliases", {}), ("organise_imports", {})]


def rename_everywhere(ws: Workspace, old: str, new: str) -> list[tuple[str, dict]]:
    """Canned steps: rename a symbol in every package that declares it."""
    found = facts.symbols(ws).where((F.col("name") == old) & (F.col("kind") != "Method")).select("dir").distinct().orderBy("dir").collect()
    return [("rename_symbol", {"package": r.dir, "old": old, "new": new}) for r in found]


def tidy_code(ws: Workspace) -> list[tuple[str, dict]]:
    """Canned steps: all fixes that need no argument."""
    return [(n, {}) for n in ("fix_boolean_branching", "fix_deep_if_else", "fix_if_init", "fix_error_wrapping")]
