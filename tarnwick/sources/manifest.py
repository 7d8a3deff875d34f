"""Corpus manifests: building, writing, verifying, pins and digests."""

from __future__ import annotations

import hashlib
import json
import subprocess
from dataclasses import dataclass
from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import __version__

VERSION = 1
#: Keys of a metadata document that change from run to run.
VOLATILE = ("generated_at", "duration_seconds", "engine_commit")


@dataclass(frozen=True)
class Pin:
    """A project at a commit of a repository."""

    name: str
    repository: str
    commit: str

    @classmethod
    def parse(cls, text: str) -> Pin:
        """``name=url@commit``; the url may hold further ``=`` and ``@``."""
        name, eq, rest = text.partition("=")
        url, at, commit = rest.rpartition("@")
        if not (eq and at and name and url) or len(commit) < 7:
            raise ValueError(f"not name=url@commit with 7 characters of the commit at least: {text!r}")
        return cls(name, url, commit)


def entries(files: DataFrame) -> DataFrame:
    """(project, path inside the project, lines, sha256) of scanned files, in order of their paths' parts."""
    inside = F.array_join(F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), "/")
    return files.orderBy("parts").select("project", F.when(inside == "", F.col("project")).otherwise(inside).alias("path"), "lines", "sha256")


def project_totals(files: DataFrame) -> DataFrame:
    """Files and lines of each project and, with a null project, of all."""
    return files.rollup("project").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("lines"), F.lit(0)).alias("lines"))


def checkout(folder: str | Path) -> tuple[str | None, str | None]:
    """(remote, commit) of a git checkout; nothing where there is none."""
    if not (Path(folder) / ".git").exists():
        return None, None

    def git(*args: str) -> str | None:
        done = subprocess.run(["git", "-C", str(folder), *args], capture_output=True, text=True, check=False)
        return done.stdout.strip() or None if done.returncode == 0 else None

    return git("remote", "get-url", "origin"), git("rev-parse", "HEAD")


def fetch(pin: Pin, root: str | Path) -> Path:
    """Check a project out at its pin; a folder that is no checkout, or another commit afterwards, is an error."""
    to = Path(root) / pin.name
    if to.exists() and not (to / ".git").exists():
        raise FileExistsError(f"{to} exists and is no checkout")
    steps = [["fetch", "--quiet", "origin"]] if to.exists() else []
    if not to.exists():
        subprocess.run(["git", "clone", "--quiet", "--no-checkout", pin.repository, str(to)], check=True)
    for step in [*steps, ["checkout", "--quiet", "--detach", pin.commit]]:
        subprocess.run(["git", "-C", str(to), *step], check=True)
    head = checkout(to)[1] or ""
    if not head.startswith(pin.commit):
        raise RuntimeError(f"{pin.name}: {head} is not {pin.commit}")
    return to


def build(files: DataFrame, root: str | Path | None = None, pins: list[Pin] | None = None) -> dict:
    """The manifest of scanned files; repository and commit come from pins, else from checkouts below ``root``.

    A manifest lists every file, so the driver holds it all: it is made for
    corpora of sources, not of web pages.
    """
    by_name = {p.name: (p.repository, p.commit) for p in pins or []}
    totals = {r["project"]: r for r in project_totals(files).collect()}
    whole = totals.pop(None, None)
    projects = {}
    for name in sorted(totals):
        repository, commit = by_name.get(name) or (checkout(Path(root) / name) if root else (None, None))
        projects[name] = {"repository": repository, "commit": commit, "files": totals[name]["files"], "lines": totals[name]["lines"]}
    return {
        "manifest_version": VERSION,
        "engine_version": __version__,
        "generated": date.today().isoformat(),
        "projects": projects,
        "totals": {"files": whole["files"] if whole else 0, "lines": whole["lines"] if whole else 0},
        "files": [r.asDict() for r in entries(files).collect()],
    }


def write(manifest: dict, path: str | Path) -> None:
    """Indented JSON with a newline at its end; folders are made."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(manifest, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def pins(manifest: dict) -> list[Pin]:
    """The pins of a manifest; a project without repository or commit is an error."""
    out = []
    for name, p in manifest["projects"].items():
        if not p.get("repository") or not p.get("commit"):
            raise ValueError(f"{name} is not pinned")
        out.append(Pin(name, p["repository"], p["commit"]))
    return out


def differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(project, path, problem, detail) where two file lists (project, path, lines, sha256) differ."""
    e, a = expected.alias("e"), actual.alias("a")
    both = e.join(a, (F.col("e.project") == F.col("a.project")) & (F.col("e.path") == F.col("a.path")), "full_outer")
    problem = (
        F.when(F.col("a.path").isNull(), "missing")
        .when(F.col("e.path").isNull(), "not in manifest")
        .when(F.col("e.sha256") != F.col("a.sha256"), "content differs")
        .when(F.col("e.lines") != F.col("a.lines"), "line count differs")
    )
    detail = F.when(problem == "line count differs", F.format_string("%d vs %d", "e.lines", "a.lines"))
    return both.select(F.coalesce("e.project", "a.project").alias("project"), F.coalesce("e.path", "a.path").alias("path"), problem.alias("problem"), detail.alias("detail")).where("problem is not null")


_ORDER = ("missing", "not in manifest", "content differs", "line count differs")


def verify(spark: SparkSession, files: DataFrame, manifest: dict, root: str | Path | None = None) -> list[str]:
    """How the scanned files differ from a manifest, in a fixed order; nothing where they don't."""
    schema = "project string, path string, lines int, sha256 string"
    expected = spark.createDataFrame([(f["project"], f["path"], f["lines"], f["sha256"]) for f in manifest["files"]], schema)
    rows = sorted(differences(expected, entries(files)).collect(), key=lambda r: (_ORDER.index(r["problem"]), r["project"], r["path"]))
    out = [f"{r['problem']}: {r['project']}/{r['path']}" + (f" ({r['detail']})" if r["detail"] else "") for r in rows]
    for name, p in manifest["projects"].items():
        have = checkout(Path(root) / name)[1] if root else None
        if p.get("commit") and have and have != p["commit"]:
            out.append(f"{name}: checked out {have[:10]}, manifest pins {p['commit'][:10]}")
    return out


def file_digest(path: str | Path) -> str:
    """SHA-256 of a file's bytes, in pieces."""
    with Path(path).open("rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def results_digest(folder: str | Path) -> dict[str, str]:
    """SHA-256 of each result file; of the metadata without what changes from run to run."""
    out = {}
    for p in sorted(Path(folder).glob("*.json")):
        if p.name == "metadata.json":
            stable = {k: v for k, v in json.loads(p.read_text(encoding="utf-8")).items() if k not in VOLATILE}
            out[p.name] = hashlib.sha256(json.dumps(stable, sort_keys=True).encode()).hexdigest()
        else:
            out[p.name] = file_digest(p)
    return out


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunks as JSON lines, in a folder of part files."""
    chunks.write.mode("overwrite").json(path)
