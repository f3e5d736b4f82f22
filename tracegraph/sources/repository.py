"""Source trees, commit histories and word-vector files."""

from __future__ import annotations

import hashlib
import os
import subprocess

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed names: folders and files that a walk prunes.
SKIPPED = (".git", "target", "node_modules", "dist", "build", ".venv", "vendor")
GRAPH_COMMITS, TIMELINE_COMMITS = 400, 1000
COMMIT_SCHEMA = "oid string, short string, summary string, author string, time_ms bigint, changed array<string>"


def is_skipped(rel: Column) -> Column:
    """Whether a relative path lies in, or is, one of the skipped names."""
    return F.arrays_overlap(F.split(rel, "/"), F.array(*map(F.lit, SKIPPED)))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, content, n_bytes`` of every file below ``root`` outside skipped folders; ``path`` is relative."""
    base = os.path.abspath(root) if "://" not in root else root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    rel = F.regexp_replace(F.substring_index(F.url_decode(F.replace(F.col("path"), F.lit("+"), F.lit("%2B"))), base.split("://")[-1] + "/", -1), r"^/+", "")
    kept = files.withColumn("rel", rel).where(~is_skipped(F.col("rel")))
    return kept.select(F.col("rel").alias("path"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"), F.col("length").alias("n_bytes"))


def _git(root: str, *args: str) -> str | None:
    try:
        done = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="replace", timeout=300)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout if done.returncode == 0 else None


def work_tree(root: str) -> str | None:
    """Top folder of the work tree that holds ``root``; null outside one and for a bare repository."""
    top = _git(root, "rev-parse", "--show-toplevel")
    return top.strip() or None if top else None


def commits(spark: SparkSession, root: str, cap: int = GRAPH_COMMITS, with_changes: bool = True) -> DataFrame:
    """Up to ``cap`` commits from HEAD, newest first, with the files that differ from the first parent; empty on any error."""
    rows = []
    if work_tree(root):
        log = _git(root, "log", f"-{cap}", "--format=%x1e%H%x1f%s%x1f%an%x1f%ct%x1f", *(["--name-only", "-m", "--first-parent", "--root", "--no-renames"] if with_changes else []))
        # --first-parent shows each commit's difference from its first parent, but also walks only those, so ids come from rev-list.
        ids = (_git(root, "rev-list", f"-n{cap}", "HEAD") or "").split()
        seen = {}
        for entry in (log or "").split("\x1e")[1:]:
            oid, summary, author, when, rest = entry.split("\x1f", 4)
            seen[oid] = (oid, oid[:8], summary, author, int(when) * 1000, sorted({x for x in rest.split("\n") if x}))
        for oid in ids:
            if oid not in seen and (one := _git(root, "log", "-1", "--format=%s%x1f%an%x1f%ct", oid)):
                summary, author, when = one.rstrip("\n").split("\x1f")
                diff = _git(root, "diff-tree", "-r", "--name-only", "--no-renames", f"{oid}^1", oid) if with_changes else ""
                seen[oid] = (oid, oid[:8], summary, author, int(when) * 1000, sorted(set((diff or "").split("\n")) - {""}))
        rows = sorted((seen[i] for i in ids if i in seen), key=lambda r: -r[4])
    return spark.createDataFrame(rows, COMMIT_SCHEMA)


def same_tree(cwd: str, root: str) -> bool:
    """Whether ``cwd`` is ``root`` or below it with no other repository in between."""
    cwd, root = os.path.realpath(cwd), os.path.realpath(root)
    while cwd != root:
        if os.path.exists(os.path.join(cwd, ".git")) or cwd == os.path.dirname(cwd):
            return False
        cwd = os.path.dirname(cwd)
    return True


def nested_repositories(root: str) -> list[str]:
    """Folders below ``root`` that are repositories of their own, relative to it; what lies in them is not looked at."""
    out = []
    for top, dirs, names in os.walk(root):
        if top != root and (".git" in dirs or ".git" in names):
            out.append(os.path.relpath(top, root))
            dirs.clear()
        dirs[:] = [d for d in dirs if d != ".git"]
    return sorted(out)


def in_tree(cwd: Column, root: str, nested: list[str]) -> Column:
    """``same_tree`` as an expression: ``cwd`` is ``root``, by either of its names, or below it and in none of ``nested``."""
    path = F.regexp_replace(cwd, r"/+$", "")
    found = F.lit(False)
    for top in {os.path.abspath(root), os.path.realpath(root)}:
        below = F.substr(path, F.lit(len(top) + 2))
        inner = F.exists(F.array(*map(F.lit, nested)), lambda n: (below == n) | F.startswith(below, F.concat(n, F.lit("/")))) if nested else F.lit(False)
        found = found | (path == top) | (F.startswith(path, F.lit(top + "/")) & ~inner)
    return F.coalesce(found, F.lit(False))


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """``token, vec`` of a text file of word vectors.

    The first row with two numbers or more fixes the dimension; rows of another
    length or with a bad number are skipped; tokens are lower-cased and the last
    of repeated ones counts.
    """
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    parts = lines.select("pos", F.split(F.trim("line"), r"\s+").alias("p"))
    rows = parts.select("pos", F.lower(F.col("p")[0]).alias("token"), F.transform(F.slice("p", 2, 100_000), lambda x: x.try_cast("double")).alias("vec"))
    rows = rows.where((F.size("vec") >= 2) & ~F.exists("vec", lambda x: x.isNull()))
    first = rows.orderBy("pos").limit(1).collect()
    if not first:
        return rows.select("token", "vec")
    same = rows.where(F.size("vec") == len(first[0]["vec"]))
    return same.groupBy("token").agg(F.max(F.struct("pos", "vec"))["vec"].alias("vec"))


def vector_file_id(path: str) -> str:
    """Name of an embedder over a vector file: its stem and a hash of its bytes."""
    with open(path, "rb") as f:
        digest = hashlib.sha256(f.read()).hexdigest()[:8]
    return f"static:{os.path.splitext(os.path.basename(path))[0]}:{digest}"
