"""Transcript connectors: JSON lines of two dialects to sessions and turns.

Lines are read as text with their position in the file and parsed leniently
into VARIANT: a broken line is null and dropped, an unknown record is a turn of
kind ``unknown``.  All of it is column expressions, one shuffle by file for the
session's first values.  Text is redacted as it is read.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tracegraph.functions.redact import redact
from tracegraph.functions.text import commit_sha, let, rfc3339_ms

UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def get(v: str | Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def first_of(*cols: Column) -> Column:
    return F.coalesce(*cols)


def _texts(content: str, types: tuple[str, ...]) -> Column:
    """The text of a string, or of an array's blocks of the given types, one a line."""
    blocks = get("v", content, "array<variant>")
    chosen = F.filter(blocks, lambda b: F.try_variant_get(b, "$.type", "string").isin(*types))
    parts = F.filter(F.transform(chosen, lambda b: F.try_variant_get(b, "$.text", "string")), lambda t: t.isNotNull())
    return F.coalesce(F.array_join(parts, "\n"), F.when(F.schema_of_variant(F.try_variant_get("v", content, "variant")) == "STRING", get("v", content)))


def _paths(v: Column, keys: tuple[str, ...], nested: tuple[str, ...]) -> Column:
    """Paths under ``keys`` of an object, of its ``nested`` objects and its ``edits``, however deep.

    A list of paths found and objects left is rewritten in place, each object to
    its own paths and the objects in it, as often as the text has keys to follow.
    """
    item = "struct<p:string,v:variant>"
    found = lambda p: F.struct(p.alias("p"), F.lit(None).cast("variant").alias("v"))
    left = lambda v: F.struct(F.lit(None).cast("string").alias("p"), v.alias("v"))

    def within(v: Column) -> Column:
        own = [found(F.try_variant_get(v, f"$.{k}", "string")) for k in keys]
        deeper = [left(F.try_variant_get(v, f"$.{n}", "variant")) for n in nested]
        edits = F.transform(F.try_variant_get(v, "$.edits", "array<variant>"), left)
        return F.concat(F.array(*own, *deeper), F.coalesce(edits, F.array().cast(f"array<{item}>")))

    def step(items: Column) -> Column:
        opened = F.flatten(F.transform(items, lambda x: F.when(x["v"].isNull(), F.array(x)).otherwise(within(x["v"]))))
        return F.filter(opened, lambda x: x["p"].isNotNull() | x["v"].isNotNull())

    times = F.regexp_count(F.to_json(v), F.lit(r'"(?:' + "|".join((*nested, "edits")) + r')"\s*:')) + 1
    all_ = F.aggregate(F.sequence(F.lit(1), times), F.array(left(v)), lambda items, _: step(items))
    return F.transform(F.filter(all_, lambda x: x["p"].isNotNull()), lambda x: x["p"])


def _distinct(paths: Column) -> Column:
    return F.coalesce(F.array_distinct(F.filter(paths, lambda p: p.isNotNull() & (p != ""))), F.array().cast("array<string>"))


@dataclass(frozen=True)
class Connector:
    """A dialect: where its files lie, and how a parsed line ``v`` becomes turn and session fields."""

    id: str
    home: str
    depth: int
    glob: str
    fields: Callable[[], dict[str, Column]]
    session_id: Callable[[Column], Column]

    def discover(self, home: str | None = None) -> list[str]:
        """Transcript files below the tool's folder, sorted; none if it is missing."""
        root = home or os.path.expanduser(self.home)
        return find_files(root, self.glob, self.depth)


def is_transcript(rel: Column, glob: str = "*.jsonl", depth: int | None = None) -> Column:
    """Whether a relative path names a transcript: its last part fits ``glob``, and it has ``depth`` parts at most."""
    name = F.rlike(F.element_at(F.split(rel, "/"), -1), F.lit("^" + "[^/]*".join(map(re.escape, glob.split("*"))) + "$"))
    return name if depth is None else name & (F.size(F.split(rel, "/")) <= depth)


def find_files(root: str, glob: str = "*.jsonl", depth: int | None = None) -> list[str]:
    """Local files below ``root`` that ``is_transcript`` holds of, sorted."""
    from fnmatch import fnmatchcase

    out = []
    for top, dirs, names in os.walk(root):
        parts = 0 if top == root else len(os.path.relpath(top, root).split(os.sep))
        if depth is not None and parts + 1 >= depth:
            dirs.clear()
        out += [os.path.join(top, n) for n in names if fnmatchcase(n, glob)]
    return sorted(out)


def find_remote(spark: SparkSession, path: str) -> list[str]:
    """``path`` itself if it is a file, else all .jsonl files below it, on any file system of Spark; sorted."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(at):
        raise FileNotFoundError(path)
    if fs.getFileStatus(at).isFile():
        return [path]
    found, out = fs.listFiles(at, True), []
    while found.hasNext():
        name = found.next().getPath().toString()
        if name.endswith(".jsonl"):
            out.append(name)
    return sorted(out)


def _fields_a() -> dict[str, Column]:
    kind = get("v", "$.type")
    tools = F.filter(get("v", "$.message.content", "array<variant>"), lambda b: F.try_variant_get(b, "$.type", "string") == "tool_use")
    keys = ("file_path", "path", "notebook_path", "filePath")
    touched = F.flatten(F.transform(tools, lambda b: _paths(F.try_variant_get(b, "$.input", "variant"), keys, ())))
    text = F.when(kind == "summary", get("v", "$.summary")).otherwise(_texts("$.message.content", ("text",)))
    return {
        "kind": F.when(kind.isin("user", "assistant", "system", "summary"), kind).otherwise("unknown"),
        "text": F.coalesce(text, F.lit("")), "ts_ms": rfc3339_ms(get("v", "$.timestamp")), "touched_files": _distinct(touched),
        "cwd": get("v", "$.cwd"), "version": get("v", "$.version"), "commit": commit_sha(first_of(get("v", "$.gitCommit"), get("v", "$.commit"))),
    }


def _fields_b() -> dict[str, Column]:
    probe = lambda *keys: first_of(*[get("v", f"$.{where}{k}") for k in keys for where in ("", "payload.")])
    kind = first_of(get("v", "$.payload.type"), get("v", "$.type"))
    role, call = get("v", "$.payload.role"), kind == "function_call"
    args = F.try_parse_json(get("v", "$.payload.arguments"))
    touched = let(args, lambda a: _paths(a, ("file_path", "path", "filePath"), ("input", "args")))
    return {
        "kind": F.when((kind == "message") & role.isin("user", "assistant", "system"), role).when(call, F.lit("assistant")).otherwise("unknown"),
        "text": F.when(call, F.concat(F.lit("[tool] "), F.coalesce(get("v", "$.payload.name"), F.lit("")))).when(kind == "message", F.coalesce(_texts("$.payload.content", ("input_text", "output_text", "text")), F.lit(""))).otherwise(""),
        "ts_ms": rfc3339_ms(probe("timestamp")), "touched_files": F.when(call, _distinct(touched)).otherwise(F.array().cast("array<string>")),
        "cwd": probe("cwd"), "version": probe("cli_version", "version"),
        "commit": commit_sha(first_of(get("v", "$.payload.git.commit"), get("v", "$.git.commit"), probe("commit", "git_commit"))),
    }


def _stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/\\]+)$", 1), r"\.[^.]*$", "")


def _rollout_id(path: Column) -> Column:
    """A trailing UUID of the file name, else its last group of eight characters or more, else the name."""
    stem = _stem(path)
    last = F.element_at(F.split(stem, "-"), -1)
    full = F.regexp_extract(stem, rf"({UUID})$", 1)
    return F.when(full != "", full).when(F.char_length(last) >= 8, last).otherwise(stem)


CONNECTORS = {
    "claude_code": Connector("claude_code", "~/.claude/projects", 3, "*.jsonl", _fields_a, _stem),
    "codex": Connector("codex", "~/.codex/sessions", 5, "rollout-*.jsonl", _fields_b, _rollout_id),
}


def resolve(connector: Connector, path: str | None = None, spark: SparkSession | None = None) -> list[str]:
    """A file is itself, a folder all its .jsonl files, no path what is discovered; a missing path is an error.

    With a session, paths with a scheme are looked up in their file system.
    """
    if path is None:
        return connector.discover()
    if spark is not None and "://" in path:
        return find_remote(spark, path)
    if os.path.isfile(path):
        return [path]
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    return find_files(path)


def read_lines(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """``path, pos, line`` of text files; a session is one file, and its lines one task's."""
    files = spark.read.text(paths, wholetext=True, recursiveFileLookup=True)
    whole = files.select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    return whole.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))


def parse_lines(lines: DataFrame, connector: Connector) -> DataFrame:
    """Turns of ``lines(path, pos, line)`` with their line's session fields; blank and broken lines are dropped."""
    v = lines.withColumn("v", F.try_parse_json(F.trim("line"))).where(F.col("v").isNotNull() & (F.trim("line") != ""))
    out = v.select("path", "pos", *[c.alias(n) for n, c in connector.fields().items()])
    index = F.row_number().over(W.partitionBy("path").orderBy("pos")) - 1
    return out.withColumn("idx", index).withColumn("text", redact(F.col("text"))).withColumn("native_session_id", connector.session_id(F.col("path")))


def sessions_of(turns: DataFrame, connector: Connector) -> DataFrame:
    """A row per file: the first value of each session field, in line order."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("pos", c)))[c]
    return turns.groupBy("path", "native_session_id").agg(
        first("cwd").alias("repo_root"), first("version").alias("connector_version"), first("commit").alias("commit"), first("ts_ms").alias("started_at_ms"), F.count("*").alias("n_turns")
    ).withColumn("agent", F.lit(connector.id))


def read_sessions(spark: SparkSession, connector_id: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Sessions and turns of a connector's files."""
    connector = CONNECTORS[connector_id]
    paths = resolve(connector, path, spark)
    lines = read_lines(spark, paths) if paths else spark.createDataFrame([], "path string, pos int, line string")
    turns = parse_lines(lines, connector)
    return sessions_of(turns, connector), turns


def doctor(spark: SparkSession, connector_id: str, path: str | None = None) -> dict:
    """What a connector finds: files, the first ten of them, and lines that are broken or of unknown kind."""
    connector = CONNECTORS[connector_id]
    paths = resolve(connector, path, spark)
    if not paths:
        return {"files": 0, "first": [], "lines": 0, "broken": 0, "unknown": 0}
    lines = read_lines(spark, paths).where(F.trim("line") != "")
    total = lines.agg(F.count("*"), F.count(F.when(F.try_parse_json("line").isNull(), 1))).first()
    unknown = parse_lines(lines, connector).where("kind = 'unknown'").count()
    return {"files": len(paths), "first": paths[:10], "lines": total[0], "broken": total[1], "unknown": unknown}
