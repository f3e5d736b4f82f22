"""Dependency names in manifests.

Each parser turns one manifest's text into names; ``dependencies`` maps it over
a table of manifests.  The formats need state from line to line, so this is the
one place of ingest that runs Python, and only over manifest files.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F

MAX_NAMES = 100
MAX_NAME_BYTES = 63
SECTION = re.compile(r"\[(.*)\]", re.DOTALL).fullmatch
QUOTED = re.compile(r'"([^"]*)"').findall
JSON_KEYS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
MANIFESTS = ("Cargo.toml", "go.mod", "package.json", "pyproject.toml")


def _lines(text: str, comment: str) -> Iterator[str]:
    return (s for line in text.split("\n") if (s := line.strip()) and not s.startswith(comment))


def _key(line: str) -> str:
    return re.split("[= ]", line, maxsplit=1)[0].strip()


def cargo_names(text: str) -> Iterator[str]:
    listing = False
    for line in _lines(text, "#"):
        if not (section := SECTION(line)):
            if listing:
                yield _key(line)
            continue
        name = section[1].strip()
        _, table, own = name.rpartition("dependencies.")
        listing = not table and (name == "dependencies" or name.endswith(("-dependencies", ".dependencies")))
        if table:
            yield own.strip().strip('"')


def go_names(text: str) -> Iterator[str]:
    listing = False
    for line in _lines(text, "//"):
        if listing:
            listing = not line.startswith(")")
            if listing:
                yield line.split()[0]
        elif line.startswith("require ("):
            listing = True
        elif line.startswith("require ") and (rest := line[8:].split()):
            yield rest[0]


def _closing(text: str, start: int) -> int:
    """Where the brace that is open at ``start`` closes, or the end."""
    depth = 1
    for m in re.compile("[{}]").finditer(text, start):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.start()
    return len(text)


def npm_names(text: str) -> Iterator[str]:
    for key in JSON_KEYS:
        at = 0
        while (at := text.find(f'"{key}"', at)) >= 0 and (brace := text.find("{", at)) >= 0:
            at = _closing(text, brace + 1)
            yield from (q[0] for entry in text[brace + 1 : at].split(",") if (q := QUOTED(entry)))


def python_names(text: str) -> Iterator[str]:
    table = array = False
    for line in _lines(text, "#"):
        if section := SECTION(line):
            name = section[1].strip()
            table, array = name.startswith("tool.poetry") and name.endswith("dependencies"), False
        elif table:
            if (name := _key(line).strip('"')) != "python":
                yield name
        elif array or line.startswith("dependencies") and "=" in line and "[" in line:
            array = "]" not in line
            yield from (re.match(r"[\w.-]*", spec)[0] for spec in QUOTED(line))


PARSERS = dict(zip(MANIFESTS, (cargo_names, go_names, npm_names, python_names)))


def names_in(file_name: str, text: str) -> list[str]:
    """The first hundred names of a manifest, in order; repeats stay."""
    parse = PARSERS.get(file_name)
    found = parse(text) if parse else ()
    return [n for n in found if n and len(n.encode()) <= MAX_NAME_BYTES][:MAX_NAMES]


def dependencies(files: DataFrame) -> DataFrame:
    """``path, name`` of each dependency of the manifests among ``files(path, content)``."""
    manifests = files.where(F.element_at(F.split("path", "/"), -1).isin(*MANIFESTS)).select("path", "content")

    def parse(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, n) for p, t in zip(pdf["path"], pdf["content"]) for n in names_in(p.rsplit("/", 1)[-1], t or "")]
            yield pd.DataFrame(rows, columns=["path", "name"])

    return manifests.mapInPandas(parse, "path string, name string")
