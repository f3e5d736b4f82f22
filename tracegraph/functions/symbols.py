"""Symbols of source files by one pattern for each language and kind."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed patterns: extensions, then (kind, pattern) in the order in which they fill a file's quota.
LANGUAGES = (
    (("rs",), (
        ("fn", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+([A-Za-z_][A-Za-z0-9_]*)"),
        ("struct", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+([A-Za-z_][A-Za-z0-9_]*)"),
        ("enum", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+([A-Za-z_][A-Za-z0-9_]*)"),
        ("trait", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+([A-Za-z_][A-Za-z0-9_]*)"),
    )),
    (("py",), (
        ("def", r"(?m)^\s*def\s+([A-Za-z_][A-Za-z0-9_]*)"),
        ("class", r"(?m)^\s*class\s+([A-Za-z_][A-Za-z0-9_]*)"),
    )),
    (("js", "ts", "jsx", "tsx", "mjs"), (
        ("function", r"(?m)\bfunction\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
        ("class", r"(?m)\bclass\s+([A-Za-z_$][A-Za-z0-9_$]*)"),
        ("const", r"(?m)^\s*(?:export\s+)?const\s+([A-Za-z_$][A-Za-z0-9_$]*)\s*="),
    )),
    (("go",), (
        ("func", r"(?m)^\s*func\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)"),
        ("type", r"(?m)^\s*type\s+([A-Za-z_][A-Za-z0-9_]*)"),
    )),
)
MAX_SYMBOLS = 200
MAX_BYTES = 1_000_000


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./\\]+)$", 1)


def symbols(path: Column, text: Column) -> Column:
    """``array<struct<kind, name>>``, at most 200 in a file; none of files over a megabyte."""
    ext = extension(path)
    out = F.array().cast("array<struct<kind:string,name:string>>")
    for exts, rules in LANGUAGES:
        found = F.concat(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(1)), _tagged(k)) for k, p in rules])
        out = F.when(ext.isin(*exts), F.slice(found, 1, MAX_SYMBOLS)).otherwise(out)
    return F.when(F.octet_length(text) <= MAX_BYTES, out).otherwise(F.array().cast("array<struct<kind:string,name:string>>"))


def _tagged(kind: str):
    return lambda name: F.struct(F.lit(kind).alias("kind"), name.alias("name"))
