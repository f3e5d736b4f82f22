"""Scalar expressions over text, time and vectors: built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY_MS = 86_400_000.0
HALF_LIFE_DAYS = 30
#: Separates the parts of a composite identity.
UNIT = "\x01"

# Ranking weight of each node kind.
KIND_WEIGHTS = {
    "decision": 1.0, "implementation": 1.0, "design_doc": 0.9, "turn": 0.85, "concept": 0.8, "session": 0.65, "pattern": 0.6, "debt_signal": 0.6,
    "repo": 0.5, "module": 0.5, "commit": 0.5, "file": 0.4, "manifest": 0.4, "package": 0.4, "framework": 0.4, "tooling": 0.4, "data_source": 0.4, "person": 0.4, "symbol": 0.3,
}
# Node kinds that carry recallable meaning.
SEMANTIC_KINDS = ("decision", "implementation", "turn", "session", "design_doc", "concept", "pattern", "debt_signal")
# Edge kinds.
EDGE_KINDS = (
    "contains", "defines", "depends_on", "derived_from", "decided_in", "produced", "touches", "changed_by", "supersedes",
)
# Markers of turns that are control chatter.
NOISE_MARKERS = ("<command-name>", "<command-message>", "<command-args>", "<local-command-stdout>", "<local-command-stderr>", "[Request interrupted")


def node_id(kind: Column | str, identity: Column) -> Column:
    """32 hex digits of SHA-256 over kind, a zero byte and the identity."""
    tag = F.lit(kind) if isinstance(kind, str) else kind
    return F.substring(F.sha2(F.concat(tag, F.lit("\x00"), identity), 256), 1, 32)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def display_kind(tag: Column) -> Column:
    """``design_doc`` as ``DesignDoc``."""
    return F.replace(F.initcap(F.replace(tag, F.lit("_"), F.lit(" "))), F.lit(" "), F.lit(""))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def summarize(body: Column) -> Column:
    """The first sentence within 180 characters, else 180 characters and an ellipsis, else all."""
    t = collapse(body)
    head = F.substring(t, 1, 180)
    stop = F.regexp_substr(head, F.lit(r"^[^.!?]*[.!?]"))
    return F.coalesce(stop, F.when(F.char_length(t) > 180, F.concat(head, F.lit("…"))).otherwise(t))


def snippet(text: Column, n: int = 240) -> Column:
    return F.when(F.char_length(text) > n, F.concat(F.substring(text, 1, n), F.lit("…"))).otherwise(text)


def evidence_text(summary: Column, body: Column, label: Column) -> Column:
    """What a hit shows: its summary, else the start of its body, else its label."""
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.coalesce(filled(summary), snippet(filled(body)), label)


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric runs of more than one byte."""
    return F.filter(F.split(F.lower(text), r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: F.octet_length(t) > 1)


def contains_word(text: Column, word: Column) -> Column:
    """Whether ``word`` is a whole alphanumeric token of ``text``."""
    return F.array_contains(F.split(text, r"[^\p{IsAlphabetic}\p{N}]+"), word)


def is_low_value(text: Column) -> Column:
    """Empty, a control wrapper, or a standing caveat."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    noise = F.lit(False)
    for m in NOISE_MARKERS:
        noise = noise | F.contains(t, F.lit(m))
    return (t == "") | noise | F.startswith(t, F.lit("Caveat:"))


def recency(now_ms: Column | int, ts_ms: Column) -> Column:
    """1 now, halved with each 30 days of age."""
    now = F.lit(now_ms) if isinstance(now_ms, int) else now_ms
    age = F.greatest(now - ts_ms, F.lit(0)) / F.lit(DAY_MS) / F.lit(HALF_LIFE_DAYS)
    return F.pow(F.lit(0.5), age)


def kind_weight(kind: Column) -> Column:
    w = F.lit(None).cast("double")
    for k, v in KIND_WEIGHTS.items():
        w = F.when(kind == k, F.lit(v)).otherwise(w)
    return w


def centrality(kind: Column, degree: Column) -> Column:
    """A small prior for well-connected decisions and implementations."""
    return F.when(kind.isin("decision", "implementation"), F.log1p(F.coalesce(degree, F.lit(0)).cast("double")) * 0.03).otherwise(F.lit(0.0))


def rfc3339_ms(text: Column) -> Column:
    """Epoch milliseconds; null unless a valid instant with an offset."""
    valid = F.rlike(text, F.lit(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"))
    return F.when(valid, F.unix_millis(F.try_to_timestamp(text)))


def commit_sha(text: Column) -> Column:
    """``text`` if it is seven hex digits or more, else null."""
    return F.when(F.rlike(text, F.lit(r"^[0-9a-fA-F]{7,}$")), text)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def relative_path(root: Column, path: Column) -> Column:
    """``path`` without the leading ``root`` (a plain prefix), else with forward slashes."""
    stripped = F.regexp_replace(F.substr(path, F.char_length(root) + 1), r"^[/\\]+", "")
    return F.when(root.isNotNull() & F.startswith(path, root), stripped).otherwise(F.replace(path, F.lit("\\"), F.lit("/")))


def file_identity(repo: Column, rel: Column) -> Column:
    return F.concat(F.coalesce(repo, F.lit("")), F.lit(UNIT), rel)


def dot(a: Column, b: Column) -> Column:
    """Inner product; vectors of different lengths score 0."""
    product = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), product).otherwise(F.lit(0.0))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def l2_normalize(v: Column) -> Column:
    """``v`` at length one; a zero vector unchanged."""
    return let(v, lambda v: let(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(v)))
