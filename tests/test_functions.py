"""Scalar expressions, redaction, decisions, symbols, manifests and reply parsing."""

import pytest
from pyspark.sql import functions as F

from tracegraph.functions import distill, text as X
from tracegraph.functions.decisions import decision_text, superseded_subject
from tracegraph.functions.manifests import names_in
from tracegraph.functions.redact import contains_secret, redact
from tracegraph.functions.symbols import symbols


def column(spark, values, fn):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string").orderBy("i").select(fn(F.col("t"))).collect()]


def test_summaries(spark):
    got = column(spark, ["One  two. Three.", "no stop", "x" * 200, "see v2.1 now", "", None], X.summarize)
    assert got == ["One two.", "no stop", "x" * 180 + "…", "see v2.", "", None]


def test_ids_are_stable_and_separated(spark):
    a, b, c = column(spark, ["x"], lambda t: X.node_id("turn", t)), column(spark, ["x"], lambda t: X.node_id("turn", t)), column(spark, ["x"], lambda t: X.node_id("file", t))
    assert a == b != c and len(a[0]) == 32


def test_tokens_count_bytes(spark):
    assert column(spark, ["A bc, é dé-F_12 漢"], X.tokens) == [["bc", "é", "dé", "12", "漢"]]


def test_low_value(spark):
    assert column(spark, ["", "  \n", "a <command-name>x", " Caveat: y", "not Caveat:", "[Request interrupted by"], X.is_low_value) == [True, True, True, True, False, True]


def test_instants(spark):
    got = column(spark, ["1970-01-01T00:00:01.500Z", "1970-01-01T02:00:00+02:00", "1970-01-01T00:00:00", "nonsense", None], X.rfc3339_ms)
    assert got == [1500, 0, None, None, None]


def test_paths(spark):
    assert column(spark, ["/work/demo/src/a.rs", "/work/demo2/x", "C:\\a\\b"], lambda t: X.relative_path(F.lit("/work/demo"), t)) == ["src/a.rs", "2/x", "C:/a/b"]
    assert column(spark, ["a/b.rs", "a\\c"], X.basename) == ["b.rs", "c"]


def test_redaction(spark):
    key, pem = "s" + "k-" + "a1B2" * 8, "-----BEGIN RSA PRIVATE" + " KEY-----\nabc\ndef\n-----END RSA PRIVATE" + " KEY-----"
    texts = [f"use {key} please", f"one\n{pem}\ntwo", "nothing here", f"X_KEY={key}", None]
    once = column(spark, texts, redact)
    assert "<redacted:openai_key:" in once[0] and key not in once[0]
    assert once[1].startswith("one\n<redacted:private_key:") and once[1].endswith("\ntwo") and once[2] == texts[2] and once[4] is None
    assert once[3].startswith("<redacted:env_assignment:") and column(spark, once, redact) == once
    assert column(spark, texts[:4], contains_secret) == [True, True, False, True]


def test_decisions(spark):
    texts = ["Hello. For the canvas we are going with Cytoscape.js today.", "Let's use it.", "We rejected that plan! but LET'S USE redb for all of it", "no cue in these many words"]
    assert column(spark, texts, decision_text) == ["For the canvas we are going with Cytoscape.", None, "but LET'S USE redb for all of it", None]
    texts = ["Switch to redb instead of sled", "use X rather than the old thing", "instead of the a an; replacing foo", "nothing", "instead of it"]
    assert column(spark, texts, superseded_subject) == ["sled", "thing", "replacing", None, None]


def test_symbols(spark):
    rust = "pub fn upsert() {}\nasync fn go() {}\npub(crate) struct Store;\nenum K {}\n  trait G {}\npub const fn no() {}"
    got = spark.createDataFrame([("a.rs", rust), ("b.tsx", "export const x = 1\nfunction f() {}\nclass C {}"), ("c.go", "func (s *S) Run() {}\ntype T struct{}"), ("d.txt", "fn x")], "p string, t string")
    rows = {r[0]: [tuple(x) for x in r[1]] for r in got.select("p", symbols(F.col("p"), F.col("t"))).collect()}
    assert rows["a.rs"] == [("fn", "upsert"), ("fn", "go"), ("struct", "Store"), ("enum", "K"), ("trait", "G")]
    assert rows["b.tsx"] == [("function", "f"), ("class", "C"), ("const", "x")] and rows["c.go"] == [("func", "Run"), ("type", "T")] and rows["d.txt"] == []


@pytest.mark.parametrize(
    "name, text, want",
    [
        ("Cargo.toml", '[package]\nname = "x"\n[dependencies]\nserde = "1"\ntokio={version="1"}\n# no\n[dev-dependencies]\ntempfile = "3"\n[dependencies.redb]\nversion = "2"\n[target.\'cfg(unix)\'.dependencies]\nnix = "1"\n', ["serde", "tokio", "tempfile", "redb", "nix"]),
        ("go.mod", "module x\nrequire (\n\tgithub.com/foo/bar v1\n\t// no\n)\nrequire golang.org/x/sync v0\n", ["github.com/foo/bar", "golang.org/x/sync"]),
        ("package.json", '{"name":"x","scripts":{"build":"y"},"dependencies":{"react":"1"},\n"devDependencies": {\n "vitest": "2"\n}}', ["react", "vitest"]),
        ("pyproject.toml", '[tool.poetry.dependencies]\npython = "3"\nflask = "1"\n[project]\ndependencies = [\n"numpy>=1", "my.pkg_x~=2",\n]\n', ["flask", "numpy", "my.pkg_x"]),
        ("other.txt", "x", []),
    ],
)
def test_manifests(name, text, want):
    assert names_in(name, text) == want


def test_replies():
    good = '```json\n{"decisions":[{"decision":"use redb","rationale":"fast","rejected":["sled"]},{"oops":1},{"decision":" "}]}\n```'
    open_, other = {"choices": [{"message": {"content": good}}]}, {"content": [{"type": "x"}, {"text": '[{"decision":"d"}]'}]}
    assert distill.parse_response("openai", open_) == [distill.Distilled("use redb", "fast", ["sled"])]
    assert distill.parse_response("anthropic", other) == [distill.Distilled("d")]
    assert distill.parse_response("openai", {"choices": [{"message": {"content": '{"decision":"one"}'}}]})[0].decision == "one"
    assert distill.parse_response("anthropic", {"content": [{"text": "[]"}]}) == []
    for bad in ({}, {"choices": []}, {"choices": [{"message": {"content": "garbage"}}]}, {"choices": [{"message": {"content": "3"}}]}):
        with pytest.raises(ValueError):
            distill.parse_response("openai", bad)
    assert "system" in distill.build_request("anthropic", "m", "t") and distill.build_request("openai", "m", "t")["messages"][1]["content"] == "t"
    assert distill.dialect_of("https://api.anthropic.com/") == "anthropic" and distill.dialect_of("http://x", "openai") == "openai"
