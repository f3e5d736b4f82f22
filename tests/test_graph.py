"""Merges, graph reads, recall, connectors, repositories, the store and its streams."""

import json
import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tracegraph.operators import graph as G, merge as M, recall as R, temporal as T, vectors as V
from tracegraph.plans import api
from tracegraph.plans.ingest import note_mutations, session_mutations
from tracegraph.operators.embedders import Embedder
from tracegraph.plans.store import EmbedderMismatch, Store
from tracegraph.sources import repository, transcripts
from tracegraph.streaming.ingest import ingest_stream

NOW = 1_700_000_000_000
DEMO = [
    {"type": "user", "timestamp": "2024-01-01T00:00:00Z", "cwd": "/work/demo", "version": "2.1", "message": {"content": "What storage engine should we use for the durable graph?"}},
    {"type": "assistant", "message": {"content": [{"type": "text", "text": "Let's use redb for the durable store instead of sled."}, {"type": "tool_use", "input": {"file_path": "/work/demo/src/store.rs", "edits": [{"path": "/work/demo/src/b.rs"}]}}]}},
    {"type": "queue-operation"},
    {"type": "user", "message": {"content": "Good. For the canvas renderer, going with Cytoscape.js."}},
    {"type": "summary", "summary": "picked redb"},
]


@pytest.fixture
def demo(tmp_path):
    path = tmp_path / "sessions"
    path.mkdir()
    lines = [json.dumps(x) for x in DEMO] + ['{"type": "user", "torn']
    (path / "demo.jsonl").write_text("\n".join(lines) + "\n")
    return str(path)


def test_first_dialect(spark, demo):
    sessions, turns = transcripts.read_sessions(spark, "claude_code", demo)
    s = sessions.collect()
    assert len(s) == 1 and (s[0]["native_session_id"], s[0]["repo_root"], s[0]["connector_version"], s[0]["n_turns"], s[0]["started_at_ms"]) == ("demo", "/work/demo", "2.1", 5, 1704067200000)
    t = turns.orderBy("idx").collect()
    assert [r["kind"] for r in t] == ["user", "assistant", "unknown", "user", "summary"]
    assert t[1]["touched_files"] == ["/work/demo/src/store.rs", "/work/demo/src/b.rs"] and t[4]["text"] == "picked redb"
    assert transcripts.doctor(spark, "claude_code", demo)["broken"] == 1
    with pytest.raises(FileNotFoundError):
        transcripts.resolve(transcripts.CONNECTORS["claude_code"], demo + "/missing")


def test_second_dialect(spark, tmp_path):
    uid = "0199a213-81a0-7000-8000-0123456789ab"
    secret = "gh" + "p_" + "a" * 30
    lines = [
        {"timestamp": "2024-01-01T00:00:00Z", "type": "session_meta", "payload": {"cwd": "/w", "cli_version": "9", "git": {"commit": "abcdef1234"}}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "hi"}, {"type": "image", "text": "no"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": f"token {secret}"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "edit", "arguments": json.dumps({"input": {"path": "src/store.rs"}})}},
        {"type": "response_item", "payload": {"type": "function_call_output"}},
        {"type": "whatever"},
    ]
    path = tmp_path / f"rollout-2024-01-01T00-00-00-{uid}.jsonl"
    path.write_text("\n".join(map(json.dumps, lines)) + "\n{torn")
    sessions, turns = transcripts.read_sessions(spark, "codex", str(path))
    s = sessions.first()
    assert (s["native_session_id"], s["repo_root"], s["connector_version"], s["commit"]) == (uid, "/w", "9", "abcdef1234")
    t = turns.orderBy("idx").collect()
    assert [r["kind"] for r in t] == ["unknown", "user", "assistant", "assistant", "unknown", "unknown"]
    assert t[1]["text"] == "hi" and secret not in t[2]["text"] and t[3]["text"] == "[tool] edit" and t[3]["touched_files"] == ["src/store.rs"]


def test_index_ask_and_store(spark, demo, tmp_path):
    repo = tmp_path / "repo"
    (repo / "src").mkdir(parents=True)
    (repo / "target").mkdir()
    (repo / "src/lib.rs").write_text("pub fn upsert() {}\npub struct DurableStore;\n")
    (repo / "target/skip.rs").write_text("fn skipped() {}")
    (repo / "Cargo.toml").write_text('[dependencies]\nserde = "1"\n')
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@x", "-C", str(repo), *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "first")
    store_dir = str(tmp_path / "store")
    got = api.index(spark, store_dir, NOW, sessions=demo, repo=str(repo))
    # Session side: session, repo, three turns, two files, two decisions; tree side: repo, framework, file, two symbols, commit, and the changed manifest and skipped-folder file are no scanned ones.
    store = Store(spark, store_dir)
    g = store.graph()
    kinds = {r["kind"]: r["count"] for r in g.nodes.groupBy("kind").count().collect()}
    assert kinds == {"session": 1, "repo": 2, "turn": 3, "decision": 2, "file": 4, "framework": 1, "symbol": 2, "commit": 1}
    assert got["nodes"] == sum(kinds.values()) and store.batches() == []
    hits = api.ask(spark, store_dir, "what storage engine did we choose", NOW).collect()
    assert any("redb" in h["label"] for h in hits) and hits[0]["why"] == "semantic"
    assert Store(spark, store_dir).counts()["nodes"] == got["nodes"]
    with pytest.raises(EmbedderMismatch):
        Store(spark, store_dir, Embedder("static:x", 50))
    n = api.index(spark, store_dir, NOW, sessions=demo)["nodes"]
    assert n == got["nodes"]
    nodes, edges = api.neighbors(store, g.nodes.where("kind = 'session'").first()["id"], 1)
    assert nodes.count() == 7 and edges.where("kind = 'contains'").count() == 3


def test_notes_survive_and_torn_batches_do_not(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.note("We decided to keep it simple.", "style", 5) == 2
    store.note("We decided to keep it simple.", "style", 6)
    batch = store.next_batch()
    note_mutations(spark, "torn note", None, 7, batch).nodes.write.parquet(f"{store.path}/wal/batch={batch}/nodes")
    again = Store(spark, store.path)
    assert again.graph().nodes.count() == 1
    assert again.checkpoint() == 1 and Store(spark, store.path).graph().nodes.first()["provenance"]["extractor"] == "manual"
    with pytest.raises(ValueError):
        store.note("  ", None, 1)


def test_supersession_redirects(spark):
    turns = lambda rows: spark.createDataFrame(rows, "path string, idx int, kind string, text string, ts_ms long, touched_files array<string>")
    t = turns([("a", 0, "assistant", "Let's use sled for the durable store.", None, []), ("b", 0, "assistant", "Switch to redb for the durable store instead of sled.", None, []), ("b", 1, "user", "what about the durable store", None, [])])
    s = spark.createDataFrame([("a", "x", "a", "/r", None, None, 1000), ("b", "x", "b", "/r", None, None, 2000)], "path string, agent string, native_session_id string, repo_root string, connector_version string, commit string, started_at_ms long")
    m = session_mutations(s, t, NOW)
    nodes = M.merge_nodes(m.nodes)
    d = nodes.where("kind = 'decision'").select("id", F.col("attrs")["scope"].alias("scope"), "label", F.col("first_seen_ms").alias("ts"))
    pairs = T.supersessions(d).collect()
    assert len(pairs) == 1
    extra = spark.createDataFrame([(pairs[0]["from"], pairs[0]["to"], "supersedes", 1.0, {}, 99)], M.EDGE)
    g = R.Graph(nodes, M.with_endpoints(M.merge_edges(m.edges.unionByName(extra)), nodes), M.merge_vectors(m.vectors))
    hits = R.search(g, "sled durable store", 10, NOW).collect()
    assert any(h["why"] == "supersedes" and "redb" in h["label"] for h in hits) and not any(h["id"] == pairs[0]["to"] for h in hits)
    bare = R.Graph(g.nodes, g.edges, g.vectors.limit(0))
    found, degraded = R.recall(bare, "sled durable", 3, NOW)
    assert degraded and {r["why"] for r in found.collect()} <= {"lexical", "supersedes"}
    assert R.recall(g, "zzzqqq", 3, NOW)[0].count() == 0


def test_heads(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("w", "x")], "id string, by string")
    assert {r["id"]: r["head"] for r in G.supersession_heads(links).collect()} == {"a": "c", "b": "c", "x": None, "y": None, "w": None}
    assert G.supersession_heads(links.limit(0)).count() == 0


def test_as_of(spark):
    c = spark.createDataFrame([(1000, "a"), (2000, "b"), (3000, "c")], "t long, oid string")
    s = spark.createDataFrame([(1, 2500), (2, 3000), (3, 5000), (4, 500), (5, None), (1, 2500)], "id int, ts long")
    got = sorted((r["id"], r["as_of"]) for r in T.as_of(s, c, "ts", "t", "oid").collect())
    assert got == [(1, "b"), (1, "b"), (2, "c"), (3, "c"), (4, "a"), (5, "c")]
    assert {r["as_of"] for r in T.as_of(s, c.limit(0), "ts", "t", "oid").collect()} == {None}


def test_approximate_search(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.standard_normal((800, 64))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>").cache()
    q = [(i, (v[i] + 0.01 * rng.standard_normal(64)).tolist()) for i in range(0, 800, 40)]
    exact = V.top_k_batch(df, spark.createDataFrame(q, "query long, vec array<double>"), 1).collect()
    assert all(r["query"] == r["id"] for r in exact) and len(exact) == 20
    assert sum(V.approximate_top_k(df, x, 1).first()["id"] == i for i, x in q[:5]) == 5


def test_word_vectors(spark, tmp_path):
    path = tmp_path / "w.txt"
    path.write_text("3 1\ncar 1 0\nAutomobile 1 0\nbanana 0 1\nragged 1 2 3\nbad 1 x\ncar 0.5 0\n")
    w = repository.word_vectors(spark, str(path))
    assert {r["token"]: r["vec"] for r in w.collect()} == {"car": [0.5, 0.0], "automobile": [1.0, 0.0], "banana": [0.0, 1.0]}
    e = V.static_embedding(spark.createDataFrame([(1, "Car automobile"), (2, "banana!"), (3, "unknown")], "id int, t string"), w, "id", "t")
    assert {r["id"]: r["vec"] for r in e.collect()} == {1: [1.0, 0.0], 2: [0.0, 1.0]}


def test_same_tree(tmp_path):
    root = tmp_path / "r"
    (root / "a/b").mkdir(parents=True)
    (root / "c/.git").mkdir(parents=True)
    assert repository.same_tree(str(root), str(root)) and repository.same_tree(str(root / "a/b"), str(root))
    assert not repository.same_tree(str(root / "c"), str(root)) and not repository.same_tree(str(tmp_path), str(root))


def test_stream_ingests_once(spark, demo, tmp_path):
    store = Store(spark, str(tmp_path / "st"))
    for _ in range(2):
        ingest_stream(spark, store, "claude_code", demo, str(tmp_path / "cp"), NOW).awaitTermination(120)
    assert store.graph().nodes.where("kind = 'turn'").count() == 3 and len(store.batches()) == 1
    assert os.path.exists(tmp_path / "cp")
