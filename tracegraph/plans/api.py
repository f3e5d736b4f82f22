"""Commands over a store: index, ask, and the reads that a viewer needs; all return tables or plain values."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracegraph.functions.text import summarize
from tracegraph.operators import graph as G
from tracegraph.operators.embedders import Embedder, choose
from tracegraph.operators.recall import recall
from tracegraph.plans.ingest import repository_mutations, session_mutations, stamp_commits
from tracegraph.plans.store import Store
from tracegraph.sources import repository, transcripts


def index(spark: SparkSession, store_dir: str, now_ms: int, sessions: str | None = None, repo: str | None = None, source: str = "claude_code", dry_run: bool = False, backend: str = "hash", model: str | None = None) -> dict[str, int]:
    """Sessions and a source tree into the store, supersessions, and a checkpoint; a dry run only counts.

    ``backend`` and ``model`` choose the embedder, as for ``ask``.
    """
    found, turns = transcripts.read_sessions(spark, source, sessions)
    out = {"sessions": found.count(), "turns": turns.count()}
    if dry_run:
        return out
    store = Store(spark, store_dir, choose(spark, backend, model))
    history = repository.commits(spark, repo, repository.TIMELINE_COMMITS, with_changes=False) if repo else None
    if history is not None and not history.isEmpty():
        found = stamp_commits(found, turns, history, repository.work_tree(repo))
    batch = store.next_batch()
    store.append(session_mutations(found, turns, now_ms, batch, embedder=store.embedder), batch)
    if repo:
        root = os.path.realpath(repo)
        top = repository.work_tree(repo)
        prefix = os.path.relpath(root, top) + "/" if top and os.path.realpath(top) != root else ""
        commits = repository.commits(spark, repo, repository.GRAPH_COMMITS)
        batch = store.next_batch()
        store.append(repository_mutations(repository.scan_files(spark, repo), root, now_ms, None if commits.isEmpty() else commits, batch, prefix, store.embedder), batch)
    store.detect_supersessions()
    store.checkpoint()
    return out | store.counts()


def ask(spark: SparkSession, store_dir: str, query: str, now_ms: int, k: int = 8, as_json: bool = False, backend: str = "hash", model: str | None = None) -> DataFrame | list[str]:
    hits, _ = recall(Store(spark, store_dir, choose(spark, backend, model)).graph(), query, k, now_ms)
    return hits.toJSON().collect() if as_json else hits


def bulk(nodes: DataFrame, body: bool = False) -> DataFrame:
    """Nodes as lists show them, without bodies unless asked for."""
    filled = lambda c: F.when(c != "", c)
    short: Column = F.coalesce(filled(F.col("summary")), filled(summarize(F.col("body"))), F.col("label"))
    return nodes.select("id", "kind", "label", short.alias("summary"), *["body"] * body, "first_seen_ms", "last_updated_ms", "attrs", "provenance")


def graph_slice(store: Store, limit: int = 400, kinds: str | None = None) -> tuple[DataFrame, DataFrame]:
    g = store.graph()
    nodes, edges = G.slice_of(g.nodes, g.edges, limit, kinds.split(",") if kinds else None)
    return bulk(nodes), edges


def neighbors(store: Store, node_id: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    g = store.graph()
    nodes, edges = G.neighbors(g.nodes, g.edges, node_id, depth)
    return bulk(nodes), edges


def node(store: Store, node_id: str) -> DataFrame:
    return bulk(G.detail(store.graph().nodes, node_id), body=True)


def timeline(store: Store, limit: int = 200) -> DataFrame:
    """Oldest first, as the viewer wants it."""
    return bulk(G.timeline(store.graph().nodes, limit))


def recent(store: Store, limit: int = 20) -> DataFrame:
    """Newest first, as an agent wants it."""
    return bulk(G.timeline(store.graph().nodes, limit, newest_first=True, most=200))


__all__ = ["Embedder", "Store", "ask", "bulk", "graph_slice", "index", "neighbors", "node", "recent", "timeline"]
