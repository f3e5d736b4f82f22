"""Sessions, repositories and notes to mutation tables of nodes, edges and vectors.

Every mutation has a ``seq`` made from its batch, position and class, so that a
later merge does not depend on partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tracegraph.functions.decisions import CONFIDENCE, EXTRACTOR, decision_text
from tracegraph.functions.manifests import dependencies
from tracegraph.functions.redact import redact
from tracegraph.functions.symbols import symbols
from tracegraph.functions.text import UNIT, basename, content_hash, file_identity, is_low_value, node_id, relative_path, summarize
from tracegraph.operators.embedders import Embedder
from tracegraph.operators.lineage import checkpointed
from tracegraph.operators.merge import EDGE, NODE, PROVENANCE, VECTOR
from tracegraph.operators.temporal import as_of, supersessions

#: Places in a sequence number: batch, then position in a session, then record class.
BATCH, CLASSES = 1 << 40, 16


@dataclass
class Mutations:
    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame


def _seq(batch: int, pos: Column, cls: int) -> Column:
    return (F.lit(batch * BATCH + cls) + pos.cast("bigint") * CLASSES).alias("seq")


def _node(kind: str, identity: Column, label: Column, ts: Column, seq: Column, body=None, summary=None, provenance=None, attrs=None) -> list[Column]:
    empty = F.lit("")
    ts = ts.cast("bigint")
    return [
        node_id(kind, identity).alias("id"), F.lit(kind).alias("kind"), label.alias("label"), (body if body is not None else empty).alias("body"),
        (summary if summary is not None else empty).alias("summary"), (provenance if provenance is not None else F.lit(None)).cast(PROVENANCE).alias("provenance"),
        (attrs if attrs is not None else F.create_map()).cast("map<string,string>").alias("attrs"), ts.alias("first_seen_ms"), ts.alias("last_updated_ms"), seq,
    ]


def _edge(a: Column, b: Column, kind: str, seq: Column) -> list[Column]:
    return [a.alias("from"), b.alias("to"), F.lit(kind).alias("kind"), F.lit(1.0).cast("float").alias("weight"), F.create_map().cast("map<string,string>").alias("attrs"), seq]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _texts(df: DataFrame, node: Column, text: Column, seq: Column) -> DataFrame:
    return df.select(node.alias("id"), text.alias("text"), seq)


def stamp_commits(sessions: DataFrame, turns: DataFrame, commits: DataFrame, root: str, nested: list[str] | None = None) -> DataFrame:
    """Sessions without a commit that ran in the work tree of ``root`` get the commit of their time.

    ``nested`` are the repositories within it, looked up if not given.
    """
    from tracegraph.sources.repository import in_tree, nested_repositories

    mine = in_tree(F.col("repo_root"), root, nested_repositories(root) if nested is None else nested)
    first_turn = turns.groupBy("path").agg(F.min(F.when(F.col("ts_ms").isNotNull(), F.struct("pos", "ts_ms")))["ts_ms"].alias("turn_ts"))
    s = sessions.join(first_turn, "path", "left").withColumn("at", F.coalesce("started_at_ms", "turn_ts"))
    found = as_of(s, commits, "at", "time_ms", "oid", out="stamp")
    return found.withColumn("commit", F.when(F.col("commit").isNull() & mine, F.col("stamp")).otherwise(F.col("commit"))).select(*sessions.columns)


def session_mutations(sessions: DataFrame, turns: DataFrame, now_ms: int, batch: int = 1, candidates: DataFrame | None = None, embedder: Embedder | None = None) -> Mutations:
    """All nodes, edges and vectors of sessions.

    ``sessions`` has ``path, agent, native_session_id, repo_root, connector_version,
    commit, started_at_ms``; ``turns`` has ``path, idx, kind, text, ts_ms,
    touched_files``.  ``candidates`` (path, idx, text, rationale, rejected,
    confidence, extractor) replaces the built-in decision extraction.
    """
    s = sessions.select(
        "path", "agent", "native_session_id", F.col("repo_root").alias("repo"), "connector_version", "commit",
        F.coalesce("started_at_ms", F.lit(now_ms)).alias("started"), F.concat("agent", F.lit(":"), "native_session_id").alias("session"),
    )
    t = turns.select("path", "idx", F.col("kind").alias("turn_kind"), "text", "ts_ms", "touched_files").join(s, "path")
    # Turns and decisions feed several tables each: they are computed once, and later plans stay small.
    chat = checkpointed(t.where(F.col("turn_kind").isin("user", "assistant") & ~is_low_value(F.col("text"))))
    intro = chat.where("turn_kind = 'user'").groupBy("path").agg(F.min(F.struct("idx", F.substring("text", 1, 200).alias("intro")))["intro"].alias("intro"))
    s = checkpointed(s.join(intro, "path", "left").withColumn("intro", F.coalesce("intro", F.lit(""))))

    def provenance(confidence: Column, extractor: Column, span: Column) -> Column:
        return F.struct(
            F.col("agent").alias("source_tool"), F.col("native_session_id"), F.col("path").alias("native_path"), F.col("connector_version"), F.col("commit"),
            span.cast("struct<start:bigint,end:bigint>").alias("span"), F.lit(2).alias("source_priority"), confidence.cast("float").alias("confidence"), extractor.alias("extractor"),
        )

    plain, none = (F.lit(1.0), F.lit(EXTRACTOR)), F.lit(None)
    session_id, repo_id = node_id("session", F.col("session")), node_id("repo", F.col("repo"))
    turn_id = node_id("turn", F.concat("session", F.lit(":"), F.col("idx").cast("string"), F.lit(":"), content_hash(F.col("text"))))
    zero, pos = F.lit(0), F.col("idx") + 1
    now = F.lit(now_ms)

    session_nodes = s.select(*_node("session", F.col("session"), F.concat(F.lit("session "), F.substring("native_session_id", 1, 8)), F.col("started"), _seq(batch, zero, 0), F.col("intro"), summarize(F.col("intro")), provenance(*plain, none)))
    in_repo = s.where("repo IS NOT NULL")
    repo_nodes = in_repo.select(*_node("repo", F.col("repo"), basename(F.col("repo")), now, _seq(batch, zero, 1), attrs=F.create_map(F.lit("path"), F.col("repo"))))
    turn_nodes = chat.select(*_node("turn", F.concat("session", F.lit(":"), F.col("idx").cast("string"), F.lit(":"), content_hash(F.col("text"))), F.substring("text", 1, 48), F.coalesce("ts_ms", "started"), _seq(batch, pos, 2), F.col("text"), summarize(F.col("text")), provenance(*plain, F.struct("idx", "idx"))))

    touched = chat.withColumn("rel", F.explode("touched_files")).withColumn("rel", relative_path(F.col("repo"), F.col("rel")))
    file_of = file_identity(F.col("repo"), F.col("rel"))

    def file_nodes(df: DataFrame, cls: int) -> DataFrame:
        return df.select(*_node("file", file_of, basename(F.col("rel")), now, _seq(batch, pos, cls), attrs=F.create_map(F.lit("path"), F.col("rel"))))

    if candidates is None:
        found = chat.withColumn("decision", decision_text(F.col("text"))).where("decision IS NOT NULL")
        found = found.select("*", F.lit("").alias("rationale"), F.array().cast("array<string>").alias("rejected"), F.lit(CONFIDENCE).alias("confidence"), F.lit(EXTRACTOR).alias("extractor"))
    else:
        c = candidates.select("path", "idx", F.col("text").alias("decision"), "rationale", "rejected", "confidence", "extractor")
        found = c.join(t, ["path", "idx"])
    # Distilled texts are not covered by the redaction of turns; for extracted ones this changes nothing.
    found = found.withColumn("decision", redact(F.col("decision"))).withColumn("rationale", redact(F.col("rationale"))).withColumn("rejected", F.transform("rejected", redact))
    found = checkpointed(found.withColumn("scope", F.coalesce("repo", "session")))
    stated = F.concat("scope", F.lit("::"), F.lower("decision"))
    attrs = F.map_filter(F.create_map(F.lit("scope"), F.col("scope"), F.lit("rejected"), F.when(F.size("rejected") > 0, F.array_join("rejected", "; "))), lambda k, v: v.isNotNull())
    body = F.when(F.col("rationale") == "", F.col("decision")).otherwise(F.concat("decision", F.lit("\n\nRationale: "), "rationale"))
    decision_nodes = found.select(*_node("decision", stated, F.col("decision"), F.col("started"), _seq(batch, pos, 4), body, summarize(F.col("decision")), provenance(F.col("confidence"), F.col("extractor"), none), attrs))
    decision_id = node_id("decision", stated)
    made = found.withColumn("rel", F.explode("touched_files")).withColumn("rel", relative_path(F.col("repo"), F.col("rel")))

    nodes = _union([session_nodes, repo_nodes, turn_nodes, file_nodes(touched, 3), decision_nodes, file_nodes(made, 5)])
    edges = _union([
        in_repo.select(*_edge(session_id, repo_id, "derived_from", _seq(batch, zero, 1))),
        chat.select(*_edge(session_id, turn_id, "contains", _seq(batch, pos, 2))),
        touched.select(*_edge(turn_id, node_id("file", file_of), "touches", _seq(batch, pos, 3))),
        found.select(*_edge(decision_id, session_id, "decided_in", _seq(batch, pos, 4))),
        made.select(*_edge(decision_id, node_id("file", file_of), "produced", _seq(batch, pos, 5))),
    ])
    texts = _union([
        _texts(s, session_id, F.col("intro"), _seq(batch, zero, 0)), _texts(chat, turn_id, F.col("text"), _seq(batch, pos, 2)), _texts(found, decision_id, F.col("decision"), _seq(batch, pos, 4)),
    ])
    return Mutations(nodes, edges, (embedder or Embedder()).vectors(texts, "seq"))


def repository_mutations(files: DataFrame, root: str, now_ms: int, commits: DataFrame | None = None, batch: int = 1, prefix: str = "", embedder: Embedder | None = None) -> Mutations:
    """All nodes, edges and vectors of a source tree ``files(path, content, n_bytes)`` and its history.

    ``prefix`` is the folder of ``root`` within its work tree, cut from changed paths.
    """
    spark = files.sparkSession
    repo = F.lit(root)
    repo_id = node_id("repo", repo)
    head = commits.orderBy(F.desc("time_ms"), "oid").limit(1).select("short").collect() if commits is not None else []
    attrs = F.create_map(F.lit("path"), repo, *([F.lit("commit"), F.lit(head[0]["short"])] if head else []))
    zero, now = F.lit(0), F.lit(now_ms)
    one = spark.range(1)
    nodes = [one.select(*_node("repo", repo, basename(repo), now, _seq(batch, zero, 0), attrs=attrs))]
    deps = dependencies(files).select("name").distinct()
    nodes.append(deps.select(*_node("framework", F.col("name"), F.col("name"), now, _seq(batch, zero, 1))))
    edges = [deps.select(*_edge(repo_id, node_id("framework", F.col("name")), "depends_on", _seq(batch, zero, 1)))]

    known = files.select(F.col("path").alias("rel"), symbols(F.col("path"), F.col("content")).alias("symbols")).where(F.size("symbols") > 0)
    file_of = file_identity(repo, F.col("rel"))
    file_id = node_id("file", file_of)
    path_attr = F.create_map(F.lit("path"), F.col("rel"))
    nodes.append(known.select(*_node("file", file_of, basename(F.col("rel")), now, _seq(batch, zero, 2), attrs=path_attr)))
    edges.append(known.select(*_edge(repo_id, file_id, "contains", _seq(batch, zero, 2))))
    each = known.select("rel", F.explode("symbols").alias("sym"))
    symbol_of = F.concat(file_of, F.lit(UNIT), F.col("sym.kind"), F.lit(UNIT), F.col("sym.name"))
    symbol_id = node_id("symbol", symbol_of)
    nodes.append(each.select(*_node("symbol", symbol_of, F.col("sym.name"), now, _seq(batch, zero, 3), attrs=F.create_map(F.lit("kind"), F.col("sym.kind"), F.lit("file"), F.col("rel")))))
    edges.append(each.select(*_edge(file_id, symbol_id, "defines", _seq(batch, zero, 3))))
    described = F.concat("rel", F.lit(" "), F.array_join(F.transform("symbols", lambda x: x["name"]), " "))
    texts = [_texts(known, file_id, described, _seq(batch, zero, 2)), _texts(each, symbol_id, F.col("sym.name"), _seq(batch, zero, 3))]

    if commits is not None:
        prov = F.struct(
            F.lit("git").alias("source_tool"), F.lit(None).cast("string").alias("native_session_id"), F.lit(None).cast("string").alias("native_path"), F.lit(None).cast("string").alias("connector_version"),
            F.col("oid").alias("commit"), F.lit(None).cast("struct<start:bigint,end:bigint>").alias("span"), F.lit(3).alias("source_priority"), F.lit(1.0).cast("float").alias("confidence"), F.lit("repo-git-v1").alias("extractor"),
        )
        commit_attrs = F.create_map(F.lit("oid"), F.col("oid"), F.lit("author"), redact(F.col("author")))
        nodes.append(commits.select(*_node("commit", F.col("oid"), F.col("short"), F.col("time_ms"), _seq(batch, zero, 4), redact(F.col("summary")), provenance=prov, attrs=commit_attrs)))
        edges.append(commits.select(*_edge(repo_id, node_id("commit", F.col("oid")), "contains", _seq(batch, zero, 4))))
        changed = commits.select("oid", F.explode("changed").alias("rel"))
        if prefix:
            changed = changed.withColumn("rel", F.when(F.startswith("rel", F.lit(prefix)), F.substr("rel", F.lit(len(prefix) + 1))).otherwise(F.col("rel")))
        changed = changed.join(files.select(F.col("path").alias("rel")), "rel", "left_semi")
        nodes.append(changed.select(*_node("file", file_of, basename(F.col("rel")), now, _seq(batch, zero, 5), attrs=path_attr)))
        edges.append(changed.select(*_edge(file_id, node_id("commit", F.col("oid")), "changed_by", _seq(batch, zero, 5))))
    return Mutations(_union(nodes), _union(edges), (embedder or Embedder()).vectors(_union(texts), "seq"))


def note_mutations(spark: SparkSession, text: str, topic: str | None, now_ms: int, batch: int = 1, embedder: Embedder | None = None) -> Mutations:
    """A manual note as a decision; noting it again changes nothing."""
    if not text.strip():
        raise ValueError("a note needs text")
    n = spark.createDataFrame([(text, topic or "note")], "text string, scope string").withColumn("text", redact(F.col("text")))
    identity = F.concat(F.lit("manual-note::"), F.col("scope"), F.lit("::"), content_hash(F.col("text")))
    prov = F.struct(
        F.lit("mcp").alias("source_tool"), F.lit(None).cast("string").alias("native_session_id"), F.lit(None).cast("string").alias("native_path"), F.lit(None).cast("string").alias("connector_version"), F.lit(None).cast("string").alias("commit"),
        F.lit(None).cast("struct<start:bigint,end:bigint>").alias("span"), F.lit(3).alias("source_priority"), F.lit(1.0).cast("float").alias("confidence"), F.lit("manual").alias("extractor"),
    )
    seq = _seq(batch, F.lit(0), 0)
    nodes = n.select(*_node("decision", identity, F.substring("text", 1, 80), F.lit(now_ms), seq, F.col("text"), summarize(F.col("text")), prov, F.create_map(F.lit("scope"), F.col("scope"))))
    texts = _texts(n, node_id("decision", identity), F.col("text"), seq)
    return Mutations(nodes, spark.createDataFrame([], EDGE), (embedder or Embedder()).vectors(texts, "seq"))


def supersession_mutations(nodes: DataFrame, batch: int) -> Mutations:
    """An edge from each decision to the one it names as replaced."""
    d = nodes.where("kind = 'decision'").select("id", F.col("attrs")["scope"].alias("scope"), "label", F.col("first_seen_ms").alias("ts"))
    spark = nodes.sparkSession
    edges = supersessions(d).select(*_edge(F.col("from"), F.col("to"), "supersedes", _seq(batch, F.lit(0), 6)))
    return Mutations(spark.createDataFrame([], NODE), edges, spark.createDataFrame([], VECTOR))
