"""Ranked recall over a memory graph: vectors, one step of the graph, labels, and BM25 where those find nothing."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from tracegraph.functions.text import SEMANTIC_KINDS, centrality, display_kind, evidence_text, kind_weight, let, recency, tokens
from tracegraph.operators.embedders import Embedder, query_tokens
from tracegraph.operators.graph import superseded_by, supersession_heads
from tracegraph.operators.lineage import checkpointed
from tracegraph.operators.merge import degrees_of
from tracegraph.operators.vectors import top_k

SEEDS = 3
FLOOR = 0.01
K1, B = 1.2, 0.75
#: Stages by precedence on equal scores.
STAGES = ("semantic", "graph", "lexical")


@dataclass
class Graph:
    """Merged tables of a store, the embedder of its vectors, and where a snapshot holds them, supersession heads."""

    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame
    embedder: Embedder = field(default_factory=Embedder)
    heads: DataFrame | None = None


def bump(candidates: DataFrame) -> DataFrame:
    """Per id the highest score; of equal ones the earliest stage. ``candidates``: ``id, score, stage``."""
    best = candidates.groupBy("id").agg(F.max(F.struct("score", (-F.col("stage")).alias("s"))).alias("x"))
    why = F.array(*map(F.lit, STAGES))
    return best.select("id", F.col("x.score").alias("score"), F.element_at(why, (1 - F.col("x.s")).cast("int")).alias("why"))


def bm25(docs: DataFrame, terms: list[str]) -> DataFrame:
    """``id, score`` over ``docs(id, text)``: only documents with a term.

    One pass keeps each document's length and the counts of the few query
    terms; the corpus statistics are one row.
    """
    terms = sorted(set(terms))
    each = let(tokens(F.col("text")), lambda t: F.struct(F.size(t).alias("len"), *[F.size(F.filter(t, _is(w))).alias(f"tf{i}") for i, w in enumerate(terms)]))
    counted = docs.select("id", each.alias("c")).select("id", "c.*")
    stats = counted.agg(F.count("*").alias("n"), F.greatest(F.avg("len"), F.lit(1.0)).alias("avgdl"), *[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))]).first()
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = math.log(1 + (stats["n"] - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5))
        tf = F.col(f"tf{i}")
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("len") / F.lit(float(stats["avgdl"] or 1.0))))
    return counted.select("id", score.alias("score")).where("score > 0")


def _is(word: str):
    return lambda t: t == F.lit(word)


def weighted(base: Column) -> Column:
    return base * kind_weight(F.col("kind")) + centrality(F.col("kind"), F.col("degree"))


def hybrid(g: Graph, query: str, k: int, now_ms: int) -> DataFrame:
    """``id, score, why`` of the vector, graph and label stages.

    Only candidates meet nodes and degrees: the pool and the neighbours of three
    seeds are small sides.  Labels match kinds whose degree doesn't count.
    """
    nodes = g.nodes.select("id", "kind", "label", recency(now_ms, F.col("last_updated_ms")).alias("recency"))
    pool = top_k(g.vectors, g.embedder.query_vector(query), max(40 * k, 256)).withColumnRenamed("score", "cos").where(F.col("cos") > FLOOR)
    # Written once: degrees, seeds and scores all start from these few rows.
    pool = checkpointed(pool.join(nodes, "id").where(F.col("kind").isin(*SEMANTIC_KINDS)))
    semantic = checkpointed(pool.join(degrees_of(g.edges, pool), "id", "left").select("id", weighted(0.7 * F.col("cos") + 0.15 * F.col("recency")).alias("score"), F.lit(0).alias("stage")))
    seeds = semantic.orderBy(F.desc("score"), "id").limit(SEEDS).select(F.col("id").alias("seed"), F.col("score").alias("seed_score"))
    both = g.edges.select(F.col("from").alias("seed"), F.col("to").alias("id")).union(g.edges.select("to", "from"))
    near = checkpointed(both.join(seeds, "seed").where("id <> seed").select("id", "seed", "seed_score").distinct())
    graph = near.join(nodes, "id").join(degrees_of(g.edges, near), "id", "left").select("id", weighted(0.35 * F.col("seed_score") + 0.15 * F.col("recency")).alias("score"), F.lit(1).alias("stage"))
    words = query_tokens(query)
    labelled, nodes = F.lit(False), nodes.withColumn("degree", F.lit(0))
    for w in words:
        labelled = labelled | F.contains(F.lower("label"), F.lit(w))
    lexical = nodes.where(~F.col("kind").isin(*SEMANTIC_KINDS) & labelled).select("id", weighted(0.6 + 0.1 * F.col("recency")).alias("score"), F.lit(2).alias("stage"))
    return bump(semantic.unionByName(graph).unionByName(lexical))


def finalize(g: Graph, scored: DataFrame, k: int) -> DataFrame:
    """Hits led on to what superseded them, the best k with their evidence."""
    heads = (supersession_heads(superseded_by(g.edges)) if g.heads is None else g.heads).withColumnRenamed("id", "old").where("head IS NOT NULL")
    led = scored.join(heads, F.col("id") == F.col("old"), "left").select(F.coalesce("head", "id").alias("id"), "score", F.when(F.col("head").isNotNull(), F.lit("supersedes")).otherwise(F.col("why")).alias("why"))
    best = led.groupBy("id").agg(F.max(F.struct("score", (F.col("why") != "supersedes").alias("own"), "why")).alias("x")).select("id", F.col("x.score").alias("score"), F.col("x.why").alias("why"))
    # Evidence is looked up for the k winners only.
    top = best.join(g.nodes.select("id"), "id", "left_semi").orderBy(F.desc("score"), "id").limit(k)
    found = top.join(g.nodes, "id")
    return found.select("id", "score", display_kind(F.col("kind")).alias("kind"), "label", evidence_text(F.col("summary"), F.col("body"), F.col("label")).alias("snippet"), "why", "provenance").orderBy(F.desc("score"), "id")


def recall(g: Graph, query: str, k: int = 12, now_ms: int = 0) -> tuple[DataFrame, bool]:
    """The k best hits, and whether the answer is degraded (there were no vectors)."""
    degraded = g.vectors.isEmpty()
    # Written once: whether there is any hit decides the stage, and the hits are read again.
    scored = None if degraded else checkpointed(hybrid(g, query, k, now_ms))
    if scored is None or scored.isEmpty():
        terms = query_tokens(query)
        docs = g.nodes.select("id", F.concat_ws(" ", "label", "body").alias("text"))
        plain = bm25(docs, terms) if terms else docs.select("id", F.lit(0.0).alias("score")).limit(0)
        plain = plain.join(g.nodes.select("id", "kind"), "id")
        scored = plain.join(degrees_of(g.edges, plain.where(F.col("kind").isin("decision", "implementation"))), "id", "left").select("id", weighted(F.col("score")).alias("score"), F.lit("lexical").alias("why"))
    return finalize(g, scored, k), degraded


def search(g: Graph, query: str, k: int = 12, now_ms: int = 0) -> DataFrame:
    return recall(g, query, min(k, 100), now_ms)[0]


def memory_search(g: Graph, query: str, k: int = 8, now_ms: int = 0) -> DataFrame:
    return recall(g, query, min(k, 50), now_ms)[0]


def recall_decisions(g: Graph, topic: str, now_ms: int = 0) -> DataFrame:
    """Decisions among the 20 best hits, with where they were taken."""
    hits = recall(g, topic, 20, now_ms)[0].where("kind = 'Decision'")
    return hits.select("id", "label", "snippet", "score", F.col("provenance.native_session_id").alias("session"), F.col("provenance.commit").alias("commit"), F.col("provenance.confidence").alias("confidence"))


def related(g: Graph, anchor: str, now_ms: int = 0) -> tuple[DataFrame, DataFrame]:
    """The best hit's neighbourhood of one step; empty without a hit."""
    from tracegraph.operators.graph import induced, reach

    best = recall(g, anchor, 1, now_ms)[0].select("id")
    return induced(g.nodes, g.edges, reach(g.nodes, g.edges, best, 1))
