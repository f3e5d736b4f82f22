"""Graph reads: neighbourhoods, induced subgraphs, supersession heads, slices and timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracegraph.operators.lineage import checkpointed

MAX_DEPTH = 3


def induced(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of ``ids(id)`` and the edges between them."""
    chosen = ids.select(F.col("id").alias("chosen")).distinct()
    inside = edges.join(chosen, F.col("from") == F.col("chosen"), "left_semi").join(chosen, F.col("to") == F.col("chosen"), "left_semi")
    return nodes.join(chosen, F.col("id") == F.col("chosen"), "left_semi"), inside


def reach(nodes: DataFrame, edges: DataFrame, start: DataFrame, depth: int = 1) -> DataFrame:
    """``start, id, depth``: what each start reaches in ``depth`` undirected steps at most, itself at 0.

    Unknown starts reach nothing.  Each step joins the frontier only.
    """
    known = start.select("id").distinct().join(nodes.select("id"), "id", "left_semi")
    seen = frontier = known.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"))
    both = edges.select(F.col("from").alias("a"), F.col("to").alias("b")).union(edges.select("to", "from"))
    for d in range(1, min(max(depth, 0), MAX_DEPTH) + 1):
        step = frontier.join(both, F.col("id") == F.col("a")).select("start", F.col("b").alias("id")).distinct()
        frontier = step.join(seen, ["start", "id"], "left_anti").withColumn("depth", F.lit(d))
        seen = seen.unionByName(frontier)
    return seen


def neighbors(nodes: DataFrame, edges: DataFrame, node_id: str, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    start = nodes.sparkSession.createDataFrame([(node_id,)], "id string")
    return induced(nodes, edges, reach(nodes, edges, start, depth))


def superseded_by(edges: DataFrame) -> DataFrame:
    """``id, by``: each superseded node's newest superseder."""
    s = edges.where("kind = 'supersedes'")
    return s.groupBy(F.col("to").alias("id")).agg(F.max(F.struct("seq", "from"))["from"].alias("by"))


def supersession_heads(links: DataFrame) -> DataFrame:
    """``id, head``: the end of each chain of ``id, by``; null on or before a cycle.

    Pointer doubling: r rounds resolve chains of 2**r links, so a chain that
    still moves after as many links as there are is a cycle.  Each node is in
    one chain, and a round is one join; rounds end when nothing moves.
    """
    jump = checkpointed(links.select("id", F.col("by").alias("head")))
    most_links = jump.count()
    if not most_links:
        return jump
    reached = 1
    while True:
        nxt = jump.select(F.col("id").alias("via"), F.col("head").alias("to"))
        step = jump.join(nxt, F.col("head") == F.col("via"), "left").select("id", "via", F.coalesce("to", "head").alias("head"))
        if reached >= most_links:
            return step.select("id", F.when(F.col("via").isNull(), F.col("head")).alias("head"))
        if step.where("via IS NOT NULL").isEmpty():
            return jump
        jump = checkpointed(step.select("id", "head"))
        reached *= 2


def newest(nodes: DataFrame, limit: int = 400, kinds: list[str] | None = None, most: int = 5000) -> DataFrame:
    chosen = nodes.where(F.lower("kind").isin(*[k.strip().lower() for k in kinds])) if kinds else nodes
    return chosen.orderBy(F.desc("last_updated_ms"), "id").limit(min(limit, most))


def slice_of(nodes: DataFrame, edges: DataFrame, limit: int = 400, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The newest nodes and the edges between them."""
    return induced(nodes, edges, newest(nodes, limit, kinds))


def timeline(nodes: DataFrame, limit: int = 200, newest_first: bool = False, most: int = 2000) -> DataFrame:
    order = F.desc("first_seen_ms") if newest_first else F.asc("first_seen_ms")
    return nodes.orderBy(order, "id").limit(min(limit, most))


def detail(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.where(F.col("id") == node_id)
