"""Keyed merges of nodes, edges and vectors: one aggregation each, no per-key lists but of small maps.

``seq`` orders arrivals.  It is any orderable column; ties are broken by the
values themselves, so a merge gives one result whatever the partitioning.
Because a result depends only on minima, maxima and arg-maxima, a merged
snapshot can be merged with a later delta.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PROVENANCE = "struct<source_tool:string,native_session_id:string,native_path:string,connector_version:string,commit:string,span:struct<start:bigint,end:bigint>,source_priority:int,confidence:float,extractor:string>"
NODE = f"id string, kind string, label string, body string, summary string, provenance {PROVENANCE}, attrs map<string,string>, first_seen_ms bigint, last_updated_ms bigint, seq bigint"
EDGE = "`from` string, `to` string, kind string, weight float, attrs map<string,string>, seq bigint"
VECTOR = "id string, vec array<double>, seq bigint"


def _latest(value: str, where: Column | None = None) -> Column:
    v = F.col(value)
    keep = v.isNotNull() if where is None else where
    return F.max(F.when(keep, F.struct(F.col("seq"), v.alias("v"))))["v"].alias(value)


def merge_nodes(records: DataFrame) -> DataFrame:
    """Per id: earliest and latest times; the latest label, kind, and non-empty body and summary; per attribute the
    latest value; the provenance of highest priority, the earliest of equal ones."""
    rank = F.struct(F.col("provenance.source_priority").alias("p"), (-F.col("seq")).alias("s"), F.col("provenance").alias("v"))
    main = records.groupBy("id").agg(
        _latest("kind"), _latest("label"), F.coalesce(_latest("body", F.col("body") != ""), F.lit("")).alias("body"), F.coalesce(_latest("summary", F.col("summary") != ""), F.lit("")).alias("summary"),
        F.max(F.when(F.col("provenance").isNotNull(), rank))["v"].alias("provenance"),
        F.min("first_seen_ms").alias("first_seen_ms"), F.max("last_updated_ms").alias("last_updated_ms"), F.max("seq").alias("seq"),
    )
    # Attributes are merged by key first, so an id with many records never holds more than its distinct keys.
    each = records.select("id", "seq", F.explode("attrs").alias("k", "v")).groupBy("id", "k").agg(F.max(F.struct("seq", "v"))["v"].alias("v"))
    attrs = each.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("attrs"))
    merged = main.join(attrs, "id", "left").withColumn("attrs", F.coalesce("attrs", F.expr("cast(map() AS map<string,string>)")))
    return merged.select("id", "kind", "label", "body", "summary", "provenance", "attrs", "first_seen_ms", "last_updated_ms", "seq")


def merge_edges(records: DataFrame) -> DataFrame:
    """The first of each (from, to, kind), whole."""
    own = F.array_sort(F.map_entries("attrs")) if "attrs" in records.columns else F.lit(None).cast("array<struct<key:string,value:string>>")
    e = records.groupBy("from", "to", "kind").agg(F.min(F.struct("seq", "weight", own.alias("attrs"))).alias("x"))
    attrs = F.coalesce(F.map_from_entries("x.attrs"), F.expr("cast(map() AS map<string,string>)"))
    return e.select("from", "to", "kind", F.col("x.weight").alias("weight"), attrs.alias("attrs"), F.col("x.seq").alias("seq"))


def merge_vectors(records: DataFrame) -> DataFrame:
    """The latest vector of each id."""
    return records.groupBy("id").agg(F.max(F.struct("seq", "vec")).alias("x")).select("id", F.col("x.vec").alias("vec"), F.col("x.seq").alias("seq"))


def with_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are nodes."""
    ids = nodes.select(F.col("id").alias("node"))
    return edges.join(ids, F.col("from") == F.col("node"), "left_semi").join(ids, F.col("to") == F.col("node"), "left_semi")


def degrees(edges: DataFrame) -> DataFrame:
    """``id, degree``: incident edges, a loop counted once."""
    return _ends(edges).groupBy("id").agg(F.count("*").alias("degree"))


def degrees_of(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``degrees`` of the nodes ``ids(id)`` only: before anything is counted, the other ends are dropped."""
    return _ends(edges).join(ids.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("degree"))


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array_distinct(F.array("from", "to"))).alias("id"))
