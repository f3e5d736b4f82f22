"""Registered queries over the driver's tables, one for each operator or more, each beside its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracegraph.functions import text as X
from tracegraph.functions.decisions import decision_text, superseded_subject
from tracegraph.functions.manifests import dependencies
from tracegraph.functions.redact import contains_secret, redact
from tracegraph.functions.symbols import symbols
from tracegraph.operators import graph as G, merge as M, recall as R, temporal as T, vectors as V
from tracegraph.operators.lineage import checkpointed, shared_folder, spread
from tracegraph.plans.api import bulk
from tracegraph.plans.ingest import repository_mutations, session_mutations
from tracegraph.plans.store import Store
from tracegraph.sources.transcripts import CONNECTORS, parse_lines, sessions_of
from tracegraph.streaming.ingest import activity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
NOW = 1_710_000_000_000


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms(name: str):
    """Epoch milliseconds of a timestamp with or without a zone."""
    return F.unix_millis(F.col(name).cast("timestamp"))


# Scalar expressions


@query("SELECT doc_id, substr(sha256(concat('turn', chr(0), CAST(doc_id AS VARCHAR))), 1, 32) AS id FROM documents")
def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.node_id("turn", F.col("doc_id").cast("string")).alias("id"))


@query("""
    WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
    SELECT doc_id, coalesce(nullif(regexp_extract(substr(t, 1, 180), '^[^.!?]*[.!?]'), ''), CASE WHEN length(t) > 180 THEN substr(t, 1, 180) || '…' ELSE t END) AS summary FROM t""")
def summarize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.summarize(F.col("text")).alias("summary"))


@query("SELECT doc_id, CASE WHEN length(text) > 240 THEN substr(text, 1, 240) || '…' ELSE text END AS snippet FROM documents")
def snippet_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.snippet(F.col("text")).alias("snippet"))


@query("""
    SELECT token, CAST(count(*) AS BIGINT) AS n FROM (
        SELECT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: strlen(t) > 1)) AS token FROM documents) GROUP BY token""")
def tokenize_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = spread(table(spark, sf_dir, "documents").select("text")).select(F.explode(X.tokens(F.col("text"))).alias("token"))
    return t.groupBy("token").agg(F.count("*").alias("n"))


@query("""
    SELECT event_id, round(power(0.5, greatest(1710000000000 - epoch_ms(ts), 0) / 86400000.0 / 30), 6) AS recency FROM events""")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.round(X.recency(NOW, ms("ts")), 6).alias("recency"))


def _secret_text():
    sha = F.sha2(F.col("o_orderkey").cast("string"), 256)
    return F.concat(F.lit("line one sk-"), sha, F.lit("\nAPI_KEY = "), F.substring(sha, 1, 12), F.lit(" end"))


@query("""
    WITH s AS (SELECT o_orderkey, sha256(CAST(o_orderkey AS VARCHAR)) AS h FROM orders)
    SELECT o_orderkey, 'line one <redacted:openai_key:' || substr(sha256('sk-' || h), 1, 8) || '>' || chr(10)
        || '<redacted:env_assignment:' || substr(sha256('API_KEY = ' || substr(h, 1, 12)), 1, 8) || '> end' AS redacted FROM s""")
def redact_synth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders").select("o_orderkey")).select("o_orderkey", redact(_secret_text()).alias("redacted"))


@query("SELECT o_orderkey, regexp_matches('id ' || CASE WHEN o_orderkey % 3 = 0 THEN 'AKIA' ELSE 'AX' END || upper(substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 16)), 'AKIA[0-9A-Z]{16}') AS secret FROM orders")
def secret_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("o_orderkey") % 3 == 0, F.lit("AKIA")).otherwise("AX")
    text = F.concat(F.lit("id "), head, F.upper(F.substring(F.sha2(F.col("o_orderkey").cast("string"), 256), 1, 16)))
    return table(spark, sf_dir, "orders").select("o_orderkey", contains_secret(text).alias("secret"))


@query("""
    SELECT conv_id, turn, turn % 4 <> 0 OR trim(text) = '' AS low FROM conversations""")
def low_value_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("turn") % 4 == 1, F.concat(F.lit("<command-name>"), "text")).when(F.col("turn") % 4 == 2, F.concat(F.lit("  Caveat: "), "text")).when(F.col("turn") % 4 == 3, F.lit("  \n ")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", X.is_low_value(text).alias("low"))


@query("""
    SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE epoch_ms(ts) - CASE WHEN event_id % 3 = 1 THEN 7200000 ELSE 0 END END AS ms
    FROM (SELECT event_id, date_trunc('millisecond', ts) AS ts FROM events)""")
def rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(at, F.lit("Z"))).when(F.col("event_id") % 3 == 1, F.concat(at, F.lit("+02:00"))).otherwise(at)
    return table(spark, sf_dir, "events").select("event_id", X.rfc3339_ms(text).alias("ms"))


@query("""
    SELECT page_id, regexp_replace(url, '^https?://', '') AS rel, list_last(regexp_split_to_array(url, '[/\\\\]')) AS base FROM pages WHERE url LIKE 'http://%' OR url LIKE 'https://%'""")
def relative_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").where("url LIKE 'http://%' OR url LIKE 'https://%'")
    root = F.when(F.startswith("url", F.lit("https:")), F.lit("https:")).otherwise("http:")
    return p.select("page_id", X.relative_path(root, F.col("url")).alias("rel"), X.basename(F.col("url")).alias("base"))


# Decisions


def _decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    tail = F.when(key % 2 == 0, F.concat(F.lit(" instead of the tool"), (key - 10).cast("string"))).otherwise("")
    label = F.concat(F.lit("Let's use tool"), key.cast("string"), F.lit(" for the store"), tail)
    return table(spark, sf_dir, "part").select(key.cast("string").alias("id"), (key % 10).cast("string").alias("scope"), label.alias("label"), (key * 1000).alias("ts"))


DECISIONS_SQL = """
    d AS (SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(p_partkey % 10 AS VARCHAR) AS scope, p_partkey * 1000 AS ts,
        'Let''s use tool' || p_partkey || ' for the store' || CASE WHEN p_partkey % 2 = 0 THEN ' instead of the tool' || (p_partkey - 10) ELSE '' END AS label FROM part)"""
PAIRS_SQL = DECISIONS_SQL + """,
    n AS (SELECT id, scope, ts, regexp_extract(lower(label), 'instead of the ([a-z0-9]+)', 1) AS word FROM d WHERE label LIKE '%instead of%'),
    w AS (SELECT id, scope, ts, unnest(list_distinct(regexp_split_to_array(lower(label), '[^a-z0-9]+'))) AS word FROM d),
    pairs AS (SELECT n.id AS "from", min(w.id) AS "to" FROM n JOIN w ON n.scope = w.scope AND n.word = w.word AND w.ts < n.ts AND w.id <> n.id GROUP BY n.id HAVING count(*) = 1)"""


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN trim(regexp_extract('We met. Then, I' || chr(39) || 'd say let''s use tool' || p_partkey || ' for ' || p_type || ' parts! Done.', '(?i)[^.!?\\n]*let''s use[^.!?\\n]*[.!?\\n]?')) END AS decision FROM part""")
def decision_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = F.concat(F.lit("We met. Then, I'd say let's use tool"), F.col("p_partkey").cast("string"), F.lit(" for "), "p_type", F.lit(" parts! Done."))
    text = F.when(F.col("p_partkey") % 3 == 0, F.lit("Go with it. Nothing here to keep in mind at all.")).otherwise(stated)
    return table(spark, sf_dir, "part").select("p_partkey", decision_text(text).alias("decision"))


@query("WITH " + DECISIONS_SQL + " SELECT id, CASE WHEN label LIKE '%instead of%' THEN regexp_extract(lower(label), 'instead of the ([a-z0-9]+)', 1) END AS subject FROM d")
def superseded_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select("id", superseded_subject(F.col("label")).alias("subject"))


@query("WITH " + PAIRS_SQL + ' SELECT "from", "to" FROM pairs')
def supersession_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.supersessions(_decisions(spark, sf_dir))


@query("WITH RECURSIVE " + PAIRS_SQL + """,
    walk AS (SELECT "to" AS id, "from" AS head FROM pairs UNION ALL SELECT walk.id, p."from" FROM walk JOIN pairs p ON p."to" = walk.head)
    SELECT id, head FROM walk WHERE head NOT IN (SELECT "to" FROM pairs)""")
def supersession_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = T.supersessions(_decisions(spark, sf_dir)).select("from", "to", F.lit("supersedes").alias("kind"), F.lit(1).cast("bigint").alias("seq"))
    return G.supersession_heads(G.superseded_by(edges))


# As-of and semi joins


@query("""
    WITH c AS (SELECT epoch_ms(l_shipdate) AS t, max(l_partkey) AS part FROM lineitem GROUP BY 1)
    SELECT o.o_orderkey, coalesce(c.part, (SELECT arg_min(part, t) FROM c)) AS commit FROM (SELECT o_orderkey, epoch_ms(o_orderdate) AS t FROM orders) o ASOF LEFT JOIN c ON o.t >= c.t""")
def asof_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "lineitem").groupBy(ms("l_shipdate").alias("time_ms")).agg(F.max("l_partkey").alias("part"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", ms("o_orderdate").alias("t"))
    return T.as_of(o, c, "t", "time_ms", "part", out="commit").select("o_orderkey", "commit")


@query("""
    WITH c AS (SELECT user_id, epoch_ms(ts) AS t, max(event_id) AS e FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2),
    o AS (SELECT user_id, arg_min(e, t) AS first FROM c GROUP BY 1)
    SELECT l.event_id, coalesce(c.e, o.first) AS previous FROM (SELECT event_id, user_id, epoch_ms(ts) AS t FROM events) l
    ASOF LEFT JOIN c ON l.user_id = c.user_id AND l.t >= c.t LEFT JOIN o ON l.user_id = o.user_id""")
def asof_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", ms("ts").alias("t"))
    c = e.where("event_id % 3 = 0").groupBy("user_id", "t").agg(F.max("event_id").alias("e"))
    return T.as_of(e, c, "t", "t", "e", by=["user_id"], out="previous").select("event_id", "previous")


@query("""
    SELECT DISTINCT l_orderkey, 'p' || l_partkey AS path FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 10)""")
def changed_files_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = table(spark, sf_dir, "part").where("p_size < 10").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"))
    changed = table(spark, sf_dir, "lineitem").select("l_orderkey", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("path"))
    return changed.join(scanned, "path", "left_semi").select("l_orderkey", "path").distinct()


# A typed graph of the star schema


def _star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    parts = [
        t("nation").select(key("n", "n_nationkey").alias("from"), key("r", "n_regionkey").alias("to"), F.lit("contains").alias("kind")),
        t("customer").select(key("c", "c_custkey").alias("from"), key("n", "c_nationkey").alias("to"), F.lit("derived_from").alias("kind")),
        t("supplier").select(key("s", "s_suppkey").alias("from"), key("n", "s_nationkey").alias("to"), F.lit("derived_from").alias("kind")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


EDGES_SQL = """
    e AS (SELECT 'n' || n_nationkey AS "from", 'r' || n_regionkey AS "to", 'contains' AS kind FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'derived_from' FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'derived_from' FROM supplier)"""


def _star_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _star_edges(spark, sf_dir)
    return e.select(F.col("from").alias("id")).union(e.select("to")).distinct()


@query("WITH " + EDGES_SQL + """
    SELECT id, CAST(count(*) AS BIGINT) AS degree FROM (SELECT "from" AS id FROM e UNION ALL SELECT "to" FROM e WHERE "to" <> "from") GROUP BY id""")
def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.degrees(_star_edges(spark, sf_dir))


@query("WITH " + EDGES_SQL + """
    SELECT id, round(CASE WHEN id LIKE 'n%' THEN ln(1 + count(*)) * 0.03 ELSE 0 END, 9) AS prior FROM (SELECT "from" AS id FROM e UNION ALL SELECT "to" FROM e) GROUP BY id""")
def centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.startswith("id", F.lit("n")), F.lit("decision")).otherwise("turn")
    return M.degrees(_star_edges(spark, sf_dir)).select("id", F.round(X.centrality(kind, F.col("degree")), 9).alias("prior"))


@query("""
    SELECT 'p' || l_partkey AS "from", 's' || l_suppkey AS "to", CAST(count(*) AS BIGINT) AS n FROM lineitem
    WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY 1, 2""")
def edge_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = table(spark, sf_dir, "part").where("p_size < 25").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"))
    nodes = nodes.union(table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))))
    edges = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("from"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("to"))
    return M.with_endpoints(edges, nodes).groupBy("from", "to").agg(F.count("*").alias("n"))


@query("WITH " + EDGES_SQL + """,
    ids AS (SELECT 'c' || c_custkey AS id FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT 'n' || n_nationkey FROM nation)
    SELECT "from", "to" FROM e WHERE "from" IN (SELECT id FROM ids) AND "to" IN (SELECT id FROM ids)""")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"))
    ids = ids.union(table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))))
    return G.induced(_star_nodes(spark, sf_dir), _star_edges(spark, sf_dir), ids)[1].select("from", "to")


@query("WITH RECURSIVE " + EDGES_SQL + """,
    b AS (SELECT "from" AS a, "to" AS b FROM e UNION ALL SELECT "to", "from" FROM e),
    s AS (SELECT 'r' || r_regionkey AS id FROM region),
    d1 AS (SELECT DISTINCT s.id AS start, b.b AS id FROM s JOIN b ON b.a = s.id),
    d2 AS (SELECT DISTINCT d1.start, b.b AS id FROM d1 JOIN b ON b.a = d1.id)
    SELECT start, id, min(depth) AS depth FROM (SELECT id AS start, id, 0 AS depth FROM s UNION ALL SELECT start, id, 1 FROM d1 UNION ALL SELECT start, id, 2 FROM d2) GROUP BY 1, 2""")
def bfs_depth2(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"))
    return G.reach(_star_nodes(spark, sf_dir), _star_edges(spark, sf_dir), start, 2)


# Merges


@query("WITH " + EDGES_SQL + """
    SELECT 'n3' AS id UNION SELECT "to" FROM e WHERE "from" = 'n3' UNION SELECT "from" FROM e WHERE "to" = 'n3'""")
def neighbors_of_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.neighbors(_star_nodes(spark, sf_dir), _star_edges(spark, sf_dir), "n3")[0].select("id")


def _upserts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prov = F.struct(
        F.lit("t").alias("source_tool"), F.lit(None).cast("string").alias("native_session_id"), F.lit(None).cast("string").alias("native_path"), F.lit(None).cast("string").alias("connector_version"), F.lit(None).cast("string").alias("commit"),
        F.lit(None).cast("struct<start:bigint,end:bigint>").alias("span"), F.col("l_linenumber").cast("int").alias("source_priority"), F.lit(1.0).cast("float").alias("confidence"), F.col("l_orderkey").cast("string").alias("extractor"),
    )
    at = ms("l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("id"), F.lower("l_returnflag").alias("kind"), F.concat("l_returnflag", F.col("l_orderkey").cast("string")).alias("label"),
        F.when(F.col("l_linenumber") % 2 == 0, F.lit("")).otherwise(F.concat(F.lit("b"), F.col("l_orderkey").cast("string"))).alias("body"), F.lit("").alias("summary"),
        F.when(F.col("l_linenumber") != 7, prov).alias("provenance"), F.create_map("l_returnflag", "l_linestatus").alias("attrs"), at.alias("first_seen_ms"), at.alias("last_updated_ms"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


@query("""
    WITH r AS (SELECT CAST(l_partkey AS VARCHAR) AS id, l_orderkey * 10 + l_linenumber AS seq, lower(l_returnflag) AS kind, l_returnflag || l_orderkey AS label,
            CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE 'b' || l_orderkey END AS body, l_linenumber AS p, CAST(l_orderkey AS VARCHAR) AS x, epoch_ms(l_shipdate) AS ms, l_returnflag AS k, l_linestatus AS v FROM lineitem),
    a AS (SELECT id, string_agg(k || '=' || v, ',' ORDER BY k) AS attrs FROM (SELECT id, k, arg_max(v, (seq, v)) AS v FROM r GROUP BY 1, 2) GROUP BY id)
    SELECT r.id, arg_max(kind, (seq, kind)) AS kind, arg_max(label, (seq, label)) AS label, coalesce(arg_max(body, (seq, body)) FILTER (WHERE body <> ''), '') AS body,
        min(ms) AS first_seen_ms, max(ms) AS last_updated_ms, arg_max(x, (p, -seq, x)) FILTER (WHERE p <> 7) AS extractor, any_value(a.attrs) AS attrs FROM r JOIN a ON r.id = a.id GROUP BY r.id""")
def node_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = M.merge_nodes(_upserts(spark, sf_dir))
    attrs = F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return m.select("id", "kind", "label", "body", "first_seen_ms", "last_updated_ms", F.col("provenance.extractor").alias("extractor"), attrs.alias("attrs"))


@query("""
    SELECT CAST(l_partkey AS VARCHAR) AS "from", CAST(l_suppkey AS VARCHAR) AS "to", l_returnflag AS kind, min(l_orderkey) AS seq FROM lineitem GROUP BY 1, 2, 3""")
def edge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("from"), F.col("l_suppkey").cast("string").alias("to"), F.col("l_returnflag").alias("kind"), F.lit(1.0).cast("float").alias("weight"), F.col("l_orderkey").alias("seq"))
    return M.merge_edges(e).select("from", "to", "kind", "seq")


@query("SELECT CAST(vec_id AS VARCHAR) AS id, round(list_sum(embedding::double[]) * CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END, 6) AS total FROM embeddings")
def vector_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), F.lit(1).cast("bigint").alias("seq"))
    again = e.where("CAST(id AS BIGINT) % 2 = 0").select("id", F.transform("vec", lambda x: x * 2).alias("vec"), F.lit(2).cast("bigint").alias("seq"))
    m = M.merge_vectors(e.union(again))
    return m.select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


# Vectors and ranking


@query("""
    WITH t AS (SELECT conv_id || '-' || turn AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: strlen(t) > 1)) AS token FROM conversations),
    h AS (SELECT id, sha256(token) AS h FROM t)
    SELECT id, CAST('0x' || substr(h, 1, 2) AS INTEGER) AS bucket, CAST(sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END) AS DOUBLE) AS value
    FROM h GROUP BY 1, 2 HAVING sum(CASE WHEN CAST('0x' || substr(h, 9, 2) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END) <> 0""")
def hash_embed_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").withColumn("id", F.concat_ws("-", "conv_id", "turn"))
    return V.hash_bag(c, "id", "text")


SPARSE_SQL = """
    t AS (SELECT conv_id || '-' || turn AS id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: strlen(t) > 1)) AS token FROM conversations),
    h AS (SELECT id, CAST('0x' || substr(sha256(token), 1, 2) AS INTEGER) AS b, CASE WHEN CAST('0x' || substr(sha256(token), 9, 2) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END AS s FROM t),
    v AS (SELECT id, b, CAST(sum(s) AS DOUBLE) AS x FROM h GROUP BY 1, 2),
    u AS (SELECT id, b, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS x, sum(x * x) OVER (PARTITION BY id) AS n FROM v)"""


@query("WITH " + SPARSE_SQL + " SELECT id, b AS bucket, round(x, 6) AS x FROM u WHERE n > 0 AND x <> 0")
def hash_embed_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), V.hash_embedding(F.col("text")).alias("vec"))
    return c.select("id", F.posexplode("vec").alias("bucket", "x")).where("x <> 0").select("id", "bucket", F.round("x", 6).alias("x"))


@query("""
    WITH w AS (SELECT token, [strlen(token), 1.0, ascii(token) % 7]::double[] AS vec FROM (SELECT DISTINCT unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: strlen(t) > 1)) AS token FROM benchmark)),
    t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: strlen(t) > 1)) AS token FROM documents),
    m AS (SELECT doc_id, avg(vec[1]) AS a, avg(vec[2]) AS b, avg(vec[3]) AS c FROM t JOIN w USING (token) GROUP BY 1)
    SELECT doc_id AS id, round(a / sqrt(a * a + b * b + c * c), 6) AS x, round(b / sqrt(a * a + b * b + c * c), 6) AS y, round(c / sqrt(a * a + b * b + c * c), 6) AS z FROM m""")
def static_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select(F.explode(X.tokens(F.col("text"))).alias("token")).distinct()
    w = w.select("token", F.array(F.octet_length("token").cast("double"), F.lit(1.0), (F.ascii("token") % 7).cast("double")).alias("vec"))
    v = V.static_embedding(table(spark, sf_dir, "documents"), w, "doc_id", "text")
    return v.select("id", *[F.round(F.col("vec")[i], 6).alias(n) for i, n in enumerate("xyz")])


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return _vectors(spark, sf_dir).orderBy("id").first()["vec"]


TOP_SQL = "q AS (SELECT embedding::double[] AS q FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id AS id, label, list_inner_product(embedding::double[], q) AS score FROM embeddings, q)"


@query("WITH " + TOP_SQL + " SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, id LIMIT 20")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.top_k(_vectors(spark, sf_dir), _first_vector(spark, sf_dir), 20).select("id", F.round("score", 6).alias("score"))


@query("""
    WITH s AS (SELECT a.vec_id AS query, b.vec_id AS id, list_inner_product(a.embedding::double[], b.embedding::double[]) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0)
    SELECT query, id, round(score, 6) AS score, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS rank FROM s QUALIFY rank <= 10""")
def vector_topk_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return V.top_k_batch(v, v.where("id % 20 = 0").select(F.col("id").alias("query"), "vec"), 10).select("query", "id", F.round("score", 6).alias("score"), "rank")


@query("WITH " + TOP_SQL + ", p AS (SELECT * FROM s ORDER BY score DESC, id LIMIT 256) SELECT id, label, round(score, 6) AS score FROM p WHERE p.score > 0.01 AND label % 2 = 0")
def pool_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir)
    pool = V.top_k(v, _first_vector(spark, sf_dir), 256).where("score > 0.01")
    return pool.join(v.where("label % 2 = 0").select("id", "label"), "id").select("id", "label", F.round("score", 6).alias("score"))


@query("SELECT vec_id AS id, round(list_sum(embedding::double[]) / sqrt(list_inner_product(embedding::double[], embedding::double[])), 6) AS total FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _vectors(spark, sf_dir).select("id", X.l2_normalize(F.col("vec")).alias("vec"))
    return v.select("id", F.round(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


BM25_SQL = """
    t AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: strlen(t) > 1) AS t FROM documents),
    n AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS avgdl FROM t),
    f AS (SELECT id, len(t) AS len, term, len(list_filter(t, lambda x: x = term)) AS tf FROM t, (SELECT unnest(['the', 'idiot', 'tion', 'unknownword']) AS term)),
    d AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM f GROUP BY term)"""


@query("WITH " + BM25_SQL + """
    SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))), 6) AS score FROM f JOIN d USING (term), n GROUP BY id HAVING sum(tf) > 0""")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return R.bm25(docs, ["the", "idiot", "tion", "unknownword", "the"]).select("id", F.round("score", 6).alias("score"))


@query("""
    SELECT l_partkey AS id, max(l_discount) AS score, ['semantic', 'graph', 'lexical'][1 + arg_max(l_linenumber % 3, (l_discount, -(l_linenumber % 3)))] AS why FROM lineitem GROUP BY l_partkey""")
def candidate_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bump(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id"), F.col("l_discount").alias("score"), (F.col("l_linenumber") % 3).cast("int").alias("stage")))


WEIGHTS_SQL = "CASE kind WHEN 'decision' THEN 1.0 WHEN 'turn' THEN 0.85 WHEN 'session' THEN 0.65 WHEN 'commit' THEN 0.5 WHEN 'file' THEN 0.4 ELSE 0.3 END"


@query(f"""
    WITH k AS (SELECT p_partkey AS id, ['decision', 'turn', 'session', 'commit', 'file', 'symbol'][1 + p_size % 6] AS kind, p_retailprice AS price FROM part)
    SELECT id, kind, round(price * {WEIGHTS_SQL}, 6) AS score FROM k ORDER BY price * {WEIGHTS_SQL} DESC, id LIMIT 100""")
def kind_weighted_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*map(F.lit, ("decision", "turn", "session", "commit", "file", "symbol")))
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.element_at(kinds, (F.col("p_size") % 6 + 1).cast("int")).alias("kind"), "p_retailprice")
    s = p.withColumn("s", F.col("p_retailprice") * X.kind_weight(F.col("kind")))
    return s.orderBy(F.desc("s"), "id").limit(100).select("id", "kind", F.round("s", 6).alias("score"))


@query("SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), '12')")
def lexical_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = R.query_tokens("Red, 12 x")
    hit = F.lit(False)
    for w in words:
        hit = hit | F.contains(F.lower("p_name"), F.lit(w))
    return table(spark, sf_dir, "part").where(hit).select(F.col("p_partkey").alias("id"))


# Slices and timelines


def _event_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), ms("ts").alias("first_seen_ms"), ms("ts").alias("last_updated_ms"))


@query("SELECT event_id AS id, event_type AS kind, epoch_ms(date_trunc('millisecond', ts)) AS last_updated_ms FROM events ORDER BY epoch_ms(date_trunc('millisecond', ts)) DESC, event_id LIMIT 400")
def newest_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.newest(_event_nodes(spark, sf_dir)).select("id", "kind", "last_updated_ms")


@query("SELECT event_id AS id, epoch_ms(date_trunc('millisecond', ts)) AS first_seen_ms FROM events ORDER BY epoch_ms(date_trunc('millisecond', ts)), event_id LIMIT 200")
def timeline_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.timeline(_event_nodes(spark, sf_dir)).select("id", "first_seen_ms")


@query("SELECT event_id AS id, epoch_ms(date_trunc('millisecond', ts)) AS first_seen_ms FROM events ORDER BY epoch_ms(date_trunc('millisecond', ts)) DESC, event_id LIMIT 20")
def timeline_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.timeline(_event_nodes(spark, sf_dir), 20, newest_first=True, most=200).select("id", "first_seen_ms")


@query("SELECT event_id AS id, event_type AS kind FROM events WHERE event_type IN ('click', 'error') ORDER BY epoch_ms(date_trunc('millisecond', ts)) DESC, event_id LIMIT 100")
def newest_of_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.newest(_event_nodes(spark, sf_dir), 100, " Click,ERROR".split(",")).select("id", "kind")


@query("SELECT event_type, epoch_ms(date_trunc('hour', ts)) AS start_ms, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def activity_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"))
    return activity(e, "ts", "1 hour", "2 hours", "event_type").select("event_type", F.unix_millis("start").alias("start_ms"), "n")


@query("""
    WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN doc_id % 3 = 0 THEN 'kept' ELSE '' END AS s, CASE WHEN doc_id % 3 = 1 THEN '' ELSE coalesce(text, '') END AS body FROM documents),
    t AS (SELECT *, trim(regexp_replace(body, '\\s+', ' ', 'g')) AS t FROM d),
    z AS (SELECT *, coalesce(nullif(regexp_extract(substr(t, 1, 180), '^[^.!?]*[.!?]'), ''), CASE WHEN length(t) > 180 THEN substr(t, 1, 180) || '…' ELSE t END) AS short FROM t)
    SELECT id, coalesce(nullif(s, ''), nullif(short, ''), 'doc ' || id) AS summary, coalesce(nullif(s, ''), nullif(CASE WHEN length(body) > 240 THEN substr(body, 1, 240) || '…' ELSE body END, ''), 'doc ' || id) AS evidence FROM z""")
def node_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    id, at = F.col("doc_id").cast("string"), F.lit(NOW)
    d = table(spark, sf_dir, "documents").select(
        id.alias("id"), F.lit("turn").alias("kind"), F.concat(F.lit("doc "), id).alias("label"), F.when(F.col("doc_id") % 3 == 0, "kept").otherwise("").alias("summary"),
        F.when(F.col("doc_id") % 3 == 1, "").otherwise(F.coalesce("text", F.lit(""))).alias("body"), at.alias("first_seen_ms"), at.alias("last_updated_ms"), F.create_map().alias("attrs"), F.lit(None).alias("provenance"),
    )
    shown = bulk(d).select("id", "summary")
    return shown.join(d.select("id", X.evidence_text(F.col("summary"), F.col("body"), F.col("label")).alias("evidence")), "id")


# Sources, over lines made from the conversations


def _lines_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = F.array(F.struct(F.lit("text").alias("type"), F.col("text"), F.lit(None).cast("struct<file_path:string,edits:array<struct<path:string>>>").alias("input")),
                     F.struct(F.lit("tool_use").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(F.concat(F.lit("src/f"), F.col("turn").cast("string")).alias("file_path"), F.array(F.struct(F.lit("src/e").alias("path"))).alias("edits")).alias("input")))
    line = F.to_json(F.struct(F.col("role").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.when(F.col("turn") > 0, F.lit("/work/demo")).alias("cwd"), F.struct(blocks.alias("content")).alias("message")))
    broken = F.when(F.col("turn") % 5 == 4, F.substring(line, 1, 40)).otherwise(line)
    return table(spark, sf_dir, "conversations").select(F.format_string("/s/%d.jsonl", "conv_id").alias("path"), F.col("turn").cast("int").alias("pos"), broken.alias("line"))


@query("""
    SELECT CAST(conv_id AS VARCHAR) AS session, turn AS pos, CASE WHEN role IN ('user', 'assistant', 'system', 'summary') THEN role ELSE 'unknown' END AS kind, text, 'src/f' || turn || ',src/e' AS files,
        CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS idx FROM (SELECT * FROM conversations WHERE turn % 5 <> 4)""")
def transcript_a_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = parse_lines(_lines_a(spark, sf_dir), CONNECTORS["claude_code"])
    return t.select(F.col("native_session_id").alias("session"), F.col("pos").cast("bigint").alias("pos"), "kind", "text", F.array_join("touched_files", ",").alias("files"), F.col("idx").cast("bigint").alias("idx"))


@query("""
    SELECT CAST(conv_id AS VARCHAR) AS session, CASE WHEN count(*) FILTER (WHERE turn > 0) > 0 THEN '/work/demo' END AS repo_root, 1704067200000 AS started_at_ms, CAST(count(*) AS BIGINT) AS n_turns
    FROM (SELECT * FROM conversations WHERE turn % 5 <> 4) GROUP BY conv_id""")
def session_first_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = CONNECTORS["claude_code"]
    s = sessions_of(parse_lines(_lines_a(spark, sf_dir), c), c)
    return s.select(F.col("native_session_id").alias("session"), "repo_root", "started_at_ms", "n_turns")


@query("""
    SELECT conv_id, turn AS pos, CASE WHEN turn % 2 = 1 THEN 'assistant' WHEN role IN ('user', 'assistant', 'system') THEN role ELSE 'unknown' END AS kind,
        CASE WHEN turn % 2 = 1 THEN '[tool] edit' ELSE text END AS text, CASE WHEN turn % 2 = 1 THEN 'a/b,c' || turn ELSE '' END AS files FROM conversations""")
def transcript_b_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = F.to_json(F.struct(F.lit("a/b").alias("file_path"), F.struct(F.concat(F.lit("c"), F.col("turn").cast("string")).alias("path")).alias("input")))
    call = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("function_call").alias("type"), F.lit("edit").alias("name"), args.alias("arguments")).alias("payload")))
    said = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), F.col("role"), F.array(F.struct(F.lit("input_text").alias("type"), F.col("text"))).alias("content")).alias("payload")))
    path = F.format_string("/s/rollout-%d-0.jsonl", "conv_id")
    lines = table(spark, sf_dir, "conversations").select(path.alias("path"), F.col("turn").cast("int").alias("pos"), F.when(F.col("turn") % 2 == 1, call).otherwise(said).alias("line"))
    t = parse_lines(lines, CONNECTORS["codex"])
    return t.select(F.regexp_extract("path", r"rollout-(\d+)", 1).cast("bigint").alias("conv_id"), F.col("pos").cast("bigint").alias("pos"), "kind", "text", F.array_join("touched_files", ",").alias("files"))


@query("""
    SELECT p_partkey, unnest([{'kind': 'def', 'name': 'run_' || p_partkey}, {'kind': 'class', 'name': 'Part' || p_size}], recursive := true) FROM part""")
def symbols_py(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("class Part"), F.col("p_size").cast("string"), F.lit(":\n    def run_"), F.col("p_partkey").cast("string"), F.lit("(self):\n        pass\n    async def no(self): ...\n"))
    s = table(spark, sf_dir, "part").select("p_partkey", F.explode(symbols(F.lit("a/b.py"), code)).alias("s"))
    return s.select("p_partkey", "s.kind", "s.name")


@query("SELECT 'd/' || s_suppkey || '/pyproject.toml' AS path, unnest(['numpy', 'pkg-' || s_suppkey, 'my.dep_x']) AS name FROM supplier")
def pep621_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit('[project]\nname = "x"\ndependencies = [\n  "numpy>=1.2", "pkg-'), F.col("s_suppkey").cast("string"), F.lit('~=2",\n  "my.dep_x",\n]\n[tool.other]\nversion = "1"\n'))
    files = table(spark, sf_dir, "supplier").select(F.concat(F.lit("d/"), F.col("s_suppkey").cast("string"), F.lit("/pyproject.toml")).alias("path"), text.alias("content"))
    return dependencies(files)


@query("SELECT 'd/' || s_suppkey || '/Cargo.toml' AS path, unnest(['serde', 'lib-' || s_suppkey, 'test-' || s_suppkey, 'own' || s_suppkey]) AS name FROM supplier")
def cargo_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = '[package]\nname = "x"\n[dependencies]\nserde = "1"\nlib-%1$d = { version = "2" }\n# no = "1"\n[dev-dependencies]\ntest-%1$d="1"\n[dependencies.own%1$d]\nversion = "1"\n[profile.release]\nlto = true\n'
    return _manifests(spark, sf_dir, "Cargo.toml", text)


@query("SELECT 'd/' || s_suppkey || '/go.mod' AS path, unnest(['example.org/one', 'example.org/k' || s_suppkey, 'example.org/x/text']) AS name FROM supplier")
def go_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "module x\n\ngo 1.22\n\nrequire example.org/one v1.0.0\n\nrequire (\n\texample.org/k%1$d v1.2.3 // indirect\n\t// note\n\texample.org/x/text v0.3.0\n)\n\nreplace a => b\n"
    return _manifests(spark, sf_dir, "go.mod", text)


@query("SELECT 'd/' || s_suppkey || '/package.json' AS path, unnest(['react', 'pkg-' || s_suppkey, '@types/n' || s_suppkey]) AS name FROM supplier")
def npm_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = "l" * 64  # a name of over 63 bytes is no name
    text = '{"name": "x", "dependencies": {"react": "^18", "pkg-%1$d": "1", "' + long + '": "1"}, "devDependencies": {"@types/n%1$d": "2"}, "scripts": {"build": "x"}}'
    return _manifests(spark, sf_dir, "package.json", text)


def _manifests(spark: SparkSession, sf_dir: str, name: str, text: str) -> DataFrame:
    key = F.col("s_suppkey").cast("int")
    files = table(spark, sf_dir, "supplier").select(F.format_string("d/%d/" + name, key).alias("path"), F.format_string(text, key).alias("content"))
    return dependencies(files)


@query("""
    WITH p AS (SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS k FROM part)
    SELECT p_partkey, unnest([{'kind': 'fn', 'name': 'go_' || k}, {'kind': 'struct', 'name': 'S' || k}, {'kind': 'enum', 'name': 'E'}, {'kind': 'trait', 'name': 'T' || k}], recursive := true) FROM p WHERE p_partkey % 4 = 0
    UNION ALL SELECT p_partkey, unnest([{'kind': 'function', 'name': 'f' || k}, {'kind': 'class', 'name': 'C' || k}, {'kind': 'const', 'name': 'x' || k}], recursive := true) FROM p WHERE p_partkey % 4 = 1
    UNION ALL SELECT p_partkey, unnest([{'kind': 'func', 'name': 'M' || k}, {'kind': 'func', 'name': 'main'}, {'kind': 'type', 'name': 'T' || k}], recursive := true) FROM p WHERE p_partkey % 4 = 2""")
def symbols_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = {
        "rs": "pub async fn go_%1$d() {}\npub(crate) struct S%1$d;\nenum E { A }\npub trait T%1$d {}\nunsafe fn no() {}\n",
        "ts": "export function f%1$d() {}\nclass C%1$d {}\nexport const x%1$d = 1;\nlet y = 2;\n",
        "go": "func (r *R) M%1$d() {}\nfunc main() {}\ntype T%1$d struct {}\n",
        "txt": "fn none() {}\n",
    }
    key = F.col("p_partkey").cast("int")
    which = lambda made: F.element_at(F.array(*made), (key % 4 + 1).cast("int"))
    s = table(spark, sf_dir, "part").withColumn("path", which([F.lit(f"a/b.{ext}") for ext in code])).withColumn("code", which([F.format_string(c, key) for c in code.values()]))
    return s.select("p_partkey", F.explode(symbols(F.col("path"), F.col("code"))).alias("s")).select("p_partkey", "s.kind", "s.name")


# Whole flows


def conversation_mutations(spark: SparkSession, sf_dir: str, decide: bool = False):
    """The conversations as sessions; with ``decide`` every assistant turn states a decision."""
    c = table(spark, sf_dir, "conversations")
    if decide:
        stated = F.concat("text", F.lit(". Let's use tool"), F.col("conv_id").cast("string"), F.lit(" for the work demo."))
        c = c.withColumn("text", F.when(F.col("role") == "assistant", stated).otherwise(F.col("text")))
    path = F.col("conv_id").cast("string").alias("path")
    none = F.lit(None).cast("string")
    start = (F.col("conv_id") * 3_600_000 + 1_700_000_000_000).alias("started_at_ms")
    s = c.select("conv_id").distinct().select(path, F.lit("claude_code").alias("agent"), F.col("conv_id").cast("string").alias("native_session_id"), F.lit("/work/demo").alias("repo_root"), none.alias("connector_version"), none.alias("commit"), start)
    touched = F.when(F.col("turn") % 3 == 1, F.array(F.concat(F.lit("/work/demo/src/f"), (F.col("turn") % 7).cast("string")))).otherwise(F.array().cast("array<string>"))
    t = c.select(path, F.col("turn").cast("int").alias("idx"), F.col("role").alias("kind"), "text", (F.col("conv_id") * 3_600_000 + 1_700_000_000_000 + F.col("turn") * 1000).alias("ts_ms"), touched.alias("touched_files"))
    return session_mutations(s, t, NOW)


def conversation_graph(spark: SparkSession, sf_dir: str, decide: bool = False) -> R.Graph:
    m = conversation_mutations(spark, sf_dir, decide)
    # Cut, as a store's snapshot would be: recall reads these tables many times.
    nodes = checkpointed(M.merge_nodes(m.nodes))
    return R.Graph(nodes, checkpointed(M.with_endpoints(M.merge_edges(m.edges), nodes)), checkpointed(M.merge_vectors(m.vectors)))


CHAT_SQL = "chat AS (SELECT * FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' AND NOT starts_with(trim(text), 'Caveat:'))"


QUESTION = "the and with work demo"
@query("""
    WITH f AS (SELECT s_suppkey, 's' || s_suppkey || '/m.py' AS rel FROM supplier UNION ALL SELECT s_suppkey, 's' || s_suppkey || '/pyproject.toml' FROM supplier WHERE s_suppkey % 5 = 0),
    h AS (SELECT DISTINCT sha1(CAST(c_custkey AS VARCHAR)) AS oid, rel FROM (SELECT c_custkey, unnest(['s' || c_nationkey || '/m.py', 's' || c_nationkey || '/pyproject.toml', 'gone.py']) AS rel FROM customer) JOIN f USING (rel)),
    raw AS (
        SELECT 'repo' AS kind, '/work/demo' AS k, 'demo' AS label UNION ALL SELECT 'framework', unnest(['numpy', 'pkg-' || s_suppkey]), unnest(['numpy', 'pkg-' || s_suppkey]) FROM supplier WHERE s_suppkey % 5 = 0
        UNION ALL SELECT 'file', '/work/demo' || chr(1) || rel, list_last(string_split(rel, '/')) FROM f WHERE rel LIKE '%.py' UNION ALL SELECT 'file', '/work/demo' || chr(1) || rel, list_last(string_split(rel, '/')) FROM h
        UNION ALL SELECT 'symbol', '/work/demo' || chr(1) || 's' || s_suppkey || '/m.py' || chr(1) || 'def' || chr(1) || 'run_' || s_suppkey, 'run_' || s_suppkey FROM supplier
        UNION ALL SELECT 'commit', sha1(CAST(c_custkey AS VARCHAR)), substr(sha1(CAST(c_custkey AS VARCHAR)), 1, 8) FROM customer),
    n AS (SELECT DISTINCT kind, k, label, substr(sha256(kind || chr(0) || k), 1, 32) AS id FROM raw),
    raw_e AS (
        SELECT 'depends_on' AS kind, '/work/demo' AS a, k AS b FROM n WHERE kind = 'framework' UNION ALL SELECT 'contains', '/work/demo', '/work/demo' || chr(1) || rel FROM f WHERE rel LIKE '%.py' UNION ALL SELECT 'contains', '/work/demo', k FROM n WHERE kind = 'commit'
        UNION ALL SELECT 'defines', '/work/demo' || chr(1) || 's' || s_suppkey || '/m.py', '/work/demo' || chr(1) || 's' || s_suppkey || '/m.py' || chr(1) || 'def' || chr(1) || 'run_' || s_suppkey FROM supplier
        UNION ALL SELECT 'changed_by', '/work/demo' || chr(1) || rel, oid FROM h)
    SELECT 'node' AS part, id AS a, kind AS b, label AS c FROM n UNION ALL SELECT 'edge', x.id, y.id, raw_e.kind FROM raw_e JOIN n x ON x.k = raw_e.a JOIN n y ON y.k = raw_e.b
    UNION ALL SELECT 'vector', id, '', '' FROM n WHERE kind = 'symbol' OR (kind = 'file' AND label = 'm.py')""")
def repository_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of a source file per supplier, some manifests, and a commit per customer."""
    key = F.col("s_suppkey").cast("int")
    s = table(spark, sf_dir, "supplier")
    code = s.select(F.format_string("s%d/m.py", key).alias("path"), F.format_string("def run_%d():\n    pass\n", key).alias("content"))
    code = code.union(s.where("s_suppkey % 5 = 0").select(F.format_string("s%d/pyproject.toml", key), F.format_string('[project]\ndependencies = ["numpy", "pkg-%d"]\n', key)))
    oid, nation = F.sha1(F.col("c_custkey").cast("string").cast("binary")), F.col("c_nationkey").cast("int")
    history = table(spark, sf_dir, "customer").select(
        oid.alias("oid"), F.substring(oid, 1, 8).alias("short"), F.col("c_name").alias("summary"), F.lit("someone").alias("author"), (F.col("c_custkey") * 60_000 + 1_700_000_000_000).alias("time_ms"),
        F.array(F.format_string("s%d/m.py", nation), F.format_string("s%d/pyproject.toml", nation), F.lit("gone.py")).alias("changed"),
    )
    m = repository_mutations(code.withColumn("n_bytes", F.octet_length("content").cast("bigint")), "/work/demo", NOW, history)
    nodes = M.merge_nodes(m.nodes)
    edges = M.with_endpoints(M.merge_edges(m.edges), nodes)
    part = lambda name: F.lit(name).alias("part")
    rows = nodes.select(part("node"), F.col("id").alias("a"), F.col("kind").alias("b"), F.col("label").alias("c")).union(edges.select(part("edge"), "from", "to", "kind"))
    return rows.union(M.merge_vectors(m.vectors).select(part("vector"), "id", F.lit(""), F.lit("")))


NODES_SQL = "WITH " + CHAT_SQL + """,
    n AS (
        SELECT 's' || conv_id AS k, 'session' AS kind, 'session ' || conv_id AS label, coalesce((SELECT substr(arg_min(c.text, c.turn), 1, 200) FROM chat c WHERE c.conv_id = x.conv_id AND c.role = 'user'), '') AS emb, 1700000000000 + conv_id * 3600000 AS ts,
            substr(sha256('session' || chr(0) || 'claude_code:' || conv_id), 1, 32) AS id FROM (SELECT DISTINCT conv_id FROM conversations) x
        UNION ALL SELECT 't' || conv_id || '-' || turn, 'turn', substr(text, 1, 48), text, 1700000000000 + conv_id * 3600000 + turn * 1000, substr(sha256('turn' || chr(0) || 'claude_code:' || conv_id || ':' || turn || ':' || sha256(text)), 1, 32) FROM chat
        UNION ALL SELECT 'r', 'repo', 'demo', NULL, 1710000000000, substr(sha256('repo' || chr(0) || '/work/demo'), 1, 32)
        UNION ALL SELECT DISTINCT 'f' || turn % 7, 'file', 'f' || turn % 7, NULL, 1710000000000, substr(sha256('file' || chr(0) || '/work/demo' || chr(1) || 'src/f' || turn % 7), 1, 32) FROM chat WHERE turn % 3 = 1),
    e AS (SELECT 's' || conv_id AS a, 'r' AS b FROM (SELECT DISTINCT conv_id FROM conversations) UNION SELECT 's' || conv_id, 't' || conv_id || '-' || turn FROM chat UNION SELECT 't' || conv_id || '-' || turn, 'f' || turn % 7 FROM chat WHERE turn % 3 = 1),
    w AS (SELECT *, power(0.5, greatest(1710000000000 - ts, 0) / 86400000.0 / 30) AS rec, CASE kind WHEN 'turn' THEN 0.85 WHEN 'session' THEN 0.65 WHEN 'repo' THEN 0.5 ELSE 0.4 END AS wt FROM n)"""
EDGE_ROWS_SQL = """
    SELECT a.id AS "from", b.id AS "to", CASE WHEN e.b = 'r' THEN 'derived_from' WHEN e.b LIKE 't%' THEN 'contains' ELSE 'touches' END AS kind FROM e JOIN n a ON a.k = e.a JOIN n b ON b.k = e.b"""


@query(NODES_SQL + """
    SELECT id, kind, label, CASE WHEN kind = 'turn' THEN emb WHEN kind = 'session' THEN emb ELSE '' END AS body, ts AS first_seen_ms, ts AS last_updated_ms,
        CASE WHEN kind = 'session' THEN substr(k, 2) WHEN kind = 'turn' THEN split_part(substr(k, 2), '-', 1) END AS session, CASE WHEN kind = 'file' THEN 'src/' || k WHEN kind = 'repo' THEN '/work/demo' END AS path FROM n""")
def ingest_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = M.merge_nodes(conversation_mutations(spark, sf_dir).nodes)
    return n.select("id", "kind", "label", "body", "first_seen_ms", "last_updated_ms", F.col("provenance.native_session_id").alias("session"), F.try_element_at("attrs", F.lit("path")).alias("path"))


@query(NODES_SQL + EDGE_ROWS_SQL)
def ingest_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = conversation_mutations(spark, sf_dir)
    return M.with_endpoints(M.merge_edges(m.edges), M.merge_nodes(m.nodes)).select("from", "to", "kind")


@query(NODES_SQL + """
    SELECT 'node' AS part, id AS a, kind AS b, label AS c FROM n UNION ALL SELECT 'edge', x."from", x."to", x.kind FROM (""" + EDGE_ROWS_SQL + """) x UNION ALL SELECT 'vector', id, '', '' FROM n WHERE trim(emb) <> ''""")
def store_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch, a snapshot, and the same batch again on top of it: recovered, everything is there once."""
    m = conversation_mutations(spark, sf_dir)
    store = Store(spark, shared_folder(spark, "store"))
    store.append(m, store.next_batch())
    store.checkpoint()
    store.append(m, store.next_batch())
    g, part = Store(spark, store.path).graph(), lambda name: F.lit(name).alias("part")
    nodes = g.nodes.select(part("node"), F.col("id").alias("a"), F.col("kind").alias("b"), F.col("label").alias("c"))
    edges = g.edges.select(part("edge"), "from", "to", "kind")
    return nodes.union(edges).union(g.vectors.select(part("vector"), "id", F.lit(""), F.lit("")))


BEST_SQL = NODES_SQL + """,
    tok AS (SELECT k, unnest(list_filter(regexp_split_to_array(lower(emb), '[^\\p{L}\\p{N}]+'), lambda t: strlen(t) > 1)) AS t FROM n WHERE trim(emb) <> '' UNION ALL SELECT 'q', unnest(['the', 'and', 'with', 'work', 'demo'])),
    bag AS (SELECT k, CAST('0x' || substr(sha256(t), 1, 2) AS INTEGER) AS b, CAST(sum(CASE WHEN CAST('0x' || substr(sha256(t), 9, 2) AS INTEGER) % 2 = 1 THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM tok GROUP BY 1, 2),
    unit AS (SELECT k, b, CASE WHEN sum(x * x) OVER (PARTITION BY k) > 0 THEN x / sqrt(sum(x * x) OVER (PARTITION BY k)) ELSE 0 END AS x FROM bag),
    pool AS (SELECT w.k, sum(u.x * q.x) AS cos FROM w JOIN unit u ON w.k = u.k JOIN (SELECT b, x FROM unit WHERE k = 'q') q ON u.b = q.b GROUP BY w.k, w.id ORDER BY cos DESC, w.id LIMIT {pool}),
    sem AS (SELECT w.k, w.id, (0.7 * cos + 0.15 * rec) * wt AS s FROM pool JOIN w USING (k) WHERE cos > 0.01 AND kind IN ('turn', 'session')),
    seed AS (SELECT k, s FROM sem ORDER BY s DESC, id LIMIT 3),
    near AS (SELECT DISTINCT y.k AS seed, y.s, x.nb FROM seed y JOIN (SELECT a AS k, b AS nb FROM e UNION SELECT b, a FROM e) x ON x.k = y.k WHERE x.nb <> y.k),
    c AS (SELECT k, s, 0 AS stage FROM sem UNION ALL SELECT w.k, (0.35 * near.s + 0.15 * rec) * wt, 1 FROM near JOIN w ON w.k = near.nb
        UNION ALL SELECT k, (0.6 + 0.1 * rec) * wt, 2 FROM w WHERE kind NOT IN ('turn', 'session') AND (contains(lower(label), 'the') OR contains(lower(label), 'and') OR contains(lower(label), 'with') OR contains(lower(label), 'work') OR contains(lower(label), 'demo'))),
    best AS (SELECT k, max(s) AS s, ['semantic', 'graph', 'lexical'][1 + arg_max(stage, (s, -stage))] AS why FROM c GROUP BY k)"""


@query(BEST_SQL.replace("{pool}", "480") + """
    SELECT w.id, round(best.s, 6) AS score, upper(substr(kind, 1, 1)) || substr(kind, 2) AS kind, label, why FROM best JOIN w USING (k) ORDER BY best.s DESC, w.id LIMIT 12""")
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.search(conversation_graph(spark, sf_dir), QUESTION, 12, NOW).select("id", F.round("score", 6).alias("score"), "kind", "label", "why")


@query(NODES_SQL + """,
    d AS (SELECT w.*, list_filter(regexp_split_to_array(lower(label || ' ' || coalesce(emb, '')), '[^\\p{L}\\p{N}]+'), lambda t: strlen(t) > 1) AS t FROM w),
    m AS (SELECT count(*) AS n, greatest(avg(len(t)), 1.0) AS avgdl FROM d),
    f AS (SELECT id, kind, wt, len(t) AS len, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, (SELECT unnest(['the', 'and', 'with', 'work', 'demo']) AS term)),
    g AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM f GROUP BY term),
    b AS (SELECT id, kind, wt * sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avgdl))) AS s FROM f JOIN g USING (term), m GROUP BY id, kind, wt HAVING sum(tf) > 0)
    SELECT id, round(s, 6) AS score, upper(substr(kind, 1, 1)) || substr(kind, 2) AS kind, 'lexical' AS why FROM b ORDER BY s DESC, id LIMIT 8""")
def recall_without_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = conversation_graph(spark, sf_dir)
    g.vectors = g.vectors.limit(0)
    return R.memory_search(g, QUESTION, 8, NOW).select("id", F.round("score", 6).alias("score"), "kind", "why")


@query(BEST_SQL.replace("{pool}", "256") + """,
    hit AS (SELECT best.k FROM best JOIN w USING (k) ORDER BY best.s DESC, w.id LIMIT 1),
    around AS (SELECT k FROM hit UNION SELECT b FROM e WHERE a IN (SELECT k FROM hit) UNION SELECT a FROM e WHERE b IN (SELECT k FROM hit))
    SELECT id, kind, label FROM n WHERE k IN (SELECT k FROM around)""")
def related_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.related(conversation_graph(spark, sf_dir), QUESTION, NOW)[0].select("id", "kind", "label")
