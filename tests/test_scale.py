"""Beyond former bounds, skewed sides, restarts and the choice of embedder."""

import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from tracegraph.operators import embedders, graph as G, merge as M, temporal as T, vectors as V
from tracegraph.plans import api
from tracegraph.plans.ingest import note_mutations, stamp_commits
from tracegraph.plans.store import EmbedderMismatch, Store
from tracegraph.sources import transcripts
from tracegraph.streaming.ingest import ingest_stream


def test_any_number_of_folders_is_stamped(spark):
    n = 100_050
    s = spark.range(n).select(F.col("id").cast("string").alias("path"), F.concat(F.lit("/r/f"), F.col("id").cast("string")).alias("repo_root"), F.lit(None).cast("string").alias("commit"), F.lit(5).cast("bigint").alias("started_at_ms"))
    turns = spark.createDataFrame([], "path string, pos int, ts_ms long")
    commits = spark.createDataFrame([(1, "a"), (9, "b")], "time_ms long, oid string")
    assert stamp_commits(s, turns, commits, "/r", nested=["f7"]).where("commit = 'a'").count() == n - 1


def test_long_chains_and_cycles(spark):
    n = (1 << 16) + 20
    chain = spark.range(n).select(F.col("id").cast("string").alias("id"), (F.col("id") + 1).cast("string").alias("by"))
    links = chain.union(spark.createDataFrame([("x", "y"), ("y", "x"), ("w", "x")], "id string, by string"))
    heads = G.supersession_heads(links)
    assert heads.where(F.col("head") == str(n)).count() == n and heads.where("head IS NULL").count() == 3


def test_as_of_with_an_outlier_a_hot_time_and_null_keys(spark):
    c = spark.range(2000).select((F.col("id") * 10).alias("t"), F.col("id").alias("v")).union(spark.createDataFrame([(10**15, -1)], "t long, v long"))
    left = spark.range(30_000).select("id", F.when(F.col("id") % 3 == 0, 7777).otherwise(F.col("id") - 5).alias("ts"))
    got = {r["id"]: r["as_of"] for r in T.as_of(left, c, "ts", "t", "v").collect()}
    assert len(got) == 30_000
    for i in (0, 3, 1, 2, 4, 1000, 19_999, 29_999):
        at = 7777 if i % 3 == 0 else i - 5
        assert got[i] == (max(0, min(1999, at // 10)))
    keyed = c.where("t < 100").withColumn("k", F.when(F.col("v") % 2 == 0, "a"))
    rows = spark.createDataFrame([("a", 35), ("b", 35), (None, 35)], "k string, ts long")
    assert {r["k"]: r["as_of"] for r in T.as_of(rows, keyed, "ts", "t", "v", by=["k"]).collect()} == {"a": 2, "b": None, None: None}


def test_a_word_that_all_decisions_share(spark):
    d = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.lit("s").alias("scope"), F.lit("Use the store instead of the store").alias("label"), F.col("id").alias("ts"))
    rows = T.supersessions(d).collect()
    assert [tuple(r) for r in rows] == [("1", "0")]  # only the second one has exactly one before it


def test_edges_keep_the_first_ones_attributes(spark):
    e = spark.createDataFrame([("a", "b", "x", 1.0, {"p": "1", "q": "2"}, 5), ("a", "b", "x", 2.0, {"p": "9"}, 7), ("a", "c", "x", 1.0, None, 1)], M.EDGE)
    got = {r["to"]: (r["weight"], r["attrs"], r["seq"]) for r in M.merge_edges(e).collect()}
    assert got == {"b": (1.0, {"p": "1", "q": "2"}, 5), "c": (1.0, {}, 1)}


def test_any_number_of_queries(spark):
    n = 200_010
    q = spark.range(n).select(F.col("id").alias("query"), F.array(F.col("id") % 7 * 1.0, F.lit(1.0)).alias("vec"))
    v = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)] + [(9, None), (10, [float("nan"), 1.0]), (11, [1.0])], "id long, vec array<double>")
    got = V.top_k_batch(v, q, 2)
    assert got.count() == 2 * n
    assert got.where("query % 7 > 0 AND rank = 1 AND id <> 4").isEmpty() and got.where("query % 7 = 0 AND rank = 1 AND id <> 0").isEmpty()
    assert V.top_k_batch(v, q.limit(0), 2).count() == 0 and V.top_k_batch(v.limit(0), q.limit(3), 2).count() == 0


def session(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.jsonl", "w") as f:
        f.write(json.dumps({"type": "user", "message": {"content": text}}) + "\n")


def test_a_batch_retried_after_a_restart_is_the_same_batch(spark, tmp_path):
    folder, check = str(tmp_path / "in"), str(tmp_path / "cp")
    store = Store(spark, str(tmp_path / "store"))
    session(folder, "one", "a first question about the store")
    ingest_stream(spark, store, "claude_code", folder, check, 5).awaitTermination(120)
    store.note("something between", None, 6)
    for done in glob.glob(f"{check}/commits/*") + glob.glob(f"{check}/commits/.*"):
        os.remove(done)  # as if the stream had died before it noted its batch
    ingest_stream(spark, store, "claude_code", folder, check, 5).awaitTermination(120)
    assert store.batches() == [1, 2]
    session(folder, "two", "a second question about the store")
    ingest_stream(spark, store, "claude_code", folder, check, 5).awaitTermination(120)
    assert store.batches() == [1, 2, 3] and store.graph().nodes.where("kind = 'turn'").count() == 2


def test_a_batch_completed_after_a_checkpoint_counts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    late = store.batch_named("late")
    store.note("noted meanwhile", None, 1)
    store.checkpoint()
    assert store.batch_named("late") == late and store.batches() == []
    assert store.graph().heads is not None
    assert store.append(note_mutations(spark, "late note", None, 2, late), late) == 2
    assert store.graph().nodes.count() == 2
    store.checkpoint()
    store.checkpoint()
    assert Store(spark, store.path).graph().nodes.count() == 2 and store.append(note_mutations(spark, "x", None, 2, late), late) == 0


def test_word_vectors_from_index_to_ask(spark, tmp_path):
    vectors = str(tmp_path / "w.txt")
    with open(vectors, "w") as f:
        f.write("database 1 0\nstore 0.9 0.1\nbanana 0 1\n")
    session(str(tmp_path / "in"), "a", "which database shall we take")
    session(str(tmp_path / "in"), "b", "a banana for lunch please")
    at = str(tmp_path / "store")
    found = api.index(spark, at, 5, sessions=f"file://{tmp_path}/in", backend="static", model=vectors)
    assert found["vectors"] == 4
    best = api.ask(spark, at, "store", 5, backend="static", model=vectors).first()
    assert best["why"] == "semantic" and "database" in best["snippet"]
    with pytest.raises(EmbedderMismatch):
        api.ask(spark, at, "store", 5)
    for bad in (("static", None), ("neural", "x")):
        with pytest.raises(ValueError):
            embedders.choose(spark, *bad)


def test_paths_with_a_scheme(spark, tmp_path):
    session(str(tmp_path / "in/deep"), "a", "hello there")
    c = transcripts.CONNECTORS["claude_code"]
    one = transcripts.resolve(c, f"file://{tmp_path}/in", spark)
    assert [x.removeprefix("file:") for x in one] == [f"{tmp_path}/in/deep/a.jsonl"]
    assert transcripts.resolve(c, f"file://{tmp_path}/in/deep/a.jsonl", spark) == [f"file://{tmp_path}/in/deep/a.jsonl"]
    with pytest.raises(FileNotFoundError):
        transcripts.resolve(c, f"file://{tmp_path}/missing", spark)
    assert api.index(spark, str(tmp_path / "s"), 5, sessions=f"file://{tmp_path}/in", dry_run=True) == {"sessions": 1, "turns": 1} and not (tmp_path / "s").exists()
