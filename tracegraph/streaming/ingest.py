"""Incremental ingest: transcripts as a file stream, each micro-batch one durable batch of the store."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tracegraph.plans.ingest import session_mutations
from tracegraph.plans.store import Store
from tracegraph.sources.transcripts import CONNECTORS, parse_lines, sessions_of


def ingest_stream(spark: SparkSession, store: Store, source: str, path: str, checkpoint_dir: str, now_ms: int, files_per_batch: int = 1000) -> StreamingQuery:
    """Reads what is new below ``path`` and stops.

    A micro-batch has a name, made of the stream's checkpoint folder and its
    number in the stream, and the store keeps the batch for it.  So one that is
    tried again, in this run or after a restart, finds the same batch: complete,
    and nothing is written, or torn, and it is written anew.
    """
    connector = CONNECTORS[source]
    files = spark.readStream.format("text").schema("value string").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.jsonl").option("maxFilesPerTrigger", files_per_batch).load(path)
    stream = sha256(checkpoint_dir.rstrip("/").encode()).hexdigest()[:16]

    def write(batch: DataFrame, number: int) -> None:
        lines = batch.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
        turns = parse_lines(lines, connector)
        at = store.batch_named(f"{stream}-{number}")
        store.append(session_mutations(sessions_of(turns, connector), turns, now_ms, at, embedder=store.embedder), at)

    named = files.select(F.col("_metadata.file_path").alias("path"), "value")
    return named.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def activity(events: DataFrame, ts: str, width: str = "1 hour", late: str = "2 hours", *keys: str) -> DataFrame:
    """Counts by time window and keys, for a batch or a stream; rows later than ``late`` are dropped from a stream."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")
