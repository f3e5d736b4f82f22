"""A durable store of merged tables: a snapshot, and batches appended since.

Layout below a folder that all executors share (any file system of Spark)::

    snap/v=<n>/{nodes,edges,vectors,heads}  merged tables; nodes are partitioned by kind
    wal/batch=<n>/{nodes,edges,vectors}, wal/batch=<n>/_DONE
    names/<name>                        number of the batch that a stream's own name stands for
    _CURRENT                            JSON: snapshot version, last batch folded, embedder, and batches before it that were not complete

A batch counts once its ``_DONE`` is written, after all its tables: a torn batch
is never read, and may be completed after a checkpoint.  Without batches since, a snapshot is read as it is.  A checkpoint writes a whole new snapshot, then moves ``_CURRENT``
by a rename, then deletes what the snapshot before it had folded; a crash
between leaves the old state readable, and open readers keep theirs.  ``_CURRENT`` also says which embedder the vectors are from.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracegraph.operators.embedders import Embedder
from tracegraph.operators.graph import superseded_by, supersession_heads
from tracegraph.operators.merge import EDGE, NODE, VECTOR, merge_edges, merge_nodes, merge_vectors, with_endpoints
from tracegraph.operators.recall import Graph
from tracegraph.plans.ingest import Mutations, note_mutations, supersession_mutations

TABLES = {"nodes": NODE, "edges": EDGE, "vectors": VECTOR}


class EmbedderMismatch(RuntimeError):
    """The store's vectors come from another embedder."""


class Files:
    """The few file operations of a store, through Hadoop's file system API."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.conf)

    def exists(self, path: str) -> bool:
        p, fs = self._at(path)
        return fs.exists(p)

    def make(self, path: str) -> None:
        p, fs = self._at(path)
        fs.mkdirs(p)

    def names(self, path: str) -> list[str]:
        p, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def delete(self, path: str) -> None:
        p, fs = self._at(path)
        fs.delete(p, True)

    def read(self, path: str) -> str | None:
        p, fs = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Written aside and renamed, so that a reader sees the old text or the new."""
        aside, fs = self._at(path + ".new")
        stream = fs.create(aside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        target, _ = self._at(path)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.isAbsolute() and target.toUri().getScheme() else fs.getUri(), self.conf)
        option = self.jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        options = self.jvm.java.lang.reflect.Array.newInstance(option.getClass(), 1)
        options[0] = option
        context.rename(aside, target, options)


class Store:
    """Open with the embedder in use; another one than the vectors' is refused."""

    def __init__(self, spark: SparkSession, path: str, embedder: Embedder | None = None):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        self.embedder = embedder or Embedder()
        meta = self._meta()
        if meta["embedder"] and meta["embedder"] != [self.embedder.id, self.embedder.dim]:
            raise EmbedderMismatch(f"the store has {meta['embedder']}, not {[self.embedder.id, self.embedder.dim]}")

    def _meta(self) -> dict:
        text = self.files.read(f"{self.path}/_CURRENT")
        return {"version": 0, "folded": 0, "embedder": None, "open": []} | (json.loads(text) if text else {})

    def batches(self) -> list[int]:
        """Complete batches that no snapshot holds yet."""
        return [i for i in self._unfolded() if self.files.exists(f"{self.path}/wal/batch={i}/_DONE")]

    def _unfolded(self) -> list[int]:
        meta = self._meta()
        ids = [int(n[6:]) for n in self.files.names(f"{self.path}/wal") if n.startswith("batch=")]
        return sorted(i for i in ids if i > meta["folded"] or i in meta["open"])

    def next_batch(self) -> int:
        ids = [int(n[6:]) for n in self.files.names(f"{self.path}/wal") if n.startswith("batch=")]
        return max([self._meta()["folded"], *ids]) + 1

    def batch_named(self, name: str) -> int:
        """The batch that ``name`` stands for, now and after any restart; its number is taken before it is told."""
        at = f"{self.path}/names/{name}"
        if number := self.files.read(at):
            return int(number)
        batch = self.next_batch()
        self.files.make(f"{self.path}/wal/batch={batch}")
        self.files.write(at, str(batch))
        return batch

    def append(self, m: Mutations, batch: int) -> int:
        """One durable batch; returns how many records it has (none, or a batch that is complete: nothing is written)."""
        at, meta = f"{self.path}/wal/batch={batch}", self._meta()
        if self.files.exists(f"{at}/_DONE") or batch <= meta["folded"] and batch not in meta["open"]:
            return 0
        for name in TABLES:
            getattr(m, name).write.mode("overwrite").parquet(f"{at}/{name}")
        n = sum(self.spark.read.schema(s).parquet(f"{at}/{name}").count() for name, s in TABLES.items())
        if not n:
            self.files.delete(at)
            return 0
        meta = self._meta()
        if not meta["embedder"]:
            self.files.write(f"{self.path}/_CURRENT", json.dumps(meta | {"embedder": [self.embedder.id, self.embedder.dim]}))
        self.files.write(f"{at}/_DONE", str(n))
        return n

    def _records(self, name: str) -> DataFrame:
        meta = self._meta()
        paths = [f"{self.path}/snap/v={meta['version']}/{name}"] * (meta["version"] > 0) + [f"{self.path}/wal/batch={i}/{name}" for i in self.batches()]
        empty = self.spark.createDataFrame([], TABLES[name])
        if not paths:
            return empty
        # Snapshots are partitioned by kind, batches are not, so each is read by itself.
        out = empty
        for p in paths:
            out = out.unionByName(self.spark.read.schema(TABLES[name]).parquet(p))
        return out

    def graph(self) -> Graph:
        """Snapshot and batches, merged; edges without both ends are left out."""
        version = self._meta()["version"]
        if version and not self.batches():
            at = f"{self.path}/snap/v={version}"
            tables = [self.spark.read.schema(s).parquet(f"{at}/{name}") for name, s in TABLES.items()]
            heads = self.spark.read.schema("id string, head string").parquet(f"{at}/heads") if self.files.exists(f"{at}/heads") else None
            return Graph(*tables, self.embedder, heads)
        nodes = merge_nodes(self._records("nodes"))
        return Graph(nodes, with_endpoints(merge_edges(self._records("edges")), nodes), merge_vectors(self._records("vectors")), self.embedder)

    def checkpoint(self) -> int:
        """A new snapshot of all there is; returns its version."""
        meta, done, open_ = self._meta(), self.batches(), self._unfolded()
        version = meta["version"] + 1
        at = f"{self.path}/snap/v={version}"
        self.files.delete(at)
        g = self.graph()
        g.nodes.repartition("kind", "id").write.partitionBy("kind").parquet(f"{at}/nodes")
        g.edges.write.parquet(f"{at}/edges")
        g.vectors.write.parquet(f"{at}/vectors")
        edges = self.spark.read.schema(EDGE).parquet(f"{at}/edges")
        supersession_heads(superseded_by(edges)).write.parquet(f"{at}/heads")
        folded = max([meta["folded"], *done])
        late = [i for i in open_ if i not in done and i < folded]
        self.files.write(f"{self.path}/_CURRENT", json.dumps({"version": version, "folded": folded, "embedder": meta["embedder"], "open": late}))
        # What this snapshot replaces stays until the next one, for readers that have it open.
        for n in self.files.names(f"{self.path}/wal"):
            if n.startswith("batch=") and int(n[6:]) <= meta["folded"] and int(n[6:]) not in meta["open"]:
                self.files.delete(f"{self.path}/wal/{n}")
        for n in self.files.names(f"{self.path}/snap"):
            if int(n[2:]) < meta["version"]:
                self.files.delete(f"{self.path}/snap/{n}")
        return version

    def note(self, text: str, topic: str | None, now_ms: int) -> int:
        batch = self.next_batch()
        return self.append(note_mutations(self.spark, text, topic, now_ms, batch, self.embedder), batch)

    def detect_supersessions(self) -> int:
        """New supersession edges as one batch; returns their number."""
        batch = self.next_batch()
        return self.append(supersession_mutations(self.graph().nodes, batch), batch)

    def counts(self) -> dict[str, int]:
        g = self.graph()
        superseded = g.edges.where("kind = 'supersedes'").select("to").distinct().count()
        return {"nodes": g.nodes.count(), "edges": g.edges.count(), "vectors": g.vectors.count(), "superseded": superseded}
