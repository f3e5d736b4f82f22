"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Documents handed to a worker function at once; bounds Python-side memory.
SLICE = 256


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder.

    Only in a local session without ``spark.checkpoint.dir`` (tests) is a
    temporary folder made and remembered; a cluster without one is refused.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tracegraph.shared.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tracegraph-")
        spark.conf.set("tracegraph.shared.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage so a
    lost executor costs a re-read, not a recomputation."""
    path = shared_dir(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    out = df.sparkSession.read.schema(schema).parquet(path)
    out._shared_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what ``materialize`` wrote for these tables; nothing may read them any more."""
    for df in tables:
        if path := getattr(df, "_shared_path", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def id_and_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *extra: str) -> DataFrame:
    """Only the needed columns, a null text as the empty string."""
    return df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col), *[F.col(c) for c in extra])


def map_slices(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, rows: int = SLICE) -> DataFrame:
    """``mapInArrow`` in slices of ``rows`` rows.

    ``make`` runs once in each task and returns a function from a dict of
    column lists to a dict of output lists.
    """
    out_schema = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fn, arrow = make(), to_arrow_schema(out_schema)
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                got = fn({k: part.column(i).to_pylist() for i, k in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)
