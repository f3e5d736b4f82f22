"""Embeddings and vector search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracegraph.functions.text import dot, l2_normalize, let, tokens

BUCKETS = 256
HASH_ID = "hash-v1"


def hash_bag(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, bucket, value``: signed token counts by hash bucket, zeros left out."""
    h = F.unhex(F.substring(F.sha2("token", 256), 1, 10))
    t = df.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("token"))
    byte = lambda i: F.conv(F.substring(F.hex(h), 2 * i + 1, 2), 16, 10).cast("int")
    signed = t.select("id", byte(0).alias("bucket"), F.when(byte(4) % 2 == 1, 1).otherwise(-1).alias("sign"))
    return signed.groupBy("id", "bucket").agg(F.sum("sign").cast("double").alias("value")).where("value <> 0")


def hash_embedding(text: Column) -> Column:
    """The 256 signed token counts of a text at length one, in one expression and without a shuffle."""
    hashed = F.transform(F.transform(tokens(text), lambda t: F.sha2(t, 256)), lambda h: F.struct(
        F.conv(F.substring(h, 1, 2), 16, 10).cast("int").alias("b"),
        F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 1, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("s")))

    def dense(parts: Column) -> Column:
        used = F.array_distinct(F.transform(parts, lambda p: p["b"]))
        sums = F.transform(used, lambda b: F.struct(b, F.aggregate(F.filter(parts, lambda p: p["b"] == b), F.lit(0.0), lambda a, p: a + p["s"])))
        return let(F.map_from_entries(sums), lambda m: F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda i: F.coalesce(F.try_element_at(m, i), F.lit(0.0))))

    return l2_normalize(let(hashed, dense))


def static_embedding(df: DataFrame, table: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, vec``: the mean of the vectors of a text's known tokens, at length one; texts without one are left out.

    ``table`` has ``token, vec``; Spark broadcasts it if its size allows.
    """
    t = df.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("token"))
    parts = t.join(table, "token").select("id", F.posexplode("vec").alias("dim", "x"))
    mean = parts.groupBy("id", "dim").agg(F.avg("x").alias("x"))
    return mean.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda p: p["x"]).alias("vec")).withColumn("vec", l2_normalize(F.col("vec")))


def top_k(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """``id, score`` of the k best by inner product, ties to the smaller id: one scan, k rows from each task."""
    q = F.array(*map(F.lit, map(float, query)))
    return vectors.select("id", dot(F.col("vec"), q).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def _block(vec) -> "np.ndarray":  # noqa: F821
    """An Arrow column of equally long arrays as a matrix; nulls and other lengths are rows of NaN."""
    import numpy as np
    import pyarrow.compute as pc

    n = pc.list_value_length(vec).to_numpy(zero_copy_only=False)
    width = int(np.nanmax(n)) if len(n) and not np.isnan(n).all() else 0
    if width and (n == width).all():
        flat = vec.flatten().to_numpy(zero_copy_only=False)
        return flat.astype(float).reshape(-1, width)
    return np.array([x if x is not None and len(x) == width else [np.nan] * width for x in vec.to_pylist()], float).reshape(-1, width)


def _best(q, names, v, ids, k: int) -> tuple:
    """``query, id, score`` of the k best of a block of vectors for each query of a block; ties to the smaller id."""
    import numpy as np

    if not len(q) or not len(v) or q.shape[1] != v.shape[1]:
        return names[:0], ids[:0], np.zeros(0)
    s = np.nan_to_num(q @ v.T, nan=-np.inf)
    m = min(k, len(v))
    rows, cols = np.nonzero((s >= np.partition(s, len(v) - m, axis=1)[:, len(v) - m, None]) & (s > -np.inf))
    order = np.lexsort((ids[cols], -s[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
    rows, cols = rows[keep], cols[keep]
    return names[rows], ids[cols], s[rows, cols]


#: Vectors and queries in a block.
VECTORS, QUERIES = 8_192, 2_048


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query, id, score, rank``: the k best for each of any number of queries (``query, vec``).

    Both sides are packed into blocks, a row each; a block of vectors and one of
    queries meet by their numbers, in one matrix product, and send k rows for
    each query.  Queries travel once for each block of vectors, vectors once for
    each block of queries; Spark broadcasts the queries if their size allows.
    Vectors and queries of different lengths, nulls and NaN have no score.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    kind, id_kind = queries.schema["query"].dataType.simpleString(), vectors.schema["id"].dataType.simpleString()
    n_q, n_v = max(1, -(-queries.count() // QUERIES)), max(1, -(-vectors.count() // VECTORS))

    def pack(size: int):
        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, size):
                    part = batch.slice(at, size)
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, part.schema) as w:
                        w.write_batch(part)
                    yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block"])

        return run

    out = f"query {kind}, id {id_kind}, score double"
    arrow = spark.createDataFrame([], out).schema

    def score(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        types = to_arrow_schema(arrow)
        for batch in batches:
            for r in batch.to_pylist():
                q, v = (pa.ipc.open_stream(r[x]).read_all().combine_chunks() for x in ("queries", "vectors"))
                names, ids = (x.column(0).to_numpy() for x in (q, v))
                got = _best(_block(q["vec"].combine_chunks()), names, _block(v["vec"].combine_chunks()), ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(got, types)], schema=types)

    number = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n))
    q = queries.select("query", "vec").mapInArrow(pack(QUERIES), "block binary").select(number(n_q).alias("q"), F.col("block").alias("queries"))
    v = vectors.select("id", "vec").mapInArrow(pack(VECTORS), "block binary").select(number(n_v).alias("v"), F.col("block").alias("vectors"))
    pairs = v.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).join(q.withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(n_v - 1)))), ["q", "v"])
    found = pairs.select("queries", "vectors").mapInArrow(score, out)
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def approximate_top_k(vectors: DataFrame, query: list[float], k: int, tables: int = 8, bucket: float = 0.5, seed: int = 7) -> DataFrame:
    """``id, score``: candidates from random projections, ranked by inner product; for unit vectors."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Vectors

    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(vectors.select(array_to_vector("vec").alias("features")))
    found = model.approxNearestNeighbors(vectors.withColumn("features", array_to_vector("vec")), Vectors.dense(query), 4 * k)
    return found.select("id", dot(F.col("vec"), F.array(*map(F.lit, map(float, query)))).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def approximate_top_k_batch(vectors: DataFrame, queries: DataFrame, k: int, tables: int = 8, bucket: float = 0.5, seed: int = 7) -> DataFrame:
    """``query, id, score, rank``: the k best of a query's candidates, those that share one of its random-projection
    buckets; for unit vectors.  Candidates meet in an equality join on (table, bucket)."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    lsh = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed)
    model = lsh.fit(vectors.limit(1).select(array_to_vector("vec").alias("features")))

    def hashed(df: DataFrame, *keep: str) -> DataFrame:
        h = model.transform(df.select(*keep, array_to_vector("vec").alias("features"))).select(*keep, F.posexplode("hashes").alias("table", "h"))
        return h.select(*keep, "table", vector_to_array("h")[0].alias("bucket"))

    near = hashed(vectors, "id").join(hashed(queries, "query"), ["table", "bucket"]).select("query", "id").distinct()
    both = near.join(vectors.select("id", "vec"), "id").join(queries.select("query", F.col("vec").alias("q")), "query")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id"))
    return both.select("query", "id", dot(F.col("vec"), F.col("q")).alias("score")).withColumn("rank", rank).where(F.col("rank") <= k)
