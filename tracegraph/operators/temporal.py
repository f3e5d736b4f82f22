"""As-of lookups and supersession detection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from tracegraph.functions.decisions import superseded_subject

#: Time buckets of one timeline.
BUCKETS = 1024


def _bucketed(times: DataFrame, edges: list[int]) -> DataFrame:
    """``times`` with ``bk``, how many edges lie at or before ``t``; exact below 2**53."""
    from pyspark.ml.feature import Bucketizer

    if not edges:
        return times.withColumn("bk", F.lit(0))
    splits = [-float("inf"), *map(float, edges), float("inf")]
    return Bucketizer(splits=splits, inputCol="t", outputCol="bk").transform(times).withColumn("bk", F.col("bk").cast("int"))


def as_of(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, value: str, by: list[str] | None = None, out: str = "as_of") -> DataFrame:
    """``left`` with the newest ``value`` of ``right`` at or before its time, else the oldest of all; of equal times the largest value.

    Time is cut into buckets at quantiles of the right side's times, so a
    single timeline is spread evenly over many tasks.  Within a bucket (and the
    ``by`` columns of both sides) a running last value over both sides does the
    lookup; what holds at a bucket's start is carried over the buckets that a key
    has.  Only the distinct times of ``left`` are looked up; its rows meet them
    in an equality join, so there is no range join, and many rows of one time
    are one lookup.  A null time takes the newest; a null key finds nothing.
    """
    by = by or []
    keys = [F.col(k) for k in by]
    times = right.where(F.col(right_ts).isNotNull()).select(F.col(right_ts).cast("bigint").alias("t"))
    # Long lists go to Spark as one text, not literal by literal.
    shares = ", ".join(f"{i / BUCKETS}D" for i in range(1, BUCKETS))
    facts = times.agg(F.max("t"), F.expr(f"percentile_approx(t, array({shares}), 10000)")).first()
    high, edges = facts[0], sorted(set(facts[1] or []))

    known = reduce(lambda a, c: a & c, [k.isNotNull() for k in keys], F.lit(True))
    kind = right.schema[value].dataType
    asked = left.select(*keys, F.coalesce(F.col(left_ts).cast("bigint"), F.lit(high)).alias("t")).where(known & F.col("t").isNotNull()).distinct()
    a = asked.select(*keys, "t", F.lit(1).alias("side"), F.lit(None).cast(kind).alias("v"))
    b = right.where(F.col(right_ts).isNotNull() & known).select(*keys, F.col(right_ts).cast("bigint").alias("t"), F.lit(0).alias("side"), F.col(value).alias("v"))
    both = _bucketed(a.unionByName(b), edges)
    seen = F.when(F.col("side") == 0, F.struct("t", "v"))
    # By key and bucket: its last and first value, and what the buckets before it end with.
    each = both.groupBy(*by, "bk").agg(F.max(seen).alias("last"), F.min(seen).alias("first"))
    key = W.partitionBy(*(by or [F.lit(0)]))
    before = key.orderBy("bk").rowsBetween(W.unboundedPreceding, -1)
    each = each.withColumn("carry", F.last("last", ignorenulls=True).over(before)).withColumn("oldest", F.min("first").over(key))
    running = W.partitionBy(*by, "bk").orderBy("t", "side", "v").rowsBetween(W.unboundedPreceding, 0)
    own = F.last(F.when(F.col("side") == 0, F.struct("v")), ignorenulls=True).over(running)
    found = both.withColumn("own", own).where("side = 1").join(each.select(*by, "bk", "carry", "oldest"), [*by, "bk"])
    found = found.select(*[k.alias(f"__k{i}") for i, k in enumerate(keys)], F.col("t").alias("__t"), F.when(F.col("own").isNotNull(), F.col("own.v")).when(F.col("carry").isNotNull(), F.col("carry.v")).otherwise(F.col("oldest.v")).alias("__v"))
    same = [F.col(k) == F.col(f"__k{i}") for i, k in enumerate(by)] + [F.coalesce(F.col(left_ts).cast("bigint"), F.lit(high)) == F.col("__t")]
    return left.join(found, reduce(lambda x, y: x & y, same), "left").select(*[left[c] for c in left.columns], F.col("__v").alias(out))


def supersessions(decisions: DataFrame) -> DataFrame:
    """``from, to``: each decision that names exactly one older decision of its scope as replaced.

    ``decisions`` has ``id, scope, label, ts``.  Whether exactly one is older
    shows in the two earliest of a scope's decisions with the word, so a word
    that all decisions share is one row of the equality join.
    """
    d = decisions.select("id", "scope", F.lower("label").alias("text"), "ts").where(F.coalesce("scope", F.lit("")) != "")
    naming = d.select(F.col("id").alias("from"), "scope", F.col("ts").alias("newer"), superseded_subject(F.col("text")).alias("word")).where("word IS NOT NULL")
    words = d.where("ts IS NOT NULL").select("id", F.col("scope").alias("s"), "ts", F.explode(F.array_distinct(F.split("text", r"[^\p{IsAlphabetic}\p{N}]+"))).alias("w"))
    # Equal rows are one decision; the limit on ranks is taken before the shuffle, too.
    rank = F.dense_rank().over(W.partitionBy("s", "w").orderBy("ts", "id"))
    early = words.withColumn("rank", rank).where("rank <= 2").groupBy("s", "w").agg(
        F.min(F.when(F.col("rank") == 1, F.struct("ts", "id"))).alias("one"), F.min(F.when(F.col("rank") == 2, F.col("ts"))).alias("two"))
    pairs = naming.join(early, (F.col("scope") == F.col("s")) & (F.col("word") == F.col("w")))
    alone = (F.col("one.ts") < F.col("newer")) & (F.col("two").isNull() | (F.col("two") >= F.col("newer")))
    return pairs.where(alone).select("from", F.col("one.id").alias("to")).where("`from` <> `to`").distinct()
