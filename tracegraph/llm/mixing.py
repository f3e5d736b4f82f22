"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

DataFrame functions only.  Steps:

1. Sizes in words, totals by source, and targets: all words shared by weight,
   no source above ``cap`` times its size, the excess reshared.
2. Each source is an ordered run of words (documents in hashed order) cut into
   blocks of near-equal length.  Its exact quota is a number of block draws:
   whole passes over its blocks, then a part of one more pass, whose last block
   is cut so that the words meet the target.
3. A binary tree splits the quotas of all sources among ``2 ** levels`` output
   shards.  Each node sends half of its draws to the left; how many of each
   source go there is drawn from the multivariate hypergeometric distribution,
   item by item, with hashed uniform numbers, so reruns agree.
4. Each shard draws exactly the tree's count of blocks of each source: disjoint
   ranges of the source's permuted passes.  Words and documents are taken only
   through these draws, and lie in a hashed order within their shard.

Sizes of what one task handles: all sources in a row each (the tree holds an
entry for each in an array), the draws of the last pass of one source, and the
documents of one block or one hashed bucket of a source.  A block has about a
``BLOCKS``-th of all words and ``BLOCK_WORDS`` at most, a shard about
``SHARD_WORDS``, so a hot source is many blocks and 100 TB are some millions of draws.

Cases: a null or empty text has size 0, takes nothing and is in no shard; a null
source is a source, the last; a table without words takes nothing and an empty
one has no rows; rows with the same doc_id are separate rows, equal ones are
interchangeable; a long text is many blocks' words; other columns are ignored by
``mix`` and kept by ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tracegraph.llm._common import materialize

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Blocks of all sources together, about, unless they had more words than BLOCK_WORDS.
BLOCKS = 4_096
BLOCK_WORDS = 1 << 22
#: Words of a shard, about, where 2 ** LEVELS shards would hold more.
SHARD_WORDS = 1 << 28
LEVELS = 4
#: Documents of one source that a window sorts together, about.
BUCKET_ROWS = 50_000
#: Parts of a shard that are shuffled, sorted and written together.
PIECES = 16


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *keep: str) -> DataFrame:
    """``doc_id, source, size``, a number ``row`` and a hash ``h`` of id and text, written once: later steps never touch the texts.

    ``keep`` are columns of ``df`` to write along, under the names ``keep_0``, ``keep_1``, ...
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")]
    made = [F.xxhash64(F.lit("mix"), F.col(id_col), text).alias("h"), F.monotonically_increasing_id().alias("row")]
    return materialize(df.select(*own, *made, *[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)]), "mix-sizes")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3) -> DataFrame:
    """A row per source: ``source, place, source_size, target``.

    Sources in the order of their capacity for each unit of weight: the first
    ones fill up, the rest share what is left by weight.
    """
    every = W.partitionBy(F.lit(0))
    t = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    t = t.withColumn("place", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())).cast("long"))
    t = t.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int")))
    t = t.withColumn("room", F.col("source_size") * cap).withColumn("ratio", F.col("room") / F.col("weight"))
    before = every.orderBy("ratio", "place").rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("used", F.coalesce(F.sum("room").over(before), F.lit(0))).withColumn("spent", F.coalesce(F.sum("weight").over(before), F.lit(0)))
    t = t.withColumn("level", (F.sum("source_size").over(every) - F.col("used")) / (F.sum("weight").over(every) - F.col("spent")))
    t = t.withColumn("first_level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level"))).over(every)["level"])
    return t.select("source", "place", "source_size", F.least(F.col("room").cast("double"), F.coalesce("first_level", F.lit(0.0)) * F.col("weight")).alias("target"))


def block_first(j: str) -> Column:
    """The first word of block ``j`` of a source; blocks differ by a word at most."""
    return F.expr(f"({j}) * (source_size div blocks) + (({j}) * (source_size % blocks)) div blocks")


def block_words(j: str) -> Column:
    return block_first(f"({j}) + 1") - block_first(j)


def permuted(i: str, turn: str, seed: int) -> Column:
    """The ``i``-th block of pass ``turn``: each round keeps the numbers below ``blocks``, a power of two, apart."""
    return F.expr(f"""
        aggregate(array(0L, 1L, 2L), {i}, (x, r) -> pmod((x ^ shiftright(x, greatest(1, length(bin(blocks)) div 2)))
            * (2 * pmod(xxhash64({seed}L, place, {turn}, r, 0L), 1048576L) + 1) + pmod(xxhash64({seed}L, place, {turn}, r, 1L), blocks), blocks))""")


def quotas(goal: DataFrame, unit: int, seed: int) -> DataFrame:
    """Block draws of each source: ``blocks``, ``passes`` whole passes, ``draws`` in all, and the words ``last_words`` of a cut last one."""
    g = goal.withColumn("blocks", F.expr(f"shiftleft(1L, length(bin(greatest(1L, source_size div {unit}L))) - 1)"))
    g = g.withColumn("words", F.round("target").cast("long"))
    g = g.withColumn("passes", F.expr("if(source_size = 0, 0L, words div source_size)")).withColumn("rest", F.expr("words - passes * source_size"))
    part = g.where("rest > 0").withColumn("i", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumn("block", permuted("i", "passes", seed))
    part = part.withColumn("words", block_words("block")).withColumn("before", F.sum("words").over(W.partitionBy("place").orderBy("i")) - F.col("words"))
    part = part.where("before < rest").groupBy(F.col("place").alias("p")).agg(F.count("*").alias("part"), F.max_by(F.least("words", F.col("rest") - F.col("before")), "i").alias("last_words"))
    g = g.join(part, F.col("place") == F.col("p"), "left")
    return g.select(*goal.columns, "blocks", "passes", F.expr("passes * blocks + coalesce(part, 0L)").alias("draws"), "last_words")


def split_tree(quota: DataFrame, levels: int, seed: int) -> DataFrame:
    """``shard, place, n``: the exact number of draws of each source in each shard."""
    node = quota.agg(F.array_sort(F.collect_list(F.struct(F.col("place").alias("p"), F.col("draws").alias("k")))).alias("q")).select(F.lit(0).cast("long").alias("node"), "q")
    for level in range(levels):
        if level and level % 4 == 0:
            node = node.repartition(1 << level, "node")
        node = node.withColumn("total", F.expr("aggregate(q, 0L, (a, x) -> a + x.k)"))
        node = node.withColumn("left", F.expr(f"""
            aggregate(q, struct(total AS open, total div 2 AS want, cast(array() AS array<bigint>) AS out),
                (a, x) -> named_struct('open', a.open - x.k, 'want', a.want - aggregate(filter(sequence(0L, x.k), t -> t > 0), 0L,
                        (n, t) -> n + if((a.want - n) > (a.open - t + 1) * (pmod(xxhash64({seed}L, {level}L, node, x.p, t), 4503599627370496L) / 4503599627370496D), 1L, 0L)),
                    'out', array_append(a.out, a.want)),
                a -> array_append(a.out, a.want))"""))
        # ``left`` holds what was still wanted before each source, so differences are the counts drawn.
        node = node.withColumn("half", F.explode(F.expr("""array(
            struct(node * 2 AS node, transform(q, (x, i) -> struct(x.p AS p, left[i] - left[i + 1] AS k)) AS q),
            struct(node * 2 + 1 AS node, transform(q, (x, i) -> struct(x.p AS p, x.k - left[i] + left[i + 1] AS k)) AS q))""")))
        node = node.select("half.node", "half.q")
    return node.select(F.col("node").alias("shard"), F.explode("q").alias("x")).select("shard", F.col("x.p").alias("place"), F.col("x.k").alias("n"))


def drawn_blocks(quota: DataFrame, levels: int, seed: int) -> DataFrame:
    """Every drawn block: ``place, shard, draw, pass, block, first, words``.

    The rows are the tree's: a shard has ``n`` consecutive draws of a source, after those of the shards before it.
    """
    dealt = split_tree(quota, levels, seed).withColumn("low", F.sum("n").over(W.partitionBy("place").orderBy("shard")) - F.col("n"))
    d = dealt.where("n > 0").withColumn("draw", F.explode(F.expr("sequence(low, low + n - 1)")))
    d = d.join(quota.drop("source", "target"), "place").withColumn("pass", F.expr("draw div blocks")).withColumn("block", permuted("draw % blocks", "pass", seed))
    words = F.when(F.col("draw") == F.col("draws") - 1, F.col("last_words"))
    return d.select("place", "shard", "draw", "pass", "block", block_first("block").alias("first"), F.coalesce(words, block_words("block")).alias("words"))


def placed(sized: DataFrame, rows: int) -> DataFrame:
    """Documents with words, and their first word's place ``start`` in their source's hashed order.

    Two-level running sums: within hashed buckets of a source, then over the buckets' totals.
    """
    n = 256
    while n * BUCKET_ROWS < rows and n < 1 << 20:
        n *= 2
    d = sized.where("size > 0").withColumn("bucket", F.pmod("h", F.lit(n)))
    inner = d.withColumn("start", F.sum("size").over(W.partitionBy("source", "bucket").orderBy("h", "doc_id", "row").rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    totals = d.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    totals = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), (F.sum("bucket_size").over(W.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")).alias("base"))
    both = inner.join(totals, inner["source"].eqNullSafe(totals["s"]) & (inner["bucket"] == totals["b"]))
    return both.select("row", "doc_id", "source", "size", "h", (F.col("start") + F.col("base")).alias("start"))


def block_of(x: str) -> Column:
    """The block of a source's word ``x``."""
    return F.expr(f"(cast(({x}) + 1 AS decimal(20, 0)) * blocks - 1) div source_size")


class Mix:
    """The tables of a mix: ``quota`` by source, ``blocks`` drawn, and ``placed`` documents with their source's numbers."""

    def __init__(self, sized: DataFrame, weights: tuple[int, ...], cap: int, levels: int | None, seed: int):
        facts = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
        words = facts[1]
        if levels is None:
            levels = max(LEVELS, (-(-words // SHARD_WORDS) - 1).bit_length())
        unit = max(1, min(BLOCK_WORDS, words // BLOCKS))
        self.quota = materialize(quotas(targets(sized, weights, cap), unit, seed), "mix-quotas")
        self.blocks = materialize(drawn_blocks(self.quota, levels, seed), "mix-blocks")
        s = self.quota.withColumnRenamed("source", "s").select("s", "place", "source_size", "target", "blocks")
        d = placed(sized, facts[0])
        self.placed = d.join(s, d["source"].eqNullSafe(s["s"])).drop("s")


def mix(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, levels: int | None = None, seed: int = 17, **cols: str) -> DataFrame:
    """A row per document: ``doc_id, size, source_size, target, taken, copies, shards``.

    ``taken`` is in words, repeats counted; ``shards`` lists the words taken by
    each shard, as ``shard:words``, comma-joined.  ``copies`` is how often the
    word in the document's middle is drawn: the whole-document form of the mix.
    """
    sized = sizes(df, **cols)
    m = Mix(sized, weights, cap, levels, seed)
    draws = m.blocks.groupBy(F.col("place").alias("p"), F.col("block").alias("b")).agg(F.first("first").alias("first"), F.collect_list(F.struct("shard", "words")).alias("draws"))
    d = m.placed.withColumn("middle", F.expr("start + (size - 1) div 2"))
    d = d.withColumn("block", F.explode(F.sequence(block_of("start"), block_of("start + size - 1"))))
    d = d.join(draws, (F.col("place") == F.col("p")) & (F.col("block") == F.col("b")), "left")
    d = d.withColumn("got", F.expr("filter(transform(draws, x -> struct(x.shard AS shard, least(start + size, first + x.words) - greatest(start, first) AS words)), x -> x.words > 0)"))
    d = d.withColumn("twice", F.expr("size(filter(draws, x -> middle >= first AND middle < first + x.words))"))
    one = [F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")]
    d = d.groupBy("row").agg(*one, F.flatten(F.collect_list("got")).alias("got"), F.coalesce(F.sum(F.greatest("twice", F.lit(0))), F.lit(0)).cast("int").alias("copies"))
    shards = "transform(array_sort(array_distinct(transform(got, x -> x.shard))), s -> concat(s, ':', aggregate(filter(got, x -> x.shard = s), 0L, (a, x) -> a + x.words)))"
    d = d.select("doc_id", "size", "source_size", "target", F.expr("aggregate(got, 0L, (a, x) -> a + x.words)").alias("taken"), "copies", F.array_join(F.expr(shards), ",").alias("shards"))
    s = m.quota.select(F.col("source").alias("s"), "source_size", "target")
    none = sized.where("size = 0").join(s, F.col("source").eqNullSafe(F.col("s")))
    return d.unionByName(none.select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).alias("copies"), F.lit("").alias("shards")))


def mixed_documents(df: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = 3, levels: int | None = None, seed: int = 17, places: bool = False, **cols: str) -> DataFrame:
    """Whole documents, one for each draw of the word in their middle, with the columns of ``df``.

    They are dealt by shard and lie in hashed order within a piece of it;
    ``places`` adds the columns ``shard, position`` that say so.
    """
    sized = sizes(df, cols.get("id_col", "doc_id"), cols.get("text_col", "text"), cols.get("source_col", "source"), *df.columns)
    m = Mix(sized.select("doc_id", "source", "size", "h", "row"), weights, cap, levels, seed)
    d = m.placed.withColumn("middle", F.expr("start + (size - 1) div 2")).withColumn("block", block_of("middle"))
    draws = m.blocks.select(F.col("place").alias("p"), F.col("block").alias("b"), "shard", "draw", "first", "words")
    d = d.join(draws, (F.col("place") == F.col("p")) & (F.col("block") == F.col("b"))).where("middle < first + words")
    d = d.select(F.col("row").alias("r"), "shard", F.xxhash64(F.lit(seed).cast("long"), "shard", "place", "draw", "h").alias("position"))
    out = sized.join(d, F.col("row") == F.col("r")).withColumn("piece", F.pmod("position", F.lit(PIECES)))
    out = out.repartition("shard", "piece").sortWithinPartitions("shard", "piece", "position", "row")
    return out.select(*[F.col(f"keep_{i}").alias(c) for i, c in enumerate(df.columns)], *(["shard", "position"] if places else []))
