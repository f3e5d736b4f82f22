"""Near copies by SimHash, and by MinHash what it can't reach, decided by exact Jaccard similarity.

Two texts link when their sets of 5-word shingles have a Jaccard similarity of
0.8 or more.

1. Equal texts become one node with a SimHash fingerprint of its shingle set.
   ``simhash.links`` proposes all pairs of fingerprints of up to ``DISTANCE``
   differing bits: grouped bits, thresholds by dynamic programming, probes
   verified inside the join.
2. Pairs at 0.8 differ in 10 bits in the mean, too many to probe for.  So each
   node also has ``BANDS`` hashes of ``ROWS`` MinHash values.  A pair at
   similarity s shares no band with probability (1 - s^ROWS)^BANDS: 2.7e-5 at
   0.8, less above.  A link is lost only if it also escapes SimHash, or to a
   sketch of the same values that rules out far pairs of large bands.
3. Proposed pairs are compared on their whole sets.  First, each node meets one
   other of its fingerprint, of a linked one and of its bands, the same for
   many.  Then, where linked fingerprints or a band are not one component yet,
   all nodes of the fingerprints meet if still apart, and the nodes outside the
   band's largest component meet all others: those of a small band
   in a join, those of a large one block by block.  So a group of near copies
   of one text costs comparisons in proportion to its size, no pair that could
   still join two components is left out, and of a large band no pairs are
   rows, but what joins components.  Links of fingerprints are rows, as in op2.
4. Components are those of ``simhash.components``.

Cases: texts without words are copies of each other; a text with up to five
words is one shingle; rows with a null id stay; rows are told apart by id and text.
"""

from __future__ import annotations

from hashlib import md5
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracegraph.llm import simhash
from tracegraph.llm._common import forget, id_and_text, map_slices, materialize
from tracegraph.llm.simhash import LOWER, SEED, WORDS, components, majority

SHINGLE, BANDS, ROWS = 5, 20, 4
#: Bits in which linked fingerprints may differ: by the plans for 15 million
#: fingerprints, 5 needs 67 probes of each and 6 needs 298.
DISTANCE = 5
#: Bits of each MinHash value in a sketch, and how many of the values may differ in them: of 8,000 pairs at 0.80 to 0.82,
#: 14 of the 80 did in the mean and 32 at most.
BITS, APART = 4, 44
#: Nodes of a band that is not dealt into blocks, and of a block.
FEW, BLOCK = 32, 2_048


def shingles(text: str) -> np.ndarray:
    """The distinct 64-bit hashes of a text's word shingles."""
    import xxhash

    w = WORDS(text.translate(LOWER))
    parts = map(" ".join, zip(*(w[i:] for i in range(SHINGLE)))) if len(w) > SHINGLE else [" ".join(w)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64))


def banded():
    """A function from shingle hashes to the hashes of the bands, and BITS bits of each MinHash value in whole numbers."""
    rnd = np.random.default_rng(SEED)
    factor = rnd.integers(0, 2**63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
    shift = rnd.integers(0, 2**63, (BANDS * ROWS, 1), np.uint64)
    fold = rnd.integers(0, 2**63, (BANDS, ROWS), np.uint64) * np.uint64(2) + np.uint64(1)
    salt = rnd.integers(0, 2**63, BANDS, np.uint64)

    def fn(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
        for at in range(0, len(h), 8192):  # bounds the hashes of a very long text
            np.minimum(low, (h[at : at + 8192] * factor + shift).min(axis=1), out=low)
        mixed = low ^ low >> np.uint64(29)
        # A plane for each bit, of two numbers with half of the values each.
        planes = np.zeros((BITS, 2, 64), np.uint8)
        planes[:, :, : BANDS * ROWS // 2] = ((mixed * fold.ravel()) >> np.arange(40, 40 + BITS, dtype=np.uint64)[:, None] & np.uint64(1)).reshape(BITS, 2, -1)
        return ((mixed.reshape(BANDS, ROWS) * fold).sum(axis=1, dtype=np.uint64) + salt).view(np.int64), np.packbits(planes).view(np.int64)

    return fn


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, key, fp, bands, sketch, n``: a digest of the text, its fingerprint, the hashes of its bands, bits of its MinHash values, and the number of its shingles."""

    def make():
        bands = banded()

        def fn(cols: dict) -> dict:
            texts = cols[text_col]
            sets = [shingles(t) for t in texts]
            made = [bands(h) for h in sets]
            fps = np.array([majority(h) for h in sets], np.uint64).view(np.int64).tolist()
            return {"doc_id": cols[id_col], "key": [md5(t.encode()).digest() for t in texts], "fp": fps, "bands": [b.tolist() for b, _ in made], "sketch": [x.tolist() for _, x in made], "n": list(map(len, sets))}

        return fn

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs, make, f"doc_id {kind}, key binary, fp long, bands array<long>, sketch array<long>, n int")


def key_of(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))


def sets_of(docs: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """``node, h``: the shingle hashes of each node of ``nodes`` (key, node)."""
    texts = docs.select(key_of(text_col).alias("k"), text_col).join(nodes, F.col("k") == F.col("key")).select("node", text_col).dropDuplicates(["node"])

    def make():
        return lambda cols: {"node": cols["node"], "h": [shingles(t).view(np.int64).tolist() for t in cols[text_col]]}

    return map_slices(texts, make, "node long, h array<long>")


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose Jaccard similarity is 0.8 or more, in whole numbers."""
    x, y = sets.select(F.col("node").alias("a"), F.col("h").alias("x")), sets.select(F.col("node").alias("b"), F.col("h").alias("y"))
    near = F.expr("9 * size(array_intersect(x, y)) >= 4 * (size(x) + size(y))")
    # Of very different sizes cannot be similar.
    return pairs.join(x, "a").join(y, "b").where(F.expr("5 * least(size(x), size(y)) >= 4 * greatest(size(x), size(y))") & near).select("a", "b")


def block_links(left: pa.Table, right: pa.Table) -> pa.Table:
    """``a, b``: links between two blocks of a band's nodes, no more than what joins their components.

    A pair is looked at in the first band that it shares only.  Sizes and
    sketches rule pairs out, whole sets decide.
    """
    out: list[tuple[int, int]] = []
    if left.num_rows and right.num_rows:
        band = left["band"][0].as_py()
        (node, root, size, bands, sketch), (nodes, roots, sizes, others, sketches) = (
            [t[c].to_numpy() for c in ("node", "root", "size")] + [np.array(t[c].to_pylist(), np.int64) for c in ("bands", "sketch")] for t in (left, right))
        main = right["main"].to_numpy()
        sets, own_sets = ([from_five(x) for x in t["h"].to_pylist()] for t in (right, left))
        root, roots = root.copy(), roots.copy()
        for i in range(len(node)):
            # Of two nodes outside the band's largest component, the smaller one looks.
            c = np.flatnonzero((roots != root[i]) & (main | (nodes > node[i])) & (5 * np.minimum(sizes, size[i]) >= 4 * np.maximum(sizes, size[i])))
            apart = np.bitwise_or.reduce((sketches[c] ^ sketch[i]).reshape(len(c), BITS, 2), axis=1)
            c = c[np.bitwise_count(apart).sum(axis=1) <= APART]
            c = c[~(others[c, :band] == bands[i, :band]).any(axis=1)]
            if not len(c):
                continue
            own, values = own_sets[i], np.concatenate([sets[x] for x in c])
            hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
            common = np.bincount(np.repeat(np.arange(len(c)), sizes[c])[hit], minlength=len(c))
            for x in c[9 * common >= 4 * (sizes[c] + size[i])]:
                if roots[x] != root[i]:
                    out.append((min(node[i], nodes[x]), max(node[i], nodes[x])))
                    was, now = roots[x], root[i]
                    root[root == was], roots[roots == was] = now, now
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def from_five(data: bytes) -> np.ndarray:
    """Sorted 40-bit numbers from five bytes each, the highest first; two different shingles of a pair of texts agree in them by chance once in 10^7 pairs."""
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, 3:] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(">u8").ravel().astype(np.int64)


def close_nodes(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SimHash's links ``a, b`` of fingerprints, and ``node, fp, head`` of the nodes whose fingerprint has a link or
    several nodes; its smallest node is the head."""
    heads = materialize(distinct.groupBy("fp").agg(F.min("node").alias("head"), F.count("*").alias("m")), "near-fingerprints")
    linked = materialize(simhash.links(heads.select("fp"), heads.count(), DISTANCE), "near-links")
    ends = linked.select(F.col("a").alias("fp")).union(linked.select("b")).union(heads.where("m > 1").select("fp")).distinct()
    some = heads.join(ends, "fp", "left_semi").select(F.col("fp").alias("f"), "head")
    close = materialize(distinct.select("node", "fp").join(some, F.col("fp") == F.col("f")).drop("f"), "near-close")
    forget(heads)
    return linked, close


def first_meetings(linked: DataFrame, close: DataFrame) -> DataFrame:
    """``a, b``: each node with the head of its fingerprint, each head with that of one linked fingerprint, the same for many."""
    heads = close.where("node = head").select("fp", "head")
    both = linked.union(linked.select("b", "a"))
    first = both.groupBy("a").agg(F.min(F.struct(F.xxhash64(F.lit("lead"), "b").alias("h"), F.col("b").alias("fp")))["fp"].alias("b"))
    x, y = heads.select(F.col("fp").alias("a"), F.col("head").alias("x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("y"))
    across = first.join(x, "a").join(y, "b").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    return close.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).union(across)


def still_apart(linked: DataFrame, close: DataFrame, label: DataFrame) -> DataFrame:
    """``a, b``: all pairs of nodes of one or of linked fingerprints that are not in one component."""
    label = label.withColumnRenamed("node", "v")
    rooted = materialize(close.join(label, F.col("node") == F.col("v"), "left").select("node", "fp", F.coalesce("root", "node").alias("root")), "near-rooted")
    span = rooted.groupBy("fp").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    x, y = (span.select(F.col("fp").alias(c), F.col("lo").alias(f"{c}_lo"), F.col("hi").alias(f"{c}_hi")) for c in "ab")
    open_ = linked.union(span.where("lo < hi").select("fp", "fp")).join(x, "a").join(y, "b").where("least(a_lo, b_lo) < greatest(a_hi, b_hi)").select("a", "b")
    x, y = (rooted.select(F.col("fp").alias(c), F.col("node").alias(f"{c}_node"), F.col("root").alias(f"{c}_root")) for c in "ab")
    pairs = open_.join(x, "a").join(y, "b").where("a_root <> b_root")
    return pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def links(docs: DataFrame, distinct: DataFrame, text_col: str) -> DataFrame | None:
    """``node, root`` of every node with a link; None without any."""
    bands = distinct.select("node", F.posexplode("bands").alias("band", "bucket"))
    several = bands.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("bucket", "n")
    shared = materialize(bands.join(several, "bucket"), "near-bands")
    linked, close = close_nodes(distinct)
    if shared.isEmpty() and close.isEmpty():
        return None
    some = distinct.join(shared.select("node").union(close.select("node")).distinct(), "node", "left_semi")
    sets = materialize(sets_of(docs, some.select("key", "node"), text_col), "near-sets")
    # At first each node meets one other only: of the first nodes of its bands the one that comes first.
    hashed = F.struct(F.xxhash64(F.lit("lead"), "node").alias("h"), F.col("node").alias("lead"))
    first = shared.groupBy("bucket").agg(F.min(hashed).alias("first"))
    pairs = shared.join(first, "bucket").where("node <> first.lead").groupBy("node").agg(F.min("first")["lead"].alias("lead"))
    met = pairs.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).union(first_meetings(linked, close)).distinct()
    found = materialize(similar(met, sets), "near-edges")
    label = components(found)
    # Pairs of two components have a node outside the largest one of their band: those nodes meet all others.
    now = shared.join(label.withColumnRenamed("node", "v"), F.col("node") == F.col("v"), "left").withColumn("root", F.coalesce("root", "node")).drop("v")
    of = now.groupBy("bucket", "root").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.max(F.struct("m", "root"))["root"].alias("top"), F.count("*").alias("roots"), F.max("m").alias("largest"))
    now = now.join(of.where("roots > 1").drop("roots"), "bucket").withColumn("main", F.col("root") == F.col("top")).drop("top")
    now = materialize(now, "near-open")
    few = now.where(F.col("n") <= FEW)
    rest = few.where(~F.col("main")).select("bucket", "node", "root")
    lead = few.select("bucket", F.col("node").alias("lead"), F.col("root").alias("lead_root"))
    pairs = rest.join(lead, "bucket").where("root <> lead_root")
    pairs = pairs.select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).union(still_apart(linked, close, label)).distinct()
    small = materialize(similar(pairs, sets), "near-edges")
    # Larger bands are dealt into blocks, and blocks meet; the row of a node goes to each block that it meets.
    five = F.expr("unhex(array_join(transform(sort_array(transform(h, x -> x & 1099511627775L)), x -> lpad(hex(x), 10, '0')), ''))")
    facts = some.select("node", "bands", "sketch", F.col("n").alias("size")).join(sets.select(F.col("node").alias("v"), five.alias("h")), F.col("node") == F.col("v")).drop("v")
    many = now.where(F.col("n") > FEW).withColumns({"i": F.ceil((F.col("n") - F.col("largest")) / BLOCK), "j": F.ceil(F.col("n") / BLOCK)}).drop("n", "largest")
    many = many.join(facts, "node")
    place = F.xxhash64(F.lit("block"), "node")
    left = many.where(~F.col("main")).withColumn("i", F.pmod(place, F.col("i"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("j") - 1)))
    right = many.withColumn("j", F.pmod(place, F.col("j"))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("i") - 1)))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, as both come from one table
    large = materialize(left.groupBy("bucket", "i", "j").cogroup(right.groupBy("bucket", "i", "j")).applyInArrow(block_links, "a long, b long"), "near-edges")
    edges = found.union(small).union(large)
    out = None if edges.isEmpty() else components(edges)
    forget(found, small, large, now, label, shared, sets, linked, close)
    return out


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``df``, with the smallest id, of each component; rows with a null id stay."""
    docs = id_and_text(df, id_col, text_col)
    sig = materialize(signatures(docs, id_col, text_col), "near-signatures")
    distinct = sig.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n").alias("n"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "near-distinct")
    label = links(docs, distinct, text_col)
    own = F.when(F.col("first_id").isNotNull(), F.struct("first_id", "key"))
    table = distinct.select("node", "key", own.alias("own"))
    if label is not None:
        tree = table.join(label, "node").groupBy("root").agg(F.min("own").alias("low"))
        of = label.join(tree, "root").select("node", "low")
        table = table.join(of, "node", "left").withColumn("own", F.coalesce("low", "own"))
    table = materialize(table.select(F.col("key").alias("k"), F.col("own.first_id").alias("low_id"), F.col("own.key").alias("low_key")), "near-components")
    rows = sig.where(F.col("doc_id").isNotNull()).select("doc_id", "key").join(table, F.col("key") == F.col("k"))
    gone = rows.where("doc_id <> low_id OR key <> low_key").select(F.col("doc_id").alias("__id"), F.col("key").alias("__gone"))
    out = df.withColumn("__key", key_of(text_col)).join(gone, (F.col(id_col) == F.col("__id")) & (F.col("__key") == F.col("__gone")), "left_anti")
    twice = sig.where(F.col("doc_id").isNotNull()).groupBy("doc_id", "key").count().where("count > 1")
    if twice.isEmpty():
        return out.drop("__key")
    once = out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, "__key"])
    return once.unionByName(out.where(F.col(id_col).isNull())).drop("__key")
