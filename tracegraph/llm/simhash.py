"""SimHash near-duplicates by a generalised pigeonhole.

A fingerprint is the majority of the XXH64 bits of a text's word shingles.  Two
fingerprints link at up to ``distance`` differing bits.  To find all links,

1. the bits are grouped: correlated ones go to the same partition;
2. dynamic programming gives each partition its own threshold ``t_i`` (-1: not
   probed) with ``sum(t_i + 1) = distance + 1``, at the least estimated cost of
   probes and candidates; the numbers of partitions compared are 2 to 4.
   A linked pair then differs in at most ``t_i`` bits in some partition;
3. each fingerprint probes its partitions with every variant of up to ``t_i``
   flipped bits and the candidates are verified inside the join.

Grouping and estimates come from a bounded sample of distinct fingerprints and
only steer the cost, never the result.  Copies of a fingerprint are one row
throughout, so groups of copies make no pairs.  Components are found by hooking
and shortcutting over written tables; nothing of all documents comes to the
driver but counts.

Cases: a null or empty text, or one without words, has fingerprint zero, which
links like any other; a text with fewer words than a shingle is one shingle;
repeated rows are in one component; rows with a null doc_id keep a null
component unless they are linked to a row with an id; other columns are ignored.
"""

from __future__ import annotations

import re
from itertools import combinations, repeat
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracegraph.llm._common import forget, id_and_text, map_slices, materialize

WORDS = re.compile(r"[^\x20\x09-\x0D]+").findall
LOWER = {c: c + 32 for c in range(65, 91)}
SEED = 42
BITS = 64
#: Distinct fingerprints from which groups and costs are estimated.
SAMPLE = 8_192
#: Cost of verifying a candidate, in probes.
VERIFY = 0.2


def fingerprint(text: str, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text."""
    import xxhash

    w = WORDS(text.translate(LOWER))
    if not w:
        return 0
    parts = map(" ".join, zip(*(w[i:] for i in range(shingle)))) if len(w) > shingle else [" ".join(w)]
    return majority(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits set in over half the hashes."""
    total = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 8192):  # bounds the unpacked bits of a very long text
        total += np.unpackbits(h[at : at + 8192].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(h)).tobytes(), "big")


def fingerprints(df: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed 64-bit number."""
    docs = id_and_text(df, id_col, text_col)

    def make():
        def fn(cols: dict) -> dict:
            fps = np.array([fingerprint(t, shingle) for t in cols[text_col]], np.uint64).view(np.int64)
            return {"doc_id": cols[id_col], "fp": fps.tolist()}

        return fn

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs, make, f"doc_id {kind}, fp long")


def bits_of(sample: np.ndarray) -> np.ndarray:
    """A 0/1 row per fingerprint; column b is bit b, the lowest first."""
    return (sample[:, None] >> np.arange(BITS, dtype=np.uint64) & np.uint64(1)).astype(np.int8)


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of near-equal width, each grown greedily by the bit most correlated with it."""
    x = bits - bits.mean(axis=0) if len(bits) else np.zeros((1, BITS))
    norm = np.sqrt((x**2).sum(axis=0))
    corr = np.abs(x.T @ x) / np.maximum(np.outer(norm, norm), 1e-9)
    free, out = list(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        group = [free.pop(int(np.argmax(corr[np.ix_(free, free)].sum(axis=1))))]
        while len(group) < width:
            group.append(free.pop(int(np.argmax(corr[np.ix_(free, group)].sum(axis=1)))))
        out.append(sorted(group))
    return out


def candidate_rate(bits: np.ndarray, group: list[int], most: int) -> list[float]:
    """Estimated share of pairs within 0..most bits in a group, from sampled pairs."""
    n = len(bits)
    if n < 2:
        return [2.0 ** -len(group) * sum(comb(len(group), j) for j in range(t + 1)) for t in range(most + 1)]
    seen = np.zeros(most + 1)
    shifts = [s for s in range(1, n) if s < 64]
    for s in shifts:
        d = (bits[:, group] != np.roll(bits[:, group], s, axis=0)).sum(axis=1)
        for t in range(most + 1):
            seen[t] += (d <= t).sum()
    even = [2.0 ** -len(group) * sum(comb(len(group), j) for j in range(t + 1)) for t in range(most + 1)]
    return [max(a / (n * len(shifts)), e) for a, e in zip(seen, even)]


def allocate(groups: list[list[int]], rates: list[list[float]], n: int, distance: int) -> tuple[float, list[int]]:
    """The cheapest thresholds with sum(t + 1) = distance + 1, by dynamic programming over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for group, rate in zip(groups, rates):
        nxt: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for t in range(-1, distance - spent + 1):
                own = 0.0 if t < 0 else 1 + sum(comb(len(group), j) for j in range(t + 1)) + VERIFY * rate[t] * n
                key = spent + t + 1
                if key not in nxt or cost + own < nxt[key][0]:
                    nxt[key] = (cost + own, [*chosen, t])
        best = nxt
    return best[distance + 1]


def plan(distinct: DataFrame, n: int, distance: int) -> list[tuple[list[int], int]]:
    """Partitions and their thresholds for ``n`` distinct fingerprints."""
    # Evenly over all hash values, so that the sample is as many rows at any size.
    rows = distinct.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, n // SAMPLE))) == 0).limit(2 * SAMPLE).collect()
    sample = np.sort(np.array([r["fp"] for r in rows], np.int64).view(np.uint64))
    bits = bits_of(np.random.default_rng(SEED).permutation(sample))
    options = []
    for m in range(2, distance + 2):
        groups = group_bits(bits, m)
        cost, t = allocate(groups, [candidate_rate(bits, g, distance) for g in groups], n, distance)
        options.append((cost, m, list(zip(groups, t))))
    return min(options)[2]


def mask_of(bits) -> int:
    """A signed 64-bit number with the given bits set."""
    return int(np.uint64(sum(1 << b for b in bits)).view(np.int64))


def links(distinct: DataFrame, n: int, distance: int = 3) -> DataFrame:
    """``a, b``: each linked pair of different fingerprints once, a < b."""
    parts = [(i, mask_of(g), [mask_of(c) for j in range(t + 1) for c in combinations(g, j)]) for i, (g, t) in enumerate(plan(distinct, n, distance)) if t >= 0]
    fp = F.col("fp")
    index = F.array(*[F.struct(F.lit(i).alias("part"), fp.bitwiseAND(F.lit(m)).alias("key")) for i, m, _ in parts])

    def variants(i: int, mask: int, flips: list[int]) -> Column:
        return F.transform(F.array(*map(F.lit, flips)), lambda x: F.struct(F.lit(i).alias("part"), fp.bitwiseAND(F.lit(mask)).bitwiseXOR(x).alias("key")))

    probe = F.concat(*[variants(*p) for p in parts])
    left = distinct.select(fp.alias("a"), F.inline(probe))
    right = distinct.select(fp.alias("b"), F.inline(index)).withColumnsRenamed({"part": "p", "key": "k"})
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return left.join(right, (F.col("part") == F.col("p")) & (F.col("key") == F.col("k")) & close).select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node reachable, for every node with an edge.

    Each round, every root hooks to the smallest label next to its tree, every
    node takes the smallest label next to it, and labels are shortcut twice; the
    rounds grow with the logarithm of the longest chain.
    """
    both = materialize(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a")), "links")
    label = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root")), "roots")
    while True:
        near = both.join(label, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        seen = materialize(label.join(near, F.col("node") == F.col("u")).select("node", "root", F.least("root", "near").alias("low")), "roots-near")
        hook = seen.groupBy(F.col("root").alias("old")).agg(F.min("low").alias("new"))
        hooked = materialize(seen.join(hook, F.col("root") == F.col("old")).select("node", F.least("low", "new").alias("root"), F.col("root").alias("was")), "roots-hooked")
        jump = hooked.select(F.col("node").alias("via"), F.col("root").alias("to"))
        after = hooked
        for _ in range(2):
            after = after.join(jump, F.col("root") == F.col("via")).select("node", F.col("to").alias("root"), "was")
        forget(label)
        after = materialize(after, "roots")
        forget(seen, hooked)
        label = after.select("node", "root")
        label._shared_path = after._shared_path
        if after.where("root <> was").isEmpty():
            forget(both)
            return label


def near_duplicates(df: DataFrame, distance: int = 3, shingle: int = 3, **cols: str) -> DataFrame:
    """``doc_id, fp, component_id, root``: the smallest doc_id reachable over links of up to ``distance`` bits, and the
    fingerprint that stands for the component (ids that have several texts may be the smallest of several)."""
    fps = materialize(fingerprints(df, shingle, **cols), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    n = distinct.count()
    edges = materialize(links(distinct.select("fp"), n, distance), "edges")
    linked = components(edges)
    tree = linked.join(distinct, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("first_id").alias("low"))
    of = linked.join(tree, "root").select(F.col("node").alias("fp"), "low", "root")
    table = distinct.join(of, "fp", "left").select(F.col("fp").alias("key"), F.coalesce("low", "first_id").alias("component_id"), F.coalesce("root", "fp").alias("root"))
    table = materialize(table, "components")
    # Written first, so that both sides are dealt anew and adaptive execution can split a hot fingerprint.
    return fps.join(table, F.col("fp") == F.col("key")).select("doc_id", "fp", "component_id", "root")


def digests(df: DataFrame) -> DataFrame:
    """The fingerprint as 16 hex digits."""
    return near_duplicates(df).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of ``df``, of the smallest id, for each component; rows with a null id stay.

    Rows are told apart by id and fingerprint: an id that has several texts may keep some of them.
    """
    found = materialize(near_duplicates(df, id_col=id_col, text_col=text_col, **options), "near-duplicates").where(F.col("doc_id").isNotNull())
    # Of a component's rows with the smallest id, the fingerprint that comes first.
    kept = found.where(F.col("doc_id") == F.col("component_id")).groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("x"))
    kept = kept.select(F.col("x.doc_id").alias("__id"), F.col("x.fp").alias("__fp"))
    shingle = options.get("shingle", 3)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                fps = np.array([fingerprint(t or "", shingle) for t in part.column(at).to_pylist()], np.uint64).view(np.int64)
                yield part.append_column("__of", pa.array(fps))

    marked = df.mapInArrow(run, StructType([*df.schema.fields, StructField("__of", LongType())]))
    out = marked.join(kept, (F.col(id_col) == F.col("__id")) & (F.col("__of") == F.col("__fp")), "left_semi").dropDuplicates([id_col, "__of"]).drop("__of")
    return out.unionByName(df.where(F.col(id_col).isNull()))
