"""The mix, row by row, against plain Python."""

import random
import re
import struct
from collections import Counter, defaultdict

import pytest
import xxhash

from tracegraph.llm import mixing

SCHEMA = "doc_id long, text string, source string, h string, row string, keep_0 int, draw int"


def xx(*parts):
    """Chained 64-bit hashes of whole numbers and strings, signed; null parts leave it as it is."""
    h = 42
    for p in parts:
        if p is not None:
            h = xxhash.xxh64(p.encode() if isinstance(p, str) else struct.pack("<q", p), seed=h).intdigest()
    return h - (h >> 63 << 64)


def permuted(place, turn, i, blocks, seed):
    for r in range(3):
        x = i ^ i >> max(1, blocks.bit_length() // 2)
        i = (x * (2 * (xx(seed, place, turn, r, 0) % 2**20) + 1) + xx(seed, place, turn, r, 1) % blocks) % blocks
    return i


def tree(draws, levels, seed):
    """{(shard, place): draws}, item by item."""
    nodes = [draws]
    for level in range(levels):
        out = []
        for node, q in enumerate(nodes):
            open_ = sum(q.values())
            want, left = open_ // 2, {}
            for p in sorted(q):
                n = 0
                for t in range(1, q[p] + 1):
                    n += want - n > (open_ - t + 1) * (xx(seed, level, node, p, t) % 2**52 / 2**52)
                open_, want, left[p] = open_ - q[p], want - n, n
            out += [left, {p: q[p] - left[p] for p in q}]
        nodes = out
    return {(s, p): n for s, q in enumerate(nodes) for p, n in q.items()}


def mixed(rows, goal, levels=4, seed=17):
    """(doc_id, size, taken, copies, shards) of each row of (doc_id, text, source); ``goal``: source to (place, target)."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows]
    unit = max(1, sum(size) // mixing.BLOCKS)
    total = Counter()
    for r, n in zip(rows, size):
        total[r[2]] += n
    of, draws, blocks, last = {}, {}, {}, {}
    for s, (p, target) in goal.items():
        b = blocks[p] = 1 << max(1, total[s] // unit).bit_length() - 1
        words = int(target + 0.5)
        passes, rest = divmod(words, total[s]) if total[s] else (0, 0)
        cut = lambda j, b=b, n=total[s]: j * n // b
        of[p] = [(j, cut(permuted(p, t, j, b, seed)), cut(permuted(p, t, j, b, seed) + 1)) for t in range(passes + 1) for j in range(b)]
        draws[p], have = passes * b, 0
        while have < rest:
            _, lo, hi = of[p][draws[p]]
            last[p] = min(hi - lo, rest - have)
            have, draws[p] = have + last[p], draws[p] + 1
    runs = defaultdict(list)  # place to (first, end, shard) of every draw
    dealt, low = tree(draws, levels, seed), Counter()
    for (shard, p), n in sorted(dealt.items()):
        for u in range(low[p], low[p] + n):
            _, lo, hi = of[p][u]
            runs[p].append((lo, lo + last[p] if u == draws[p] - 1 and p in last else hi, shard))
        low[p] += n
    out, at = [None] * len(rows), Counter()
    order = sorted(range(len(rows)), key=lambda i: (h := xx("mix", rows[i][0], rows[i][1] or ""), h)[:1] and (h % 256, h, rows[i][0] is not None, rows[i][0] or 0))
    for i in order:
        s, n = rows[i][2], size[i]
        a, at[s] = at[s], at[s] + n
        got, copies = Counter(), 0
        for lo, hi, shard in runs[goal[s][0]] if n else ():
            if lo < a + n and a < hi:
                got[shard] += min(a + n, hi) - max(a, lo)
                copies += lo <= a + (n - 1) // 2 < hi
        out[i] = (rows[i][0], n, sum(got.values()), copies, ",".join(f"{k}:{got[k]}" for k in sorted(got)))
    return out


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(7)
    out = [(i, " ".join(["w"] * rnd.randint(0, 60)), rnd.choice(["a", "a", "a", "b", "c", None])) for i in range(400)]
    out += [(400, None, "a"), (401, "", None), (402, " \t ", "d"), (403, "x " * 9000, "b"), (None, "no id here", "c"), (None, None, None)]
    return out + [out[3], out[3], (3, "another text", "a"), (500, "lone", "tiny"), (501, "one two", "tiny")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "h", "row", 1, 2) for r in rows], SCHEMA)


def test_every_row_as_in_plain_python(spark, rows):
    df = frame(spark, rows)
    goal = {r["source"]: (r["place"], r["target"]) for r in mixing.targets(mixing.sizes(df)).collect()}
    want = Counter(mixed(rows, goal))
    fields = ("doc_id", "size", "taken", "copies", "shards")
    got = mixing.mix(df).collect()
    assert Counter(tuple(r[f] for f in fields) for r in got) == want
    again = mixing.mix(df.repartition(7)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    deep = mixing.mix(df, levels=6, seed=5).collect()
    assert Counter(tuple(r[f] for f in fields) for r in deep) == Counter(mixed(rows, goal, 6, 5))


def test_another_seed_draws_other_blocks_to_the_same_sums(spark, rows):
    df = frame(spark, rows)

    def sums(got):
        out = Counter()
        for r in got:
            out[r["target"], r["source_size"]] += r["taken"]
        return out

    one, two = mixing.mix(df).collect(), mixing.mix(df, seed=99).collect()
    assert sums(one) == sums(two)
    assert all(abs(n - t) <= 0.5 for (t, _), n in sums(one).items())
    assert {(r["doc_id"], r["taken"]) for r in one} != {(r["doc_id"], r["taken"]) for r in two}
    assert {(r["doc_id"], r["shards"]) for r in one} != {(r["doc_id"], r["shards"]) for r in two}


def test_tree_is_in_the_plan_and_gives_the_rows(spark, rows, monkeypatch):
    sized = mixing.sizes(frame(spark, rows))
    quota = mixing.quotas(mixing.targets(sized), 1, 17)
    plan = mixing.drawn_blocks(quota, 4, 17).groupBy("place", "block").count()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") >= 5
    whole = mixing.mix(frame(spark, rows)).agg({"taken": "sum"}).first()[0]
    real = mixing.split_tree
    monkeypatch.setattr(mixing, "split_tree", lambda *a: real(*a).where("shard <> 3"))
    short = mixing.mix(frame(spark, rows))
    assert short.agg({"taken": "sum"}).first()[0] < whole and short.count() == len(rows)
    assert not any(f"{3}:" in f",{x}" for r in short.select("shards").collect() for x in r["shards"].split(",") if x.startswith("3:"))


def test_mixed_documents_lie_in_their_shards(spark, rows):
    df = frame(spark, rows)
    copies = Counter()
    for r in mixing.mix(df).collect():
        copies[r["doc_id"], r["size"]] += r["copies"]
    got = mixing.mixed_documents(df, places=True)
    assert got.columns == [*df.columns, "shard", "position"]
    seen, parts = Counter(), defaultdict(list)
    from pyspark.sql import functions as F

    for r in got.withColumn("part", F.spark_partition_id()).collect():
        seen[r["doc_id"], len((r["text"] or "").split())] += 1
        parts[r["part"]].append((r["shard"], r["position"] % mixing.PIECES, r["position"]))
    assert seen == +copies
    assert all(p == sorted(p) for p in parts.values())
    where = defaultdict(set)
    for part, places in parts.items():
        for shard, piece, _ in places:
            where[shard, piece].add(part)
    assert all(len(x) == 1 for x in where.values()) and len({s for s, _ in where}) == 16


def test_empty_and_wordless_tables(spark):
    df = frame(spark, [(1, None, "a"), (1, "", "b"), (2, " ", None)])
    assert [r["taken"] for r in mixing.mix(df).collect()] == [0, 0, 0] and mixing.mixed_documents(df).count() == 0
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0
