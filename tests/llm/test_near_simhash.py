"""SimHash in the near-duplicate stage: where MinHash sees nothing, its links alone must be found, checked and joined."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tests.llm.test_near_copies import SCHEMA, sets_of
from tracegraph.llm import near_copies, simhash


def rows_of():
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(40):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(60, 300))]
        texts.append(" ".join(base))
        for changes in (1, 1, 3, 8):
            copy = list(base)
            for _ in range(changes):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            texts.append(" ".join(copy))
        texts += ["  ".join(base).upper(), " ".join(base) + " " + " ".join(base)]
    texts += ["", None, " \n", "two words", "Two  WORDS"]
    rnd.shuffle(texts)
    return [(i // 2 * 3, t) for i, t in enumerate(texts)]


def classes(rows, distance):
    """The smallest id of each class and how often it stays: rows link at ``distance`` bits and 0.8 of their shingles."""
    fps, sets, root = [simhash.majority(near_copies.shingles(t or "")) for _, t in rows], [sets_of(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= distance and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), d), d)
    return Counter(best.values())


@pytest.fixture
def no_bands(monkeypatch):
    """No two texts share a band."""
    plain = near_copies.signatures

    def blind(docs, id_col, text_col):
        return plain(docs, id_col, text_col).withColumn("bands", F.array(F.xxhash64("key")))

    monkeypatch.setattr(near_copies, "signatures", blind)


def test_links_of_simhash_alone(spark, no_bands):
    rows = rows_of()
    want = classes(rows, near_copies.DISTANCE)
    assert classes(rows, 0) != want and sum(want.values()) < len({t for _, t in rows})
    got = P.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert Counter(r["doc_id"] for r in got.collect()) == want


def test_every_link_is_checked_on_whole_sets(spark, no_bands, monkeypatch):
    # Any two fingerprints are proposed, far more than those that decide.
    monkeypatch.setattr(simhash, "links", lambda each, n, distance: each.select(F.col("fp").alias("a")).join(each.select(F.col("fp").alias("b")), F.expr("a < b")))
    rows = rows_of()
    got = P.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert Counter(r["doc_id"] for r in got.collect()) == classes(rows, 64)


def test_fingerprints_of_one_number_are_compared_too(spark, no_bands, monkeypatch):
    blind = near_copies.signatures
    monkeypatch.setattr(near_copies, "signatures", lambda *args: blind(*args).withColumn("fp", F.lit(5).cast("long")))
    rows = rows_of()
    got = P.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert Counter(r["doc_id"] for r in got.collect()) == classes(rows, 64)
