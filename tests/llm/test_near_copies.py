"""The near-duplicate stage against all pairs of shingle sets."""

import random
from collections import Counter

import pytest

import corpus_pipeline as P
from tracegraph.llm import near_copies

SCHEMA = "doc_id long, text string"


def sets_of(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) > k else {tuple(w)}


def kept_by_all_pairs(rows):
    """Index of the row each component keeps."""
    sets, root = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return Counter(best.values())


@pytest.mark.parametrize("few, block", [(near_copies.FEW, near_copies.BLOCK), (1, 8)])
def test_changed_words(spark, monkeypatch, few, block):
    monkeypatch.setattr(near_copies, "FEW", few)
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(60):
        base = [rnd.choice(vocab) for _ in range(rnd.randint(40, 300))]
        for share in (0, 0.005, 0.01, 0.02, 0.03, 0.1):
            copy = list(base)
            for _ in range(max(1, round(share * len(base)))) if share else ():
                copy[rnd.randrange(len(copy))] = rnd.choice(vocab)
            rows.append(" ".join(copy))
    # A chain and a hub: many copies, each similar to the hub but not to each other.
    hub = [rnd.choice(vocab) for _ in range(200)]
    rows.append(" ".join(hub))
    for i in range(60):
        copy = list(hub)
        for j in range(4):
            copy[(i * 4 + j * 47) % 200] = f"x{i}{j}"
        rows.append(" ".join(copy))
    rows += ["", None, "two words", "Two  WORDS", "one two three four five", "one two three four six"]
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    got = P.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert Counter(r["doc_id"] for r in got.collect()) == kept_by_all_pairs(rows)


def test_shared_ids(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(50)) for c in "abc"}
    rows = [(1, text["a"]), (2, text["a"]), (2, text["b"]), (3, text["c"]), (3, text["c"]), (None, text["a"]), (None, text["a"])]
    got = near_copies.keep_first(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter(map(tuple, got)) == Counter([(1, text["a"]), (2, text["b"]), (3, text["c"]), (None, text["a"]), (None, text["a"])])
