"""The whole score of op6 against plain Python: mining, label model, posteriors, classifier."""

import math
import random
import zlib

import numpy as np

from tracegraph.llm import toxicity as T

SCHEMA = "doc_id long, text string, source string, stem string, h int"


def rows_and_labels(seed=3, n=700):
    rnd = random.Random(seed)
    bad = ["bozorro", "crudnik", "idiot", "moron", "slimeball", "trash"]
    plain = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        toxic = rnd.random() < 0.2
        words = rnd.choices(plain, k=rnd.randint(3, 40)) + (rnd.sample(bad, rnd.randint(1, 4)) if toxic else [])
        rnd.shuffle(words)
        rows.append((i, " ".join(words)))
        if rnd.random() < 0.8:
            labels.append((i, 1, int(toxic)))
    rows += [(n, None), (n + 1, ""), (n + 2, rows[5][1]), (None, "you idiot, moron"), (7, "another text of one id"), (n + 3, "idiot " * 200_000)]
    return rows, [*labels, (3, 0, 1), (None, 0, 1), (4, None, None)]


def plain_scores(rows, labels):
    """Score of each row, in order."""
    train = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 0
    text = [t or "" for _, t in rows]
    stems = lambda t: {s for w in set(T.WORDS(t.lower())) for s in T.stems_of(w)}
    label = {}
    for i, _, y in labels:
        if i is not None and y is not None and train(i):
            label[i] = max(label.get(i, 0), y)
    # One id for each text, and the text's highest label; then all rows of those ids.
    of = {}
    for (i, _), t in zip(rows, text):
        if i in label:
            low, y = of.get(t, (i, 0))
            of[t] = min(low, i), max(y, label[i])
    chosen = {}
    for i, y in of.values():
        chosen[i] = max(chosen.get(i, 0), y)
    learn = [(t, chosen[i]) for (i, _), t in zip(rows, text) if i in chosen]
    n, hits = {}, {}
    for t, y in learn:
        for s in stems(t):
            n[s], hits[s] = n.get(s, 0) + 1, hits.get(s, 0) + y
    p = sum(y for _, y in learn) / len(learn)
    z = {s: (hits[s] - n[s] * p) / math.sqrt(n[s] * p * (1 - p)) for s in n if n[s] >= 4}

    def precise(s):
        q, e = hits[s] / n[s], T.ERRORS**2
        least = (q + e / (2 * n[s]) - T.ERRORS * math.sqrt(q * (1 - q) / n[s] + e / (4 * n[s] ** 2))) / (1 + e / n[s])
        return hits[s] >= n[s] * T.PRECISE and z[s] > 3 and least > 0.5

    mined = [s for s in sorted(z, key=lambda s: (-z[s], s)) if precise(s)]
    voters = list(dict.fromkeys([*T.folded({s: n[s] for s in mined}), *T.SEED_LEXICON]))
    features = list(dict.fromkeys([*voters, *sorted(z, key=lambda s: (-abs(z[s]), s))[: T.FEATURES]]))
    votes = lambda t: [int(v in stems(t)) for v in voters] + [int(bool(f(t))) for f in T.PATTERNS.values()]
    fired = np.array([votes(t) for (i, _), t in zip(rows, text) if train(i)], float)
    m = T.fit_label_model(len(fired), fires := fired.sum(axis=0), fired.T @ fired, p)
    assert len(fires) == len(voters) + len(T.PATTERNS)

    def posterior(t):
        v = np.flatnonzero(votes(t))
        odds = math.log(p / (1 - p)) + sum(math.log(m.toxic[a] / m.clean[a]) / (1 + sum(m.correlation[a, b] for b in v)) for a in v)
        return 1 / (1 + math.exp(-max(-30, min(30, odds))))

    have = [stems(t) for t, _ in learn]
    x = np.array([[*(f in h for f in features), 1] for h in have], float)
    soft = np.array([posterior(t) for t, _ in learn])
    # Newton's method finds the same optimum of the penalised likelihood by another way.
    w, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.3)
    ridge[-1] = 1e-6
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= np.linalg.solve((x.T * (q * (1 - q) + 1e-9)) @ x + np.diag(ridge), x.T @ (q - soft) + ridge * w)
    out = []
    for t in text:
        h = stems(t)
        out.append(1 / (1 + math.exp(-np.clip(w[-1] + sum(a for a, f in zip(w, features) if f in h), -30, 30))))
    return out


def test_scores_as_in_plain_python(spark):
    rows, labels = rows_and_labels()
    want = sorted(zip([r[0] if r[0] is not None else -1 for r in rows], plain_scores(rows, labels)))
    df = spark.createDataFrame([(i, t, "s", "x", 1) for i, t in rows], SCHEMA).repartition(3)
    got = T.scored(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    have = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["score"]) for r in got)
    assert [i for i, _ in have] == [i for i, _ in want]
    # The operator's optimiser stops at steps below 1e-4, some way before the optimum.
    assert max(abs(a - b) for (_, a), (_, b) in zip(have, want)) < 0.03
    assert all(r["predicted"] == (r["score"] >= 0.5) for r in got)
