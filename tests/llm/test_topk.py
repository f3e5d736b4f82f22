"""Bounds of the top-k search: they stop it early, on the driver's vectors too, and lose nothing."""

from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tracegraph.llm import topk


def brute(q, q_ids, v, ids, k):
    out = []
    for i in range(len(q)):
        s = v @ q[i]
        out.append([(j, s[j]) for j in sorted(np.flatnonzero(ids != q_ids[i]).tolist(), key=lambda j: (-s[j], j))[:k]])
    return out


def check(v, ids, asked, k=5):
    rows, cols, score, stopped = topk.best_of(v[asked], ids[asked], v, ids, k)
    want = brute(v[asked], ids[asked], v, ids, k)
    for i in range(len(asked)):
        assert list(zip(cols[rows == i].tolist(), score[rows == i].tolist())) == want[i]
    return stopped


def test_the_drivers_vectors_stop_early():
    t = pq.read_table("/root/testdata/sf0.1/embeddings.parquet")
    ids = np.array(t["vec_id"].to_pylist())
    v = np.floor(256 * np.array(t["embedding"].to_pylist(), np.float64)).astype(np.int64)
    order = np.argsort(ids)
    stopped = check(v[order], ids[order], np.flatnonzero(ids[order] % 50 == 0))
    assert (stopped < 1).all() and np.median(stopped) <= 0.8


@pytest.mark.parametrize("case", ["ties", "zeros", "spread", "few", "wide", "one list"])
def test_any_vectors(case):
    rnd = np.random.default_rng(3)
    v = np.floor(rnd.standard_normal((700, 24)) * 50).astype(np.int64)
    if case == "ties":
        v = np.concatenate([v[:100], np.repeat(v[:1], 400, axis=0), -v[:100]])
    if case == "zeros":
        v[:, ::2] = 0
        v[::3] = 0
    if case == "spread":
        v = v * (1 << np.arange(24)[::-1] // 2)
    if case == "few":
        v = v[:4]
    if case == "wide":
        v = v * (1 << 20)
    if case == "one list":
        v = v[:, :1]
    check(v, np.arange(len(v)) // 2 * 2, np.arange(0, len(v), 29))


def test_many_blocks_repeats_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(topk, "LEAST", 40)
    monkeypatch.setattr(topk, "QUERIES", 5)
    monkeypatch.setattr(topk, "READ", 16)
    rnd = np.random.default_rng(9)
    rows = [(i, (rnd.standard_normal(6) / 3).tolist()) for i in range(300)]
    rows += [rows[0]] * 90 + [rows[7]] * 9 + [(50, rows[3][1]), (1000, []), (1001, []), (None, rows[0][1]), (1050, None)]
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, n int, one int, v int")
    got = {}
    for r in topk.top_k(df, 50, 5).collect():
        got.setdefault(r[0], []).append((r[1], r[2], r[3]))
    whole = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows if i is not None and v is not None]
    first = {}
    for i, v in sorted(whole, key=lambda x: (x[0], x[1].tolist())):
        first.setdefault(i, v)
    want = {}
    for q in {i for i, _ in whole if i % 50 == 0}:
        best = sorted((-int(first[q] @ v), i) for i, v in whole if i != q and len(v) == len(first[q]))[:5]
        if best:
            want[q] = [(n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert {q: sorted(x) for q, x in got.items()} == want
    assert Counter(len(x) for x in got.values())[5] == 6
