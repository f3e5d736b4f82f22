"""Removal of repeats beyond one slice, shard and piece: hot passages, long texts, many small parts."""

import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.test_operators import without_repeats
from tracegraph.llm import suffix


def texts(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefghij é") for _ in range(rnd.randint(2, 9)))
    licence = " ".join(word() for _ in range(40))
    parts = [" ".join(word() for _ in range(25)) for _ in range(6)]
    out = []
    for _ in range(n):
        own = [" ".join(word() for _ in range(rnd.randint(0, 12)))]
        own += [licence if rnd.random() < 0.6 else licence[rnd.randrange(60) :]] * (rnd.random() < 0.8)
        own += rnd.sample(parts, rnd.randint(0, 2))
        rnd.shuffle(own)
        out.append("".join(own))
    return out + ["x" * 900, "x" * 700 + "y", "ab" * 300, None, "", "short"]


@pytest.mark.parametrize("hot, shard, block", [(2, 300, 1 << 18), (0, 4 << 20, 64), (10**6, 300, 64)])
def test_hot_hashes_small_shards_and_pieces(spark, monkeypatch, hot, shard, block):
    monkeypatch.setattr(suffix, "HOT", max(1, hot))
    monkeypatch.setattr(suffix, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix, "BLOCK_BYTES", block)
    monkeypatch.setattr(suffix, "SLICE_BYTES", 2000)
    rows = [(i, t, 1, b"x") for i, t in enumerate(texts(hot, 90))]
    rows += [rows[3], rows[4], (None, rows[5][1], 1, None)]
    random.Random(1).shuffle(rows)
    parts = []
    real = suffix.materialize
    monkeypatch.setattr(suffix, "materialize", lambda df, name: parts.append((name, real(df, name))) or parts[-1][1])
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, slice int, body binary").repartition(4), keep=False)
    assert Counter(tuple(r)[:5] for r in got.collect()) == without_repeats([r[:2] for r in rows], 50)
    tables = dict(parts)
    assert tables["slices"].count() > 8 and (tables["hot-answers"].count() > 20) == (hot < 10)


def test_hot_keys_are_told_apart():
    rows = [(5, s, suffix.five_bytes(np.array([7, 100 + s, 200 + s // 2], np.uint64))) for s in range(6)]
    got = suffix.shared_keys(3)(suffix.pa.Table.from_batches([suffix.batch_of(suffix.BUCKET_ROW, rows[:4]), suffix.batch_of(suffix.BUCKET_ROW, rows[4:])])).to_pylist()
    of = lambda kind: {r["slice"]: suffix.from_five(r["data"]).tolist() for r in got if r["kind"] == kind}
    assert of(suffix.SHARED) == {s: [7, 200 + s // 2] for s in range(6)} and of(suffix.HOT_KEY) == {s: [7] for s in range(6)}


def test_runs_of_a_long_text_do_not_depend_on_pieces():
    rnd = random.Random(8)
    text = bytes(rnd.choice(b"abcd") for _ in range(5000))
    whole = suffix.find_runs([text, b"", text[:49], text[:50]], 50)
    runs, lows = suffix.find_runs([text, b"", text[:49], text[:50]], 50, 300)
    assert runs.sum() == whole[0].sum() == 4952
    for r, low in ((runs, lows), whole):
        at = np.cumsum(r.astype(int)) - r
        h = suffix.gram_hash(*(suffix.words_at(np.frombuffer(text + bytes(16), np.uint8))[k:][: len(text) - 7] for k in (0, 8)))
        for p, o in zip(at[at < 4951].tolist(), low.tolist()):
            assert h[p + o] == h[p : p + 35].min()


def test_a_text_of_several_megabytes(spark):
    rnd = np.random.default_rng(3)
    big = rnd.integers(97, 123, 6 << 20, np.uint8).tobytes().decode()
    rows = [(1, big), (2, "head " + big[1_000_000:1_000_400]), (3, big[:3_000_000] + "!" + big[3_000_000:])]
    got = {r[0]: tuple(r)[1:4] for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=False).collect()}
    assert got == {1: (6 << 20, 0, 0), 2: (405, 400, 1), 3: ((6 << 20) + 1, 6 << 20, 2)}
