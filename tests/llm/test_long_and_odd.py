"""Very long texts, repeated rows, empty tables and clashing columns, for the operators whose other tests lack them."""

import hashlib
import random
from collections import Counter

import pytest
from public_tokenizers import path
from tokenizers import Tokenizer

from tracegraph.llm import bpe, media, pii, simhash, tokencount

SCHEMA = "doc_id long, text string, fp long, ids string, base_sha256 string, n_bytes string, spans int"
LIBRARY = Tokenizer.from_file(path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    vocab = [f"word{i}" for i in range(5000)]
    long = " ".join(rnd.choices(vocab, k=500_000)) + " mail me@example.org or +49 (30) 1234567, 10.0.0.1"
    return [(1, long), (2, long + " end"), (2, "x" * 65 + "TAG" + "y" * 124), (2, "x" * 65 + "TAG" + "y" * 124), (3, None), (3, ""), (None, "a@b.cd"), (None, None), (4, "=" * 300_000), (5, "one two"), (6, "One  two")]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame([(*r, 1, "i", "b", "n", 2) for r in rows], SCHEMA)


def test_fingerprints(df, rows):
    got = Counter((r["doc_id"], int(r["fingerprint"], 16)) for r in simhash.digests(df).collect())
    assert got == Counter((i, simhash.fingerprint(t or "")) for i, t in rows)
    assert simhash.digests(df.limit(0)).count() == 0


def test_personal_data(df, rows):
    got = pii.digests(df).collect()
    assert len(got) == len(rows) and pii.digests(df.limit(0)).count() == 0
    for i in (1, 2):
        r = next(r for r in got if r["doc_id"] == i and r["n_ip"])
        assert (r["n_email"], r["n_ip"], r["n_phone"]) == (1, 1, 1)
    assert sum(r["n_email"] for r in got) == 3


def test_media(df, rows):
    got = Counter((r["doc_id"], r["n_bytes"], r["payload_sha256"]) for r in media.text_media(df, keep_media=False).collect())
    data = [(i, (t or "").encode()) for i, t in rows]
    assert got == Counter((i, len(b), hashlib.sha256(media.padded(b)).hexdigest()) for i, b in data)


def test_every_magic_string_at_every_place():
    magics = [b"TAG", b"ID3\x03\0\0\0\0\0\x05", b"\xff\xfa\x38\xc0", b"Info", b"Xing\0\0\0\x07", b"VBRI", b"\xff" * 8]
    for magic in magics:
        for at in range(192 * 2 - len(magic)):
            payload = bytearray(b"z" * 192 * 3)
            payload[at : at + len(magic)] = magic
            payload[-192 + at % 180 : -192 + at % 180 + len(magic)] = magic
            payload = bytes(payload[: 192 * 3])
            assert media.load(media.store(payload)) == payload, (magic, at)


def test_tokens(df, rows):
    want = Counter()
    for i, t in rows:
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    got = bpe.digests(df).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == want and bpe.digests(df.limit(0)).count() == 0
    counted = tokencount.token_counts(df, limit=512).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in counted) == Counter({(i, n): sum(c for (a, b, *_), c in want.items() if (a, b) == (i, n)) for i, n, *_ in want})
    assert tokencount.token_counts(df.limit(0), limit=512).count() == 0
