"""Every training-data operator against a brute-force version, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tracegraph.llm import bpe, media, mixing, pii, simhash, suffix, tokencount, topk, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, size string, ids string, h string"
LONG = "Der lange Text ist so lang, dass er viele Teile hat. " * 800
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def rows_of():
    rnd = random.Random(7)
    texts = [None, "", " \n ", "a", "One two", LONG, LONG + "x", "mail a.b@c.de, +49 170 1234567 at 10.0.0.1", "<|endoftext|> x<|endoftext|>", "日本語 текст 𝔘   b"]
    texts += [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 80))) for _ in range(30)]
    texts += texts[10:14] + [texts[12] + " omega"]
    out = [(i, t, "en", None if i % 7 == 0 else f"s{i % 3}", 1, "x", "y", "z", "w") for i, t in enumerate(texts)]
    return out + [out[11], (None, texts[12], "en", "s0", 1, "x", "y", "z", "w")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def text_of(r):
    return r[1] or ""


# BPE and token counts


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_bpe_equals_the_library(docs, none, library):
    want = Counter()
    for r in rows_of():
        ids = library.encode(text_of(r), add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter(map(tuple, bpe.digests(docs).collect())) == want
    assert bpe.digests(none).count() == 0
    assert {r["decoded"] for r in bpe.encode(docs).collect()} == {text_of(r) for r in rows_of()}


def test_token_counts_equal_the_library(docs, none, library):
    want = Counter()
    for r in rows_of():
        n = len(library.encode(text_of(r), add_special_tokens=False).ids)
        want[r[0], len(text_of(r).encode()), n, n > 512] += 1
    assert Counter(map(tuple, tokencount.token_counts(docs).collect())) == want
    assert tokencount.token_counts(none).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=" \n\tabcdefghie'stl0129.,-=é🙂漢", max_size=60))
def test_bpe_on_any_text(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids if not hasattr(test_bpe_on_any_text, "t") else test_bpe_on_any_text.t.encode(text, add_special_tokens=False).ids
    test_bpe_on_any_text.t = getattr(test_bpe_on_any_text, "t", None) or Tokenizer.from_file(path)
    assert bpe.parse_ids(bpe.codec(path).encode_joined([text])[0]).tolist() == ids
    assert tokencount.counter(path).count([text]) == [len(ids)]


def test_long_run_of_one_letter(library):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    for text in ("a" * 5001, "=" * 3000, "ab" * 2500, "x" * 17 + "\n" * 40):
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert tokencount.counter(path).count([text]) == [n]
        assert len(bpe.parse_ids(bpe.codec(path).encode_joined([text])[0])) == n


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    out = {}
    for kind, p in PATTERNS.items():
        out[kind] = []
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            fine = {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else True, "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if fine:
                out[kind].append(m.span())
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["1", "23", "255", "256", ".", "@", "a", "b.c", "+", "-", " ", "(", ")", "4111 1111 1111 1111", "é", "://", "x_"]), max_size=20).map("".join))
def test_base_spans_equal_the_patterns(text):
    got = pii.find_spans(text)
    assert {k: got[k] for k in pii.BASE} == base_spans(text)


def test_pii_rows(docs, none):
    want = Counter()
    for r in rows_of():
        s = base_spans(text_of(r))
        joined = ",".join(f"{k}:{a}:{b}" for k in pii.BASE for a, b in s[k])
        want[r[0], *(len(s[k]) for k in pii.BASE), hashlib.sha256(joined.encode()).hexdigest()] += 1
    assert Counter(tuple(r)[:6] for r in pii.digests(docs).collect()) == want
    assert pii.digests(none).count() == 0


def test_added_kinds_and_mask():
    text = "See https://user@example.com/a?b=1, account no. AB-12345; IBAN DE89 3704 0044 0532 0130 00 now"
    s = pii.find_spans(text)
    assert [text[a:b] for a, b in s["url"]] == ["https://user@example.com/a?b=1"]
    assert [text[a:b] for a, b in s["account"]] == ["AB-12345"]
    assert [text[a:b] for a, b in s["iban"]] == ["DE89 3704 0044 0532 0130 00"]
    assert "AB-12345" not in pii.mask(text, s) and "<IBAN>" in pii.mask(text, s)


def test_redact_keeps_columns_and_nulls(docs):
    got = {r["doc_id"]: r for r in pii.redact(docs).collect()}
    assert got[0]["text"] is None and got[7]["text"] == "mail <EMAIL>, <PHONE> at <IP>" and got[7]["size"] == "y"


# SimHash


def near_classes(rows):
    fps = [simhash.fingerprint(text_of(r)) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return Counter((r[0], f"{fps[i]:016x}", low.get(find(i))) for i, r in enumerate(rows))


def test_simhash_classes(docs, none):
    assert Counter(map(tuple, simhash.digests(docs).collect())) == near_classes(rows_of())
    assert simhash.digests(none).count() == 0


def test_fingerprint_by_definition():
    import xxhash

    words = "The QUICK brown fox the quick brown fox".split()
    words = [w.lower() for w in words]
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint("The QUICK\tbrown fox\nthe  quick brown fox ") == want
    assert simhash.fingerprint("") == simhash.fingerprint(" \n") == 0


def test_chain_of_links_and_plan(spark):
    rnd = np.random.default_rng(3)
    fps = rnd.integers(0, 2**63, 300, dtype=np.int64).tolist()
    chain = [fps[0]]
    for b in range(0, 60, 3):
        chain.append(chain[-1] ^ (0b111 << b))
    edges = simhash.links(spark.createDataFrame([(x,) for x in {*fps, *chain}], "fp long"), 5_000_000_000, 3)
    got = {(r["a"], r["b"]) for r in edges.collect()}
    assert {(min(a, b), max(a, b)) for a, b in zip(chain, chain[1:])} == got
    roots = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert set(roots.values()) == {min(chain)} and set(roots) == set(chain)
    for n in (10, 10**6, 10**10):
        cost, t = simhash.allocate([[*range(32)], [*range(32, 64)]], [[2.0**-32] * 4] * 2, n, 3)
        assert sum(x + 1 for x in t) == 4


def test_keep_first(docs):
    want = {r[2] for r in near_classes([r for r in rows_of()]) if r[2] is not None}
    kept = [r["doc_id"] for r in simhash.keep_first(docs).collect()]
    assert Counter(i for i in kept if i is not None) == Counter(want)


# Suffix arrays


def without_repeats(rows, length):
    first = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        t = text_of(r).encode()
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], r[0])
    out = Counter()
    for r in rows:
        t = text_of(r).encode()
        gone = [False] * len(t)
        for p in range(len(t) - length + 1 if r[0] is not None else 0):
            if first[t[p : p + length]] < r[0]:
                gone[p : p + length] = [True] * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[r[0], len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()] += 1
    return out


@pytest.mark.parametrize("length", [50, 20])
def test_repeats_are_removed(docs, none, length):
    want = without_repeats(rows_of(), length)
    got = suffix.remove_repeats(docs, length=length).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert suffix.remove_repeats(none, keep=False).count() == 0


@pytest.mark.parametrize("keep", [True, False])
def test_rows_with_one_id_differ_in_text(spark, keep):
    a, b, c = ("".join(random.Random(i).choice("abcdefgh ") for _ in range(150)) for i in range(3))
    rows = [(1, a), (2, a), (2, a), (2, b + a[:70]), (2, "short"), (1, "short"), (3, b), (3, c), (3, c), (4, c[20:] + b), (4, None), (5, "")]
    got = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep=keep).collect()
    assert Counter(tuple(r)[:5] for r in got) == without_repeats(rows, 50)
    assert not keep or all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)


def test_shards_merge():
    rnd = random.Random(2)
    base = bytes(rnd.choice(b"ab") for _ in range(400))
    parts = [(d, base[a : a + 49 + n]) for d, (a, n) in enumerate((rnd.randrange(300), rnd.randint(1, 56)) for _ in range(40))]
    rows = [{"slice": i, "runs": bytes([len(p) - 49]), "docs": np.array([d], np.int64).tobytes(), "body": p + b"\xff"} for i, (d, p) in enumerate(parts)]
    got = suffix.answers(rows, 50, 200)
    for (d, p), mask in zip(parts, got):
        for j in range(len(p) - 49):
            assert (int(mask[0]) >> j & 1) == any(e < d and p[j : j + 50] in q for e, q in parts)


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=120).map(lambda b: bytes(97 + c % 2 for c in b)))
def test_suffix_array_and_prefixes(data):
    text = np.frombuffer(data, np.uint8)
    order = suffix.suffix_array(text)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    common = suffix.common_prefixes(text, order, np.array([0]), np.array([len(data)]), 50)
    for a, b in zip(order, order[1:]):
        n = next((k for k in range(51) if k == 50 or max(a, b) + k >= len(data) or data[a + k] != data[b + k]), 50)
        assert common[b] == n


# Mixing


def test_targets_fill_up(spark):
    rows = [(i, f"s{i}", n) for i, n in enumerate([10, 1000, 1000, 5, 0, 700])] + [(9, None, 300)]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "doc_id long, source string, size long")).collect()}
    size = {s: n for _, s, n in rows}
    order = sorted((s for s in size if s), key=str) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, open_ = {}, set(size)
    while True:
        left = sum(size.values()) - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * size[s]}
        if not full:
            want |= share
            break
        want |= {s: 3.0 * size[s] for s in full}
        open_ -= full
    assert got == pytest.approx(want)


def test_mix_takes_its_targets(docs, none):
    got = mixing.mix(docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows_of())
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    by = Counter()
    for r in got:
        by[r["target"], r["source_size"]] += r["taken"]
    assert all(abs(n - t) <= 1 for (t, _), n in by.items())
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(none).count() == 0


def test_tree_deals_every_draw_once(docs):
    sized = mixing.sizes(docs)
    quota = mixing.quotas(mixing.targets(sized), 1, 5)
    want = {r["place"]: r["draws"] for r in quota.collect()}
    dealt = mixing.split_tree(quota, 3, 5).collect()
    assert Counter({p: 0 for p in want}) | Counter() == Counter()
    per_source, per_shard = Counter(), Counter()
    for r in dealt:
        per_source[r["place"]] += r["n"]
        per_shard[r["shard"]] += r["n"]
        assert r["n"] >= 0
    assert all(per_source[p] == n for p, n in want.items())
    assert max(per_shard.values()) - min(per_shard.values()) <= 3
    plan = mixing.drawn_blocks(quota, 3, 5).collect()
    assert max(Counter((r["place"], r["pass"], r["block"]) for r in plan).values()) == 1


def test_mixed_documents_keep_columns(docs):
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and got.count() > 0


# Top-k


def test_top_k(spark):
    rnd = np.random.default_rng(1)
    vec = {i: (rnd.standard_normal(8) / 3).tolist() for i in range(400)}
    vec |= {i: vec[50] for i in range(400, 430)}
    bad = {430: None, 431: [float("nan")] * 8, 432: [None] * 8, 433: [float("inf")] * 8, 450: [1.0] * 8, 451: [0.0] * 3}
    df = spark.createDataFrame([(i, v, 1, "q") for i, v in {**vec, **bad}.items()], "vec_id long, embedding array<double>, rank int, c string")
    got = {(r[0], r[1]): (r[2], r[3]) for r in topk.top_k(df, 50, 5).collect()}
    vec[450] = bad[450]
    whole = {i: np.floor(256 * np.array(v)).astype(int) for i, v in vec.items()}
    want = {}
    for q in [i for i in whole if i % 50 == 0]:
        best = sorted((-int(whole[q] @ whole[i]), i) for i in whole if i != q)[:5]
        want |= {(q, r + 1): (i, -s) for r, (s, i) in enumerate(best)}
    assert got == want
    assert topk.top_k(df.limit(0), 50, 5).count() == 0


def test_early_stop_is_exact():
    rnd = np.random.default_rng(4)
    v = np.floor(rnd.standard_normal((3000, 16)) * 40).astype(np.int64)
    v[:20] *= 6  # long vectors stand out, so readers stop early
    ids = np.arange(3000)
    q, q_ids = v[:40], ids[:40]
    rows, cols, score, stopped = topk.best_of(q, q_ids, v, ids, 5)
    assert (stopped < 1).all()
    for i in range(40):
        s = v @ q[i]
        s[i] = -(10**9)
        want = sorted(range(3000), key=lambda j: (-s[j], j))[:5]
        assert cols[rows == i].tolist() == want and score[rows == i].tolist() == [s[j] for j in want]


# Media


def test_media_round_trip(docs, none):
    got = media.text_media(docs).collect()
    by = {r["doc_id"]: r for r in got}
    for r in rows_of():
        data = text_of(r).encode()
        data += b" " * ((-len(data)) % 192 or (0 if data else 192))
        m = by[r[0]]
        assert m["payload_sha256"] == hashlib.sha256(data).hexdigest() and m["payload_bytes"] == len(data)
        assert media.load(m["media"]) == data and len(m["frame_offsets"]) == len(data) // 192
        assert m["media_sha256"] == hashlib.sha256(m["media"]).hexdigest()
    assert media.text_media(none).count() == 0


def test_scan_resynchronises_and_checks():
    raw = media.store(b"x" * 1920)
    s = media.scan(raw)
    assert (len(s.offsets), s.damaged, s.duration) == (10, 0, 10 * 1152 / media.Fraction(32000)) and s.table["frames"] == 10
    at = s.offsets[4]
    torn = media.scan(b"noise\xff\xfa" + raw[:at] + b"\xff\x00junk" + raw[at:] + b"TAG" + bytes(125))
    assert len(torn.offsets) == 10 and torn.resyncs >= 1 and "ID3v1" in torn.tags
    flipped = bytearray(raw)
    flipped[at + 8] ^= 1
    assert media.scan(bytes(flipped)).damaged == 1
    assert media.scan(b"").offsets == [] and media.feature(media.scan(b"\xff" * 50)).startswith("none")


def test_variable_rate_stream():
    frames, want, samples = [], [], 0
    at = 0
    for kbps in (5, 9, 1, 14):
        head = bytes((0xFF, 0xFB, kbps << 4 | 0 << 2, 0xC0))
        h = media.header(head)
        frames.append(head + bytes(h.size - 4))
        want.append(at)
        at += h.size
        samples += h.samples
    s = media.scan(b"".join(frames))
    assert s.offsets == want and s.duration == media.Fraction(samples, 44100)


# WARC


def page_rows():
    rows = [(i, f"http://x/{i % 5}", f"<p>{i % 6}é</p>" * (i % 6), 1, "r") for i in range(40)]
    return rows + [(40, None, None, 1, "r"), (41, "u", "", 1, "r"), (None, "u", "<p>only</p>", 1, "r"), rows[3]]


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string, digest int, raw string")
    got = Counter(map(tuple, warc.digests(pages).collect()))
    low = {}
    for i, _, html, *_ in page_rows():
        if i is not None:
            low[html or ""] = min(low.get(html or "", i), i)
    want = Counter()
    for i, _, html, *_ in page_rows():
        b = (html or "").encode()
        again = i is not None and low[html or ""] != i
        want[i, len(b), warc.digest_of(b), "revisit" if again else "response", low[html or ""] if again else None] += 1
    assert got == want
    assert warc.digests(pages.limit(0)).count() == 0
    large = {r["page_id"]: r["record_type"] for r in warc.digests(pages, min_bytes=1000).collect()}
    assert set(large.values()) == {"response"}


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_reader_matches_the_standard_library(zip64):
    import io
    import zipfile

    records = [(f"page:{i}", warc.record("response", i, "http://x/", b"body%d" % i, warc.digest_of(b"body%d" % i), 5)) for i in range(9)]
    raw = warc.package(records, zip64)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert z.testzip() is None and z.namelist() == [warc.RECORDS, warc.INDEX, warc.MANIFEST]
        assert z.read(warc.RECORDS) == b"".join(r for _, r in records)
    asked = []

    def read(at, n):
        asked.append(n)
        return raw[at : at + n]

    got = list(warc.ZipPackage(read, len(raw)).records())
    assert [r["payload"] for r in got] == [b"body%d" % i for i in range(9)]
    with pytest.raises(ValueError):
        warc.ZipPackage(lambda at, n: raw[:-40][at : at + n], len(raw) - 40)


# Toxicity


def test_toxicity_learns_from_weak_votes(spark):
    rnd = random.Random(5)
    insults = toxicity.SEED_LEXICON[:6]
    rows, labels = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        words = [rnd.choice(WORDS) for _ in range(30)] + ([rnd.choice(insults), rnd.choice(insults), "grr" + rnd.choice(WORDS)] if toxic else [])
        rnd.shuffle(words)
        rows.append((i, " ".join(words), 1.0))
        if i % 3:
            labels.append((i, int(toxic) ^ (rnd.random() < 0.02)))
    df = spark.createDataFrame([*rows, (None, None, 1.0), (5000, "", 1.0)], "doc_id long, text string, score double")
    lab = spark.createDataFrame([*labels, labels[0], (None, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.scored(df, lab).collect()}
    wrong = sum(got[i]["predicted"] != int(i % 8 == 0) for i in range(1500) if got[i]["held_out"])
    assert len(got) == 1502 and wrong <= 3 and got[5000]["predicted"] == 0 and got[None]["predicted"] == 0
    import zlib

    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(1500))
    bare = toxicity.scored(df, lab.limit(0)).collect()
    assert len(bare) == 1502 and {r["predicted"] for r in bare if r["doc_id"] in (0, 5000)} <= {0, 1}
    assert toxicity.scored(df.limit(0), lab).count() == 0


def test_label_model_finds_accuracies_and_correlations():
    rng = np.random.default_rng(0)
    y = rng.random(200_000) < 0.2
    fires = np.stack([np.where(y, rng.random(len(y)) < a, rng.random(len(y)) < b) for a, b in ((0.6, 0.02), (0.5, 0.01), (0.7, 0.05), (0.4, 0.02))] , axis=1)
    fires = np.column_stack((fires, fires[:, 0])).astype(float)  # the last copies the first
    m = toxicity.fit_label_model(len(y), fires.sum(0), fires.T @ fires, 0.2)
    assert m.toxic[1] == pytest.approx(0.5, abs=0.1) and m.toxic[2] == pytest.approx(0.7, abs=0.1)
    assert m.correlation[0, 4] > 0.3 and m.weight[0] < m.weight[1]
