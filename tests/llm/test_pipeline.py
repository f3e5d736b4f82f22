"""The corpus pipeline, stage by stage, against plain Python."""

import hashlib
from collections import Counter

import corpus_pipeline as P
from tests.llm.test_near_copies import kept_by_all_pairs
from tracegraph.llm import mixing, pii, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.scored(docs, labels).collect() if r["predicted"]}
    kept = P.materialize(P.drop_toxic(spark, docs, SF), "a")
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in docs.collect()} - toxic

    unique = P.materialize(P.drop_near_copies(spark, kept, SF), "b")
    assert Counter(r["doc_id"] for r in unique.collect()) == kept_by_all_pairs([tuple(r) for r in kept.select("doc_id", "text").collect()])

    masked = P.materialize(P.mask_personal_data(spark, unique, SF), "c")
    text = {r["doc_id"]: r["text"] for r in unique.collect()}
    for r in masked.collect():
        assert r["text"] == pii.mask(text[r["doc_id"]], pii.find_spans(text[r["doc_id"]])) and r["n_chars"] == len(r["text"])

    mixed = P.materialize(P.mix_sources(spark, masked, SF), "d")
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(masked).collect()}
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({i: n for i, n in copies.items() if n})

    out = P.encode(spark, mixed, SF)
    decoded = {r["doc_id"]: hashlib.sha256(r["text"].encode()).hexdigest() for r in masked.collect()}
    rows = out.collect()
    assert len(rows) == mixed.count() and all(decoded[r["doc_id"]] == r["decoded_sha256"] for r in rows)
    assert kept.columns == unique.columns == masked.columns == mixed.columns == docs.columns
    assert Counter(map(tuple, P.run(spark, SF).collect())) == Counter(map(tuple, rows))


def write(spark, folder, docs, labels):
    for name, df in (("documents", docs), ("labels", labels)):
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


EXTRA = "doc_id long, text string, lang string, source string, n_chars int, row string, draw int, __k int, shard long, fp string"
LABELS = "doc_id long, quality int, toxic int"


def test_nulls_repeats_and_clashing_columns(spark, tmp_path):
    text = {c: " ".join(f"{c}{i}" for i in range(40)) for c in "abc"}
    rows = [(1, text["a"]), (2, text["a"]), (2, text["b"]), (2, text["b"]), (3, None), (4, ""), (None, text["c"]), (None, None), (5, text["b"] + " write to a.b@example.org"), (6, "long " * 400_000)]
    docs = spark.createDataFrame([(i, t, None, "s" if i else None, None, "r", 1, 2, 3, "f") for i, t in rows], EXTRA)
    sf = write(spark, tmp_path / "t", docs, spark.createDataFrame([(1, 1, 0), (None, 0, 1), (2, None, None)], LABELS))
    now, seen = spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, stage in P.STAGES[:-1]:
        now = P.materialize(stage(spark, now, sf), name)
        assert now.columns == docs.columns
        seen.append(Counter((r["doc_id"], (r["text"] or "")[:3]) for r in now.collect()))
    # Nothing is toxic; then one row for each text that is no copy, and what has no id.
    assert seen[0] == Counter((i, (t or "")[:3]) for i, t in rows)
    assert seen[1] == seen[2] == Counter([(1, "a0 "), (2, "b0 "), (3, ""), (None, "c0 "), (None, ""), (6, "lon")])
    assert set(seen[3]) <= set(seen[1]) and (3, "") not in seen[3]
    assert sum(seen[3].values()) == P.run(spark, sf).count() > 0


def test_empty_tables(spark, tmp_path):
    sf = write(spark, tmp_path / "t", spark.createDataFrame([], EXTRA), spark.createDataFrame([], LABELS))
    assert P.run(spark, sf).count() == 0
