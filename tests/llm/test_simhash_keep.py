"""Keeping one row of each component where ids repeat with different texts."""

from collections import Counter

from tracegraph.llm import simhash


def test_an_id_with_several_texts_keeps_those_that_are_no_copies(spark):
    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcd"}
    rows = [(1, text["a"]), (5, text["a"]), (5, text["b"]), (6, text["c"]), (6, text["c"]), (6, text["d"]), (None, text["a"]), (None, None), (7, None), (8, "")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = simhash.keep_first(df)
    assert got.columns == df.columns
    want = [(1, text["a"]), (5, text["b"]), (6, text["c"]), (6, text["d"]), (7, None), (None, text["a"]), (None, None)]
    assert Counter((r[0], r[1]) for r in got.collect()) == Counter(want)
    assert simhash.keep_first(df.limit(0)).count() == 0
