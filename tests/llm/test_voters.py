"""Every stem that passes the miner's tests votes, once for each set of rows."""

from tracegraph.llm import toxicity


def test_all_precise_stems_vote(spark):
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) + "zzz" for i in range(100)]
    rows = [(f"plain text {w} {words[(i + 1) % 100]}", 1) for i, w in enumerate(words) for _ in range(4)]
    rows += [("plain text of no harm", 0)] * 4000
    rows += [("scarce", 1)] * 3 + [("scarce", 0)]
    voters, _, _ = toxicity.mine_stems(spark.createDataFrame(rows, "text string, toxic int"))
    assert sorted(voters) == sorted(w[:4] + "~" for w in words)


def test_folded_keeps_stems_of_other_rows():
    assert toxicity.folded({"trash": 9, "tras~": 9, "pathetic": 5, "pathe~": 7, "path~": 7, "boco~": 4}) == ["tras~", "pathetic", "path~", "boco~"]
