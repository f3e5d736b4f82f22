"""Toxicity by weak supervision.

1. Stems (words and word beginnings) are counted over all labelled training
   texts, copies once: the words of a text with many copies are no evidence
   each time.  Those that single out toxic rows join a seed lexicon as voters;
   patterns of punctuation and capitals vote too.
2. A generative label model is estimated from how often voters fire alone and
   together in all training documents, without their labels: triplets of
   voters give each one's accuracy, and what a pair shares beyond that gives the
   correlations, by which the votes cast for one text count less.
3. A linear classifier over stems is trained on the posterior labels of a
   bounded sample of the labelled rows and scores every whole text.

Training rows are those whose crc32(doc_id as text) mod 5 is not 0; label, lang,
source and doc_id never enter a score.

Cases: a null or empty text scores what no evidence gives; a doc_id with several
labels counts as its highest one; without labels, or with one class only, the
seed lexicon votes; rows with a null doc_id are scored, not learned from, and
not held out; repeated rows are learned from and scored each; an empty table
has no rows; a very long text is one text; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from tracegraph.llm._common import id_and_text, map_slices, materialize

# A fixed word list: insults that vote from the start.
SEED_LEXICON = ("idiot", "moron", "stupid", "loser", "scum", "trash", "clown", "pathetic", "worthless", "disgusting", "dumb", "jerk", "fool", "imbecile", "cretin", "vermin")
PATTERNS = {"!!!": re.compile(r"!!!").search, "???": re.compile(r"\?\?\?").search, "CAPS": re.compile(r"\b[A-Z]{5,}(?:\W+[A-Z]{5,}){2}").search, "$#!": re.compile(r"[@#$%&*]{3,}").search}
WORDS = re.compile(r"[^\W\d_]+").findall
BEGINNINGS = (4, 5, 6)

#: Labelled rows, about, on which the classifier is fitted; fewer, if there are fewer.
SAMPLE = 8_000
FEATURES = 1_000
#: Stems that a task counts before it sends their counts.
STEMS = 200_000
#: A voter's least precision, and the standard errors by which it is above one half.
PRECISE, ERRORS = 0.9, 2.0
#: Correlations below this are taken for none.
DEPENDENT = 0.1
PRIOR = 0.1


def training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def stems_of(word: str) -> list[str]:
    return [word, *(word[:n] + "~" for n in BEGINNINGS if len(word) > n)]


class Matcher:
    """Positions of the known stems in a text; words are remembered up to a bound."""

    def __init__(self, stems: list[str]):
        self.at = {s: i for i, s in enumerate(stems)}
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> set[int]:
        found: set[int] = set()
        known, at = self.known, self.at
        if len(known) > 500_000:
            known.clear()
        for w in set(WORDS(text.lower())):
            hit = known.get(w)
            if hit is None:
                hit = known[w] = tuple(at[s] for s in stems_of(w) if s in at)
            if hit:
                found.update(hit)
        return found


def votes_of(text: str, match: Matcher) -> set[int]:
    n = len(match.at)
    return match(text) | {n + i for i, p in enumerate(PATTERNS.values()) if p(text)}


@dataclass
class LabelModel:
    """Firing rates of each voter given either class, its weight if all voters fired, and correlations."""

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    weight: np.ndarray
    correlation: np.ndarray

    def posterior(self, votes: set[int]) -> float:
        """Probability of the toxic class; a voter that doesn't fire abstains."""
        odds = np.log(self.prior / (1 - self.prior))
        if votes:
            v = np.array(sorted(votes))
            # Votes that depend on others cast here share their weight.
            odds += (np.log(self.toxic[v] / self.clean[v]) / (1 + self.correlation[np.ix_(v, v)].sum(axis=1))).sum()
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def fit_label_model(n: float, alone: np.ndarray, together: np.ndarray, prior: float) -> LabelModel:
    """Accuracies by triplets, correlations from what they leave unexplained.

    With conditionally independent voters, cov(i, j) = p(1 - p) a_i a_j for
    a = P(fires | toxic) - P(fires | clean), so three voters give each a.
    """
    n = max(n, 1.0)
    rate = alone / n
    cov = together / n - np.outer(rate, rate)
    spread, m = prior * (1 - prior), len(alone)
    noise = 3 * np.sqrt(np.outer(rate, rate) / n) + 1e-9
    firm = (cov > noise) & ~np.eye(m, dtype=bool)
    a = np.zeros(m)
    for i in range(m):
        others = np.flatnonzero(firm[i])
        if len(others) >= 2:
            j, k = np.triu_indices(len(others), 1)
            j, k = others[j], others[k]
            fine = firm[j, k]
            if fine.any():
                j, k = j[fine], k[fine]
                a[i] = np.sqrt(np.median(cov[i, j] * cov[i, k] / cov[j, k]) / spread)
    a = np.clip(a, 0, np.minimum(1, rate / prior))
    toxic = np.clip(rate + (1 - prior) * a, 1e-4, 0.999)
    clean = np.clip(rate - prior * a, 1e-4, 0.999)
    silent = alone == 0
    toxic[silent], clean[silent] = 2e-3, 1e-4  # never seen firing: a weak vote
    scale = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
    corr = np.clip((cov - spread * np.outer(a, a)) / np.outer(scale, scale), -1, 1)
    np.fill_diagonal(corr, 0)
    dependent = np.where(np.abs(corr) > DEPENDENT, np.abs(corr), 0)
    return LabelModel(prior, toxic, clean, 1 / (1 + dependent.sum(axis=1)), dependent.astype(np.float32))


def fit_linear(rows: list[set[int]], soft: np.ndarray, n_features: int, ridge: float = 0.3, rounds: int = 150) -> np.ndarray:
    """Weights and, last, intercept of a ridge logistic regression on soft labels.

    Each step solves with the fixed upper bound of the Hessian, X'X / 4, which
    is factored once and never overshoots.
    """
    x = np.zeros((len(rows), n_features + 1))
    for i, r in enumerate(rows):
        x[i, list(r)] = 1
    x[:, -1] = 1
    w = np.zeros(n_features + 1)
    penalty = np.full(n_features + 1, ridge)
    penalty[-1] = 1e-6
    inverse = np.linalg.inv(x.T @ x / 4 + np.diag(penalty))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = inverse @ (x.T @ (p - soft) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


@dataclass
class Model:
    voters: list[str]
    labels: LabelModel
    stems: list[str]
    weights: np.ndarray


def known_labels(labels: DataFrame) -> DataFrame:
    """``__id, toxic`` of the labelled training rows."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & training(F.col("doc_id")))
    return known.groupBy(F.col("doc_id").alias("__id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))


def of_distinct_texts(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``known`` with one id for each text, the smallest, and its highest label; only ids and hashes move."""
    texts = docs.where(training(F.col("doc_id"))).select("doc_id", F.xxhash64("text").alias("h")).join(known, F.col("doc_id") == F.col("__id"))
    return texts.groupBy("h").agg(F.min("doc_id").alias("__id"), F.max("toxic").alias("toxic")).groupBy("__id").agg(F.max("toxic").alias("toxic"))


def labelled(docs: DataFrame, known: DataFrame, move: str = "merge") -> DataFrame:
    """``text, toxic`` of the rows that ``known`` labels; by default the texts are dealt by id, few as the labels may
    be: one way at every size."""
    return docs.where(training(F.col("doc_id"))).join(known.hint(move), F.col("doc_id") == F.col("__id")).select("text", "toxic")


def sampled(known: DataFrame, bound: int) -> DataFrame:
    """About ``bound`` of the labels, chosen by hash: as many at any size, so that they may be broadcast."""
    share = min(1.0, bound / max(1, known.count()))
    return known.where(F.pmod(F.xxhash64(F.lit("sample"), "__id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def folded(counts: dict[str, int]) -> list[str]:
    """``counts`` without the stems that fire on the same rows as a beginning of theirs, in the same order.

    A beginning fires wherever a longer stem does, so equal counts mean equal rows.
    """

    def beginnings(stem: str) -> list[str]:
        word = stem.rstrip("~")
        return [b for n in BEGINNINGS if len(word) > n and (b := word[:n] + "~") != stem]

    return [s for s, n in counts.items() if all(counts.get(b) != n for b in beginnings(s))]


def mine_stems(rows: DataFrame) -> tuple[list[str], list[str], float]:
    """Voter stems, feature stems, and the share of toxic rows, of all of ``rows(text, toxic)``."""

    def count(batches):
        """Counts by stem, sent whenever a task has many of them."""
        import pyarrow as pa

        n: Counter[str] = Counter()
        hits: Counter[str] = Counter()

        def sent():
            out = pa.table({"stem": pa.array(n, pa.string()), "n": pa.array(n.values(), pa.int64()), "hits": pa.array([hits[s] for s in n], pa.int64())})
            n.clear()
            hits.clear()
            return out.to_batches()

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    stems = {s for w in set(WORDS(text.lower())) for s in stems_of(w)}
                    stems.add("")  # counts the rows
                    n.update(stems)
                    if label:
                        hits.update(stems)
                if len(n) > STEMS:
                    yield from sent()
        yield from sent()

    each = rows.mapInArrow(count, "stem string, n long, hits long")
    # Written once: the totals, the voters and the features are read from it.
    stems = materialize(each.groupBy("stem").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")), "toxic-stems")
    total = stems.where("stem = ''").first()
    if total is None or not 0 < total["hits"] < total["n"]:
        return [], [], PRIOR
    p = total["hits"] / total["n"]
    z = (F.col("hits") - F.col("n") * p) / F.sqrt(F.col("n") * F.lit(p * (1 - p)))
    stems = stems.where("stem <> '' AND n >= 4").withColumn("z", z)
    # All that pass vote.  The lower end of Wilson's interval keeps out rare stems that are precise by chance.
    q, n, e = F.col("hits") / F.col("n"), F.col("n"), ERRORS**2
    least = (q + e / (2 * n) - ERRORS * F.sqrt(q * (1 - q) / n + e / (4 * n * n))) / (1 + e / n)
    precise = stems.where((F.col("hits") >= F.col("n") * PRECISE) & (F.col("z") > 3) & (least > 0.5)).orderBy(F.desc("z"), "stem")
    telling = stems.orderBy(F.desc(F.abs("z")), "stem").limit(FEATURES)
    return folded({r["stem"]: r["n"] for r in precise.collect()}), [r["stem"] for r in telling.collect()], p


def vote_counts(docs: DataFrame, voters: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """Rows, and how often voters fire alone and in pairs, over all of ``docs``."""

    def make():
        match = Matcher(voters)

        def fn(cols: dict) -> dict:
            pairs: Counter[tuple[int, int]] = Counter()
            for text in cols["text"]:
                got = sorted(votes_of(text, match))
                pairs.update((i, j) for i in got for j in got if i <= j)
            pairs[-1, -1] = len(cols["text"])
            return {"i": [i for i, _ in pairs], "j": [j for _, j in pairs], "n": list(pairs.values())}

        return fn

    m = len(voters) + len(PATTERNS)
    together, n = np.zeros((m, m)), 0.0
    for r in map_slices(docs, make, "i int, j int, n long", rows=2048).groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        if r["i"] < 0:
            n = float(r["n"])
        else:
            together[r["i"], r["j"]] = together[r["j"], r["i"]] = r["n"]
    return n, together.diagonal().copy(), together


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    docs = id_and_text(documents)
    known = materialize(of_distinct_texts(docs, known_labels(labels)), "toxic-labels")
    mined, stems, prior = mine_stems(labelled(docs, known))
    voters = list(dict.fromkeys([*mined, *SEED_LEXICON]))
    n, alone, together = vote_counts(docs.where(training(F.col("doc_id"))).select("text"), voters)
    model = fit_label_model(n, alone, together, prior)
    stems = list(dict.fromkeys([*voters, *stems]))

    def make():
        votes, features = Matcher(voters), Matcher(stems)

        def fn(cols: dict) -> dict:
            return {"soft": [model.posterior(votes_of(t, votes)) for t in cols["text"]], "features": [sorted(features(t)) for t in cols["text"]]}

        return fn

    rows = labelled(docs, sampled(known, sample), "broadcast")
    got = map_slices(rows, make, "soft double, features array<int>").collect() if mined else []
    # With no labelled rows the voters' own log odds are the classifier.
    odds = model.weight * np.log(model.toxic / model.clean)
    w = np.array([odds[i] if i < len(voters) else 0.0 for i in range(len(stems))] + [np.log(prior / (1 - prior))])
    if got:
        got.sort(key=lambda r: (r["soft"], r["features"]))
        w = fit_linear([set(r["features"]) for r in got], np.array([r["soft"] for r in got]), len(stems))
    return Model(voters, model, stems, w)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row."""
    docs = id_and_text(documents)

    def make():
        match, w = Matcher(model.stems), model.weights.tolist()

        def fn(cols: dict) -> dict:
            z = np.array([w[-1] + sum(w[i] for i in sorted(match(t))) for t in cols["text"]])
            return {"doc_id": cols["doc_id"], "score": (1 / (1 + np.exp(-np.clip(z, -30, 30)))).tolist()}

        return fn

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_slices(docs, make, f"doc_id {kind}, score double")


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the training rows, scores all, and marks the held-out ones."""
    s = score(documents, fit(documents, labels))
    return s.select("doc_id", F.coalesce(~training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``documents`` that score below ``threshold``, texts and columns unchanged."""
    schema = documents.schema

    def run(batches):
        import pyarrow as pa

        match, w = Matcher(model.stems), model.weights.tolist()
        limit = np.log(threshold / (1 - threshold))
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                keep = [w[-1] + sum(w[j] for j in sorted(match(t or ""))) < limit for t in part.column(at).to_pylist()]
                yield part.filter(pa.array(keep, pa.bool_()))

    return documents.mapInArrow(run, schema)
