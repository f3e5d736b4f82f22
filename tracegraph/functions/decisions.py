"""Decisions in chat turns: cue phrases, the sentence around one, and what it supersedes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed phrases; the first of the list that a text contains is its cue.
CUES = (
    "we'll use", "let's use", "i'll use", "decided to", "decision:", "go with", "going with", "switch to", "switching to", "instead of",
    "chose ", "we should use", "rejected", "trade-off", "tradeoff", "the plan is",
)
# Fixed phrases; what follows one is the superseded choice.
SUPERSEDE_CUES = ("instead of ", "rather than ", "in place of ", "switch from ", "switching from ", "migrate off ", "moving off ", "replacing ", "supersedes ", "deprecates ")
# Fixed words: never the subject.
SUBJECT_STOP = ("the", "a", "an", "our", "its", "this", "that", "using", "use", "old")

MIN_WORDS = 5
CONFIDENCE = 0.5
EXTRACTOR = "deterministic-v1"


def first_cue(text: Column) -> Column:
    lower = F.lower(text)
    return F.coalesce(*[F.when(F.contains(lower, F.lit(c)), F.lit(c)) for c in CUES])


def sentence_around(text: Column) -> Column:
    """The sentence around the first occurrence of the text's cue, at most 280 characters; null without one."""
    lower = F.lower(text)
    out = F.lit(None).cast("string")
    for cue in reversed(CUES):
        found = F.regexp_extract(text, rf"(?i)([^.!?\n]*?\Q{cue}\E[^.!?\n]*[.!?\n]?)", 1)
        out = F.when(F.contains(lower, F.lit(cue)), found).otherwise(out)
    return F.substring(F.regexp_replace(out, r"^\s+|\s+$", ""), 1, 280)


def decision_text(text: Column) -> Column:
    """The sentence that states a decision, if it has five words or more; else null."""
    s = sentence_around(text)
    return F.when(F.size(F.split(F.trim(s), r"\s+")) >= MIN_WORDS, s)


def superseded_subject(text: Column) -> Column:
    """The first telling token after a superseding phrase, in list order; null if there is none."""
    lower = F.lower(text)

    def after(cue: str) -> Column:
        rest = F.substr(lower, F.locate(cue, lower) + len(cue))
        words = F.filter(F.split(rest, r"[^\p{IsAlphabetic}\p{N}]+"), lambda t: (F.octet_length(t) > 2) & ~t.isin(*SUBJECT_STOP))
        return F.when(F.contains(lower, F.lit(cue)), F.try_element_at(words, F.lit(1)))

    return F.coalesce(*[after(c) for c in SUPERSEDE_CUES])
