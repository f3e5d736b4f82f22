"""Token counts by rank-synchronous merging of ragged arrays.

Method.  The distinct unseen pieces of a slice of documents are laid end to end
in one numpy array of byte tokens.  In each round every sequence finds the
lowest rank among its adjacent pairs, and all sequences apply theirs at once
(every occurrence of that pair, from the left).  A sequence without a
mergeable pair leaves the batch; its surviving symbols are its token count.

Cases: a null or empty text counts 0; strings of special tokens inside a text
count as one token, the library's default; repeated rows give equal rows; other
columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from tracegraph.llm._common import id_and_text, map_slices
from tracegraph.llm.pretoken import ChunkCache, Splitter, Vocabulary

DEFAULT = "byte_bpe_50k.json"
NONE = np.int64(1 << 40)
SLOTS = 1 << 18


class PairTable:
    """Open-addressing hash table from a pair of ids to rank and merged id."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]]):
        keys = np.array([a << 20 | b for a, b in pairs], np.int64)
        self.rank_of = np.array([r for r, _ in pairs.values()], np.int64)
        self.merged_of = np.array([m for _, m in pairs.values()], np.int64)
        self.keys = np.full(SLOTS, -1, np.int64)
        self.index = np.zeros(SLOTS, np.int64)
        slot, left, self.probes = self.slot(keys), np.arange(len(keys)), 0
        while len(left):
            self.probes += 1
            free = self.keys[slot[left]] < 0
            first = np.unique(slot[left[free]], return_index=True)[1]
            won = left[free][first]
            self.keys[slot[won]], self.index[slot[won]] = keys[won], won
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) % SLOTS

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks (NONE if the pair doesn't merge) and positions in ``merged_of``."""
        keys = a << 20 | b
        slot = self.slot(keys)
        rank, where = np.full(len(keys), NONE), np.zeros(len(keys), np.int64)
        open_ = np.arange(len(keys))
        for _ in range(self.probes):
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            won = open_[hit]
            where[won] = self.index[slot[won]]
            rank[won] = self.rank_of[where[won]]
            open_ = open_[~hit & (there >= 0)]
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) % SLOTS
        return rank, where


def merge_counts(words: list[bytes], byte_ids: np.ndarray, table: PairTable) -> np.ndarray:
    """Number of symbols of each word after all merges."""
    sizes = np.array([len(w) for w in words], np.int64)
    counts = sizes.copy()
    symbols = byte_ids[np.frombuffer(b"".join(words), np.uint8)]
    owner = np.repeat(np.arange(len(words)), sizes)
    keep = counts[owner] > 1
    symbols, owner = symbols[keep], owner[keep]
    while len(symbols):
        same = owner[1:] == owner[:-1]
        rank = np.full(len(symbols), NONE)
        where = np.zeros(len(symbols), np.int64)
        left = np.flatnonzero(same)
        rank[left], where[left] = table.lookup(symbols[left], symbols[left + 1])
        starts = np.flatnonzero(np.concatenate(([True], ~same)))
        lengths = np.diff(np.append(starts, len(symbols)))
        lowest = np.repeat(np.minimum.reduceat(rank, starts), lengths)
        chosen = (rank == lowest) & (lowest < NONE)
        # Overlapping occurrences (a run of one symbol): from the left, every second one.
        at = np.flatnonzero(chosen)
        if len(at) > 1 and (np.diff(at) == 1).any():
            begin = np.concatenate(([True], np.diff(at) != 1))
            run = np.maximum.accumulate(np.where(begin, np.arange(len(at)), 0))
            chosen[at[(np.arange(len(at)) - run) % 2 == 1]] = False
            at = np.flatnonzero(chosen)
        symbols[at] = table.merged_of[where[at]]
        counts -= np.bincount(owner[at], minlength=len(counts))
        alive = lowest < NONE
        alive[at + 1] = False
        symbols, owner = symbols[alive], owner[alive]
    return counts


class Counter:
    """Token counts of texts for one vocabulary file."""

    def __init__(self, path: str):
        v = Vocabulary(path)
        self.splitter = Splitter(path, v.special)
        self.byte_ids, self.table = np.array(v.byte_ids, np.int64), PairTable(v.pairs)
        self.cache = ChunkCache(self.splitter, self._counts, sum)

    def _counts(self, pieces: list[str]) -> list[int]:
        words = [p.encode() for p in pieces]
        return [n for i in range(0, len(words), 50_000) for n in merge_counts(words[i : i + 50_000], self.byte_ids, self.table).tolist()]

    def count(self, texts: list[str]) -> list[int]:
        cut = [self.splitter.segments(t) for t in texts]
        values = iter(self.cache.values([s for c in cut for s in c if isinstance(s, str)]))
        return [sum(1 if isinstance(s, int) else next(values) for s in c) for c in cut]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, path: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens) of every row."""
    path = path or public_tokenizers.path(DEFAULT)
    docs = id_and_text(df, id_col, text_col)

    def make():
        c = counter(path)

        def fn(cols: dict) -> dict:
            n = c.count(cols[text_col])
            return {id_col: cols[id_col], "n_bytes": [len(t.encode()) for t in cols[text_col]], "n_tokens": n, "over_limit": [x > limit for x in n]}

        return fn

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs, make, f"{id_col} {kind}, n_bytes long, n_tokens long, over_limit boolean")
