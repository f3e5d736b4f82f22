"""Byte-level BPE encoding and decoding over a prefix-sharing trie.

Method.  The distinct unseen pieces of a slice of documents go into a trie.  A
depth-first walk carries, for each prefix on the path, the last token of that
prefix's encoding.  The last token of a longer prefix is the one vocabulary
suffix ``t`` of it for which the token ending just before ``t`` may stand next
to ``t``, i.e. merging the bytes of both gives the two back.  So a prefix that
many words share is encoded once, and the ids of a word are read backwards off
the path.

Cases: a null or empty text has no tokens; strings of special tokens inside a
text become their ids, as the library does by default; repeated rows give equal
rows; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame

from tracegraph.llm._common import id_and_text, map_slices
from tracegraph.llm.pretoken import ChunkCache, Splitter, Vocabulary

DEFAULT = "byte_bpe_50k.json"

#: Remembered steps and decisions, of some 100 bytes each, at which either is forgotten.
ENTRIES = 1_000_000


class TrieEncoder:
    """Encodings of words by a depth-first walk of their trie."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.self_encoding: dict[int, bool] = {}
        self.compatible: dict[int, bool] = {}
        #: Aho-Corasick automaton of the vocabulary: ``ends[state]`` lists width and id of the tokens ending there, longest first.
        self.goto: dict[int, int] = {}
        token_at, order = {0: None}, [(0, 0, 0)]
        for token, i in vocabulary.id_of.items():
            state = 0
            for b in token:
                key = state << 8 | b
                state = self.goto.get(key, -1)
                if state < 0:
                    state = self.goto[key] = len(token_at)
                    token_at[state] = None
                    order.append((state, key >> 8, b))
            token_at[state] = (len(token), i)
        children: dict[int, list[tuple[int, int]]] = {}
        for state, parent, b in order[1:]:
            children.setdefault(parent, []).append((state, b))
        self.fail = [0] * len(token_at)
        self.ends: list[tuple] = [()] * len(token_at)
        level = [0]
        while level:
            below = []
            for parent in level:
                for state, b in children.get(parent, ()):
                    self.fail[state] = self.step(self.fail[parent], b) if parent else 0
                    own = token_at[state]
                    self.ends[state] = ((own,) if own else ()) + self.ends[self.fail[state]]
                    below.append(state)
            level = below
        self.fixed = len(self.goto)

    def step(self, state: int, b: int) -> int:
        """The state after byte ``b``; transitions over fail links are remembered."""
        key = state << 8 | b
        to = self.goto.get(key)
        while to is None and state:
            state = self.fail[state]
            to = self.goto.get(state << 8 | b)
        return to or 0

    def merge(self, ids: list[int]) -> list[int]:
        """Plain lowest-rank-first merging, used for pairs of tokens only."""
        pairs = self.v.pairs
        while len(ids) > 1:
            best, at = min((pairs.get((a, b), (1 << 60, 0))[0], k) for k, (a, b) in enumerate(zip(ids, ids[1:])))
            if best == 1 << 60:
                break
            ids[at : at + 2] = [pairs[ids[at], ids[at + 1]][1]]
        return ids

    def may_follow(self, s: int, t: int) -> bool:
        key = s << 20 | t
        ok = self.compatible.get(key)
        if ok is None:
            if len(self.compatible) > ENTRIES:
                self.compatible.clear()
            raw = self.v.bytes_of[s] + self.v.bytes_of[t]
            ok = self.compatible[key] = self.merge([self.v.byte_ids[b] for b in raw]) == [s, t]
        return ok

    def alone(self, t: int) -> bool:
        ok = self.self_encoding.get(t)
        if ok is None:
            ok = self.self_encoding[t] = self.merge([self.v.byte_ids[b] for b in self.v.bytes_of[t]]) == [t]
        return ok

    def encode(self, words: list[bytes]) -> dict[bytes, list[int]]:
        trie: dict = {}
        for w in words:
            node = trie
            for b in w:
                child = node.get(b)
                if child is None:
                    child = node[b] = {}
                node = child
            node[256] = w
        out: dict[bytes, list[int]] = {b"": []}
        longest = max(map(len, words), default=0)
        last, width = [-1] * (longest + 1), [0] * (longest + 1)
        goto, ends, compatible = self.goto, self.ends, self.compatible
        if len(goto) > self.fixed + ENTRIES:
            for key in [k for i, k in enumerate(goto) if i >= self.fixed]:
                del goto[key]
        todo = [(node, 1, 0, b) for b, node in trie.items() if b != 256]
        pop, push = todo.pop, todo.append
        while todo:
            node, depth, state, byte = pop()
            key = state << 8 | byte
            state = goto.get(key)
            if state is None:
                state = goto[key] = self.step(key >> 8, byte)
            for n, token in ends[state]:
                if n < depth:
                    ok = compatible.get(last[depth - n] << 20 | token)
                    if ok is None:
                        ok = self.may_follow(last[depth - n], token)
                else:
                    ok = self.alone(token)
                if ok:
                    last[depth], width[depth] = token, n
                    break
            for b, child in node.items():
                if b == 256:
                    ids, d = [], depth
                    while d:
                        ids.append(last[d])
                        d -= width[d]
                    out[child] = ids[::-1]
                else:
                    push((child, depth + 1, state, b))
        return out


class Codec:
    """Texts to ids and ids to texts, for one vocabulary file."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.splitter = Splitter(path, self.v.special)
        self.trie = TrieEncoder(self.v)
        self.cache = ChunkCache(self.splitter, self._strings, ",".join)
        ids = sorted(self.v.bytes_of)
        self.length = np.zeros(ids[-1] + 1, np.int64)
        self.start = np.zeros(ids[-1] + 1, np.int64)
        raw, at = [], 0
        for i in ids:
            token = self.v.bytes_of[i]
            self.length[i], self.start[i] = len(token), at
            raw.append(token)
            at += len(token)
        self.flat = np.frombuffer(b"".join(raw), np.uint8)

    def _strings(self, pieces: list[str]) -> list[str]:
        words = [p.encode() for p in pieces]
        got = self.trie.encode(words)
        return [",".join(map(str, got[w])) for w in words]

    def encode_joined(self, texts: list[str]) -> list[str]:
        """Decimal ids of each text, joined by commas."""
        cut = [self.splitter.segments(t) for t in texts]
        values = iter(self.cache.values([s for c in cut for s in c if isinstance(s, str)]))
        return [",".join(str(s) if isinstance(s, int) else next(values) for s in c) for c in cut]

    def decode(self, ids: np.ndarray) -> str:
        """The text of an id sequence; bytes that are no UTF-8 become U+FFFD."""
        if not len(ids):
            return ""
        n = self.length[ids]
        shift = self.start[ids] - (np.cumsum(n) - n)
        return self.flat[np.repeat(shift, n) + np.arange(n.sum())].tobytes().decode("utf-8", "replace")


def parse_ids(joined: str) -> np.ndarray:
    return np.fromstring(joined, dtype=np.int64, sep=",") if joined else np.zeros(0, np.int64)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    """One codec per worker process and file."""
    return Codec(path)


def encode(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids array<int>`` and ``decoded string`` of every row."""
    path = path or public_tokenizers.path(DEFAULT)
    docs = id_and_text(df, id_col, text_col)

    def make():
        c = codec(path)

        def fn(cols: dict) -> dict:
            ids = [parse_ids(s) for s in c.encode_joined(cols[text_col])]
            return {id_col: cols[id_col], "ids": ids, "decoded": [c.decode(x) for x in ids]}

        return fn

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs, make, f"{id_col} {kind}, ids array<int>, decoded string")


def digests(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of the round trip."""
    from hashlib import sha256

    path = path or public_tokenizers.path(DEFAULT)
    docs = id_and_text(df, id_col, text_col)

    def make():
        c = codec(path)

        def fn(cols: dict) -> dict:
            out: dict = {id_col: cols[id_col], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for joined in c.encode_joined(cols[text_col]):
                ids = parse_ids(joined)
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(sha256(joined.encode()).hexdigest())
                out["decoded_sha256"].append(sha256(c.decode(ids).encode()).hexdigest())
            return out

        return fn

    kind = docs.schema[id_col].dataType.simpleString()
    return map_slices(docs, make, f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
