"""Pre-tokenisation for byte-level BPE files, with caching of space-delimited chunks.

A text is cut at single spaces between two non-space characters.  There the
byte-level pattern always starts a new piece, so each chunk (with its leading
space) can be split on its own and remembered.  A text with a chunk for which
this does not hold (empty, or starting or ending with white space) is split as
a whole.
"""

from __future__ import annotations

import json
from collections.abc import Callable

#: The split pattern of byte-level BPE; a fixed value of the format.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Above this code point Unicode versions disagree on classes; the library's own splitter decides there.
AGREED = "ɏ"


def byte_chars() -> dict[str, int]:
    """Printable character of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens, merges and special tokens of a ``tokenizers`` byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        chars = byte_chars()
        to_bytes = lambda s: bytes(chars[c] for c in s)
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        vocab = data["model"]["vocab"]
        self.bytes_of: dict[int, bytes] = {i: s.encode() if s in self.special else to_bytes(s) for s, i in vocab.items()}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.id_of = {b: i for i, b in self.bytes_of.items() if i not in set(self.special.values())}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(data["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        self.byte_ids = [self.id_of[bytes([b])] for b in range(256)]


class Splitter:
    """Texts to segments (at special tokens) and segments to pieces."""

    def __init__(self, path: str, special: dict[str, int]):
        import regex
        from tokenizers import Tokenizer

        self.find = regex.compile(PATTERN).findall
        self.exotic = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.special = special
        self.cut = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def pieces(self, text: str) -> list[str]:
        if not text:
            return []
        if max(text) <= AGREED:
            return self.find(text)
        return [text[a:b] for a, b in self._spans(text)]

    def _spans(self, text: str) -> list[tuple[int, int]]:
        spans: list[tuple[int, int]] = []
        for _, (a, b) in self.exotic(text):
            if not spans or a >= spans[-1][1]:
                spans.append((a, b))
        return spans

    def segments(self, text: str) -> list[str | int]:
        """Text between special tokens, and the ids of those."""
        if self.cut is None or not any(s in text for s in self.special):
            return [text] if text else []
        out: list[str | int] = []
        at = 0
        for m in self.cut.finditer(text):
            if m.start() > at:
                out.append(text[at : m.start()])
            out.append(self.special[m[0]])
            at = m.end()
        return out + [text[at:]] * (at < len(text))


def weight(keys) -> int:
    """About how many bytes a cache takes for these keys and their values."""
    return 160 * len(keys) + 4 * sum(map(len, keys))


class ChunkCache:
    """Values of chunks, computed in batches from values of their pieces.

    ``encode`` maps a list of unseen pieces to their values; ``join`` combines
    the values of consecutive pieces.  Both caches are emptied at about
    ``limit`` bytes, so memory stays bounded whatever the corpus.
    """

    def __init__(self, splitter: Splitter, encode: Callable[[list[str]], list], join: Callable[[list], object], limit: int = 64 << 20):
        self.splitter, self.encode, self.join, self.limit = splitter, encode, join, limit
        self.chunks: dict[str, object] = {}
        self.known: dict[str, object] = {}
        self.chunk_bytes = self.known_bytes = 0

    def learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.known]
        if self.known_bytes + weight(new) > self.limit:
            self.known.clear()
            self.known_bytes, new = 0, list(pieces)
        self.known_bytes += weight(new)
        self.known.update(zip(new, self.encode(new), strict=True))

    def values(self, segments: list[str]) -> list:
        """The joined value of each non-empty segment."""
        cut = [s.split(" ") for s in segments]
        if self.chunk_bytes > self.limit:
            self.chunks.clear()
            self.chunk_bytes = 0
        new = set().union(*(c[1:] for c in cut)).difference(self.chunks)
        split: dict[str, list[str]] = {}
        bad: set[str] = set()
        for c in new:
            if c and not c[0].isspace() and not c[-1].isspace():
                split[c] = self.splitter.pieces(" " + c)
            else:
                bad.add(c)
        whole: dict[int, list[str]] = {}
        heads: dict[int, list[str]] = {}
        for i, c in enumerate(cut):
            if not c[0] or c[0][0].isspace() or c[0][-1].isspace() or bad and not bad.isdisjoint(c[1:]):
                whole[i] = self.splitter.pieces(segments[i])
            else:
                heads[i] = self.splitter.pieces(c[0])
        self.learn(set().union(*split.values(), *whole.values(), *heads.values()))
        known, join = self.known, self.join
        for c, p in split.items():
            self.chunks[c] = known[p[0]] if len(p) == 1 else join([known[x] for x in p])
        self.chunk_bytes += weight(split)
        get, out = self.chunks.__getitem__, []
        for i, c in enumerate(cut):
            if i in whole:
                out.append(join([known[x] for x in whole[i]]))
            else:
                out.append(join([*(known[x] for x in heads[i]), *map(get, c[1:])]))
        return out
