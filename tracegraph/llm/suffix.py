"""Removing long repeated byte strings with suffix arrays.

A byte goes if it lies in a string of ``length`` bytes that also starts in a
document with a smaller id.  Strings never cross documents.

1. Whole copies of a text are settled by its hash: only the first one goes on.
2. Texts are packed into compressed slices of bounded size.  Each string of
   ``length`` bytes is filed under the smallest hash of the ``GRAM``-byte strings
   in it, so equal strings have the same file; consecutive strings with the same
   one make a run.
3. Hashes travel alone, in buckets: those that one document only has are out.
4. The runs that are left go, once per slice and content, to the group of their
   hash, where strings are compared.  A group is worked in shards: each gets a
   suffix array by Larsson-Sadakane refinement, common prefixes by Kasai's
   inheritance (all runs in step), and from these its distinct strings with
   their smallest document, in order.  Shards are merged two by two, by binary search.
5. A bit for each string of a run goes back to its slice, which cuts.

Steps 3 and 4 decide what is worth comparing and where; only compared bytes
decide what is removed.  A hash that more than ``HOT`` slices share is first
worked by parts of the slices, each of which keeps one run of a content; only
these meet in the hash's group, and the parts pass its answers on.

Cases: a null or empty text has no bytes; texts shorter than ``length`` keep all;
rows with the same doc_id never take from each other; rows with a null doc_id
keep all and take nothing; an empty table has no rows; repeated rows are a row
each; other columns are ignored.  A text is never cut: it is hashed piece by
piece, and a task that holds it needs some ten bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tracegraph.llm._common import materialize

LENGTH = 50
GRAM = 16
SLICE_BYTES = 4 << 20
SHARD_BYTES = 4 << 20
#: Texts are hashed so many bytes at a time.
BLOCK_BYTES = 1 << 18
#: Strings in a run at most, so that a run's answer is one number.
RUN = 56
#: Slices that may share a hash before their runs are reduced in parts of about as many slices.
HOT = 64
END = b"\xff"  # never in UTF-8

SLICE_SCHEMA = "slice long, ids binary, sizes binary, runs binary, lows binary, body binary"
REPLY_SCHEMA = "slice long, kind int, part int, data binary"


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one number (the last seven positions are left out)."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def gram_hash(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    h = low * np.uint64(0x9E3779B97F4A7C15) + high * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def find_runs(texts: list[bytes], length: int, at_once: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Over all strings of all texts in order: lengths of the runs, and where in a run's first string its hash lies."""
    runs, lows = [], []
    width = length - GRAM + 1
    at = 0
    # Long texts by pieces, each with all strings that start in ``at_once`` bytes of the text.
    pieces = [t[o : o + at_once + length - 1] for t in texts for o in range(0, max(1, len(t) - length + 1), at_once)]
    while at < len(pieces):
        block, size = [], 0
        while at < len(pieces) and (not block or size + len(pieces[at]) <= at_once):
            block.append(pieces[at])
            size += len(pieces[at]) + 1
            at += 1
        data = np.frombuffer(END.join(block) + END + bytes(GRAM), np.uint8)
        words = words_at(data)
        h = gram_hash(words[:-8], words[8:])
        low, reach = h, 1
        while reach * 2 <= width:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if reach < width:
            low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
        sizes = np.array([len(t) for t in block])
        counts = np.maximum(sizes - length + 1, 0)
        starts = np.repeat(np.cumsum(sizes + 1) - sizes - 1, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        if not len(starts):
            continue
        value = low[starts]
        new = np.ones(len(starts), bool)
        new[1:] = value[1:] != value[:-1]
        new[(np.cumsum(counts) - counts)[counts > 0]] = True
        first = np.flatnonzero(new)
        lengths = np.diff(np.append(first, len(starts)))
        if lengths.max() > RUN:
            parts = -(-lengths // RUN)
            inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
            first = np.repeat(first, parts) + inner * RUN
            lengths = np.minimum(np.repeat(lengths, parts) - inner * RUN, RUN)
        offset = np.full(len(first), width, np.int64)
        todo = np.arange(len(first))
        for j in range(width):  # the leftmost place of the smallest hash
            hit = h[starts[first[todo]] + j] == value[first[todo]]
            offset[todo[hit]] = j
            todo = todo[~hit]
            if not len(todo):
                break
        runs.append(lengths.astype(np.uint8))
        lows.append(offset.astype(np.uint8))
    none = np.zeros(0, np.uint8)
    return np.concatenate([none, *runs]), np.concatenate([none, *lows])


class Slice:
    """The texts of a slice with their runs, unpacked."""

    def __init__(self, row: dict, length: int):
        import zstandard

        self.id, self.length = row["slice"], length
        self.ids, self.sizes = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["sizes"], np.int64)
        self.body = zstandard.ZstdDecompressor().decompress(row["body"])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.run = np.frombuffer(row["runs"], np.uint8).astype(np.int64)
        counts = np.maximum(self.sizes - length + 1, 0)
        string = np.cumsum(self.run) - self.run  # number of each run's first string
        upto = np.cumsum(counts)
        self.doc = np.searchsorted(upto, string, "right")
        self.at = self.starts[self.doc] + string - (upto - counts)[self.doc]
        place = self.at + np.frombuffer(row["lows"], np.uint8)
        words = words_at(np.frombuffer(self.body + bytes(16), np.uint8))
        self.hash = gram_hash(words[place], words[place + 8]) if len(place) else np.zeros(0, np.uint64)

    def keys(self, buckets: int) -> np.ndarray:
        """Bucket in the upper 24 bits, 40 bits of the hash below; a clash only adds a comparison."""
        return (self.hash & np.uint64(0xFFFFFF)) % np.uint64(buckets) << np.uint64(40) | self.hash >> np.uint64(24)

    def chosen(self, shared: np.ndarray, buckets: int) -> np.ndarray:
        """Positions of runs whose hash two documents have, here or elsewhere."""
        key = self.keys(buckets)
        wanted = np.zeros(len(key), bool)
        if len(shared):
            found = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
            wanted = shared[found] == key
        order = np.argsort(key, kind="stable")
        k, d = key[order], self.ids[self.doc[order]]
        head = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)
        if len(head):
            several = np.minimum.reduceat(d, head) != np.maximum.reduceat(d, head)
            wanted[order] |= np.repeat(several, np.diff(np.append(head, len(k))))
        return np.flatnonzero(wanted)

    def distinct(self, picked: np.ndarray, groups: int, hot: np.ndarray, buckets: int) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Contents of the picked runs in order of first use, each run's content, and each content's first run, group and whether its hash is hot."""
        body, extra, known = self.body, self.length - 1, {}
        number = [known.setdefault(body[a : a + n + extra], len(known)) for a, n in zip(self.at[picked].tolist(), self.run[picked].tolist())]
        first = picked[np.unique(np.array(number, np.int64), return_index=True)[1]] if number else np.zeros(0, np.int64)
        # All runs with one hash must meet, so the group comes from the hash alone.
        return list(known), np.array(number, np.int64), first, (self.hash[first] >> np.uint64(8)) % np.uint64(groups), np.isin(self.keys(buckets)[first], hot)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """All suffixes in order.

    Larsson-Sadakane: a rank is the number of the last place of its group, and
    only groups with more than one suffix are sorted again, by the rank of the
    suffix as far on as they agree.  The first pass takes eight bytes at once.
    """
    n = len(text)
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    key = words_at(padded)[:n].byteswap()
    order = np.argsort(key)
    k = key[order]
    rank, group_of = np.empty(n, np.int64), np.empty(n, np.int64)

    def regroup(places: np.ndarray, new: np.ndarray) -> None:
        """Ranks of the suffixes at sorted ``places``; ``new`` marks where groups begin."""
        head = np.flatnonzero(new)
        size = np.diff(np.append(head, len(places)))
        rank[order[places]] = np.repeat(places[head + size - 1], size)
        group_of[places] = np.repeat(places[head], size)

    regroup(np.arange(n), np.concatenate(([True], k[1:] != k[:-1])))
    h = 8
    while True:
        begin = group_of
        lone = np.ones(n, bool)
        lone[1:] = begin[1:] != begin[:-1]
        lone[:-1] &= lone[1:]
        places = np.flatnonzero(~lone)
        if not len(places):
            break
        ahead = order[places] + h
        next_rank = np.where(ahead < n, rank[np.minimum(ahead, n - 1)], -1)
        both = begin[places] * (n + 1) + next_rank + 1
        again = np.argsort(both)
        order[places] = order[places][again]
        b = both[again]
        regroup(places, np.concatenate(([True], b[1:] != b[:-1])))
        h *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, most: int) -> np.ndarray:
    """By suffix, the common prefix with its predecessor in ``order``, up to ``most``.

    Kasai: going one byte on in a text, at most one byte of it is lost.  All
    texts go on in step, the longest first, so a step is one array operation.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate((text, np.zeros(most + 1, np.uint8)))
    out = np.zeros(n, np.int64)
    by_size = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by_size], sizes[by_size]
    have = np.zeros(len(starts), np.int64)
    for j in range(int(sizes[0]) if len(sizes) else 0):
        live = int(np.searchsorted(-sizes, -j, "left"))
        p = starts[:live] + j
        q, common = before[p], np.maximum(have[:live] - 1, 0)
        todo = np.flatnonzero(q >= 0)
        common[q < 0] = 0
        while len(todo):
            a, b = p[todo] + common[todo], q[todo] + common[todo]
            same = (common[todo] < most) & (a < n) & (b < n) & (padded[np.minimum(a, n)] == padded[np.minimum(b, n)])
            todo = todo[same]
            common[todo] += 1
        have[:live] = common
        out[p] = common
    return out


def shard_strings(text: np.ndarray, starts: np.ndarray, runs: np.ndarray, docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct strings of a shard in order, the smallest document of each, and by run and string the number of its string."""
    order = suffix_array(text)
    common = common_prefixes(text, order, starts, runs + length, length)
    string_at = np.repeat(starts, runs) + np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
    which = np.full(len(text), -1, np.int64)
    which[string_at] = np.arange(len(string_at))
    owner = np.repeat(docs, runs)
    # Only strings count; a suffix that begins none has a terminator in its first bytes, so it parts no equal ones.
    new = common[order] < length
    number = np.cumsum(new) - 1
    strings = which[order] >= 0
    number, which_run = number[strings], which[order][strings]
    head = np.concatenate(([True], number[1:] != number[:-1]))
    low = np.minimum.reduceat(owner[which_run], np.flatnonzero(head))
    of = np.empty(len(string_at), np.int64)
    of[which_run] = np.cumsum(head) - 1
    first = string_at[which_run[head]]
    table = np.lib.stride_tricks.sliding_window_view(text, length)[first]
    return np.ascontiguousarray(table).view(f"S{length}").ravel(), low, of


def merged(tables: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Tables of distinct strings in order, with their smallest documents, as one; two by two."""
    while len(tables) > 1:
        pairs = [tables[i : i + 2] for i in range(0, len(tables), 2)]
        tables = [merge(*p) if len(p) == 2 else p[0] for p in pairs]
    return tables[0]


def merge(one: tuple[np.ndarray, np.ndarray], two: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The strings of ``two`` find their place among those of ``one`` by binary search."""
    (strings, low), (others, other_low) = one, two
    at = np.searchsorted(strings, others)
    same = strings[np.minimum(at, len(strings) - 1)] == others
    low = low.copy()
    low[at[same]] = np.minimum(low[at[same]], other_low[same])
    return np.insert(strings, at[~same], others[~same]), np.insert(low, at[~same], other_low[~same])


def answers(rows: list[dict], length: int, shard: int = SHARD_BYTES) -> list[np.ndarray]:
    """For each row of runs, a number per run: its bit j is set if string j also starts in a smaller document of the group.

    Equal contents are compared as one, under their smallest document: all
    strings of the others start in that one, too.
    """
    known: dict[bytes, int] = {}
    number = [known.setdefault(c, len(known)) for r in rows for c in r["body"].split(END)[:-1]]
    docs = np.concatenate([np.frombuffer(r["docs"], np.int64) for r in rows])
    number = np.array(number, np.int64)
    own = np.full(len(known), np.iinfo(np.int64).max)
    np.minimum.at(own, number, docs)
    contents = list(known)

    shards: list[list[int]] = []
    size = shard
    for i, c in enumerate(contents):
        if size + len(c) > shard:
            shards.append([])
            size = 0
        shards[-1].append(i)
        size += len(c) + 1
    done = []
    for members in shards:
        text = np.frombuffer(END.join([contents[i] for i in members]) + END, np.uint8)
        runs = np.array([len(contents[i]) for i in members], np.int64) - length + 1
        width = runs + length  # a terminator follows each content
        done.append((members, runs, *shard_strings(text, np.cumsum(width) - width, runs, own[members], length)))
    # All strings of the shards, in order; each shard then looks its own up.
    strings, smallest = merged([(d[2], d[3]) for d in done])
    lows = [smallest[np.searchsorted(strings, d[2])] for d in done]
    mask = np.zeros(len(contents), np.uint64)
    for (members, runs, _, _, of), low in zip(done, lows):
        first = np.cumsum(runs) - runs
        bit = (np.arange(len(of)) - np.repeat(first, runs)).astype(np.uint64)
        hit = low[of] < np.repeat(own[members], runs)
        mask[members] = np.add.reduceat(np.where(hit, np.uint64(1) << bit, np.uint64(0)), first)
    every = np.where(docs > own[number], np.uint64(2**64 - 1), mask[number])
    ends = np.cumsum([len(r["runs"]) for r in rows])
    return np.split(every, ends[:-1])


def pack(length: int):
    """Rows of (doc_id, text) to slices; documents lie in the order of their ids."""

    def close(number: int, held: list[tuple[int, bytes]]) -> pa.RecordBatch:
        import zstandard

        held.sort()
        texts = [t for _, t in held]
        runs, lows = find_runs(texts, length, BLOCK_BYTES)
        ids, sizes = np.array([i for i, _ in held], np.int64), np.array(list(map(len, texts)), np.int64)
        columns = [[number], [ids.tobytes()], [sizes.tobytes()], [runs.tobytes()], [lows.tobytes()], [zstandard.ZstdCompressor(level=1).compress(b"".join(texts))]]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), *[pa.binary()] * 5])], names=["slice", "ids", "sizes", "runs", "lows", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int, bytes]] = []
        size = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
                    held.append((i, t))
                    size += len(t) + 1
                    if size >= SLICE_BYTES:
                        yield close(number, held)
                        number, held, size = number + 1, [], 0
        if held:
            yield close(number, held)

    return run


def batch_of(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(schema)], names=[n for n, _ in schema])


BUCKET_ROW = [("bucket", pa.int32()), ("slice", pa.int64()), ("data", pa.binary())]
REPLY_ROW = [("slice", pa.int64()), ("kind", pa.int32()), ("part", pa.int32()), ("data", pa.binary())]
GROUP_ROW = [("part", pa.int32()), ("salt", pa.int32()), ("slice", pa.int64()), ("runs", pa.binary()), ("docs", pa.binary()), ("body", pa.binary())]
#: What groups return: answers (ANSWER), the distinct contents of a part of a hot group (PART), or its rows as they came (ROW).
WORKED_ROW = [("kind", pa.int32()), *GROUP_ROW]
GROUP_SCHEMA = "part int, salt int, slice long, runs binary, docs binary, body binary"
WORKED_SCHEMA = f"kind int, {GROUP_SCHEMA}"
# Kinds of replies to a slice: keys that others have, too; of these the hot ones; answers to its runs, and to its runs of hot groups.
SHARED, ANSWER, HOT_KEY, HOT_ANSWER, PART, ROW = range(6)
DOC_ROW = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())]


def five_bytes(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def from_five(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel()


def hashes_out(buckets: int, length: int):
    """Slices to a row per bucket with their distinct keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = Slice(batch.slice(i, 1).to_pylist()[0], length)
                key = np.unique(s.keys(buckets))
                bucket, first = np.unique(key >> np.uint64(40), return_index=True)
                ends = np.append(first[1:], len(key))
                yield batch_of(BUCKET_ROW, [(b, s.id, five_bytes(key[x:y])) for b, x, y in zip(bucket.tolist(), first, ends)])

    return run


def shared_keys(most: int):
    """Of a bucket: by slice, the keys that another slice has, too, and of these the hot ones; by whole columns, as a hot bucket has a row for each slice."""

    def run(table: pa.Table) -> pa.Table:
        slices, bucket = table["slice"].to_numpy(), table["bucket"][0].as_py()
        chunks = [c.cast(pa.large_binary()) for c in table["data"].chunks]
        offsets = [np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1] for c in chunks]
        key = np.concatenate([from_five(c.buffers()[2][int(o[0]) : int(o[-1])]) for c, o in zip(chunks, offsets)])
        row = np.repeat(np.arange(len(slices)), np.concatenate([np.diff(o) for o in offsets]) // 5)
        _, number, count = np.unique(key, return_inverse=True, return_counts=True)
        count = count[number]
        out = []
        for kind, wanted in ((SHARED, count > 1), (HOT_KEY, count > most)):
            rows, first = np.unique(row[wanted], return_index=True)
            data, ends = five_bytes(key[wanted]), 5 * np.append(first[1:], wanted.sum())
            values = pa.array([data[a:b] for a, b in zip((5 * first).tolist(), ends.tolist())], pa.binary())
            full = lambda x: pa.array(np.full(len(rows), x, np.int32))  # noqa: B023, E731
            out.append(pa.RecordBatch.from_arrays([pa.array(slices[rows]), full(kind), full(bucket), values], names=[n for n, _ in REPLY_ROW]))
        return pa.Table.from_batches(out)

    return run


def keys_of(rows: list[dict], kind: int) -> np.ndarray:
    keys = [from_five(r["data"]) | np.uint64(r["part"] << 40) for r in rows if r["kind"] == kind]
    return np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.uint64)


def contents_row(contents: list[bytes], docs: np.ndarray, length: int) -> tuple[bytes, bytes, bytes]:
    """``runs, docs, body`` of a row of runs."""
    return bytes(len(x) - length + 1 for x in contents), docs.astype(np.int64).tobytes(), END.join(contents) + END


def runs_out(buckets: int, groups: int, salts: int, length: int):
    """A slice and its shared keys to a row per group with its distinct contents; those of hot hashes apart, with a salt."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        replies = right.to_pylist()
        for row in left.to_pylist():
            s = Slice(row, length)
            contents, _, first, group, hot = s.distinct(s.chosen(keys_of(replies, SHARED), buckets), groups, keys_of(replies, HOT_KEY), buckets)
            docs, salt = s.ids[s.doc[first]], s.id * 0x9E3779B1 % (1 << 31) % salts
            for some, mark in ((np.flatnonzero(~hot), -1), (np.flatnonzero(hot), salt)):
                some = some[np.argsort(group[some], kind="stable")]
                cut = np.flatnonzero(np.append(True, group[some][1:] != group[some][:-1])) if len(some) else []
                for a, b in zip(cut, np.append(cut[1:], len(some))):
                    m = some[a:b]
                    out.append((int(group[m[0]]), mark, s.id, *contents_row([contents[x] for x in m.tolist()], docs[m], length)))
        return pa.Table.from_batches([batch_of(GROUP_ROW, out)])

    return run


def row_contents(row: dict) -> tuple[list[bytes], np.ndarray]:
    return row["body"].split(END)[:-1], np.frombuffer(row["docs"], np.int64)


def compare(length: int):
    """A group to its answers; a part of a hot one to its distinct contents with their smallest documents, and its rows."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["slice"])
        part, salt = rows[0]["part"], rows[0]["salt"]
        if salt < 0:
            out = [(ANSWER, part, salt, r["slice"], a.tobytes(), None, None) for r, a in zip(rows, answers(rows, length, SHARD_BYTES))]
        else:
            low: dict[bytes, int] = {}
            for r in rows:
                for c, d in zip(*row_contents(r)):
                    low[c] = min(low.get(c, d), d)
            out = [(PART, part, salt, salt, *contents_row(list(low), np.array(list(low.values()), np.int64), length))]
            out += [(ROW, part, salt, r["slice"], r["runs"], r["docs"], r["body"]) for r in rows]
        return pa.Table.from_batches([batch_of(WORKED_ROW, out)])

    return run


def compare_parts(length: int):
    """The parts of a hot group to an answer for each of them."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["salt"])
        return pa.Table.from_batches([batch_of(WORKED_ROW, [(ANSWER, r["part"], r["salt"], r["slice"], a.tobytes(), None, None) for r, a in zip(rows, answers(rows, length, SHARD_BYTES))])])

    return run


def pass_on(left: pa.Table, right: pa.Table) -> pa.Table:
    """A part's rows and answer to the answers of its slices: later documents than the part's first one lose every string."""
    rows, out = left.to_pylist(), []
    head = next(r for r in rows if r["kind"] == PART)
    contents, docs = row_contents(head)
    at, answer = {c: i for i, c in enumerate(contents)}, np.frombuffer(right.to_pylist()[0]["runs"], np.uint64)
    for r in rows:
        if r["kind"] == ROW:
            own, d = row_contents(r)
            i = np.array([at[c] for c in own], np.int64)
            out.append((r["slice"], HOT_ANSWER, r["part"], np.where(d > docs[i], np.uint64(2**64 - 1), answer[i]).tobytes()))
    return pa.Table.from_batches([batch_of(REPLY_ROW, out)])


def cut(buckets: int, groups: int, length: int, keep: bool):
    """A slice and all replies to it to a row per document."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        replies = right.to_pylist()
        for row in left.to_pylist():
            s = Slice(row, length)
            picked = s.chosen(keys_of(replies, SHARED), buckets)
            contents, number, first, group, hot = s.distinct(picked, groups, keys_of(replies, HOT_KEY), buckets)
            mask = np.zeros(len(contents), np.uint64)
            for kind, some in ((ANSWER, np.flatnonzero(~hot)), (HOT_ANSWER, np.flatnonzero(hot))):
                some = some[np.argsort(group[some], kind="stable")]
                for r in replies:
                    if r["kind"] == kind:
                        a, b = np.searchsorted(group[some], [np.uint64(r["part"]), np.uint64(r["part"] + 1)])
                        mask[some[a:b]] = np.frombuffer(r["data"], np.uint64)
            start = end = of = np.zeros(0, np.int64)
            if len(picked):
                bits = mask[number]
                bits[s.ids[s.doc[picked]] > s.ids[s.doc[first]][number]] = np.uint64(2**64 - 1)  # a document before it in this slice has the same run
                runs = s.run[picked]
                j = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
                hit = (np.repeat(bits, runs) >> j.astype(np.uint64) & np.uint64(1)).astype(bool)
                at, doc = (np.repeat(s.at[picked], runs) + j)[hit], np.repeat(s.doc[picked], runs)[hit]
                if len(at):
                    new = np.flatnonzero(np.append(True, (at[1:] > at[:-1] + length) | (doc[1:] != doc[:-1])))
                    start, end, of = at[new], at[np.append(new[1:], len(at)) - 1] + length, doc[new]
            spans = np.searchsorted(of, np.arange(len(s.ids) + 1))
            for k, (i, a, n) in enumerate(zip(s.ids.tolist(), s.starts.tolist(), s.sizes.tolist())):
                x, y = start[spans[k] : spans[k + 1]].tolist(), end[spans[k] : spans[k + 1]].tolist()
                text = b"".join([s.body[u:v] for u, v in zip([a, *y], [*x, a + n])])
                out.append((i, n, n - len(text), len(x), sha256(text).hexdigest(), text if keep else None))
        return pa.Table.from_batches([batch_of(DOC_ROW, out)])

    return run


def remove_repeats(df: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if ``keep``, the remaining bytes ``kept``, of every row."""
    if length < GRAM or length > 255 - RUN:
        raise ValueError(f"length is {GRAM} to {255 - RUN} bytes")
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    raw = F.col("text").cast("binary")
    facts = materialize(docs.select("doc_id", F.sha2(raw, 256).alias("sha"), F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    first = facts.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    copies = materialize(facts.join(materialize(first.select("sha", "first_id"), "first-texts"), "sha").where("doc_id > first_id").drop("first_id"), "copies")
    total = facts.agg(F.sum("n_bytes")).first()[0] or 0
    # Both counts follow the bytes, so buckets and groups keep their size.
    buckets, groups = max(8, min(1 << 24, total // (24 << 20))), max(8, total // (4 << 20))
    salts = max(2, total // (SLICE_BYTES * HOT))

    # Always dealt by id, small as the copies may be: one way at every size.
    # The hash is part of the key: of rows with one doc_id, some may be copies and others not.
    known = copies.select(F.col("doc_id").alias("c"), F.col("sha").alias("c_sha"))
    dealt = docs.where("doc_id IS NOT NULL").withColumn("sha", F.sha2(raw, 256)).hint("merge")
    own = dealt.join(known, (F.col("doc_id") == F.col("c")) & (F.col("sha") == F.col("c_sha")), "left_anti").select("doc_id", "text")
    slices = materialize(own.mapInArrow(pack(length), SLICE_SCHEMA), "slices")
    hashes = slices.mapInArrow(hashes_out(buckets, length), "bucket int, slice long, data binary")
    shared = materialize(hashes.groupBy("bucket").applyInArrow(shared_keys(HOT), REPLY_SCHEMA), "shared-keys")
    sent = slices.groupBy("slice").cogroup(shared.groupBy("slice")).applyInArrow(runs_out(buckets, groups, salts, length), GROUP_SCHEMA)
    worked = materialize(sent.groupBy("part", "salt").applyInArrow(compare(length), WORKED_SCHEMA), "answers")
    parts = worked.where(F.col("kind") == PART).groupBy("part").applyInArrow(compare_parts(length), WORKED_SCHEMA)
    hot = worked.where(F.col("kind").isin(PART, ROW)).groupBy("part", "salt").cogroup(parts.groupBy("part", "salt")).applyInArrow(pass_on, REPLY_SCHEMA)
    replies = worked.where(F.col("kind") == ANSWER).select("slice", "kind", "part", F.col("runs").alias("data")).unionByName(materialize(hot, "hot-answers"))
    result = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    done = slices.groupBy("slice").cogroup(shared.unionByName(replies).groupBy("slice")).applyInArrow(cut(buckets, groups, length, keep), result)

    nothing = F.lit(sha256(b"").hexdigest())
    whole = F.col("n_bytes") >= length
    gone = copies.select("doc_id", "n_bytes", F.when(whole, F.col("n_bytes")).otherwise(0).alias("n_removed"), F.when(whole, 1).otherwise(0).cast("long").alias("n_spans"), F.when(whole, nothing).otherwise(F.col("sha")).alias("kept_sha256"))
    lone = facts.where("doc_id IS NULL").select("doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"))
    if not keep:
        return done.drop("kept").unionByName(gone).unionByName(lone)
    short = docs.where(F.octet_length("text") < length).select("doc_id", F.sha2(raw, 256).alias("kept_sha256"), raw.alias("kept")).distinct()
    gone = gone.join(short, ["doc_id", "kept_sha256"], "left").withColumn("kept", F.coalesce("kept", F.lit(b""))).select(*done.columns)
    return done.unionByName(gone).unionByName(lone.join(docs.where("doc_id IS NULL").select(F.sha2(raw, 256).alias("kept_sha256"), raw.alias("kept")).distinct(), "kept_sha256").select(*done.columns))
