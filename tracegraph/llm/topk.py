"""Exact top-k by inner product: no-random-access aggregation over sorted lists.

Each dimension of a block of candidates is a sorted list, read from the end
that the sign of a query's component favours.  All lists are read to the same
depth, in rounds.  After a round a candidate's known components are those no
worse than the frontier (the last value read) of their list.  Its score is the
known products plus what is unknown, which is no more than

* the frontier of each unread list, times the query's component, and
* by Cauchy and Schwarz, the product of what remains of the query's and of the
  candidate's length, which bounds it from below, too.

A candidate is open while its upper bound reaches the k-th best lower bound;
only open ones are looked at in later rounds.  A query stops reading when few
enough are open: no outsider can qualify, and the final scores of those few are
resolved.  What is left after the last round is resolved alike.

While many candidates are open a round is a matrix product over a tile of
queries; then it goes over the open pairs alone.  Bounds are sums of whole
numbers, exact in the floating type chosen; the square root is rounded up.

Queries and candidates are dealt into hashed blocks of bounded size, packed to
a row each in the narrowest whole numbers that hold them.  A task holds one pair
of blocks; blocks send their k best, which a window merges.  So the candidates
travel once for each block of queries, the queries once for each block of
candidates, and no score travels but k of each pair of blocks and query.

Cases: ties go to the smaller vec_id; vectors that are null, or hold a null or
non-finite component, take no part; vectors of different lengths have no score
together, empty ones score 0; rows repeating a vec_id are candidates each (of
equal rows the first k, as no more can be among the best), but a query is asked
once, with its smallest vector, and excludes every row with its id; an empty
table has no rows; other columns are ignored.  Scores are exact as long as
64-bit floats hold the sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

#: Vectors in a block, at most; smaller tables are cut into PARTS blocks of LEAST or more.
CANDIDATES, QUERIES, PARTS, LEAST = 131_072, 65_536, 64, 2_048
#: Candidates whose lists are read together, and pairs bounded at once.
READ, TILE, PAIRS = 16_384, 1 << 21, 1 << 16
#: Candidates a query may leave open when it stops reading.
OPEN = 64
#: Shares of the lists read by the end of each round.
DEPTHS = (0.5, 0.625, 0.75, 0.875, 0.95)
#: Rounds are matrix products while more than this share is open.
DENSE = 0.1


def quantised(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v array<long>``: valid vectors as floor(256 * x)."""
    x = F.col(vec_col)
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return df.where(F.col(id_col).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * 256).cast("long")).alias("v"))


def packed(rows: DataFrame, key: str, n: int) -> DataFrame:
    """One row per block and vector length: ids, components as raw little-endian numbers, and their kind."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        mat = np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), -1)
        most = int(np.abs(mat).max(initial=0))
        kind = next(k for k in ("<i2", "<i4", "<i8") if most <= np.iinfo(k).max)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "dim": [mat.shape[1]], "kind": [kind], "ids": [pdf["vec_id"].to_numpy("<i8").tobytes()], "vecs": [mat.astype(kind).tobytes()]})

    hashed = rows.withColumn(key, F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int")).withColumn("dim", F.size("v"))
    return hashed.groupBy(key, "dim").applyInPandas(pack, f"{key} int, dim int, kind string, ids binary, vecs binary")


def unpacked(row: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["vecs"], row["kind"]).reshape(len(ids), int(row["dim"])).astype(np.int64)


class Lists:
    """A block's sorted lists, and what is known of all its candidates at a depth."""

    def __init__(self, v: np.ndarray):
        self.v, self.lists = v, np.sort(v, axis=0)
        self.length2 = (v * v).sum(axis=1, dtype=np.float64)
        self.at: dict[float, tuple] = {}

    def frontier(self, depth: float) -> tuple[np.ndarray, np.ndarray]:
        """The last values read from the upper and from the lower end."""
        n = len(self.v)
        t = min(n, max(1, int(np.ceil(n * depth))))
        return self.lists[n - t], self.lists[t - 1]

    def known(self, depth: float) -> tuple[np.ndarray, ...]:
        """For both ends side by side: components or frontier, known components, and whether they are known."""
        if depth not in self.at:
            high, low = self.frontier(depth)
            seen = np.hstack([self.v >= high, self.v <= low])
            both = np.hstack([self.v, self.v])
            self.at[depth] = np.where(seen, both, np.hstack([high, low])), np.where(seen, both, 0), seen.astype(self.v.dtype)
        return self.at[depth]


def remainder(q2: np.ndarray, v2: np.ndarray) -> np.ndarray:
    """The most that unknown components can add or take, from the squared lengths that remain; rounded up."""
    return np.sqrt(np.maximum(q2, 0).astype(np.float64) * np.maximum(v2, 0)) * (1 + 1e-9) + 1e-6


def kth(rows: np.ndarray, value: np.ndarray, n_rows: int, k: int) -> np.ndarray:
    """By row, its k-th largest value (-inf if it has fewer); ``rows`` is sorted."""
    order = np.lexsort((-value, rows))
    first = np.searchsorted(rows, np.arange(n_rows + 1))
    at = first[:-1] + k - 1
    out = np.full(n_rows, -np.inf)
    fine = at < first[1:]
    out[fine] = value[order[at[fine]]]
    return out


def open_after(q: np.ndarray, block: Lists, depth: float, rows: np.ndarray, cols: np.ndarray, k: int) -> np.ndarray:
    """Which of the pairs are still open after a round; ``rows`` is sorted."""
    high, low = block.frontier(depth)
    upper, lower = np.empty(len(rows)), np.empty(len(rows))
    for at in range(0, len(rows), PAIRS):
        r, c = rows[at : at + PAIRS], cols[at : at + PAIRS]
        x, y = q[r], block.v[c]
        seen = np.where(x > 0, y >= high, y <= low)
        sure = np.where(seen, x * y, 0).sum(axis=1, dtype=np.float64)
        front = np.where(seen, 0, x * np.where(x > 0, high, low)).sum(axis=1, dtype=np.float64)
        rest = remainder(np.where(seen, 0, x * x).sum(axis=1, dtype=np.float64), np.where(seen, 0, y * y).sum(axis=1, dtype=np.float64))
        upper[at : at + PAIRS], lower[at : at + PAIRS] = sure + np.minimum(front, rest), sure - rest
    return upper >= kth(rows, lower, len(q), k)[rows]


def best_of(q: np.ndarray, q_ids: np.ndarray, v: np.ndarray, v_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of queries, of candidates, and scores of each query's k best, and the depth at which each query
    stopped; candidates come sorted by id."""
    n, dim = v.shape
    kind = np.float32 if max(float(np.abs(q).max(initial=0)), float(np.abs(v).max(initial=0))) ** 2 * max(dim, 1) < 2**24 else np.float64
    q, block = q.astype(kind), Lists(v.astype(kind))
    out, stopped = [], np.ones(len(q))
    tile = max(1, TILE // max(1, n))
    for start in range(0, len(q), tile):
        x = q[start : start + tile]
        ends = np.hstack([np.maximum(x, 0), np.minimum(x, 0)])
        side, length2 = (ends != 0).astype(kind), (x * x).sum(axis=1, dtype=np.float64)[:, None]
        alive = np.ones((len(x), n), bool)
        own = [np.searchsorted(v_ids, q_ids[start : start + tile], s) for s in ("left", "right")]
        for i in np.flatnonzero(own[0] < own[1]):
            alive[i, own[0][i] : own[1][i]] = False
        going = np.arange(len(x))
        rows = cols = np.zeros(0, np.int64)
        for depth in DEPTHS:
            if not len(rows):
                reach, sure, seen = block.known(depth)
                e = ends[going]
                known = (e @ sure.T).astype(np.float64)
                # A list that the query doesn't read has no part in the score: its whole length is unknown to no avail.
                rest = remainder(length2[going] - (e * e) @ seen.T, block.length2 - side[going] @ (sure * sure).T)
                open_ = alive[going]
                lower = np.where(open_, known - rest, -np.inf)
                m = min(k, n)
                floor = -np.partition(-lower, m - 1, axis=1)[:, m - 1 : m] if m == k else np.full((len(going), 1), -np.inf)
                alive[going] = open_ & (np.minimum(known + rest, e @ reach.T) >= floor)
                left = alive[going].sum(axis=1)
                stopped[start + going[left <= OPEN]] = depth
                going = going[left > OPEN]
                if len(going) and left[left > OPEN].mean() <= DENSE * n:
                    rows, cols = np.nonzero(alive[going])
                    rows = going[rows]
            else:
                stay = open_after(x, block, depth, rows, cols, k)
                alive[rows[~stay], cols[~stay]] = False
                rows, cols = rows[stay], cols[stay]
                left = np.bincount(rows, minlength=len(x))
                stopped[start + going[left[going] <= OPEN]] = depth
                going = going[left[going] > OPEN]
                more = left[rows] > OPEN
                rows, cols = rows[more], cols[more]
            if not len(going):
                break
        rows, cols = np.nonzero(alive)
        score = np.empty(len(rows))
        for at in range(0, len(rows), PAIRS):
            r, c = rows[at : at + PAIRS], cols[at : at + PAIRS]
            score[at : at + PAIRS] = (x[r] * block.v[c]).sum(axis=1, dtype=np.float64)
        order = np.lexsort((cols, -score, rows))
        rows, cols, score = rows[order], cols[order], score[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows, "left") < k
        out.append((start + rows[keep], cols[keep], score[keep]))
    rows, cols, score = (np.concatenate(a) for a in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
    return rows, cols, score, stopped


def blocks(n: int, most: int) -> int:
    """How many blocks ``n`` vectors make."""
    return max(1, -(-n // max(LEAST, min(most, -(-n // PARTS)))))


def top_k(df: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows whose id is divisible by ``every``, against all others."""
    rows = quantised(df, id_col, vec_col).groupBy("vec_id", "v").agg(F.count("*").alias("n"))
    rows = rows.withColumn("one", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int")))).select("vec_id", "v")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    sizes = df.agg(F.count("*"), F.count(F.when(F.col(id_col).cast("long") % every == 0, 1))).first()
    n_c, n_q = blocks(sizes[0], CANDIDATES), max(1, -(-sizes[1] // QUERIES))
    c = packed(rows, "c", n_c).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))
    a = packed(asked, "q", n_q).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [(np.zeros(0, np.int64),) * 3]
        if len(left) and len(right):
            (q_ids, q), (v_ids, v) = unpacked(left.iloc[0]), unpacked(right.iloc[0])
            for at in range(0, len(v), READ):
                r, s, x, _ = best_of(q, q_ids, v[at : at + READ], v_ids[at : at + READ], k)
                found.append((q_ids[r], v_ids[at + s], x.astype(np.int64)))
        return pd.DataFrame({name: np.concatenate(x) for name, x in zip(("query_id", "vec_id", "score"), zip(*found))})

    found = a.groupBy("q", "c", "dim").cogroup(c.groupBy("q", "c", "dim")).applyInPandas(score, "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
