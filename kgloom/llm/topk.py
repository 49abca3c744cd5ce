"""Exact top-k search by inner product, by aggregation without random access.

In a block of candidates every dimension is a list of the block's vectors sorted by that component. A query reads the
lists of its positive weights from the top and those of its negative weights from the bottom, all in step, and adds what
it reads to the partial scores of the vectors it meets. What has been read of a vector and the places that the cursors
have reached, in the lists it hasn't been met in, give its upper bound; with the far ends of the lists it is its lower
bound. A vector whose upper bound is below the k-th lower bound, or below the k-th score of earlier blocks, is an outsider.
A query stops when all are outsiders but a share RESOLVE of the block, and the final scores of those are resolved from the
components that haven't been met yet. A task's first block is small, and so gives the others a k-th score to begin with.

Bounds are floating point numbers with as much to spare as sums can lose by rounding; where scores may exceed 2^52, final
scores are sums of Python's integers, so size changes nothing else.

Candidates stay where they are: each task reads its own partition in blocks of bounded size and never moves a vector.
Queries are dealt to blocks of bounded bytes that are broadcast one after the other; more queries mean more passes over
the candidates. A task keeps k rows for each query of the block, and these are merged by a window.

Defined results: components become floor(256 * x). Rows without id, with a null vector, or with a null, NaN or infinite
component take no part. A vector shorter than others has zeros at its end. Candidates are all rows whose id is not the
query's, repeated rows each for themselves; a query whose id is repeated is asked once for each distinct vector, and the
best k of all answers to the id are given. Scores beyond 64 bits are held at its ends, and are ties there.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

K, SCALE, EVERY = 5, 256, 50
#: Candidates of a block, and queries asked of it at once: a task holds a few matrices of their product.
CANDIDATES, QUERIES = 4096, 256
#: Components of a block of candidates: of long vectors it holds fewer.
COMPONENTS = 1 << 19
#: Bytes of the queries that are broadcast at once.
QUERY_BYTES = 32 << 20
#: Shares of the lists after which bounds are compared; the last reads them to the end.
DEPTHS = (0.6, 0.75, 0.9, 1.0)
#: Share of a block whose final scores are resolved when all others are outsiders, and candidates of a first block.
RESOLVE, FIRST = 0.1, 256
#: Scores beyond are held there.
MOST = 2**63 - 1
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and its components as integers; only rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


class Lists:
    """The sorted lists of a block, read by many queries in step.

    A list is held as the place of every vector in it. What all queries read between two depths is one matrix, which holds
    the components met there and zeros elsewhere; adding it to the partial scores is one product for all queries.
    """

    def __init__(self, x: np.ndarray):
        self.x, self.n = x, len(x)
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, axis=0)
        self.place = np.empty(x.shape, np.int32)
        np.put_along_axis(self.place, order, np.broadcast_to(np.arange(self.n, dtype=np.int32)[:, None], x.shape), axis=0)
        self.reads = self.resolved = 0
        self.made: dict[tuple, np.ndarray] = {}

    def _met(self, start: int, end: int) -> np.ndarray:
        """Components met between two depths: from the top for positive weights, from the bottom for negative ones."""
        if ("met", start, end) not in self.made:
            top = (self.place >= self.n - end) & (self.place < self.n - start)
            bottom = (self.place >= start) & (self.place < end)
            self.made["met", start, end] = np.hstack([np.where(top, self.x, 0), np.where(bottom, self.x, 0)]).T.copy()
        return self.made["met", start, end]

    def _unmet(self, depth: int, top: np.ndarray, bottom: np.ndarray, name: str) -> np.ndarray:
        """The given value of each list wherever a vector hasn't been met in it."""
        if (name, depth) not in self.made:
            self.made[name, depth] = np.hstack([np.where(self.place < self.n - depth, top, 0), np.where(self.place >= depth, bottom, 0)]).T.copy()
        return self.made[name, depth]

    @staticmethod
    def weights(q: np.ndarray) -> np.ndarray:
        return np.hstack([np.maximum(q, 0), np.minimum(q, 0)])

    def read(self, q: np.ndarray, partial: np.ndarray, start: int, end: int) -> None:
        """Adds entries [start, end) of every list to the partial scores (queries x vectors)."""
        partial += self.weights(q) @ self._met(start, end)
        self.reads += int(np.count_nonzero(q)) * (end - start)

    def high(self, q: np.ndarray, depth: int) -> np.ndarray:
        """What each vector's components that haven't been met can add at most: the cursors' places."""
        return self.weights(q) @ self._unmet(depth, self.sorted[self.n - depth], self.sorted[depth - 1], "high")

    def low(self, q: np.ndarray, depth: int) -> np.ndarray:
        """What they add at least: the ends of the lists."""
        return self.weights(q) @ self._unmet(depth, self.sorted[0], self.sorted[-1], "low")

    def resolve(self, q: np.ndarray, rest: np.ndarray, depth: int) -> None:
        """Counts the components of the given vectors that a query hasn't met."""
        if depth < self.n:
            at = self.place[rest]
            self.resolved += int(((at < self.n - depth) & (q > 0)).sum() + ((at >= depth) & (q < 0)).sum())


def nra(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, lists: Lists, k: int, floor: np.ndarray | None = None, slack: float = 0.0, whole: tuple[np.ndarray, np.ndarray] | None = None) -> list[tuple[int, int, int]]:
    """(place of the query, vector, score) of the k best vectors of a block for each query.

    floor: a score for each query; vectors below it may be left out. slack: what rounding can take from a sum. whole:
    queries and vectors as integers, from which final scores are summed if q's and the lists' type doesn't hold them exactly.
    """
    out: list[tuple[int, int, int]] = []
    n, left = lists.n, np.arange(len(q))
    partial, depth = np.zeros((len(q), n), q.dtype), 0
    own = q_ids[:, None] == x_ids[None, :]
    floor = np.full(len(q), -np.inf) if floor is None else floor
    for share in DEPTHS:
        end = max(1, math.ceil(n * share))
        lists.read(q[left], partial, depth, end)
        depth = end
        upper = partial + slack + (lists.high(q[left], depth) if depth < n else 0)
        upper[own] = -np.inf
        least = floor[left]
        if n > k and (depth == n or np.isneginf(least).any()):
            lower = partial - slack + (lists.low(q[left], depth) if depth < n else 0)
            lower[own] = -np.inf
            least = np.maximum(least, np.partition(lower, n - k, axis=1)[:, n - k])
        may = (upper >= np.minimum(least, float(MOST))[:, None]) & (upper > -np.inf)
        done = (may.sum(axis=1) <= max(k, RESOLVE * n)) | (depth == n)
        for at in np.flatnonzero(done).tolist():
            rest = np.flatnonzero(may[at])
            place = int(left[at])
            lists.resolve(q[place], rest, depth)
            if whole is None:
                scores = partial[at, rest] if depth == n else lists.x[rest] @ q[place]
            else:
                exact = (sum(map(int.__mul__, whole[0][place].tolist(), v)) for v in whole[1][rest].tolist())
                scores = np.array([max(-MOST - 1, min(MOST, s)) for s in exact], np.int64)
            best = np.lexsort((x_ids[rest], -scores if whole is None else ~scores))[:k]
            out += zip([place] * len(best), x_ids[rest[best]].tolist(), scores[best].astype(np.int64).tolist(), strict=True)
        left, partial, own = left[~done], partial[~done], own[~done]
        if not len(left):
            break
    return out


def _matrix(lists: pa.Array, width: int = 0) -> np.ndarray:
    sizes = lists.value_lengths().to_numpy()
    m = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))), np.int64)
    m[np.arange(m.shape[1]) < sizes[:, None]] = lists.flatten().to_numpy()
    return m


def _most(m: np.ndarray) -> float:
    return max(1.0, float(np.abs(m.astype(float)).max(initial=0)))


class _Best:
    """The k best of each query over the blocks of one task."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int):
        self.q_ids, self.q, self.k = q_ids, q, k
        self.held: list[list[tuple[int, int]]] = [[] for _ in q_ids]
        self.floor = np.full(len(q_ids), -np.inf)
        self.size = _most(q)
        self.reads = self.there = 0  # entries of lists, and those of them that were read

    def see(self, x_ids: np.ndarray, x: np.ndarray, queries: int) -> None:
        width = max(x.shape[1], self.q.shape[1])
        q, x = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (self.q, x))
        if not width:  # without components all scores are 0
            q, x = np.zeros((len(q), 1), np.int64), np.zeros((len(x), 1), np.int64)
        largest = self.size * _most(x) * max(width, 1)
        exact = largest < 2**52
        kind = np.float32 if largest < 2**24 else np.float64  # whole numbers below are exact
        slack = 0.0 if exact else largest * width * 2.0**-51
        lists = Lists(x.astype(kind))
        for a in range(0, len(q), queries):
            part = slice(a, a + queries)
            found = nra(self.q_ids[part], q[part].astype(kind), x_ids, lists, self.k, self.floor[part], slack, None if exact else (q[part], x))
            met: dict[int, list[tuple[int, int]]] = {}
            for at, vec, score in found:
                met.setdefault(a + at, []).append((-score, vec))
            for at, new in met.items():
                self.held[at] = sorted(self.held[at] + new)[: self.k]
                if len(self.held[at]) == self.k:
                    self.floor[at] = float(-self.held[at][-1][0]) * (1 - np.sign(-self.held[at][-1][0]) * 2.0**-50)
        self.reads += lists.reads + lists.resolved
        self.there += int(np.count_nonzero(q)) * len(x)

    def rows(self) -> pa.RecordBatch:
        out = [(q, vec, -s) for q, held in zip(self.q_ids.tolist(), self.held) for s, vec in held]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 3, ["query_id", "vec_id", "score"])


def _search(batches: Iterator[pa.RecordBatch], asked: tuple[np.ndarray, np.ndarray], k: int, candidates: int, queries: int) -> Iterator[pa.RecordBatch]:
    best, held, n, first = _Best(*asked, k), [], 0, True

    def spend() -> None:
        t = pa.Table.from_batches(held)
        lists = t.column("v").combine_chunks()
        best.see(t.column("vec_id").to_numpy(), _matrix(lists), queries)

    for batch in batches:
        width = max(1, asked[1].shape[1], int(batch.column("v").value_lengths().to_numpy().max(initial=0)))
        full, a = max(1, min(candidates, COMPONENTS // width)), 0
        while a < batch.num_rows:
            most = min(full, FIRST) if first else full
            part = batch.slice(a, max(1, most - n))
            held, n, a = [*held, part], n + part.num_rows, a + part.num_rows
            if n >= most:
                spend()
                held, n, first = [], 0, False
    if n:
        spend()
    yield best.rows()


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, candidates: int = CANDIDATES, queries: int = QUERIES, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, vec_id and score: the k best candidates of every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    rows = quantised(vectors, scale)
    asking = rows.where(F.col("vec_id") % every == 0).distinct()
    size = asking.agg(F.sum(8 * (F.size("v") + 1))).first()[0] or 0
    blocks = max(1, math.ceil(size / query_bytes))
    if blocks > 1:
        asking = stored(asking.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))), "queries")
    found = None
    for block in range(blocks):
        t = (asking.where(F.col("block") == block).select("vec_id", "v") if blocks > 1 else asking).toArrow()
        sent = spark.sparkContext.broadcast((t.column("vec_id").to_numpy(), _matrix(t.column("v").combine_chunks())))
        part = rows.mapInArrow(lambda b, sent=sent: _search(b, sent.value, k, candidates, queries), FOUND)
        part = _ranked(part, k)
        if blocks > 1:
            part = stored(part, "answers")
            sent.unpersist()
        found = part if found is None else found.unionByName(part)
    return found.select("query_id", "rank", "vec_id", "score") if blocks == 1 else _ranked(found.drop("rank"), k).select("query_id", "rank", "vec_id", "score")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)
