"""Exact dense search that skips most of the points: k-means cells with radii.

Points are dealt to the cell of their nearest centre and stored by cell, with the cell's radius, the greatest distance of
a point from its centre. By the triangle inequality no point of a cell is nearer to a query than the centre's distance
less the radius. A query reads the cells with the nearest centres first; with the k-th score found there, it reads of the
others only those that could hold a better one. The answer is the exact one, however good or bad the cells are: they are
fitted on a bounded sample, which decides only how much is read.

Distances are those of unit vectors, so their order is that of the cosine. Vectors without length have a cell of
their own that is always read, and queries without length read everything.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from kgloom.operators import retrieval as R
from kgloom.shared import stored

#: Cells, points that the centres are fitted on at most, and rounds of the fit.
CELLS, SAMPLE, ROUNDS = 64, 20_000, 10
#: Cells that a query reads first.
FIRST = 2
#: Tasks that may write one cell.
SPLITS = 4
#: More than a distance loses by rounding.
SLACK = 1e-6
#: The cell of vectors without length.
NOWHERE = -1


def _distances(m: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (m @ centres.T), 0))


def centres_of(points: DataFrame, cells: int = CELLS, sample: int = SAMPLE) -> np.ndarray:
    """Centres of unit length, fitted on the `sample` points whose ids have the least hashes."""
    some = points.select("doc", F.col("vector").cast("array<double>").alias("vector")).where("vector is not null").orderBy(F.xxhash64("doc"), "doc").limit(sample).select("vector").toArrow()
    m = R._matrix(some.column("vector").combine_chunks(), 0) if some.num_rows else np.zeros((0, 1))
    m = m[np.linalg.norm(m, axis=1) > 0]
    if not len(m):
        return np.zeros((0, m.shape[1]))
    centres = m[np.linspace(0, len(m) - 1, min(cells, len(m))).astype(int)]
    for _ in range(ROUNDS):
        at = np.argmax(m @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, m)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def _dealt(batches: Iterator[pa.RecordBatch], centres: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in batches:
        m = R._matrix(b.column("vector"), centres.shape[1])
        there = np.linalg.norm(m, axis=1) > 0
        cell, far = np.full(len(m), NOWHERE, np.int32), np.zeros(len(m))
        if len(centres):
            # what a longer vector has beyond the centres' length only makes it farther
            d = _distances(m[:, : centres.shape[1]], centres)
            cell[there] = np.argmin(d[there], axis=1)
            far = d[np.arange(len(m)), np.maximum(cell, 0)]
        yield pa.RecordBatch.from_arrays([b.column("doc"), b.column("vector"), pa.array(cell), pa.array(far)], ["doc", "vector", "cell", "far"])


def _read(batches: Iterator[pa.RecordBatch], asked: pa.Table, wanted: dict[int, np.ndarray], k: int, block: int) -> Iterator[pa.RecordBatch]:
    """The k best points of the partition for each query, among the cells that each wants."""
    lists = asked.column("v").combine_chunks()
    width = int(lists.value_lengths().to_numpy().max(initial=0))
    q = R._matrix(lists, width)
    scores, docs = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    for batch in batches:
        cells = batch.column("cell").to_numpy()
        for cell in np.unique(cells).tolist():
            rows = wanted.get(cell, np.zeros(0, int))
            part = batch.filter(pa.array(cells == cell)) if len(rows) else batch.slice(0, 0)
            for at in range(0, part.num_rows, block):
                some = part.slice(at, block)
                points, p = some.column("doc").to_numpy(), R._matrix(some.column("vector"), width)[:, :width].T
                new = np.round(q[rows] @ p, R.DECIMALS)
                scores[rows], docs[rows] = R._best(np.hstack([scores[rows], new]), np.hstack([docs[rows], np.broadcast_to(points, new.shape)]), k)
    row, column = np.nonzero(scores > -np.inf)
    ids = asked.column("query_id").combine_chunks().take(pa.array(row))
    yield pa.RecordBatch.from_arrays([ids, pa.array(docs[row, column]), pa.array(scores[row, column])], ["query_id", "doc", "score"])


class Cells:
    """Points (doc, vector) by cell."""

    def __init__(self, points: DataFrame, cells: int = CELLS, sample: int = SAMPLE):
        self.spark, self.centres = points.sparkSession, centres_of(points, cells, sample)
        v = points.where("vector is not null").select(F.col("doc").cast("long").alias("doc"), F.col("vector").cast("array<double>").alias("vector"))
        sent = self.spark.sparkContext.broadcast(self.centres)
        dealt = v.mapInArrow(lambda b: _dealt(b, sent.value), "doc long, vector array<double>, cell int, far double")
        dealt = dealt.repartition("cell", F.pmod(F.xxhash64("doc"), F.lit(SPLITS))).sortWithinPartitions("cell")
        self.points = stored(dealt, "cells")
        self.radii = {r["cell"]: r["far"] for r in self.points.groupBy("cell").agg(F.max("far").alias("far")).collect()}  # one row for each cell
        #: Pairs of query and cell that the last search read, and all pairs.
        self.read = self.pairs = 0

    def search(self, queries: DataFrame, k: int = R.ARM_LIMIT, block: int = 1024, query_bytes: int = R.QUERY_BYTES) -> DataFrame:
        """As retrieval.dense_arm: query_id, doc, score, rank. Queries are broadcast in blocks of bounded bytes, each read twice."""
        q = queries.where("vector is not null").select("query_id", F.col("vector").cast("array<double>").alias("v"))
        blocks = max(1, math.ceil((q.agg(F.sum(8 * (F.size("v") + 1))).first()[0] or 0) / query_bytes))
        if blocks > 1:
            q = stored(q.withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks))), "query-vectors")
        self.read = self.pairs = 0
        found = None
        for i in range(blocks):
            part = R.ranked(self._searched((q.where(F.col("block") == i).drop("block") if blocks > 1 else q).toArrow(), q.schema["query_id"], k, block), k)
            found = part if found is None else found.unionByName(part)
        return found

    def _searched(self, asked: pa.Table, id_field: StructField, k: int, block: int) -> DataFrame:
        lists = asked.column("v").combine_chunks()
        m = R._matrix(lists, self.centres.shape[1])
        cells = np.array(sorted(c for c in self.radii if c != NOWHERE), int)
        least = np.zeros((len(m), len(cells)))
        if len(cells) and len(m):
            d = _distances(m[:, : self.centres.shape[1]], self.centres[cells])
            least = d - np.array([self.radii[c] for c in cells]) - SLACK
            # parts of a query beyond the centres' length say nothing of its distance to the points, nor does no length
            odd = (np.linalg.norm(m[:, : self.centres.shape[1]], axis=1) < 1 - SLACK) | (np.linalg.norm(m, axis=1) == 0)
            least[odd] = -np.inf
            near = np.argsort(d, axis=1)[:, : min(FIRST, len(cells))]
            first = np.zeros(least.shape, bool)
            np.put_along_axis(first, near, True, axis=1)
        else:
            first = np.ones(least.shape, bool)
        made = StructType([id_field, StructField("doc", LongType()), StructField("score", DoubleType())])

        def run(mask: np.ndarray, nowhere: bool) -> DataFrame:
            wanted = {int(c): np.flatnonzero(mask[:, i]) for i, c in enumerate(cells) if mask[:, i].any()}
            if nowhere and NOWHERE in self.radii:
                wanted[NOWHERE] = np.arange(len(m))
            sent = self.spark.sparkContext.broadcast((asked, wanted))
            rows = self.points.where(F.col("cell").isin(list(wanted)) if wanted else F.lit(False)).select("doc", "vector", "cell")
            return rows.mapInArrow(lambda b: _read(b, *sent.value, k, block), made)

        one = stored(R.ranked(run(first, True), k).drop("rank"), "first-cells")
        place = {r["query_id"]: r["score"] for r in R.ranked(one, k).where(F.col("rank") == k).select("query_id", "score").collect()}  # one row a query of the block
        kth = np.array([place.get(x, -1.0) for x in asked.column("query_id").to_pylist()])
        # the distance of the k-th score; a score can't be better than its rounding
        reach = np.sqrt(np.maximum(2 - 2 * (kth - 10.0**-R.DECIMALS), 0))
        rest = (least <= reach[:, None]) & ~first
        self.read += int(first.sum() + rest.sum())
        self.pairs += first.size
        return one.unionByName(run(rest, False))
