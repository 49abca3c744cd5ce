"""The point store: points by document, their postings by token, and what a search needs to know about the postings.

An upsert appends: rows carry the version that wrote them, and `replaced` says from which version on a document's older
rows don't count. Nothing is rewritten, so an upsert costs what it brings, however large the index; readers leave the
replaced rows out, and `compact` writes the tables anew without them.

Search is MaxScore over block-max postings. `blocks` has for each token and block of documents the number of its
documents and their largest weight. A query's tokens are ordered by the most that they can add to a score. The best of
them give a first k-th score; tokens that can't reach it even together with all weaker ones are not essential: a
document that has only such tokens is out, and their postings, the longest, are read only for documents whose score
so far, with what their block can add at most, reaches the k-th one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.operators import retrieval as R
from kgloom.shared import Scratch, sendable, stored

from .store import ATTEMPTS, BUCKETS, DELAY, SPLITS, Table, Tables, retried

#: Documents of a block, in the mean, when the store is created or compacted.
BLOCK_DOCS = 64
#: Postings of the best tokens that give the first k-th score, for each of the k.
SEEDS = 4
#: Bounds are compared with so much to spare, which is more than sums of scores lose by rounding.
SLACK = 1e-6
#: Characters of the texts whose postings one task writes, in the mean, where there are more than its bucket's SPLITS hold.
SPLIT_CHARS = 1 << 24
#: Ids of points that are broadcast to find the documents without one.
SENT_POINTS = 1 << 20
#: The row that counts all documents; no token is empty.
ALL = ""


class _Live(Table):
    """The rows of a table that no later version has replaced."""

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        there = self.tables.manifest()
        rows = self.tables._read(there, self.name, buckets)
        if "replaced" in there:
            since = self.tables._read(there, "replaced").groupBy("doc").agg(F.max("__version").alias("__since"))
            rows = rows.join(sendable(since), "doc", "left").where("__since is null or __version >= __since").drop("__since")
        return rows.drop("__version")


class PointStore:
    """points (doc, vector, text, ...) and, if it is made with them, postings (doc, token, tf, weight). Each call is one commit."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.tables = Tables(spark, root, buckets)
        self.points, self.postings = _Live(self.tables, "points"), _Live(self.tables, "postings")

    # ------------------------------------------------------------ writing

    def create(self, points: DataFrame, sparse: bool = True, order: str | None = None) -> None:
        """Replaces what is there. Points are read once."""
        self._whole(points, sparse, order)

    def compact(self) -> None:
        """Writes the tables without replaced rows, with blocks of the size that the documents have now."""
        self._whole(self.points.read(), self.postings.exists())

    def _whole(self, points: DataFrame, sparse: bool, order: str | None = None) -> None:
        before = self.tables.versions()
        version = before[-1] + 1 if before else 0
        made = self._added({}, points, version, order)
        if sparse:
            rows, _ = self.tables.added({}, made, "points")
            made |= self._posted({}, rows, version, max(1, rows.count() // BLOCK_DOCS))
        self.tables.commit(before, made)

    def _added(self, tables: dict[str, Any], points: DataFrame, version: int, order: str | None) -> dict[str, Any]:
        """The points' entry with the last row of each id."""
        last = lambda rows, name, key: self.tables.write_last(rows, name, key, order)
        rows = points.withColumn("__version", F.lit(version).cast("long"))
        return {"points": self.tables.appended(tables, "points", rows, ["doc"], last)}

    def _posted(self, tables: dict[str, Any], rows: DataFrame, version: int, n: int, old: DataFrame | None = None) -> dict[str, Any]:
        """The entries of postings and blocks after stored rows have replaced old ones.

        Postings of a token and block lie together and follow each other, so that they are counted as they are read.
        """
        chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
        splits = max(SPLITS, -(-chars // (self.tables.buckets * SPLIT_CHARS)))
        # one number: bucket, token and block
        at = F.shiftleft(F.col("__bucket").cast("long"), 56).bitwiseOR(F.shiftleft(F.hash("token").cast("long").bitwiseAND(F.lit((1 << 30) - 1)), 26)).bitwiseOR(_block("doc", n).cast("long"))
        together = lambda dealt, by: dealt.sortWithinPartitions(at)
        by_block = lambda posted, name, key: self.tables.write(posted, name, key, _block("doc", n), together, splits, in_order=True)
        posted = R.postings(rows, "doc").withColumn("__version", F.lit(version).cast("long"))
        made = {"postings": self.tables.appended(tables, "postings", posted, ["token"], by_block)}
        here = lambda blocks, name, key: self.tables._write(blocks.withColumn("__bucket", self.tables.bucket_of(*key)), name, in_order=True)
        blocks = _blocks(n, rows, self.tables.added(tables, made, "postings")[0], old)
        return made | {"blocks": self.tables.appended(tables, "blocks", blocks, ["token"], here) | {"n": n}}

    def upsert(self, points: DataFrame, order: str | None = None, attempts: int = ATTEMPTS, delay: float = DELAY, sleep: Callable[[float], None] = time.sleep) -> None:
        """Points replace those of the same id; of an id that the rows repeat, the last counts. Postings follow the points.

        A call that fails, or meets another writer, is made again, as often and after as long as told.
        """
        retried(lambda: self._upsert(points, order), attempts, delay, sleep)

    def _upsert(self, points: DataFrame, order: str | None) -> None:
        before, tables = self.tables.versions(), self.tables.manifest()
        if "points" not in tables:
            self.create(points, order=order)
            return
        held, version = Scratch(self.tables.spark), before[-1] + 1
        made = self._added(tables, points, version, order)
        rows, touched = self.tables.added(tables, made, "points")
        live = self.points.read(touched)
        gone = held.stored(live.select("doc").join(sendable(rows.select("doc")), "doc", "left_semi"), "replaced-ids")
        if "postings" in tables:
            made |= self._posted(tables, rows, version, tables["blocks"]["n"], live.join(sendable(gone), "doc", "left_semi"))
        if not gone.isEmpty():
            made["replaced"] = self.tables.replaced(tables, "replaced", gone.select("doc", F.lit(version).cast("long").alias("__version")), ["doc"], None)
        self.tables.commit(before, tables | made)
        held.clear()

    # ------------------------------------------------------------ reading

    def posted(self, tokens: DataFrame) -> DataFrame:
        """doc, token, weight of the given tokens (token): only the buckets that hold them are read."""
        at = self.tables.touched(tokens, "token")
        return self.postings.read(at).join(tokens.select("token").distinct(), "token", "left_semi").select("doc", "token", "weight")

    def sparse_arm(self, queries: DataFrame, query_id: str, k: int = R.ARM_LIMIT) -> DataFrame:
        """As retrieval.sparse_arm, from the stored postings: no document is tokenised."""
        return R.ranked(self.searched(R.asked_tokens(queries, query_id), k)["scores"], k)

    def searched(self, asked: DataFrame, k: int) -> dict[str, DataFrame]:
        """scores (query_id, doc, score) of all that can be among the k best, and met, the postings that were added up for it
        (query_id, doc, token).

        asked: query_id, token, q_weight.
        """
        tables, n = self.tables, self.tables.manifest()["blocks"]["n"]
        asked = stored(asked, "asked-tokens")
        known = tables.read("blocks", tables.touched(asked, "token")).join(asked.select("token").distinct(), "token", "left_semi")
        known = stored(known.groupBy("token", "block").agg(F.sum("df").alias("df"), F.max("top").alias("top")).where("df > 0"), "asked-blocks")
        everything = tables.read("blocks", tables.touched(tables.spark.range(1).select(F.lit(ALL).alias("token")), "token"))
        n_docs = everything.where(F.col("token") == ALL).agg(F.coalesce(F.sum("df"), F.lit(0)).alias("n"))
        of_token = known.groupBy("token").agg(F.sum("df").alias("df"), F.max("top").alias("top"))
        rate = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        w = (F.col("q_weight") * rate).alias("w")
        weighted = asked.join(of_token, "token").crossJoin(F.broadcast(n_docs)).select("query_id", "token", "df", w, (w * F.col("top")).alias("most"))  # one row
        weighted = stored(weighted, "asked-weights")

        # a first k-th score, from the tokens that can add most
        best = Window.partitionBy("query_id").orderBy(F.desc("most"), "token")
        before = F.coalesce(F.sum("df").over(best.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        seeds = weighted.withColumn("before", before).where(F.col("before") < SEEDS * k).select("query_id", "token", "w")
        first = self.posted(seeds).join(seeds, "token").groupBy("query_id", "doc").agg(F.sum(F.col("w") * F.col("weight")).alias("score"))
        kth = R.ranked(first, k).where(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("kth"))

        # tokens that reach it, alone or with all that can add less
        worst = Window.partitionBy("query_id").orderBy("most", F.desc("token"))
        run = F.sum("most").over(worst.rowsBetween(Window.unboundedPreceding, 0))
        parts = weighted.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(0.0)))
        parts = stored(parts.withColumn("essential", run >= F.col("kth")), "asked-parts")
        strong, weak = (parts.where(c).select("query_id", "token", "w", "kth") for c in ("essential", "not essential"))
        met = self.posted(strong).join(strong, "token")
        so_far = met.groupBy("query_id", "doc").agg(F.sum(F.col("w") * F.col("weight")).alias("score"), F.max("kth").alias("kth"))
        still = weak.join(known, "token").groupBy("query_id", "block").agg(F.sum(F.col("w") * F.col("top")).alias("still"))
        reach = so_far.withColumn("block", _block("doc", n)).join(still, ["query_id", "block"], "left")
        reach = stored(reach.where(F.col("score") + F.coalesce("still", F.lit(0.0)) >= F.col("kth")).select("query_id", "doc", "score"), "candidates")
        late = self.posted(weak).join(reach.select("doc").distinct(), "doc", "left_semi").join(weak, "token")
        late = late.join(reach.select("query_id", "doc"), ["query_id", "doc"], "left_semi")
        scores = reach.unionByName(late.select("query_id", "doc", (F.col("w") * F.col("weight")).alias("score"))).groupBy("query_id", "doc").agg(F.round(F.sum("score"), R.DECIMALS).alias("score"))
        return {"scores": scores, "met": met.select("query_id", "doc", "token").unionByName(late.select("query_id", "doc", "token"))}

    def stats(self) -> dict[str, Any]:
        return {"points": self.points.read().count() if self.points.exists() else 0, "has_sparse": self.postings.exists()}

    def missing(self, docs: DataFrame) -> DataFrame:
        """Documents without a point: what an interrupted indexing still has to do, whatever order it ran in."""
        if not self.points.exists():
            return docs
        known = self.points.read().select("doc")
        if known.count() <= SENT_POINTS:
            return docs.join(F.broadcast(known), "doc", "left_anti")
        # the ids meet without their texts; what is left of them is sent to the texts if it can be
        left = stored(docs.select("doc").join(known, "doc", "left_anti").distinct(), "missing-ids").withColumnRenamed("doc", "__doc")
        return docs.join(sendable(left), F.col("doc").eqNullSafe(F.col("__doc")), "left_semi")

    def drop(self) -> bool:
        return self.tables.drop()


def _block(doc: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(doc), F.lit(blocks)).cast("int")


def _blocks(blocks: int, points: DataFrame, posted: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """token, block, df, top: what postings add; readers add up what repeats a token and block. Documents that they replace
    count against them; a largest weight stays a bound."""
    made = posted.select("token", _block("doc", blocks).alias("block"), F.lit(1).cast("long").alias("df"), F.col("weight").alias("top"))
    rows = _runs(made).unionByName(_everything(points, 1))
    if old is not None:
        gone = R.postings(old, "doc").groupBy("token", _block("doc", blocks).alias("block")).agg((-F.count(F.lit(1))).alias("df"), F.lit(0.0).alias("top"))
        rows = rows.unionByName(gone).unionByName(_everything(old, -1).where("df < 0"))
    return rows


def _everything(points: DataFrame, sign: int) -> DataFrame:
    """The row that counts all documents."""
    return points.agg((sign * F.count(F.lit(1))).alias("df")).select(F.lit(ALL).alias("token"), F.lit(0).alias("block"), "df", F.lit(0.0).alias("top"))


def _runs(rows: DataFrame) -> DataFrame:
    """Blocks of rows that follow each other by token and block, counted where they are read, without a shuffle."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.Table.from_batches([batch]).group_by(["token", "block"], use_threads=False).aggregate([("df", "sum"), ("top", "max")])
            yield from found.rename_columns({"df_sum": "df", "top_max": "top"}).select(["token", "block", "df", "top"]).to_batches()

    return rows.mapInArrow(counted, rows.schema)
