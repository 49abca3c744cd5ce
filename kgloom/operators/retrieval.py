"""Retrieval over batches of queries: postings, weights, the sparse and the dense arm, rank fusion, the answer gate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from kgloom.functions import text as T
from kgloom.shared import spread, stored

ARM_LIMIT, K, RRF_C, IDK_THRESHOLD = 50, 5, 60, 0.5
#: Scores are rounded before they are ranked, so that the order of a sum doesn't decide ties.
DECIMALS = 9
#: Bytes of the query vectors that are broadcast at once.
QUERY_BYTES = 32 << 20


def postings(docs: DataFrame, doc_id: str, text: str = "text", repeated: bool = False) -> DataFrame:
    """doc, token, tf, weight: counts, and counts over the document's largest count. Texts without tokens have none.

    Tokens are sorted and counted by their runs inside each row, so postings are made without any shuffle. Ids have to be
    unique; with repeated=True the rows of one id are parts of one document, whose counts are added up.
    """
    docs = spread(docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")))

    def runs(t: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(t) - 1), lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        counted = lambda b: F.transform(b, lambda p, j: F.struct(F.get(t, p).alias("token"), (F.coalesce(F.get(b, j + 1), F.size(t)) - p).cast("long").alias("tf")))
        return F.when(F.size(t) > 0, T.let(starts, counted))

    found = T.let(F.sort_array(T.tokens(F.col("text"))), runs)
    with_top = T.let(found, lambda r: F.struct(r.alias("runs"), F.array_max(F.transform(r, lambda x: x["tf"])).alias("top")))
    rows = docs.select("doc", with_top.alias("p"))
    out = rows.select("doc", F.col("p.top").alias("top"), F.inline("p.runs"))
    if repeated:
        out = out.groupBy("doc", "token").agg(F.sum("tf").alias("tf"))
        out = out.withColumn("top", F.max("tf").over(Window.partitionBy("doc")))
    return out.select("doc", "token", "tf", (F.col("tf") / F.col("top")).alias("weight"))


def idf(posted: DataFrame, n_docs: DataFrame) -> DataFrame:
    """token, df, idf: ln(1 + (N - df + 0.5) / (df + 0.5)). n_docs has one row with column n."""
    counts = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    rate = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return counts.crossJoin(F.broadcast(n_docs)).select("token", "df", rate.alias("idf"))  # one row


def ranked(scored: DataFrame, k: int, *ties: str, by: str = "query_id") -> DataFrame:
    """The k best by score for each query, with rank; ties by the given columns. Spark prunes before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), *(ties or ("doc",))))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def asked_tokens(queries: DataFrame, query_id: str) -> DataFrame:
    """query_id, token, q_weight."""
    return postings(queries, query_id).select(F.col("doc").alias("query_id"), "token", F.col("weight").alias("q_weight"))


def scores_of(asked: DataFrame, posted: DataFrame, n_docs: DataFrame) -> DataFrame:
    """query_id, doc, score: the sum of query weight, document weight and idf over shared tokens.

    posted: all postings of the asked tokens, from a store's buckets or made for the purpose; it is read twice.
    """
    weighted = asked.join(idf(posted, n_docs), "token").select("query_id", "token", (F.col("q_weight") * F.col("idf")).alias("w"))
    return posted.join(weighted, "token").groupBy("query_id", "doc").agg(F.round(F.sum(F.col("w") * F.col("weight")), DECIMALS).alias("score"))


def sparse_scores(queries: DataFrame, docs: DataFrame, doc_id: str, query_id: str) -> DataFrame:
    """As scores_of, over documents that aren't indexed. The corpus is tokenised once: the postings of the tokens that
    queries have are stored in the shared folder. For questions that come again and again, keep a PointStore."""
    asked = asked_tokens(queries, query_id)
    posted = stored(postings(docs, doc_id).join(asked.select("token").distinct(), "token", "left_semi").select("doc", "token", "weight"), "postings")
    return scores_of(asked, posted, docs.agg(F.count(F.lit(1)).alias("n")))


def sparse_arm(queries: DataFrame, docs: DataFrame, doc_id: str, query_id: str, k: int = ARM_LIMIT) -> DataFrame:
    return ranked(sparse_scores(queries, docs, doc_id, query_id), k)


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows of unit length, filled up with zeros to the width; components that are no finite number count as 0."""
    sizes = lists.value_lengths().to_numpy()
    m = np.zeros((len(sizes), max(width, int(sizes.max(initial=0)))))
    m[np.arange(m.shape[1]) < sizes[:, None]] = np.nan_to_num(lists.flatten().to_numpy(zero_copy_only=False), posinf=0, neginf=0)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _best(scores: np.ndarray, docs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of each row, ties to the smaller document; only what reaches the k-th score is sorted."""
    least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
    row, column = np.nonzero(scores >= least[:, None])
    order = np.lexsort((docs[row, column], -scores[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    row, column = (x[place < k].reshape(len(scores), k) for x in (row, column))
    return scores[row, column], docs[row, column]


def _nearest(batches: Iterator[pa.RecordBatch], asked: pa.Table, k: int, block: int) -> Iterator[pa.RecordBatch]:
    """The k best points of the partition for each query: blocks of points by blocks of queries, and what is best so far."""
    lists = asked.column("v").combine_chunks()
    width = int(lists.value_lengths().to_numpy().max(initial=0))
    q = _matrix(lists, width)
    scores, docs = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    for batch in batches:
        for at in range(0, batch.num_rows, block):
            part = batch.slice(at, block)
            points, p = part.column("doc").to_numpy(), _matrix(part.column("v"), width)[:, :width].T
            for a in range(0, len(q), block):
                rows = slice(a, a + block)
                new = np.round(q[rows] @ p, DECIMALS)
                scores[rows], docs[rows] = _best(np.hstack([scores[rows], new]), np.hstack([docs[rows], np.broadcast_to(points, new.shape)]), k)
    row, column = np.nonzero(scores > -np.inf)
    ids = asked.column("query_id").combine_chunks().take(pa.array(row))
    yield pa.RecordBatch.from_arrays([ids, pa.array(docs[row, column]), pa.array(scores[row, column])], ["query_id", "doc", "score"])


def dense_arm(queries: DataFrame, points: DataFrame, k: int = ARM_LIMIT, block: int = 1024, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, doc, score, rank: exact cosine of each query's vector with every point.

    queries: query_id, vector; points: doc, vector. Points stay where they are. Queries are dealt to blocks of bounded bytes,
    which are broadcast one after the other: more queries mean more passes over the points. A task holds blocks of points
    by blocks of queries, and the k best so far.
    """
    v = F.col("vector").cast("array<double>").alias("v")
    p = points.where("vector is not null").select(F.col("doc").cast("long").alias("doc"), v)
    q = queries.where("vector is not null").select("query_id", v)
    found_type = StructType([q.schema["query_id"], StructField("doc", LongType()), StructField("score", DoubleType())])
    blocks = max(1, math.ceil((q.agg(F.sum(8 * (F.size("v") + 1))).first()[0] or 0) / query_bytes))
    if blocks > 1:
        q = stored(q.withColumn("block", F.pmod(F.xxhash64("query_id", "v"), F.lit(blocks))), "query-vectors")
    found = None
    for i in range(blocks):
        sent = q.sparkSession.sparkContext.broadcast((q.where(F.col("block") == i).drop("block") if blocks > 1 else q).toArrow())
        part = ranked(p.mapInArrow(lambda b, sent=sent: _nearest(b, sent.value, k, block), found_type), k)
        found = part if found is None else found.unionByName(part)
    return found


def fused(arms: list[tuple[DataFrame, float]], k: int = K, c: int = RRF_C) -> DataFrame:
    """query_id, doc, score, score_norm, rank: reciprocal rank fusion, the sum of weight / (c + rank) over the arms.

    score_norm is the score over the best possible one, so that it can be compared with a threshold between 0 and 1.
    """
    top = sum(w / (c + 1) for _, w in arms)
    summed = None
    for i, (arm, w) in enumerate(arms):
        part = arm.select("query_id", "doc", (F.lit(float(w)) / (c + F.col("rank"))).alias(f"part{i}"))
        summed = part if summed is None else summed.join(part, ["query_id", "doc"], "full_outer")
    total = sum((F.coalesce(f"part{i}", F.lit(0.0)) for i in range(len(arms))), F.lit(0.0))
    summed = summed.select("query_id", "doc", F.round(total, DECIMALS).alias("score"))
    return ranked(summed, k).withColumn("score_norm", F.round(F.col("score") / top, 6))


def hybrid(queries: DataFrame, docs: DataFrame, points: DataFrame, query_vectors: DataFrame, doc_id: str, query_id: str, k: int = K, c: int = RRF_C, dense_weight: float = 1.0, sparse_weight: float = 1.0) -> DataFrame:
    """Both arms, fused."""
    arms = [(dense_arm(query_vectors, points), dense_weight), (sparse_arm(queries, docs, doc_id, query_id), sparse_weight)]
    return fused(arms, k, c)


similarity_search_with_score = hybrid


def max_scores(queries: DataFrame, results: DataFrame, query_id: str, score: str = "score_norm") -> DataFrame:
    """query_id and max_score of every query; 0 if it found nothing."""
    best = results.groupBy("query_id").agg(F.max(score).alias("m"))
    return queries.select(F.col(query_id).alias("query_id")).join(best, "query_id", "left").select("query_id", F.coalesce("m", F.lit(0.0)).alias("max_score"))


def gated(answer: Column, max_score: Column, threshold: float = IDK_THRESHOLD) -> Column:
    """The answer, unless the best score is below the threshold."""
    return F.when(max_score < threshold, F.lit(T.IDK_MESSAGE)).otherwise(answer)


def lookup(points: DataFrame, ids: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Points of the given ids whose text isn't empty."""
    return points.where(F.coalesce(text, F.lit("")) != "").join(ids.select(key).distinct(), key, "left_semi")
