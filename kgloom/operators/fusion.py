"""Fusion of retrieved and graph documents, and what is made of them: context, citations, references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.functions import text as T

K, GRAPH_WEIGHT, NO_SCORE = 5, 0.3, 0.5


def _ordered(found: DataFrame, graph: DataFrame) -> DataFrame:
    """Retrieved documents first, then graph documents, each in its order: query_id, doc, text, arm, pos, score."""
    cols = ["query_id", "doc", "text", "arm", "pos", "score"]
    first = found.withColumn("arm", F.lit(0))
    first = first if "score" in found.columns else first.withColumn("score", F.lit(None).cast("double"))
    return first.select(cols).unionByName(graph.withColumns({"arm": F.lit(1), "score": F.lit(None).cast("double")}).select(cols))


def _unique(rows: DataFrame) -> DataFrame:
    """The first of the documents of a query that begin alike. A query without graph documents keeps them all."""
    has_graph = F.max("arm").over(Window.partitionBy("query_id")) == 1
    first = F.row_number().over(Window.partitionBy("query_id", T.content_key(F.col("text"))).orderBy("arm", "pos"))
    return rows.withColumns({"__graph": has_graph, "__first": first}).where(~F.col("__graph") | (F.col("__first") == 1)).drop("__first")


def appended(found: DataFrame, graph: DataFrame, k: int = K) -> DataFrame:
    """query_id, doc, text, arm, position: retrieved documents in their order, graph documents after them, k at most.

    found: query_id, doc, text, pos; graph: the same.
    """
    return placed(_ordered(found, graph), k).select("query_id", "doc", "text", "arm", "position")


def placed(rows: DataFrame, k: int = K) -> DataFrame:
    """Rows of both arms (query_id, text, arm, pos, ...) with position: the first of those that begin alike, k at most."""
    rows = _unique(rows)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("arm", "pos"))
    return rows.withColumn("position", place).where(F.col("position") <= k)


def scored(found: DataFrame, graph: DataFrame, k: int = K, graph_weight: float = GRAPH_WEIGHT) -> DataFrame:
    """As `appended`, but ordered by score; graph documents get the mean retrieved score and half the graph's weight, 1 at most."""
    rows = _ordered(found, graph)
    mean = F.coalesce(F.avg(F.when(F.col("arm") == 0, F.col("score"))).over(Window.partitionBy("query_id")), F.lit(NO_SCORE))
    rows = rows.withColumn("score", F.round(F.when(F.col("arm") == 1, F.least(F.lit(1.0), mean + graph_weight * 0.5)).otherwise(F.col("score")), 9))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "arm", "pos"))
    return _unique(rows).withColumn("position", place).where(F.col("position") <= k).select("query_id", "doc", "text", "arm", "score", "position")


def _joined(df: DataFrame, by: str, order: str, part: Column, sep: str) -> DataFrame:
    """The parts of each group in order, joined. A group has no more rows than a query has results."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("x"))))
    return df.groupBy(by).agg(F.array_join(F.transform(rows, lambda r: r["x"]), sep).alias("context"))


def context(results: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """query_id, context: the documents with their numbers, for a prompt."""
    text = T.truncated(F.trim("text"), T.CONTEXT_CHARS)
    out = _joined(results, "query_id", "position", F.concat(F.lit("["), F.col("position").cast("string"), F.lit("] "), text), "\n\n")
    if queries is None:
        return out
    return queries.select("query_id").join(out, "query_id", "left").select("query_id", F.coalesce("context", F.lit("No relevant context found.")).alias("context"))


def source_listing(results: DataFrame) -> DataFrame:
    """query_id, context: number, source and beginning of each document. results: + source."""
    n = F.col("position").cast("string")
    part = F.concat(F.lit("["), n, F.lit("] Source: "), F.coalesce("source", F.lit("unknown")), F.lit("\n    Content: "), F.substring(F.trim("text"), 1, 100), F.lit("..."))
    return _joined(results, "query_id", "position", part, "\n")


def references(answer: Column, docs: Column) -> Column:
    """The answer with a block of the documents it cites. docs: array of (source, text) in the order of their numbers."""
    cited = T.citations(answer)
    marked = F.transform(docs, lambda d, i: F.struct((i + 1).alias("n"), d["source"].alias("source"), d["text"].alias("text")))
    lines = F.transform(F.filter(marked, lambda d: F.array_contains(cited, d["n"])), lambda d: F.concat(F.lit("\n["), d["n"].cast("string"), F.lit("] "), F.coalesce(d["source"], F.lit("Unknown source")), F.lit("\n    "), d["text"], F.lit("\n")))
    block = F.concat(F.lit("\n\n---\n**References:**\n"), F.array_join(lines, ""))
    return F.when(F.size(cited) > 0, F.concat(answer, block)).otherwise(answer)


def context_rows(results: DataFrame, document_id: Column) -> DataFrame:
    """query_id, document_id, text, score, position: rows of a prediction. All rows of a query carry its best score."""
    best = F.max("score").over(Window.partitionBy("query_id"))
    return results.select("query_id", F.coalesce(document_id, F.lit("unknown")).alias("document_id"), "text", best.alias("score"), "position")
