"""Indexing as streams.

Batching, memory, retries and resumption are the engine's: micro-batches are bounded by files per trigger, operators
spill, failed tasks are run again, and a query started again with its checkpoint goes on after the last committed batch.
Sinks are idempotent: a batch written twice replaces itself.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgloom.operators.retrieval import postings
from kgloom.plans.indexing import index
from kgloom.sources.points import PointStore
from kgloom.sources.store import GraphStore

FILES_PER_TRIGGER = 16


def stream_table(spark: SparkSession, path: str, files_per_trigger: int = FILES_PER_TRIGGER) -> DataFrame:
    """A stream over the Parquet files of a table; the schema is that of the files there are."""
    schema = spark.read.parquet(path).schema
    head, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{head}/{name[:-1]}[{name[-1]}]")


def index_stream(docs: DataFrame, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """docs (doc, text) into <root>/batch=<id>, texts with their postings as an array. Each batch replaces itself."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch = batch.dropDuplicates(["doc"]).persist()  # read once, though it is used twice
        counts = postings(batch, "doc").groupBy("doc").agg(F.collect_list(F.struct("token", "tf", "weight")).alias("postings"))
        batch.join(counts, "doc", "left").write.mode("overwrite").parquet(f"{root}/batch={batch_id}")
        batch.unpersist()

    writer = docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def store_stream(docs: DataFrame, store: PointStore, graph: GraphStore | None, checkpoint: str, once: bool = True, **how: Any) -> StreamingQuery:
    """docs (doc_id, text) through extraction into both stores, batch by batch, as `plans.indexing.index` does it.

    Documents that have a point are left out, so a batch that comes again after a failure changes nothing. The call is
    the store's: tried again, and a failure fails the batch, which the query takes up again when it is started anew.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        index(batch.dropDuplicates(["doc_id"]), store, graph, **how)

    writer = docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def indexed(spark: SparkSession, root: str) -> DataFrame:
    """doc, token, tf, weight of the latest version of each document."""
    rows = spark.read.option("basePath", root).parquet(root)
    latest = rows.groupBy("doc").agg(F.max_by("postings", "batch").alias("postings"))
    return latest.select("doc", F.inline("postings"))


def merged_stream(entities: DataFrame, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Entities merged across all batches: name, type, description, n, first_seq in <root>/batch=<id>.

    The state is Spark's, one row for each name and type; without an event time in the data it isn't bounded by a
    watermark but by the number of different entities. Each batch writes the rows that changed.
    """
    state = entities.groupBy("name", "type").agg(F.max(F.struct(F.length("description").alias("len"), (-F.col("seq")).alias("neg"), "description")).alias("best"), F.count(F.lit(1)).alias("n"), F.min("seq").alias("first_seq"))

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.select("name", "type", F.col("best.description").alias("description"), "n", "first_seq").write.mode("overwrite").parquet(f"{root}/batch={batch_id}")

    writer = state.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def merged(spark: SparkSession, root: str) -> DataFrame:
    """The latest state of each entity."""
    rows = spark.read.option("basePath", root).parquet(root)
    last = rows.groupBy("name", "type").agg(F.max_by(F.struct("description", "n", "first_seq"), "batch").alias("s"))
    return last.select("name", "type", "s.*")


def progress(query: StreamingQuery) -> dict[str, float]:
    """Batches, rows and rows a minute of a query so far."""
    seen = [p for p in query.recentProgress if p["numInputRows"]]
    rows = sum(p["numInputRows"] for p in seen)
    ms = sum(p["durationMs"].get("triggerExecution", 0) for p in seen)
    return {"batches": len(seen), "rows": rows, "rows_a_minute": rows * 60_000 / ms if ms else 0.0}
