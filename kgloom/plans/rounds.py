"""Runs with memory: what a conversation was answered before is the history of its next question.

Questions of different conversations don't depend on each other, those of one do. So the n-th questions of all
conversations are one batch, answered by one plan, and the rounds follow each other: as many as the longest conversation has
questions, however many conversations there are. Each round reads its own batch and what the round before remembers,
both stored in the shared folder: no plan grows with the rounds, and a run that was broken off goes on with the first
round that isn't complete.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.operators.conversation import WINDOW
from kgloom.shared import present, removed, scratch
from kgloom.sources import jsonl
from kgloom.sources.points import PointStore

from . import rag
from .providers import PROVIDERS

#: From (conv_id, turn, text, history, ...) to conv_id, answer and more columns; a null answer is a call that failed.
Respond = Callable[[DataFrame], DataFrame]


def in_rounds(asked: DataFrame, respond: Respond, window: int | None = WINDOW, root: str | None = None) -> DataFrame:
    """asked with history, and what respond gives for it.

    asked: conv_id, turn, text and more; questions of one conversation are ordered by turn, then text. history: array of
    (query, response), oldest first, of the last `window` answered questions, or of all. A failed call is not
    remembered. Rows without conv_id have no part in it. root: a folder of this run, in which it is taken up again; else a new one.
    """
    spark = asked.sparkSession
    root = root or scratch(spark, "rounds")
    if not present(spark, f"{root}/asked/_SUCCESS"):
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))
        asked.where("conv_id is not null").withColumn("round", place).write.mode("overwrite").partitionBy("round").parquet(f"{root}/asked")
    questions = spark.read.schema(asked.withColumn("round", F.lit(1)).schema).parquet(f"{root}/asked")
    last = questions.agg(F.max("round")).first()[0] or 0
    none = F.array().cast("array<struct<query:string,response:string>>")
    if not last:
        nothing = questions.withColumn("history", none)
        return nothing.join(respond(nothing), "conv_id")
    for n in range(1, last + 1):
        if present(spark, f"{root}/memory/{n}/_SUCCESS"):
            continue
        given = questions.where(F.col("round") == n).drop("round")
        if n > 1:
            given = given.join(spark.read.parquet(f"{root}/memory/{n - 1}"), "conv_id", "left").withColumn("history", F.coalesce("history", none))
        else:
            given = given.withColumn("history", none)
        given.join(respond(given), "conv_id", "left").write.mode("overwrite").parquet(f"{root}/answered/round={n}")
        done = spark.read.parquet(f"{root}/answered/round={n}")
        said = F.array(F.struct(F.col("text").alias("query"), F.col("answer").alias("response")))
        longer = F.when(F.col("answer").isNotNull(), F.concat("history", said)).otherwise(F.col("history"))
        going_on = questions.where(F.col("round") == n + 1).select("conv_id")
        done.join(going_on, "conv_id", "left_semi").select("conv_id", _last(longer, window).alias("history")).write.mode("overwrite").parquet(f"{root}/memory/{n}")
        if n > 1:
            removed(spark, f"{root}/memory/{n - 2}")
    return spark.read.parquet(f"{root}/answered")


def _last(turns: Column, window: int | None) -> Column:
    return turns if window is None else F.slice(turns, F.greatest(F.size(turns) - window + 1, F.lit(1)), F.lit(window))


def retrieving(docs: DataFrame | None, points: DataFrame | None, k: int = rag.K, store: PointStore | None = None, **graph_arm: DataFrame) -> Respond:
    """Answers a round's questions from what is found for them, made standalone by the history: conv_id, contexts, answer."""

    def respond(given: DataFrame) -> DataFrame:
        asked = rag.rewritten(given.select(F.col("conv_id").alias("query_id"), "text", "history"))
        searched = asked.select("query_id", F.col("standalone").alias("text"))
        vectors = searched.select("query_id", PROVIDERS["embed"](F.col("text")).alias("vector"))
        if graph_arm:
            more = {"entities": rag.query_entities(searched)} | graph_arm
        else:
            more = {}
        found = rag.retrieve(docs, searched, points, vectors, k=k, store=store, **more)
        return rag.predictions(asked, found, failed=True).withColumnRenamed("query_id", "conv_id")

    return respond


def run_conversations(tasks: DataFrame, path: str, respond: Respond, order: str = "task_id", window: int | None = WINDOW, root: str | None = None) -> DataFrame:
    """Answers tasks with memory, writes the prediction file and gives it as it is read back.

    tasks as jsonl.load_tasks gives them; those of one conversation_id are asked in the order column's order, and those
    without one are conversations of their own. A task whose answer failed has the gate's message and no contexts.
    """
    own = F.coalesce(F.concat(F.lit("c"), "conversation_id"), F.concat(F.lit("t"), "task_id"))
    first = F.coalesce(F.get("input", F.lit(0))["text"], F.lit(""))
    asked = tasks.select(own.alias("conv_id"), F.col(order).alias("turn"), first.alias("text"), "task_id")
    answered = in_rounds(asked, respond, window, root).where("answer is not null").select(F.col("task_id").alias("query_id"), "contexts", "answer")
    jsonl.write_predictions(rag.predicted_tasks(tasks, answered), path)
    return jsonl.load_tasks(tasks.sparkSession, path)
