"""The whole way from questions to predictions, as one lazy plan over a batch of questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.functions import text as T
from kgloom.operators import evaluate, fusion, graph
from kgloom.operators import retrieval as R
from kgloom.operators.retrieval import K
from kgloom.shared import stored
from kgloom.sources import jsonl
from kgloom.sources.points import PointStore

from .providers import PROVIDERS


def rewritten(asked: DataFrame) -> DataFrame:
    """asked (query_id, text, history) with standalone, the question that is searched for."""
    judged = T.is_yes(PROVIDERS["judge"](F.col("text"), F.col("history")))
    return asked.withColumn("standalone", F.when(judged, PROVIDERS["rewrite"](F.col("text"), F.col("history"))).otherwise(F.col("text")))


def query_entities(asked: DataFrame, text: str = "text") -> DataFrame:
    """query_id, entity_pos, name: what the provider finds in each question, in its order."""
    found = PROVIDERS["query_entities"](F.col(text))["entities"]
    return asked.select("query_id", F.posexplode(found).alias("pos", "e")).select("query_id", (F.col("pos") + 1).alias("entity_pos"), F.col("e.name").alias("name"))


def retrieve(docs: DataFrame | None, asked: DataFrame, points: DataFrame | None, query_vectors: DataFrame, entities: DataFrame | None = None, mentions: DataFrame | None = None, k: int = K, edges: DataFrame | None = None, store: PointStore | None = None, hybrid: DataFrame | None = None) -> DataFrame:
    """query_id, doc, text, arm, position, max_score: hybrid search, with graph documents after it if entities are given.

    docs: doc_id, text; asked: query_id, text and, if questions are to be made standalone first, history; entities:
    query_id, entity_pos, name; mentions: chunk_id, name. What each arm finds goes through one plan: the best score is a
    window over it, and texts are joined once. store: takes the place of docs and points; no document is tokenised. hybrid:
    what hybrid search has found for the questions before, which isn't searched for again.
    """
    if store is not None:
        points = store.points.read()
        docs = points.select(F.col("doc").alias("doc_id"), "text")
    if "history" in asked.columns:
        asked = rewritten(asked).withColumn("text", F.col("standalone"))
    found = searched(docs, asked, points, query_vectors, k, store) if hybrid is None else hybrid
    rows = found.select("query_id", "doc", F.lit(0).alias("arm"), F.col("rank").alias("pos"), F.col("score_norm").alias("score"))
    if entities is not None:
        near = graph.search(entities, mentions, edges, k)
        rows = rows.unionByName(near.select("query_id", F.col("chunk_id").alias("doc"), F.lit(1).alias("arm"), F.col("position").alias("pos"), F.lit(None).cast("double").alias("score")))
    best = F.coalesce(F.max("score").over(Window.partitionBy("query_id")), F.lit(0.0))
    texts = docs.select(F.col("doc_id").alias("doc"), "text")
    rows = rows.withColumn("max_score", best).join(texts, "doc").where("arm = 0 or text <> ''")
    out = fusion.placed(rows, k) if entities is not None else rows.withColumn("position", F.col("pos"))
    return out.select("query_id", "doc", "text", "arm", "position", "max_score")


def searched(docs: DataFrame | None, asked: DataFrame, points: DataFrame, query_vectors: DataFrame, k: int = K, store: PointStore | None = None) -> DataFrame:
    """query_id, doc, rank, score_norm: what hybrid search finds for each question, which is said twice."""
    twice = asked.withColumn("text", T.duplicated(F.col("text")))
    if store is not None:
        return R.fused([(R.dense_arm(query_vectors, points), 1.0), (store.sparse_arm(twice, "query_id"), 1.0)], k)
    return R.hybrid(twice, docs, points, query_vectors, "doc_id", "query_id", k)


def predictions(asked: DataFrame, retrieved: DataFrame, threshold: float = R.IDK_THRESHOLD, failed: bool = False) -> DataFrame:
    """query_id, contexts, answer of every question: the gate's message where nothing good was found.

    A call that failed (null) gives the message too, or with failed=True no answer, if the gate let it pass.
    """
    rows = F.sort_array(F.collect_list(F.struct("position", F.col("doc").cast("string").alias("document_id"), "text", F.col("max_score").alias("score"))))
    grouped = retrieved.groupBy("query_id").agg(rows.alias("rows"), F.max("max_score").alias("max_score"))  # k rows a question
    joined = asked.select("query_id", F.col("text").alias("question")).join(grouped, "query_id", "left")
    contexts = F.coalesce(F.transform("rows", lambda r: F.struct(r["document_id"], r["text"], r["score"])), F.array().cast("array<struct<document_id:string,text:string,score:double>>"))
    made = PROVIDERS["answer"](F.col("question"), F.transform("rows", lambda r: r["text"]))
    return joined.select("query_id", contexts.alias("contexts"), R.gated(made if failed else F.coalesce(made, F.lit(T.IDK_MESSAGE)), F.coalesce("max_score", F.lit(0.0)), threshold).alias("answer"))


def with_references(answers: DataFrame) -> DataFrame:
    """query_id, answer: answers (query_id, contexts, answer) with a block of the documents that they cite."""
    listed = F.transform("contexts", lambda c: F.struct(c["document_id"].alias("source"), c["text"].alias("text")))
    return answers.select("query_id", fusion.references(F.col("answer"), listed).alias("answer"))


def asked_of(tasks: DataFrame) -> DataFrame:
    """query_id (the task's), text of every task: what its first input says."""
    return tasks.select(F.col("task_id").alias("query_id"), F.coalesce(F.get("input", F.lit(0))["text"], F.lit("")).alias("text"))


def predicted_tasks(tasks: DataFrame, answered: DataFrame) -> DataFrame:
    """Tasks with contexts and predictions, as prediction files have them; a task without an answer gets the gate's message.

    answered: query_id, contexts, answer, as `predictions` gives them.
    """
    got = answered.select(F.col("query_id").alias("task_id"), F.col("contexts").alias("found"), "answer")
    none = F.array().cast("array<struct<document_id:string,text:string,score:double>>")
    joined = tasks.drop("contexts", "predictions").join(got, "task_id", "left")
    made = F.array(F.struct(F.coalesce("answer", F.lit(T.IDK_MESSAGE)).alias("text")))
    return joined.withColumns({"contexts": F.coalesce("found", none), "predictions": made}).drop("found", "answer")


def answered(docs: DataFrame | None, asked: DataFrame, points: DataFrame | None, query_vectors: DataFrame, k: int = K, **graph_arm: DataFrame) -> DataFrame:
    """query_id, contexts, answer of every question: a configured run, with the graph arm if its tables are given."""
    return predictions(asked.select("query_id", "text"), retrieve(docs, asked, points, query_vectors, k=k, **graph_arm))


def run_tasks(tasks: DataFrame, docs: DataFrame, points: DataFrame, path: str, k: int = 5, vectors: DataFrame | None = None, **graph_arm: DataFrame) -> DataFrame:
    """Answers the tasks, writes the prediction file and gives it as it is read back. The questions are embedded if no vectors are given."""
    asked = asked_of(tasks)
    vectors = asked.select("query_id", PROVIDERS["embed"](F.col("text")).alias("vector")) if vectors is None else vectors
    jsonl.write_predictions(predicted_tasks(tasks, answered(docs, asked, points, vectors, k, **graph_arm)), path)
    return jsonl.load_tasks(tasks.sparkSession, path)


def compared_runs(tasks: DataFrame, docs: DataFrame, points: DataFrame, root: str, k: int = 5, vectors: DataFrame | None = None, **graph_arm: DataFrame) -> DataFrame:
    """One row of counts: the same tasks answered with and without the graph, both files written below root.

    The documents are searched once for both: the graph only adds to what hybrid search has found.
    """
    asked = asked_of(tasks)
    vectors = asked.select("query_id", PROVIDERS["embed"](F.col("text")).alias("vector")) if vectors is None else vectors
    found = stored(searched(docs, asked, points, vectors, k), "hybrid")
    runs = [run_tasks(tasks, docs, points, f"{root}/{name}", k, vectors, hybrid=found, **arm) for name, arm in (("kg", graph_arm), ("no_kg", {}))]
    rows = [run.select("task_id", F.lit(0).alias("line_no"), F.get("predictions", F.lit(0))["text"].alias("answer"), F.size("contexts").alias("n_contexts")) for run in runs]
    return evaluate.compared(*rows)
