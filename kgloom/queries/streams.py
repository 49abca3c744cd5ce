"""Streams run to their end, against the same work as a batch; runs from questions to prediction files."""

from __future__ import annotations

from pyspark.sql import functions as F

from kgloom.functions import text as T
from kgloom.plans import rag
from kgloom.plans.providers import using
from kgloom.shared import scratch
from kgloom.sources import jsonl
from kgloom.streaming import indexer

from . import query, table
from .evaluation import REFERS
from .graphs import ASKED, MENTIONS, asked, mentions
from .search import DENSE, GATE, IDF, POSTED, SPARSE, _posted, fused_sql, items, points, query_vectors


@query(f"WITH {POSTED} SELECT doc, count(*) AS tokens, CAST(sum(tf) AS BIGINT) AS tf, round(max(weight), 6) AS top FROM d GROUP BY doc")
def stream_index_equals_batch(spark, sf_dir):
    root = scratch(spark, "stream-index")
    rows = indexer.stream_table(spark, f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("doc"), "text")
    indexer.index_stream(rows, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    found = indexer.indexed(spark, f"{root}/out")
    return found.groupBy("doc").agg(F.count(F.lit(1)).alias("tokens"), F.sum("tf").alias("tf"), F.round(F.max("weight"), 6).alias("top"))


@query("SELECT event_type AS name, 'user ' || (user_id % 10) AS type, arg_max(d, length(d) * CAST(100000000000 AS BIGINT) - event_id) AS description, count(*) AS n, min(event_id) AS first_seq FROM (SELECT *, substr(props, 1, 4 + CAST(event_id % 5 AS INTEGER)) AS d FROM events) GROUP BY ALL")
def stream_dedup_state(spark, sf_dir):
    root = scratch(spark, "stream-entities")
    rows = indexer.stream_table(spark, f"{sf_dir}/events.parquet")
    text = F.substr(F.col("props"), F.lit(1), (4 + F.col("event_id") % 5).cast("int"))
    entities = rows.select(F.col("event_type").alias("name"), F.concat(F.lit("user "), (F.col("user_id") % 10).cast("string")).alias("type"), text.alias("description"), F.col("event_id").alias("seq"))
    indexer.merged_stream(entities, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return indexer.merged(spark, f"{root}/out")


def _asked(spark, sf_dir):
    return items(spark, sf_dir).select(F.col("item_id").alias("query_id"), "text")


def _retrieved(spark, sf_dir, with_graph: bool):
    rows, q = table(spark, sf_dir, "documents"), _asked(spark, sf_dir)
    graph = {"entities": asked(spark, sf_dir).drop("title", "domain"), "mentions": mentions(spark, sf_dir)} if with_graph else {}
    return q, rag.retrieve(rows, q, points(spark, sf_dir), query_vectors(spark, sf_dir), k=8, **graph)


_HIT = f"""WITH {SPARSE}, {DENSE}, {fused_sql(1, 1, 8)}, {GATE}, {MENTIONS}, {ASKED},
hit AS (SELECT DISTINCT query_id, entity_pos, chunk_id FROM asked a JOIN mentions m ON m.name = a.name),
own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, entity_pos ORDER BY chunk_id) AS r FROM hit) WHERE r <= 10),
firsts AS (SELECT query_id, chunk_id, min(entity_pos) AS entity_pos FROM own GROUP BY ALL),
open_ AS (SELECT query_id, entity_pos, coalesce(sum(n) OVER (PARTITION BY query_id ORDER BY entity_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM (SELECT query_id, entity_pos, count(*) AS n FROM firsts GROUP BY ALL)),
near AS (SELECT * FROM (SELECT f.query_id, chunk_id AS doc, row_number() OVER (PARTITION BY f.query_id ORDER BY f.entity_pos, chunk_id) AS pos FROM firsts f JOIN open_ o ON o.query_id = f.query_id AND o.entity_pos = f.entity_pos AND o.before < 16) WHERE pos <= 8),
allrows AS (SELECT query_id, doc, text, 0 AS arm, rank AS pos FROM fused JOIN documents ON doc_id = doc UNION ALL SELECT query_id, doc, text, 1, pos FROM near JOIN documents ON doc_id = doc WHERE text <> ''),
firsts_ AS (SELECT *, max(arm) OVER (PARTITION BY query_id) AS g, row_number() OVER (PARTITION BY query_id, substr(text, 1, 100) ORDER BY arm, pos) AS nth FROM allrows),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY arm, pos) AS position FROM firsts_ WHERE g = 0 OR nth = 1)"""


@query(f"{_HIT} SELECT p.query_id, p.doc, CAST(p.arm AS BIGINT) AS arm, p.position, b.max_score FROM placed p JOIN best b ON b.query_id = p.query_id WHERE position <= 8")
def retrieve_with_kg(spark, sf_dir):
    found = _retrieved(spark, sf_dir, True)[1]
    return found.select("query_id", "doc", F.col("arm").cast("long").alias("arm"), F.col("position").cast("long").alias("position"), "max_score")


@query(rf"""{_HIT} SELECT b.item_id AS query_id, coalesce(n, 0) AS n_contexts, CASE WHEN n IS NULL THEN 'none' ELSE regexp_extract(t, '^([^.\n]*)', 1) || '. [1]' END AS answer
FROM benchmark b LEFT JOIN (SELECT query_id, count(*) AS n, max(text) FILTER (WHERE position = 1) AS t FROM placed WHERE position <= 8 GROUP BY query_id) p ON p.query_id = b.item_id""")
def prediction_rows(spark, sf_dir):
    """Answers of the offline rule with their contexts."""
    q, found = _retrieved(spark, sf_dir, True)
    out = rag.predictions(q, found)
    return out.select("query_id", F.size("contexts").cast("long").alias("n_contexts"), "answer")


_PLAIN = f"WITH {SPARSE}, {DENSE}, {fused_sql(1, 1, 8)}, {GATE}, first_ AS (SELECT query_id, max(text) FILTER (WHERE rank = 1) AS t, count(*) AS n FROM fused JOIN documents ON doc_id = doc GROUP BY query_id)"
_IDK = "'" + T.IDK_MESSAGE.replace("'", "''") + "'"
_SAID = rf"CASE WHEN f.n IS NULL OR b.max_score < 0.5 THEN {_IDK} ELSE regexp_extract(t, '^([^.\n]*)', 1) || '. [1]' END"


@query(f"{_PLAIN} SELECT b.query_id, md5({_SAID}) AS digest FROM best b LEFT JOIN first_ f ON f.query_id = b.query_id")
def answer_extractive(spark, sf_dir):
    q, found = _retrieved(spark, sf_dir, False)
    return rag.predictions(q, found).select("query_id", F.md5("answer").alias("digest"))


@query(f"{_PLAIN}, said AS (SELECT b.query_id, {_SAID} AS a, t, f.doc FROM best b LEFT JOIN (SELECT f.*, d.doc FROM first_ f JOIN (SELECT query_id, min(doc) FILTER (WHERE place = 1) AS doc FROM (SELECT query_id, doc, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM fused JOIN documents ON doc_id = doc) GROUP BY query_id) d USING (query_id)) f ON f.query_id = b.query_id) SELECT query_id, md5(CASE WHEN contains(a, '[1]') THEN a || chr(10) || chr(10) || '---' || chr(10) || '**References:**' || chr(10) || chr(10) || '[1] ' || doc || chr(10) || '    ' || t || chr(10) ELSE a END) AS digest FROM said")
def answer_with_references(spark, sf_dir):
    q, found = _retrieved(spark, sf_dir, False)
    return rag.with_references(rag.predictions(q, found)).select("query_id", F.md5("answer").alias("digest"))


#: Every second question comes with a history; the judge sends those that refer back to the rewriter, which puts the
#: question before in front.
_ASKED = f"""turned AS (SELECT b.item_id, b.text, CASE WHEN b.item_id % 2 = 0 THEN p.text END AS before FROM benchmark b LEFT JOIN benchmark p ON p.item_id = b.item_id + 1),
rewritten AS (SELECT item_id, CASE WHEN before IS NOT NULL AND regexp_matches(lower(text), '(^|[^\\p{{L}}]){REFERS}([^\\p{{L}}]|$)') THEN before || ' ' || text ELSE text END AS text FROM turned)"""


@query(f"WITH {_ASKED}, {_posted('d', 'documents', 'doc_id')}, {_posted('q', 'rewritten', 'item_id')}, {IDF}, {SPARSE.split(IDF + ', ')[1]}, {DENSE}, {fused_sql(1, 1, 10)}, {GATE} SELECT f.query_id, f.doc, f.rank AS position, b.max_score FROM fused f JOIN documents ON doc_id = f.doc JOIN best b ON b.query_id = f.query_id")
def retrieve_rewritten(spark, sf_dir):
    """Judged, rewritten, asked twice, searched for."""
    rows = items(spark, sf_dir)
    before = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("before"))
    turn = F.struct(F.col("before").alias("query"), F.lit("").alias("response"))
    given = F.when((F.col("item_id") % 2 == 0) & F.col("before").isNotNull(), F.array(turn)).otherwise(F.array().cast("array<struct<query:string,response:string>>"))
    q = rows.join(before, "item_id", "left").select(F.col("item_id").alias("query_id"), "text", given.alias("history"))
    with using(rewrite=lambda text, history: F.concat_ws(" ", F.element_at(history, -1)["query"], text)):
        found = rag.retrieve(table(spark, sf_dir, "documents"), q, points(spark, sf_dir), query_vectors(spark, sf_dir), k=10)
    return found.select("query_id", "doc", F.col("position").cast("long").alias("position"), "max_score")


def _tasks(spark, sf_dir):
    """A task for each benchmark item."""
    given = F.array(F.struct(F.lit("user").alias("speaker"), "text"))
    rows = items(spark, sf_dir).select(F.lit("c").alias("conversation_id"), F.concat(F.lit("t"), F.col("item_id").cast("string")).alias("task_id"), F.lit("s").alias("Collection"), given.alias("input"))
    names = {f.name: f.dataType for f in spark.createDataFrame([], jsonl.TASK_SCHEMA).schema.fields}
    return rows.withColumns({c: F.lit(None).cast(names[c]) for c in ("contexts", "predictions")})


def _run_inputs(spark, sf_dir) -> dict:
    name = F.concat(F.lit("t"), F.col("query_id").cast("string")).alias("query_id")
    arm = {"entities": asked(spark, sf_dir).select(name, "entity_pos", "name"), "mentions": mentions(spark, sf_dir)}
    return {"docs": table(spark, sf_dir, "documents"), "points": points(spark, sf_dir), "vectors": query_vectors(spark, sf_dir).select(name, "vector"), **arm}


@query(f"{_PLAIN} SELECT 't' || b.query_id AS task_id, 's' AS collection, CASE WHEN f.n IS NULL THEN 0 ELSE f.n END AS n_contexts, md5({_SAID}) AS digest FROM best b LEFT JOIN first_ f ON f.query_id = b.query_id")
def evaluation_run(spark, sf_dir):
    """Tasks answered, written as a prediction file and read back."""
    given = _run_inputs(spark, sf_dir)
    for arm in ("entities", "mentions"):
        given.pop(arm)
    rows = rag.run_tasks(_tasks(spark, sf_dir), path=scratch(spark, "predictions"), k=8, **given)
    return rows.select("task_id", F.col("Collection").alias("collection"), F.size("contexts").cast("long").alias("n_contexts"), F.md5(F.get("predictions", F.lit(0))["text"]).alias("digest"))


@query(rf"""{_HIT}, kg AS (SELECT b.query_id, coalesce(n, 0) AS c, CASE WHEN p.n IS NULL OR b.max_score < 0.5 THEN {_IDK} ELSE regexp_extract(t, '^([^.
]*)', 1) || '. [1]' END AS a FROM best b LEFT JOIN (SELECT query_id, count(*) AS n, max(text) FILTER (WHERE position = 1) AS t FROM placed WHERE position <= 8 GROUP BY query_id) p ON p.query_id = b.query_id),
first_ AS (SELECT query_id, max(text) FILTER (WHERE rank = 1) AS t, count(*) AS n FROM fused JOIN documents ON doc_id = doc GROUP BY query_id),
no_kg AS (SELECT b.query_id, coalesce(f.n, 0) AS c, {_SAID} AS a FROM best b LEFT JOIN first_ f ON f.query_id = b.query_id)
SELECT count(*) AS total_tasks, count(*) FILTER (WHERE k.a = n.a) AS same_responses, count(*) FILTER (WHERE k.a <> n.a) AS different_responses, count(*) FILTER (WHERE k.a <> {_IDK} AND n.a = {_IDK}) AS kg_only_answered, count(*) FILTER (WHERE k.a = {_IDK} AND n.a <> {_IDK}) AS no_kg_only_answered, round(avg(k.c), 6) AS avg_contexts_kg, round(avg(n.c), 6) AS avg_contexts_no_kg FROM kg k JOIN no_kg n USING (query_id)""")
def configured_runs(spark, sf_dir):
    """The same tasks with and without the graph: both files written, read and compared."""
    return rag.compared_runs(_tasks(spark, sf_dir), root=scratch(spark, "runs"), k=8, **_run_inputs(spark, sf_dir))
