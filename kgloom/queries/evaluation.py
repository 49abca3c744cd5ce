"""Conversations, prediction files and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import text as T
from kgloom.operators import conversation, evaluate

from . import query, table

TURNS = """turns AS (SELECT conv_id, turn, text AS query, coalesce(CASE WHEN nr = 'assistant' THEN nt END, '') AS response FROM (
  SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'),
hist AS (SELECT *, string_agg('Q: ' || query || chr(10) || 'A: ' || response, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS h,
  count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS n FROM turns)"""
# The words of the offline rule, as the operator has them.
REFERS = "(it|its|that|this|these|those|they|them|he|she|former|latter)"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.turns(table(spark, sf_dir, "conversations"))


@query(f"WITH {TURNS} SELECT conv_id, turn, n AS n_before FROM hist")
def history_window(spark, sf_dir):
    return conversation.history(asked(spark, sf_dir)).select("conv_id", "turn", F.size("history").cast("long").alias("n_before"))


@query(f"WITH {TURNS} SELECT conv_id, turn, md5(coalesce(h, '')) AS digest FROM hist")
def history_text(spark, sf_dir):
    rows = conversation.history(asked(spark, sf_dir))
    return rows.select("conv_id", "turn", F.md5(conversation.history_text(F.col("history"))).alias("digest"))


@query("WITH t AS (SELECT conv_id, turn, text AS query, coalesce(CASE WHEN nr = 'assistant' THEN nt END, '') AS response FROM (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user') SELECT conv_id, turn, md5(coalesce(string_agg('Q: ' || query || chr(10) || 'A: ' || response, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '')) AS digest FROM t")
def history_full(spark, sf_dir):
    """All turns before each one."""
    rows = conversation.history(asked(spark, sf_dir), window=None)
    return rows.select("conv_id", "turn", F.md5(conversation.history_text(F.col("history"))).alias("digest"))


@query(rf"WITH {TURNS} SELECT conv_id, turn, n > 0 AND regexp_matches(lower(query), '(^|[^\p{{L}}]){REFERS}([^\p{{L}}]|$)') AS rewrite FROM hist")
def rewrite_judge_rule(spark, sf_dir):
    from kgloom.plans.providers import PROVIDERS

    rows = conversation.history(asked(spark, sf_dir))
    return rows.select("conv_id", "turn", T.is_yes(PROVIDERS["judge"](F.col("query"), F.col("history"))).alias("rewrite"))


@query("""WITH t AS (SELECT source, doc_id // 10 AS task FROM documents GROUP BY ALL), c AS (SELECT source, doc_id // 10 AS task, lang || '_' || doc_id AS id FROM documents)
SELECT source, task FROM t WHERE EXISTS (SELECT 1 FROM c WHERE c.source = t.source AND c.task = t.task AND starts_with(c.id, 'fr_'))""")
def task_prefix_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", F.floor(F.col("doc_id") / 10).alias("task"), F.concat_ws("_", "lang", F.col("doc_id").cast("string")).alias("document_id"))
    tasks = rows.groupBy("source", "task").agg(F.collect_list(F.struct("document_id")).alias("contexts"))  # ten rows at most
    return evaluate.with_prefix(tasks, "fr_").select("source", "task")


#: Lines of a prediction file with faults by the line's number: a JSON text made of parts. Fixed values.
FAULTS = [
    '{"task_id": "%n", "Collection": "c", "input": [], "contexts": [{"document_id": "d", "score": 1.5}], "predictions": [{"text": "x"}]}',
    '{"task_id": %n, "Collection": 1, "input": {}, "contexts": {}, "predictions": "x"}',
    '{"Collection": null, "contexts": []}',
    '{"task_id": "%n", ',
    '{"task_id": null, "contexts": [1, {"document_id": 5}, {"document_id": "d", "score": "high"}, {"document_id": "d", "score": true}], "predictions": [2, {}, {"text": 3}]}',
    '{"task_id": "%n", "Collection": "c", "input": [], "contexts": [{},{},{},{},{},{},{},{},{},{},{}], "predictions": []}',
    "   ",
    "[1, 2]",
]
LINES = "lines AS (SELECT line_no, replace(CAST([{}] AS VARCHAR[])[CAST(line_no % 8 AS INTEGER) + 1], '%n', CAST(line_no AS VARCHAR)) AS line FROM (SELECT conv_id * 100 + turn AS line_no FROM conversations))".format(", ".join("'" + x + "'" for x in FAULTS))


def prediction_lines(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("line_no"))
    given = F.array(*map(F.lit, FAULTS))
    return rows.select("line_no", F.replace(F.get(given, (F.col("line_no") % 8).cast("int")), F.lit("%n"), F.col("line_no").cast("string")).alias("line"))


def validation_sql(mode: str) -> str:
    """The same rules over DuckDB's JSON types."""
    kinds = {"STRING": "VARCHAR", "ARRAY": "ARRAY"}
    parts = []
    for field, kind in evaluate.REQUIRED[mode].items():
        parts.append(f"SELECT line_no, 'missing' AS code, '{field}' AS field, NULL AS item FROM good WHERE json_type(j, '$.{field}') IS NULL")
        parts.append(f"SELECT line_no, 'wrong_type', '{field}', NULL FROM good WHERE json_type(j, '$.{field}') <> '{kinds[kind]}'")
    ctx = "json_type(j, '$.contexts')"
    parts.append(f"SELECT line_no, 'not_a_list', 'contexts', NULL FROM good WHERE coalesce({ctx}, '') <> 'ARRAY'")
    parts.append(f"SELECT line_no, 'empty_contexts', 'contexts', NULL FROM good WHERE {ctx} = 'ARRAY' AND json_array_length(j, '$.contexts') = 0")
    parts.append(f"SELECT line_no, 'too_many_contexts', 'contexts', NULL FROM good WHERE {ctx} = 'ARRAY' AND json_array_length(j, '$.contexts') > 10")

    def members(name: str, fields: dict[str, str]) -> None:
        items = f"(SELECT line_no, i AS item, json_extract(j, '$.{name}[' || i || ']') AS x FROM (SELECT line_no, j, unnest(range(0, CAST(json_array_length(j, '$.{name}') AS BIGINT))) AS i FROM good WHERE json_type(j, '$.{name}') = 'ARRAY'))"
        parts.append(f"SELECT line_no, 'not_an_object', '{name}', item FROM {items} WHERE json_type(x) <> 'OBJECT'")
        for f, ok in fields.items():
            parts.append(f"SELECT line_no, 'missing', '{name}.{f}', item FROM {items} WHERE json_type(x) = 'OBJECT' AND json_type(x, '$.{f}') IS NULL")
            parts.append(f"SELECT line_no, 'wrong_type', '{name}.{f}', item FROM {items} WHERE json_type(x) = 'OBJECT' AND json_type(x, '$.{f}') NOT IN ({ok})")

    members("contexts", {"document_id": "'VARCHAR'", "score": "'BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT', 'BOOLEAN'"})
    if "predictions" in evaluate.REQUIRED[mode]:
        members("predictions", {"text": "'VARCHAR'"})
    union = " UNION ALL ".join(parts)
    return f"""{LINES}, good AS (SELECT line_no, CAST(line AS JSON) AS j FROM lines WHERE trim(line) <> '' AND json_valid(line)),
faults AS (SELECT line_no, 'invalid_json' AS code, 'line' AS field, NULL AS item FROM lines WHERE trim(line) <> '' AND NOT json_valid(line) UNION ALL {union})"""


def _validation(mode: str):
    def run(spark, sf_dir):
        return evaluate.validated(prediction_lines(spark, sf_dir), mode)

    return run


for _letter, _mode in (("a", "retrieval_taska"), ("b", "generation_taskb"), ("c", "rag_taskc")):
    _run = _validation(_mode)
    _run.__name__ = f"validate_task_{_letter}"
    query(f"WITH {validation_sql(_mode)} SELECT line_no, code, field, CAST(item AS INTEGER) AS item FROM faults")(_run)


@query(f"""WITH {validation_sql("rag_taskc")}, inp AS (SELECT CAST(line_no AS VARCHAR) AS task_id FROM lines WHERE line_no % 3 <> 0), got AS (SELECT json_extract_string(j, '$.task_id') AS task_id FROM good WHERE json_type(j, '$.task_id') = 'VARCHAR'),
ids AS (SELECT 'missing' AS code FROM (SELECT DISTINCT task_id FROM inp) WHERE task_id NOT IN (SELECT task_id FROM got) UNION ALL SELECT 'extra' FROM (SELECT DISTINCT task_id FROM got) WHERE task_id NOT IN (SELECT task_id FROM inp) UNION ALL SELECT 'count_differs' WHERE (SELECT count(*) FROM inp) <> (SELECT count(*) FROM got))
SELECT CASE code WHEN 'empty_contexts' THEN 'warning' ELSE 'error' END AS severity, code, count(*) AS n FROM (SELECT code FROM ids UNION ALL SELECT code FROM faults) GROUP BY ALL""")
def validation_report(spark, sf_dir):
    lines = prediction_lines(spark, sf_dir)
    given = lines.where("line_no % 3 <> 0").select("line_no", F.format_string('{"task_id": "%d"}', "line_no").alias("line"))
    return evaluate.report(given, lines, "rag_taskc")


@query(f"WITH {LINES} SELECT json_extract_string(CAST(line AS JSON), '$.task_id') AS task_id FROM (SELECT line FROM lines WHERE json_valid(line)) WHERE json_type(CAST(line AS JSON), '$.task_id') = 'VARCHAR'")
def task_ids_clean(spark, sf_dir):
    return evaluate.task_ids(prediction_lines(spark, sf_dir))


DIFF = "a AS (SELECT 'c' || conv_id || '-' || turn AS task_id FROM conversations WHERE turn % 3 <> 0), b AS (SELECT 'c' || conv_id || '-' || turn AS task_id FROM conversations WHERE turn % 2 = 0)"


@query(f"WITH {DIFF} SELECT 'missing' AS code, task_id FROM (SELECT task_id FROM a EXCEPT SELECT task_id FROM b) UNION ALL SELECT 'extra', task_id FROM (SELECT task_id FROM b EXCEPT SELECT task_id FROM a) UNION ALL SELECT 'count_differs', (SELECT count(*) FROM a) || '/' || (SELECT count(*) FROM b) WHERE (SELECT count(*) FROM a) <> (SELECT count(*) FROM b)")
def task_id_diff(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select("turn", F.concat(F.lit("c"), F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("task_id"))
    return evaluate.compared_ids(ids.where("turn % 3 <> 0"), ids.where("turn % 2 = 0"))


#: Two runs over the conversations: answers differ by the turn, some are the message that nothing was found.
RUNS = f"""runs AS (SELECT conv_id AS task, conv_id * 100 + turn AS line_no, text, turn FROM conversations WHERE role = 'assistant'),
kg AS (SELECT task AS task_id, arg_max(CASE WHEN line_no % 7 = 0 THEN '{T.IDK_MESSAGE.replace("'", "''")}' ELSE text END, line_no) AS a, arg_max(turn + 1, line_no) AS ca FROM runs WHERE task % 11 <> 0 GROUP BY task),
no_kg AS (SELECT task AS task_id, arg_max(CASE WHEN line_no % 5 = 0 THEN upper('{T.IDK_MESSAGE.replace("'", "''")}') WHEN line_no % 4 = 0 THEN 'other' ELSE text END, line_no) AS b, arg_max(turn, line_no) AS cb FROM runs WHERE task % 13 <> 0 GROUP BY task)"""
COUNTS = f"""{RUNS}, both_ AS (SELECT *, contains(lower(a), 'couldn''t find relevant information') AS ia, contains(lower(b), 'couldn''t find relevant information') AS ib FROM kg FULL JOIN no_kg USING (task_id)),
counts AS (SELECT count(ca) AS total_tasks, count(*) FILTER (WHERE a = b) AS same_responses, count(*) FILTER (WHERE a <> b) AS different_responses, count(*) FILTER (WHERE NOT ia AND ib) AS kg_only_answered, count(*) FILTER (WHERE ia AND NOT ib) AS no_kg_only_answered,
  coalesce(round(avg(ca), 6), 0) AS avg_contexts_kg, coalesce(round(avg(cb), 6), 0) AS avg_contexts_no_kg FROM both_)"""


def _runs(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'").select(F.col("conv_id").alias("task_id"), (F.col("conv_id") * 100 + F.col("turn")).alias("line_no"), "text", "turn")
    a = rows.where("task_id % 11 <> 0").select("task_id", "line_no", F.when(F.col("line_no") % 7 == 0, T.IDK_MESSAGE).otherwise(F.col("text")).alias("answer"), (F.col("turn") + 1).alias("n_contexts"))
    b = rows.where("task_id % 13 <> 0").select("task_id", "line_no", F.when(F.col("line_no") % 5 == 0, T.IDK_MESSAGE.upper()).when(F.col("line_no") % 4 == 0, "other").otherwise(F.col("text")).alias("answer"), F.col("turn").alias("n_contexts"))
    return a, b


@query(f"WITH {COUNTS} SELECT * FROM counts")
def compare_predictions(spark, sf_dir):
    return evaluate.compared(*_runs(spark, sf_dir))


@query(f"WITH {COUNTS} SELECT total_tasks, round(CASE WHEN n > 0 THEN same_responses * 100 / n ELSE 0 END, 1) AS pct_same, round(CASE WHEN n > 0 THEN different_responses * 100 / n ELSE 0 END, 1) AS pct_different, CASE WHEN kg_only_answered > no_kg_only_answered THEN 'kg' WHEN kg_only_answered < no_kg_only_answered THEN 'no_kg' ELSE 'equal' END AS verdict FROM (SELECT *, CAST(same_responses + different_responses AS DOUBLE) AS n FROM counts)")
def ab_report(spark, sf_dir):
    return evaluate.verdict(evaluate.compared(*_runs(spark, sf_dir)))


@query(f"WITH {RUNS} SELECT count(*) AS tasks, count(*) FILTER (WHERE contains(lower(a), 'couldn''t find relevant information')) AS idk FROM kg")
def idk_counts(spark, sf_dir):
    rows = evaluate.last_of(_runs(spark, sf_dir)[0], "task_id", "line_no")
    return rows.agg(F.count(F.lit(1)).alias("tasks"), F.count_if(T.is_idk(F.col("answer"))).alias("idk"))


@query("SELECT total, passed, CASE WHEN passed = total THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT count(*) AS total, count(*) FILTER (WHERE contains(lower(text), 'ion') OR contains(lower(text), 'über')) AS passed FROM conversations)")
def keyword_hit_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("text").alias("response"), F.array(F.lit("ION"), F.lit("über")).alias("keywords"))
    return evaluate.hits(rows)


@query("SELECT conv_id, count(*) AS total, count(*) FILTER (WHERE contains(lower(text), 'ion') OR contains(lower(text), 'über')) AS passed, CASE WHEN count(*) = count(*) FILTER (WHERE contains(lower(text), 'ion') OR contains(lower(text), 'über')) THEN 'PASS' ELSE 'FAIL' END AS status FROM conversations GROUP BY conv_id")
def conversation_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("text").alias("response"), F.array(F.lit("ION"), F.lit("über")).alias("keywords"))
    return evaluate.hits_by(rows, "conv_id")


@query(rf"""WITH RECURSIVE t AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS n FROM conversations WHERE role = 'user'),
r AS (
  SELECT conv_id, turn, n, text, 0::BIGINT AS n_before, md5(text || '|') AS answer, ['Q: ' || text || chr(10) || 'A: ' || md5(text || '|')] AS said FROM t WHERE n = 1
  UNION ALL
  SELECT conv_id, turn, n, text, len(said), a, list_append(said, 'Q: ' || text || chr(10) || 'A: ' || a)[-5:] FROM (
    SELECT *, md5(CASE WHEN regexp_matches(lower(text), '(^|[^\p{{L}}]){REFERS}([^\p{{L}}]|$)') THEN text || ' ' || last ELSE text END || '|' || array_to_string(said, chr(10))) AS a
    FROM (SELECT t.*, r.answer AS last, r.said FROM r JOIN t ON t.conv_id = r.conv_id AND t.n = r.n + 1)))
SELECT conv_id, turn, n_before, answer FROM r""")
def conversation_rounds(spark, sf_dir):
    """Every answer is a digest of the question, made standalone by the last answer, and of the history: a chain of all turns."""
    from kgloom.plans import rag, rounds
    from kgloom.plans.providers import using

    def respond(given):
        made = rag.rewritten(given)
        return made.select("conv_id", F.md5(F.concat("standalone", F.lit("|"), conversation.history_text(F.col("history")))).alias("answer"))

    asked = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    with using(rewrite=lambda q, h: F.concat_ws(" ", q, F.element_at(h, -1)["response"])):
        return rounds.in_rounds(asked, respond).select("conv_id", "turn", F.size("history").cast("long").alias("n_before"), "answer")
