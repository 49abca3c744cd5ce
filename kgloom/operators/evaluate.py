"""Evaluation: tasks, validation of prediction files, comparison of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kgloom.functions import text as T

MAX_CONTEXTS, MAX_MB = 10, 20
# Required fields and their types in each mode.
REQUIRED = {
    "retrieval_taska": {"task_id": "STRING", "Collection": "STRING", "contexts": "ARRAY"},
    "generation_taskb": {"task_id": "STRING", "input": "ARRAY", "contexts": "ARRAY", "predictions": "ARRAY"},
    "rag_taskc": {"task_id": "STRING", "Collection": "STRING", "input": "ARRAY", "contexts": "ARRAY", "predictions": "ARRAY"},
}
NUMBERS = ("BIGINT", "DOUBLE", "DECIMAL", "FLOAT", "INT", "BOOLEAN")  # booleans pass as numbers


def with_prefix(tasks: DataFrame, prefix: str | None) -> DataFrame:
    """Tasks with any context whose document id begins with the prefix; all, without one. A null contexts has none."""
    if prefix is None:
        return tasks
    return tasks.where(F.coalesce(F.exists("contexts", lambda c: F.coalesce(F.startswith(c["document_id"], F.lit(prefix)), F.lit(False))), F.lit(False)))


def _kind(v: Column) -> Column:
    """STRING, ARRAY, OBJECT, BIGINT, ..., VOID for a JSON null; null where there is no value."""
    return F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1)


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def validated(lines: DataFrame, mode: str) -> DataFrame:
    """line_no, code, field, item: the faults of each line of a prediction file; item is the index within a list, or null.

    lines: line_no, line. Blank lines are skipped. Codes: invalid_json, missing, wrong_type, not_a_list,
    too_many_contexts, not_an_object, and the warning empty_contexts. All checks are one pass over the line.
    """
    fault = lambda code, field, item=None: F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), (F.lit(None) if item is None else item).cast("int").alias("item"))
    rows = lines.withColumn("line", F.trim("line")).where("line <> ''").withColumn("v", T.strict_json(F.col("line")))
    v = F.col("v")
    checks = []
    for field, kind in REQUIRED[mode].items():
        got = _at(v, f"$.{field}")
        checks.append(F.when(got.isNull(), fault("missing", field)))
        checks.append(F.when(got.isNotNull() & (_kind(got) != kind), fault("wrong_type", field)))
    contexts = _at(v, "$.contexts")
    listed = F.coalesce(_kind(contexts) == "ARRAY", F.lit(False))
    items = F.when(listed, contexts.cast("array<variant>"))
    checks.append(F.when(~listed, fault("not_a_list", "contexts")))
    checks.append(F.when(listed & (F.size(items) == 0), fault("empty_contexts", "contexts")))
    checks.append(F.when(F.size(items) > MAX_CONTEXTS, fault("too_many_contexts", "contexts")))

    def member(x: Column, i: Column, field: str, kinds: tuple, name: str) -> Column:
        got = _at(x, f"$.{field}")
        return F.when(_kind(x) == "OBJECT", F.when(got.isNull(), fault("missing", f"{name}.{field}", i)).when(~_kind(got).isin(*kinds), fault("wrong_type", f"{name}.{field}", i)))

    each = F.flatten(F.transform(items, lambda x, i: F.array(F.when(_kind(x) != "OBJECT", fault("not_an_object", "contexts", i)), member(x, i, "document_id", ("STRING",), "contexts"), member(x, i, "score", NUMBERS, "contexts"))))
    lists = [F.array(*checks), each]
    if "predictions" in REQUIRED[mode]:
        preds = _at(v, "$.predictions")
        items = F.when(F.coalesce(_kind(preds) == "ARRAY", F.lit(False)), preds.cast("array<variant>"))
        lists.append(F.flatten(F.transform(items, lambda x, i: F.array(F.when(_kind(x) != "OBJECT", fault("not_an_object", "predictions", i)), member(x, i, "text", ("STRING",), "predictions")))))
    empty = F.array().cast("array<struct<code:string,field:string,item:int>>")
    found = F.when(v.isNull(), F.array(fault("invalid_json", "line"))).otherwise(F.concat(*[F.coalesce(x, empty) for x in lists]))
    out = rows.select("line_no", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("f"))
    return out.select(F.col("line_no").cast("long").alias("line_no"), "f.code", "f.field", "f.item")


def task_ids(lines: DataFrame) -> DataFrame:
    """task_id of every line that is an object with a text as its id."""
    v = T.strict_json(F.col("line"))
    got = _at(v, "$.task_id")
    return lines.select(F.when(_kind(got) == "STRING", F.try_variant_get(v, "$.task_id", "string")).alias("task_id")).where("task_id is not null")


def compared_ids(asked: DataFrame, predicted: DataFrame) -> DataFrame:
    """code, task_id: missing and extra ids, and count_differs with both counts where their numbers differ."""
    a, b = asked.select("task_id"), predicted.select("task_id")
    missing = a.distinct().join(b, "task_id", "left_anti").select(F.lit("missing").alias("code"), "task_id")
    extra = b.distinct().join(a, "task_id", "left_anti").select(F.lit("extra").alias("code"), "task_id")
    counts = a.agg(F.count(F.lit(1)).alias("x")).crossJoin(b.agg(F.count(F.lit(1)).alias("y"))).where("x <> y")
    return missing.unionByName(extra).unionByName(counts.select(F.lit("count_differs").alias("code"), F.concat_ws("/", F.col("x").cast("string"), F.col("y").cast("string")).alias("task_id")))


def report(asked_lines: DataFrame, predicted_lines: DataFrame, mode: str) -> DataFrame:
    """severity, code, n over a whole file: id faults and line faults; empty contexts are warnings."""
    ids = compared_ids(task_ids(asked_lines), task_ids(predicted_lines)).select("code")
    both = ids.unionByName(validated(predicted_lines, mode).select("code"))
    severity = F.when(F.col("code") == "empty_contexts", "warning").otherwise("error")
    return both.groupBy(severity.alias("severity"), "code").agg(F.count(F.lit(1)).alias("n"))


def last_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last in order."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("__r", rank).where("__r = 1").drop("__r")


def compared(with_kg: DataFrame, without: DataFrame) -> DataFrame:
    """One row of counts over two runs. Both: task_id, line_no, answer, n_contexts; the last of an id counts."""
    a = last_of(with_kg, "task_id", "line_no").select("task_id", F.col("answer").alias("a"), F.col("n_contexts").alias("ca"))
    b = last_of(without, "task_id", "line_no").select("task_id", F.col("answer").alias("b"), F.col("n_contexts").alias("cb"))
    both = a.join(b, "task_id", "full_outer")
    in_a, in_both = F.col("ca").isNotNull(), F.col("ca").isNotNull() & F.col("cb").isNotNull()
    return both.agg(
        F.count_if(in_a).alias("total_tasks"),
        F.count_if(in_both & (F.col("a") == F.col("b"))).alias("same_responses"),
        F.count_if(in_both & (F.col("a") != F.col("b"))).alias("different_responses"),
        F.count_if(in_both & ~T.is_idk(F.col("a")) & T.is_idk(F.col("b"))).alias("kg_only_answered"),
        F.count_if(in_both & T.is_idk(F.col("a")) & ~T.is_idk(F.col("b"))).alias("no_kg_only_answered"),
        F.coalesce(F.round(F.avg("ca"), 6), F.lit(0.0)).alias("avg_contexts_kg"),
        F.coalesce(F.round(F.avg("cb"), 6), F.lit(0.0)).alias("avg_contexts_no_kg"),
    )


def verdict(counts: DataFrame) -> DataFrame:
    """Percentages of compared answers, and which run answered more."""
    n = F.col("same_responses") + F.col("different_responses")
    share = lambda c: F.round(F.when(n > 0, F.col(c) * 100 / n).otherwise(F.lit(0.0)), 1)
    word = F.when(F.col("kg_only_answered") > F.col("no_kg_only_answered"), "kg").when(F.col("kg_only_answered") < F.col("no_kg_only_answered"), "no_kg").otherwise("equal")
    return counts.select("total_tasks", share("same_responses").alias("pct_same"), share("different_responses").alias("pct_different"), word.alias("verdict"))


def hits(rows: DataFrame) -> DataFrame:
    """One row: turns, turns whose response has any expected keyword, PASS or FAIL. rows: response, keywords."""
    passed = F.count_if(T.any_keyword(F.col("response"), F.col("keywords")))
    return rows.agg(F.count(F.lit(1)).alias("total"), passed.alias("passed")).withColumn("status", F.when(F.col("passed") == F.col("total"), "PASS").otherwise("FAIL"))


def hits_by(rows: DataFrame, by: str) -> DataFrame:
    """The same for each value of a column, as one row for each test conversation."""
    passed = F.count_if(T.any_keyword(F.col("response"), F.col("keywords")))
    counts = rows.groupBy(by).agg(F.count(F.lit(1)).alias("total"), passed.alias("passed"))
    return counts.withColumn("status", F.when(F.col("passed") == F.col("total"), "PASS").otherwise("FAIL"))


def file_sizes(spark, path: str, max_mb: int = MAX_MB) -> DataFrame:
    """path, length, within_limit of each file; contents aren't read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    return files.withColumn("within_limit", F.col("length") <= max_mb * 1024 * 1024)
