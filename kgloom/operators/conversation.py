"""Conversations: history windows and the decision to rewrite a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOW = 5
#: Offline rule for "depends on what was said before": it refers to something. Fixed values.
REFERENCES = ("it", "its", "that", "this", "these", "those", "they", "them", "he", "she", "former", "latter")


def turns(rows: DataFrame) -> DataFrame:
    """conv_id, turn, query, response: each user row with the assistant row right after it."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    after = rows.withColumns({"next_role": F.lead("role").over(by), "response": F.lead("text").over(by)})
    asked = after.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"), F.when(F.col("next_role") == "assistant", F.col("response")).alias("response"))
    return asked.withColumn("response", F.coalesce("response", F.lit("")))


def history(asked: DataFrame, window: int | None = WINDOW) -> DataFrame:
    """asked with history, the turns before each one (the last `window` of them, or all), oldest first."""
    by = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-window if window else Window.unboundedPreceding, -1)
    return asked.withColumn("history", F.collect_list(F.struct("query", "response")).over(by))


def history_text(turns_before: Column) -> Column:
    line = lambda t: F.concat(F.lit("Q: "), t["query"], F.lit("\nA: "), t["response"])
    return F.array_join(F.transform(turns_before, line), "\n")


def needs_rewrite(query: Column, turns_before: Column) -> Column:
    """Offline judge: there is a history, and the query has a word that refers back."""
    words = F.split(F.lower(query), r"[^\p{L}]+")
    return (F.size(turns_before) > 0) & F.exists(words, lambda w: w.isin(*REFERENCES))
