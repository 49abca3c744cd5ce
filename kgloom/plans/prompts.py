"""Prompts as Column expressions; the wording is this library's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kgloom.functions import names as N
from kgloom.functions import text as T


def extraction(text: Column, domain: Column) -> Column:
    """For one document: the types of its domain, and the text's beginning."""
    return F.concat(F.lit("Extract entities of these types: "), F.array_join(N.entity_types_of(domain), ", "), F.lit("\n"), F.substring(text, 1, T.SINGLE_CHARS))


def batch_document(doc_id: Column, text: Column, chars: int = T.STRUCTURED_BATCH_CHARS) -> Column:
    """A document's part in a prompt for several."""
    return F.concat(F.lit("--- Document "), doc_id.cast("string"), F.lit(" ---\n"), T.truncated(text, chars))


def gleaning(text: Column, names: Column) -> Column:
    """A second look: what was found first (three names), and the text's beginning."""
    found = F.when(F.size(names) > 0, F.concat(F.lit("Found so far: "), F.array_join(F.slice(names, 1, 3), ", "))).otherwise(F.lit("Nothing found so far."))
    return F.concat(found, F.lit("\n"), F.substring(text, 1, T.SINGLE_CHARS))


def query_entities(query: Column) -> Column:
    return F.concat(F.lit("Name the entities in this question: "), query)


def rewrite_judge(query: Column, history: Column) -> Column:
    return F.concat(F.lit("Does the question depend on the conversation? Answer yes or no.\n"), history, F.lit("\nQuestion: "), query)


def rewrite(query: Column, history: Column) -> Column:
    return F.concat(F.lit("Put the question so that it stands alone.\n"), history, F.lit("\nQuestion: "), query)


def answer(query: Column, context: Column) -> Column:
    return F.concat(F.lit("Answer from the numbered documents and cite them as [n].\n"), context, F.lit("\nQuestion: "), query)
