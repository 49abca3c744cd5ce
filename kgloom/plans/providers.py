"""Model calls as pluggable providers, with offline defaults that are plain rules.

A provider is a function from Columns to a Column. Register another (for instance a pandas UDF around a model's client,
with its own retries) under the same name. The defaults make results repeatable; they are no substitute for a model.
"""

from __future__ import annotations

import contextlib
import time
from collections.abc import Callable, Iterator
from typing import Any, TypeVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from kgloom.functions import text as T
from kgloom.operators import conversation
from kgloom.operators.kg import END, FIELD

A = TypeVar("A")
#: Components of the offline embedding.
DIMENSIONS = 64
#: Runs of words with a capital first letter.
_NAMES = r"(^|[^\p{L}\p{N}_])(\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)"


def embed(text: Column, dimensions: int = DIMENSIONS) -> Column:
    """Feature hashing of the tokens, signed; deterministic across processes. Each token of a batch is hashed once."""

    @F.arrow_udf("array<float>")
    def run(rows: pa.Array) -> pa.Array:
        import hashlib

        n, words = len(rows), rows.flatten().dictionary_encode()
        counts = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        codes = np.array([int(hashlib.md5(t.encode()).hexdigest()[:8], 16) for t in words.dictionary.to_pylist()], np.int64)
        h = codes[words.indices.to_numpy()]
        at = np.repeat(np.arange(n) * dimensions, counts) + h % dimensions
        out = np.bincount(at, np.where(h >> 31, 1.0, -1.0), n * dimensions).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dimensions, pa.int32()), pa.array(out))

    return run(T.tokens(text))


def judge(query: Column, history: Column) -> Column:
    return F.when(conversation.needs_rewrite(query, history), "yes").otherwise("no")


def rewrite(query: Column, history: Column) -> Column:
    return query


def extract(text: Column) -> Column:
    """struct(entities, relationships): capitalised names, each related to the one after it. Too short texts give none."""
    names = F.when(F.length(F.trim(text)) >= T.MIN_EXTRACT_CHARS, F.regexp_extract_all(text, F.lit(_NAMES), 2))
    entity = lambda n: F.struct(F.lower(n).alias("name"), F.lit("OTHER").alias("type"), n.alias("description"), F.array().cast("array<string>").alias("keywords"))
    pair = lambda a, b: F.struct(F.lower(a).alias("source"), F.lower(b).alias("target"), F.lit("RELATED_TO").alias("type"), F.concat_ws(" ", a, b).alias("description"), F.lit(5).alias("strength"))

    def found(n: Column) -> Column:
        # pairs are told apart as texts, by hashing; structs would each be compared with all before. Names have no line ends.
        both = F.zip_with(F.slice(n, F.lit(1), F.greatest(F.size(n) - 1, F.lit(0))), F.slice(n, F.lit(2), F.greatest(F.size(n) - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("\n"), b))
        pairs = F.transform(F.array_distinct(both), lambda p: pair(F.substring_index(p, "\n", 1), F.substring_index(p, "\n", -1)))
        return F.struct(F.transform(F.array_distinct(n), entity).alias("entities"), pairs.alias("relationships"))

    return T.let(F.coalesce(names, F.array().cast("array<string>")), found)


def _lines(found: Column, head: Column) -> Column:
    def lines(f: Column) -> Column:
        entities = F.transform(f["entities"], lambda e: F.concat(head, F.concat_ws(FIELD, F.lit("entity"), e["name"], e["type"], e["description"])))
        rels = F.transform(f["relationships"], lambda r: F.concat(head, F.concat_ws(FIELD, F.lit("relation"), r["source"], r["target"], r["type"], r["description"])))
        return F.array_join(F.concat(entities, rels), "\n")

    return T.let(found, lines)


def extract_delimited(text: Column) -> Column:
    """What `extract` finds, in the delimited form that a model would write, with the end mark."""
    return F.concat_ws("\n", _lines(extract(text), F.lit("")), F.lit(END))


def extract_batch(docs: Column) -> Column:
    """One answer for several documents (array of doc_id and text), its lines marked by document; null: the call failed."""
    each = F.transform(docs, lambda d: _lines(extract(d["text"]), F.concat(F.lit("doc_id:"), d["doc_id"].cast("string"), F.lit(FIELD))))
    return F.concat_ws("\n", F.array_join(each, "\n"), F.lit(END))


def glean(text: Column, names: Column) -> Column:
    """A second look: the offline rule finds words in capitals that the first look left out. Gives array of entities."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(r"(^|[^\p{L}\p{N}_])(\p{Lu}{2,})(?![\p{L}\p{N}_])"), 2))
    new = T.let(names, lambda known: F.filter(found, lambda n: ~F.array_contains(known, F.lower(n))))
    return F.transform(new, lambda n: F.struct(F.lower(n).alias("name"), F.lit("OTHER").alias("type"), n.alias("description"), F.array().cast("array<string>").alias("keywords")))


def answer(query: Column, docs: Column) -> Column:
    """The first sentence of the first document, cited. docs: array of texts."""
    return F.concat(F.regexp_extract(F.get(docs, F.lit(0)), r"^([^.\n]*)", 1), F.lit(". [1]"))


PROVIDERS: dict[str, Callable[..., Column]] = {
    "embed": embed, "judge": judge, "rewrite": rewrite, "extract": extract, "extract_delimited": extract_delimited,
    "extract_batch": extract_batch, "glean": glean, "query_entities": extract, "answer": answer,
}


def register(name: str, provider: Callable[..., Column]) -> None:
    PROVIDERS[name] = provider


@contextlib.contextmanager
def using(**providers: Callable[..., Column]) -> Iterator[None]:
    """Other providers for the plans that are made meanwhile."""
    before = dict(PROVIDERS)
    PROVIDERS.update(providers)
    try:
        yield
    finally:
        PROVIDERS.clear()
        PROVIDERS.update(before)


def retried(call: Callable[[], A], attempts: int = 3, delay: float = 1.0, fallback: Any = None, sleep: Callable[[float], None] = time.sleep) -> A | Any:
    """What call returns, tried again after delays that double; the fallback after the last failure. For use in providers."""
    for i in range(attempts):
        try:
            return call()
        except Exception:  # noqa: BLE001
            if i + 1 < attempts:
                sleep(delay * 2**i)
    return fallback
