"""Extraction behind the cache: what is asked, how often, and what comes out."""

from pyspark.sql import functions as F

from kgloom.plans import extraction, indexing
from kgloom.plans.providers import extract, using
from kgloom.sources.points import PointStore
from kgloom.sources.store import ExtractionCache, GraphStore

LONG = "Alice met Bob in Paris. " * 30


def counted(spark):
    """A provider that counts its calls, once for each row that it is asked for."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        calls.add(1)
        return text

    return calls, lambda text: extract(seen(text))


def rows_of(df):
    return {r["chunk"]: r["result"] for r in df.collect()}


def test_each_key_is_computed_once(spark, tmp_path):
    rows = [(1, LONG + "one"), (2, LONG + "two"), (3, "Carol went to Rome"), (4, "Carol went to Rome"), (5, None), (6, "short"), (7, "Dave saw Eve")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    cache = ExtractionCache(spark, f"file://{tmp_path}/c", buckets=4)
    calls, provider = counted(spark)
    with using(extract=provider):
        first = rows_of(extraction.cached(docs.where("doc_id < 7"), cache))
        assert calls.value == 2  # two texts that begin alike, two that are equal, two that are too short
        again = rows_of(extraction.cached(docs, cache))
        assert calls.value == 3 and len(cache) == 3
    plain = rows_of(extraction.extracted(docs))
    assert again == plain | {2: plain[1]} and all(again[i] == first[i] for i in first)


def test_ways_and_templates_have_keys_of_their_own(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Alice met Bob in Paris")], "doc_id long, text string")
    cache = ExtractionCache(spark, f"file://{tmp_path}/c", buckets=4)
    for way in ("structured", "delimited", "gleaning"):
        assert rows_of(extraction.cached(docs, cache, way=way)) == rows_of(extraction.extracted(docs, way=way))
    extraction.cached(docs, cache, template="another prompt")
    assert len(cache) == 4
    assert extraction.cached(docs.limit(0), cache).count() == 0


def test_indexing_anew_asks_nothing(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Alice met Bob in Paris"), (2, "Bob met Carol in Rome")], "doc_id long, text string")
    cache = ExtractionCache(spark, f"file://{tmp_path}/c", buckets=4)
    calls, provider = counted(spark)
    with using(extract=provider):
        counts = [indexing.index(docs, PointStore(spark, f"file://{tmp_path}/p{i}", 2), GraphStore(spark, f"file://{tmp_path}/g{i}", 2), cache=cache) for i in (1, 2)]
    assert counts[0] == counts[1] and counts[0]["nodes"] == 5 and calls.value == 2
