"""A corpus pipeline: documents are filtered, cleaned, deduplicated, decontaminated and encoded, stage by stage.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; all but the last
return the columns of documents, and other columns that docs may have are left out. Rows are whatever docs has: a stage
keeps or drops rows and never makes any. What becomes of nulls, empty and repeated rows is told with each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm import bpe, decontaminate, line_dedup, quality, simhash
from kgloom.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: shingles of five words at a cosine similarity of 0.8, which SimHash shows by 52 of 256 bits (angle acos(0.8))
#: with a deviation of 6. The radius is five deviations beyond that and only saves exact tests.
SHINGLE, SIMILARITY, LANES, RADIUS = 5, 0.8, 4, 88


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    It is fitted on the labelled ones among docs. Null and empty texts get the score of no difference, which the curve
    decides on; rows with one text share their fate, whatever their id. Without labels every score is 0.5 and all stay.
    """
    return quality.classify(docs, table(spark, sf_dir, "labels")).where("predicted = 1").select(COLUMNS)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents go; documents stay, also those of which nothing is left.

    A null text becomes an empty one; n_chars is counted anew. Rows with one id are one document, a row without id is one
    of its own.
    """
    return line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id.

    Null and empty texts, and those of one to four words, are alike if they are equal: one row of each such text stays. Rows
    that repeat an id are judged by their texts; rows without id come last in their group.
    """
    return simhash.representatives(docs.select(COLUMNS), n=SHINGLE, similarity=SIMILARITY, radius=RADIUS, lanes=LANES)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Texts and items that are null or have fewer than five words match nothing; repeated rows share their fate.
    """
    return decontaminate.decontaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the digests of ids and of the decoded text, one row for each; a null text has none."""
    return bpe.encode_documents(docs.select(COLUMNS))


STAGES = [
    ("quality classifier", classify_quality),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_documents),
    ("benchmark decontamination", decontaminate_benchmark),
    ("byte-level bpe", encode),
]

#: The classifier, SimHash and BPE can't be put in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
