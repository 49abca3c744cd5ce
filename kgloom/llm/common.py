"""What the training-data operators share: table access, keys of rows and word splitting."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.shared import Scratch, scratch, shared_dir, steady, stored

__all__ = ["BLANKS", "Scratch", "bit_set", "has_bits", "row_key", "scratch", "shared_dir", "short_batches", "steady", "stored", "table", "words"]

#: White space of every contract here: [\x20\x09-\x0D]. bytes.split() splits at the same six bytes.
BLANKS = " \t\n\x0b\f\r"
#: Rows of one Arrow batch sent to Python, besides Spark's own limit on its bytes, and of one batch read from Parquet.
BATCH_ROWS = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def short_batches(spark: SparkSession) -> None:
    """Keep batches of whole texts short: a reader's batch of 4096 long texts would be hundreds of MB in each task."""
    steady(spark)
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def row_key(*columns: Column | str) -> list[Column]:
    """128 bits that stand for the given values: two XXH64 from different seeds. Rows equal in them are interchangeable."""
    return [F.xxhash64(F.lit(1), *columns).alias("k1"), F.xxhash64(F.lit(2), *columns).alias("k2")]


def words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of a text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def bit_set(buckets: DataFrame, size: int) -> np.ndarray:
    """The numbers in column bucket, all below size, as bits. What passes the driver is size / 8 bytes, in parts of 4096."""
    place = F.col("bucket") + 1
    parts = buckets.groupBy(F.bitmap_bucket_number(place).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(-(-size // 32768) * 4096, np.uint8)
    for row in parts.toLocalIterator():
        out[(row["part"] - 1) * 4096 :][:4096] = np.frombuffer(row["bits"], np.uint8)
    return out


def has_bits(bits: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    return (bits[buckets >> 3] >> (buckets & 7).astype(np.uint8) & 1).astype(bool)
