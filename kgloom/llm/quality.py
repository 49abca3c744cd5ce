"""Quality classifier by compression.

Two zstandard dictionaries hold text labelled good and text labelled bad. A text is compressed with either, in pieces of
PIECE bytes, so that what helps is the dictionary and not the text before; the difference of the two sizes, over the
larger of them, says which it resembles. A logistic curve fitted on training rows that are in neither dictionary turns the
difference into a probability.

The model is fitted on at most FIT_ROWS labelled rows of each label (those with the least hash of their id), a bound that
doesn't depend on the corpus. Half of them fill the dictionaries: each gives its whole text or, if that is longer than its
equal share of DICT_BYTES, SPREAD stretches evenly spread from its first character to its last. Only these stretches reach
the driver. The other half are compressed whole, by the executors, and give one number each to the curve. Everything else
runs over all rows and whole texts.

Defined results: null and empty texts get the score of a difference of zero. Rows whose label is null aren't learnt from.
Of several texts with one id, that with the least hash is learnt from; an id with both labels is learnt from for both. If a
label has fewer than four such rows, every score is the share of label 1 (0.5 without any labelled row).
"""

from __future__ import annotations

import dataclasses
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from .common import short_batches, stored

#: Labelled rows of each label that are fitted on; bytes of a dictionary; stretches of a text that is longer than its share.
FIT_ROWS, DICT_BYTES, SPREAD = 1500, 512 << 10, 4
FOLDS, THRESHOLD, LEVEL, PIECE = 5, 0.3, 3, 96
#: Bytes that zstandard spends on any frame.
FRAME = 2


@dataclasses.dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    shift: float

    def scorer(self):
        if not self.good:
            return lambda text: _sigmoid(self.shift)
        made = _compressors(self.good, self.bad)
        return lambda text: _sigmoid(self.slope * difference(text, *made) + self.shift)


def _compressors(good: bytes, bad: bytes) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in (good, bad):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def _sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def difference(text: str | None, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """Above 0 if the good dictionary helps more; between -1 and 1."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return 0.0
    pieces = [raw[i : i + PIECE] for i in range(0, len(raw), PIECE)]
    a, b = (sum(map(len, map(z.compress, pieces))) - FRAME * len(pieces) for z in (good, bad))
    return (b - a) / max(a, b, 1)


def content(text: Column, chars: int) -> Column:
    """The text, or SPREAD stretches of it, the first and the last at its ends, that have so many characters together."""
    each = max(1, chars // SPREAD)
    last = F.char_length(text) - each
    stretches = F.transform(F.sequence(F.lit(0), F.lit(SPREAD - 1)), lambda i: F.substring(text, F.floor(last * i / (SPREAD - 1)).cast("int") + 1, F.lit(each)))
    return F.when(F.char_length(text) <= chars, text).otherwise(F.array_join(stretches, "\n"))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift by Newton steps with a small ridge."""
    a, w = np.column_stack([x, np.ones(len(x))]), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + 1e-3 * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fold(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """text, quality and half (0: dictionary, 1: curve) of the rows that are fitted on; none of fold 0."""
    told = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)).select("doc_id", "quality").distinct()
    place = F.row_number().over(Window.partitionBy("quality").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = told.withColumn("place", place).where(F.col("place") <= rows).select("doc_id", "quality", (F.col("place") % 2).alias("half"))
    found = docs.select("doc_id", "text").where("text <> ''").join(F.broadcast(chosen), "doc_id")  # at most two times rows
    one = F.row_number().over(Window.partitionBy("doc_id", "quality").orderBy(F.xxhash64("text"), "text"))
    return found.withColumn("one", one).where("one = 1").select("doc_id", "text", "quality", "half")


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learns from labelled rows whose fold is not 0."""
    short_batches(docs.sparkSession)
    told = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id")) != 0)).select("doc_id", "quality").distinct()
    of = {r["quality"]: r["n"] for r in told.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = of.get(1, 0) / sum(of.values()) if of else 0.5
    chosen = stored(sample(docs, labels, rows), "quality-sample")
    halves = {(r["quality"], r["half"]): r["n"] for r in chosen.groupBy("quality", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(halves) < 4:
        share = min(1 - 1e-6, max(1e-6, share))
        return Model(b"", b"", 0.0, math.log(share / (1 - share)))
    made = {}
    for y in (0, 1):
        part = chosen.where((F.col("half") == 0) & (F.col("quality") == y)).orderBy(F.xxhash64("doc_id"), "doc_id")
        texts = part.select(content(F.col("text"), max(64, DICT_BYTES // halves[y, 0])).alias("text")).collect()
        made[y] = b"\n".join(r["text"].encode("utf-8", "replace") for r in texts)[-DICT_BYTES:]
    sent = docs.sparkSession.sparkContext.broadcast((made[1], made[0]))
    rest = chosen.where("half = 1").select("text", "quality").mapInArrow(lambda b: _differences(b, sent.value), "quality int, x double").collect()
    rest.sort()
    x, y = np.array([r["x"] for r in rest]), np.array([float(r["quality"]) for r in rest])
    slope, shift = logistic(x, y)
    shift += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))  # the sample's shares are not the corpus's
    return Model(made[1], made[0], slope, shift)


def _differences(batches: Iterator[pa.RecordBatch], dictionaries: tuple[bytes, bytes]) -> Iterator[pa.RecordBatch]:
    made = _compressors(*dictionaries)
    for batch in batches:
        x = [difference(t, *made) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("quality").cast(pa.int32()), pa.array(x, pa.float64())], ["quality", "x"])


def _score(batches: Iterator[pa.RecordBatch], model: Model, text: str) -> Iterator[pa.RecordBatch]:
    score = model.scorer()
    for batch in batches:
        out = pa.array([score(t) for t in batch.column(text).to_pylist()], pa.float64())
        yield pa.RecordBatch.from_arrays([*batch.columns, out], [*batch.schema.names, "score"])


def score_documents(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score, the probability of label 1; a column of that name is replaced."""
    short_batches(docs.sparkSession)
    docs = docs.drop("score")
    sent = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of DICT_BYTES
    return docs.mapInArrow(lambda b: _score(b, sent.value, text), StructType([*docs.schema.fields, StructField("score", DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, corpus: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score and predicted (1: good). corpus has the texts of labelled rows; docs, unless given."""
    scored = score_documents(docs, train(docs if corpus is None else corpus, labels))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
