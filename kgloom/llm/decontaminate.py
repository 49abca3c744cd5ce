"""Benchmark decontamination.

A document is contaminated by a benchmark item if some window of the item's number of words resembles it: exact weighted
Jaccard similarity (counts as weights) of five-word shingles of at least 0.8.

Windows of an item's size get a SimHash fingerprint of 256 bits. Items of one size are indexed by the 32 blocks of eight
bits of their fingerprints. A window is looked up in every block under its own value and the eight one bit away, which
finds every item whose fingerprint is within RADIUS (63) bits: were all blocks two or more bits off, the distance would be
at least 64. At similarity 0.8 the expected distance is 39 bits with a deviation of 6. What the blocks propose and what is
within the radius is verified by the exact similarity. The index alone says which item a window is compared to.

A window of M shingles of which fewer than t (L + M) / (1 + t) occur anywhere in the benchmark has a similarity below t to
every item of L shingles, so only windows with as many are fingerprinted; this drops nothing. M is L but for windows at
the end of a text, which may be shorter than the item. Prefix sums of bit counts give all windows of a stretch at once.
Documents are independent of each other: there is no shuffle, and no group that could be hot.

The index is broadcast. Its size is bounded: items are dealt to blocks of about BLOCK_BYTES of text, of which the driver
holds one at a time; more items mean more passes over the documents, not a larger broadcast.

Defined results: items and documents that are null or have fewer than five words make no five-word shingle and match
nothing. Items without id are left out; items equal in id and text are one. A document without id keeps its null id, and
rows repeated are found once each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import row_key, short_batches, stored, words

WORDS, SIMILARITY, RADIUS = 5, 0.8, 63
BLOCK_BYTES = 8 << 20
#: Windows fingerprinted at once, and pairs of a window and an item held at once.
STRETCH, PAIRS = 4096, 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, len(ws))


def shingle_hashes(h: np.ndarray, n: int = WORDS) -> np.ndarray:
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = (out ^ (out >> np.uint64(29))) * _ODD + h[i : len(h) - n + 1 + i]
    return out ^ (out >> np.uint64(32))


def bit_signs(sh: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 256 bits of each shingle."""
    x = sh[:, None] + _SEEDS[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return np.unpackbits(x.view(np.uint8), axis=1).astype(np.int32) * 2 - 1


class Sized:
    """The items of one size, by the blocks of their fingerprints."""

    #: Every block with every value that is looked up in it: its own, and with one bit flipped.
    BLOCK, FLIP = np.repeat(np.arange(32), 9), np.tile(np.array([0, *(1 << i for i in range(8))], np.uint8), 32)
    LOOKUPS = 32 * 9

    def __init__(self, places: list[int], prints: np.ndarray):
        self.places, self.prints = np.array(places), prints
        self.order = np.argsort(prints, axis=0, kind="stable")
        self.starts = np.array([np.searchsorted(np.sort(prints[:, b]), np.arange(257)) for b in range(32)])

    def proposed(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a fingerprint (32 octets) and an item that share a block up to one bit, each pair once."""
        found, n, most = [], len(self.places), max(1, PAIRS // max(len(self.places), self.LOOKUPS))
        for base in range(0, len(prints), most):
            value = prints[base : base + most, self.BLOCK] ^ self.FLIP  # all lookups of all fingerprints at once
            low = self.starts[self.BLOCK, value]
            many = (self.starts[self.BLOCK, value.astype(np.int64) + 1] - low).ravel()
            at = np.flatnonzero(many)
            many = many[at]
            flat = np.repeat(low.ravel()[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
            block, window = self.BLOCK[at % self.LOOKUPS], base + at // self.LOOKUPS
            found.append(np.unique(np.repeat(window, many) * n + self.order[flat, np.repeat(block, many)]))
        pairs = np.concatenate(found)
        return pairs // n, pairs % n


class Index:
    """Items: their shingles, their fingerprints and, for each size, the tables of blocks."""

    def __init__(self, items: list[tuple[int, str]], n: int = WORDS):
        self.n, self.ids, self.sizes, self.bags = n, [], [], []
        by_size: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item, text in items:
            ws = words(text)
            if len(ws) < n:
                continue
            sh = shingle_hashes(word_hashes(ws), n)
            by_size.setdefault(len(sh), []).append((len(self.ids), np.packbits(bit_signs(sh).sum(axis=0) > 0)))
            self.ids.append(item)
            self.sizes.append(len(ws))
            self.bags.append(np.unique(sh, return_counts=True))
        self.empty = not self.ids
        if self.empty:
            return
        self.by_size = {length: Sized([i for i, _ in of], np.array([p for _, p in of])) for length, of in sorted(by_size.items())}
        self.shingles = np.unique(np.concatenate([values for values, _ in self.bags]))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.shingles >> np.uint64(44)).astype(np.int64)] = True
        self.compared = 0  # pairs that the blocks proposed

    def known(self, sh: np.ndarray) -> np.ndarray:
        """Positions of shingles that some item has."""
        at = np.flatnonzero(self.maybe[(sh >> np.uint64(44)).astype(np.int64)])
        place = np.minimum(np.searchsorted(self.shingles, sh[at]), len(self.shingles) - 1)
        return at[self.shingles[place] == sh[at]]

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item's."""
        values, counts = self.bags[item]
        own, many = np.unique(window, return_counts=True)
        place = np.minimum(np.searchsorted(values, own), len(values) - 1)
        hit = values[place] == own
        common = int(np.minimum(many[hit], counts[place[hit]]).sum())
        return common / max(1, len(window) + int(counts.sum()) - common)

    def matches(self, text: str | None, threshold: float = SIMILARITY) -> list[tuple[int, float, int, int]]:
        """(place of the item, similarity, first word, end word) of the best window of each item found."""
        ws = words(text)
        if self.empty or len(ws) < self.n:
            return []
        sh = shingle_hashes(word_hashes(ws), self.n)
        at = self.known(sh)
        best: dict[int, tuple[float, int]] = {}
        for length, sized in self.by_size.items() if len(at) else ():
            for first, last in self._stretches(at, length):
                starts = np.arange(first, last + 1)
                inside = np.searchsorted(at, starts + length) - np.searchsorted(at, starts)
                need = (length + np.minimum(length, len(sh) - starts)) * threshold / (1 + threshold)
                starts = starts[inside >= need - 1e-9]
                if len(starts):
                    self._compare(sh, starts, length, sized, threshold, best)
        return [(i, score, s, min(len(ws), s + self.sizes[i])) for i, (score, s) in sorted(best.items())]

    @staticmethod
    def _stretches(at: np.ndarray, length: int) -> Iterator[tuple[int, int]]:
        """First and last start of windows that hold a known shingle, as stretches of bounded length."""
        for part in np.split(at, np.flatnonzero(np.diff(at) > length) + 1):
            first, last = max(0, int(part[0]) - length + 1), int(part[-1])
            for a in range(first, last + 1, STRETCH):
                yield a, min(last, a + STRETCH - 1)

    def _compare(self, sh: np.ndarray, starts: np.ndarray, length: int, sized: Sized, threshold: float, best: dict[int, tuple[float, int]]) -> None:
        """Looks up the windows that start at `starts`, which lie within one stretch, and keeps the best of each item."""
        base = int(starts[0])
        part = sh[base : int(starts[-1]) + length]
        signs = np.vstack([np.zeros((1, 256), np.int32), np.cumsum(bit_signs(part), axis=0, dtype=np.int32)])
        prints = np.packbits(signs[np.minimum(starts - base + length, len(part))] - signs[starts - base] > 0, axis=1)
        window, item = sized.proposed(prints)
        self.compared += len(window)
        near = np.bitwise_count(prints[window] ^ sized.prints[item]).sum(axis=1) <= RADIUS
        for s, i in zip(starts[window[near]].tolist(), sized.places[item[near]].tolist()):
            score = self.similarity(sh[s : s + length], i)
            if score >= threshold and (i not in best or (score, -s) > (best[i][0], -best[i][1])):
                best[i] = (score, s)


MATCH = ArrayType(StructType([StructField("item_id", LongType()), StructField("similarity", DoubleType()), StructField("first_word", LongType()), StructField("end_word", LongType())]))


def _run(batches: Iterator[pa.RecordBatch], items: list, text: str, n: int, threshold: float) -> Iterator[pa.RecordBatch]:
    index = Index(items, n)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))
    for batch in batches:
        rows = [[{"item_id": index.ids[i], "similarity": s, "first_word": a, "end_word": b} for i, s, a, b in index.matches(t, threshold)] for t in batch.column(text).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, kind)], [*batch.schema.names, "leaks"])


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of bounded size, of which the driver holds one at a time; at least one block, be it empty."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text") + F.lit(64))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    own = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    dealt = stored(rows.withColumn("block", own), "benchmark-items") if blocks > 1 else rows.withColumn("block", F.lit(0))
    for k in range(blocks):
        yield [(r["item_id"], r["text"]) for r in dealt.where(F.col("block") == k).orderBy("item_id", "text").collect()]


def _marked(docs: DataFrame, block: list, text: str, n: int, threshold: float) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(block)
    return docs.mapInArrow(lambda b: _run(b, sent.value, text, n, threshold), StructType([*docs.schema.fields, StructField("leaks", MATCH)]))


def leaks(docs: DataFrame, items: DataFrame, text: str = "text", n: int = WORDS, threshold: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with leaks, an array of the items found in each text; a column of that name is replaced.

    With one block of items the documents are read once. With more, each pass stores what it found by the key of the
    text, and only those rows are joined.
    """
    short_batches(docs.sparkSession)
    docs = docs.drop("leaks")
    blocks = item_blocks(items, block_bytes)
    first, found = next(blocks), None
    for block in blocks:
        if found is None:
            found = _found(docs.select(text), first, text, n, threshold)
        found = found.unionByName(_found(docs.select(text), block, text, n, threshold))
    if found is None:
        return _marked(docs, first, text, n, threshold)
    per_text = found.groupBy("__k1", "__k2").agg(F.sort_array(F.flatten(F.collect_set("leaks"))).alias("leaks"))
    keys = row_key(text)
    joined = docs.withColumns({"__k1": keys[0], "__k2": keys[1]}).join(per_text.hint("shuffle_hash"), ["__k1", "__k2"], "left").drop("__k1", "__k2")
    return joined.withColumn("leaks", F.coalesce("leaks", F.array().cast(MATCH)))


def _found(narrow: DataFrame, block: list, text: str, n: int, threshold: float) -> DataFrame:
    """Key of the text and leaks of the texts in which an item of the block is found; a text that repeats is one row."""
    keys = row_key(text)
    hits = _marked(narrow, block, text, n, threshold).where(F.size("leaks") > 0)
    return stored(hits.select(keys[0].alias("__k1"), keys[1].alias("__k2"), "leaks").distinct(), "leaks")


def contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """doc_id, item_id, similarity, first_word and end_word of every item found in a document."""
    return leaks(docs.select("doc_id", "text"), items, **how).select("doc_id", F.inline("leaks"))


def decontaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """docs without those in which an item is found."""
    return leaks(docs, items, **how).where(F.size("leaks") == 0).drop("leaks")
