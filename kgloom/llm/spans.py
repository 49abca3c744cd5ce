"""Substring dedup: passages of words that occur earlier in the corpus are removed from every document.

Suffix automata of reference shards. What a shard's automaton recognises are the passages sent to it; for each state it
keeps the earliest place at which the state's substrings end. Every passage is then streamed through the automaton:
matching statistics give, for each of its windows, whether the same words start earlier, and the words that such windows
cover go. Words are compared as words, never as hashes.

Which passages go where: a window of `length` words has as its anchor the least hash of the `shingle`-word shingles in it
(the leftmost, if several are equal). Equal windows have equal anchors, neighbouring windows mostly the same one, and an
anchor that only one place in the corpus has marks windows that occur nowhere else. So anchors are counted over the corpus,
by hash in a fixed number of buckets, and those with two places or more are a set of bits that is broadcast (34 MB,
whatever the corpus; what it lets through by chance only costs). The stretch of windows of such an anchor is a passage, of
2 length - shingle words at most, and its shard is the hash of the anchor. Sending every document past every automaton
instead would cost documents times shards.

Hot anchors (over HOT places: text around a passage that many documents share) are dealt by whole windows, so that no
shard holds all places of one. A passage that a task meets again is decided there: the task keeps the earliest place of
each passage and drops the others whole, and only that one travels. Shards hold about SHARD passages, whatever the size of
the corpus. A passage that is alone with its anchor has no window in common with another and needs no automaton. Documents
are joined once with what they lose.

Defined results: a null text has no words. Documents are ordered by id, null last, then by a hash of the text; rows that repeat
id and text are one document and share its fate, rows that repeat only the id are documents of their own. Kept words are
joined by one blank. Other columns stay. An empty table gives no rows; texts of less than `length` words keep all words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bit_set, has_bits, row_key, short_batches, stored

LENGTH, SHINGLE = 20, 8
#: Places from which on an anchor's windows are dealt one by one.
HOT = 500
#: Passages of a shard, in the mean.
SHARD = 2000
#: Passages that a task remembers, words whose hashes it keeps, rows that it sends, and words that it hashes at once.
HELD, BATCH, WORDS = 300_000, 5000, 20_000
#: Buckets in which anchors are counted, as a power of two, and buckets that are hot together.
BITS, HOT_GROUP = 28, 16
#: An id that is null comes after all others.
_LAST = (1 << 63) - 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _anchors(texts: list[list[bytes]], known: _Hashes, length: int, shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of the windows of some texts: hash, number of the text, first window, number of windows, in order."""
    sizes = np.array([len(w) for w in texts])
    ends = np.cumsum(sizes)
    h = np.fromiter(chain.from_iterable(map(known.__getitem__, w) for w in texts), np.uint64, ends[-1])
    m = len(h) - length + 1
    if m <= 0:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)
    n = len(h) - shingle + 1
    s = np.zeros(n, np.uint64)
    for i in range(shingle):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    s ^= s >> np.uint64(30)
    s *= _M1
    s ^= s >> np.uint64(27)
    s *= _M2
    s ^= s >> np.uint64(31)
    best, at = s[:m].copy(), np.arange(m)
    for i in range(1, length - shingle + 1):
        other = s[i : i + m]
        less = other < best
        np.copyto(best, other, where=less)
        at[less] = np.flatnonzero(less) + i
    text = np.repeat(np.arange(len(sizes)), sizes)[:m]
    own = np.flatnonzero(np.arange(m) + length <= ends[text])  # windows that end in the text in which they start
    at, text = at[own], text[own]
    starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])]) if len(own) else own
    return s[at[starts]], text[starts], own[starts] - (ends - sizes)[text[starts]], np.diff(np.r_[starts, len(own)])


def _some(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[list[list[bytes]], list[tuple]]]:
    """Words of texts, the last column, with the rest of their rows: as many rows as have so many words together."""
    texts, rest, size = [], [], 0
    for b in batches:
        for i, text in enumerate(b.column(b.num_columns - 1)):
            texts.append((text.as_py() or b"").split())
            rest.append(tuple(b.column(c)[i].as_py() for c in range(b.num_columns - 1)))
            size += len(texts[-1])
            if size >= words:
                yield texts, rest
                texts, rest, size = [], [], 0
    if texts:
        yield texts, rest


def _bucket(anchors: np.ndarray, bits: int) -> np.ndarray:
    """By bits that don't depend on size: anchors are least hashes, so their first bits are mostly 0."""
    return ((anchors * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _bucket_counts(length: int, shingle: int, bits: int) -> Callable:
    """For mapInArrow over texts: bucket, n, of anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = _Hashes(), []

        def out() -> pa.RecordBatch:
            bucket, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.record_batch([pa.array(bucket), pa.array(n)], names=["bucket", "n"])

        for texts, _ in _some(batches, WORDS):
            held.append(_bucket(_anchors(texts, known, length, shingle)[0], bits))
            if sum(map(len, held)) >= HELD:
                yield out()
        if held:
            yield out()

    return run


_PASSAGE = "route long, doc long, tie long, start int, windows int, words binary"
_PASSAGES = pa.schema([("route", pa.int64()), ("doc", pa.int64()), ("tie", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("words", pa.binary())])


def _joined(gone: list[tuple], length: int) -> list[tuple]:
    """Passages that go whole, those of a document that touch or overlap as one: a copy of a document is one row."""
    out: list[tuple] = []
    for route, doc, tie, start, windows, _ in sorted(gone, key=lambda r: r[1:5]):
        if out and out[-1][1:3] == (doc, tie) and start <= (end := out[-1][3] + out[-1][4] + length - 1):
            out[-1] = (route, doc, tie, out[-1][3], max(end, start + windows + length - 1) - out[-1][3] - length + 1, None)
        else:
            out.append((route, doc, tie, start, windows, None))
    return out


def _cut_out(length: int, shingle: int, bits: int, marks: Callable[[], tuple[np.ndarray, np.ndarray]], most: int) -> Callable:
    """For mapInArrow over (doc, tie, text): passages, without words if all of their windows start earlier.

    marks: buckets of anchors with two places or more, and groups of HOT_GROUP buckets of which one has over HOT. A task keeps
    the earliest place of each passage it has met, `most` at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        again, hot = marks()
        known = _Hashes()
        held: dict[bytes, tuple] = {}
        gone: list[tuple] = []

        def send(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            for low in range(0, len(rows), BATCH):
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[low : low + BATCH], strict=True), _PASSAGES, strict=True)], schema=_PASSAGES)

        for texts, rest in _some(batches, WORDS):
            anchors, text, first, n = _anchors(texts, known, length, shingle)
            buckets = _bucket(anchors, bits)
            at = np.flatnonzero(has_bits(again, buckets))
            by_window = has_bits(hot, buckets[at] // HOT_GROUP).tolist()
            for route, t, start, m, alone in zip(anchors[at].view(np.int64).tolist(), text[at].tolist(), first[at].tolist(), n[at].tolist(), by_window, strict=True):
                words, (doc, tie) = texts[t], rest[t]
                for s, k in [(s, 1) for s in range(start, start + m)] if alone else [(start, m)]:
                    key = b" ".join(words[s : s + k + length - 1])
                    if alone:
                        route = xxhash.xxh3_64_intdigest(key) - (1 << 63)
                    here = (doc, tie, s)
                    was = held.get(key)
                    if was is None:
                        held[key] = (route, k, here)
                    elif here > was[2]:
                        gone.append((0, *here, k, None))
                    elif here < was[2]:
                        gone.append((0, *was[2], k, None))
                        held[key] = (route, k, here)
            if len(gone) >= 20 * BATCH:
                yield from send(_joined(gone, length))
                gone.clear()
            if len(held) >= most:
                yield from send([(route, *here, k, key) for key, (route, k, here) in held.items()])
                held.clear()
        yield from send(_joined(gone, length))
        yield from send([(route, *here, k, key) for key, (route, k, here) in held.items()])

    return run


class Automaton:
    """A suffix automaton over several passages, with the earliest place at which the substrings of each state end."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.place: list[tuple | None] = [None]

    def _state(self, size: int, following: dict[bytes, int], link: int) -> int:
        self.next.append(following)
        self.size.append(size)
        self.link.append(link)
        self.place.append(None)
        return len(self.size) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A state for the substrings of q that end at p's longest one and word."""
        made = self._state(self.size[p] + 1, dict(self.next[q]), self.link[q])
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = made
            p = self.link[p]
        self.link[q] = made
        return made

    def add(self, words: list[bytes], doc: int, tie: int, start: int) -> None:
        last = 0
        for i, word in enumerate(words):
            q = self.next[last].get(word)
            if q is not None:  # the automaton has these words already
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
            else:
                made, p = self._state(self.size[last] + 1, {}, 0), last
                while p >= 0 and word not in self.next[p]:
                    self.next[p][word] = made
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][word]
                    self.link[made] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
                last = made
            here = (doc, tie, start + i)
            if self.place[last] is None or here < self.place[last]:
                self.place[last] = here

    def close(self) -> None:
        """Places pass from longer substrings to their suffixes, which end there too."""
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            up, here = self.link[v], self.place[v]
            if up > 0 and here is not None and (self.place[up] is None or here < self.place[up]):
                self.place[up] = here

    def earliest(self, words: list[bytes], length: int) -> Iterator[tuple | None]:
        """For each window of `length` words: the earliest place at which its words end, if the automaton knows them."""
        v, n = 0, 0
        for i, word in enumerate(words):
            while v and word not in self.next[v]:
                v = self.link[v]
                n = self.size[v]
            if word in self.next[v]:
                v, n = self.next[v][word], n + 1
            else:
                v, n = 0, 0
            if i < length - 1:
                continue
            if n < length:
                yield None
                continue
            while self.size[self.link[v]] >= length:  # what is longer than a window may occur later than the window
                v = self.link[v]
                n = self.size[v]
            yield self.place[v]


def _repeats(words: list[bytes], length: int) -> bool:
    """Whether two windows of a passage are equal."""
    n = len(words) - length + 1
    return any(words[i : i + length] == words[j : j + length] for i in range(n) for j in range(i + 1, n) if words[i] == words[j])


def _covered(flags: list[bool], length: int) -> list[tuple[int, int]]:
    """Stretches of words, as first and end, that the marked windows cover."""
    out: list[tuple[int, int]] = []
    for i, marked in enumerate(flags):
        if marked:
            if out and i <= out[-1][1]:
                out[-1] = (out[-1][0], i + length)
            else:
                out.append((i, i + length))
    return out


def _matched(length: int) -> Callable:
    """For mapInArrow over passages sorted by shard: the stretches of words to be removed, as (doc, tie, first, end)."""
    schema = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("first", pa.int32()), ("end", pa.int32())])

    def shard(rows: dict[bytes, tuple]) -> Iterator[tuple]:
        alike = Counter(route for route, _ in rows.values())
        some = [(key.split(b" "), here) for key, (route, here) in rows.items() if alike[route] > 1 or _repeats(key.split(b" "), length)]
        reference = Automaton()
        for words, here in some:
            reference.add(words, *here)
        reference.close()
        for words, (doc, tie, start) in some:
            earlier = [place is not None and place < (doc, tie, start + i + length - 1) for i, place in enumerate(reference.earliest(words, length))]
            for first, end in _covered(earlier, length):
                yield doc, tie, start + first, start + end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, {}, []
        for b in batches:
            for number, route, doc, tie, start, windows, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key is None:
                    out.append((doc, tie, start, start + windows + length - 1))
                    continue
                if number != at:
                    out += shard(rows)
                    at, rows = number, {}
                here, was = (doc, tie, start), rows.get(key, (route, None))[1]
                if was is None or here < was:
                    rows[key] = (route, here)
                if was is not None and here != was:  # the later of two equal passages goes whole
                    out.append((*max(here, was), max(here, was)[2] + windows + length - 1))
            if out:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        out += shard(rows)
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, shingle: int = SHINGLE, text: str = "text", doc_id: str = "doc_id", held: int = HELD, bits: int = BITS) -> DataFrame:
    """Stretches of words that start earlier in the corpus: doc, tie, and spans [(first, end)], which may overlap.

    doc is the id (null: the greatest long), tie the hash of the text by which rows of one id are told apart.
    """
    spark = docs.sparkSession
    short_batches(spark)
    if not 0 < shingle <= length:
        raise ValueError("a shingle is part of a window")
    given = docs.select(*_order(doc_id, text), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    counts = given.select("text").mapInArrow(_bucket_counts(length, shingle, bits), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where("n > 1")
    held_back = Scratch(spark)
    again = held_back.stored(counts, "repeated-anchors")
    hot = F.col("n") > HOT
    passages = again.agg(F.sum(F.when(hot, F.col("n") * (length - shingle + 1)).otherwise(F.col("n")))).first()[0] or 0
    size = 1 << bits
    sent = spark.sparkContext.broadcast((bit_set(again.select("bucket"), size), bit_set(again.where(hot).select(F.floor(F.col("bucket") / HOT_GROUP).alias("bucket")).distinct(), size // HOT_GROUP + 1)))
    held_back.clear()
    cut = given.mapInArrow(_cut_out(length, shingle, bits, lambda: sent.value, held), _PASSAGE)
    shards = max(1, passages // SHARD)
    number = F.when(F.col("words").isNull(), F.pmod(F.xxhash64("doc"), F.lit(shards))).otherwise(F.pmod(F.xxhash64("route"), F.lit(shards)))
    dealt = cut.select(number.alias("shard"), "route", "doc", "tie", "start", "windows", "words").repartition("shard").sortWithinPartitions("shard")
    removed = dealt.mapInArrow(_matched(length), "doc long, tie long, first int, end int")
    return removed.groupBy("doc", "tie").agg(F.collect_set(F.struct("first", "end")).alias("spans"))


def _order(doc_id: str, text: str) -> list[Column]:
    """By what documents are ordered; row_key's second hash doubles as the tie, as both stand for id and text."""
    return [F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"), row_key(doc_id, text)[1].alias("tie")]


def _rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (spans, text) and other columns: text without the words of the spans, and the counts."""
    for b in batches:
        texts, counts, removed = [], [], []
        for spans, text in zip(b.column("__spans").to_pylist(), b.column("__text").to_pylist(), strict=True):
            words = (text or b"").split()
            stay = np.ones(len(words), bool)
            for span in spans or ():
                stay[span["first"] : span["end"]] = False
            texts.append(b" ".join(words if stay.all() else [words[i] for i in np.flatnonzero(stay)]))
            counts.append(len(words))
            removed.append(len(words) - int(stay.sum()))
        new = {"__text": pa.array(texts, pa.binary()).cast(pa.string()), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(removed, pa.int64())}
        rest = [n for n in b.schema.names if n not in ("__spans", "__text", "n_words", "n_removed")]
        yield pa.record_batch([b.column(n) for n in rest] + list(new.values()), names=rest + list(new))


def without_repeats(docs: DataFrame, length: int = LENGTH, shingle: int = SHINGLE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with each text reduced to the words that no earlier passage of `length` words has, and n_words and n_removed."""
    spans = repeated_spans(docs, length, shingle, text, doc_id).toDF("__doc", "__tie", "__spans")
    doc, tie = _order(doc_id, text)
    names = [n for n in docs.columns if n not in (text, "n_words", "n_removed")]
    keyed = docs.select(*names, F.col(text).cast("binary").alias("__text"), doc.alias("__doc"), tie.alias("__tie"))
    marked = keyed.join(spans.hint("shuffle_hash"), ["__doc", "__tie"], "left").select(*names, "__spans", "__text")
    kinds = ", ".join(f"`{n}` {marked.schema[n].dataType.simpleString()}" for n in names)
    made = marked.mapInArrow(_rest, ", ".join(filter(None, [kinds, "__text string, n_words long, n_removed long"])))
    return made.withColumnRenamed("__text", text).select(*(n for n in docs.columns if n in (*names, text)), "n_words", "n_removed")
