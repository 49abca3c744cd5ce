"""Collocations: frequent phrases whose words occur together far more often than their parts do apart.

First all words are counted. The most frequent ones of min_count or more, WORDS at most over all languages, get a number,
and the list of them is broadcast. A phrase of up to max_n numbered words is one number of 63 bits, so that what is sent of
a phrase is a few bytes: each task counts the numbers of all phrases in about FLUSH words, sorts them and sends one row of
packed differences for each of the parts that the numbers are dealt into. A part is added up by one call, which gives back
the phrases of min_count or more. At most max_n - 1 numbers are sent for each word, whatever occurs how often; a phrase that
is everywhere is sent once for each FLUSH words. A word below min_count is in no phrase that counts.

Frequent words beyond the numbered ones are few, and rare, but nothing may be lost: if there are any, the phrases that hold
one are counted by suffix-sigma. From each word of a piece of text its suffix starts, cut after max_n words or before a word
below min_count (told by a set of bits that is broadcast; what it lets through by chance only costs, and is counted
exactly). Suffixes are dealt by language and first word and sorted in reverse order, so that every phrase is a prefix of a
run of neighbours, and one pass with a stack of max_n counters counts all phrases: a counter is closed, and handed to the
one below it, when its word changes. Equal suffixes are counted in each task before they are shuffled. First words with 1 /
HEAVY of all words or more, which are no more than HEAVY, are dealt by whole suffix: what their tasks count for phrases
below max_n is summed up at the end, as is everything that passes the stacks. Of the other counters only those of min_count
or more leave the task. A suffix carries a blank after each word, which no word has: without it "a b" and "a" might not be
neighbours.

Counts of the two parts of each cut are joined afterwards. Joins have one row for each key on the side of the parts, so
Spark can split a hot part.

Defined results: a null text is empty, a null language is `und`; rows that repeat an id or are equal all count. Only the two
columns named are read, so other columns don't matter. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, bit_set, has_bits, short_batches, stored

MAX_N, MIN_COUNT, TOP = 3, 10, 2000
#: Words that get a number; with max_n above 3 fewer, so that a phrase has 63 bits. They are broadcast.
WORDS = 1 << 19
#: Words whose phrases a task counts together before it sends them on.
FLUSH = 1 << 20
#: Numbers of phrases are dealt into 2 ** PARTS parts: fewer in a small corpus, and more beyond 2 ** (PARTS + 21) words.
PARTS = 10
#: A first word with 1 / HEAVY of all words or more is dealt by whole suffix.
HEAVY = 4096
#: Different words or suffixes that a task counts together before it sends them on, and words whose hashes it keeps.
SUFFIXES, HELD = 400_000, 200_000
#: Buckets of pairs, of words and of each longer length, as powers of two. Only words are told apart here.
BITS = (27, 23, 27)
#: Groups that the best phrases of a language are chosen in first.
GROUPS = 64
#: A-Z become a-z, the ends of a piece a line feed, a tab a blank.
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\x0b\x0c\x0d\t", b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n\n\n\n ")
_END = b"\n"


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a text; a line feed of its own stands where a piece ends."""
    return list(filter(None, (text or b"").translate(_FOLD).replace(b"\n", b" \n ").split(b" ")))


class _Hashes(dict):
    """Hashes of the words of a language; the end of a piece has 0."""

    def __init__(self, lang: str):
        self.seed = xxhash.xxh3_64_intdigest(lang.encode())

    def __missing__(self, word: bytes) -> int:
        if len(self) >= HELD:
            self.clear()
        self[word] = h = 0 if word == _END else xxhash.xxh3_64_intdigest(word, self.seed) or 1
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _buckets(h: np.ndarray, k: int, bits: tuple[int, int, int]) -> np.ndarray:
    """Buckets of the k words from each on: those of pairs, of words and of each longer length have their own range."""
    first, size = {2: (0, bits[0]), 1: (1 << bits[0], bits[1])}.get(k, ((1 << bits[0]) + (1 << bits[1]) + ((k - 3) << bits[2]), bits[2]))
    n = max(0, len(h) - k + 1)
    x = np.zeros(n, np.uint64)
    for j in range(k):
        x = x * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(64 - size)).astype(np.int64) + first


class _Sketch:
    """Which buckets can hold a phrase of min_count or more, for phrases of up to `levels` words, and the buckets of hot words."""

    def __init__(self, marks: np.ndarray, heavy: frozenset[int], bits: tuple[int, int, int], levels: int):
        self.marks, self.heavy, self.bits, self.levels = marks, heavy, bits, levels

    def often(self, h: np.ndarray, most: int) -> list[np.ndarray]:
        """For k of 1 to `most`: from which words on the k words may be frequent. Words of 0, the ends of pieces, never are."""
        found = [(h > 0) & has_bits(self.marks, _buckets(h, 1, self.bits))]
        for k in range(2, most + 1):
            both = found[-1][:-1] & found[-1][1:]
            found.append(both & has_bits(self.marks, _buckets(h, k, self.bits)) if k <= self.levels else both)
        return found


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over (lang, text): words with their counts; the empty one counts all words."""
    schema = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])
    held: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counter in held.items():
            counter[b""] = counter.total() - counter.pop(_END, 0)
            columns = ([lang] * len(counter), list(counter), list(counter.values()))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            held.setdefault(lang, Counter()).update(tokens(text))
        if sum(map(len, held.values())) >= SUFFIXES:
            yield from out()
    yield from out()


def _word_buckets(bits: tuple[int, int, int]) -> Callable:
    """For mapInArrow over (lang, word, f): bucket, n."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, _Hashes] = {}
        for batch in batches:
            rows = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            h = np.array([known.setdefault(lang, _Hashes(lang))[word] for lang, word in rows], np.uint64)
            yield pa.record_batch([pa.array(_buckets(h, 1, bits)), batch.column(2)], names=["bucket", "n"])

    return run


class _Words:
    """The numbered words, from 1 on, of all languages: a phrase of up to max_n of them is one number.

    Numbers of phrases are stirred by an odd factor, so that equal ranges of them hold about equally many.
    """

    FACTOR = 0x9E3779B97F4A7C15

    def __init__(self, lang: pa.Array, word: pa.Array, max_n: int):
        self.lang, self.word, self.max_n = lang, word, max_n
        self.bits = max(1, len(word).bit_length())
        self.width = self.bits * max_n

    @cached_property
    def numbers(self) -> dict[str, dict[bytes, int]]:
        out: dict[str, dict[bytes, int]] = {lang: {} for lang in self.lang.unique().to_pylist()}
        for i, (lang, word) in enumerate(zip(self.lang.to_pylist(), self.word.to_pylist(), strict=True), 1):
            out[lang][word] = i
        return out

    def of(self, lang: str, words: list[bytes]) -> np.ndarray:
        """Numbers of words; 0 for another word and the end of a piece."""
        return np.fromiter(map(self.numbers.get(lang, {}).get, words, repeat(0)), np.uint64, len(words))

    def phrases(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Stirred numbers of all phrases of 2 words or more in a row of words, in order, and how often each occurs."""
        found, whole = [], h > 0
        key = h << np.uint64(self.bits * (self.max_n - 1))
        for k in range(2, self.max_n + 1):
            last = h[k - 1 :]
            key, whole = key[: len(last)] | (last << np.uint64(self.bits * (self.max_n - k))), whole[: len(last)] & (last > 0)
            found.append(key[whole])
        return np.unique(np.concatenate(found) * np.uint64(self.FACTOR) & np.uint64((1 << self.width) - 1), return_counts=True)

    def named(self, stirred: np.ndarray) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """Language, phrase and length for each number."""
        key = stirred * np.uint64(pow(self.FACTOR, -1, 1 << self.width)) & np.uint64((1 << self.width) - 1)
        ids = [(key >> np.uint64(self.bits * (self.max_n - k)) & np.uint64((1 << self.bits) - 1)).astype(np.int64) for k in range(1, self.max_n + 1)]
        words = [self.word.take(pa.array(i - 1, mask=i == 0)) for i in ids]
        phrase = pc.binary_join_element_wise(*words, pa.scalar(b" ", self.word.type), null_handling="skip")
        return self.lang.take(pa.array(ids[0] - 1)), phrase, sum((i > 0).astype(np.int32) for i in ids)


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second ones and so on: those that are mostly 0 compress to nothing."""
    return x.view(np.uint8).reshape(len(x), -1).T.tobytes()


def _from_planes(planes: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed(words: Callable[[], _Words], parts: int) -> Callable:
    """For mapInArrow over (lang, text): of the phrases of FLUSH words a row for each of the 2 ** parts parts, with packed numbers and counts."""
    schema = pa.schema([("part", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held, size, end = words(), [], 0, np.zeros(1, np.uint64)

        def out() -> pa.RecordBatch:
            keys, n = known.phrases(np.concatenate(held))
            held.clear()
            part = (keys >> np.uint64(known.width - parts)).astype(np.int32)
            starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]][: len(part)])
            rows = [slice(*at) for at in zip(starts, np.r_[starts[1:], len(part)], strict=False)]
            packed = [_planes(np.diff(keys[at], prepend=np.uint64(0)).astype("<u8")) for at in rows]
            counts = [_planes(n[at].astype("<u4")) for at in rows]
            return pa.record_batch([pa.array(c, f.type) for c, f in zip((part[starts], packed, counts), schema, strict=True)], schema=schema)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h = known.of(lang, tokens(text))
                held += [h, end]
                size += len(h)
                if size >= FLUSH:
                    yield out()
                    size = 0
        if held:
            yield out()

    return run


def _added(words: Callable[[], _Words], min_count: int) -> Callable:
    """For applyInArrow over the packed rows of a part: its phrases of min_count or more."""

    def run(packed: pa.Table) -> pa.Table:
        keys = np.concatenate([np.cumsum(_from_planes(x, "<u8"), dtype=np.uint64) for x in packed["keys"].to_pylist()])
        n = np.concatenate([_from_planes(x, "<u4") for x in packed["counts"].to_pylist()])
        order = np.argsort(keys)
        keys = keys[order]
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        f = np.add.reduceat(n[order], starts, dtype=np.int64)
        some = f >= min_count
        lang, phrase, size = words().named(keys[starts[some]])
        return pa.table([lang.cast(pa.string()), phrase.cast(pa.binary()), pa.array(size, pa.int32()), pa.array(f[some])], names=["lang", "phrase", "words", "f"])

    return run


def _suffix_counts(max_n: int, sketch: Callable[[], _Sketch], numbered: Callable[[], _Words] | None = None) -> Callable:
    """For mapInArrow over (lang, text): suffixes with their counts; the empty one counts all words.

    With numbered words only suffixes of 2 words or more that hold another word.
    """
    schema = pa.schema([("lang", pa.string()), ("suffix", pa.binary()), ("n", pa.int64()), ("salt", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked, numbers = sketch(), numbered() if numbered else None
        known: dict[str, _Hashes] = {}
        held: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, counter in held.items():
                suffixes = [k and k + b" " for k in counter]
                firsts = _buckets(known[lang].of([k.split(b" ", 1)[0] for k in counter]), 1, marked.bits).tolist()
                salts = [xxhash.xxh32_intdigest(s) % 2**30 if b in marked.heavy else -1 for s, b in zip(suffixes, firsts, strict=True)]
                columns = ([lang] * len(suffixes), suffixes, list(counter.values()), salts)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
            held.clear()

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if lang not in known:
                    known[lang] = _Hashes(lang)
                words = tokens(text)
                h = known[lang].of(words)
                counter = held.setdefault(lang, Counter())
                if numbers is None:
                    counter[b""] += int((h > 0).sum())
                size = np.zeros(len(h), np.int64)
                for k, some in enumerate(marked.often(h, max_n) if len(h) else (), 1):
                    size[: len(some)] += some
                if numbers is not None:
                    others = np.r_[0, np.cumsum(numbers.of(lang, words) == 0)]
                    at = np.arange(len(h))
                    size[(size == 1) | (others[at + size] == others[at])] = 0
                counter.update(compress(words, (size == 1).tolist()))
                for k in range(2, max_n + 1):
                    counter.update([b" ".join(words[i : i + k]) for i in np.flatnonzero(size == k).tolist()])
                if sum(map(len, held.values())) >= SUFFIXES:
                    yield from out()
        yield from out()

    return run


def _runs(b: pa.RecordBatch) -> list[pa.Array]:
    """The columns of sorted (lang, suffix, n, salt) with equal neighbours as one row, their counts added up."""
    lang, suffix, n, salt = b.columns
    if len(n) < 2:
        return b.columns
    other = pc.or_(pc.not_equal(lang[1:], lang[:-1]), pc.not_equal(suffix[1:], suffix[:-1]))
    starts = np.flatnonzero(np.r_[True, other.to_numpy(zero_copy_only=False)])
    at = pa.array(starts)
    return [lang.take(at), suffix.take(at), pa.array(np.add.reduceat(n.to_numpy(), starts)), salt.take(at)]


def _stack(max_n: int, min_count: int, numbered: Callable[[], _Words]) -> Callable:
    """For mapInArrow over (lang, suffix, n, salt) in reverse order: the counts of all prefixes of 2 words or more, but for those of numbered words only."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("words", pa.int32()), ("f", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[bytes] = []  # the suffix that is open, and the count of each of its prefixes so far
        counts: list[int] = []
        out: tuple[list, list, list, list] = ([], [], [], [])
        at, partial = None, False
        numbers = numbered().numbers

        def close(depth: int) -> None:
            while len(words) > depth:
                n, k = counts.pop(), len(words)
                if counts:
                    counts[-1] += n
                if k > 1 and (n >= min_count or (partial and k < max_n)) and not all(w in numbers.get(at, ()) for w in words):
                    for column, value in zip(out, (at, b" ".join(words), k, n), strict=True):
                        column.append(value)
                words.pop()

        def batch() -> pa.RecordBatch:
            made = pa.record_batch([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)
            for column in out:
                column.clear()
            return made

        for b in batches:
            for lang, suffix, n, salt in zip(*(c.to_pylist() for c in _runs(b)), strict=True):
                new = suffix.split(b" ")
                new.pop()
                common = 0
                if lang == at:
                    for x, y in zip(words, new, strict=False):
                        if x != y:
                            break
                        common += 1
                if common < len(words):
                    close(common)
                at, partial = lang, salt >= 0
                for w in new[common:]:
                    words.append(w)
                    counts.append(0)
                counts[-1] += n
            if out[0]:
                yield batch()
        close(0)
        if out[0]:
            yield batch()

    return run


def phrase_counts(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, text: str = "text", lang: str = "lang", bits: tuple[int, int, int] = BITS) -> tuple[DataFrame, DataFrame]:
    """f of all phrases of up to max_n words that occur min_count times or more (lang, phrase, words, f), and n of each lang."""
    spark = docs.sparkSession
    short_batches(spark)
    held = Scratch(spark)
    given = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("text"))
    words = given.mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    words = held.stored(words.where((F.col("f") >= min_count) | (F.length("word") == 0)), "words")
    total = words.where(F.length("word") == 0).agg(F.sum("f")).first()[0] or 0
    often = words.where((F.length("word") > 0) & (F.col("f") >= min_count))
    numbered, others = _numbered(often, max_n)
    sent = spark.sparkContext.broadcast(numbered)
    schema = "lang string, phrase binary, words int, f long"

    parts = min(numbered.width, max(min(PARTS, (total >> 12).bit_length()), (total >> 21).bit_length()))
    packed = given.mapInArrow(_packed(lambda: sent.value, parts), "part int, keys binary, counts binary")
    counted = packed.groupBy("part").applyInArrow(_added(lambda: sent.value, min_count), schema)
    if others:
        sketch = spark.sparkContext.broadcast(_sketched(often, total, bits))
        suffixes = given.mapInArrow(_suffix_counts(max_n, lambda: sketch.value, lambda: sent.value), "lang string, suffix binary, n long, salt int")
        dealt = suffixes.repartition("lang", F.substring_index(F.col("suffix").cast("string"), " ", 1), "salt").sortWithinPartitions(F.desc("lang"), F.desc("suffix"))
        found = dealt.mapInArrow(_stack(max_n, min_count, lambda: sent.value), schema)
        counted = counted.union(found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where(F.col("f") >= min_count).select(*counted.columns))
    counted = counted.union(words.select("lang", "word", F.when(F.length("word") > 0, 1).otherwise(0), "f"))
    counted = stored(counted.select("lang", F.col("phrase").cast("string").alias("phrase"), "words", "f"), "phrases")
    held.clear()
    return counted.where("words > 0"), counted.where("words = 0").select("lang", F.col("f").alias("n"))


def _numbered(often: DataFrame, max_n: int) -> tuple[_Words, bool]:
    """The most frequent words, as many as there are numbers for, and whether there are others."""
    least, room, most = None, min(WORDS, (1 << 63 // max_n) - 1), F.least(F.col("f"), F.lit(1 << 16))
    for f, n in sorted(map(tuple, often.groupBy(most.alias("f")).count().collect()), reverse=True):  # 65,536 rows at most
        room -= n
        if room < 0:
            break
        least = f
    some = often.where(most >= least if least is not None else F.lit(False)).select("lang", "word").toArrow().combine_chunks()
    return _Words(*(pa.concat_arrays([pa.array([], c.type), *c.chunks]) for c in some.columns), max_n), room < 0


def _sketched(often: DataFrame, total: int, bits: tuple[int, int, int]) -> _Sketch:
    """The bits of all buckets that hold a word of min_count or more, and the buckets of words with 1 / HEAVY of all words or more."""
    held, bits = Scratch(often.sparkSession), (3, bits[1], 3)
    rows = often.select("lang", "word", "f").mapInArrow(_word_buckets(bits), "bucket long, n long")
    buckets = held.stored(rows.groupBy("bucket").agg(F.sum("n").alias("n")), "buckets")
    hot = buckets.where(F.col("n") * HEAVY >= total).select("bucket").collect()  # HEAVY rows at most
    out = _Sketch(bit_set(buckets, (1 << bits[0]) + (1 << bits[1])), frozenset(r["bucket"] for r in hot), bits, 1)
    held.clear()
    return out


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a^2 / (l r)), by decimals of 38 digits: exact for counts below 10^15."""
    a, left, right = (c.cast("decimal(16,0)") for c in (a, left, right))
    return F.call_function("div", a * a * F.lit(1_000_000).cast("decimal(7,0)"), left * right)


def collocations(docs: DataFrame, max_n: int = MAX_N, min_count: int = MIN_COUNT, top: int = TOP, held_by: int = 50, text: str = "text", lang: str = "lang", bits: tuple[int, int, int] = BITS) -> DataFrame:
    """Of each language the `top` phrases of 2 to max_n words by score: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count; of all cuts into a first part (l) and a rest (r) that with the least score counts, ties to the
    shortest first part. A phrase goes if a longer one that holds it occurs held_by percent as often or more. Ties go to
    the larger a, then to the phrase that is less by its UTF-8 bytes.
    """
    counted, totals = phrase_counts(docs, max_n, min_count, text, lang, bits)
    candidates = counted.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    some = lambda start, size: F.array_join(F.slice("w", start, size), " ")

    # what longer phrases hold
    inner = F.explode(F.sequence(F.lit(2), F.col("words") - 1))
    within = candidates.where("words > 2").select("lang", "w", "words", F.col("a").alias("longer"), inner.alias("size"))
    within = within.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    within = within.select("lang", some(F.col("start"), F.col("size")).alias("phrase"), "longer").groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    left = candidates.join(within, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * held_by))

    # cuts of what stays, with the counts of both parts
    cuts = left.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", some(F.lit(1), F.col("k")).alias("first"), some(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    firsts = counted.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rests = counted.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    cuts = cuts.join(firsts, ["lang", "first"]).join(rests, ["lang", "rest"])
    cuts = cuts.withColumn("score", _score(F.col("a"), F.col("l"), F.col("r")))
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))
    some_of = best.withColumn("place", F.row_number().over(Window.partitionBy("lang", group).orderBy(*order))).where(F.col("place") <= top)
    ranked = some_of.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = ranked.join(totals, "lang")
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", F.col("cut.score").cast("long").alias("score"))
