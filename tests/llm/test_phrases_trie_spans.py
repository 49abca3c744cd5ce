"""Collocations, the prefix trie and repeated spans against plain versions, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kgloom.llm import phrases, queries, spans, trie
from kgloom.llm.common import table


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# ---------------------------------------------------------------- 11


def brute_phrases(rows, max_n, min_count, top, held_by):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, max_n + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= min_count}
        held = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    held[p[i : i + k]] = max(held[p[i : i + k]], a)
        scored = []
        for p, a in candidates.items():
            if p in held and 100 * held[p] >= held_by * a:
                continue
            score, _, left, right = min((10**6 * a * a // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def random_texts(seed, rows, vocabulary, longest):
    rng = random.Random(seed)
    words = [rng.choice(["", "É", "x"]) + "".join(rng.choices("abC", k=rng.randint(1, 3))) for _ in range(vocabulary)]
    joint = [" ", " ", " ", " ", "\t", ", ", ".", "\n", "\r\n", "  ", ";", "\x0b"]
    return [(rng.choice(["en", "de", None]), "".join(rng.choice(words) + rng.choice(joint) for _ in range(rng.randint(0, longest)))) for _ in range(rows)]


@pytest.mark.parametrize(("max_n", "held_by"), [(2, 50), (3, 50), (4, 30)])
def test_phrases_against_plain_counts(spark, max_n, held_by):
    rows = random_texts(max_n, 150, 12, 80)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    got = rows_of(phrases.collocations(docs, max_n=max_n, min_count=3, top=40, held_by=held_by))
    want = brute_phrases(rows, max_n, 3, 40, held_by)
    assert got == want and any(r[1] == 40 for r in want)


def test_phrases_of_hot_words_are_summed_up(spark, monkeypatch):
    """One word begins most suffixes: those are dealt by whole suffix, and counted by several tasks."""
    rng = random.Random(5)
    rows = [("en", " ".join(rng.choice(["the", "the", "the", f"w{rng.randint(0, 30)}"]) for _ in range(60))) for _ in range(100)]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(6)
    assert rows_of(phrases.collocations(docs, min_count=5, top=100)) == brute_phrases(rows, 3, 5, 100, 50)
    monkeypatch.setattr(phrases, "HEAVY", 1)
    assert rows_of(phrases.collocations(docs, min_count=5, top=100)) == brute_phrases(rows, 3, 5, 100, 50)


def test_phrases_are_sent_on_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(phrases, "SUFFIXES", 7)
    size = sum(2**b for b in phrases.BITS) // 8
    every = phrases._Sketch(np.full(size, 255, np.uint8), frozenset(), phrases.BITS, 3)
    batch = pa.record_batch([pa.array(["en"] * 20), pa.array([b"a b c. d e f"] * 20)], names=["lang", "text"])
    sent = list(phrases._suffix_counts(3, lambda: every)([batch]))
    assert len(sent) == 20 and all(b.num_rows == 7 for b in sent)
    assert sum(sum(b.column(2).to_pylist()) for b in sent) == 240
    nothing = phrases._Sketch(np.zeros(size, np.uint8), frozenset(), phrases.BITS, 3)
    assert [b.to_pylist() for b in phrases._suffix_counts(3, lambda: nothing)([batch])] == [[{"lang": "en", "suffix": b"", "n": 120, "salt": -1}]]


def test_phrases_in_crowded_buckets(spark):
    """Buckets that many words share let rare ones through, which changes no count."""
    rows = random_texts(11, 150, 300, 120)
    docs = spark.createDataFrame(rows, "lang string, text string")
    want = brute_phrases(rows, 3, 4, 500, 50)
    for bits in ((15, 15, 15), (20, 16, 17)):
        assert rows_of(phrases.collocations(docs, min_count=4, top=500, bits=bits)) == want


def test_phrases_odd_rows(spark):
    odd = [("en", None), ("en", ""), (None, "a b a b"), ("und", "a b"), ("en", ".,;"), ("en", "x" * 100_000), ("en", "a b " * 20_000), ("fr", "É É. É É")]
    docs = spark.createDataFrame(odd, "lang string, text string").withColumn("n", F.lit(1)).withColumn("phrase", F.lit("mine"))
    assert rows_of(phrases.collocations(docs, min_count=2)) == brute_phrases(odd, 3, 2, 2000, 50)
    assert phrases.collocations(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("numbered", "max_n"), [(0, 3), (5, 2), (9, 4)])
def test_phrases_of_words_without_a_number(spark, monkeypatch, numbered, max_n):
    """Words beyond those that get a number: phrases that hold one are counted apart, none twice and none lost."""
    rows = random_texts(21, 150, 40, 80)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(5)
    want = brute_phrases(rows, max_n, 3, 500, 50)
    monkeypatch.setattr(phrases, "WORDS", numbered)
    for heavy in (4096, 1):
        monkeypatch.setattr(phrases, "HEAVY", heavy)
        assert rows_of(phrases.collocations(docs, max_n=max_n, min_count=3, top=500)) == want


def test_phrases_sent_grow_no_faster_than_the_text(monkeypatch):
    """In five times the text most pairs pass min_count; the rows and bytes that are sent must not grow by more than five."""
    rng = random.Random(7)
    vocabulary = [f"w{i}".encode() for i in range(60)]
    numbered = phrases._Words(pa.array(["en"] * 60), pa.array(vocabulary), 3)
    monkeypatch.setattr(phrases, "FLUSH", 1000)

    def sent(words):
        text = [b" ".join(rng.choices(vocabulary, k=500)) for _ in range(words // 500)]
        batches = list(phrases._packed(lambda: numbered, 4)([pa.record_batch([pa.array(["en"] * len(text)), pa.array(text)], names=["lang", "text"])]))
        parts = pa.Table.from_batches(batches)
        added = pa.concat_tables([phrases._added(lambda: numbered, 1)(parts.filter(pa.array(np.asarray(parts["part"]) == i))) for i in range(16)])
        want = Counter()
        for w in (t.split() for t in text):
            want.update(b" ".join(w[i : i + k]) for k in (2, 3) for i in range(len(w) - k + 1))
        assert dict(zip(added["phrase"].to_pylist(), added["f"].to_pylist(), strict=True)) == want
        assert set(added["lang"].to_pylist()) == {"en"} and all(p.count(b" ") == k - 1 for p, k in zip(added["phrase"].to_pylist(), added["words"].to_pylist(), strict=True))
        return parts.num_rows, parts.nbytes, sum(n >= 10 for n in want.values())

    (rows, size, often), (rows5, size5, often5) = sent(20_000), sent(100_000)
    assert often5 > 10 * often and rows5 == 5 * rows == 5 * 20 * 16 and size5 < 5.1 * size


# ---------------------------------------------------------------- 12


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute_trie(sequences):
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = []
    sub = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sub[c] for c in children[p]]
        saved = (len(members[p]) - 1) * (len(p[-1][1]) if p else 0) + sum(b[1] for b in below)
        sub[p] = (sum(b[0] for b in below) or 1, saved)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(sequences[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), *sub[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_conversations(seed, n, rich=3, longest=7):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-150, 600), n):
        for t in range(rng.randint(1, longest)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", None, "assistant"]), rng.choice(["a", "", None, "bb", "ééé"][:rich])))
    return rows


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_trie_against_plain_version(spark, parts):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        for seed, rich in ((1, 1), (2, 2), (3, 5)):
            rows = random_conversations(seed, 200, rich)
            got = rows_of(trie.prefix_trie(trie.rebuilt(spark.createDataFrame(rows, TURNS))))
            assert got == brute_trie(brute_rebuilt(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("held", [1, 3, 10_000])
def test_trie_of_many_equal_and_long_conversations(spark, held):
    """Equal conversations fill several ranges; ids and rows that wait are sent on before their point is closed."""
    rows = [(c, t, "user", f"hot {t}") for c in range(300) for t in range(3)] + [(1000 + c, t, "user", f"{c} {t}") for c in range(50) for t in range(1 + c % 5)]
    rows += [(5000, t, "user", str(t % 7)) for t in range(700)]
    got = rows_of(trie.prefix_trie(trie.rebuilt(spark.createDataFrame(rows, TURNS)), held))
    assert got == brute_trie(brute_rebuilt(rows))


def test_trie_names_of_beginnings():
    assert trie.in_common(b"a" * 48, b"a" * 32) == 2 and trie.in_common(b"", b"a" * 16) == 0
    names = trie._prefixes(b"a" * 48)
    assert names == [trie._name(b"a" * 48, d) for d in range(4)] and len(set(names)) == 4


def test_trie_odd_rows(spark):
    rows = [(7, None, None, None), (7, None, "user", "b"), (7, 1, "user", "b"), (7, 1, "user", "b"), (None, 1, "user", "x"), (200, 0, "", ""), (201, 0, "user", "x" * 100_000)]
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("mine")).withColumn("key", F.lit(1))
    assert rows_of(trie.prefix_trie(trie.rebuilt(df))) == brute_trie(brute_rebuilt(rows))
    assert trie.prefix_trie(trie.rebuilt(df.limit(0))).count() == 0
    turnless = [(c, 0, "user", "x") for c in range(101, 140) if zlib.crc32(str(c).encode()) % 6 > 0]
    got = rows_of(trie.prefix_trie(trie.rebuilt(spark.createDataFrame(turnless, TURNS))))
    assert got == brute_trie(brute_rebuilt(turnless)) and len(got) == 1


def test_trie_of_the_given_table(spark, small):
    rows = [tuple(r) for r in table(spark, small, "conversations").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(queries.op12_trie(spark, small)) == brute_trie(brute_rebuilt(rows))


# ---------------------------------------------------------------- 13


def covered(rows, length):
    """(doc_id, place) of the words that go."""
    seen, out = set(), []
    for doc_id, text in sorted(rows):
        w = text.split()
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            out += [(doc_id, i + j) for j in range(length)] if key in seen else []
            seen.add(key)
    return out


def brute_spans(rows, length):
    """rows: (doc_id, text) with different ids, in any order."""
    first, out = {}, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        w = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
        gone = set()
        for i in range(len(w) - length + 1):
            if first.setdefault(tuple(w[i : i + length]), (doc_id, i)) != (doc_id, i):
                gone.update(range(i, i + length))
        out.append((doc_id, " ".join(x for i, x in enumerate(w) if i not in gone), len(w), len(gone)))
    return sorted(out, key=str)


def passages(seed, n, length, vocabulary=30):
    rng = random.Random(seed)
    some = lambda k: [rng.choice(["É", "a", "b"]) + str(rng.randrange(vocabulary)) for _ in range(k)]
    shared = [some(rng.randint(length - 2, 3 * length)) for _ in range(6)]
    rows = []
    for i in range(n):
        w = some(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            w += rng.choice(shared) + some(rng.randint(0, 9))
        if rows and rng.random() < 0.2:
            w = rng.choice(rows)[1].split() + some(rng.randint(0, 3))
        rows.append((i * 3 - 50, rng.choice([" ", "\n", " \t"]).join(w)))
    return rows


def spans_of(spark, rows, **more):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return rows_of(spans.without_repeats(docs, **more).select("doc_id", "text", "n_words", "n_removed"))


@pytest.mark.parametrize(("length", "shingle", "vocabulary"), [(5, 3, 30), (8, 8, 30), (6, 1, 2), (4, 2, 1)])
def test_spans_against_plain_version(spark, length, shingle, vocabulary):
    rows = passages(length, 120, length, vocabulary)
    want = brute_spans(rows, length)
    assert spans_of(spark, rows, length=length, shingle=shingle) == want and sum(r[3] for r in want) > 100


def test_spans_of_hot_anchors_and_full_tasks(spark, monkeypatch):
    """Anchors dealt by whole windows, shards of few passages, and tasks that forget what they have met."""
    rows = passages(9, 150, 6)
    for hot, shard, held in ((1, 3, 5), (4, 1, 100_000), (10_000, 1_000_000, 1)):
        monkeypatch.setattr(spans, "HOT", hot)
        monkeypatch.setattr(spans, "SHARD", shard)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        want = {(d, i) for d, i in covered(rows, 6)}
        got = spans.repeated_spans(docs, 6, 3, held=held, bits=15 + shard % 9).collect()
        assert {(r["doc"], i) for r in got for s in r["spans"] for i in range(s["first"], s["end"])} == want


def test_automaton_knows_all_substrings_and_their_first_places():
    rng = random.Random(3)
    for _ in range(60):
        texts = [[rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 6))]
        order = rng.sample(range(len(texts)), len(texts))
        a = spans.Automaton()
        for i in order:
            a.add(texts[i], i, 0, 0)
        a.close()
        assert len(a.size) <= 2 * sum(map(len, texts)) + 1
        asked = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(15)]
        for length in (1, 2, 3):
            found = list(a.earliest(asked, length))
            for i, place in enumerate(found):
                w = asked[i : i + length]
                at = [(d, 0, j + length - 1) for d, t in enumerate(texts) for j in range(len(t) - length + 1) if t[j : j + length] == w]
                assert place == min(at, default=None)


def test_spans_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(None, long), (3, None), (4, ""), (5, " \n "), (6, "x" * 100_000), (7, long), (8, "a " * 5000), (9, f"{long} {long}"), (-1, "é " + long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("mine")).withColumn("spans", F.lit(1)).withColumn("doc", F.lit(None).cast("date"))
    got = spans.without_repeats(docs)
    assert got.columns == ["doc_id", "text", "spans", "doc", "n_words", "n_removed"]
    assert rows_of(got.select("doc_id", "text", "n_words", "n_removed")) == brute_spans(rows, 20)
    assert spans.without_repeats(docs.limit(0)).count() == 0
    # rows that repeat id and text are one document; rows that repeat an id are documents of their own
    twice = spans.without_repeats(spark.createDataFrame([(1, long), (1, long)], "doc_id long, text string")).collect()
    assert [r.n_removed for r in twice] == [0, 0]
    other = spans.without_repeats(spark.createDataFrame([(1, long), (1, long + " z")], "doc_id long, text string")).collect()
    assert sorted(r.n_removed for r in other) == [0, 30]


def test_spans_of_the_given_table(spark, small):
    rows = [tuple(r) for r in table(spark, small, "documents").select("doc_id", "text").collect()]
    want = [(d, n, m, hashlib.sha256(t.encode()).hexdigest()) for d, t, n, m in brute_spans(rows, 20)]
    assert rows_of(queries.op13_spans(spark, small)) == sorted(want, key=str) and sum(r[2] for r in want) > 0
