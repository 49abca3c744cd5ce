"""Each operator against a plain version, and on nulls, empty texts, ties, repeated rows and clashing names."""

import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from kgloom.llm import bpe, chat, decontaminate, line_dedup, pii, quality, queries, sharding, simhash, topk, warc
from kgloom.llm.common import table

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts, extra="hash string"):
    rows = [(i, t, "en", "s", None if t is None else len(t), "x") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, f"{DOCS}, {extra}")


ODD = [None, "", " ", "\n", "a", "a\nb", "A\nb", "a\n\n b ", "x" * 5000, "é É ß", "a b c", "a b c", "one two three four five six seven eight"]


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---------------------------------------------------------------- 1


def test_sharding_bytes_law(spark, small):
    docs = table(spark, small, "documents")
    got = queries.op1_sharding(spark, small).toPandas()
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(got) == len(text)
    assert all(zlib.crc32(text[r.doc_id]) == r.text_crc32 and len(text[r.doc_id]) + 8 == r.size for r in got.itertuples())
    for _, g in got.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert set(got["shard"]) == set(range(24))
    load = got.groupby("shard")["size"].sum()
    assert load.max() - load.min() <= got["size"].max()
    assert got.groupby("virtual_slot")["shard"].nunique().max() == 1 == got.groupby("virtual_slot")["shard_in_next_map"].nunique().max()
    moved = got[got["shard"] != got["shard_in_next_map"]]["size"].sum()
    assert set(got["shard_in_next_map"]) == set(range(25)) and moved < 0.15 * got["size"].sum()


def test_sharding_moves_little_when_a_shard_is_added(spark, small):
    totals = sharding.slot_totals(sharding.measured(table(spark, small, "documents"), 256))
    one = sharding.build_map(totals, 4).cache()
    two = sharding.build_map(totals, 5, previous=one)
    moved = one.alias("a").join(two.alias("b"), "vslot").select("a.bytes", (F.col("a.shard") != F.col("b.shard")).alias("moved")).toPandas()
    assert len(moved) == one.count()
    assert 0.1 < moved[moved.moved]["bytes"].sum() / moved["bytes"].sum() < 0.3
    same = sharding.build_map(totals, 4, previous=one)
    assert rows_of(one.select("vslot", "shard")) == rows_of(same.select("vslot", "shard"))


def test_sharding_odd_rows(spark):
    df = docs_of(spark, ODD).unionByName(docs_of(spark, ODD)).withColumn("slot", F.lit("mine"))
    df = df.unionByName(df.limit(2).withColumn("doc_id", F.lit(None).cast("long")))
    got = sharding.shard_documents(df, shards=3).toPandas()
    assert len(got) == df.count()
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert sharding.shard_documents(df.limit(0), shards=3).count() == 0


# ---------------------------------------------------------------- 2


def brute_topk(rows, k, every):
    v = {i: [int(np.floor(256 * float(x))) for x in e] for i, e in rows}
    out = []
    for q in sorted(i for i in v if i % every == 0):
        scored = sorted((-sum(a * b for a, b in itertools.zip_longest(v[q], v[c], fillvalue=0)), c) for c in v if c != q)
        out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("blocks", [(64, 8), (4096, 512)])
def test_topk_against_all_pairs(spark, small, blocks):
    df = table(spark, small, "embeddings")
    got = topk.top_k(df, candidates=blocks[0], queries=blocks[1])
    assert rows_of(got) == sorted(brute_topk([(r[0], r[1]) for r in df.collect()], 5, 50), key=str)


def test_topk_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (50, [1.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, []), (4, [-1.0, 0.5]), (100, [-1.0, -2.0])]
    bad = [(5, None), (6, [None]), (7, [float("nan")]), (8, [float("inf")]), (None, [1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    assert rows_of(topk.top_k(df)) == sorted(brute_topk(rows, 5, 50), key=str)
    assert topk.top_k(df.limit(0)).count() == 0
    huge = spark.createDataFrame([(0, [1e9, 1.0]), (1, [1e9, 1.0]), (2, [-1e9, 1.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in topk.top_k(huge).orderBy("rank").collect()] == [1, 2]


def test_nra_stops_early_and_is_exact():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(size=(3000, 16)) * 100)
    x[:40] = x[0] + rng.integers(-2, 3, (40, 16))
    q = x[:10]
    got = topk.nra(np.arange(10), q, np.arange(3000), topk.Lists(x), 5)
    for i in range(10):
        s = x @ q[i]
        s[i] = -np.inf
        assert [(a, b) for c, a, b in got if c == i] == [(int(j), int(s[j])) for j in np.lexsort((np.arange(3000), -s))[:5]]


# ---------------------------------------------------------------- 3


def test_viterbi_in_segments_is_viterbi_in_one():
    rng = random.Random(5)
    model = chat.Model.from_counts(np.random.default_rng(1).random((chat.STATES + 1, chat.STATES)), np.random.default_rng(2).random((chat.STATES, chat.SYMBOLS)))
    for _ in range(20):
        obs = [rng.randrange(chat.SYMBOLS) for _ in range(rng.randrange(3, 60))]
        cuts = sorted(rng.sample(range(1, len(obs)), 2))
        parts = [obs[a:b] for a, b in zip([0, *cuts], [*cuts, len(obs)])]
        ends = chat.ends_of([(i, 0, "c", model.segment(p)) for i, p in enumerate(parts)])
        pieces = [s for i, p in enumerate(parts) for s in model.decode(p, *ends[i, 0])]
        assert pieces == model.decode(obs)


def test_chat_roles(spark, small):
    got = queries.op3_chat(spark, small).toPandas()
    first = got[got.part == 0]
    assert len(first) == table(spark, small, "conversations").count()
    assert (first.role == first.recovered_role).mean() > 0.85


def test_chat_markers_hot_conversation_and_odd_rows(spark):
    text = "User: what is it?\nmore of it\nAssistant: it is that.\nand so on"
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", "is it so?" if i % 2 == 0 else "it is so, at length, as I have said before.\nit is") for i in range(400)]
    rows += [(2, 0, None, text), (2, 0, None, text), (None, None, None, None), (3, 0, "odd", "")]
    got = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("obs", F.lit(1))).toPandas()
    hot = got[got.conv_id == 1].sort_values("turn")
    assert len(hot) == 400 and (hot.role == hot.recovered_role).all()
    assert list(got[(got.conv_id == 2)].sort_values("part").recovered_role)[:2] == ["user", "user"]
    assert "<|assistant|>\nit is that.\nand so on\n<|end|>\n" in set(got[got.conv_id == 2].rendered)
    assert len(got) == 400 + 4 + 2
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(empty).count() == 0


# ---------------------------------------------------------------- 4


def brute_lines(texts, at_least):
    blank = " \t\n\x0b\f\r"
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    lines = [(t or "").split("\n") for t in texts]
    keys = [[lower(x.strip(blank)) for x in d] for d in lines]
    count = {}
    for d in keys:
        for k in set(d):
            count[k] = count.get(k, 0) + 1
    bad = {k for k, n in count.items() if n >= at_least and k}
    return [(len(d), sum(k in bad for k in ks), "\n".join(x for x, k in zip(d, ks) if k not in bad)) for d, ks in zip(lines, keys)]


def test_line_dedup(spark):
    rng = random.Random(2)
    pool = ["Alpha", "alpha ", "\tALPHA\r", "", " ", "Éa", "éa", "beta", "gamma", "delta"]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(0, 6))) for _ in range(60)] + ODD
    df = docs_of(spark, texts).withColumnsRenamed({"hash": "gone"}).withColumn("pos", F.lit(1))
    got = line_dedup.dedup_lines(df, min_docs=10).orderBy("doc_id").collect()
    assert [(r["n_lines"], r["n_dropped"], r["text"]) for r in got] == brute_lines(texts, 10)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0
    twice = line_dedup.dedup_lines(df.unionByName(df), min_docs=20).where("doc_id = 3")
    assert twice.count() == 2


# ---------------------------------------------------------------- 5


def test_warc_round_trip(spark, tmp_path):
    big, other = "x" * 999 + "é", "y" * 1000
    rows = [(1, "http://a", big), (2, None, big), (3, "http://b\n c", other), (3, "http://b", other), (9, "u", other), (5, "u", "short"), (6, "u", "short"), (7, "u", None), (None, "u", big), (8, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    manifest = warc.write_archives(pages, root=f"file://{tmp_path}/w").cache()
    for span in (40, 1 << 20):
        got = warc.read_archives(manifest, span).toPandas()
        assert len(got) == len(rows) and got.verified.all()
        of = {r.page_id: (r.record_type, None if np.isnan(r.refers_to) else int(r.refers_to)) for r in got.dropna(subset=["page_id"]).itertuples()}
        assert of[1] == ("revisit", 2) and of[2] == ("response", None) and of[3] == ("revisit", 9) and of[9] == ("response", None)
        assert of[5] == of[6] == of[7] == of[8] == ("response", None)
        assert set(got[got.page_id == 1].payload_digest) == {hashlib.sha1(big.encode()).hexdigest()} and set(got[got.page_id == 1].payload_bytes) == {1001}
    one = manifest.first()["path"].removeprefix("file://")
    assert gzip.open(one).read().startswith(b"WARC/1.1\r\n")
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_reader_skips_false_magic(tmp_path):
    import pyarrow as pa

    real = [warc.member(i, "u", "z" * i * 50, "d", None) for i in range(6)]
    junk = warc.MAGIC + b"junk" + gzip.compress(b"not a record")
    data = junk + junk.join(real)
    for span in (7, 64, 1000, 10**6):
        seen = [raw for a in range(0, len(data), span) for _, raw in warc.members(pa.BufferReader(data), len(data), a, min(len(data), a + span))]
        assert [warc.parsed(r)["warc-record-id"] for r in seen] == [f"<urn:page:{i}>" for i in range(6)]


# ---------------------------------------------------------------- 6


def weighted_jaccard(a, b):
    common = sum((a & b).values())
    return common / max(1, sum(a.values()) + sum(b.values()) - common)


def brute_leaks(texts, items):
    out = []
    for d, t in texts:
        ws = decontaminate.words(t)
        for i, it in items:
            iw = decontaminate.words(it)
            if len(iw) < 5 or len(ws) < 5:
                continue
            want = Counter(zip(*(iw[k:] for k in range(5))))
            best = max(weighted_jaccard(Counter(zip(*(ws[s : s + len(iw)][k:] for k in range(5)))), want) for s in range(len(ws) - 4))
            if best >= 0.8:
                out.append((d, i, round(best, 9)))
    return sorted(out)


def test_decontamination_against_all_windows(spark, small):
    docs = [(r.doc_id, r.text) for r in table(spark, small, "documents").where("length(text) < 3000").collect()]
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    words = items[0][1].split()
    docs += [(900, "Before it " + items[1][1] + " and after."), (901, " ".join(words[:-1])), (902, " ".join(["Odd"] + words[1:])), (903, " ".join(words[: len(words) // 2])), (904, None), (905, ""), (906, items[2][1].upper())]
    docs += [(907, " ".join(["to"] * 3 + words + words))]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items + [(77, None), (78, "a b")], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got.collect()) == brute_leaks(docs, items)
    assert {(900, 1), (901, 0), (902, 0), (906, 2), (907, 0)} <= {(r.doc_id, r.item_id) for r in got.collect()}


def test_decontamination_of_texts_that_end_inside_an_item(spark):
    item = [f"w{i}" for i in range(39)]
    docs = [(n, " ".join(item[:n])) for n in range(28, 40)] + [(100 + n, " ".join(["before"] * 50 + item[:n])) for n in range(28, 40)]
    docs += [(200 + n, " ".join(item[-n:])) for n in range(28, 40)]
    items = [(1, " ".join(item))]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    found = sorted((r.doc_id, r.item_id, round(r.similarity, 9)) for r in got.collect())
    assert found == brute_leaks(docs, items)
    assert {base + n for base in (0, 100, 200) for n in range(32, 40)} == {d for d, _, _ in found}


def test_decontaminated_keeps_the_rest(spark):
    item = " ".join(f"w{i}" for i in range(30))
    df = docs_of(spark, [item, "x " + item, "clean text", None]).withColumn("leaks", F.lit(1))
    got = decontaminate.decontaminated(df, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == [2, 3]
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminated(df, none).count() == 4


# ---------------------------------------------------------------- 7


def test_bpe_is_tiktoken(spark, small):
    import tiktoken

    ranks = bpe.load_ranks(bpe.default_path())
    told = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    odd = ["", "a" * 3000, "ab" * 700, " " * 40, "日本語テキスト" * 60, "".join(rng.choice("abcdeé ßñ\n\t.,!0123") for _ in range(4000)), "🙂" * 300, "".join(chr(rng.randrange(32, 0x3000)) for _ in range(3000)), "<|endoftext|>", "\r\n\r\n  x"]
    texts = [r.text for r in table(spark, small, "documents").collect()] + odd
    enc = bpe.encoder(bpe.default_path(), bpe.default_pattern())
    for t, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == told.encode_ordinary(t)
        assert enc.decode(ids) == t.encode()


def test_bpe_rows(spark):
    df = docs_of(spark, ODD).withColumn("n_tokens", F.lit("mine"))
    got = bpe.encode_documents(df).orderBy("doc_id").collect()
    assert got[0]["n_tokens"] == 0 and got[0]["ids"] == [] and got[1]["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
    assert all(r["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest() for r, t in zip(got, ODD))
    assert bpe.encode_documents(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 8


def brute_groups(texts, n=3, radius=2):
    def fp(t):
        ws = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
        sh = [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] if len(ws) >= n else [" ".join(ws)] if ws else []
        hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    f = [fp(t) for t in texts]
    root = list(range(len(f)))
    for _ in range(len(f)):
        old = root[:]
        for i in range(len(f)):
            for j in range(i):
                if (f[i] ^ f[j]).bit_count() <= radius:
                    root[i] = root[j] = min(root[i], root[j])
        if old == root:
            break
    return f, root


def test_simhash_groups_against_all_pairs(spark, small):
    rng = random.Random(9)
    base = [r.text for r in table(spark, small, "documents").limit(60).collect()]
    texts = base + ODD + [" ".join(b.split()[: -rng.randrange(1, 3)]) for b in base[:30]] + base[:5]
    texts += [" ".join(["same"] * 400 + [str(i)]) for i in range(70)]
    f, root = brute_groups(texts)
    got = simhash.near_duplicates(docs_of(spark, texts).withColumn("fp", F.lit(1))).orderBy("doc_id").collect()
    assert [r["fp"][0] % 2**64 for r in got] == f
    assert [r["component_id"] for r in got] == root
    assert simhash.near_duplicates(docs_of(spark, ODD).limit(0)).count() == 0


def test_cells_meet_for_all_pairs_in_radius():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2**64, 500, np.uint64)
    for flips in (0, 1, 2):
        y = x.copy()
        for _ in range(flips):
            y ^= np.uint64(1) << rng.integers(0, 64, 500).astype(np.uint64)
        a, b = simhash.cells(x[:, None]), simhash.cells(y[:, None])
        assert all(set(p) & set(q) for p, q in zip(a.tolist(), b.tolist()))


def test_forest_of_long_runs_and_of_short_runs():
    rng = np.random.default_rng(1)
    near = np.bitwise_xor(np.uint64(12345), np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64))
    fp = np.unique(near)[:, None]
    fp = np.concatenate([fp, rng.integers(0, 2**64, (2500, 1), np.uint64)])
    links = simhash._forest(np.zeros(len(fp), np.int64), np.arange(len(fp)), fp, simhash.pivots(1), 2)
    assert {a for a, _ in links.tolist()} | {0} == set(range(len(np.unique(near)))) and len(links) == len(np.unique(near)) - 1


def test_components_of_chains_and_stars(spark):
    edges = [(i + 1, i) for i in range(100, 140)] + [(i, 7) for i in range(200, 260)] + [(260, 259), (9, 7), (9, 3)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(100, 141)} == {100} and got[260] == got[7] == got[9] == got[3] == 3
    assert simhash.components(spark.createDataFrame([], "a long, b long")).count() == 0


def cosine(a, b):
    return sum((a & b).values()) / max(1, sum(a.values()) * sum(b.values())) ** 0.5


def brute_similar(texts, n=5, least=0.8):
    def bag(t):
        ws = simhash.words(t)
        return Counter(simhash.shingles(ws, n))

    bags = [bag(t) for t in texts]
    root = list(range(len(bags)))
    for i, x in enumerate(bags):
        for j in range(i):
            if not x and not bags[j] or x and cosine(x, bags[j]) >= least - 1e-9:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


def test_similar_groups_against_all_pairs(spark):
    """Pairs just above and below the similarity, repeated shingles, a group of near copies, a chain, short texts."""
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = []
    for at in range(60):
        ws = [word() for _ in range(304)]
        texts += [" ".join(ws), " ".join(ws[: 196 if at % 2 else 195])]  # 192 of 300 shingles, or one fewer
        other = ws[:]
        for i in range(5, 300, 21 if at % 2 else 26):
            other[i] = "changed"
        texts.append(" ".join(other))
    ws = [word() for _ in range(200)]
    for _ in range(70):
        other = ws[:]
        for _ in range(rng.randrange(1, 5)):
            other[rng.randrange(200)] = word()
        texts.append(" ".join(other))
    texts += [" ".join(ws[i : i + 100]) for i in range(0, 80, 8)]
    texts += ["a b c d e f g h i", "a b c d e f g h", "a b c d e f g", "a b c d", "a b c d", "a b c", "x " * 60, "x " * 76, "x " * 90, "", " ", None]
    texts += ["p q r s t " * 3 + "p q r s", "p q r s t " * 4 + "p q r s"]
    got = simhash.similar_groups(docs_of(spark, texts), n=5, similarity=0.8, radius=88, lanes=4).orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == brute_similar(texts)
    assert simhash.similar_groups(docs_of(spark, texts).limit(0), n=5, similarity=0.8, radius=88, lanes=4).count() == 0


# ---------------------------------------------------------------- 9


def plain_spans(t):
    t = t or ""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


def test_base_spans_are_the_patterns(spark, small):
    rng = random.Random(6)
    texts = ["".join(rng.choice("aZ0123456789.@-+ ()%_") for _ in range(rng.randrange(0, 80))) for _ in range(4000)]
    texts += ["4111 1111-1111 1111 é x@y.zz 1.2.3.4.5.6.7.8 999.1.1.1 +1 (234) 567-8901", "a@b@c.de", "@a.b", "a@@b.c", "a@b.c.d@e.f", "0001.02.3.255", None, ""]
    texts += [r.text for r in table(spark, small, "documents").collect()]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t), t


def test_sanitisation_of_disclosing_terms(spark):
    fill = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    rng = random.Random(3)
    line = lambda: " ".join(rng.choice(fill) for _ in range(12))
    texts = [f"{line()} Zorblatt wrote from jo@ex.org {line()}" for _ in range(6)] + [line() for _ in range(40)] + ["see Zorblatt, the alpha", None, ""]
    got = pii.sanitise(docs_of(spark, texts).withColumn("spans", F.lit(1))).orderBy("doc_id").collect()
    assert all("[EMAIL]" in r["text"] and "jo@ex" not in r["text"] and "orblatt" not in r["text"] for r in got[:6])
    assert "orblatt" not in got[46]["text"] and got[46]["text"].endswith("alpha")
    assert [r["text"] for r in got[6:46]] == texts[6:46] and got[47]["text"] == "" == got[48]["text"]
    assert pii.sanitise(docs_of(spark, ODD).limit(0)).count() == 0


# ---------------------------------------------------------------- 10


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op10_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").where("held_out").toPandas()
    assert len(got) > 500
    assert (got.predicted == got.quality).mean() > 0.95
    good, bad = got[got.quality == 1].score.rank().mean(), got[got.quality == 0].score.mean()
    assert bad < got[got.quality == 1].score.mean() - 0.5 and good > 0
    fold = [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]
    assert all(fold)


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(13)] + [(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs_of(spark, ODD).withColumn("score", F.lit("mine"))
    got = quality.classify(df, labels)
    assert got.count() == len(ODD) and all(0 <= r["score"] <= 1 for r in got.collect())
    assert quality.classify(df.limit(0), labels.limit(0)).count() == 0
    assert {r["score"] for r in quality.classify(df, labels.limit(0)).collect()} == {0.5}


# ---------------------------------------------------------------- by operator: methods, rows repeated, damage, size


def test_sharding_spreads_hot_records(spark):
    rows = [(7, "same")] * 4000 + [(7, f"other {i}") for i in range(500)] + [(None, "x")] * 500 + [(i, "t" * (i % 50)) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sharding.shard_documents(df, shards=5, slots=64).toPandas()
    assert len(got) == len(rows) and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    assert got.virtual_slot.value_counts().max() < 400
    load = got.groupby("shard")["size"].sum()
    assert load.max() < 1.1 * load.min()


def test_topk_of_repeated_vectors_and_of_many_query_blocks(spark):
    rng = np.random.default_rng(0)
    v = [(int(i), [float(x) for x in rng.integers(-3, 4, 6)]) for i in rng.integers(0, 120, 400)]
    v += [(60, [1.0] * 6)] * 50 + [(50, [1.0] * 6)] * 3
    df = spark.createDataFrame(v, "vec_id long, embedding array<double>").repartition(5)
    ids, x = [i for i, _ in v], np.array([e for _, e in v]) * 256
    want = []
    for q in sorted({i for i in ids if i % 50 == 0}):
        asked = {tuple(e) for i, e in v if i == q}
        scored = sorted((-int(np.dot(np.array(a) * 256, x[j])), ids[j]) for a in asked for j in range(len(v)) if ids[j] != q)
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:5])]
    for how in ({}, {"query_bytes": 100}, {"candidates": 7, "queries": 2}):
        assert rows_of(topk.top_k(df, **how)) == sorted(want, key=str), how


def share_read(rows, every=50, **blocks):
    """Of the entries of all lists of the given table, those that queries have read or resolved."""
    ids, x = np.array([i for i, _ in rows]), np.array([[int(np.floor(256 * float(c))) for c in e] for _, e in rows])
    asked = ids % every == 0
    best = topk._Best(ids[asked], x[asked], 5)
    for a, b in ((0, topk.FIRST), (topk.FIRST, len(ids))):
        best.see(ids[a:b], x[a:b], 256)
    return best.reads / best.there


def test_bounds_stop_on_the_given_table(spark, small):
    for sf in (small, small.replace("0.001", "0.1")):
        rows = [(r[0], r[1]) for r in table(spark, sf, "embeddings").select("vec_id", "embedding").collect()]
        assert share_read(rows) < 0.95, share_read(rows)


def test_sums_beyond_the_floating_point_numbers(spark):
    """Components of any size: the lists give bounds with room for rounding, integers the scores."""
    rng = random.Random(6)
    rows = [(i, [rng.choice([1e4, 3e5, 2e6]) * rng.uniform(-1, 1) for _ in range(7)]) for i in range(700)] + [(701, [2e6] * 7), (702, [2e6] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    assert rows_of(topk.top_k(df)) == sorted(brute_topk(rows, 5, 50), key=str)
    most = 2**63 - 1
    huge = [(0, [1e9]), (5, [3e9]), (3, [2e9]), (4, [9e9]), (9, [-1e9])]
    got = topk.top_k(spark.createDataFrame(huge, "vec_id long, embedding array<double>"), k=3).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(3, most), (4, most), (5, most)]


def test_nra_reads_less_than_all_and_bounds_hold():
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(30, 12)) * 200
    x = np.floor(centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 12)) * 5)
    q, ids = np.floor(centres[:20] * 3), np.arange(3000)
    lists = topk.Lists(x)
    got = topk.nra(-1 - np.arange(20), q, ids, lists, 5)
    for i in range(20):
        s = x @ q[i]
        assert [(b, c) for a, b, c in got if a == i] == [(int(j), int(s[j])) for j in np.lexsort((ids, -s))[:5]]
    assert lists.resolved <= 20 * topk.RESOLVE * x.size and lists.reads + lists.resolved < 0.95 * 20 * x.size
    partial, depth, before = np.zeros((20, 3000)), 700, lists.reads
    lists.read(q, partial, 0, 300)
    lists.read(q, partial, 300, depth)
    assert lists.reads - before == np.count_nonzero(q) * depth
    low, high = lists.low(q, depth), lists.high(q, depth)
    assert (partial + low <= q @ x.T).all() and (q @ x.T <= partial + high).all()
    for i in (0, 7):  # what one query has read, entry by entry
        seen = np.zeros(3000)
        for j in range(12):
            order = np.argsort(x[:, j], kind="stable")
            for at in order[::-1][:depth] if q[i, j] > 0 else order[:depth]:
                seen[at] += q[i, j] * x[at, j]
        assert (seen == partial[i]).all()


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    model = chat.Model.from_counts(rng.random((chat.STATES + 1, chat.STATES)), rng.random((chat.STATES, chat.SYMBOLS)))
    for n in (1, 2, 3, 4):
        for _ in range(5):
            obs = rng.integers(0, chat.SYMBOLS, n).tolist()

            def weight(path):
                return sum(model.trans[a, b] + model.emit[b, o] for a, b, o in zip((chat.START, *path), path, obs))

            best = max(itertools.product(range(chat.STATES), repeat=n), key=weight)
            assert model.decode(obs) == list(best)
            assert np.isclose(model.segment(obs)[chat.START].max(), weight(best))


def test_chat_against_one_pass_over_each_conversation(spark, small):
    """Counts by hand, and one Viterbi for each conversation; ids are texts here."""
    df = table(spark, small, "conversations").withColumn("conv_id", F.concat(F.lit("c"), F.col("conv_id").cast("string")))
    df = df.unionByName(df.where("turn = 1"))
    rows = df.select("conv_id", "turn", "role", "text", F.xxhash64("text", "role").alias("h")).orderBy("conv_id", "turn", "h").collect()
    trans, emit = np.zeros((chat.STATES + 1, chat.STATES)), np.zeros((chat.STATES, chat.SYMBOLS))
    by = {c: list(g) for c, g in itertools.groupby(rows, key=lambda r: r["conv_id"])}
    for of in by.values():
        states = [2 * chat.ROLES.index(r["role"]) + (i > 0) for r in of for i in range(len(r["text"].split("\n")))]
        trans[chat.START, states[0]] += 1
        for a, b in zip(states, states[1:]):
            trans[a, b] += 1
        for s, o in zip(states, [o for r in of for o in chat.symbols(r["text"])]):
            emit[s, o] += 1
    model, want = chat.Model.from_counts(trans, emit), []
    for c, of in by.items():
        states, at = model.decode([o for r in of for o in chat.symbols(r["text"])]), 0
        for r in of:
            lines = r["text"].split("\n")
            mine, at = states[at : at + len(lines)], at + len(lines)
            starts = [0] + [i for i in range(1, len(lines)) if mine[i] % 2 == 0]
            for p, (a, b) in enumerate(zip(starts, [*starts[1:], len(lines)])):
                role = chat.ROLES[mine[a] // 2]
                text = "\n".join([lines[a][chat.marker(lines[a])[1] :], *lines[a + 1 : b]])
                want.append((c, r["turn"], p, r["role"], role, text, f"<|{role}|>\n{text.strip()}\n<|end|>\n"))
    assert rows_of(chat.format_chats(df)) == sorted(want, key=str)


def test_line_dedup_counts_documents_not_rows(spark):
    rows = [(1, "often in one\nx")] * 12 + [(i, "in ten\ny") for i in range(10, 20)] + [(None, "null\nz")] * 10 + [(None, "null 2")] * 9
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=10).collect()
    assert sorted({(r["doc_id"] or 0, r["text"]) for r in got if r["doc_id"] not in range(10, 20)}) == [(0, ""), (0, "null 2"), (1, "often in one\nx")]
    assert len(got) == len(rows) and {r["text"] for r in got if r["doc_id"] in range(10, 20)} == {""}


def test_warc_payloads_and_damage(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" + "é" * (i * 30)) for i in range(40)] + [(100, "u", "é" * 900), (101, "u", "é" * 900)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    manifest = warc.write_archives(pages, root=f"file://{tmp_path}/w").cache()
    got = {r.page_id: r for r in warc.read_archives(manifest, 300, with_payload=True).collect()}
    assert all(bytes(got[i].payload).decode() == html for i, _, html in rows if i != 100) and bytes(got[100].payload) == b"" and got[100].payload_bytes == 1800
    assert manifest.agg(F.sum("records")).first()[0] == len(got) == 42
    path = max((r["path"] for r in manifest.collect()), key=lambda p: len(open(p.removeprefix("file://"), "rb").read())).removeprefix("file://")
    whole = open(path, "rb").read()
    starts = [at for at, _ in warc.members(__import__("pyarrow").BufferReader(whole), len(whole), 0, len(whole))]
    middle = starts[len(starts) // 2]
    for harm in (whole[:-5], whole[:middle] + b"\0" * 12 + whole[middle + 12 :], whole[: middle + 40] + b"\0" * 40 + whole[middle + 80 :], whole[:middle]):
        with open(path, "wb") as f:
            f.write(harm)
        for span in (100, 1 << 20):
            with pytest.raises(Exception, match="cut off|record|bytes|Error"):
                warc.read_archives(manifest, span).collect()
    with open(path, "wb") as f:
        f.write(whole[:middle] + b"\0" * 12 + whole[middle + 12 :])
    assert warc.read_archives(manifest, strict=False).count() == 41


def test_block_index_proposes_all_within_the_radius():
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 256, (300, 32)).astype(np.uint8)
    near = np.unpackbits(prints, axis=1)
    for row in near:
        row[rng.choice(256, rng.integers(0, decontaminate.RADIUS + 1), replace=False)] ^= 1
    sized = decontaminate.Sized(list(range(300)), prints)
    window, item = sized.proposed(np.packbits(near, axis=1))
    assert {(i, i) for i in range(300)} <= set(zip(window.tolist(), item.tolist()))
    assert len(set(zip(window.tolist(), item.tolist()))) == len(window) < 300 * 300


def test_decontamination_finds_through_the_index(monkeypatch):
    items = [(i, " ".join(f"i{i}w{j}" for j in range(40))) for i in range(50)]
    index = decontaminate.Index(items)
    text = f"before {items[3][1]} after " + " ".join(f"other{j}" for j in range(500))
    assert [(index.ids[i], s) for i, s, _, _ in index.matches(text)] == [(3, 1.0)] and 0 < index.compared < 50 * 540
    monkeypatch.setattr(decontaminate.Sized, "proposed", lambda self, p: (np.empty(0, int), np.empty(0, int)))
    assert index.matches(text) == []
    monkeypatch.undo()
    assert [i for i, *_ in decontaminate.Index([(1, "to " * 400)]).matches("to " * 40_000)] == [0]


def test_decontamination_in_blocks_of_items_and_of_repeated_rows(spark, small):
    docs = table(spark, small, "documents").select("doc_id", "text")
    docs = docs.unionByName(docs.limit(60))
    items = table(spark, small, "benchmark").unionByName(table(spark, small, "benchmark"))
    one = decontaminate.contaminated(docs, items)
    assert rows_of(one) and rows_of(one) == rows_of(decontaminate.contaminated(docs, items, block_bytes=2000))
    assert rows_of(decontaminate.decontaminated(docs, items)) == rows_of(decontaminate.decontaminated(docs, items, block_bytes=2000))
    texts = [(r.doc_id, r.text) for r in docs.where("length(text) < 1500").collect()]
    short = docs.where("length(text) < 1500")
    assert sorted((r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontaminate.contaminated(short, items).collect()) == brute_leaks(texts, [tuple(r) for r in table(spark, small, "benchmark").collect()])


def test_bpe_matches_of_any_length():
    import tiktoken

    told = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.load_ranks(bpe.default_path()), special_tokens={})
    enc, rng = bpe.encoder(bpe.default_path(), bpe.default_pattern()), random.Random(12)
    texts = ["".join(rng.choice(alphabet) for _ in range(n)) for alphabet in ("ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "日本語テキスト") for n in (*range(1, 40, 3), 255, 256, 257, 511, 512, 513, 767, 768, 769, 2000, 9000)]
    texts += ["x" * n for n in range(500, 520)] + ["abc" * n for n in range(168, 175)] + [" " * 700, "\n" * 600]
    for t, ids in zip(texts, enc.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == told.encode_ordinary(t)


def test_bpe_query_rows_are_tiktokens(spark, small, tmp_path):
    import tiktoken

    told = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.load_ranks(bpe.default_path()), special_tokens={})
    docs = table(spark, small, "documents")
    odd = docs.limit(3).withColumn("text", F.lit(None).cast("string"))
    docs.unionByName(docs.limit(20)).unionByName(odd).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = rows_of(queries.op7_bpe(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256"))
    want = []
    for r in spark.read.parquet(f"file://{tmp_path}/documents.parquet").collect():
        ids = np.array(told.encode_ordinary(r.text or ""), "<u4")
        want.append((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def near_pairs(rng, n, words):
    """Texts of random words, each with a second one of a similarity between 0.80 and 0.86."""
    texts = []
    while len(texts) < 2 * n:
        ws = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        other = ws[:]
        while (s := cosine(Counter(zip(*(ws[i:] for i in range(5)))), Counter(zip(*(other[i:] for i in range(5)))))) > 0.86:
            other[rng.randrange(words)] = f"c{rng.randrange(10**6)}"
        if s >= 0.8:
            texts += [" ".join(ws), " ".join(other)]
    return texts


@pytest.mark.parametrize("words", [60, 300])
def test_near_duplicates_just_above_the_similarity_are_found(spark, words):
    texts = near_pairs(random.Random(words), 300, words)
    got = simhash.similar_groups(docs_of(spark, texts), n=5, similarity=0.8, radius=88, lanes=4).select("doc_id", "component_id").collect()
    of = {r.doc_id: r.component_id for r in got}
    assert sum(of[i] == i - 1 for i in range(1, 600, 2)) >= 0.98 * 300 and all(c // 2 == i // 2 for i, c in of.items())


def test_large_cells_are_compared_in_blocks(spark, monkeypatch):
    """Many texts that share most of their shingles, some linked and some not: all in the same cells."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for share in (0.93, 0.9, 0.87, 0.8):
        for _ in range(40):
            ws = base[:]
            at = rng.randrange(0, 120)
            for k in range(int(120 * (1 - share))):
                ws[(at + k) % 120] = f"n{rng.randrange(40)}"
            texts.append(" ".join(ws))
    want = brute_similar(texts)
    split = simhash._split
    for cell, middle in ((8, 1 << 16), (32, 20), (10**6, 5)):
        monkeypatch.setattr(simhash, "MIDDLE", middle)  # here, not in the workers: cells are dealt to parts of this size
        monkeypatch.setattr(simhash, "_split", lambda rooted, cell=cell: split(rooted, cell))
        got = simhash.similar_groups(docs_of(spark, texts), n=5, similarity=0.8, radius=88, lanes=4).orderBy("doc_id").collect()
        assert [r["component_id"] for r in got] == want
    assert 1 < len(set(want)) < len(texts)


def test_stars_read_a_cell_in_parts(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(6)
    cell = np.sort(rng.integers(0, 6, 400))
    fp, node = rng.integers(0, 4, (400, 4)).astype(np.uint64), np.arange(400)
    cell[100:300] = cell[100]
    cell.sort()

    def batches():
        for a in range(0, 400, 37):
            part = slice(a, a + 37)
            rows = fp[part].view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cell[part]), pa.array(node[part]), pa.array(list(rows), pa.list_(pa.int64()))], ["cell", "node", "fp"])

    for most in (16, 1 << 16):
        monkeypatch.setattr(simhash, "MIDDLE", most)
        got = [r for b in simhash._stars(batches(), 3) for r in b.to_pylist()]
        assert len(got) == 400 - len(set(cell.tolist()))
        for r in got:
            assert r["hub"] in (r["a"], r["b"]) and cell[r["a"]] == cell[r["b"]] and r["near"] == (np.bitwise_count(fp[r["a"]] ^ fp[r["b"]]).sum() <= 3)


def test_representatives_by_row_key(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    how = dict(n=5, similarity=0.8, radius=88, lanes=4)
    kept = lambda rows: rows_of(simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string, lang string"), **how).select("doc_id", "text"))
    assert kept([(5, a, "x"), (5, b, "y"), (7, c, "z")]) == sorted([(5, a), (5, b), (7, c)], key=str)
    assert kept([(3, a, "x"), (5, a, "x"), (5, b, "y")]) == sorted([(3, a), (5, b)], key=str)
    assert kept([(None, a, "x"), (None, a + " end", "y"), (None, b, "x")]) in ([(None, a), (None, b)], [(None, a + " end"), (None, b)])
    assert kept([(1, a, "x"), (1, a, "y"), (1, a, "y"), (2, a + " end", "x")]) == [(1, a)]


def plain_disclosing(texts, generalise=0.9, min_texts=2):
    """Every pair of a term and an entity, by the definition."""
    docs = []
    for t in texts:
        spans = plain_spans(t)
        own = set()
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t or ""):
            w = m[0].strip(pii.PUNCTUATION).lower()
            if len(w) >= 3 and not any(a < m.end() and m.start() < b for _, a, b in spans):
                own.add(w)
        docs.append((t, {f"{k}:{t[a:b]}" for k, a, b in spans}, own))
    n, out = len(docs), {}
    for term in set().union(*(o for _, _, o in docs)):
        have = [d for d in docs if term in d[2]]
        for entity in set().union(*(e for _, e, _ in have)):
            both, e_docs = [d for d in have if entity in d[1]], sum(entity in e for _, e, _ in docs)
            if len({d[0] for d in both}) < min_texts or e_docs == n:
                continue
            rate = np.log((len(both) / n) / (len(have) / n * e_docs / n)) / -np.log(e_docs / n)
            if rate >= generalise - 1e-12:
                out[term] = max(out.get(term, 0), round(float(rate), 9))
    return out


def pii_texts():
    rng, fill = random.Random(11), [f"word{i}" for i in range(60)]
    line = lambda n: " ".join(rng.choice(fill) for _ in range(n))
    texts = []
    for k in range(12):
        who, code = f"jo{k}@ex.org", f"ID-{k}x{k}"
        for i in range(rng.randrange(1, 5)):
            texts.append(f"Zor{k}blatt, {line(300)} writes from {who} {line(20)} {code}; {line(rng.randrange(3))}" + (f" and +1 234 567 80{k:02d}" if i % 2 else ""))
        if k % 3 == 0:
            texts += [texts[-1]] * 3 + [f"zor{k}blatt {line(30)}"] * (k // 3)
    return texts + [line(40) for _ in range(200)] + [None, "", "1.2.3.4 Once", "1.2.3.4 Once", "5.6.7.8 twice a", "5.6.7.8 twice b"]


def test_disclosure_against_all_pairs(spark):
    texts = pii_texts()
    want = plain_disclosing(texts)
    got = {r.term: round(r.disclosure, 9) for r in pii.disclosing(docs_of(spark, texts)).collect()}
    assert got == {pii.code_of(t): rate for t, rate in want.items()}
    assert {"zor4blatt", "twice"} <= want.keys() and "once" not in want and not any(t.startswith("word") for t in want)


def test_pii_query_rows(spark, tmp_path):
    """Whole rows by the plain definitions; broadcast terms and joined terms give the same."""
    texts = pii_texts()
    docs_of(spark, texts).write.parquet(f"file://{tmp_path}/documents.parquet")
    rates, want = plain_disclosing(texts), []
    for i, t in enumerate(texts):
        base = plain_spans(t)
        more = []
        for m in re.finditer(r"[^\x20\x09-\x0D]+", t or ""):
            if m[0].strip(pii.PUNCTUATION).lower() in rates:
                a, b = m.span()
                if not any(x < b and a < y for _, x, y in base):
                    more.append(("term", a, b))
        told = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        want.append((i, *(sum(k == kind for k, _, _ in base) for kind in pii.KINDS), hashlib.sha256(told(base).encode()).hexdigest(), told(base + more)))
    assert rows_of(queries.op9_pii(spark, str(tmp_path))) == sorted(want, key=str)
    df = docs_of(spark, texts)
    assert rows_of(pii.sanitise(df)) == rows_of(pii.sanitise(df, broadcast_terms=0))
    assert any("term" in w[-1] for w in want)


def test_quality_against_a_plain_scorer(spark, small, monkeypatch):
    """The same dictionaries and curve, made by hand from the sample."""
    import zstandard

    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents").unionByName(table(spark, sf, "documents").limit(50)), table(spark, sf, "labels")
    told = {(r.doc_id, r.quality) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    order = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    text = {r.doc_id: r.text for r in docs.collect()}
    filled, curve = {0: [], 1: []}, []
    for y in (0, 1):
        ids = sorted((d for d, q in told if q == y and text.get(d)), key=lambda d: (order[d], d))
        filled[y] = [text[d] for place, d in enumerate(ids, 1) if place % 2 == 0]
        curve += [(text[d], y) for place, d in enumerate(ids, 1) if place % 2]
    raw = {}
    for y, texts in filled.items():
        chars = max(64, quality.DICT_BYTES // len(texts))
        each, parts = chars // quality.SPREAD, []
        for t in texts:
            last = len(t) - each
            parts.append(t if len(t) <= chars else "\n".join(t[last * i // (quality.SPREAD - 1) :][:each] for i in range(quality.SPREAD)))
        raw[y] = "\n".join(parts).encode()[-quality.DICT_BYTES :]

    def size(piece, y):
        d = zstandard.ZstdCompressionDict(raw[y], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        return len(zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(piece)) - quality.FRAME

    model = quality.train(docs, labels)
    assert (model.good, model.bad) == (raw[1], raw[0])
    made = quality._compressors(raw[1], raw[0])
    x, y = np.array([quality.difference(t, *made) for t, _ in curve]), np.array([q for _, q in curve])
    p = 1 / (1 + np.exp(-(model.slope * x + model.shift + np.log(y.mean() / (1 - y.mean())) - np.log((s := sum(q for _, q in told) / len(told)) / (1 - s)))))
    slope, shift = quality.logistic(x, y.astype(float))
    assert np.isclose(slope, model.slope) and abs((p - y).sum()) < 0.05 and abs(((p - y) * x).sum() + 1e-3 * slope) < 1e-3  # the least loss
    scores = {(r.doc_id, r.text): r.score for r in quality.score_documents(docs, model).collect()}
    for (_, t), score in list(scores.items())[:12]:
        pieces = [t.encode()[i : i + quality.PIECE] for i in range(0, len(t.encode()), quality.PIECE)]
        a, b = (sum(size(p, y) for p in pieces) for y in (1, 0))
        assert np.isclose(score, 1 / (1 + np.exp(-(model.slope * (b - a) / max(a, b, 1) + model.shift))))


def test_quality_learns_from_whole_texts(spark):
    """What tells the labels apart stands at the end of texts that are far longer than their share of a dictionary."""
    rng = random.Random(2)
    noise = lambda n: " ".join(f"w{rng.randrange(10**5)}" for _ in range(n))
    mark = {0: " ".join(f"bad{i} sign" for i in range(150)), 1: " ".join(f"good{i} mark" for i in range(150))}
    rows = [(i, noise(6000) + " " + mark[i % 2]) for i in range(150)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], "doc_id long, quality int, toxic int")
    probe = [(1000 + y, mark[y]) for y in (0, 1)]
    docs = spark.createDataFrame(rows + rows[:30] + probe, "doc_id long, text string")
    got = {r.doc_id: r.score for r in quality.classify(docs, labels).collect()}
    assert got[1001] > got[1000]


def test_heads_of_any_length(spark):
    """What the writer writes the reader reads, and copies of what is left don't grow with the number of records."""
    rows = [(1, "http://x/" + "u" * 70_000, "a" * 2000), (2, "http://x/" + "v" * 300_000, None), (3, None, "a" * 2000), (4, "http://x/y", "b")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r for r in warc.read_archives(warc.write_archives(pages)).collect()}
    assert {i: r["url"] for i, r in got.items()} == {i: u or f"urn:page:{i}" for i, u, _ in rows}
    assert (got[1]["refers_to"], got[3]["record_type"], got[2]["payload_bytes"]) == (3, "response", 0) and all(r["verified"] for r in got.values())
    records = [warc.member(i, f"http://x/{i}", "p" * (i % 50), "d", None) for i in range(3000)]
    data = b"".join(records)
    pa = __import__("pyarrow")
    w = warc._Window(pa.BufferReader(data), 0, len(data))
    w.fill(10)
    whole = w.data
    for r in records[:1000]:
        w.skip(len(r))
        w.fill(10)
    assert w.data is whole  # passing records copies nothing
    assert [raw for _, raw in warc.members(pa.BufferReader(data), len(data), 0, len(data), True)] == [gzip.decompress(r) for r in records]


def test_pivot_tables_link_near_copies_by_themselves(spark, monkeypatch):
    """The pipeline's near-duplicate stage has SimHash's pivot tables: without least-hash keys near copies are still found."""
    import corpus_pipeline as P

    def none(batches, limit):
        yield from ()

    words = [f"w{i * 7919 % 1000}" for i in range(4000)]
    base = " ".join(words)
    texts = [base, base + " end", " ".join(words[:2000]), "one", None]
    made = simhash.fingerprints(texts[:2], P.SHINGLE)[:, 0]
    assert 0 < int(made[0] ^ made[1]).bit_count() <= simhash.TABLE_RADIUS or int(made[0]) == int(made[1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(simhash, "_stars", none)
    monkeypatch.setattr(simhash, "_unconnected", none)
    got = simhash.similar_groups(docs, P.SHINGLE, P.SIMILARITY, P.RADIUS, P.LANES).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4}
