"""The pipeline's stages against plain versions of them: each on all its predecessor kept, with its decisions in effect."""

import hashlib
from collections import Counter

import corpus_pipeline as P
import numpy as np
import pytest
import zstandard

from kgloom.llm import bpe, quality
from kgloom.llm.common import stored, table

BLANK = " \t\n\x0b\f\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def bag(text, n=5):
    ws = lower(text or "").encode().split()
    if len(ws) < n:
        return Counter([tuple(ws)] if ws else [])
    return Counter(zip(*(ws[i:] for i in range(n))))


def alike(a, b):
    common = sum((a & b).values())
    return common / max(1, sum(a.values()) + sum(b.values()) - common)


def cosine(a, b):
    return sum((a & b).values()) / max(1, sum(a.values()) * sum(b.values())) ** 0.5


def plain_quality(rows, model):
    """The stored model's dictionaries and curve, by a compressor made for every piece."""
    out = []
    for r in rows:
        raw, sizes = (r.text or "").encode(), []
        for content in (model.good, model.bad):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=quality.LEVEL)
            c = zstandard.ZstdCompressor(level=quality.LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes.append(sum(len(c.compress(raw[i : i + quality.PIECE])) - quality.FRAME for i in range(0, len(raw), quality.PIECE)))
        x = (sizes[1] - sizes[0]) / max(*sizes, 1) if raw else 0.0
        if 1 / (1 + np.exp(-(model.slope * x + model.shift))) >= quality.THRESHOLD:
            out.append(tuple(r))
    return out


def plain_lines(rows):
    lines = [(r.text or "").split("\n") for r in rows]
    keys = [[lower(x.strip(BLANK)) for x in d] for d in lines]
    documents = {}
    for i, (r, d) in enumerate(zip(rows, keys)):
        for k in set(d):
            documents.setdefault(k, set()).add(("id", r.doc_id) if r.doc_id is not None else ("row", i))
    bad = {k for k, of in documents.items() if k and len(of) >= 10}
    texts = ["\n".join(x for x, k in zip(d, ks) if k not in bad) for d, ks in zip(lines, keys)]
    return [(r.doc_id, t, r.lang, r.source, len(t)) for r, t in zip(rows, texts)]


def plain_near(rows):
    bags = [bag(r.text) for r in rows]
    root = list(range(len(rows)))
    for i, x in enumerate(bags):
        for j in range(i):
            if root[i] != root[j] and (not x and not bags[j] or x and cosine(x, bags[j]) >= 0.8 - 1e-9):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    kept = {}
    for r, at in zip(rows, root):
        if at not in kept or r.doc_id < kept[at].doc_id:
            kept[at] = r
    return [tuple(r) for r in kept.values()]


def plain_clean(rows, items):
    out = []
    wanted = [(len(lower(t).split()), bag(t)) for _, t in items]
    for r in rows:
        ws = lower(r.text or "").encode().split()
        sh = list(zip(*(ws[i:] for i in range(5))))
        known = {s for _, b in wanted for s in b}
        if not any(s in known for s in sh):
            out.append(tuple(r))
            continue
        if not any(alike(Counter(sh[s : s + size - 4]), b) >= 0.8 for size, b in wanted if size >= 5 for s in range(len(sh))):
            out.append(tuple(r))
    return out


def rows_of(df):
    return sorted(map(tuple, df.select(P.COLUMNS).collect()), key=str)


@pytest.fixture(scope="module")
def kept(spark, small):
    """Stage by stage: what each was given and what it gave."""
    docs, out = table(spark, small, "documents"), []
    for name, stage in P.STAGES[:-1]:
        after = stored(stage(spark, docs, small), name.replace(" ", "-"))
        assert after.columns == P.COLUMNS
        out.append((docs, after))
        docs = after
    return out


def test_quality_stage(spark, small, kept):
    before, after = kept[0]
    model = quality.train(before, table(spark, small, "labels"))
    assert rows_of(after) == sorted(plain_quality(before.select(P.COLUMNS).collect(), model), key=str)
    assert 0 < after.count() < before.count()


def test_line_stage(kept):
    before, after = kept[1]
    assert rows_of(after) == sorted(plain_lines(before.select(P.COLUMNS).collect()), key=str)


def test_near_duplicate_stage(kept):
    before, after = kept[2]
    assert rows_of(after) == sorted(plain_near(before.select(P.COLUMNS).collect()), key=str)
    assert after.count() < before.count()


def test_decontamination_stage(spark, small, kept):
    before, after = kept[3]
    items = [(r.item_id, r.text) for r in table(spark, small, "benchmark").collect()]
    assert rows_of(after) == sorted(plain_clean(before.select(P.COLUMNS).collect(), items), key=str)


def test_encoding_stage_and_run(spark, small, kept):
    import tiktoken

    told = tiktoken.Encoding("own", pat_str=bpe.default_pattern(), mergeable_ranks=bpe.load_ranks(bpe.default_path()), special_tokens={})
    got = {r.doc_id: r for r in P.run(spark, small).collect()}
    rows = kept[3][1].collect()
    assert got.keys() == {r.doc_id for r in rows}
    for r in rows:
        ids = told.encode_ordinary(r.text)
        assert list(got[r.doc_id].ids) == ids and got[r.doc_id].n_tokens == len(ids)
        assert got[r.doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[r.doc_id].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()


def test_stages_on_odd_rows(spark, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long, predicted string"
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (1, "", "en", "s", 0, "x"), (2, "a b c d e f g", "en", "s", 13, None), (3, "a b c d e f g", None, None, None, "x")]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in P.STAGES:
            got = stage(spark, docs, small)
            assert got.count() <= len(data)
            docs = got if stage is not P.encode else docs
    docs = spark.createDataFrame(rows, schema)
    assert rows_of(P.dedup_documents(spark, docs, small)) == sorted([(1, "", "en", "s", 0), (2, "a b c d e f g", "en", "s", 13)], key=str)
    assert P.dedup_lines(spark, docs, small).count() == P.encode(spark, docs, small).count() == len(rows)


def test_near_duplicates_go_by_exact_similarity(spark, small):
    """Of 304 words, the first 196 have 192 of the 300 shingles (192 over the root of 192 * 300: 0.8), the first 195 one fewer."""
    texts = [[f"d{i}w{j}" for j in range(304)] for i in range(60)]
    rows = [(2 * i + k, " ".join(ws[:n]), "en", "s", 1) for i, ws in enumerate(texts) for k, n in enumerate((304, 196 if i % 2 else 195))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in P.dedup_documents(spark, docs, small).collect()}
    assert got == {r[0] for r in rows} - {2 * i + 1 for i in range(1, 60, 2)}
