"""Personal data: patterns, and information-theoretic sanitisation of what goes with them.

Base spans come from four patterns (email, ip, card, phone). Their values are the protected entities. A term discloses an
entity as far as knowing that a document has the term makes it certain that it has the entity: with probabilities counted
over all documents, PMI(term; entity) / IC(entity), which is 1 if every document with the term has the entity. Terms whose
disclosure is at least GENERALISE are generalised to a class ([NAME], [CODE] or [TERM]); at REMOVE they are removed,
wherever in a document and in whichever document they stand. A term counts for an entity only if MIN_TEXTS different texts
have both, so that the words of one text, however often it is copied, disclose nothing.

How it scales. One pass over the texts counts the documents of every term, in each task first, and lists the entities and
terms of the documents that have an entity; copies of a text become one row there. Only entities and terms of several
texts go on, and of the terms only those that are rare enough outside of such documents: as p(entity) is at least 1 / N,
p(entity | term) has to be N ** -(1 - GENERALISE) or more. Entities that stand in just the same texts are one class, terms
of the same texts and document count are another, so a document that lists thousands of entities and rare terms gives a
pair of classes and not the product of its lists. Disclosing terms are broadcast to the last pass up to BROADCAST_TERMS of
them; beyond, they are joined to the documents that have them.

Defined results: a null text is an empty one, without spans. Where spans of several kinds overlap, all base spans are
listed, and a term that overlaps one is not; in the sanitised text the span that starts first, then the longer, is
replaced. Rows equal in text are treated alike. An entity that every document has is disclosed by nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .common import Scratch, row_key, short_batches, stored

KINDS = ("email", "ip", "card", "phone")
#: Different texts that must have a term with an entity; code points of a term.
MIN_TEXTS, MIN_TERM = 2, 3
#: Disclosing terms up to which they are broadcast, hashes counted at once, and words whose hash is remembered.
BROADCAST_TERMS, CHUNK, REMEMBERED = 200_000, 1 << 20, 1 << 18
GENERALISE, REMOVE = 0.9, 1.0

#: Characters that don't belong to a term at its ends.
PUNCTUATION = ".,;:!?()[]{}<>\"'*#$%&|"

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match starts at the first digit of a run: what starts later in a run matches only if the run's first digit does.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def emails(text: str) -> list[tuple[int, int]]:
    """From each @ to the left as far as the pattern's characters reach: linear also in texts without blanks."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        left = text[last:at]
        start = last + len(left.rstrip(_LOCAL))
        found = _HOST.match(text, at) if start < at else None
        if found:
            out.append((start, found.end()))
        last = found.end() if found else at + 1
        at = text.find("@", last)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        d = d * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start."""
    if not text:
        return []
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def term_of(word: str) -> str:
    """A word as a term: without punctuation at its ends, in lower case."""
    return word.strip(PUNCTUATION).lower()


def terms(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _WORD.finditer(text):
        t = term_of(m[0])
        if len(t) >= MIN_TERM:
            yield t, *m.span()


def clear_terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """The terms of a text that overlap none of the spans."""
    taken: list[tuple[int, int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if taken and a <= taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    at = 0
    for t, a, b in terms(text):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at == len(taken) or taken[at][0] >= b:
            yield t, a, b


def code_of(term: str) -> int:
    """64 bits, signed, that stand for a term."""
    code = xxhash.xxh3_64_intdigest(term.encode("utf-8", "replace"))
    return code - (code >> 63 << 64)


class _Codes:
    """Codes of the distinct terms of a text; those of words met lately are remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int | None] = {}

    def _code(self, word: str) -> int | None:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        t = term_of(word)
        found = self.known[word] = code_of(t) if len(t) >= MIN_TERM else None
        return found

    def of(self, text: str) -> set[int]:
        known, words = self.known, set(_WORD.findall(text))
        found = {known[w] if w in known else self._code(w) for w in words}
        found.discard(None)
        return found


COUNTED = "k1 long, k2 long, entities array<string>, terms array<long>, term long, n long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, entities and terms of each text that has an entity; term and n, the documents of each term, in parts."""
    codes, held, size = _Codes(), [], 0
    types = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int64())
    names = [f.split()[0] for f in COUNTED.split(", ")]

    def counted() -> pa.RecordBatch:
        of, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([*(pa.nulls(len(of), t) for t in types[:4]), pa.array(of), pa.array(n, pa.int64())], names)

    for batch in batches:
        rows = []
        for text, k1, k2 in zip(*(batch.column(c).to_pylist() for c in ("text", "k1", "k2"))):
            spans = base_spans(text)
            found = {code_of(t) for t in {t for t, _, _ in clear_terms(text, spans)}} if spans else codes.of(text or "")
            held.append(np.fromiter(found, np.int64, len(found)))
            size += len(found)
            if spans:
                rows.append((k1, k2, sorted({f"{kind}:{text[a:b]}" for kind, a, b in spans}), sorted(found), None, None))
            if size > CHUNK:
                yield counted()
                held, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
    if held:
        yield counted()


def disclosing(docs: DataFrame, generalise: float = GENERALISE, min_texts: int = MIN_TEXTS) -> DataFrame:
    """term (its code), disclosure and entity (the one disclosed most) of the terms to be sanitised. docs: text."""
    short_batches(docs.sparkSession)
    space = Scratch(docs.sparkSession)
    counted = space.stored(docs.select("text", *row_key("text")).mapInArrow(_count, COUNTED), "terms-and-entities")
    held = docs.count()
    texts = counted.where("term is null").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    texts = space.stored(texts, "texts-with-entities")
    # equal for two of them if they stand in the same texts
    same = [F.count(F.lit(1)).alias("texts"), *(F.bit_xor(F.xxhash64(F.lit(i), "k1", "k2")).alias(f"x{i}") for i in (1, 2))]
    entities = texts.select("k1", "k2", "copies", F.explode("entities").alias("entity")).groupBy("entity").agg(*same, F.sum("copies").alias("e_docs"))
    entities = space.stored(entities.where((F.col("texts") >= min_texts) & (F.col("e_docs") < held)).withColumn("e_class", F.xxhash64("texts", "x1", "x2")), "entities")
    of_text = texts.select("k1", "k2", "copies", F.explode("entities").alias("entity")).join(entities.select("entity", "e_class"), "entity")
    of_text = space.stored(of_text.groupBy("k1", "k2", "e_class").agg(F.first("copies").alias("copies")), "entities-of-texts")
    some = texts.join(of_text.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", "copies", F.explode("terms").alias("term"))
    some = space.stored(some, "terms-of-texts")
    near = some.groupBy("term").agg(*same, F.sum("copies").alias("least")).where(F.col("texts") >= min_texts)
    docs_of = counted.where("term is not null").groupBy("term").agg(F.sum("n").alias("docs"))
    rare = near.join(docs_of, "term").where(F.col("least") >= F.col("docs") * (max(1, held) ** -(1 - generalise) * (1 - 1e-9)))
    rare = space.stored(rare.select("term", "docs", F.xxhash64("texts", "x1", "x2", "docs").alias("t_class")), "rare-terms")
    t_of_text = some.join(rare.select("term", "t_class"), "term").select("k1", "k2", "t_class").distinct()
    both = of_text.join(t_of_text, ["k1", "k2"]).groupBy("e_class", "t_class").agg(F.sum("copies").alias("both"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= min_texts)
    classes = entities.groupBy("e_class").agg(F.min("entity").alias("entity"), F.first("e_docs").alias("e_docs"))
    rated = both.join(classes, "e_class").join(rare.select("t_class", "docs").distinct(), "t_class")
    p_entity, p_given = F.col("e_docs") / held, F.least(F.col("both") / F.col("docs"), F.lit(1.0))
    rate = F.when(p_given >= 1, F.lit(1.0)).otherwise(1 + F.log(p_given) / -F.log(p_entity))
    rated = rated.withColumn("disclosure", rate).where(F.col("disclosure") >= generalise)
    most = rated.groupBy("t_class").agg(F.max("disclosure").alias("disclosure"), F.min_by("entity", F.struct(-F.col("disclosure"), "entity")).alias("entity"))
    found = stored(rare.select("term", "t_class").join(most, "t_class").select("term", "disclosure", "entity"), "disclosing-terms")
    space.clear()
    return found


def _label(word: str, rate: float) -> str:
    if rate >= REMOVE:
        return ""
    return "[CODE]" if _DIGIT.search(word) else "[NAME]" if word[:1].isupper() else "[TERM]"


def sanitised(text: str, spans: list[tuple[str, int, int]], rates: dict[str, float]) -> str:
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < last:
            continue
        out += [text[last:a], f"[{kind.upper()}]" if kind in KINDS else _label(text[a:b], rates.get(term_of(text[a:b]), 0.0))]
        last = b
    return "".join([*out, text[last:]])


SPAN = ArrayType(StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())]))


def _scan(batches: Iterator[pa.RecordBatch], text: str, with_text: bool, known: dict[int, float] | None) -> Iterator[pa.RecordBatch]:
    """known: disclosures by a term's code, or null if each row brings its own."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    codes = _Codes()
    for batch in batches:
        found, made = [], []
        own = batch.column("__risky").to_pylist() if known is None else [None] * batch.num_rows
        for t, risky in zip(batch.column(text).to_pylist(), own):
            t = t or ""
            spans = base_spans(t)
            rates: dict[str, float] = {}
            rated = {r["term"]: r["disclosure"] for r in risky or ()} if known is None else known
            if rated and not rated.keys().isdisjoint(codes.of(t)):
                for w, a, b in list(clear_terms(t, spans)):
                    if (rate := rated.get(code_of(w))) is not None:
                        rates[w] = rate
                        spans.append(("term", a, b))
            found.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            made.append(sanitised(t, spans, rates) if with_text else None)
        keep = [i for i, n in enumerate(batch.schema.names) if n not in ("__risky", text)]
        columns, names = [batch.column(i) for i in keep], [batch.schema.names[i] for i in keep]
        if with_text:
            columns, names = [*columns, pa.array(made, pa.string())], [*names, text]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(found, kind)], [*names, "spans"])


def _occurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    codes = _Codes()
    for batch in batches:
        found = [sorted(codes.of(t or "")) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(found, pa.list_(pa.int64()))], ["k1", "k2", "terms"])


def _with_terms(docs: DataFrame, text: str, risky: DataFrame) -> DataFrame:
    """docs with __risky, the disclosing terms of each text: for more of them than are broadcast."""
    listed = docs.select(F.col(text).alias("text"), *row_key(text)).mapInArrow(_occurring, "k1 long, k2 long, terms array<long>")
    narrow = listed.select("k1", "k2", F.explode("terms").alias("term")).join(risky.select("term", "disclosure"), "term")
    per_text = narrow.groupBy("k1", "k2").agg(F.collect_set(F.struct("term", "disclosure")).alias("__risky"))
    per_text = stored(per_text, "risky-documents").toDF("__k1", "__k2", "__risky")
    keys = row_key(text)
    keyed = docs.withColumns({"__k1": keys[0], "__k2": keys[1]})
    return keyed.join(per_text.hint("shuffle_hash"), ["__k1", "__k2"], "left").drop("__k1", "__k2")


def sanitise(docs: DataFrame, text: str = "text", with_text: bool = True, broadcast_terms: int = BROADCAST_TERMS, **how) -> DataFrame:
    """docs with spans (kind, start, end; code points) and, if asked for, the sanitised text in place of the text."""
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.drop("spans")
    risky = disclosing(docs.select(F.col(text).alias("text")), **how)
    fields = [f for f in docs.schema.fields if f.name != text] + ([StructField(text, StringType())] if with_text else [])
    schema = StructType([*fields, StructField("spans", SPAN)])
    if risky.count() > broadcast_terms:
        return _with_terms(docs, text, risky).mapInArrow(lambda b: _scan(b, text, with_text, None), schema)
    sent = spark.sparkContext.broadcast({r["term"]: r["disclosure"] for r in risky.select("term", "disclosure").collect()})
    return docs.mapInArrow(lambda b: _scan(b, text, with_text, sent.value), schema)


def joined_spans(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
