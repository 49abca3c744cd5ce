"""Chunking of documents: grouping, packing, splitting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from kgloom.functions import text as T
from kgloom.shared import shared_dir, spread

# Words are estimated at 0.75 tokens each; characters of a chunk and of its overlap.
WORDS_PER_TOKEN = 0.75
CHUNK_CHARS, OVERLAP_CHARS = 1000, 200


def classified(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_tokens and size_class."""
    return spread(docs).withColumn("n_tokens", T.token_count(F.col(text))).withColumn("size_class", T.size_class(F.col("n_tokens")))


class Packer:
    """Greedy packing as a fold over token counts: 0 stands for "no open pack", 1 + h for an open one that holds h tokens.

    Packs that were begun and the place in the open pack only add up, so a stretch of documents is told by what it makes
    of each state it may be entered in. A document that isn't short makes all states one.
    """

    def __init__(self, min_tokens: int):
        self.min_tokens = min_tokens

    def step(self, state: int, begun: int, place: int, n: int, short: bool) -> tuple[int, int, int]:
        """After one more document: its pack is the last begun, its place the last."""
        if not short or state == 0:
            begun, place, held = begun + 1, 0, n
        else:
            place, held = place + 1, state - 1 + n
        return (0 if not short or held >= self.min_tokens else 1 + held), begun, place

    def summary(self, counts: list[int], short: list[bool]) -> list[tuple[int, int, int, bool]]:
        """For each state: the one after the documents, packs begun, place of the last, and whether any was begun."""
        met: dict[tuple[int, int, int], tuple[int, int]] = {}  # place and state, to the entry that was there first and its packs
        rows: list[tuple[int, int, int, bool]] = []
        for entry in range(self.min_tokens + 1):
            state, begun, place = entry, 0, -1
            trail = []
            for i, (n, s) in enumerate(zip(counts, short)):
                state, begun, place = self.step(state, begun, place, n, s)
                if begun and (i, state, place) in met:
                    other, b = met[i, state, place]
                    end = rows[other]
                    state, begun, place = end[0], end[1] - b + begun, end[2]
                    break
                if begun:
                    trail.append(((i, state, place), begun))
            rows.append((state, begun, place, begun > 0))
            met.update({at: (entry, b) for at, b in trail if at not in met})
        return rows


def packs(docs: DataFrame, domain: str, order: str, min_tokens: int = T.MIN_TOKENS) -> DataFrame:
    """domain, order, n_tokens, size_class, pack and pack_pos of every document: greedy packing within each domain.

    Short documents are gathered until they have min_tokens; any other document closes the pack before it and is one of
    its own. The sum begins anew with each pack, which no window frame can express, so it is a fold over token counts,
    never over texts. Rows are dealt by ranges of (domain, order), so that a domain of any size is many tasks; what a
    range makes of each state at its ends (one state for every token below min_tokens) is composed on the driver, two
    summaries for each range, and each range then numbers its own. order has to be unique within a domain.
    """
    shared_dir(docs.sparkSession)
    narrow = classified(docs).select(F.col(domain).alias("domain"), F.col(order).alias("order"), "n_tokens", "size_class")
    dealt = narrow.repartitionByRange("domain", "order").sortWithinPartitions("domain", "order").checkpoint()
    packer = Packer(min_tokens)
    ends = _entered(dealt.mapInArrow(lambda b: _summaries(b, packer), "part int, side int, domain string, summary array<struct<state:int,begun:long,place:long,any:boolean>>").collect())
    schema = StructType([*dealt.schema.fields, StructField("pack", LongType()), StructField("pack_pos", LongType())])
    return dealt.mapInArrow(lambda b: _numbers(b, packer, ends), schema).withColumnsRenamed({"domain": domain, "order": order})


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Table]]:
    """The rows of each domain of a sorted partition; names are told apart from null. Only counts are held."""
    whole = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if whole is None:
        return
    names = [repr(x) for x in whole.column("domain").to_pylist()]
    cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
    for a, b in zip(cuts, cuts[1:]):
        yield names[a], whole.slice(a, b - a)


def _counts(rows: pa.Table) -> tuple[list[int], list[bool]]:
    return rows.column("n_tokens").to_pylist(), [c == "short" for c in rows.column("size_class").to_pylist()]


def _summaries(batches: Iterator[pa.RecordBatch], packer: Packer) -> Iterator[pa.RecordBatch]:
    """Summaries of the first and the last domain of the partition."""
    part, found = TaskContext.get().partitionId(), list(_stretches(batches))
    at = [(0, found[0])] + ([(1, found[-1])] if len(found) > 1 else []) if found else []
    kind = pa.list_(pa.struct([("state", pa.int32()), ("begun", pa.int64()), ("place", pa.int64()), ("any", pa.bool_())]))
    rows = [(part, side, name, [dict(zip(("state", "begun", "place", "any"), x)) for x in packer.summary(*_counts(t))]) for side, (name, t) in at]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.string(), kind))], ["part", "side", "domain", "summary"])


def _entered(summaries: list) -> dict[tuple[int, int], tuple[int, int, int]]:
    """(partition, side) -> state, packs begun and place before the first document of the stretch."""
    out, name, now = {}, None, (0, 0, -1)
    for r in sorted(summaries, key=lambda r: (r["part"], r["side"])):
        if r["domain"] != name:
            name, now = r["domain"], (0, 0, -1)
        out[r["part"], r["side"]] = now
        end = r["summary"][now[0]]
        # the place goes on from that of the open pack if none was begun; places of a stretch start at -1
        now = (end["state"], now[1] + end["begun"], end["place"] if end["any"] else now[2] + 1 + end["place"])
    return out


def _numbers(batches: Iterator[pa.RecordBatch], packer: Packer, ends: dict) -> Iterator[pa.RecordBatch]:
    part, found = TaskContext.get().partitionId(), list(_stretches(batches))
    for i, (_, rows) in enumerate(found):
        state, begun, place = ends.get((part, 0 if i == 0 else 1), (0, 0, -1)) if i in (0, len(found) - 1) else (0, 0, -1)
        made = []
        for n, short in zip(*_counts(rows)):
            state, begun, place = packer.step(state, begun, place, n, short)
            made.append((begun - 1, place + 1))
        out = rows.append_column("pack", pa.array([p for p, _ in made], pa.int64())).append_column("pack_pos", pa.array([p for _, p in made], pa.int64()))
        yield from out.to_batches()


def packed(docs: DataFrame, domain: str, order: str, min_tokens: int = T.MIN_TOKENS) -> DataFrame:
    """docs with n_tokens, size_class, pack and pack_pos, as `packs` gives them."""
    found = packs(docs, domain, order, min_tokens).withColumnsRenamed({domain: "__domain", order: "__order"})
    here = F.col(domain).eqNullSafe(F.col("__domain")) & F.col(order).eqNullSafe(F.col("__order"))
    return docs.drop("n_tokens", "size_class", "pack", "pack_pos").join(found, here).drop("__domain", "__order")


def chunk_line(title: Column, text: Column) -> Column:
    """A line of a packed chunk: the title in brackets before the text, if there is one."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("["), title, F.lit("] "), text)).otherwise(text)


def packed_chunks(docs: DataFrame, domain: str, order: str, title: Column | None = None) -> DataFrame:
    """Chunks of short and normal documents: domain, pack, text, source_ids, title of the first."""
    title = F.lit(None).cast("string") if title is None else title
    rows = packed(docs, domain, order).where("size_class <> 'long'")
    line = F.struct(F.col(order).alias("o"), chunk_line(title, F.col("text")).alias("line"), title.alias("title"))
    grouped = rows.groupBy(domain, "pack").agg(F.sort_array(F.collect_list(line)).alias("lines"))  # a pack is bounded by its tokens
    return grouped.select(domain, "pack", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"), F.transform("lines", lambda x: x["o"]).alias("source_ids"), F.coalesce(F.col("lines")[0]["title"], F.lit("")).alias("title"))


def split_long(docs: DataFrame, order: str, title: Column | None = None, max_tokens: int = T.MAX_TOKENS, overlap: int = T.OVERLAP_TOKENS) -> DataFrame:
    """Overlapping chunks of words: order, chunk_no, start_word, text. A text without words gives none."""
    size, lap = int(max_tokens / WORDS_PER_TOKEN), int(overlap / WORDS_PER_TOKEN)
    stride = size - lap
    if stride <= 0:
        raise ValueError("the overlap has to be smaller than a chunk")
    words = docs.withColumn("__words", T._words(F.col("text"))).where(F.size("__words") > 0)
    rows = words.withColumn("start_word", F.explode(F.sequence(F.lit(0), F.size("__words") - 1, F.lit(stride))))
    text = F.array_join(F.slice("__words", F.col("start_word") + 1, F.lit(size)), " ")
    return rows.select(F.col(order), (F.col("start_word") / stride).cast("int").alias("chunk_no"), "start_word", chunk_line(F.lit(None).cast("string") if title is None else title, text).alias("text"))


def preprocessed(docs: DataFrame, domain: str, order: str) -> DataFrame:
    """All chunks: packed ones and those of long documents. chunk_id is a digest of what the chunk is made of."""
    short = packed_chunks(docs, domain, order).select(domain, "text", F.transform("source_ids", lambda x: x.cast("string")).alias("source_ids"), F.lit(0).alias("part"))
    long = classified(docs).where("size_class = 'long'")
    pieces = split_long(long, order).join(long.select(order, domain), order).select(domain, "text", F.array(F.col(order).cast("string")).alias("source_ids"), F.col("chunk_no").alias("part"))
    both = short.unionByName(pieces)
    digest = F.substring(F.sha2(F.concat_ws("|", F.col(domain), F.array_join("source_ids", ","), F.col("part").cast("string")), 256), 1, 8)
    return both.withColumn("chunk_id", F.concat(F.lit("chunk-"), digest))


def char_windows(docs: DataFrame, order: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Windows of fixed width: order, start_index, text. The last one ends with the text."""
    stride = size - overlap
    last = F.greatest(F.length("text") - 1 - overlap, F.lit(0))
    rows = docs.where(F.length("text") > 0).withColumn("start_index", F.explode(F.sequence(F.lit(0), last, F.lit(stride))))
    return rows.select(order, F.col("start_index").cast("long").alias("start_index"), F.substr(F.col("text"), F.col("start_index") + 1, F.lit(size)).alias("text"))


SEPARATORS = ("\n\n", "\n", " ", "")


def split_text(text: str, size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> Iterator[tuple[int, str]]:
    """Start and text of chunks of at most `size` characters that end, if they can, at a paragraph, a line or a blank.

    Of the chunk before, as much as fits into `overlap` is repeated, from a blank on.
    """
    start, n = 0, len(text)
    while start < n:
        end = min(n, start + size)
        if end < n:
            for sep in SEPARATORS[:-1]:
                at = text.rfind(sep, start + size // 2, end)
                if at > start:
                    end = at + len(sep)
                    break
        piece = text[start:end]
        if bare := piece.strip():
            yield start + len(piece) - len(piece.lstrip()), bare
        if end >= n:
            return
        back = max(start + 1, end - overlap)
        blank = text.find(" ", back, end)
        start = blank + 1 if blank >= 0 else back


def char_split(docs: DataFrame, keys: list[str], text: str = "text", size: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """Recursive character split: keys, start_index, text. Built-in functions can't search backwards from a place."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keys).schema.fields) + ", start_index long, text string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(*row[:-1], a, t) for row in frame.itertuples(index=False) for a, t in split_text(row[-1] or "", size, overlap)]
            yield pd.DataFrame(rows, columns=[*keys, "start_index", "text"])

    return docs.select(*keys, F.col(text).alias("text")).mapInPandas(run, schema)


def numbered(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """Gapless numbers from 0 in the given total order, without one task for all rows.

    Rows are dealt by ranges of the order and checkpointed, so that every later step sees the same ranges; a partition's
    numbers start after the rows of those before it, whose counts (one number for each) are all that passes the driver.
    """
    shared_dir(df.sparkSession)
    kept = df.repartitionByRange(*map(F.col, order)).sortWithinPartitions(*order).checkpoint().withColumn("__at", F.monotonically_increasing_id())
    # the number's upper bits are the partition's, the lower 33 the row's place in it
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r["part"]: r["n"] for r in kept.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(counts):
        starts += [F.lit(p), F.lit(total).cast("long")]
        total += counts[p]
    first = F.element_at(F.create_map(*starts), part) if starts else F.lit(0).cast("long")
    return kept.withColumn(name, (first + place).cast("long")).drop("__at")
