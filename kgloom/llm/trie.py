"""The prefix trie of conversations: one row for each distinct beginning, with the tokens that sharing it saves.

Patricia construction. Conversations become sequences of turn digests, are dealt by range and sorted. One pass over a
sorted range keeps the open path on a stack and makes points only where conversations branch, end or have no
continuation; counts are summed on points, and the unary nodes of an edge are written out when its point is closed: an
edge's nodes have the same members, so only saved_tokens differs along it, by the suffix sum of the edge's lengths.

All sums are over members alone, given what each has in common with its predecessor in the sorted order: the tokens
saved below a node are the shared lengths of its members without the way to the node. So nodes whose members lie in
several ranges (they begin the first or the last conversation of a range) are summed up from their parts, and what
the two conversations at a border have in common is corrected afterwards. A hot beginning, turn or conversation is
split over as many ranges as it fills. A task holds one path, HELD ids and HELD rows for each point of it.

What comes together in one place: the turns of one conversation, as 40 bytes each (never their texts); two conversations
for each range, in a task that compares neighbours; the ids of conversations that are equal, if they touch a border or are
many, which stream through one task in order, because the digest asked for is one chain.

Defined results: rows without conv_id take no part. Turns are ordered by turn, null first, then by role and text; null role
or text is empty; repeated rows are turns of their own. Other columns are ignored. An empty table has no root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import steady, stored

#: Turns of a conversation that may come from the first one of its hundred, and the size of a hundred.
HEADS, HUNDRED = 6, 100
#: Ids or rows that wait at a point before they are written with a reference to it.
HELD = 10_000
BATCH = 20_000
#: Bytes of a turn's digest.
DIGEST = 16
NO_ENDS = hashlib.sha256(b"").hexdigest()

NODE, PART, END, BORDER = range(4)
_SCHEMA = pa.schema([("kind", pa.int32()), ("prefix", pa.binary()), ("parent", pa.binary()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("shared", pa.int64()), ("above", pa.int64()), ("ends_sha256", pa.string()), ("first", pa.binary()), ("last", pa.binary()), ("lengths", pa.list_(pa.int64()))])
_DDL = "kind int, prefix binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, shared long, above long, ends_sha256 string, first binary, last binary, lengths array<long>"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and its turns in order: digest of role and text (hex), code points of the text."""
    rows = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    digest = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"))
    turns = rows.select("conv_id", place.alias("place"), digest.alias("digest"), F.char_length("text").cast("long").alias("length"))
    return turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "digest", "length"))).alias("turns"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """Every conversation with its first h turns taken from the first one of its hundred: conv_id, key, lengths.

    h = crc32(decimal conv_id) mod 6. A key is the digests of all turns in a row.
    """
    own = ordered_turns(conversations)
    cid = F.col("conv_id")
    h = (F.crc32(cid.cast("string").cast("binary")) % HEADS).cast("int")
    heads = own.where(cid % HUNDRED == 0).select(cid.alias("base"), F.slice("turns", 1, HEADS - 1).alias("head"))
    both = own.withColumns({"base": cid - cid % HUNDRED, "h": h}).join(heads, "base", "left")
    none = F.slice("turns", 1, 0)
    turns = F.concat(F.slice(F.coalesce("head", none), F.lit(1), F.col("h")), F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1))))
    key = F.unhex(F.array_join(F.transform("all", lambda t: t["digest"]), ""))
    return both.select(cid, turns.alias("all")).select("conv_id", key.alias("key"), F.transform("all", lambda t: t["length"]).alias("lengths"))


def in_common(a: bytes, b: bytes) -> int:
    """Turns that two keys have in common at their beginnings."""
    low, high = 0, min(len(a), len(b)) // DIGEST
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * DIGEST : mid * DIGEST] == b[low * DIGEST : mid * DIGEST]:
            low = mid
        else:
            high = mid - 1
    return low


def _prefixes(key: bytes) -> list[bytes]:
    """A name for each beginning of a key, from the empty one to the whole."""
    h = xxhash.xxh3_128()
    out = [h.digest()]
    for at in range(0, len(key), DIGEST):
        h.update(key[at : at + DIGEST])
        out.append(h.digest())
    return out


def _name(key: bytes, depth: int) -> bytes:
    return xxhash.xxh3_128_digest(key[: depth * DIGEST])


@dataclass
class _Point:
    depth: int
    begins: bool  # the range's first conversation is a member
    n: int = 0
    least: int | None = None
    shared: int = 0
    children: int = 0
    leaves: int = 0
    ends: list[int] = field(default_factory=list)
    ends_out: bool = False  # ids of ends are rows of their own
    named: bool = False  # rows refer to it by name
    waiting: list[tuple] = field(default_factory=list)


class _Range:
    """The trie of one sorted range."""

    def __init__(self, held: int = HELD) -> None:
        self.held = held
        self.out: list[list] = [[] for _ in _SCHEMA]
        self.stack = [_Point(0, True)]
        self.key, self.sums, self.first = b"", [0], None  # of the row before

    def put(self, kind: int, **values) -> None:
        for column, f in zip(self.out, _SCHEMA, strict=True):
            column.append(kind if f.name == "kind" else values.get(f.name))

    def batch(self) -> pa.RecordBatch:
        made = pa.record_batch([pa.array(c, f.type) for c, f in zip(self.out, _SCHEMA, strict=True)], schema=_SCHEMA)
        self.out = [[] for _ in _SCHEMA]
        return made

    def add(self, conv_id: int, key: bytes, lengths: list[int]) -> None:
        sums = [0, *accumulate(lengths)]
        common = in_common(self.key, key)
        stack = self.stack
        if self.first is None:
            self.first = (key, lengths)
        else:
            while stack[-1].depth > common:
                top = stack.pop()
                if stack[-1].depth < common:
                    stack.append(_Point(common, top.begins))
                self.close(top, stack[-1])
            stack[-1].shared += sums[common]
        t = len(lengths)
        if stack[-1].depth < t:
            stack.append(_Point(t, key == self.first[0]))
        top = stack[-1]
        top.n += 1
        top.least = conv_id if top.least is None else min(top.least, conv_id)
        self.key, self.sums = key, sums
        top.ends.append(conv_id)
        if len(top.ends) >= self.held:
            self.name_ends(top)

    def name_ends(self, p: _Point) -> None:
        p.named = p.ends_out = True
        name = _name(self.key, p.depth)
        for c in p.ends:
            self.put(END, prefix=name, conv_id=c)
        p.ends.clear()

    def name_waiting(self, p: _Point) -> None:
        p.named, name = True, _name(self.key, p.depth)
        for row in p.waiting:
            self.node(row, parent=name)
        p.waiting.clear()

    def node(self, row: tuple, **more) -> None:
        name, least, depth, n, children, leaves, shared, above, ends = row
        self.put(NODE, prefix=name, conv_id=least, depth=depth, n_convs=n, n_children=children, n_leaves=leaves, shared=shared, above=above, ends_sha256=ends, **more)

    def close(self, p: _Point, onto: _Point | None, last: bool = False) -> None:
        """Writes the nodes of p's edge and hands its sums to the point above. The row before is a member of p."""
        if not p.children and p.depth:
            p.leaves = 1
        part = p.begins or last
        touches = part and (last and len(self.key) == p.depth * DIGEST or self.first[0] == self.key[: p.depth * DIGEST])
        if p.ends and (touches or p.ends_out):
            self.name_ends(p)
        if part and p.waiting:
            self.name_waiting(p)
        named = p.named
        ends = None if p.ends_out else hashlib.sha256(",".join(map(str, p.ends)).encode()).hexdigest()
        above = onto.depth if onto else -1
        if part:
            names = _prefixes(self.key[: p.depth * DIGEST])
            for d in range(p.depth, above, -1):
                at = d == p.depth
                self.put(PART, prefix=names[d], parent=names[d - 1] if d else None, conv_id=p.least, depth=d, n_convs=p.n, n_children=p.children if at else 1, n_leaves=p.leaves, shared=p.shared, above=self.sums[max(d - 1, 0)], ends_sha256=ends if at else NO_ENDS)
        else:
            name = _name(self.key, p.depth) if named else None
            rows = [(name, p.least, p.depth, p.n, p.children, p.leaves, p.shared, self.sums[p.depth - 1], ends)]
            rows += [(None, p.least, d, p.n, 1, p.leaves, p.shared, self.sums[d - 1], NO_ENDS) for d in range(p.depth - 1, above, -1)]
            for row in rows[:-1]:
                self.node(row, parent_conv_id=p.least)
            for row in p.waiting:
                self.node(row, parent_conv_id=p.least)
            onto.waiting.append(rows[-1])
        if onto:
            onto.n += p.n
            onto.least = p.least if onto.least is None else min(onto.least, p.least)
            onto.shared += p.shared
            onto.children += 1
            onto.leaves += p.leaves
            if len(onto.waiting) >= self.held:
                self.name_waiting(onto)

    def end(self, number: int) -> None:
        if self.first is None:
            return
        self.put(BORDER, depth=number, first=self.first[0], last=self.key, lengths=self.first[1])
        while self.stack:
            top = self.stack.pop()
            self.close(top, self.stack[-1] if self.stack else None, last=True)


def _tries(held: int) -> Callable:
    """For mapInArrow over sorted (conv_id, key, lengths)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Range(held)
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                made.add(*row)
                if len(made.out[0]) >= BATCH:
                    yield made.batch()
        made.end(TaskContext.get().partitionId())
        yield made.batch()

    return run


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over the (first, last, lengths) of all ranges in order: what both sides of a border have counted."""
    made, before = _Range(), None
    for b in batches:
        for first, last, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if before is not None:
                common = in_common(before, first)
                names, shared = _prefixes(first[: common * DIGEST]), sum(lengths[:common])
                leaf = common > 0 and len(before) == common * DIGEST
                for d, name in enumerate(names):
                    made.put(PART, prefix=name, depth=d, n_convs=0, n_children=-(d < common), n_leaves=-leaf, shared=shared)
            before = last
            if len(made.out[0]) >= BATCH:
                yield made.batch()
    yield made.batch()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow over sorted (prefix, conv_id): the digest of each prefix's ids, one after the other."""
    at, chain = None, None
    schema = pa.schema([("prefix", pa.binary()), ("digest", pa.string())])
    for b in batches:
        out = []
        for prefix, conv_id in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if prefix == at:
                chain.update(b",%d" % conv_id)
                continue
            if at is not None:
                out.append((at, chain.hexdigest()))
            at, chain = prefix, hashlib.sha256(b"%d" % conv_id)
        if out:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    if at is not None:
        yield pa.record_batch([pa.array([at], pa.binary()), pa.array([chain.hexdigest()])], schema=schema)


def prefix_trie(sequences: DataFrame, held: int = HELD) -> DataFrame:
    """Nodes of the trie over (conv_id, key, lengths): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    steady(sequences.sparkSession)
    ordered = stored(sequences.select("conv_id", "key", "lengths"), "sequences").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    parts = stored(ordered.mapInArrow(_tries(held), _DDL), "trie-parts")

    borders = parts.where(F.col("kind") == BORDER).select("depth", "first", "last", "lengths").repartition(1).sortWithinPartitions("depth")  # one row for each range
    corrected = borders.select("first", "last", "lengths").mapInArrow(_corrections, _DDL)
    open_parts = parts.where(F.col("kind") == PART).unionByName(corrected)
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "shared")]
    merged = open_parts.groupBy("prefix").agg(F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), *sums, F.max("above").alias("above"), F.max(F.nullif("ends_sha256", F.lit(NO_ENDS))).alias("ends_sha256"))
    ids = parts.where(F.col("kind") == END).select("prefix", "conv_id").repartition("prefix").sortWithinPartitions("prefix", "conv_id")
    digests = ids.mapInArrow(_digests, "prefix binary, digest string")

    columns = ["prefix", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "shared", "above", "ends_sha256"]
    nodes = parts.where(F.col("kind") == NODE)
    referred = nodes.where("prefix is not null").select(columns).unionByName(merged.withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns))
    referred = stored(referred.join(digests, "prefix", "left").withColumn("ends_sha256", F.coalesce("digest", "ends_sha256", F.lit(NO_ENDS))).select(columns), "trie-points")
    rows = nodes.where("prefix is null").select(columns).unionByName(referred)
    parents = referred.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("of_parent"))
    found = rows.where("parent is not null").drop("parent_conv_id").join(parents, "parent", "left").withColumnRenamed("of_parent", "parent_conv_id").select(columns)
    return _result(rows.where("parent is null").unionByName(found))


def _result(rows: DataFrame) -> DataFrame:
    leaves: Column = F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves"))
    saved = F.col("shared") - (F.col("n_convs") - 1) * F.col("above")
    return rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", leaves.cast("long").alias("n_leaves"), saved.cast("long").alias("saved_tokens"), "ends_sha256")
