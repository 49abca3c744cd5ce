"""Near-duplicate groups by SimHash.

Fingerprints. XXH64 (seed 42) of every word shingle, repeats included; a bit is 1 if it is set in over half of them.

Links, exact (radius up to 2). The Hamming distances of a fingerprint to reference fingerprints (pivots) are its
coordinates: two fingerprints at distance d differ by at most d in every coordinate. The first pivots are 0 and one mask
for each block of BLOCK bits; distance to 0 less distance to a mask gives the ones in that block. Fingerprints at distance
2 or less differ by 2 or less in the sum over all blocks, so some cell of block counts is at most one step from both: each
fingerprint is dealt to its own cell and to those one step away, and each pair within the radius meets. In a cell, pairs
are discarded whose coordinates to further random pivots differ by more than the radius, and survivors are verified. With
blocks of three bits the fullest cell of N different random fingerprints holds about N * 5e-8 of them.

Links, by similarity of shingles. Two texts are linked if their shingles have a cosine similarity of at least `similarity`:
what they have in common over the root of the product of their numbers. That is the similarity which SimHash estimates by
its bits; a repeat of a shingle is an element of its own, so that texts are sets. It is computed exactly. Texts are dealt to
BANDS tables keyed by the least values of BAND_ROWS hash functions over the elements. A pair that shares a part j of all its
elements shares no key with probability (1 - j ** BAND_ROWS) ** BANDS: of two texts of one length j is 2/3 at 0.8, where
that is 0.0004; if one text is part of the other, j is 0.64 and it is 0.0014. Pivot coordinates can't replace these keys:
at 0.8 fingerprints of 256 bits are 52 bits apart, with a deviation of 6, and the coordinates of unrelated ones differ by
less than that, so the tables would discard next to nothing and every pair of documents would have to be verified. So the
tables find what is within TABLE_RADIUS bits of the fingerprint's first word, as above, and these links are verified like
the others; the keys go beyond them, to what the similarity allows and the tables can't reach.

In a cell the middle fingerprint is the pivot: members whose fingerprints differ from it by more than the radius are
discarded, the others are verified, and links found are contracted, which leaves little of a group of near copies. A cell
of more than MIDDLE fingerprints is dealt to parts of that size, each with a pivot of its own, and the pivots of the parts
meet in the cell. Cells
that hold several components then still have to be compared outside of them. In a cell of more than CELL sets, the largest
component is the trunk; the others are dealt to blocks, and each block is compared to every block of the trunk and of the
others. So no task holds more than two blocks, whatever the cell, and members of the trunk are never compared to each other.
A spanning forest is kept of the links. Nodes are sets of elements, not fingerprints, which different texts may share.

Equal fingerprints (or equal sets) are one node from the start: a group of copies of any size is one row. Components are
found by alternating star operations on the stored links; nothing is collected to the driver.

Defined results: null and empty texts have no words and fingerprint zero, which links like any other. A row without id
has a component but never names one (the component's id is null if no row has one). Rows repeated are rows of one group.
The representative of a group is its row with the least id, of those the one with the least key (row_key) of id and text;
rows without id come last. Of rows equal in id and text, one stays.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType
from pyspark.sql.window import Window

from .common import Scratch, row_key, short_batches, stored, words

SEED, BLOCK, BLOCKS = 42, 3, 22
#: Random reference fingerprints besides the block masks.
PIVOTS = 24
#: Shingles hashed at a time, and fingerprints compared at a time.
STEP, SIDE = 1 << 16, 2048
BANDS, BAND_ROWS = 36, 4
#: Bits of the fingerprint's first word within which pivot tables find all pairs, when texts are linked by similarity.
TABLE_RADIUS = 2
#: Sets of a cell that one task compares; larger cells are compared in blocks of half as many.
CELL = 1024
#: Rows of a cell among which the middle one is looked for.
MIDDLE = 1 << 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shingles(ws: list[bytes], n: int) -> list[bytes] | map:
    if len(ws) < n:
        return [b" ".join(ws)] if ws else []
    return map(b" ".join, zip(*(ws[i:] for i in range(n))))


_BITS = np.array([[(v >> b) & 1 for b in range(8)] for v in range(256)], np.int64)


def ones(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """How many of each owner's hashes have each bit: n x 64, bit 0 first."""
    octets, out = hashes.astype("<u8").view(np.uint8).reshape(-1, 8), np.empty((n, 64), np.int64)
    for j in range(8):
        out[:, 8 * j : 8 * j + 8] = np.bincount((owner << 8) | octets[:, j], minlength=n << 8).reshape(n, 256) @ _BITS
    return out


_SALTS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93], np.uint64)


def _mixed(h: np.ndarray, salt: np.uint64) -> np.ndarray:
    """64 more bits from each hash."""
    x = h + salt
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(text: str | None, n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles(words(text), n), repeat(SEED)), np.uint64)


def fingerprints(texts: list[str | None], n: int, lanes: int = 1) -> np.ndarray:
    """len(texts) x lanes unsigned 64-bit words."""
    return fingerprints_of([hashes(t, n) for t in texts], lanes)


def fingerprints_of(texts: list[np.ndarray], lanes: int = 1) -> np.ndarray:
    """fingerprints() of texts given as hashes of their shingles."""
    count, total = np.zeros((len(texts), lanes, 64), np.int64), np.zeros(len(texts), np.int64)
    owners: list[np.ndarray] = []
    held: list[np.ndarray] = []

    def spend() -> None:
        if held:
            first = int(owners[0][0])
            h, o = np.concatenate(held), np.concatenate(owners) - first
            for lane in range(lanes):
                part = ones(h if lane == 0 else _mixed(h, _SALTS[lane - 1]), o, int(o[-1]) + 1)
                count[first : first + len(part), lane] += part
            owners.clear()
            held.clear()

    size = 0
    for i, h in enumerate(texts):
        total[i] = len(h)
        if len(h):
            held.append(h)
            owners.append(np.full(len(h), i, np.int64))
            size += len(h)
        if size > STEP:
            spend()
            size = 0
    spend()
    bits = (2 * count > total[:, None, None]).astype(np.uint64)
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)


def _fingerprint(batches: Iterator[pa.RecordBatch], n: int, lanes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = fingerprints(batch.column("text").to_pylist(), n, lanes).view(np.int64)
        ends = pa.array(np.arange(0, fp.size + 1, lanes, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(ends, pa.array(fp.reshape(-1)))], ["doc_id", "fp"])


def fingerprinted(docs: DataFrame, n: int = 3, lanes: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and fp, the fingerprint's 64-bit words, of every row."""
    short_batches(docs.sparkSession)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return narrow.mapInArrow(lambda b: _fingerprint(b, n, lanes), StructType([StructField("doc_id", narrow.schema["doc_id"].dataType), StructField("fp", ArrayType(LongType(), False))]))


# ---------------------------------------------------------------- candidates

_MASKS = np.array([(((1 << BLOCK) - 1) << (BLOCK * i)) % 2**64 for i in range(BLOCKS)], np.uint64)


def pivots(lanes: int, n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 2**64, (n, lanes), np.uint64)


def distances(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Pivot table: Hamming distance of each fingerprint to each reference."""
    return np.bitwise_count(fp[:, None, :] ^ refs[None, :, :]).sum(axis=2, dtype=np.int16)


def block_counts(fp: np.ndarray) -> np.ndarray:
    """Ones in each block, from the distances to 0 and to the block's mask."""
    refs = np.concatenate([[np.uint64(0)], _MASKS])[:, None]
    d = distances(fp, refs)
    return (d[:, :1] - d[:, 1:] + np.bitwise_count(_MASKS).astype(np.int16)) // 2


def cells(fp: np.ndarray) -> np.ndarray:
    """Keys of the cell of each one-word fingerprint and of those one step away: n x (2 * BLOCKS + 1)."""
    base = (BLOCK + 3) ** np.arange(BLOCKS, dtype=np.int64)  # counts from -1 to BLOCK + 1
    own = (block_counts(fp).astype(np.int64) + 1) @ base
    return np.column_stack([own, own[:, None] + base, own[:, None] - base])


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("fp")
        fp = lists.flatten().to_numpy().view(np.uint64).reshape(-1, 1)
        keys = cells(fp)
        rows = np.repeat(np.arange(len(fp)), keys.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), batch.column("node").take(pa.array(rows)), lists.take(pa.array(rows))], ["cell", "node", "fp"])


def _joined(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Least member of each element's component when the pairs (x, y) are added to those that root has."""
    while len(x):
        m = np.minimum(root[x], root[y])
        new = root.copy()
        for at in (x, y, root[x], root[y]):
            np.minimum.at(new, at, m)
        while (new != (up := new[new])).any():
            new = up
        root = new
        open_ = root[x] != root[y]
        x, y = x[open_], y[open_]
    return root


def _verified(fp: np.ndarray, table: np.ndarray, x: np.ndarray, y: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that no pivot discards and that are within the radius."""
    for j in range(0, table.shape[1], 8):
        keep = (np.abs(table[x, j : j + 8] - table[y, j : j + 8]) <= radius).all(axis=1)
        x, y = x[keep], y[keep]
    good = np.bitwise_count(fp[x] ^ fp[y]).sum(axis=1) <= radius
    return x[good], y[good]


def _large(fp: np.ndarray, table: np.ndarray, radius: int) -> np.ndarray:
    """Components of one cell with many fingerprints, side by side in blocks."""
    root = np.arange(len(fp))
    for a in range(0, len(fp), SIDE):
        for b in range(a, len(fp), SIDE):
            near = root[a : a + SIDE, None] != root[None, b : b + SIDE]
            for j in range(4):
                near &= np.abs(table[a : a + SIDE, None, j] - table[None, b : b + SIDE, j]) <= radius
            x, y = np.nonzero(near)
            root = _joined(root, *_verified(fp, table, x + a, y + b, radius))
    return root


#: Runs up to this length are compared together, by distance in the sorted rows.
SHORT = 48


def _forest(cell: np.ndarray, node: np.ndarray, fp: np.ndarray, refs: np.ndarray, radius: int) -> np.ndarray:
    """Links of a spanning forest of the fingerprints that share a cell and are within the radius; cell is sorted."""
    edge = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    size = np.diff(np.append(edge, len(cell)))
    some = np.repeat(size > 1, size)
    if not some.any():
        return np.empty((0, 2), np.int64)
    cell, node, fp, size = cell[some], node[some], fp[some], size[size > 1]
    start, table = np.cumsum(size) - size, distances(fp, refs)
    root = np.arange(len(cell))
    short = np.repeat(size <= SHORT, size)
    for k in range(1, min(SHORT, int(size.max()))):
        x = np.flatnonzero((cell[k:] == cell[:-k]) & short[k:])
        if not len(x):
            break
        root = _joined(root, *_verified(fp, table, x, x + k, radius))
    for s, n in zip(start[size > SHORT].tolist(), size[size > SHORT].tolist()):
        root[s : s + n] = _large(fp[s : s + n], table[s : s + n], radius) + s
    linked = root != np.arange(len(root))
    return np.column_stack([node[linked], node[root[linked]]])


def _lists(column: pa.Array) -> np.ndarray:
    """Lists as an array of arrays."""
    flat, ends = column.flatten().to_numpy().view(np.uint64), np.cumsum(column.value_lengths().to_numpy())
    out = np.empty(len(column), object)
    out[:] = [flat[a:b] for a, b in zip(np.append(0, ends[:-1]).tolist(), ends.tolist())]
    return out


def _whole_cells(batches: Iterator[pa.RecordBatch], names: list[str], most: int | None = None) -> Iterator[tuple[np.ndarray, ...]]:
    """cell, fp (or elements) and the named columns of whole cells; rows come sorted by cell, and a cell may span batches.

    most: a cell of more rows is given in parts.
    """
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        fp = batch.column("fp").flatten().to_numpy().view(np.uint64).reshape(batch.num_rows, -1) if "fp" in batch.schema.names else _lists(batch.column("elements"))
        held.append((batch.column("cell").to_numpy(), fp, *(batch.column(c).to_numpy() for c in names)))
        last = held[-1][0]
        if held[0][0][0] == last[-1]:
            if most and sum(len(x[0]) for x in held) >= most:
                yield tuple(np.concatenate(x) for x in zip(*held))
                held = []
            continue  # all one cell so far
        whole = [np.concatenate(x) for x in zip(*held)]
        cut = int(np.searchsorted(whole[0], last[-1], "left"))
        yield tuple(x[:cut] for x in whole)
        held = [tuple(x[cut:] for x in whole)]
    if held:
        yield tuple(np.concatenate(x) for x in zip(*held))


def _runs(cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the cells with several rows."""
    start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    size = np.diff(np.append(start, len(cell)))
    return start[size > 1], size[size > 1]


def _middle(fp: np.ndarray) -> int:
    """The fingerprint nearest to the majority of all bits."""
    bits = np.zeros(fp.shape[1] * 64, np.int64)
    for a in range(0, len(fp), SIDE):
        bits += np.unpackbits(np.ascontiguousarray(fp[a : a + SIDE]).view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    centre = np.packbits(2 * bits > len(fp)).view(np.uint64)
    return int(np.bitwise_count(fp ^ centre).sum(axis=1, dtype=np.int64).argmin())


def _stars(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Each node of a cell with its hub, the middle one of its first MIDDLE rows, and whether their fingerprints are within
    the radius. A cell is read through, never held whole."""
    now, centre, of = None, None, None

    def spokes(cell: int, fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
        nonlocal now, centre, of
        if cell != now:
            at = _middle(fp[:MIDDLE])
            now, centre, of = cell, fp[at].copy(), int(node[at])
        near = np.bitwise_count(fp ^ centre).sum(axis=1, dtype=np.int64) <= radius
        other = node != of
        return np.maximum(node, of)[other], np.minimum(node, of)[other], near[other], np.full(int(other.sum()), of)

    for cell, fp, node in _whole_cells(batches, ["node"], MIDDLE):
        start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        size = np.diff(np.append(start, len(cell)))
        more = cell[start] == now  # the rest of a cell that was given in part
        x = start[(size == 2) & ~more]
        far = np.bitwise_count(fp[x] ^ fp[x + 1]).sum(axis=1, dtype=np.int64)
        found = [(np.maximum(node[x], node[x + 1]), np.minimum(node[x], node[x + 1]), far <= radius, node[x])]
        some = (size > 2) | more
        found += [spokes(int(cell[s]), fp[s : s + n], node[s : s + n]) for s, n in zip(start[some].tolist(), size[some].tolist())]
        a, b, near, hub = (np.concatenate(x) for x in zip(*found))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(near), pa.array(hub)], ["a", "b", "near", "hub"])


def _common(sets: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
    """How many elements the sets of two blocks have in common, block by block: the blocks' starts and the counts."""
    owner = np.repeat(np.arange(len(sets)), [len(e) for e in sets])
    _, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, column = owner[many[column] > 1], column[many[column] > 1]
    column = np.unique(column, return_inverse=True)[1]
    edge = np.searchsorted(owner, np.arange(0, len(sets) + SIDE // 4, SIDE // 4))
    width = int(column.max(initial=-1)) + 1

    def dense(k: int, c: int) -> np.ndarray:
        o, e = owner[edge[k] : edge[k + 1]] - k * (SIDE // 4), column[edge[k] : edge[k + 1]]
        here = (e >= c) & (e < c + SIDE)
        out = np.zeros((min(SIDE // 4, len(sets) - k * (SIDE // 4)), SIDE), np.float32)
        out[o[here], e[here] - c] = 1
        return out

    for a in range(len(edge) - 1):
        for b in range(a, len(edge) - 1):
            total = 0
            for c in range(0, max(1, width), SIDE):
                left = dense(a, c)
                total = total + left @ (left if a == b else dense(b, c)).T
            yield a * (SIDE // 4), b * (SIDE // 4), total


def _unconnected(batches: Iterator[pa.RecordBatch], similarity: float) -> Iterator[pa.RecordBatch]:
    """Links of a spanning forest of each cell's sets with at least this similarity, besides those of one root."""
    for cell, sets, node, root in _whole_cells(batches, ["node", "root"]):
        found = []
        for s, n in zip(*(x.tolist() for x in _runs(cell))):
            _, known = np.unique(root[s : s + n], return_index=True)
            group = known[np.unique(root[s : s + n], return_inverse=True)[1]]
            size = np.array([len(e) for e in sets[s : s + n]])
            for a, b, common in _common(list(sets[s : s + n])):
                u, v = common.shape
                least = similarity * np.sqrt(size[a : a + u, None] * size[None, b : b + v].astype(float))
                x, y = np.nonzero((common >= least - 1e-9) & (group[a : a + u, None] != group[None, b : b + v]))
                group = _joined(group, x + a, y + b)
            at = np.flatnonzero(group != np.arange(n))
            found.append(np.column_stack([node[s + at], node[s + group[at]]]))
        links = np.concatenate([*found, np.empty((0, 2), np.int64)])
        links = links[links[:, 0] != links[:, 1]]
        yield pa.RecordBatch.from_arrays([pa.array(links.max(axis=1)), pa.array(links.min(axis=1))], ["a", "b"])


def _meet(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by cell; a run of one cell may span batches."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    refs = None

    def runs(cell: np.ndarray, node: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        a = np.unique(np.sort(_forest(cell, node, fp, refs, radius), axis=1), axis=0)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a.max(axis=1)), pa.array(a.min(axis=1))], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("fp")
        lanes = len(lists[0])
        refs = pivots(lanes) if refs is None else refs
        held.append((batch.column("cell").to_numpy(), batch.column("node").to_numpy(), lists.flatten().to_numpy().view(np.uint64).reshape(-1, lanes)))
        last = held[-1][0]
        if last[0] == last[-1] and (len(held) == 1 or held[0][0][-1] == last[-1]):
            continue  # all one cell so far
        cell, node, fp = (np.concatenate(x) for x in zip(*held))
        cut = int(np.searchsorted(cell, cell[-1], "left"))
        yield from runs(cell[:cut], node[:cut], fp[:cut])
        held = [(cell[cut:], node[cut:], fp[cut:])]
    if held:
        yield from runs(*(np.concatenate(x) for x in zip(*held)))


def links(nodes: DataFrame, radius: int) -> DataFrame:
    """a > b: a spanning forest, cell by cell, of the links between nodes (node, fp of one word)."""
    if radius > 2:
        raise ValueError("cells guarantee a radius up to 2")
    dealt = nodes.mapInArrow(_deal, "cell long, node long, fp array<long>")
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = dealt.repartition(parts, "cell").sortWithinPartitions("cell")
    return together.mapInArrow(lambda b: _meet(b, radius), "a long, b long")


# ---------------------------------------------------------------- similarity of shingles


def elements(h: np.ndarray) -> np.ndarray:
    """Hashes of shingles, sorted; each repeat of one is an element of its own, so that all are different."""
    h = np.sort(h)
    again = np.append(False, h[1:] == h[:-1])
    if not again.any():
        return h
    place = np.arange(len(h))
    nth = place - np.maximum.accumulate(np.where(again, 0, place))
    h[again] = _mixed(h[again] + nth[again].astype(np.uint64) * _ODD, _SALTS[0])
    return np.unique(h)


def band_keys(texts: list[np.ndarray]) -> np.ndarray:
    """Keys of each text (its elements, at least one) in every table: len(texts) x BANDS."""
    factors = np.random.default_rng(13).integers(0, 2**63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    out = np.empty((len(texts), BANDS), np.uint64)
    ends = np.cumsum([len(t) for t in texts])
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + STEP, "right")))
        x = np.concatenate(texts[first:last])
        x ^= x >> np.uint64(32)
        starts = np.cumsum([0, *(len(t) for t in texts[first : last - 1])])
        for band in range(BANDS):
            key = np.full(last - first, band, np.uint64)
            for f in factors[band * BAND_ROWS : (band + 1) * BAND_ROWS]:
                y = x * f
                least = np.minimum.reduceat(y ^ (y >> np.uint64(29)), starts)
                key = (key ^ (key >> np.uint64(29))) * _ODD + least
            out[first:last, band] = key ^ (key >> np.uint64(32))
        first = last
    return out


def _described(batches: Iterator[pa.RecordBatch], n: int, lanes: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [hashes(t, n) for t in batch.column("text").to_pylist()]
        fp = fingerprints_of(sets, lanes).view(np.int64)
        sets = [elements(h) for h in sets]
        node = np.array([xxhash.xxh3_64_intdigest(e.tobytes()) for e in sets], np.uint64).view(np.int64)
        some = [e for e in sets if len(e)]
        keys = band_keys(some).view(np.int64).reshape(-1) if some else np.empty(0, np.int64)
        key_ends = pa.array(np.cumsum([0, *(BANDS * bool(len(e)) for e in sets)]).astype(np.int32))
        ends = pa.array(np.arange(0, fp.size + 1, lanes, dtype=np.int32))
        made = [pa.array(node), pa.ListArray.from_arrays(ends, pa.array(fp.reshape(-1))), pa.ListArray.from_arrays(key_ends, pa.array(keys))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k1", "k2")), *made], ["doc_id", "k1", "k2", "node", "fp", "keys"])


def _elements(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [elements(hashes(t, n)).view(np.int64) for t in batch.column("text").to_pylist()]
        ends = pa.array(np.cumsum([0, *map(len, sets)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*sets, np.empty(0, np.int64)])))], ["node", "elements"])


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes with at least this similarity; sets: node, elements."""
    both = pairs.join(sets.toDF("a", "ea"), "a").join(sets.toDF("b", "eb"), "b")
    small, large = F.least(F.size("ea"), F.size("eb")), F.greatest(F.size("ea"), F.size("eb"))
    common = F.size(F.array_intersect("ea", "eb"))
    alike = F.when(small >= large * similarity**2 - 1e-9, common >= similarity * F.sqrt(small.cast("double") * large) - 1e-9)
    return both.where(alike).select("a", "b")


def similar_groups(docs: DataFrame, n: int, similarity: float, radius: int, lanes: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, k1 and k2 (row_key), fp and component_id (the least doc_id of the group) of every row; groups are connected
    by texts of at least the given similarity of shingles."""
    prints, groups = _similar_groups(docs, n, similarity, radius, lanes, text, doc_id)
    return _named(prints, groups, "doc_id", "k1", "k2", "fp")


def _similar_groups(docs: DataFrame, n: int, similarity: float, radius: int, lanes: int, text: str, doc_id: str) -> tuple[DataFrame, DataFrame]:
    """Rows with their node, and nodes with the first row of their group."""
    spark = docs.sparkSession
    short_batches(spark)
    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *row_key(doc_id, text))
    schema = StructType([narrow.schema["doc_id"], *(StructField(c, LongType()) for c in ("k1", "k2", "node")), *(StructField(c, ArrayType(LongType(), False)) for c in ("fp", "keys"))])
    prints = stored(narrow.mapInArrow(lambda b: _described(b, n, lanes), schema), "fingerprints")
    space = Scratch(spark)
    nodes = space.stored(prints.groupBy("node").agg(F.min(_first()).alias("least"), F.min(F.struct("k1", "k2")).alias("at"), F.first("fp").alias("fp"), F.first("keys").alias("keys")), "nodes")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def met(dealt: DataFrame, how, limit: float, to: str) -> DataFrame:
        return dealt.repartition(parts, "cell").sortWithinPartitions("cell").mapInArrow(lambda b: how(b, limit), to)

    dealt = nodes.select(F.explode("keys").alias("cell"), "node", "fp")
    full = space.stored(dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > MIDDLE), "full-cells")
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / MIDDLE))
    parts_of = dealt.join(full, "cell", "left").select(F.when(F.col("n").isNull(), F.col("cell")).otherwise(F.xxhash64("cell", part)).alias("cell"), "node", "fp")
    star = "a long, b long, near boolean, hub long"
    inner = space.stored(met(parts_of, _stars, radius, star).distinct(), "stars-of-parts")
    hubs = dealt.join(full, "cell", "left_semi").join(inner.select(F.col("hub").alias("node")).distinct(), "node", "left_semi").select("cell", "node", "fp")
    stars = space.stored(inner.unionByName(met(hubs, _stars, radius, star)).select("a", "b", "near").distinct(), "stars")
    tables = space.stored(links(nodes.select("node", F.slice("fp", 1, 1).alias("fp")), TABLE_RADIUS).distinct(), "pivot-links")
    pairs = stars.where("near").select("a", "b").unionByName(tables).distinct()
    shared = space.stored(stars.select("a", "b").unionByName(tables).select(F.explode(F.array("a", "b")).alias("node")).distinct(), "candidates")
    at = nodes.join(shared, "node").select("at.k1", "at.k2", "node")
    texts = narrow.select("k1", "k2", "text").join(at.hint("shuffle_hash"), ["k1", "k2"])
    sets = space.stored(texts.select("node", "text").mapInArrow(lambda b: _elements(b, n), "node long, elements array<long>").dropDuplicates(["node"]), "elements")
    first = space.stored(_similar(pairs, sets, similarity), "similar")
    rooted = nodes.join(shared, "node").join(components(first), "node", "left").select(F.explode("keys").alias("cell"), "node", F.coalesce("root", "node").alias("root"))
    rooted = space.stored(rooted, "rooted")
    left = space.stored(_split(rooted), "unconnected")
    more = space.stored(met(left.join(sets, "node"), _unconnected, similarity, "a long, b long"), "links-of-cells")
    groups = _grouped(nodes, components(first.unionByName(more)))
    space.clear()
    return prints, groups


def _split(rooted: DataFrame, cell: int = CELL) -> DataFrame:
    """cell, node and root of the rows of cells that are to be compared; large cells are dealt to several, in blocks.

    The only pair of a cell of two has been compared, and in a cell of one root nothing is left to connect.
    """
    roots = rooted.groupBy("cell", "root").agg(F.count(F.lit(1)).alias("n"))
    trunk = F.max(F.struct("n", "root"))
    of = roots.groupBy("cell").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("roots"), trunk["root"].alias("trunk"), trunk["n"].alias("of_trunk")).where("n > 2 and roots > 1")
    rows = rooted.join(of.drop("roots").hint("shuffle_hash"), "cell")
    blocks = lambda n: F.ceil(n / (cell // 2)).cast("int")
    many, wide = blocks(F.col("n") - F.col("of_trunk")), blocks(F.col("of_trunk"))
    in_trunk = F.col("root") == F.col("trunk")
    own = F.pmod(F.xxhash64("node"), F.when(in_trunk, wide).otherwise(many)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    key = lambda kind, a, b: F.xxhash64("cell", F.lit(kind), a, b)
    of_trunk = F.transform(upto(F.col("many")), lambda p: key("trunk", p, F.col("own")))
    of_others = F.concat(F.transform(upto(F.col("wide")), lambda q: key("trunk", F.col("own"), q)), F.transform(upto(F.col("many")), lambda q: key("others", F.least(q, F.col("own")), F.greatest(q, F.col("own")))))
    dealt = rows.withColumns({"many": many, "wide": wide, "own": own})
    to = F.when(F.col("n") <= cell, F.array("cell")).when(in_trunk, of_trunk).otherwise(of_others)
    return dealt.select(F.explode(to).alias("cell"), "node", "root")


# ---------------------------------------------------------------- components


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node it is connected to, for every node of an edge (a > b).

    Alternating large and small stars: each round points the larger neighbours of a node, and then its smaller ones, at the
    least of them, until nothing changes. Every round is written to the shared folder, so no plan grows with the rounds.
    """
    state = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.hash("a", "b").cast("long"))).first()
    # dealt by both ends before equal ones are dropped, so that nothing ties the join before it to a hub's one partition:
    # adaptive execution can split it
    once = lambda e: e.repartition("a", "b").distinct()
    before, rounds = Scratch(edges.sparkSession), Scratch(edges.sparkSession)
    now = before.stored(edges.select("a", "b").distinct(), "links")
    seen = state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = rounds.stored(once(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        after = rounds.stored(once(small), "small-star")
        # sums that are equal are no proof: the edges themselves are compared, which are distinct and as many
        if (counted := state(after)) == seen and after.join(now, ["a", "b"], "left_anti").isEmpty():
            before.clear()
            return after.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(after.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before.clear()  # what this round was made from
        before, rounds = rounds, Scratch(edges.sparkSession)
        now, seen = after, counted


def near_duplicates(docs: DataFrame, n: int = 3, radius: int = 2, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, fp and component_id (the least doc_id of the group) of every row."""
    prints = stored(fingerprinted(docs, n, 1, text, doc_id), "fingerprints").withColumn("node", F.col("fp")[0])
    least = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id")
    nodes = stored(prints.groupBy("node").agg(F.min(least).alias("least"), F.first("fp").alias("fp")), "nodes")
    return _named(prints, _grouped(nodes, components(links(nodes.select("node", "fp"), radius))), "doc_id", "fp")


def _first() -> Column:
    """The row's place among those of its group."""
    return F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "k1", "k2")


def _grouped(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """node, and the first row of its group."""
    rooted = nodes.select("node", "least").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    whole = rooted.groupBy("root").agg(F.min("least").alias("first"))
    return stored(rooted.join(whole, "root").select("node", "root", "first"), "components")


def _named(prints: DataFrame, groups: DataFrame, *columns: str) -> DataFrame:
    """These columns of prints with component_id."""
    return prints.join(groups, "node").select(*columns, F.col("first.doc_id").alias("component_id"))


def representatives(docs: DataFrame, n: int, similarity: float, radius: int, lanes: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the rows that aren't the first of their group; of rows equal in id and text, one stays."""
    prints, groups = _similar_groups(docs, n, similarity, radius, lanes, text, doc_id)
    firsts = groups.select("root", "first.k1", "first.k2").distinct()
    equal = prints.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    kept = firsts.join(equal, ["k1", "k2"]).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), (F.col("n") > 1).alias("__again"))
    keys = row_key(doc_id, text)
    keep = docs.withColumns({"__k1": keys[0], "__k2": keys[1]}).join(kept.hint("shuffle_hash"), ["__k1", "__k2"])  # whole texts aren't sorted
    order = Window.partitionBy("__k1", "__k2").orderBy(*[F.col(c) for c in docs.columns])
    again = keep.where("__again").withColumn("__rank", F.row_number().over(order)).where("__rank = 1")  # only repeated rows are sorted
    return keep.where("not __again").select(docs.columns).unionByName(again.select(docs.columns))
