"""Byte-level BPE encoding and decoding.

A text is cut by the tokenizer's pattern; each distinct match is encoded once and remembered. Matches that are new in a
batch are put in padded numpy matrices by length class, with the rank of every adjacent pair beside them, looked up in a
hash table by whole arrays. Each round, every row merges its leftmost pair of least rank, closes up, and looks up the two
pairs that are new; rows without a pair to merge leave the matrix. A match of more than WIDE bytes is folded: its bytes are
the rows of a matrix of its own, whose rounds merge the leftmost pair of least rank of the whole match and touch one row
only, so that a round doesn't cost the length of the match. A match that is itself a token is that token.

Defined results: a null text is an empty text, with no ids. Rows repeated are encoded alike. Extra columns are kept; those
of the result's names are replaced. A matrix has at most CELLS cells, and the memory of matches is emptied when it holds
REMEMBERED_BYTES of them, so a worker's memory is bounded by the longest text, whatever the vocabulary of the corpus.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from .common import short_batches

#: Upper ends of the length classes in bytes; longer matches are folded into rows of FOLD bytes.
CLASSES = (4, 8, 12, 16, 24, 32, 64, 128, 256, 512)
WIDE, FOLD = CLASSES[-1], 256
#: Cells of a matrix and characters cut at once, and bytes of remembered matches and their ids.
CELLS, REMEMBERED_BYTES = 1 << 20, 48 << 20
#: Odd multiplier of the pair hash (2**64 divided by the golden ratio).
MIX = np.uint64(0x9E3779B97F4A7C15)
NONE = np.int64(1 << 40)


class Pairs:
    """Pair of ids -> rank, in an open-addressed table read by whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(8, int(len(left) * 4).bit_length())
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, NONE, np.int64)
        keys, at = self._key(left, right), None
        at = self._home(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self.keys[at[todo]] == -1
            some = todo[free]
            _, first = np.unique(at[some], return_index=True)  # one key for each free place
            put = some[first]
            self.keys[at[put]], self.ranks[at[put]] = keys[put], rank[put]
            todo = todo[self.keys[at[todo]] != keys[todo]]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.int64) << 32) | right.astype(np.int64)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * MIX) >> np.uint64(64 - self.bits)).astype(np.int64)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it is no pair or an id is negative (padding)."""
        keys = self._key(left, right)
        out = np.full(keys.shape, NONE, np.int64)
        todo = np.flatnonzero((left >= 0) & (right >= 0))
        flat, k = out.reshape(-1), keys.reshape(-1)
        at = self._home(k[todo])
        while len(todo):
            seen = self.keys[at]
            hit = seen == k[todo]
            flat[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (seen != -1)
            todo, at = todo[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = [(a, b, i) for t, i in ranks.items() for cut in range(1, len(t)) if (a := ranks.get(t[:cut])) is not None and (b := ranks.get(t[cut:])) is not None]
        self.pairs = Pairs(*np.array(pairs, np.int64).reshape(-1, 3).T)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _matrix(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces of one length class."""
        width = max(2, *map(len, pieces))
        sizes = np.array([len(p) for p in pieces])
        m = np.full((len(pieces), width), -1, np.int64)
        m[np.arange(width) < sizes[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list = [None] * len(pieces)
        rows, ranks = np.arange(len(pieces)), self.pairs.lookup(m[:, :-1], m[:, 1:])
        while len(rows):
            each = np.arange(len(rows))
            at = ranks.argmin(axis=1)  # the leftmost of the least
            least = ranks[each, at]
            if (over := least == NONE).any():
                for r, ids in zip(rows[over].tolist(), m[over].tolist()):
                    out[r] = [i for i in ids if i >= 0]
                m, ranks, rows, at, least = m[~over], ranks[~over], rows[~over], at[~over], least[~over]
                if not len(rows):
                    break
                longest = max(2, int((m >= 0).sum(axis=1).max()))  # closes up
                m, ranks, each = m[:, :longest], ranks[:, : longest - 1], np.arange(len(rows))
            m[each, at] = least
            last = m.shape[1] - 1
            after = np.arange(last)[None, :] > at[:, None]
            m[:, :-1] = np.where(after, m[:, 1:], m[:, :-1])
            m[:, -1] = -1
            ranks[:, :-1] = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            # the two pairs that the merged id stands in
            ranks[each, np.minimum(at, last - 1)] = self.pairs.lookup(m[each, np.minimum(at, last - 1)], m[each, np.minimum(at, last - 1) + 1])
            some = np.flatnonzero(at > 0)
            ranks[some, at[some] - 1] = self.pairs.lookup(m[some, at[some] - 1], m[some, at[some]])
        return out

    def _folded(self, piece: bytes) -> list[int]:
        """Ids of one long piece, whose rows are the rows of a matrix.

        A row that has become empty is passed over. The rank of a row's last pair, whose right side stands in the next row
        that isn't empty, is held with the row of its left side.
        """
        rows = -(-len(piece) // FOLD)
        flat = np.full(rows * FOLD, -1, np.int64)
        flat[: len(piece)] = self.single[np.frombuffer(piece, np.uint8)]
        ranks = self.pairs.lookup(flat, np.append(flat[1:], -1)).reshape(rows, FOLD)
        m, size = flat.reshape(rows, FOLD), (flat.reshape(rows, FOLD) >= 0).sum(axis=1).tolist()
        before, after = list(range(-1, rows - 1)), list(range(1, rows + 1))
        least = ranks.min(axis=1)
        rank = lambda a, b: int(self.pairs.lookup(np.array([a]), np.array([b]))[0])

        def drop(r: int, c: int) -> None:
            """Takes an id out of its row; a row without ids leaves the chain."""
            m[r, c : size[r] - 1], ranks[r, c : size[r] - 1] = m[r, c + 1 : size[r]], ranks[r, c + 1 : size[r]]
            size[r] -= 1
            m[r, size[r]], ranks[r, size[r]] = -1, NONE
            if size[r]:
                least[r] = ranks[r].min()
                return
            least[r] = NONE
            if before[r] >= 0:
                after[before[r]] = after[r]
            if after[r] < rows:
                before[after[r]] = before[r]

        while True:
            r = int(least.argmin())
            if least[r] == NONE:
                return [i for i in m.ravel().tolist() if i >= 0]
            c = int(ranks[r].argmin())
            m[r, c] = ranks[r, c]
            if c + 1 < size[r]:
                drop(r, c + 1)
            else:
                drop(after[r], 0)
            right = m[r, c + 1] if c + 1 < size[r] else m[after[r], 0] if after[r] < rows else -1
            ranks[r, c] = rank(m[r, c], right)
            least[r] = ranks[r].min()
            if c or before[r] >= 0:
                p, o = (r, c - 1) if c else (before[r], size[before[r]] - 1)
                ranks[p, o] = rank(m[p, o], m[r, c])
                least[p] = ranks[p].min()

    def _remember(self, match: str, ids: list[int]) -> None:
        self.known[match] = np.array(ids, "<u4").tobytes()
        self.held += 100 + len(match) + 4 * len(ids)

    def learn(self, matches: set[str]) -> None:
        """Encodes matches that aren't known yet."""
        classes: dict[int, list[tuple[str, bytes]]] = {}
        for s in matches:
            p = s.encode("utf-8", "surrogatepass")
            if (whole := self.ranks.get(p)) is not None:
                self._remember(s, [whole])
            elif len(p) > WIDE:
                self._remember(s, self._folded(p))
            else:
                classes.setdefault(next(c for c in CLASSES if len(p) <= c), []).append((s, p))
        for width, members in classes.items():
            most = max(1, CELLS // width)
            for a in range(0, len(members), most):
                part = members[a : a + most]
                for (s, _), ids in zip(part, self._matrix([p for _, p in part])):
                    self._remember(s, ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; texts are cut a few at a time, by their length."""
        out: list[bytes] = []
        ends = np.cumsum([len(t) if t else 0 for t in texts])
        while (first := len(out)) < len(texts):
            spent = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, spent + CELLS, "right")))
            cut = [self.find(t) if t else [] for t in texts[first:last]]
            if self.held > REMEMBERED_BYTES:
                self.known.clear()
                self.held = 0
            self.learn(set().union(*cut).difference(self.known))
            out += [b"".join(map(self.known.__getitem__, c)) for c in cut]
        return out

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


_loaded: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One encoder for each worker process."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Encoder(load_ranks(path), pattern)
    return _loaded[path, pattern]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def _run(batches: Iterator[pa.RecordBatch], path: str, pattern: str, text: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc = encoder(path, pattern)
    for batch in batches:
        ids = enc.encode(batch.column(text).to_pylist())
        made = [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in ids])]
        if with_ids:
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            made.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))))
        keep = [i for i, name in enumerate(batch.schema.names) if name != text]
        names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], [*(batch.schema.names[i] for i in keep), *names])


def encode_documents(docs: DataFrame, text: str = "text", path: str | None = None, pattern: str | None = None, with_ids: bool = True) -> DataFrame:
    """The columns of docs but the text, then n_tokens, ids_sha256 and decoded_sha256 and, if asked for, the ids.

    path is a file of ranks that every executor has. Columns of docs that have these names are replaced.
    """
    short_batches(docs.sparkSession)
    path, pattern = path or default_path(), pattern or default_pattern()
    docs = docs.drop("n_tokens", "ids_sha256", "decoded_sha256", "ids")
    made = [StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType())]
    made += [StructField("ids", ArrayType(IntegerType()))] if with_ids else []
    schema = StructType([f for f in docs.schema.fields if f.name != text] + made)
    return docs.mapInArrow(lambda b: _run(b, path, pattern, text, with_ids), schema)
