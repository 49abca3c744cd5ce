"""Chat formatting: roles recovered from the lines of a transcript, then canonical turns.

A hidden Markov model runs over the lines of a conversation. Its states are a role and whether the line begins a turn or
goes on with it; an observation is what the line shows: a speaker marker ("User:", "Assistant:", "System:"), whether it
opens a row of the transcript, whether it ends as a question, how long it is, how many lines the row has. Start,
transition and emission probabilities are counts over all rows whose role is known. Viterbi gives the most probable
states; a line in a begin state opens a turn, and each turn is rendered in the canonical form without its marker.

How it scales. Rows are dealt by ranges of (conversation, turn), so a conversation that holds a third of all rows lies in
several partitions. Of a conversation that goes over the ends of a partition, the partition's lines are one matrix of the
best scores from each state before them to each state at their end; there are at most two such matrices for a partition.
Those are put in order on the driver, which finds the states at the ends, and each partition then decodes its own lines
between fixed ends. The result is that of one pass of Viterbi over the whole conversation. The dealt rows are
checkpointed in the shared folder, so the passes see the same partitions.

Defined results: a null text is one empty line. Rows of a conversation are ordered by turn, those of one turn by a hash of
text and role; a null conversation id is a conversation, a null turn comes first. Ids and turns keep their type, numbers or
texts. Rows with a null or unknown role are decoded but not learnt from. Rows repeated are turns of their own, dealt to
several ranges if they are many. Extra columns are not carried.
"""

from __future__ import annotations

import dataclasses
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import short_batches, shared_dir

ROLES = ("system", "user", "assistant")
#: State 2 * r begins a turn of role r, 2 * r + 1 goes on with it; the last row of the transitions is the start.
STATES = 2 * len(ROLES)
START = STATES
_MARKERS = [re.compile(p, re.IGNORECASE) for p in (r"\s*(?:\[?system\]?|instructions?)\s*[:>]\s*", r"\s*(?:\[?user\]?|human|question|q)\s*[:>]\s*", r"\s*(?:\[?assistant\]?|bot|ai|answer|a)\s*[:>]\s*")]
_LENGTHS = (0, 24, 64, 128, 192, 256, 384, 640)
_ROWS = (1, 2, 3, 5, 8)
_QUESTION = "?¿？"
#: Equal rows are dealt in so many parts.
SALTS = 64
SYMBOLS = 4 * 2 * 2 * (len(_LENGTHS) + 1) * (len(_ROWS) + 1)


def marker(line: str) -> tuple[int, int]:
    """Number of the marked role (0: none) and the marker's length."""
    for i, m in enumerate(_MARKERS):
        if found := m.match(line):
            return i + 1, found.end()
    return 0, 0


def symbols(text: str | None) -> list[int]:
    """The observation of each line of a row."""
    lines = (text or "").split("\n")
    rows = sum(len(lines) > n for n in _ROWS)
    out = []
    for i, line in enumerate(lines):
        bare = line.rstrip()
        length = sum(len(bare) > n for n in _LENGTHS)
        out.append((((marker(line)[0] * 2 + (i == 0)) * 2 + (bare[-1:] in _QUESTION and bare != "")) * (len(_LENGTHS) + 1) + length) * (len(_ROWS) + 1) + rows)
    return out


@dataclasses.dataclass
class Model:
    """Logarithms: trans[i, j] from state i (START: none) to j, emit[j, symbol]."""

    trans: np.ndarray
    emit: np.ndarray

    @classmethod
    def from_counts(cls, trans: np.ndarray, emit: np.ndarray) -> Model:
        """A line without a marker shows its other features; of a marked line only the marker counts. What the corpus doesn't show: a turn
        goes on with its own role, and a marker belongs to the begin of its own role's turns."""
        t = trans + 0.1
        counts = emit.reshape(STATES, 4, SYMBOLS // 4)
        marks = counts.sum(axis=2) + 1e-4
        marks[:, 0] += 1
        for r in range(len(ROLES)):
            t[2 * r, 2 * r + 1] += 1
            t[2 * r + 1, 2 * r + 1] += 1
            t[2 * r + 1, [2 * other for other in range(len(ROLES)) if other != r]] += 1
            marks[2 * r, r + 1] += 1 + 0.02 * marks[2 * r].sum()
        rest = counts[:, 0] + 0.02
        e = (marks / marks.sum(axis=1, keepdims=True))[:, :, None] * (rest / rest.sum(axis=1, keepdims=True))[:, None, :]
        e[:, 1:] = (marks[:, 1:] / marks.sum(axis=1, keepdims=True))[:, :, None] / rest.shape[1]
        return cls(np.log(t / t.sum(axis=1, keepdims=True)), np.log(e.reshape(STATES, SYMBOLS)))

    def segment(self, obs: list[int]) -> np.ndarray:
        """Best score from each state before (or START) to each state at the last of the lines."""
        best = self.trans + self.emit[:, obs[0]][None, :]
        for o in obs[1:]:
            best = (best[:, :, None] + self.trans[None, :STATES, :]).max(axis=1) + self.emit[:, o][None, :]
        return best

    def decode(self, obs: list[int], before: int = START, last: int | None = None) -> list[int]:
        """Most probable states of the lines, from the state before them to the last, if that is given."""
        score, back = self.trans[before] + self.emit[:, obs[0]], []
        inner = self.trans[:STATES]
        for o in obs[1:]:
            paths = score[:, None] + inner
            back.append(paths.argmax(axis=0))
            score = paths.max(axis=0) + self.emit[:, o]
        at = int(score.argmax()) if last is None else last
        out = [at]
        for b in reversed(back):
            at = int(b[at])
            out.append(at)
        return out[::-1]


def _conversations(rows: Iterator[dict]) -> Iterator[tuple]:
    """(conversation, its rows) of sorted rows, one conversation at a time within the partition."""
    held: list[dict] = []
    for r in rows:
        if held and held[0]["conv_id"] != r["conv_id"]:
            yield held[0]["conv_id"], held
            held = []
        held.append(r)
    if held:
        yield held[0]["conv_id"], held


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def _told(rows: list[dict]) -> list[int | None]:
    """States of the lines of rows with known roles."""
    out: list[int | None] = []
    for r in rows:
        known = ROLES.index(r["role"]) if r["role"] in ROLES else None
        out += [None if known is None else 2 * known + (i > 0) for i in range(len(r["obs"]))]
    return out


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        obs = [symbols(t) for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(obs, pa.list_(pa.int32()))], [*batch.schema.names, "obs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Transition counts (kind 0), emission counts (kind 1), and the states at the partition's ends (kind 2 and 3)."""
    part, trans, emit = TaskContext.get().partitionId(), Counter(), Counter()
    ends: list[tuple] = []
    last_state, last_conv = None, None
    first = True
    for conv, rows in _conversations(_rows(batches)):
        states = _told(rows)
        obs = [o for r in rows for o in r["obs"]]
        emit.update((s, o) for s, o in zip(states, obs) if s is not None)
        trans.update((a, b) for a, b in zip(states, states[1:]) if a is not None and b is not None)
        if first:
            ends.append((2, part, -1 if states[0] is None else states[0], repr(conv)))
            first = False
        elif states[0] is not None:
            trans[START, states[0]] += 1
        last_state, last_conv = states[-1], conv
    if not first:
        ends.append((3, part, -1 if last_state is None else last_state, repr(last_conv)))
    rows = [(0, a, b, None, n) for (a, b), n in trans.items()] + [(1, a, b, None, n) for (a, b), n in emit.items()] + [(k, p, s, c, 1) for k, p, s, c in ends]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["kind", "a", "b", "conv", "n"])


def train(dealt: DataFrame) -> Model:
    """Counts over all rows: at most (states + 1) * states + states * symbols sums, and two rows for each partition."""
    counts = dealt.mapInArrow(_count, "kind int, a long, b long, conv string, n long").groupBy("kind", "a", "b", "conv").agg(F.sum("n").alias("n")).collect()
    trans, emit = np.zeros((STATES + 1, STATES)), np.zeros((STATES, SYMBOLS))
    ends: dict[int, dict[int, tuple]] = {2: {}, 3: {}}
    for r in counts:
        if r["kind"] < 2:
            (emit if r["kind"] else trans)[r["a"], r["b"]] += r["n"]
        else:
            ends[r["kind"]][r["a"]] = (r["b"], r["conv"])
    before: tuple | None = None
    for part in sorted(ends[2]):
        state, conv = ends[2][part]
        if state >= 0:
            if before is None or before[1] != conv:
                trans[START, state] += 1
            elif before[0] >= 0:
                trans[before[0], state] += 1
        before = ends[3][part]
    return Model.from_counts(trans, emit)


def _border(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Matrices of the first and the last conversation of the partition."""
    part, out, last = TaskContext.get().partitionId(), [], None
    for i, (conv, rows) in enumerate(_conversations(_rows(batches))):
        last = (repr(conv), [o for r in rows for o in r["obs"]], i)
        if i == 0:
            out.append((part, 0, last[0], model.segment(last[1]).ravel().tolist()))
    if last is not None and last[2] > 0:
        out.append((part, 1, last[0], model.segment(last[1]).ravel().tolist()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64())))], ["part", "side", "conv", "best"])


def ends_of(borders: list[tuple[int, int, str, np.ndarray]]) -> dict[tuple[int, int], tuple[int, int | None]]:
    """(partition, side) -> (state before the first line, state at the last line) of each border segment.

    borders: in order of partition and side. Segments of one conversation follow each other.
    """
    out, chain = {}, []

    def close() -> None:
        scores = [np.full(STATES + 1, -np.inf)]
        scores[0][START] = 0.0
        for _, _, _, best in chain:
            nxt = (scores[-1][:, None] + best).max(axis=0)
            scores.append(np.append(nxt, -np.inf))
        at = int(scores[-1].argmax()) if chain else 0
        for k in range(len(chain) - 1, -1, -1):
            before = int((scores[k] + chain[k][3][:, at]).argmax())
            out[chain[k][:2]] = (before, at)
            at = before

    for b in borders:
        if chain and chain[-1][2] != b[2]:
            close()
            chain = []
        chain.append(b)
    close()
    return out


def _render(batches: Iterator[pa.RecordBatch], model: Model, ends: dict, types: tuple) -> Iterator[pa.RecordBatch]:
    part, held, out = TaskContext.get().partitionId(), None, []
    names = ["conv_id", "turn", "part", "role", "recovered_role", "text", "rendered"]

    def turns(i: int, conv, rows: list[dict], is_last: bool) -> Iterator[tuple]:
        side = 0 if i == 0 else 1
        before, last = ends.get((part, side), (START, None)) if i == 0 or is_last else (START, None)
        states = model.decode([o for r in rows for o in r["obs"]], before, last)
        at = 0
        for r in rows:
            lines = (r["text"] or "").split("\n")
            mine = states[at : at + len(lines)]
            at += len(lines)
            cuts = [0, *(k for k in range(1, len(lines)) if mine[k] % 2 == 0), len(lines)]
            for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
                role = ROLES[mine[a] // 2]
                first = lines[a][marker(lines[a])[1] :]
                body = "\n".join([first, *lines[a + 1 : b]])
                yield r["conv_id"], r["turn"], p, r["role"], role, body, canonical(role, body)

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (*types, pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()))], names)

    for i, (conv, rows) in enumerate(_conversations(_rows(batches))):
        if held is not None:
            out += turns(*held, False)
        held = (i, conv, rows)
        if len(out) >= 1000:
            yield batch()
            out.clear()
    if held is not None:
        out += turns(*held, True)
    if out:
        yield batch()


def canonical(role: str, text: str) -> str:
    """A turn in the canonical form."""
    return f"<|{role}|>\n{text.strip()}\n<|end|>\n"


def dealt(conversations: DataFrame) -> DataFrame:
    """Rows with observations, in ranges of (conversation, turn), checkpointed."""
    spark = conversations.sparkSession
    short_batches(spark)
    shared_dir(spark)
    rows = conversations.select("conv_id", "turn", F.col("role").cast("string").alias("role"), "text")
    seen = rows.mapInArrow(_observe, StructType([*rows.schema.fields, StructField("obs", ArrayType(IntegerType()))]))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = seen.withColumns({"__order": F.xxhash64("text", "role"), "__salt": F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))})
    order = ["conv_id", "turn", "__order", "__salt"]
    return keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order, "text", "role").drop("__order", "__salt").checkpoint()


def format_chats(conversations: DataFrame, model: Model | None = None) -> DataFrame:
    """conv_id, turn, part, role (as given), recovered_role, text and rendered: a row for each recovered turn.

    part numbers the turns that one row was found to hold. The model is trained on the rows themselves unless given.
    """
    rows = dealt(conversations)
    model = model or train(rows)
    borders = rows.mapInArrow(lambda b: _border(b, model), "part int, side int, conv string, best array<double>").collect()
    borders = sorted(((r["part"], r["side"], r["conv"], np.array(r["best"]).reshape(STATES + 1, STATES)) for r in borders), key=lambda b: b[:2])
    ends = ends_of(borders)
    given = [StructField(c, rows.schema[c].dataType) for c in ("conv_id", "turn")]
    types = tuple(to_arrow_type(f.dataType) for f in given)
    made = [StructField("part", IntegerType()), *(StructField(c, StringType()) for c in ("role", "recovered_role", "text", "rendered"))]
    return rows.mapInArrow(lambda b: _render(b, model, ends, types), StructType([*given, *made]))
