"""Conversation memory as a stream: the last turns of each conversation as state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kgloom.operators.conversation import WINDOW

OUT = "conv_id long, turn long, query string, history string"
STATE = "queries array<string>, responses array<string>"


def remembered(turns: DataFrame, window: int = WINDOW, idle_ms: int | None = None) -> DataFrame:
    """conv_id, turn, query and history (Q and A lines of the turns before it) of each arriving turn.

    turns: conv_id, turn, query, response, as a stream; turns of a conversation are taken in the order of their numbers
    within a batch. The state of a conversation is `window` turns; with idle_ms it is dropped when none has come so long.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        queries, responses = (list(x) for x in (state.get if state.exists else ([], [])))
        rows = []
        for r in pd.concat(list(frames)).sort_values("turn").itertuples(index=False):
            rows.append((key[0], r.turn, r.query, "\n".join(f"Q: {q}\nA: {a}" for q, a in zip(queries, responses))))
            queries, responses = [*queries, r.query][-window:], [*responses, r.response][-window:]
        state.update((queries, responses))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(rows, columns=["conv_id", "turn", "query", "history"])

    kind = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return turns.groupBy("conv_id").applyInPandasWithState(step, OUT, STATE, "append", kind)
