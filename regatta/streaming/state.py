"""Custom keyed state: the last few values of an entity, and alerts when they rise.

The input is one row per entity and closed window (``metrics.entity_windows``), so a busy entity
sends a row per window to its state, never its raw events. An entity that is silent for longer than
``keep`` starts again: its next value has no history, and its state is dropped once the watermark says so.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from regatta.operators.assign import RISE
from regatta.operators.history import HISTORY_LENGTH

STATE = "ats array<timestamp>, norms array<double>"
# Silence after which an entity's history ends, and how late a window may come.
KEEP = "30 days"
LATE = "1 day"


def _advance(
    batches: Iterator[pd.DataFrame], state: GroupState, keep: pd.Timedelta
) -> list[tuple[pd.Timestamp, list[float]]]:
    """Feed rows in event-time order into the bounded list; rows older than its head are ignored."""
    if state.hasTimedOut:
        state.remove()
        return []
    ats, norms = (list(x) for x in state.get) if state.exists else ([], [])
    rows = sorted((at, n) for pdf in batches for at, n in zip(pdf["at"], pdf["norm"]))
    seen = []
    for at, norm in rows:
        if ats and at <= pd.Timestamp(ats[0]):
            continue
        if ats and at - pd.Timestamp(ats[0]) > keep:
            ats, norms = [], []
        ats, norms = [at, *ats][:HISTORY_LENGTH], [norm, *norms][:HISTORY_LENGTH]
        seen.append((at, list(norms)))
    state.update((ats, norms))
    ends = _millis(pd.Timestamp(ats[0]) + keep)
    state.setTimeoutTimestamp(max(ends, state.getCurrentWatermarkMs()) + 1)
    return seen


def _millis(at: pd.Timestamp) -> int:
    return int(at.timestamp() * 1000)


def _with_state(windows: DataFrame, step, schema: str) -> DataFrame:
    return windows.withWatermark("at", LATE).groupBy("entity").applyInPandasWithState(
        step, schema, STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def recent_values(windows: DataFrame, keep: str = KEEP) -> DataFrame:
    """``(entity, at, newest, second, third, kept)`` after every window of an entity."""

    def step(key, batches, state):
        seen = _advance(batches, state, pd.Timedelta(keep))
        if seen:
            padded = [(n + [None] * HISTORY_LENGTH)[:HISTORY_LENGTH] for _, n in seen]
            yield pd.DataFrame({
                "entity": [key[0]] * len(seen), "at": [a for a, _ in seen],
                "newest": [p[0] for p in padded],
                "second": pd.Series([p[1] for p in padded], dtype="float64"),
                "third": pd.Series([p[2] for p in padded], dtype="float64"),
                "kept": [len(n) for _, n in seen],
            })

    schema = "entity long, at timestamp, newest double, second double, third double, kept int"
    return _with_state(windows, step, schema)


def increase_alerts(windows: DataFrame, keep: str = KEEP) -> DataFrame:
    """``(entity, at, previous, current)`` whenever a value is 1.2 times the one before."""

    def step(key, batches, state):
        hits = [
            (key[0], at, n[1], n[0]) for at, n in _advance(batches, state, pd.Timedelta(keep))
            if len(n) > 1 and n[0] >= n[1] * RISE
        ]
        if hits:
            yield pd.DataFrame(hits, columns=["entity", "at", "previous", "current"])

    schema = "entity long, at timestamp, previous double, current double"
    return _with_state(windows, step, schema)
