"""Quotas whose decisions depend on earlier decisions: one pass in time order a key, batch and streaming.

A refused use takes no place, so a window frame over all uses gives wrong answers; the state of a key is a handful of
accepted times. The batch form sorts each key's rows and folds over them, the streaming form keeps the same state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def seconds_of(column: str):
    """Seconds since 1970 of a timestamp without time zone, as a double."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ)) / 1e6D")


def sliding_step(times: list[float], now: float, limit: int, seconds: int) -> tuple[list[float], bool]:
    times = [t for t in times if now - t < seconds]
    ok = len(times) < limit
    return ([*times, now] if ok else times), ok


def ttl_step(state: list[float], now: float, cap: int, seconds: int) -> tuple[list[float], bool]:
    """state: the uses of the running window and when it ends."""
    used, ends = state or [0.0, 0.0]
    if now >= ends:
        used, ends = 0.0, now + seconds
    return ([used + 1, ends], True) if used < cap else ([used, ends], False)


def replayed(events: DataFrame, key: str, step: Callable, limit: int, seconds: int) -> DataFrame:
    """key, event_id, accepted in batch: rows are dealt by key and sorted, and a task folds over its sorted rows.

    A task reads its keys as a stream of batches and keeps one key's state, so a key of any size is never held whole.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, []
        for frame in frames:
            out = []
            for k, now in zip(frame[key], frame["_t"], strict=True):
                if k != current:
                    current, state = k, []
                state, ok = step(state, now, limit, seconds)
                out.append(ok)
            yield frame[[key, "event_id"]].assign(accepted=out)

    rows = events.select(key, "event_id", seconds_of("ts").alias("_t"))
    dealt = rows.repartition(key).sortWithinPartitions(key, "_t", "event_id")
    kinds = dict(events.dtypes)
    return dealt.mapInPandas(fold, f"{key} {kinds[key]}, event_id {kinds['event_id']}, accepted boolean")


def sliding_limit(events: DataFrame, key: str, limit: int, seconds: int) -> DataFrame:
    return replayed(events, key, sliding_step, limit, seconds)


def ttl_counter(events: DataFrame, key: str, cap: int, seconds: int) -> DataFrame:
    return replayed(events, key, ttl_step, cap, seconds)


def streamed(events: DataFrame, key: str, step: Callable, limit: int, seconds: int, timeout_ms: int | None = None) -> DataFrame:
    """The streaming twin of replayed: the state lives in the state store, rows of a batch are taken in time order.

    timeout_ms: a stream that runs on forgets a key that nothing has come for in so long; give it twice the window or
    more, so that no use of the key could count any more. Without it (runs over what is available) nothing is forgotten.
    """

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["_t", "event_id"])
        out = []
        for now in rows["_t"]:
            kept, ok = step(kept, now, limit, seconds)
            out.append(ok)
        state.update((kept,))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield rows[[key, "event_id"]].assign(accepted=out)

    kinds = dict(events.dtypes)
    schema = f"{key} {kinds[key]}, event_id {kinds['event_id']}, accepted boolean"
    rows = events.select(key, "event_id", seconds_of("ts").alias("_t"))
    return rows.groupBy(key).applyInPandasWithState(update, schema, "kept array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)
