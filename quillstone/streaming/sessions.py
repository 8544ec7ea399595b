"""Call sessions as a state machine over their events, batch and streaming, and items verified as they stream in.

A session's state is its status, its attempts and when it ends. Statuses never move back; an attempt beyond the limit,
an event after the end and an event of a session that never began are refused and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstone.operators import grounding
from quillstone.streaming import scanner
from quillstone.streaming.quotas import seconds_of

RANK = {"placed": 0, "ringing": 1, "talking": 2, "done": 3, "failed": 3}
ATTEMPTS = 3
TTL = 86_400
#: status, attempts, when it ends; an empty status is a session that has not begun.
NEW = ("", 0, 0.0)


def step(state: tuple, kind: str, now: float, ttl: float = TTL, attempts: int = ATTEMPTS) -> tuple[tuple, str]:
    """The state after an event of a kind (start, attempt, or a status) and what became of it: applied or why not."""
    status, tries, ends = state
    if kind == "start":
        live = status and now < ends and RANK[status] < 3
        return (state, "already_live") if live else (("placed", 0, now + ttl), "applied")
    if not status:
        return state, "unknown"
    if now >= ends:
        return state, "stale"
    if RANK[status] == 3:
        return state, "finished"
    if kind == "attempt":
        return (state, "too_many") if tries >= attempts else ((status, tries + 1, ends), "applied")
    if kind not in RANK or RANK[kind] <= RANK[status]:
        return state, "no_move"
    return (kind, tries, ends), "applied"


def sessions(events: DataFrame, session: str, ttl: float = TTL) -> DataFrame:
    """session, event_id, status, attempts, outcome of every event in time order; a task holds one session's state."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, NEW
        for frame in frames:
            out = []
            for s, kind, now in zip(frame[session], frame["kind"], frame["_t"], strict=True):
                if s != current:
                    current, state = s, NEW
                state, outcome = step(state, kind, now, ttl)
                out.append((state[0], state[1], outcome))
            yield frame[[session, "event_id"]].reset_index(drop=True).join(pd.DataFrame(out, columns=["status", "attempts", "outcome"]))

    rows = events.select(session, "event_id", "kind", seconds_of("ts").alias("_t"))
    kinds = dict(events.dtypes)
    dealt = rows.repartition(session).sortWithinPartitions(session, "_t", "event_id")
    return dealt.mapInPandas(fold, f"{session} {kinds[session]}, event_id {kinds['event_id']}, status string, attempts int, outcome string")


def sessions_stream(events: DataFrame, session: str, ttl: float = TTL, timeout_ms: int | None = None) -> DataFrame:
    """The same over a stream; one that runs on sweeps sessions that nothing has come for in timeout_ms, if it is given."""

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, out = tuple(state.get) if state.exists else NEW, []
        rows = pd.concat(list(frames)).sort_values(["_t", "event_id"])
        for kind, now in zip(rows["kind"], rows["_t"], strict=True):
            held, outcome = step(held, kind, now, ttl)
            out.append((held[0], held[1], outcome))
        state.update(held)
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield rows[[session, "event_id"]].reset_index(drop=True).join(pd.DataFrame(out, columns=["status", "attempts", "outcome"]))

    kinds = dict(events.dtypes)
    schema = f"{session} {kinds[session]}, event_id {kinds['event_id']}, status string, attempts int, outcome string"
    rows = events.select(session, "event_id", "kind", seconds_of("ts").alias("_t"))
    return rows.groupBy(session).applyInPandasWithState(update, schema, "status string, attempts int, ends double", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)


def verified_items(items: DataFrame, sources: DataFrame, request: str) -> DataFrame:
    """request, pos, status (grounded, not_found, malformed), start, end of scanned items (request, pos, item).

    sources: request, text. A narrow pass after one join with a static table, so it runs over a stream of items too.
    """
    parsed = items.select(request, "pos", F.from_json("item", "kind STRING, quote STRING").alias("i")).select(request, "pos", "i.kind", "i.quote")
    found = grounding.ground(parsed.join(sources.select(request, "text"), request, "left"), [request, "pos", "kind", "quote"])
    status = F.when(F.col("kind").isNull() | F.col("quote").isNull(), "malformed").when(F.col("start").isNull(), "not_found").otherwise("grounded")
    return found.select(request, "pos", status.alias("status"), "start", "end")


def verified_stream(chunks: DataFrame, sources: DataFrame, request: str, order: str) -> DataFrame:
    """Items out of a stream of chunks, each verified against its request's text as soon as it is complete."""
    return verified_items(scanner.scanned_stream(chunks, request, order), sources, request)
