"""Events of a plan that arrives step by step: what is shown after each, and how a request ends; a batch and a streaming twin.

Kinds are start, step, done and error. A start shows a plan without steps, also in place of an earlier one; each step adds
one. A step before any start breaks the request. Nothing counts after a request is done, failed or broken. Any other kind,
null too, changes nothing and shows nothing. Events of a request that have the same order are read in the order of their kinds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

KINDS = ["done", "error", "start", "step"]
ENDS = {"done": "finished", "error": "failed"}
#: Steps that are shown, or this while there was no start; and once a request has ended.
UNBEGUN, ENDED = -1, -2


def previews(events: DataFrame, request: str, order: str) -> DataFrame:
    """request, order, outcome (preview, finished, failed, broken), n_steps: a row for each event that counts."""
    by = Window.partitionBy(request).orderBy(order, "kind").rowsBetween(Window.unboundedPreceding, 0)
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    known = events.where(F.col("kind").isin(KINDS)).select(request, order, "kind")
    started = known.withColumn("_run", F.count_if(F.col("kind") == "start").over(by))
    broken = (F.col("kind") == "step") & (F.col("_run") == 0)
    ends = started.withColumn("_end", broken | F.col("kind").isin(*ENDS)).withColumn("_ended", F.coalesce(F.max("_end").over(before), F.lit(False)))
    of_run = Window.partitionBy(request, "_run").orderBy(order, "kind").rowsBetween(Window.unboundedPreceding, 0)
    steps = F.when(F.col("_run") > 0, F.count_if(F.col("kind") == "step").over(of_run)).otherwise(0)
    outcome = F.when(F.col("kind") == "done", "finished").when(F.col("kind") == "error", "failed").when(broken, "broken").otherwise("preview")
    return ends.withColumns({"n_steps": steps, "outcome": outcome}).where(~F.col("_ended")).select(request, order, "outcome", "n_steps")


def endings(shown: DataFrame, request: str, order: str) -> DataFrame:
    """request, ending (finished, failed, broken or cut_off), n_steps of each request that showed anything."""
    last = shown.groupBy(request).agg(F.max(F.struct(order, F.when(F.col("outcome") == "preview", 0).otherwise(1).alias("end"), "outcome", "n_steps")).alias("x"))
    return last.select(request, F.when(F.col("x.outcome") == "preview", "cut_off").otherwise(F.col("x.outcome")).alias("ending"), "x.n_steps")


def step(steps: int, kind: str) -> tuple[int, str | None, int]:
    """The state after an event, its outcome (None: it does not count) and the steps that are shown."""
    if steps == ENDED or kind not in KINDS:
        return steps, None, 0
    if kind == "start":
        return 0, "preview", 0
    if kind in ENDS:
        return ENDED, ENDS[kind], max(steps, 0)
    return (ENDED, "broken", 0) if steps == UNBEGUN else (steps + 1, "preview", steps + 1)


def preview_stream(events: DataFrame, request: str, order: str) -> DataFrame:
    """The rows of previews over a stream whose batches bring a request's events in order; a request's state is one number."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, out = state.get[0] if state.exists else UNBEGUN, []
        rows = pd.concat(list(frames)).sort_values([order, "kind"])
        for at, kind in zip(rows[order], rows["kind"], strict=True):
            steps, outcome, shown = step(steps, kind)
            if outcome:
                out.append((key[0], at, outcome, shown))
        state.update((steps,))
        yield pd.DataFrame(out, columns=[request, order, "outcome", "n_steps"])

    kinds = dict(events.dtypes)
    schema = f"{request} {kinds[request]}, {order} {kinds[order]}, outcome string, n_steps long"
    return events.select(request, order, "kind").groupBy(request).applyInPandasWithState(update, schema, "steps long", "append", GroupStateTimeout.NoTimeout)
