"""All-or-nothing reservations over several budgets, replayed from an operation log, and their settlement.

Budgets that are ever asked for together must be decided in one place, so a log is dealt by its scope (for example an
account): within a scope operations run in order, scopes are independent.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def step(used: dict, op: dict) -> tuple[dict, bool, str]:
    """Applies a reserve (all asks fit, or none is taken) or an adjust (never below zero); ok, and the first full bucket."""
    if op["op"] == "adjust":
        for a in op["asks"]:
            k = (a["bucket"], a["win"])
            used = used | {k: max(0, used.get(k, 0) + a["amount"])}
        return used, True, ""
    for a in sorted(op["asks"], key=lambda a: (a["bucket"], a["win"])):
        if used.get((a["bucket"], a["win"]), 0) + a["amount"] > a["cap"]:
            return used, False, a["bucket"]
    for a in op["asks"]:
        k = (a["bucket"], a["win"])
        used = used | {k: used.get(k, 0) + a["amount"]}
    return used, True, ""


def replay(log: DataFrame, scope: str) -> DataFrame:
    """scope, seq, ok, full of a log of scope, seq, op, asks (array of bucket, win, amount, cap)."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, used = None, {}
        for frame in frames:
            out = []
            for s, op, asks in zip(frame[scope], frame["op"], frame["asks"], strict=True):
                if s != current:
                    current, used = s, {}
                used, ok, full = step(used, {"op": op, "asks": list(asks)})
                out.append((ok, full))
            yield frame[[scope, "seq"]].assign(ok=[o for o, _ in out], full=[f for _, f in out])

    dealt = log.select(scope, "seq", "op", "asks").repartition(scope).sortWithinPartitions(scope, "seq")
    kinds = dict(log.dtypes)
    return dealt.mapInPandas(fold, f"{scope} {kinds[scope]}, seq {kinds['seq']}, ok boolean, full string")
