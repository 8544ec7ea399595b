"""Objects of a JSON array out of chunks that may end anywhere: batch and streaming."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: What matters outside of a string, and inside of one: an escape with what it escapes, or the end.
STRUCTURE, STRING = re.compile(r'["{}\[\]:,]'), re.compile(r'(?s)\\.|"')

#: What is kept between chunks: an escape that waits for its second half, the open brackets, whether a string is open,
#: the string and the key last read in the outermost object, and the text so far of an open object of the array.
START = ("", "", False, "", "", "")
STATE = "rest string, stack string, quoted boolean, word string, name string, item string"


def push(state: tuple, chunk: str, key: str = "items") -> tuple[tuple, list[str]]:
    """The new state, and the raw JSON of every object of the top-level array key that this chunk completes."""
    rest, stack, quoted, word, name, item = state
    text, at, out = rest + chunk, 0, []
    opened = 0 if item else None  # where the open object's text goes on in this chunk
    spelled = 0 if quoted and len(stack) == 1 else None  # the same for a string of the outermost object
    while found := (STRING if quoted else STRUCTURE).search(text, at):
        mark, at = found.group(), found.end()
        if mark == '"':
            quoted = not quoted
            if len(stack) == 1 and quoted:
                word, spelled = "", found.start()
            elif spelled is not None:
                word, spelled = word + text[spelled:at], None
        elif quoted:
            continue
        elif mark in "[{":
            if mark == "{" and stack == "{[" and name == key:
                opened = found.start()
            stack += mark
        elif mark in "]}":
            stack = stack[:-1]
            if opened is not None and stack == "{[":
                out.append(item + text[opened:at])
                item, opened = "", None
        elif len(stack) == 1:
            name = plain(word) if mark == ":" else ""
    rest = "\\" if quoted and text.endswith("\\") and at < len(text) else ""
    body = text[: len(text) - len(rest)]
    if opened is not None:
        item += body[opened:]
    if spelled is not None:
        word += body[spelled:]
    return (rest, stack, quoted, word, name, item), out


def plain(word: str) -> str:
    try:
        return json.loads(word)
    except ValueError:
        return ""


def scanned(chunks: DataFrame, request: str, order: str, key: str = "items") -> DataFrame:
    """request, pos, item of batch chunks: dealt by request, sorted, folded; one request's state is held at a time."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state, n = None, START, 0
        for frame in frames:
            rows = []
            for r, chunk in zip(frame[request], frame["chunk"], strict=True):
                if r != current:
                    current, state, n = r, START, 0
                state, items = push(state, chunk or "", key)
                rows += [(r, n + i, item) for i, item in enumerate(items)]
                n += len(items)
            yield pd.DataFrame(rows, columns=[request, "pos", "item"])

    dealt = chunks.select(request, order, "chunk").repartition(request).sortWithinPartitions(request, order)
    return dealt.mapInPandas(fold, f"{request} {dict(chunks.dtypes)[request]}, pos int, item string")


def scanned_stream(chunks: DataFrame, request: str, order: str, key: str = "items", timeout_ms: int | None = None) -> DataFrame:
    """The same over a stream: the state of each request is in the state store.

    timeout_ms: a stream that runs on forgets a request that nothing has come for in so long. Without it (runs over what
    is available) nothing is forgotten.
    """

    def update(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, n = (tuple(state.get[:-1]), state.get[-1]) if state.exists else (START, 0)
        rows = []
        for chunk in pd.concat(list(frames)).sort_values(order)["chunk"]:
            held, items = push(held, chunk or "", key)
            rows += [(k[0], n + i, item) for i, item in enumerate(items)]
            n += len(items)
        state.update((*held, n))
        if timeout_ms:
            state.setTimeoutDuration(timeout_ms)
        yield pd.DataFrame(rows, columns=[request, "pos", "item"])

    schema = f"{request} {dict(chunks.dtypes)[request]}, pos int, item string"
    return chunks.groupBy(request).applyInPandasWithState(update, schema, f"{STATE}, n int", "append", GroupStateTimeout.ProcessingTimeTimeout if timeout_ms else GroupStateTimeout.NoTimeout)
