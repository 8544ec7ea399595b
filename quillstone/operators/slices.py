"""Arrow batches cut into slices of bounded text, so that a Python worker's memory does not follow the size of a batch."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SLICE_BYTES = 4_000_000


def give_back() -> None:
    """What this worker has freed goes back to the system; workers live on after their task and the next one needs it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def given_back(batches):
    """The batches; before the first and after each, memory that is free goes back to the system."""
    give_back()
    for batch in batches:
        yield batch
        give_back()


def text_slices(batches, column: str = "text", most: int = SLICE_BYTES):
    """Record batches cut so that the text column of each holds about most bytes; between them free memory goes back."""
    return given_back(_cut(batches, column, most))


def _cut(batches, column: str, most: int):
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // most)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(ddl))


def in_slices(df: DataFrame, work: Callable, schema: str, column: str = "text", most: int = SLICE_BYTES) -> DataFrame:
    """df.mapInPandas(work, schema), but work is handed frames whose text column holds about most bytes."""
    out = arrow_schema(schema)

    def run(batches):
        for frame in work(b.to_pandas(integer_object_nulls=True) for b in text_slices(batches, column, most)):
            yield pa.RecordBatch.from_pandas(frame, out, preserve_index=False)

    return df.mapInArrow(run, schema)


def items(lists: pa.Array, names: list[str]) -> tuple[list[int], list[list]]:
    """Of an array of lists of structs: where each list begins and the last ends, and the named fields of all of them; null: empty."""
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    flat = lists.flatten()
    return [0, *np.cumsum(counts).tolist()], [pc.struct_field(flat, n).to_pylist() for n in names]
