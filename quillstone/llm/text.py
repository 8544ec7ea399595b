"""Arrow helpers for whole texts: byte translation, ASCII white-space splitting, batches of bounded text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.slices import SLICE_BYTES, give_back, given_back, text_slices  # noqa: F401  the operators here take them from this module
from quillstone.session import written

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where each text begins and ends in the bytes that follow; only the bytes of these texts, not of their batch."""
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    ends = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, wide)
    first, last = int(ends[0]), int(ends[-1])
    return ends - ends.dtype.type(first), memoryview(data)[first:last] if data is not None else memoryview(b"")


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """The texts (null: empty) with each ASCII byte mapped by table; other bytes of UTF-8 stay as they are."""
    texts = texts.fill_null("")
    ends, data = raw_bytes(texts)
    return pa.Array.from_buffers(texts.type, len(texts), [None, pa.py_buffer(ends), pa.py_buffer(bytes(data).translate(table))])


def split_words(texts: pa.Array, table: bytes = LOWER) -> tuple[np.ndarray, pa.Array]:
    """The number of words of each text and the words of all texts one after another; [\\x20\\x09-\\x0D]+ parts words."""
    split = pc.ascii_split_whitespace(translated(texts, table))
    words = split.flatten()
    counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    blank = pc.equal(words, "").to_numpy(zero_copy_only=False)
    if blank.any():
        owner = np.repeat(np.arange(len(counts)), counts)
        counts = counts - np.bincount(owner[blank], minlength=len(counts))
        words = words.filter(pa.array(~blank))
    return counts, words


#: Ids of up to so many rows are broadcast (some 20 MB); more are joined by shuffle.
BROADCAST_IDS = 2_000_000


def without_ids(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is not in gone (one column, key); texts are shuffled only if gone is large."""
    gone = written(gone, "gone")
    small = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if small else gone, key, "left_anti").select(*docs.columns)
