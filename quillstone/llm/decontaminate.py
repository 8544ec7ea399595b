"""Benchmark decontamination by a prefix-filtered set join with exact verification.

Words are runs of letters, digits and non-ASCII characters, with A-Z lower-cased. A window is WINDOW consecutive words
of an item (an item of fewer words is one window). A window occurs in a document only if all of its word shingles do,
so one shingle of each window, its rarest over all documents, is enough to find every candidate: that is the prefix
of a containment join at threshold 1. A hit of the prefix shingle at a document position fixes where the window
would begin (positional bound) and that it must end inside the document (length bound); the words are then compared
one by one.

Two narrow passes over the documents: one counts the benchmark's shingles over the corpus, one finds and verifies.
Neither shuffles texts. The benchmark reaches the tasks in blocks of at most BLOCK_WORDS words, one pass a block that is
written before the next one begins, so what a task holds is bounded whatever the benchmark's size; within a pass a document's words are mapped to the ids of
the block's words, which turns shingles into vectorised rolling hashes.

Defined results
* null or empty texts and items have no words and link with nothing; a null item_id sorts as empty text;
* equal items and equal windows each count; repeated documents each get their row;
* an empty benchmark leaves all documents clean; an empty documents table gives no rows;
* a text may be of any length that one task can hold (about 20 times a text's bytes are used for it); items that tie
  are listed in the order of their ids;
* extra columns pass through; those called like an output column are replaced.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.text import LOWER, split_words, text_slices
from quillstone.session import forget, written

WINDOW = 10
SHINGLE = 5
BLOCK_WORDS = 500_000
#: Fixed value: what a word is.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes that end a word become spaces; the others of a word are lower-cased.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 32 for b in LOWER)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


class Block:
    """A block of items: its words, windows, shingles and, once chosen, the prefix shingle of each window."""

    def __init__(self, item_ids: list, texts: list[str | None]):
        counts, words = split_words(pa.array(texts, pa.string()), WORD_BYTES)
        coded = words.dictionary_encode()
        self.words = coded.dictionary
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.item_ids = item_ids
        windows: dict[tuple, list[int]] = {}
        at = 0
        for i, n in enumerate(counts.tolist()):
            item = ids[at : at + n].tolist()
            at += n
            for j in range(max(1, n - WINDOW + 1) if n else 0):
                owners = windows.setdefault(tuple(item[j : j + WINDOW]), [])
                if not owners or owners[-1] != i:
                    owners.append(i)
        self.windows, self.owners = list(windows), list(windows.values())
        self.shingles: dict[tuple, int] = {}
        for w in self.windows:
            n = min(SHINGLE, len(w))
            for j in range(len(w) - n + 1):
                self.shingles.setdefault(w[j : j + n], len(self.shingles))
        self.by_length = {n: self._sorted([s for s in self.shingles if len(s) == n]) for n in sorted({len(s) for s in self.shingles})}

    @classmethod
    def of(cls, state: dict) -> Block:
        block = cls.__new__(cls)
        block.__dict__.update(state)
        return block

    def _sorted(self, some: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        rows = np.array(some, np.int64)
        h = hashed([rows[:, j] for j in range(rows.shape[1])])
        order = np.argsort(h, kind="stable")
        return h[order], np.array([self.shingles[s] for s in some])[order]

    def choose(self, frequency: np.ndarray) -> None:
        """Orders each window's shingles by rarity and keeps the first."""
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for i, w in enumerate(self.windows):
            n = min(SHINGLE, len(w))
            own = [(int(frequency[self.shingles[w[j : j + n]]]), j) for j in range(len(w) - n + 1)]
            j = min(own)[1]
            self.prefix.setdefault(self.shingles[w[j : j + n]], []).append((i, j))
        used = np.array(sorted(self.prefix))
        self.by_length = {n: (h[keep], s[keep]) for n, (h, s) in self.by_length.items() if (keep := np.isin(s, used)).any()}

    def ids_of(self, words: pa.Array) -> np.ndarray:
        return pc.fill_null(pc.index_in(words, value_set=self.words.cast(words.type)), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def found(self, ids: np.ndarray, counts: np.ndarray):
        """(position, shingle) of each shingle that begins at a position and ends inside its document."""
        left = np.repeat(np.cumsum(counts), counts) - np.arange(len(ids))  # words from here to the document's end
        for n, (hashes, shingles) in self.by_length.items():
            if len(ids) < n:
                continue
            known = ids >= 0
            m = len(ids) - n + 1
            full = left[:m] >= n
            for j in range(n):
                full &= known[j : j + m]
            at = np.flatnonzero(full)
            h = hashed([ids[at + j] for j in range(n)])
            place = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = hashes[place] == h
            yield at[hit], shingles[place[hit]]


def hashed(columns: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = (h ^ (c.astype(np.uint64) + np.uint64(1))) * FACTOR
        h ^= h >> np.uint64(29)
    return h


def shingle_frequencies(docs: DataFrame, block, size: int) -> np.ndarray:
    """In how many places of the corpus each of the block's shingles occurs; one row a shingle comes back."""

    def count(batches):
        total, own = np.zeros(size, np.int64), Block.of(block.value)
        for batch in text_slices(batches):
            counts, words = split_words(batch.column("text"), WORD_BYTES)
            for _, shingles in own.found(own.ids_of(words), counts):
                total += np.bincount(shingles, minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["shingle", "n"])

    rows = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(size, np.int64)
    frequency[rows.column("shingle").to_numpy()] = rows.column("n").to_numpy()
    return frequency


def _verified(block: Block, ids: np.ndarray, counts: np.ndarray):
    """(window, first position) of every exact occurrence."""
    ends = np.cumsum(counts)
    for places, shingles in block.found(ids, counts):
        for place, shingle in zip(places.tolist(), shingles.tolist(), strict=True):
            doc = int(np.searchsorted(ends, place, "right"))
            for window, offset in block.prefix[shingle]:
                words, start = block.windows[window], place - offset
                if start >= ends[doc] - counts[doc] and start + len(words) <= ends[doc] and tuple(ids[start : start + len(words)].tolist()) == words:
                    yield doc, window, start


def item_blocks(items: DataFrame):
    """Lists of (item_id, text) of at most BLOCK_WORDS words, or one item."""
    held, size = [], 0
    for row in items.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        n = len(row[1] or "") // 2 + 1  # at least as many as it has words
        if held and size + n > BLOCK_WORDS:
            yield held
            held, size = [], 0
        held.append((row[0] or "", row[1]))
        size += n
    if held:
        yield held


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs with n_words, hits (array of [first, last] word ranges, disjoint and sorted) and leaked_items (sorted)."""
    spark = docs.sparkSession
    out = ["n_words", "hits", "leaked_items"]
    docs = docs.drop(*out)
    found = docs.withColumns({"n_words": F.lit(0).cast("long"), "hits": F.array().cast("array<array<int>>"), "leaked_items": F.array().cast("array<string>")})
    blocks, before = item_blocks(items), None
    for held in chain([next(blocks, [])], blocks):  # one block of items at a time is on the driver
        if before is not None:
            found = written(found, "hits")
            if hasattr(before, "shared_path"):
                forget(before)
        before = found
        own = Block([i for i, _ in held], [t for _, t in held])
        plain = spark.sparkContext.broadcast(dict(vars(own)))
        own.choose(shingle_frequencies(docs, plain, len(own.shingles)) if own.shingles else np.zeros(0, np.int64))
        ready = spark.sparkContext.broadcast(vars(own))

        def verify(batches, ready=ready):
            block = Block.of(ready.value)
            for batch in text_slices(batches):
                counts, words = split_words(batch.column("text"), WORD_BYTES)
                ids = block.ids_of(words)
                firsts = np.cumsum(counts) - counts
                places: dict[int, list] = {}
                items: dict[int, set] = {}
                for doc, window, start in _verified(block, ids, counts):
                    first = start - int(firsts[doc])
                    places.setdefault(doc, []).append([first, first + len(block.windows[window]) - 1])
                    items.setdefault(doc, set()).update(block.item_ids[i] for i in block.owners[window])
                hits, leaked = batch.column("hits").to_pylist(), batch.column("leaked_items").to_pylist()
                for doc, some in places.items():
                    hits[doc] = merged(hits[doc] + some)
                    leaked[doc] = sorted(set(leaked[doc]) | items[doc])
                new = {"n_words": pa.array(counts), "hits": pa.array(hits, pa.list_(pa.list_(pa.int32()))), "leaked_items": pa.array(leaked, pa.list_(pa.string()))}
                names = batch.schema.names
                yield pa.RecordBatch.from_arrays([new.get(n, batch.column(i)) for i, n in enumerate(names)], names=names)

        found = found.mapInArrow(verify, found.schema)
    return found


def merged(ranges: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def remove_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no window of any item."""
    return find_leaks(docs, items).where(F.size("hits") == 0).select(*docs.columns)


def op4_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r[1] - r[0] + 1)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("leaked_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leaked_items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )


_words = lambda t: f"regexp_extract_all(translate(coalesce({t}, ''), '{UPPER}', '{UPPER.lower()}'), '{WORD}')"
SQL = f"""
WITH items AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW} - 1], ' ') AS s
  FROM items, range(1, greatest(len(w) - {WINDOW} - 1 + 3, 2)) t(i) WHERE len(w) > 0),
lengths AS (SELECT DISTINCT n FROM windows),
docs AS (SELECT doc_id, {_words("text")} AS w FROM documents),
spots AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM docs, lengths, range(1, greatest(len(w) - n + 2, 1)) t(i)),
found AS (SELECT doc_id, item_id, i, n FROM spots JOIN windows USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM found, range(i, i + n) t(p) GROUP BY doc_id),
leaked AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN leaked USING (doc_id)
"""
