"""Periodic runs of words in whole texts: a harmonic grid of longest common extensions.

A run is a stretch of consecutive words of smallest period q (words q apart are the same) with at least
max(LEAST, TIMES * q) words that no neighbouring word extends. For each period p the text is cut by a grid of
multiples of p. A run of that period holds two grid points a period apart, so the longest common extensions of the two
places jp and (j+1)p, forwards and backwards, give the run's ends. As runs have at least max(LEAST, TIMES * p) words,
every s-th multiple of p is enough, s = (max(LEAST, TIMES * p) - p) // p; so a text of n words has about
n / (TIMES - 1) * ln(n) grid points.

Extensions come from a suffix array of the words, its array of longest common prefixes and range minima over it;
backward ones from the same over the reversed text. The suffix array is made by doubling, sorting only the suffixes
that are still tied. Grid points whose extensions are plainly too short are out before: of a long enough one, either
the NEAR words from the place on or the NEAR words before it are the same. Texts without such a place need no suffix
array. All steps are numpy over the texts of a batch; a text is never split over tasks, and nothing is shuffled.

Defined results
* [\\x20\\x09-\\x0D]+ parts words, letters keep their case; null, empty and blank texts have no words and no runs;
* repeated rows each give a row, a null doc_id passes through; extra columns pass by; an empty table gives no rows;
* a run whose period is a multiple of its smallest one is reported once, with the smallest;
* texts may be of any length that one task can hold (some 100 to 300 bytes a word).
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.text import split_words, text_slices

LEAST = 24
TIMES = 3
NEAR = 8
#: Grid points looked at together.
POINTS = 4_000_000
BLOCK = 32
AS_IS = bytes(range(256))


class Minima:
    """Minima of any range of an array: within blocks from either end, and a sparse table over the blocks."""

    def __init__(self, values: np.ndarray):
        blocks = max(1, -(-len(values) // BLOCK))
        held = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        held[: len(values)] = values
        self.values = held
        by = held.reshape(blocks, BLOCK)
        self.upto = np.minimum.accumulate(by, axis=1).ravel()
        self.since = np.minimum.accumulate(by[:, ::-1], axis=1)[:, ::-1].ravel()
        self.table = [by.min(axis=1)]
        while 2 ** len(self.table) <= blocks:
            last, step = self.table[-1], 2 ** (len(self.table) - 1)
            self.table.append(np.minimum(last[:-step], last[step:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima of values[low..high], both ends included."""
        a, b = low // BLOCK, high // BLOCK
        out = np.minimum(self.since[low], self.upto[high])
        same = np.flatnonzero(a == b)
        if len(same):
            at, end = low[same], high[same]
            least = self.values[at].copy()
            for k in range(1, BLOCK):
                least = np.minimum(least, self.values[np.minimum(at + k, end)])
            out[same] = least
        apart = np.flatnonzero(b - a > 1)
        if len(apart):
            first, last = a[apart] + 1, b[apart] - 1
            level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
            for k in np.unique(level):
                some = level == k
                here = self.table[k]
                middle = np.minimum(here[first[some]], here[last[some] - 2**k + 1])
                out[apart[some]] = np.minimum(out[apart[some]], middle)
        return out


class Extensions:
    """Longest common extensions within texts: owner and code of each word, texts one after another."""

    def __init__(self, owner: np.ndarray, codes: np.ndarray):
        n = len(codes)
        key = owner.astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(key, kind="stable")
        new = np.ones(n, bool)
        new[1:] = key[order][1:] != key[order][:-1]
        common = np.zeros(n, np.int32)
        rank = np.full(n + 1, -1, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        levels, reach = [rank.astype(np.int32)], 1
        ends = np.flatnonzero(np.diff(owner, append=-1)) + 1
        last = ends[np.searchsorted(ends, np.arange(n), side="right")] if n else ends
        tied = ~(new & np.append(new[1:], True))
        while tied.any():
            slots = np.flatnonzero(tied)
            some = order[slots]
            # the next reach words; a suffix that ends before comes first
            then = np.where(some + reach < last[some], rank[np.minimum(some + reach, n)] + 1, 0)
            key = rank[some] * (n + 1) + then
            by = np.argsort(key, kind="stable")
            some, key = some[by], key[by]
            order[slots] = some
            split = np.ones(len(slots), bool)
            split[1:] = key[1:] != key[:-1]
            fresh = np.flatnonzero(split & ~new[slots])
            new[slots] |= split
            u, v = order[slots[fresh] - 1].astype(np.int64), order[slots[fresh]].astype(np.int64)
            length = np.full(len(fresh), reach, np.int64)
            for k in range(len(levels) - 2, -1, -1):
                same = levels[k][u + length] == levels[k][v + length]
                length += np.where(same, 2**k, 0)
            common[slots[fresh]] = length
            rank[some] = np.maximum.accumulate(np.where(split, slots, 0))
            levels.append(rank.astype(np.int32))
            reach *= 2
            tied = ~(new & np.append(new[1:], True))
        self.rank, self.minima = rank[:-1], Minima(common)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and from j on are the same; i and j differ and are of one text."""
        a, b = self.rank[i], self.rank[j]
        return self.minima(np.minimum(a, b) + 1, np.maximum(a, b))


def grid(counts: np.ndarray, least: int, times: int):
    """(text, place, period) of the grid points of texts of so many words, in portions of about POINTS."""
    most = np.where(counts >= least, counts // times, 0)
    owners = np.repeat(np.arange(len(counts)), most)
    period = np.arange(len(owners)) - np.repeat(np.cumsum(most) - most, most) + 1
    stride = (np.maximum(least, times * period) - period) // period * period
    points = (counts[owners] - period - 1) // stride + 1
    upto = np.cumsum(points)
    cuts = [0, *(np.flatnonzero(np.diff(upto // POINTS)) + 1).tolist(), len(points)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        n = points[a:b]
        row = np.repeat(np.arange(a, b), n)
        place = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * stride[row]
        yield owners[row], place, period[row]


def near(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, i: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    """Which of the places i have the same n words from i and i + p on, or before them; the words at i are the same."""
    after, before = np.ones(len(i), bool), np.ones(len(i), bool)
    for k in range(1, n + 1):
        if k < n:
            some = np.flatnonzero(after)
            at = i[some] + k
            after[some] = (at + p[some] < ends[some]) & (codes[at] == codes[np.minimum(at + p[some], len(codes) - 1)])
        some = np.flatnonzero(before)
        at = i[some] - k
        before[some] = (at >= starts[some]) & (codes[np.maximum(at, 0)] == codes[at + p[some]])
    return after | before


def find_runs(counts: np.ndarray, codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Rows text, start, length, period of all runs, in this order. codes: equal numbers for equal words."""
    ends = np.cumsum(counts)
    starts = ends - counts
    # an extension over at least (least - p, or (times - 1) * p) words reaches half of that to one side
    reach = min(NEAR, max(1, (times - 1) * least // times // 2))
    found = []
    for owner, place, p in grid(counts, least, times):
        i = place + starts[owner]
        same = np.flatnonzero(codes[i] == codes[i + p])
        owner, i, p = owner[same], i[same], p[same]
        good = near(codes, starts[owner], ends[owner], i, p, reach)
        found.append((owner[good], i[good], p[good]))
    owner, i, p = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in range(3))
    if not len(i):
        return np.zeros((0, 4), np.int64)
    # only texts with such places; their words one after another
    texts = np.unique(owner)
    n = counts[texts]
    whose = np.repeat(np.arange(len(texts)), n)
    first = np.cumsum(n) - n
    words = np.arange(len(whose)) - first[whose] + starts[texts][whose]
    at = np.searchsorted(texts, owner)
    i = i - starts[owner] + first[at]
    codes, total = codes[words], len(words)
    forward = Extensions(whose, codes)(i, i + p)
    back = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > first[at])
    back[inner] = Extensions(whose[-1] - whose[::-1], codes[::-1])(total - i[inner], total - i[inner] - p[inner])
    length = back + p + forward
    enough = length >= np.maximum(least, times * p)
    rows = np.stack([owner, i - back - first[at], length, p], axis=1)[enough]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh = np.ones(len(rows), bool)
    fresh[1:] = (rows[1:, :3] != rows[:-1, :3]).any(axis=1)
    rows = rows[fresh]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def kept_words(counts: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Which words no run holds behind its first period."""
    starts = np.cumsum(counts) - counts
    change = np.zeros(int(counts.sum()) + 1, np.int64)
    begin = starts[runs[:, 0]] + runs[:, 1]
    np.add.at(change, begin + runs[:, 3], 1)
    np.add.at(change, begin + runs[:, 2], -1)
    return np.cumsum(change[:-1]) == 0


RESULT = "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """doc_id, n_words, runs (by start, then period) and collapsed: the text without the repetitions, words joined by a space."""

    def find(batches):
        for batch in text_slices(batches, text):
            counts, words = split_words(batch.column(text), AS_IS)
            codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            runs = find_runs(counts, codes, least, times)
            keep = kept_words(counts, runs)
            owner = np.repeat(np.arange(len(counts)), counts)
            n_kept = np.bincount(owner[keep], minlength=len(counts))
            lists = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_kept)]), pa.int64()), words.filter(pa.array(keep)))
            collapsed = pc.binary_join(lists, " ").cast(pa.large_string())
            n_runs = np.bincount(runs[:, 0], minlength=len(counts))
            offsets = pa.array(np.concatenate([[0], np.cumsum(n_runs)]).astype(np.int32))
            found = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(runs[:, k]) for k in (1, 2, 3)], names=["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), found, collapsed.cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(find, f"doc_id {key}, {RESULT}")


def summarised(runs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of greatest exponent and digests of the runs and of the collapsed text."""

    def tell(batches):
        for batch in batches:
            out = []
            for held, collapsed in zip(batch.column("runs").to_pylist(), batch.column("collapsed"), strict=True):
                line = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in held)
                best = max(held, key=lambda r: (Fraction(r["length"], r["period"]), -r["start"], -r["period"]), default=None)
                four = [best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]] if best else [None] * 4
                out.append([len(held), *four, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(collapsed.as_buffer()).hexdigest()])
            cells = [pa.array([r[k] for r in out], pa.int64() if k < 5 else pa.string()) for k in range(7)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cells], names=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])

    key = runs.schema["doc_id"].dataType.simpleString()
    return runs.select("doc_id", "runs", "collapsed").mapInArrow(tell, f"doc_id {key}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def with_planted_runs(docs: DataFrame, seed: Column) -> DataFrame:
    """doc_id, text: where seed % 10 is 0, the words from a place on become repetitions of the first few of them.

    Place and period come from the seed; a null seed leaves the text alone.
    """
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    some = docs.select("doc_id", "text", seed.alias("_h")).withColumn("_w", F.when(F.col("_h") % 10 == 0, words))
    some = some.withColumn("_n", F.size("_w").cast("long")).withColumn("_g", F.floor(F.col("_h") / 10))
    some = some.withColumn("_a", F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")))
    rest = F.col("_n") - F.col("_a")
    some = some.withColumn("_p", 1 + F.floor(rest / (3 + F.col("_g") % 8)))
    once = F.slice("_w", (F.col("_a") + 1).cast("int"), F.col("_p").cast("int"))
    again = F.slice(F.flatten(F.array_repeat(once, F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest.cast("int"))
    planted = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a").cast("int")), again), " ")
    return some.select("doc_id", F.when(F.col("_p").isNotNull(), planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which is made periodic from a place on."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return summarised(periodic_runs(with_planted_runs(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")))))
