"""Exact top-k search by inner product with a vector-approximation file.

Every component of every candidate is known by its cell on a grid of CELLS even intervals between the least and the
greatest value of its dimension over all candidates: one byte instead of eight. The cells of all candidates are a
table of their own, written once. A query's product with a cell's vector is q . (low + cell * step) plus something
between the sums of the negative and of the positive q * step, so one product with the cells bounds all candidates
from both sides. A scan reads the cells alone; it keeps what reaches the k-th greatest lower bound of its task, and
what reaches that of all tasks is left.

The exact vectors of these are then fetched by id in the order of their upper bounds: READ of a query in the first round, four
times as many in each further one, until the k-th score found is above every bound left and the result is certain.

Equal vectors score equally and ties go to the smaller id, so of each vector only the k + 1 smallest ids can be in any
answer (one may be the query's own): the others are dropped by a window with a group limit before the cells are
written. A vector that a third of the rows hold is then k + 1 rows.

Queries come in blocks of at most BLOCK_QUERIES, a size bound for what is broadcast. The grid is two numbers a
dimension.

Defined results
* a vector that is null, empty, or holds null or non-finite components takes no part, nor does one with a component
  that is not finite once it is scaled, nor one of another dimension than the query's; null ids take no part;
* products beyond 2**53 are computed with Python integers; a score beyond a long is the nearest long;
* rows that repeat an id and its vector count once; an id with several vectors: each is a candidate, but none for a
  query of that id; a query id with several vectors gets the k best over all of them;
* empty tables: no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import forget, shared_dir, written

BLOCK_QUERIES = 16_384
CELLS = 256
READ = 20
EXACT = float(1 << 53)
LONG = (1 << 63) - 1


def matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one dimension, none null, as rows of float64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def by_dimension(batch: pa.RecordBatch, column: str):
    """(dimension, rows) of a batch of vectors."""
    vectors = batch.column(column)
    length = pc.binary_length if pa.types.is_binary(vectors.type) else pc.list_value_length
    sizes = length(vectors).to_numpy(zero_copy_only=False)
    for d in np.unique(sizes).tolist():
        yield d, batch.filter(pa.array(sizes == d))


def grid_of(vectors: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """dimension -> least values and steps; from every task's extremes, some numbers a dimension."""

    def extremes(batches):
        for batch in batches:
            for d, rows in by_dimension(batch, "vector"):
                x = matrix(rows.column("vector"))
                cells = [np.full(d, d), np.arange(d), x.min(0), x.max(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cells], names=["d", "at", "low", "high"])

    found = vectors.select("vector").mapInArrow(extremes, "d long, at long, low double, high double")
    rows = found.groupBy("d", "at").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d", "at").toArrow().to_pandas()
    out = {}
    for d, some in rows.groupby("d"):
        low, high = some["low"].to_numpy(), some["high"].to_numpy()
        out[int(d)] = (low, high / CELLS - low / CELLS)
    return out


def approximation(vectors: DataFrame, grid: dict) -> DataFrame:
    """vec_id, cells (a byte a dimension) of every vector, as a table of the shared folder."""
    sent = vectors.sparkSession.sparkContext.broadcast(grid)

    def code(batches):
        for batch in batches:
            for d, rows in by_dimension(batch, "vector"):
                low, step = sent.value[d]
                x = matrix(rows.column("vector"))
                cells = np.clip(np.floor((x - low) / np.where(step > 0, step, 1.0)), 0, CELLS - 1).astype(np.uint8)
                raw = pa.Array.from_buffers(pa.binary(d), len(x), [None, pa.py_buffer(np.ascontiguousarray(cells))])
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), raw.cast(pa.binary())], names=["vec_id", "cells"])

    return written(vectors.mapInArrow(code, "vec_id long, cells binary"), "cells")


def bounds(cells: np.ndarray, queries: np.ndarray, low: np.ndarray, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest product of each candidate (row) with each query (column)."""
    with np.errstate(all="ignore"):
        wide = queries * step
        middle = cells.astype(np.float64) @ wide.T + queries @ low
        # rounding may put a value just outside its cell, and the sums have errors of their own
        slack = 1e-9 * (np.abs(queries) @ (np.abs(low) + CELLS * step)) + 1e-9
        below, above = middle + np.minimum(wide, 0).sum(1) - slack, middle + np.maximum(wide, 0).sum(1) + slack
        sure = np.isfinite(below) & np.isfinite(above)
    return np.where(sure, np.minimum(below, LONG), -np.inf), np.where(sure, np.maximum(above, -LONG), np.inf)


def scores(vectors: np.ndarray, queries: np.ndarray) -> list[int]:
    """The product of each row with the other's row of the same number."""
    with np.errstate(all="ignore"):
        safe = np.abs(vectors).max(1, initial=0) * np.abs(queries).max(1, initial=0) * max(1, vectors.shape[1]) < EXACT
    out = np.zeros(len(vectors), np.int64)
    out[safe] = np.einsum("ij,ij->i", vectors[safe], queries[safe]).astype(np.int64)
    for i in np.flatnonzero(~safe):
        out[i] = min(LONG, max(-LONG - 1, sum(int(a) * int(b) for a, b in zip(vectors[i], queries[i], strict=True))))
    return out.tolist()


def integer_vectors(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and vector, array<double> of floor(scale * component); rows that take no part are left out."""
    sound = F.col("embedding").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0)
    finite = lambda v: F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    whole = lambda v: F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)  # noqa: E731  whole already beyond
    as_is = F.transform("embedding", lambda x: whole(x.cast("double") * scale))
    return vectors.where(sound).where(finite("embedding")).select("vec_id", as_is.alias("vector")).where(finite("vector"))


def scanned(cells: DataFrame, block, grid, k: int) -> DataFrame:
    """q, query_id, vec_id, below, above: what may be among the k best of query number q."""

    def scan(batches):
        best: dict[int, np.ndarray] = {}  # the k greatest lower bounds of each query so far in this task
        for batch in batches:
            for d, rows in by_dimension(batch, "cells"):
                if d not in block.value:
                    continue
                ids, (numbers, query_ids, queries), (low, step) = rows.column("vec_id").to_numpy(), block.value[d], grid.value[d]
                coded = np.frombuffer(b"".join(rows.column("cells").to_pylist()), np.uint8).reshape(len(ids), d)
                top = best.setdefault(d, np.full((k, len(numbers)), -np.inf))
                for a in range(0, len(numbers), 512):
                    some = slice(a, min(len(numbers), a + 512))
                    below, above = bounds(coded, queries[some], low, step)
                    own = ids[:, None] == query_ids[some][None, :]
                    below[own], above[own] = -np.inf, -np.inf
                    both = np.concatenate([top[:, some], np.partition(below, len(ids) - k, axis=0)[-k:] if len(ids) > k else below])
                    top[:, some] = np.partition(both, len(both) - k, axis=0)[-k:]
                    i, j = np.nonzero((above >= top[:, some].min(0)) & ~own)
                    cols = [numbers[some][j], query_ids[some][j], ids[i], below[i, j], above[i, j]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["q", "query_id", "vec_id", "below", "above"])

    return cells.mapInArrow(scan, "q long, query_id long, vec_id long, below double, above double")


def read_exact(some: DataFrame, vectors: DataFrame, block) -> DataFrame:
    """q, query_id, vec_id, score of the pairs of some, with the exact vectors that are fetched for them."""

    def score(batches):
        for batch in batches:
            for d, rows in by_dimension(batch, "vector"):
                if d not in block.value:
                    continue
                numbers, _, queries = block.value[d]
                q = rows.column("q").to_numpy()
                place = np.minimum(np.searchsorted(numbers, q), len(numbers) - 1)
                known = numbers[place] == q  # another vector of the id may have another dimension
                rows, place = rows.filter(pa.array(known)), place[known]
                found = scores(matrix(rows.column("vector")), queries[place]) if len(place) else []
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in ("q", "query_id", "vec_id")), pa.array(found, pa.int64())], names=["q", "query_id", "vec_id", "score"])

    joined = some.select("q", "query_id", "vec_id").distinct().join(vectors, "vec_id").select("q", "query_id", "vec_id", "vector")
    return joined.mapInArrow(score, "q long, query_id long, vec_id long, score long")


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each query by inner product.

    Both tables: vec_id long, vector array<double> of whole numbers.
    """
    spark = candidates.sparkSession
    shared_dir(spark)
    same = Window.partitionBy("vector").orderBy("vec_id")
    kept = candidates.select("vec_id", "vector").distinct().withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).drop("_n")
    kept = written(kept, "vectors")
    asked = written(queries.select("vec_id", "vector").distinct(), "queries")
    grid = grid_of(kept)
    cells, sent = approximation(kept, grid), spark.sparkContext.broadcast(grid)
    blocks, done, first = max(1, -(-asked.count() // BLOCK_QUERIES)), [], 0
    for b in range(blocks):
        some = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)) == b)
        rows = some.toArrow()  # about BLOCK_QUERIES rows
        by_size: dict[int, list] = {}
        for i, v in zip(rows.column("vec_id").to_pylist(), rows.column("vector").to_pylist(), strict=True):
            by_size.setdefault(len(v), []).append((first, i, v))
            first += 1
        columns = lambda x: (np.array([n for n, _, _ in x], np.int64), np.array([i for _, i, _ in x], np.int64), np.array([v for _, _, v in x], np.float64))
        block = spark.sparkContext.broadcast({d: columns(x) for d, x in by_size.items()})
        found = written(scanned(cells, block, sent, k), "bounds")
        order = Window.partitionBy("q").orderBy(F.col("below").desc(), "vec_id")
        least = found.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k).groupBy("q").agg(F.min("below").alias("least"), F.max("_n").alias("n"))
        left = found.join(least, "q").where(f"n < {k} OR above >= least").select("q", "query_id", "vec_id", "above")
        by_bound = Window.partitionBy("q").orderBy(F.col("above").desc(), "vec_id")
        left = written(left.withColumn("place", F.row_number().over(by_bound)), "left")
        upto, read = READ, []
        while True:
            read.append(written(read_exact(left.where(f"place <= {upto}"), kept, block), "exact"))
            whole = read[0]
            for part in read[1:]:
                whole = whole.unionByName(part)
            sure = whole.withColumn("_n", F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("_n") == k).select("q", F.col("score").alias("kth"))
            rest = written(left.where(f"place > {upto}").join(sure, "q", "left").where("kth IS NULL OR above >= kth").select(*left.columns), "left")
            forget(left)
            if rest.isEmpty():
                break
            left, upto = rest, upto * 4
        forget(found, rest)
        done.append(whole)
    every = done[0]
    for part in done[1:]:
        every = every.unionByName(part)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return every.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_exact_top_k(spark, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for every vector whose id is divisible by 50."""
    vectors = integer_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR NOT isfinite(x::DOUBLE * 256))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
