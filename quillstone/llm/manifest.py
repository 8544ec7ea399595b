"""Merkle manifest of a table: a tree for each language, a tree over their roots, a proof for each row.

A row is a leaf, the SHA-256 of its columns, made where the row is read; from then on only ids and digests move. Leaves
are range-partitioned by (lang, doc_id, leaf), so that a partition holds consecutive leaves. One line of figures a
partition (rows, languages, rows of its first and last language) tells where each partition's leaves stand in their
trees and how wide the trees are.

A fragment is a sparse forest: nodes keyed by (tree, level) and index. Partitions fold all runs of siblings that they
hold whole; only nodes of runs that reach over a partition's edge stay open, at most ARITY - 1 at each end of a level.
Fragments form a commutative monoid: ``merge`` unites the open nodes and folds a run whenever its last sibling arrives
(the width of every level is known, so a last run of fewer is known to be whole). treeReduce merges all of them. Runs
that are folded by a merge reach over partition edges; they are kept as the spine, one run a level and partition edge,
and go back to the partitions, which then hold every sibling on their rows' ways to the root.

What passes through the driver: a line of figures, open nodes and spine runs of each partition, so it is bounded by
partitions x levels x ARITY digests, not by rows or languages; partitions hold ROWS_A_PARTITION rows.

Defined results
* nulls: a null column is written `-`, unlike an empty text `0:`; a null doc_id sorts first; a null language is a tree
  of its own, the first one;
* rows that repeat a doc_id in one language are ordered by their leaf; equal rows have equal leaves and places side by
  side, which of them gets which place makes no difference to any digest;
* one row: leaf, subroot and root are the same, its proof is the digest of nothing;
* an empty table gives no rows; other columns are not part of a leaf and pass by; long texts are hashed whole.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.session import shared_dir

ARITY = 8
ROWS_A_PARTITION = 1_000_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64
TOP = -1  # the tree over the languages' roots


def leaf_digest(text: Column | None = None) -> Column:
    """The digest of a row's fields; text replaces the column of that name."""
    parts = []
    for name in FIELDS:
        value = (text if text is not None and name == "text" else F.col(name)).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def sha(data: bytes) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def height(width: int) -> int:
    """How many levels stand above that many nodes."""
    n = 0
    while width > 1:
        width, n = -(-width // ARITY), n + 1
    return n


def width_at(width: int, level: int) -> int:
    for _ in range(level):
        width = -(-width // ARITY)
    return width


class Forest:
    """A fragment: open nodes, the widths of their trees, and the runs that merges have folded."""

    def __init__(self, trees: int):
        self.widths: dict[int, int] = {TOP: trees}
        self.open: dict[tuple[int, int], dict[int, bytes]] = defaultdict(dict)
        self.spine: dict[tuple[int, int, int], bytes] = {}

    def put(self, tree: int, level: int, index: int, digest: bytes) -> None:
        """Adds a node and folds upwards as far as runs are whole."""
        while True:
            width = width_at(self.widths[tree], level)
            if width == 1 and tree != TOP:
                del self.widths[tree]
                tree, level, index, digest = TOP, 0, tree, digest
                continue
            held = self.open[tree, level]
            held[index] = digest
            first = index - index % ARITY
            run = range(first, min(first + ARITY, width))
            if width == 1 or not all(i in held for i in run):
                return
            children = b"".join(held.pop(i) for i in run)
            if not held:
                del self.open[tree, level]
            self.spine[tree, level, first // ARITY] = children
            level, index, digest = level + 1, first // ARITY, sha(children)

    def merge(self, other: Forest) -> Forest:
        """The union of both; folds what is whole by now. Commutative and associative, an empty forest changes nothing."""
        self.widths |= other.widths
        self.spine |= other.spine
        for (tree, level), held in sorted(other.open.items(), key=lambda x: x[0][1]):
            for index, digest in held.items():
                self.put(tree, level, index, digest)
        return self

    def fold(self, tree: int, first: int, nodes: bytes, level: int = 0) -> bytes | None:
        """Takes consecutive nodes: folds all whole runs at once, level by level; opens what is left at both ends.

        Gives the tree's root if it is among them, and leaves its place in the tree above to the caller.
        """
        while nodes:
            width, count = width_at(self.widths[tree], level), len(nodes) // HEX
            if width == 1:
                return nodes
            last = first + count
            low, high = -(-first // ARITY), -(-last // ARITY) if last == width else last // ARITY
            if low >= high:
                low, high = first // ARITY, first // ARITY
                left, inner, right = nodes, b"", b""
            else:
                a, b = (low * ARITY - first) * HEX, (min(high * ARITY, last) - first) * HEX
                left, inner, right = nodes[:a], nodes[a:b], nodes[b:]
            for at, part in ((first, left), (last - len(right) // HEX, right)):
                for i in range(len(part) // HEX):
                    self.open[tree, level][at + i] = part[i * HEX : (i + 1) * HEX]
            step = ARITY * HEX
            nodes = b"".join(sha(inner[i : i + step]) for i in range(0, len(inner), step))
            first, level = low, level + 1
        return None


def whole_runs(spine: dict, widths: int, tree: int, first: int, nodes: bytes) -> list[tuple[int, bytes]]:
    """For each level below the root: the index and the nodes of all runs that these consecutive leaves stand in."""
    levels, level, width = [], 0, widths
    while width > 1:
        last = first + len(nodes) // HEX
        if first % ARITY:
            run = spine[tree, level, first // ARITY]
            nodes = run[: first % ARITY * HEX] + nodes
            first -= first % ARITY
        if last % ARITY and last < width:
            nodes += spine[tree, level, last // ARITY][last % ARITY * HEX :]
        levels.append((first, nodes))
        step = ARITY * HEX
        nodes = b"".join(sha(nodes[i : i + step]) for i in range(0, len(nodes), step))
        first, level, width = first // ARITY, level + 1, -(-width // ARITY)
    levels.append((first, nodes))
    return levels


class Way:
    """The siblings on the way from nodes of one level to the root, left to right, level by level."""

    def __init__(self, levels: list[tuple[int, bytes]], above: list[tuple[bytes, bytes]]):
        self.levels, self.above, self.known = levels[:-1], above, {}

    def pairs(self, index: int, level: int = 0) -> list[tuple[bytes, bytes]]:
        """(siblings before, siblings after) for each level."""
        if level == len(self.levels):
            return self.above
        first, nodes = self.levels[level]
        start = (index - index % ARITY - first) * HEX
        own = (index - first) * HEX
        parent = index // ARITY
        if self.known.get(level, (None,))[0] != parent:
            self.known[level] = (parent, self.pairs(parent, level + 1))
        return [(nodes[start:own], nodes[own + HEX : start + ARITY * HEX]), *self.known[level][1]]


def segments(batches, columns: list[str]) -> tuple[list[pa.Array], list[tuple[int, int]]]:
    """A partition's columns, and where the rows of each language begin and end; the first column is the language."""
    held = list(batches)
    if not held or not sum(b.num_rows for b in held):
        return [], []
    table = pa.Table.from_batches(held).combine_chunks()
    arrays = [table.column(c).combine_chunks() if table.num_rows else None for c in columns]
    coded = arrays[0].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(coded)) + 1).tolist(), len(coded)]
    return arrays, list(zip(cuts, cuts[1:], strict=False))


def hexes(digests: pa.Array) -> bytes:
    """Fixed-length hexadecimal digests without nulls, one after another."""
    _, offsets, data = digests.buffers()
    wide = np.int64 if pa.types.is_large_string(digests.type) else np.int32
    ends = np.frombuffer(offsets, wide)[digests.offset : digests.offset + len(digests) + 1]
    return memoryview(data)[int(ends[0]) : int(ends[-1])].tobytes()


def placed(leaves: DataFrame) -> tuple[DataFrame, dict[int, tuple], int]:
    """The leaves (lang, doc_id, leaf, ...) in order over partitions that stay as they are; each partition's place; the trees.

    A place: the tree of the first row, its index there, the widths of the first and the last tree.
    """
    spark = leaves.sparkSession
    shared_dir(spark)
    many = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(leaves.count() / ROWS_A_PARTITION))
    # equal rows are told apart by a number, so that a repeated row can fill more than one partition
    order = [F.asc_nulls_first("lang"), F.asc_nulls_first("doc_id"), F.asc("leaf"), F.asc("_n")]
    held = leaves.withColumn("_n", F.xxhash64(F.monotonically_increasing_id()))
    held = held.repartitionByRange(many, *order).sortWithinPartitions(*order).drop("_n").checkpoint()
    name = F.struct(F.col("lang").isNotNull().alias("k"), F.coalesce("lang", F.lit("")).alias("v"))
    by_lang = held.groupBy(F.spark_partition_id().alias("pid"), name.alias("t")).agg(F.count(F.lit(1)).alias("n"))
    lines = by_lang.groupBy("pid").agg(F.count(F.lit(1)), F.min("t"), F.min_by("n", "t"), F.max("t"), F.max_by("n", "t")).orderBy("pid").collect()
    places, widths, rank, before = {}, defaultdict(int), -1, None
    seen = []
    for pid, langs, first, n_first, last, n_last in lines:
        new = before is None or first != before
        rank += new
        seen.append((pid, rank, 0 if new else widths[rank], rank + langs - 1))
        widths[rank] += n_first
        rank += langs - 1
        if langs > 1:
            widths[rank] += n_last
        before = last
    for pid, tree, index, end in seen:
        places[pid] = (tree, index, widths[tree], widths[end])
    return held, places, rank + 1


def fragments(held: DataFrame, places: dict[int, tuple], trees: int) -> DataFrame:
    """A pickled forest of each partition."""
    import pickle

    def fold(batches):
        from pyspark import TaskContext

        arrays, parts = segments(batches, ["lang", "leaf"])
        if not parts:
            return
        tree, index, n_first, n_last = places[TaskContext.get().partitionId()]
        forest, roots, from_ = Forest(trees), b"", None
        for i, (a, b) in enumerate(parts):
            forest.widths[tree] = n_first if i == 0 else n_last if i == len(parts) - 1 else b - a
            root = forest.fold(tree, index, hexes(arrays[1].slice(a, b - a)))
            if root is not None:
                del forest.widths[tree]
                roots, from_ = roots + root, tree if from_ is None else from_
            tree, index = tree + 1, 0
        top = forest.fold(TOP, from_ or 0, roots)
        if top is not None:
            forest.open[TOP, height(trees)][0] = top
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((forest.widths, dict(forest.open)))], pa.binary())], names=["forest"])

    return held.select("lang", "leaf").mapInArrow(fold, "forest binary")


def build(leaves: DataFrame) -> tuple[DataFrame, dict[int, tuple], int, Forest]:
    """The ordered leaves, their places, the number of trees and the one forest that all fragments make."""
    import pickle

    held, places, trees = placed(leaves)

    def load(row) -> Forest:
        forest = Forest(trees)
        forest.widths, nodes = pickle.loads(row[0])
        forest.open.update(nodes)
        return forest

    rdd = fragments(held, places, trees).rdd.map(load)
    depth = max(2, math.ceil(math.log(max(len(places), 2), 16)))
    return held, places, trees, rdd.treeReduce(lambda a, b: a.merge(b), depth) if places else Forest(0)


def manifest_root(docs: DataFrame) -> str | None:
    """The root of a table's manifest; null for an empty table."""
    _, _, trees, forest = build(docs.select("lang", "doc_id", leaf_digest().alias("leaf")))
    return forest.open[TOP, height(trees)][0].decode() if trees else None


def prove(docs: DataFrame, given_text: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row.

    given_text: the text that a row is presented with for verification; the row's own where it is null. folded_root is
    what the presented row and the siblings of its proof fold to.
    """
    given = F.lit(None).cast("string") if given_text is None else F.when(given_text.isNotNull(), leaf_digest(given_text))
    held, places, trees, forest = build(docs.select("lang", "doc_id", leaf_digest().alias("leaf"), given.alias("given")))
    spine = docs.sparkSession.sparkContext.broadcast(forest.spine)

    def tell(batches):
        from pyspark import TaskContext

        arrays, parts = segments(batches, ["lang", "doc_id", "leaf", "given"])
        if not parts:
            return
        tree, index, n_first, n_last = places[TaskContext.get().partitionId()]
        first_tree, ways, roots = tree, [], b""
        for i, (a, b) in enumerate(parts):
            width = n_first if i == 0 else n_last if i == len(parts) - 1 else b - a
            levels = whole_runs(spine.value, width, tree, index, hexes(arrays[2].slice(a, b - a)))
            ways.append((index, levels))
            roots += levels[-1][1]
            tree, index = tree + 1, 0
        top = whole_runs(spine.value, trees, TOP, first_tree, roots)
        root = top[-1][1]
        for i, ((a, b), (index, levels)) in enumerate(zip(parts, ways, strict=True)):
            way = Way(levels, Way(top, []).pairs(first_tree + i))
            for c in range(a, b, 50_000):
                d = min(b, c + 50_000)
                proofs, folded = [], []
                leaves, given = hexes(arrays[2].slice(c, d - c)), arrays[3].slice(c, d - c).to_pylist()
                for k in range(d - c):
                    pairs = way.pairs(index + c - a + k)
                    proofs.append(hashlib.sha256(b"".join([x for pair in pairs for x in pair])).hexdigest())
                    now = given[k].encode() if given[k] else leaves[k * HEX : (k + 1) * HEX]
                    for left, right in pairs:
                        now = sha(left + now + right)
                    folded.append(now.decode())
                n = d - c
                cells = [arrays[1].slice(c, n), arrays[2].slice(c, n), pa.array([levels[-1][1].decode()] * n), pa.array([root.decode()] * n), pa.array(proofs), pa.array(folded)]
                cells.append(pa.array([x == root.decode() for x in folded]))
                yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return held.mapInArrow(tell, f"doc_id {key}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def op13_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    """Proofs of all documents; a third of them is presented with its text in lower case."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return prove(docs, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, lower))


SQL = r"""
WITH RECURSIVE rows AS (
  SELECT *, list_reduce(
      flatten(list_transform(range(1, len(doc_id::VARCHAR) + 1), lambda i: [ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, 4294967295::BIGINT) AS crc
  FROM documents),
put AS (
  SELECT doc_id, lang, xor(crc, 4294967295::BIGINT) % 3 = 0 AS altered,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low
  FROM rows),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || CASE WHEN altered THEN coalesce(strlen(low) || ':' || low, '-') ELSE coalesce(strlen(text) || ':' || text, '-') END) AS given
  FROM put),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM leaves),
nodes AS (
  SELECT tree, 0 AS level, list(leaf ORDER BY i) AS h FROM placed GROUP BY tree
  UNION ALL
  SELECT tree, level + 1, list_transform(range(0, (len(h) + 7) // 8), lambda g: sha256(array_to_string(h[8 * g + 1:8 * g + 8], ''))) FROM nodes WHERE len(h) > 1),
subroots AS (SELECT tree, h[1] AS subroot FROM nodes WHERE len(h) = 1),
tops AS (
  SELECT 0 AS level, list(subroot ORDER BY tree) AS h FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(0, (len(h) + 7) // 8), lambda g: sha256(array_to_string(h[8 * g + 1:8 * g + 8], ''))) FROM tops WHERE len(h) > 1),
ways AS (
  SELECT tree, i, 0 AS level, doc_id, leaf, given AS folded, '' AS proof FROM placed
  UNION ALL
  SELECT w.tree, w.i // 8, w.level + 1, w.doc_id, w.leaf,
    sha256(array_to_string(h[8 * (w.i // 8) + 1:w.i], '') || folded || array_to_string(h[w.i + 2:8 * (w.i // 8) + 8], '')),
    proof || array_to_string(h[8 * (w.i // 8) + 1:w.i], '') || array_to_string(h[w.i + 2:8 * (w.i // 8) + 8], '')
  FROM ways w JOIN nodes n ON n.tree = w.tree AND n.level = w.level WHERE len(h) > 1),
under AS (SELECT w.* FROM ways w JOIN nodes n ON n.tree = w.tree AND n.level = w.level AND len(n.h) = 1),
above AS (
  SELECT tree, tree AS i, 0 AS level, doc_id, leaf, folded, proof FROM under
  UNION ALL
  SELECT w.tree, w.i // 8, w.level + 1, w.doc_id, w.leaf,
    sha256(array_to_string(h[8 * (w.i // 8) + 1:w.i], '') || folded || array_to_string(h[w.i + 2:8 * (w.i // 8) + 8], '')),
    proof || array_to_string(h[8 * (w.i // 8) + 1:w.i], '') || array_to_string(h[w.i + 2:8 * (w.i // 8) + 8], '')
  FROM above w JOIN tops n ON n.level = w.level WHERE len(h) > 1)
SELECT a.doc_id, a.leaf, s.subroot, t.h[1] AS root, sha256(a.proof) AS proof_sha256, a.folded AS folded_root, a.folded = t.h[1] AS verified
FROM above a JOIN tops t ON t.level = a.level AND len(t.h) = 1 JOIN subroots s ON s.tree = a.tree
"""
