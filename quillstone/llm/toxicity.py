"""Toxicity scores from the nearest labelled examples by exact TF-IDF cosine.

Terms are words and word beginnings of 4 to 7 characters, each also as "at least 2 times", "at least 3 times" in the
text, since a beginning that chance gives once is telling when it returns. Which terms count is learnt from at most SAMPLE labelled
rows (the bound on what is fitted): all that toxic examples hold significantly more often, by the log-likelihood
ratio. Document frequencies for the IDF cover all documents. Each document becomes a vector over these terms. (Over
the full vocabulary ordinary words decide which texts are near, and the neighbours tell little: see the README.)

The different vectors of the labelled examples with a term (at most EXAMPLES) are cut into blocks of BLOCK, each with
the greatest weight that a term has there. For a document the block maxima bound the cosine of every block; blocks
whose bound is below the K-th cosine found are passed over. In the others terms that many examples have are multiplied
as dense tiles and the rest by postings, in single precision, many documents at once, and what may be among the K nearest is computed again in double precision, so the neighbours are
exact. Neighbours vote with the square of their cosine, ties going to the smaller id of those that share a strongest
term, and the vote is calibrated by isotonic regression on the examples, each one and all copies of its text left out
of its own vote. Documents without a term get the smoothed share of toxic
ones among the labelled documents without a term. The neighbours are returned as evidence.

Scores read the text only; labels are read from rows that ``learn`` accepts.

Defined results
* null and empty texts have no term and get the score of such documents;
* several labels of a document: toxic if any is; null labels are not read;
* without labels of both kinds all scores are the share of toxic labels (0.5 without any);
* repeated documents each get a row; a null doc_id is scored and never learnt from; an empty table gives no rows;
* a text may be of any length that one task can hold (about 20 times a text's bytes are used for it);
* extra columns of any name pass through; those called like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.decontaminate import WORD_BYTES
from quillstone.llm.text import given_back, split_words, text_slices, without_ids
from quillstone.session import shared_dir, written

SAMPLE = 50_000
EXAMPLES = 20_000
PREFIXES = (4, 5, 7)
TIMES = 3
#: Least number of toxic examples of a term. Its log-likelihood ratio must reach 2 ln(tests), so that about one of all
#: tested terms passes by chance.
LEAST_TOXIC = 3
K = 16
BLOCK = 512
#: A term that more than one in so many vectors has is multiplied densely; postings are cheaper for the others.
DENSE = 50
#: Documents that are searched together, and vectors whose neighbours a task keeps for their copies.
TOGETHER = 512
KNOWN = 10_000
#: More than the error of a cosine of unit vectors in single precision; what it leaves open is computed in double.
SINGLE = 1e-4
#: Weight of the prior in a vote.
PRIOR = 0.05
THRESHOLD = 0.7


def text_terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, term, count) of every term of every text, ordered by text and term, and the terms' names."""
    counts, words = split_words(texts, WORD_BYTES)
    coded = words.dictionary_encode()
    whole = pc.utf8_lower(coded.dictionary)
    if not len(whole):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), whole
    star, none = pa.scalar("*", whole.type), pa.scalar("", whole.type)
    starts = [pc.binary_join_element_wise(pc.utf8_slice_codeunits(whole, 0, n), star, none) for n in PREFIXES]
    names = pa.concat_arrays([whole, *starts]).dictionary_encode()
    codes = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    where = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    n = len(names.dictionary)
    pairs, times = np.unique(np.concatenate([owner * n + codes[where + len(whole) * k] for k in range(len(PREFIXES) + 1)]), return_counts=True)
    return pairs // n, pairs % n, times, names.dictionary


def labelled_sample(labels: DataFrame, learn: Column) -> DataFrame:
    """doc_id, toxic of at most SAMPLE labelled documents, drawn by a hash of the id."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).where(learn)
    one = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)


def covers(beginning: str, term: str, least: int) -> bool:
    """Whether every text that holds term at least so often holds the beginning (a term with a star) as often."""
    stem, letters = beginning[:-1], len(term.rstrip("*"))
    if beginning == term or not beginning.endswith("*") or not term.startswith(stem):
        return False
    if len(stem) not in PREFIXES:  # of a word that is shorter than a beginning
        return term == stem
    # a word that is shorter than a longer beginning has the term several times
    return least == 1 or not term.endswith("*") or sum(n >= letters for n in PREFIXES) == 1


def choose_terms(docs: DataFrame, sample: DataFrame) -> list[tuple[str, int]]:
    """(term, least times) that toxic examples hold significantly more often than others."""

    def count(batches):
        for batch in text_slices(batches):
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            marks = batch.column("mark").to_numpy(zero_copy_only=False)
            owner, term, times, names = text_terms(batch.column("text"))
            for least in range(1, TIMES + 1):
                held = term[times >= least]
                all_, bad = np.bincount(held, minlength=len(names)), np.bincount(term[(times >= least) & toxic[owner]], minlength=len(names))
                some, digest = np.flatnonzero(all_), np.zeros(len(names), np.int64)
                np.add.at(digest, held, marks[owner[times >= least]])
                cells = [names.take(pa.array(some)).cast(pa.string()), pa.array(np.full(len(some), least, np.int32)), pa.array(bad[some]), pa.array(all_[some]), pa.array(digest[some])]
                yield pa.RecordBatch.from_arrays(cells, names=["term", "times", "bad", "n", "digest"])

    sizes = sample.groupBy("toxic").count().collect()  # two rows
    n_bad = sum(r["count"] for r in sizes if r["toxic"] == 1)
    n_all = sum(r["count"] for r in sizes)
    if not 0 < n_bad < n_all:
        return []
    # sums of 40 bits of a hash tell sets of texts apart; they stay in a long for millions of texts
    mark = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 24).alias("mark")
    counts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic", mark).mapInArrow(count, "term string, times int, bad long, n long, digest long")
    counts = written(counts.groupBy("term", "times").agg(*(F.sum(c).alias(c) for c in ("bad", "n", "digest"))).where(F.col("n") >= LEAST_TOXIC), "terms")
    least = 2 * float(np.log(max(2, counts.count())))
    share = n_bad / n_all
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(F.lit(0.0))
    b, g = F.col("bad"), F.col("n") - F.col("bad")
    ratio = 2 * (
        part(b, F.col("n") * share) + part(g, F.col("n") * (1 - share)) + part(n_bad - b, (n_all - F.col("n")) * share) + part(n_all - n_bad - g, (n_all - F.col("n")) * (1 - share))
    )
    best = counts.where((b >= LEAST_TOXIC) & (b > F.col("n") * share)).withColumn("ratio", ratio).where(F.col("ratio") >= least)
    # no more than the sample's texts have significant terms, some thousands
    rows = best.orderBy(F.col("ratio").desc(), "term", "times").select("term", "times", "bad", "n", "digest").collect()
    # a word and its beginnings often stand in the very same texts: a beginning is enough then
    same: dict[tuple, list[str]] = {}
    for r in rows:
        same.setdefault((r["times"], r["bad"], r["n"], r["digest"]), []).append(r["term"])
    alike = lambda r: same[(r["times"], r["bad"], r["n"], r["digest"])]
    return [(r["term"], r["times"]) for r in rows if not any(covers(t, r["term"], r["times"]) for t in alike(r))]


def term_vectors(docs: DataFrame, terms: list[tuple[str, int]]) -> DataFrame:
    """docs without text, with terms and counts (arrays of int) of each document, in order of the terms."""
    names = [c for c in docs.columns if c != "text"]
    number = {t: i for i, t in enumerate(terms)}
    known = sorted({t for t, _ in terms})
    slots = np.array([[number.get((t, k + 1), -1) for k in range(TIMES)] for t in known], np.int64).reshape(-1, TIMES)

    def vectors(batches):
        wanted = pa.array(known, pa.string())
        for batch in text_slices(batches):
            counts, words = split_words(batch.column("text"), WORD_BYTES)
            coded = words.dictionary_encode()
            whole = pc.utf8_lower(coded.dictionary).cast(pa.string())
            # for each different word the terms that it is or begins with; most have none and go at once
            forms = [whole, *(pc.binary_join_element_wise(pc.utf8_slice_codeunits(whole, 0, n), "*", "") for n in PREFIXES)]
            ours = np.stack([pc.fill_null(pc.index_in(f, value_set=wanted), -1).to_numpy(zero_copy_only=False) for f in forms])
            codes = coded.indices.to_numpy(zero_copy_only=False)
            hit = np.flatnonzero((ours >= 0).any(0)[codes]) if len(codes) else np.zeros(0, np.int64)
            owner = np.searchsorted(np.cumsum(counts), hit, "right")
            held = ours[:, codes[hit]].astype(np.int64) if len(hit) else np.zeros((len(forms), 0), np.int64)
            size = max(1, len(known))
            pairs, times = np.unique((owner * size + held)[held >= 0], return_counts=True)
            owner, term = pairs // size, pairs % size
            cells = [(owner[ok], s[ok], times[ok]) for k in range(TIMES) for s in [slots[term, k]] for ok in [(s >= 0) & (times > k)]]
            owner, term, times = (np.concatenate(c) for c in zip(*cells, strict=True))
            order = np.lexsort((term, owner))
            owner, term, times = owner[order], term[order], times[order]
            offsets = pa.array(np.searchsorted(owner, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, times)]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *lists], names=[*names, "terms", "counts"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(vectors, f"{schema}, terms array<int>, counts array<int>")


class BlockMaxIndex:
    """Unit vectors of the examples, equal ones once, with block maxima."""

    def __init__(self, ids: list, toxic: list[int], vectors: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray, marks: list | None = None):
        """marks: what examples are hidden by, the same for copies; their ids if None."""
        order = sorted(range(len(ids)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1] * idf[vectors[i][0]])]), ids[i]))
        self.tiles: dict[int, np.ndarray] = {}
        self.idf, self.ids, self.toxic = idf, [ids[i] for i in order], np.array([toxic[i] for i in order], np.float64)
        self.places: dict = {}
        for i, o in enumerate(order):
            self.places.setdefault((marks or ids)[o], []).append(i)
        #: The examples of each different vector, in order.
        self.members: list[list[int]] = []
        number: dict[tuple, int] = {}
        rows = []
        for i, o in enumerate(order):
            t, w = self.unit(*vectors[o])
            n = number.setdefault((t.tobytes(), w.tobytes()), len(rows))
            if n == len(rows):
                rows.append((t, w))
                self.members.append([])
            self.members[n].append(i)
        vector_of = {e: n for n, some in enumerate(self.members) for e in some}
        #: How many different vectors the examples of each mark have: one for copies, however many they are.
        self.n_vectors = {mark: len({vector_of[e] for e in some}) for mark, some in self.places.items()}
        self.starts = np.cumsum([0, *(len(t) for t, _ in rows)])
        self.term = np.concatenate([np.zeros(0, np.int64), *(t for t, _ in rows)]).astype(np.int32)
        self.weight = np.concatenate([np.zeros(0), *(w for _, w in rows)])
        self.vector = np.repeat(np.arange(len(rows), dtype=np.int32), np.diff(self.starts))
        # terms that many vectors have are columns of dense tiles, the others postings by block and term
        self.dense = np.flatnonzero(np.bincount(self.term, minlength=len(idf)) * DENSE > len(rows))
        self.column = np.full(len(idf), -1)
        self.column[self.dense] = np.arange(len(self.dense))
        rare = np.flatnonzero(self.column[self.term] < 0)
        key = self.vector[rare].astype(np.int64) // BLOCK * len(idf) + self.term[rare]
        by_key = np.argsort(key, kind="stable")
        self.posted = rare[by_key].astype(np.int32)
        self.first = np.searchsorted(key[by_key], np.arange(-(-len(rows) // BLOCK) * len(idf) + 1))
        self.top = np.zeros((-(-len(rows) // BLOCK), len(idf)), np.float32)
        np.maximum.at(self.top, (self.vector // BLOCK, self.term), self.weight.astype(np.float32))

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = (1 + np.log(counts)) * self.idf[terms]
        return terms, w / np.linalg.norm(w)

    def candidates(self, dense: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(row of dense, vector) of all that can be among the k nearest vectors of a row, k-th ones and ties included."""
        n, single = len(self.members), dense.astype(np.float32)
        bounds = single @ self.top.T
        often = np.ascontiguousarray(single[:, self.dense])
        of_row, of_term = np.nonzero((single > 0) & (self.column < 0))
        best = np.zeros((len(dense), k), np.float32)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        for block in np.argsort(-bounds.sum(0), kind="stable"):
            # the k-th cosine found rules out the blocks whose bound is below it
            rows = np.flatnonzero((bounds[:, block] > 0) & (bounds[:, block] + SINGLE >= best[:, 0]))
            if not len(rows):
                continue
            a, b = block * BLOCK, min(n, (block + 1) * BLOCK)
            cosines = often[rows] @ self.tile(block).T + self.posted_products(single, rows, of_row, of_term, block, a, b - a)
            # most blocks hold nothing that is nearer than what most rows have by then
            some = np.flatnonzero(cosines.max(1) > np.maximum(best[rows, 0] - SINGLE, 0))
            if not len(some):
                continue
            rows, cosines = rows[some], cosines[some]
            near = np.partition(cosines, b - a - k, axis=1)[:, -k:] if b - a > k else cosines
            both = np.concatenate([best[rows], near], axis=1)
            kept = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]  # the k-th one comes first
            best[rows] = kept
            i, j = np.nonzero(cosines >= np.maximum(kept[:, :1] - SINGLE, np.finfo(np.float32).tiny))
            found.append((rows[i], j + a, cosines[i, j]))
        row, vector, cosine = (np.concatenate(c) for c in zip(*found, strict=True))
        some = cosine >= best[row, 0] - SINGLE
        return row[some], vector[some]

    def tile(self, block: int) -> np.ndarray:
        """The dense terms of a block's vectors; made once an index, all tiles have EXAMPLES x len(dense) cells."""
        if block not in self.tiles:
            a, b = block * BLOCK, min(len(self.members), (block + 1) * BLOCK)
            part = slice(self.starts[a], self.starts[b])
            tile = np.zeros((b - a, len(self.dense)), np.float32)
            column = self.column[self.term[part]]
            tile[(self.vector[part] - a)[column >= 0], column[column >= 0]] = self.weight[part][column >= 0]
            self.tiles[block] = tile
        return self.tiles[block]

    def posted_products(self, single: np.ndarray, rows: np.ndarray, of_row: np.ndarray, of_term: np.ndarray, block: int, a: int, width: int) -> np.ndarray:
        """What the rarer terms of the rows add to their products with the vectors of a block, by the block's postings."""
        place = np.full(len(single), -1)
        place[rows] = np.arange(len(rows))
        asked = place[of_row] >= 0
        row, term = of_row[asked], of_term[asked]
        start, end = self.first[block * len(self.idf) + term], self.first[block * len(self.idf) + term + 1]
        each = end - start
        at = self.posted[np.repeat(start - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
        cell = np.repeat(place[row] * width, each) + self.vector[at] - a
        return np.bincount(cell, np.repeat(single[row, term], each) * self.weight[at], minlength=len(rows) * width).reshape(len(rows), width).astype(np.float32)

    def nearest_all(self, vectors: list[tuple[np.ndarray, np.ndarray]], without: list | None = None, k: int = K) -> list[list[tuple[float, int]]]:
        """For each vector (cosine, example) of the k nearest, ties to the earlier example; without: marks whose examples are left out."""
        out: list[list[tuple[float, int]]] = []
        for at in range(0, len(vectors), TOGETHER):
            group = vectors[at : at + TOGETHER]
            marks = (without or [None] * len(vectors))[at : at + TOGETHER]
            hidden = [set(self.places.get(i, [])) if i is not None else set() for i in marks]
            dense = np.zeros((len(group), len(self.idf)))
            for i, v in enumerate(group):
                terms, weights = self.unit(*v)
                dense[i, terms] = weights
            # hidden examples take their different vectors away at most
            row, vector = self.candidates(dense, k + max(self.n_vectors.get(i, 0) for i in marks))
            each = self.starts[vector + 1] - self.starts[vector]
            ends = np.cumsum(each)
            where = np.repeat(self.starts[vector] - (ends - each), each) + np.arange(int(each.sum()))
            products = dense.ravel()[np.repeat(row * len(self.idf), each) + self.term[where]] * self.weight[where]
            cosines = np.round(np.add.reduceat(products, ends - each), 12) if len(row) else np.zeros(0)
            order = np.lexsort((-cosines, row))
            ends = np.searchsorted(row[order], np.arange(len(group) + 1))
            for i, gone in enumerate(hidden):
                near: list[tuple[float, int]] = []
                for p in order[ends[i] : ends[i + 1]]:
                    if len(near) >= k and cosines[p] < near[k - 1][0]:
                        break
                    shown = (e for e in self.members[vector[p]] if e not in gone)
                    near += [(float(cosines[p]), e) for e, _ in zip(shown, range(k), strict=False)]
                near.sort(key=lambda x: (-x[0], x[1]))
                out.append(near[:k])
        return out

    def nearest(self, terms: np.ndarray, counts: np.ndarray, without=None, k: int = K) -> list[tuple[float, int]]:
        """nearest_all of one vector."""
        return self.nearest_all([(terms, counts)], [without], k)[0]

    def vote(self, neighbours: list[tuple[float, int]], prior: float) -> float:
        weights = np.array([c * c for c, _ in neighbours])
        return float((weights @ self.toxic[[i for _, i in neighbours]] + PRIOR * prior) / (weights.sum() + PRIOR)) if neighbours else prior


def list_vectors(rows) -> list[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a batch or table with columns terms and counts, as views of two arrays."""
    out = []
    for name, kind in (("terms", np.int64), ("counts", np.float64)):
        column = rows.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(kind)
        out.append([flat[a:b] for a, b in zip(ends, ends[1:], strict=False)])
    return list(zip(*out, strict=True))


def isotonic(votes: np.ndarray, truth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising step function from votes to shares of toxic examples, pooled until they rise."""
    pools: list[list[float]] = []
    for v in np.unique(np.round(votes, 6)):
        hit = np.round(votes, 6) == v
        pools.append([v, float(truth[hit].sum()), float(hit.sum())])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.1) / (p[2] + 0.2) for p in pools])


def score_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """docs without text, with score, predicted and evidence (array of doc_id, cosine, toxic).

    learn: a condition on doc_id; labels are read where it holds (None: everywhere).
    """
    spark = docs.sparkSession
    shared_dir(spark)
    out = ("score", "predicted", "evidence", "text")
    # the columns of the caller stay in one struct, so no name of theirs can meet one of ours
    docs = docs.select(F.struct(*[c for c in docs.columns if c not in out]).alias("kept"), "doc_id", "text", F.xxhash64("text").alias("mark"))
    sample = written(labelled_sample(labels, F.lit(True) if learn is None else learn), "labels")
    terms = choose_terms(docs, sample)
    vectors = written(term_vectors(docs, terms), "vectors")
    total = vectors.count()
    idf = np.zeros(len(terms))

    def held(batches):
        for batch in batches:
            n = np.bincount(batch.column("terms").flatten().to_numpy(zero_copy_only=False), minlength=len(terms))
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some].astype(np.int64))], names=["t", "n"])

    for r in vectors.select("terms").mapInArrow(held, "t int, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():  # a row a term
        idf[r["t"]] = np.log(1 + total / r["n"])
    known = vectors.join(F.broadcast(sample), "doc_id")
    shares = {r["toxic"]: r["count"] for r in known.where(F.size("terms") == 0).groupBy("toxic").count().collect()}  # two rows
    overall = sample.agg(F.avg("toxic")).first()[0]
    prior = 0.5 if overall is None else float(overall)
    without_term = (shares.get(1, 0) + prior) / (sum(shares.values()) + 1)
    some = known.where(F.size("terms") > 0).orderBy(F.xxhash64("doc_id"), "doc_id").limit(EXAMPLES)
    chosen = written(some.select("doc_id", "toxic", "terms", "counts", "mark"), "examples")
    rows = chosen.toArrow().combine_chunks()  # at most EXAMPLES short vectors, as arrays
    index = BlockMaxIndex(rows.column("doc_id").to_pylist(), rows.column("toxic").to_pylist(), list_vectors(rows), idf, rows.column("mark").to_pylist())
    n_examples = rows.num_rows
    del rows
    sent = spark.sparkContext.broadcast(vars(index))

    def opened(state: dict) -> BlockMaxIndex:
        index = BlockMaxIndex.__new__(BlockMaxIndex)
        index.__dict__.update(state)
        index.tiles = {}  # of this task, not of the broadcast, which outlives it in the worker
        return index

    def leave_out(batches):
        index = opened(sent.value)
        for batch in given_back(batches):
            near = index.nearest_all(list_vectors(batch), batch.column("mark").to_pylist())
            votes = [index.vote(n, prior) for n in near]
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), batch.column("toxic")], names=["vote", "toxic"])

    points = (np.zeros(0), np.zeros(0))
    if n_examples:
        again = chosen.repartition(max(1, n_examples // 500)).mapInArrow(leave_out, "vote double, toxic int").toArrow()
        points = isotonic(again.column("vote").to_numpy(), again.column("toxic").to_numpy())

    def score(batches):
        index = opened(sent.value)
        known: dict[tuple, list[tuple[float, int]]] = {}
        for batch in (whole.slice(i, TOGETHER * 2) for whole in given_back(batches) for i in range(0, whole.num_rows, TOGETHER * 2)):
            vectors = list_vectors(batch)
            keys = [(t.tobytes(), c.tobytes()) for t, c in vectors]
            # equal vectors, copies among them, are looked up once as long as they are known
            if len(known) > KNOWN:
                known.clear()
            asked = {key: v for key, v in zip(keys, vectors, strict=True) if key[0] and index.ids and key not in known}
            known |= dict(zip(asked, index.nearest_all(list(asked.values())), strict=True))
            seen = {}
            for key in dict.fromkeys(keys):
                near = known.get(key, [])
                # documents whose terms no example shares are as those without a term
                vote = float(points[1][min(np.searchsorted(points[0], index.vote(near, prior) - 1e-6), len(points[0]) - 1)]) if near else without_term
                seen[key] = min(1.0, max(0.0, vote)), [{"doc_id": index.ids[i], "cosine": s, "toxic": int(index.toxic[i])} for s, i in near]
            scores, evidence = [seen[key][0] for key in keys], [seen[key][1] for key in keys]
            kind = pa.list_(pa.struct([("doc_id", batch.column("doc_id").type), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            cells = [batch.column("kept"), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(evidence, kind)]
            yield pa.RecordBatch.from_arrays(cells, names=["kept", "score", "predicted", "evidence"])

    key = docs.schema["doc_id"].dataType.simpleString()
    kept = vectors.schema["kept"].dataType.simpleString()
    return vectors.mapInArrow(score, f"kept {kept}, score double, predicted int, evidence array<struct<doc_id:{key},cosine:double,toxic:int>>").select("kept.*", "score", "predicted", "evidence")


def remainder(n: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def remove_toxic(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """The documents that are not predicted toxic; rows go by id and text, so a null or repeated id drops no other text."""
    key = F.md5(F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    found = score_toxicity(docs.select("doc_id", "text", key.alias("_key")), labels, learn)
    bad = found.where("predicted = 1").select("_key").distinct()
    return without_ids(docs.withColumn("_key", key), bad, "_key").select(*docs.columns)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels are learnt where crc32(doc_id) mod 3 is not 1."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score_toxicity(docs, labels, remainder(3) != 1)
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "score", "predicted", "evidence")
