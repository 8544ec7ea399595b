"""Near-duplicate documents by a signature-coordinate inverted join.

A document is the set of its distinct shingles of WORDS words. Documents with the same set are one class, found by an
aggregation over set digests. Each class has a MinHash signature of COORDINATES values; every (coordinate, value) pair
is a token. Two sets of Jaccard similarity 0.8 agree in each coordinate with probability 0.8, so they agree in fewer
than MATCHES of 32 with probability 4e-9: pairs with fewer matches are not looked at.

Prefix merging: with tokens ordered by rarity over all classes, two classes that share MATCHES tokens share one of
their first COORDINATES - MATCHES + 1. Only these prefixes are posted, so tokens that thousands of unrelated
documents share (a common passage) are hardly ever posted. Skip merging: the remaining coordinates are not merged from
their lists; a candidate pair's signatures are compared directly and pairs below MATCHES go. What stays is confirmed on
the full shingle sets, with the length bound first.

Only components are asked for, so a list of L near copies need not become L * L / 2 pairs. HUBS members of every list
are checked against the whole list: those whose tokens most classes share (the text that near copies were made from
shares more with each of them than they do with each other). Confirmed links join components; a list whose members that
were no hubs are one component is done. While more members than a block are left outside of one component, there is
another round, up to ROUNDS, with hubs from among them. What is left is every such member outside of the largest component against the others.
These are checked by counting: blocks of at most GROUP_BLOCK sets from either side meet in a task, an index from
shingle to set gives all intersection sizes of a set at once, and one link for each component that it touches comes
out. Before a group that does not fit into one block is dealt, the sets go that have too many shingles of their own:
what no other set of the group holds is in no intersection. So no link between different components is left out, no
list's pairs are written down, and rows grow with the lists' lengths.

Components grow by star contraction with aggregations and joins only. Tables between steps go to the shared folder.
Joins shuffle whatever size Spark estimates, for it takes exploded signatures and tables of ids for many times smaller
than they are; only tables of at most SENT_ROWS rows of ids may be broadcast.

Defined results
* A-Z are lower-cased; [\\x20\\x09-\\x0D]+ parts words; fewer words than a shingle make one shingle;
* null, empty and blank texts have 0 shingles and are linked with nothing, each is its own component;
* rows that repeat a doc_id are one document with several texts: they share a component, and remove_near_duplicates
  keeps one of the rows;
* a row of null doc_id is counted but not linked: component_id null, kept true; remove_near_duplicates keeps one of
  those of equal text;
* texts may be of any length that one task can hold (about 20 times a text's bytes are used for it); ties go to the
  smallest id;
* an empty table gives no rows; extra columns pass through remove_near_duplicates.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.text import split_words, text_slices, without_ids
from quillstone.session import shared_dir, unsent, written

COORDINATES = 32
MATCHES = 11
HUBS = 4
ROUNDS = 3
#: What a round has left is checked by counting, in blocks of so many sets.
GROUP_BLOCK = 4_096
MIX = 0x9E3779B97F4A7C15
#: Tables of a few ids a row may be broadcast up to so many rows (some 5 MB); all others are joined by shuffle.
SENT_ROWS = 100_000
#: Bytes of text whose shingles a task holds at once; it needs some 20 times as many.
SLICE_BYTES = 2_000_000


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The size of each text's shingle set, and the 64-bit hashes of the sets one after another, each sorted."""
    import pandas as pd

    counts, flat = split_words(texts)
    coded = flat.dictionary_encode()
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    of_word = pd.util.hash_array(names, categorize=False) if len(names) else np.zeros(0, np.uint64)
    h = of_word[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.uint64)
    ends = np.cumsum(counts)
    starts = ends - counts
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    owner = np.repeat(np.arange(len(counts)), sizes)
    place = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]
    length = np.minimum(counts, words)[owner]
    value = length.astype(np.uint64)
    for j in range(words):
        part = h[np.minimum(place + j, max(len(h) - 1, 0))] if len(h) else h
        mixed = (value ^ part) * np.uint64(MIX)
        mixed ^= mixed >> np.uint64(32)
        value = np.where(j < length, mixed, value)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    first = np.ones(len(value), bool)
    first[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return np.bincount(owner[first], minlength=len(counts)), value[first]


def signatures(sizes: np.ndarray, values: np.ndarray, coordinates: int) -> np.ndarray:
    """A row of int32 for each text that has shingles."""
    starts = (np.cumsum(sizes) - sizes)[sizes > 0]
    out = np.empty((len(starts), coordinates), np.int32)
    rng = np.random.default_rng(20)
    for j, (a, b) in enumerate(rng.integers(1, 1 << 63, (coordinates, 2), dtype=np.uint64)):
        v = (values ^ b) * (a | np.uint64(1))
        v ^= v >> np.uint64(29)
        v *= np.uint64(MIX)
        out[:, j] = (np.minimum.reduceat(v, starts) >> np.uint64(32)).astype(np.uint32).view(np.int32) if len(starts) else 0
    return out


def digest_documents(docs: DataFrame, words: int, coordinates: int = COORDINATES) -> DataFrame:
    """doc_id, n_shingles, digest (null without shingles), signature as array<int>."""

    def digest(batches):
        for batch in text_slices(batches, most=SLICE_BYTES):
            sizes, values = shingle_sets(batch.column("text"), words)
            sigs = iter(signatures(sizes, values, coordinates).tolist())
            ends = np.cumsum(sizes)
            digests = [hashlib.blake2b(values[e - n : e].tobytes(), digest_size=16).digest() if n else None for n, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array([next(sigs) if n else None for n in sizes.tolist()], pa.list_(pa.int32()))],
                names=["doc_id", "n_shingles", "digest", "signature"],
            )

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(digest, f"doc_id {key}, n_shingles long, digest binary, signature array<int>")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id, digest, shingles (sorted 64-bit hashes) of the documents whose doc_id is an id of wanted."""

    def sets(batches):
        for batch in text_slices(batches, most=SLICE_BYTES):
            sizes, values = shingle_sets(batch.column("text"), words)
            ends = np.cumsum(sizes).tolist()
            raw = [values[e - n : e].tobytes() for n, e in zip(sizes.tolist(), ends, strict=True)]
            digests = [hashlib.blake2b(r, digest_size=16).digest() for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], names=["id", "digest", "shingles"])

    some = docs.select(F.col("doc_id").alias("id"), "text").join(unsent(wanted.select("id").distinct()), "id", "left_semi")
    return some.mapInArrow(sets, f"id {docs.schema['doc_id'].dataType.simpleString()}, digest binary, shingles binary")


def postings(classes: DataFrame) -> DataFrame:
    """token, id, central: the prefix of each class's tokens in order of rarity, without tokens that no other class has.

    central: with how many classes the class shares its tokens.
    """
    k = classes.select("id", F.posexplode("signature").alias("at", "value"))
    tokens = k.select("id", F.xxhash64("at", "value").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # a class's shared tokens by rarity; tokens of one class only come before them
    ranked = tokens.join(unsent(shared), "token").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("all"), F.sum("n").alias("central"))
    room = F.greatest(F.lit(0), F.size("all") - (MATCHES - 1))
    return ranked.select("id", "central", F.explode(F.slice("all", F.lit(1), room)).alias("t")).select("t.token", "id", "central")


def confirmed(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs a, b that agree in MATCHES coordinates and whose shingle sets are similar enough."""
    light = classes.select("id", "n_shingles", "signature")
    ab = pairs
    for side in ("a", "b"):
        ab = ab.join(unsent(light.select(F.col("id").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("signature").alias(f"s_{side}"))), side)
    ab = ab.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    ab = ab.where(F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x) >= MATCHES).select("a", "b")
    for side in ("a", "b"):
        ab = ab.join(unsent(sets.select(F.col("id").alias(side), F.col("shingles").alias(f"x_{side}"))), side)
    key = pairs.schema["a"].dataType.simpleString()

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x_a"), batch.column("x_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int((x[place] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return ab.select("a", "b", "x_a", "x_b").mapInArrow(check, f"a {key}, b {key}")


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many rows of ids, for a join that may broadcast it only if they are few."""
    return df if rows <= SENT_ROWS else unsent(df)


def components(links: DataFrame) -> DataFrame:
    """id, label: the smallest id of each linked id's component. links: a, b. Star contraction until nothing moves."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before, rows = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m"))
        large = both.join(bounded(least, 2 * rows), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(bounded(low, 2 * rows), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        edges = written(small.distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
        before, rows = now, now[0]


def without_lone(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The members (group, id, ...) that share enough shingles with the rest of their group to be linked with one."""

    def apart(batches):
        for batch in batches:
            for rows in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                raw = [np.frombuffer(v.as_buffer(), np.int64) for v in rows.column("shingles")]
                where = pa.array(np.repeat(np.arange(len(raw)), [len(r) for r in raw]))
                cells = [rows.column("group").take(where), rows.column("id").take(where), pa.array(np.concatenate(raw))]
                yield pa.RecordBatch.from_arrays(cells, names=["group", "id", "shingle"])

    key = members.schema["id"].dataType.simpleString()
    held = members.select("group", "id").join(unsent(sets), "id").select("group", "id", "shingles").mapInArrow(apart, f"group {key}, id {key}, shingle long")
    alone = held.groupBy("group", "shingle").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).where("n = 1")
    alone = alone.groupBy("group", "id").agg(F.count(F.lit(1)).alias("n_alone"))
    sized = sets.select("id", (F.octet_length("shingles") / 8).alias("n"))
    rated = members.join(unsent(alone), ["group", "id"], "left").join(unsent(sized), "id")
    return rated.where(f"100 * (n - coalesce(n_alone, 0)) >= {percent} * n").select(*members.columns)


def counted(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b of each group's outside ids with its members, one for each component that an id touches.

    members: group, id, comp; outside are those whose component is not called like the group.
    """
    count = members.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    large = members.join(unsent(count.where(F.col("n") > GROUP_BLOCK).select("group")), "group", "left_semi")
    small = members.join(unsent(count.where(F.col("n") <= GROUP_BLOCK).select("group")), "group", "left_semi")
    members = written(small.unionByName(without_lone(large, sets, percent)), "members")
    outside = members.where("comp <> group")
    sized = lambda d, n: d.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / GROUP_BLOCK).cast("int").alias(n))
    blocks = sized(outside, "n_x").join(unsent(sized(members, "n_y")), "group")
    deal = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    with_sets = lambda d: d.join(unsent(blocks), "group").join(unsent(sets), "id")
    x = with_sets(outside).select("group", "id", "comp", "shingles", F.lit(True).alias("is_x"), deal("n_x").alias("bx"), every("n_y").alias("by"))
    y = with_sets(members).select("group", "id", "comp", "shingles", F.lit(False).alias("is_x"), every("n_x").alias("bx"), deal("n_y").alias("by"))
    key = members.schema["id"].dataType.simpleString()

    def check(table: pa.Table) -> pa.Table:
        is_x = table.column("is_x").to_numpy().astype(bool)
        ids, comps = table.column("id").to_numpy(), table.column("comp").to_numpy()
        raw = [np.frombuffer(v, np.uint64) for v in table.column("shingles").to_pylist()]
        xs, ys = np.flatnonzero(is_x), np.flatnonzero(~is_x)
        sizes = np.array([len(raw[i]) for i in ys], np.int64)
        values = np.concatenate([np.zeros(0, np.uint64), *(raw[i] for i in ys)])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], np.repeat(np.arange(len(ys)), sizes)[order]
        links: list[tuple] = []
        for i in xs.tolist():
            left, right = np.searchsorted(values, raw[i], "left"), np.searchsorted(values, raw[i], "right")
            each = right - left
            where = np.repeat(left - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            both = np.bincount(owner[where], minlength=len(ys))
            near = np.flatnonzero((100 * both >= percent * (sizes + len(raw[i]) - both)) & (comps[ys] != comps[i]))
            _, one = np.unique(comps[ys[near]], return_index=True)
            links += [(ids[i], ids[ys[j]]) for j in near[one]]
        kind = table.schema.field("id").type
        return pa.table({"a": pa.array([a for a, _ in links], kind), "b": pa.array([b for _, b in links], kind)})

    return x.unionByName(y).groupBy("group", "bx", "by").applyInArrow(check, f"a {key}, b {key}")


def link_classes(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """id, label of the classes that are linked with another one."""
    posted = written(postings(classes), "postings")
    wanted = posted.select("id").distinct()
    found = full_sets(docs, wanted, words).join(unsent(classes.select("id", "digest")), ["id", "digest"], "left_semi")
    sets = written(found.select("id", "shingles").dropDuplicates(["id"]), "shingles")

    # members that were hubs have been checked against their whole list
    open_, labels = posted.select("token", "id", "central", F.lit(False).alias("used"), F.col("id").alias("comp"), F.lit(None).cast(posted.schema["id"].dataType).alias("main")), None
    star = lambda: labels.select(F.col("id").alias("a"), F.col("label").alias("b"))
    for turn in range(ROUNDS):
        draw = Window.partitionBy("token").orderBy(F.col("central").desc(), F.xxhash64(F.lit(1), "id"), "id")
        best = open_.where("NOT used" if turn == 0 else "NOT used AND comp <> main")
        hubs = written(best.withColumn("_n", F.row_number().over(draw)).where(F.col("_n") <= HUBS).select("token", F.col("id").alias("x")), "hubs")
        pairs = hubs.join(unsent(open_.select("token", "id")), "token").where("x <> id").select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()
        links = confirmed(pairs, classes, sets, percent)
        labels = components(links if labels is None else links.unionByName(star()))
        now = open_.select("token", "id", "central", "used").join(bounded(labels, labels.count()), "id", "left").select("token", "id", "central", "used", F.coalesce("label", "id").alias("comp"))
        now = written(now.join(bounded(hubs.select("token", F.col("x").alias("id"), F.lit(True).alias("hub")), hubs.count()), ["token", "id"], "left").withColumn("used", F.expr("used OR coalesce(hub, false)")).drop("hub"), "labelled")
        by_comp = now.where("NOT used").groupBy("token", "comp").agg(F.count(F.lit(1)).alias("n"))
        lists = by_comp.groupBy("token").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.count(F.lit(1)).alias("n")).where("n > 1")
        lists = written(lists.select("token", "main"), "lists")
        open_ = written(now.join(bounded(lists, lists.count()), "token"), "open")
        outside = open_.where("NOT used AND comp <> main").groupBy("main").agg(F.count_distinct("id").alias("n")).agg(F.max("n")).first()[0]
        if not outside:
            return labels
        if outside <= GROUP_BLOCK:
            break
    members = open_.where("NOT used").select(F.col("main").alias("group"), "id", "comp").distinct()
    return components(counted(members, sets, percent).unionByName(star()))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each document: links are Jaccard similarities of percent or more."""
    shared_dir(docs.sparkSession)
    base = written(digest_documents(docs, words), "digests")
    classes = (
        base.where("n_shingles > 0 AND doc_id IS NOT NULL")
        .groupBy("digest")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("signature").alias("signature"), F.count(F.lit(1)).alias("n_docs"))
    )
    classes = written(classes, "classes")
    labels = link_classes(docs, classes, words, percent)
    named = classes.join(bounded(labels, labels.count()), "id", "left").select("digest", "id", "n_docs", F.coalesce("label", "id").alias("label"))
    moved = named.where("n_docs > 1 OR label <> id").select("digest", "label")
    whole = base.select("doc_id", "n_shingles", "digest").join(unsent(moved), "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", "doc_id"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def remove_near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One document of each component of near duplicates, and one row of each document."""
    gone = near_duplicates(docs, words, percent).where("NOT kept").select("doc_id")
    names = docs.columns
    left = without_ids(docs, gone.distinct())
    # rows that share an id or, without one, a text: narrow to find, and only they are sorted
    name = F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.concat(F.lit("t"), F.md5(F.coalesce("text", F.lit("")))))
    keyed = left.select(F.struct(*names).alias("row"), name.alias("name"))
    again = written(keyed.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name"), "repeated")
    n_again = again.count()
    if not n_again:
        return left
    order = Window.partitionBy("name").orderBy(F.xxhash64("row"))
    one = keyed.join(bounded(again, n_again), "name", "left_semi").withColumn("n", F.row_number().over(order)).where("n = 1")
    return keyed.join(bounded(again, n_again), "name", "left_anti").select("row.*").unionByName(one.select("row.*"))


def op10_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """Components of near duplicates among all documents, by shingles of four words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=80)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 2, 2)), lambda i: md5(array_to_string(w[i:i + 3], ' '))))) END AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS n_both
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * n_both >= 80 * (na + nb - n_both)),
reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM links
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
comps AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM sets LEFT JOIN comps USING (doc_id)
"""
