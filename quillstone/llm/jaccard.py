"""N-gram Jaccard join of whole texts with two ways of skipping: over blocks of index lists, and by sets' relations.

A document is the set of its distinct shingles; documents of one set are one class. Two classes are linked when the
Jaccard similarity of their sets is PERCENT or more; that is an exact join, no signature and no chance is in it.

Index. Tokens have one order for all sets: those in the lowest 1 / SHARE of the hash range first, by the number of
classes that hold them (all classes are counted), the others behind by their hash. Linked sets share one of their
first n - ceil(PERCENT * n / 100) + 1 tokens, so only these are posted, with their position, and only if another class
posts the token too.

Skipping blocks. Each list is cut into blocks by size band and position. A band holds sets of a size class and the next
one; sets of other classes are never similar enough. An entry whose position leaves too few tokens for any partner of a
band is not in that band's block: most of the second half of a prefix meets smaller partners only.

Skipping by relation. A list's leader (the set that shares its tokens with most classes) is compared with all members of
the list; lists of up to SMALL members compare all. Members that are linked to the leader are one component: their
answers are known from the leader's. For what is left, the members outside of a list's main component against the
others, answers are derived from those of a similar set r: x and y differ in (x - r) and (y - r) where these differ, so
|x & y| follows from the two differences and the number of tokens that both differences hold. The index of a block
holds differences only, a small part of the sets where members are copies of one text; if they are not, r is the empty
set and the differences are the sets. Blocks hold up to BLOCK sets and meet blocks of the same and adjoining size
classes only; a block gives a spanning forest of the components that it links, not pairs.

Defined results
* A-Z are lower-cased; [\\x20\\x09-\\x0D]+ parts words; fewer words than a shingle make one shingle;
* null, empty and blank texts have 0 shingles and are linked with nothing, each is its own component;
* rows that repeat a doc_id are one document with several texts and share a component; a row of null doc_id is counted
  but not linked, its component_id is null;
* a component is called by its smallest doc_id; ties of leaders go to the smaller id;
* texts may be of any length that one task can hold (about 20 times a text's bytes); extra columns pass by; an empty
  table gives no rows.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.llm.neardup import components, shingle_sets
from quillstone.llm.text import BROADCAST_IDS, text_slices
from quillstone.session import forget, shared_dir, written

SHARE = 5
SMALL = 5
BLOCK = 4_096
EARLY = 2**64 // SHARE


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's first tokens are posted."""
    return n - -(-percent * n // 100) + 1


def named(values: np.ndarray) -> int:
    """The name of a set: 64 bits, as for its shingles."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def read_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, id of the set, n_early, tokens: the early tokens in order of their hash, a prefix at least."""

    def read(batches):
        for batch in text_slices(batches):
            sizes, values = shingle_sets(batch.column("text"), words)
            ids, early, tokens = [], [], []
            at = 0
            for n in sizes.tolist():
                own = values[at : at + n]
                at += n
                ids.append(named(own) if n else None)
                early.append(int(np.searchsorted(own, np.uint64(EARLY))))
                tokens.append(own[: max(early[-1], int(needed(np.int64(n), percent)))].tobytes() if n else None)
            cells = [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(ids, pa.int64()), pa.array(early, pa.int64()), pa.array(tokens, pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "n_shingles", "id", "n_early", "tokens"])

    key = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(read, f"doc_id {key}, n_shingles long, id long, n_early long, tokens binary")


def full_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """id, shingles (sorted 64-bit hashes) of the wanted sets (doc_id, id); texts move only if very many are wanted."""

    def sets(batches):
        for batch in text_slices(batches):
            sizes, values = shingle_sets(batch.column("text"), words)
            ends = np.cumsum(sizes).tolist()
            own = [values[e - n : e] for n, e in zip(sizes.tolist(), ends, strict=True)]
            keep = pa.array([n > 0 and named(v) == i for n, v, i in zip(sizes.tolist(), own, batch.column("id").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([v.tobytes() for v in own], pa.binary())], names=["id", "shingles"]).filter(keep)

    wanted = written(wanted, "wanted")
    small = wanted.count() <= BROADCAST_IDS
    some = docs.select("doc_id", "text").join(F.broadcast(wanted) if small else wanted, "doc_id")
    return some.select("id", "text").mapInArrow(sets, "id long, shingles binary")


def apart(classes: DataFrame) -> DataFrame:
    """id, token, at: a row for each token of the classes, at is its place in order of the hash."""

    def cut(batches):
        for batch in batches:
            for rows in (batch.slice(i, 1_024) for i in range(0, batch.num_rows, 1_024)):
                raw = [np.frombuffer(v.as_buffer(), np.int64) for v in rows.column("tokens")]
                n = np.array([len(r) for r in raw])
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                cells = [rows.column("id").take(pa.array(np.repeat(np.arange(len(raw)), n))), pa.array(np.concatenate(raw)), pa.array(at.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cells, names=["id", "token", "at"])

    key = classes.schema["id"].dataType.simpleString()
    return classes.select("id", "tokens").mapInArrow(cut, f"id {key}, token long, at int")


def postings(classes: DataFrame, percent: int) -> DataFrame:
    """token, id, n, pos, central: the prefixes of the sets in the order of tokens, without tokens of one class only."""
    tokens = apart(classes)
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    early = f"token >= 0 AND token < {EARLY}"
    held = tokens.join(shared, "token").groupBy("id")
    held = held.agg(
        F.sort_array(F.collect_list(F.expr(f"CASE WHEN {early} THEN struct(df, token) END"))).alias("first"),
        F.collect_list(F.expr(f"CASE WHEN NOT ({early}) THEN struct(at AS pos, token) END")).alias("then"),
        F.sum("df").alias("central"),
    )
    held = held.join(classes.select("id", F.col("n_shingles").alias("n"), "n_early"), "id")
    # tokens that no other class holds are the rarest, they stand before the shared ones
    first = F.transform("first", lambda x, k: F.struct((F.col("n_early") - F.size("first") + k).cast("int").alias("pos"), x["token"].alias("token")))
    prefix = F.expr(f"n - cast(ceil({percent} * n / 100) AS long) + 1")
    one = F.explode(F.filter(F.concat(first, "then"), lambda x: x["pos"] < prefix)).alias("t")
    return held.select("id", "n", "central", one).select("t.token", "id", "n", "t.pos", "central")


def blocks_of_lists(posted: DataFrame, percent: int) -> DataFrame:
    """list, id, n, room, low, central: the entries of each block of the index lists that has any two to compare.

    room: how many tokens the entry's position leaves. low: the set is of the band's lower size class; two sets of its
    upper class meet in the next band.
    """
    base = 100 / (percent - 1)
    rows = posted.withColumn("room", F.col("n") - F.col("pos")).withColumn("c", F.floor(F.log(F.col("n").cast("double")) / math.log(base)))
    # the smallest partner in the own band; as overlap >= percent * (n + m) / (100 + percent), it needs the least room
    least = F.greatest(F.col("n") * percent / 100.0, F.pow(F.lit(base), F.col("c").cast("double")) * (1 - 1e-9))
    own = rows.where(F.col("room") * (100.0 + percent) >= percent * (F.col("n") + least) * (1 - 1e-12)).withColumn("low", F.lit(True))
    down = rows.where(F.col("n") * percent / 100.0 * (1 - 1e-9) < F.pow(F.lit(base), F.col("c").cast("double"))).withColumn("low", F.lit(False)).withColumn("c", F.col("c") - 1)
    both = own.unionByName(down).select(F.xxhash64("token", "c").alias("list"), "id", "n", "room", "low", "central")
    many = both.groupBy("list").agg(F.count(F.lit(1)).alias("members"), F.max("low").alias("any")).where("members > 1 AND any")
    return both.join(many.select("list", "members"), "list")


def led_pairs(lists: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The leaders (list, x) of the lists, and the pairs a, b of them with members that length and position allow."""
    order = Window.partitionBy("list").orderBy(F.col("central").desc(), "id")
    ranked = lists.withColumn("_r", F.row_number().over(order)).where(f"_r < {SMALL}")
    leaders = written(ranked.where(f"_r = 1 OR members <= {SMALL}").select("list", F.col("id").alias("x"), F.col("n").alias("n_x"), F.col("room").alias("room_x"), F.col("low").alias("low_x")), "leaders")
    met = leaders.join(lists.select("list", "id", "n", "room", "low"), "list").where("x <> id AND (low OR low_x)")
    met = met.where(f"100 * least(n, n_x) >= {percent} * greatest(n, n_x) AND {100 + percent} * least(room, room_x) >= {percent} * (n + n_x)")
    return leaders, met.select(F.least("x", "id").alias("a"), F.greatest("x", "id").alias("b")).distinct()


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose whole sets are similar enough."""
    ab = pairs
    for side in ("a", "b"):
        ab = ab.join(sets.select(F.col("id").alias(side), F.col("shingles").alias(f"x_{side}")), side)
    key = pairs.schema["a"].dataType.simpleString()

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x_a"), batch.column("x_b"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return ab.select("a", "b", "x_a", "x_b").mapInArrow(check, f"a {key}, b {key}")


def differences(sets: list[np.ndarray], r: np.ndarray) -> list[np.ndarray]:
    return [np.setxor1d(x, r, assume_unique=True) for x in sets]


def similar_set(sets: list[np.ndarray]) -> np.ndarray:
    """The set whose tokens most of these sets hold, or the empty set if differences from it would be no smaller."""
    values, count = np.unique(np.concatenate(sets), return_counts=True)
    r = max(sets, key=lambda x: float(count[np.searchsorted(values, x)].mean()))
    held = count[np.searchsorted(values, r)]
    total = sum(map(len, sets))
    changed = int(total + len(sets) * len(r) - 2 * held.sum())  # all differences from r together
    return r if changed < total else r[:0]


def derived_links(xs: list[np.ndarray], ys: list[np.ndarray], percent: int):
    """For each x the places of the ys that are similar enough, from the differences to a similar set."""
    r = similar_set(ys)
    delta = differences(ys, r)
    size = np.array([len(y) for y in ys], np.int64)
    changed = np.array([len(d) for d in delta], np.int64)
    tokens, owner = np.concatenate(delta), np.repeat(np.arange(len(ys)), changed)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    for x, d in zip(xs, differences(xs, r), strict=True):
        left = np.searchsorted(tokens, d, "left")
        each = np.searchsorted(tokens, d, "right") - left
        where = np.repeat(left - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        common = np.bincount(owner[where], minlength=len(ys))
        both = (size + len(x) - (changed + len(d) - 2 * common)) // 2
        yield np.flatnonzero(100 * both >= percent * (size + len(x) - both))


def left_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links a, b between components of each group: its outside ids against all its members.

    members: group, id, comp; outside are those whose component is not called like the group.
    """
    n = (F.octet_length("shingles") / 8).cast("double")
    sized = written(members.join(sets, "id").withColumn("c", F.floor(F.log(n) / math.log(100 / (percent - 1)))), "members")
    block = lambda d, c, k: d.groupBy("group", F.col("c").alias(c)).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias(k))
    outside = sized.where("comp <> group")
    meet = block(outside, "cx", "kx").join(block(sized, "cy", "ky"), "group").where("abs(cx - cy) <= 1")
    deal = lambda k: F.pmod(F.xxhash64("id"), F.col(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    cells = ["group", "cx", "cy", "bx", "by"]
    x = outside.join(meet.withColumnRenamed("cx", "c"), ["group", "c"]).select("group", "id", "comp", "shingles", F.lit(True).alias("is_x"), F.col("c").alias("cx"), "cy", deal("kx").alias("bx"), every("ky").alias("by"))
    y = sized.join(meet.withColumnRenamed("cy", "c"), ["group", "c"]).select("group", "id", "comp", "shingles", F.lit(False).alias("is_x"), "cx", F.col("c").alias("cy"), every("kx").alias("bx"), deal("ky").alias("by"))
    key = members.schema["id"].dataType.simpleString()

    def check(table: pa.Table) -> pa.Table:
        is_x = table.column("is_x").to_numpy().astype(bool)
        ids, comps = table.column("id").to_pylist(), table.column("comp").to_pylist()
        raw = [np.frombuffer(v, np.uint64) for v in table.column("shingles").to_pylist()]
        at_x, at_y = np.flatnonzero(is_x).tolist(), np.flatnonzero(~is_x).tolist()
        parent: dict = {}

        def root(c):
            while parent.get(c, c) != c:
                parent[c] = parent.get(parent[c], parent[c])
                c = parent[c]
            return c

        links = []
        if at_x and at_y:
            for i, near in zip(at_x, derived_links([raw[i] for i in at_x], [raw[j] for j in at_y], percent), strict=True):
                for j in near.tolist():
                    p, q = root(comps[i]), root(comps[at_y[j]])
                    if p != q:
                        parent[p] = q
                        links.append((ids[i], ids[at_y[j]]))
        kind = table.schema.field("id").type
        return pa.table({"a": pa.array([a for a, _ in links], kind), "b": pa.array([b for _, b in links], kind)})

    return x.unionByName(y).groupBy(*cells).applyInArrow(check, f"a {key}, b {key}")


def link_classes(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """a, b: links between the ids of classes that have the same components as all links."""
    lists = written(blocks_of_lists(postings(classes, percent), percent), "lists")
    wanted = classes.join(lists.select("id").distinct(), "id", "left_semi").select("doc_id", "id")
    sets = written(full_sets(docs, wanted, words), "shingles")
    leaders, pairs = led_pairs(lists, percent)
    led = written(confirmed(pairs, sets, percent), "links")
    # the members that no leader's answers cover yet
    rest = lists.where(f"members > {SMALL}").join(leaders.select("list", F.col("x").alias("id")), ["list", "id"], "left_anti")
    rest = written(rest.join(components(led), "id", "left").select("list", "id", F.coalesce("label", "id").alias("comp")), "rest")
    by_comp = rest.groupBy("list", "comp").agg(F.count(F.lit(1)).alias("n"))
    mains = by_comp.groupBy("list").agg(F.max_by("comp", F.struct("n", "comp")).alias("group"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = rest.join(mains.select("list", "group"), "list").select("group", "id", "comp").distinct()
    return led.unionByName(left_links(members, sets, percent))


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of each document; links are Jaccard similarities of percent or more."""
    shared_dir(docs.sparkSession)
    first = written(read_sets(docs, words, percent), "sets")
    base = written(first.select("doc_id", "n_shingles", "id"), "named")
    held = first.where("id IS NOT NULL AND doc_id IS NOT NULL").groupBy("id")
    classes = written(held.agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n_shingles", "n_early", "tokens")]), "classes")
    forget(first)
    known = base.where("id IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "id")
    # a document of several texts links their classes
    several = known.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a <> b").select("doc_id", "a")
    own = known.join(several, "doc_id").where("a <> id").select("a", F.col("id").alias("b")).distinct()
    labels = components(link_classes(docs, classes, words, percent).unionByName(own))
    label = F.coalesce("label", "id").alias("label")
    classed = classes.select("id", "doc_id").join(labels, "id", "left").select("id", "doc_id", label)
    smallest = classed.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    whole = base.join(classed.join(smallest, "label").select("id", "component_id"), "id", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"))


def op12_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Components of all documents that share nine tenths of their shingles of three words."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, percent=90)


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] ELSE list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 1, 2)), lambda i: md5(array_to_string(w[i:i + 2], ' '))))) END AS s
  FROM words),
shingles AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS n_both
  FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * n_both >= 90 * (na + nb - n_both)),
reach AS (
  SELECT DISTINCT a AS doc_id, a AS other FROM links
  UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.other = l.a),
comps AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM sets LEFT JOIN comps USING (doc_id)
"""
