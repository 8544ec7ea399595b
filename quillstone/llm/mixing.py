"""Mixing sources to target weights by Poisson replication.

Every source s gets the mean repetition rate ``weight_s * total / size_s`` where size is a row count or a sum of
UTF-8 bytes. A document's count is a Poisson draw with that mean, inverted from a uniform that is a hash of its id, source
and text and of its number among equal rows, so a rerun, a retry after a lost executor and another cluster size give the
same rows. Documents are exploded by their counts, then dealt by a hash and sorted by another inside each partition: a
global shuffle. A hot row is counted before it is shuffled, numbered within input partitions and dealt by number and copy.

Only DataFrame functions run on the rows.

Defined results
* null source: a source of its own, with the default weight unless ``weights`` holds the key None;
* null doc_id: source and text make the seed; null text counts as empty;
* repeated rows, and rows that share an id: each has a draw of its own, so shares hold whatever is repeated; among rows equal
  in id, source and text it is open which has which draw where extra columns tell them apart;
* a source of weight 0, or an empty table: no rows;
* a text may be of any length that a row can hold; ties of the shuffle key leave equal rows in any order;
* extra columns of any name pass through; a column called like an output column is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstone.session import shared_dir, written

#: A Poisson mean above this is drawn as a sum of independent Poisson draws of at most this mean.
CHUNK = 16.0
#: Terms of a chunk's distribution function; the tail beyond has under 1e-16 of the mass at mean 16.
TERMS = 72
#: The rates are broadcast up to this many sources and joined by shuffle beyond.
MAX_BROADCAST_SOURCES = 50_000
#: Keys of repeated rows are broadcast up to so many (some 10 MB) and joined by shuffle beyond.
MAX_BROADCAST_KEYS = 100_000


def hashed_uniform(*parts: Column) -> Column:
    """A uniform double in [0, 1) with 52 bits from the MD5 of the parts joined by '|'."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def row_key() -> Column:
    """The id, source and digest of the text of a row of documents; equal rows have equal keys."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws("|", plain("doc_id"), plain("source"), F.md5(plain("text")))


def poisson_table(mean: Column) -> Column:
    """array<double> of P(X <= 0), P(X <= 1), ... for a Poisson mean of at most CHUNK."""
    step = lambda s, k: F.struct(
        (s["p"] * mean / k).alias("p"),
        (s["c"] + s["p"] * mean / k).alias("c"),
        F.concat(s["all"], F.array(s["c"] + s["p"] * mean / k)).alias("all"),
    )
    first = F.exp(-mean)
    start = F.struct(first.alias("p"), first.alias("c"), F.array(first).alias("all"))
    ks = F.transform(F.sequence(F.lit(1), F.lit(TERMS)), lambda k: k.cast("double"))
    return F.aggregate(ks, start, step, lambda s: s["all"])


def source_rates(
    docs: DataFrame, weights: dict[str | None, float] | None, default_weight: float, by: str, total: float | None
) -> DataFrame:
    """source, n_docs, size, rate: one row a source, from all documents."""
    size = F.lit(1) if by == "rows" else F.octet_length(F.coalesce("text", F.lit("")))
    stats = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(size.cast("long")).alias("size"))
    weight = F.lit(float(default_weight))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(w))).otherwise(weight)
    stats = stats.withColumn("weight", weight).checkpoint()
    all_weight, all_size = stats.agg(F.sum("weight"), F.sum("size")).first()  # one row
    whole = F.lit(float(all_size or 0) if total is None else float(total))
    rate = F.when(
        (F.col("size") > 0) & (F.col("weight") > 0),
        F.col("weight") / F.lit(float(all_weight or 1)) * whole / F.col("size"),
    ).otherwise(F.lit(0.0))
    return stats.select("source", "n_docs", "size", rate.alias("rate"))


def numbered(rows: DataFrame, often: int = 1) -> DataFrame:
    """rows with number, from 0 among the rows of each key that has more than often; 0 for all other rows.

    Only keys that repeat more often cost more than a count.

    The rows of those keys are written with their input partition. They are numbered by key and partition, so a key that
    holds a third of all rows is as many groups as it has partitions; the groups' sizes add up to where each begins.
    """
    repeats = written(rows.groupBy("key").count().where(F.col("count") > often).select("key"), "repeats")
    n = repeats.limit(MAX_BROADCAST_KEYS + 1).count()
    if n == 0:
        return rows.withColumn("number", F.lit(0).cast("long"))
    if n <= MAX_BROADCAST_KEYS:
        repeats = F.broadcast(repeats)
    held = written(rows.withColumn("part", F.spark_partition_id()).join(repeats, "key", "left_semi"), "repeated")
    at = Window.partitionBy("key", "part").orderBy("part")
    sizes = held.groupBy("key", "part").count()
    begins = sizes.select("key", "part", (F.sum("count").over(Window.partitionBy("key").orderBy("part")) - F.col("count")).alias("begin"))
    placed = held.withColumn("place", F.row_number().over(at) - 1).join(begins, ["key", "part"])
    again = placed.select(*rows.columns, (F.col("begin") + F.col("place")).alias("number"))
    return rows.join(repeats, "key", "left_anti").select(*rows.columns, F.lit(0).cast("long").alias("number")).unionByName(again)


def mix_sources(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    default_weight: float = 1.0,
    by: str = "bytes",
    total: float | None = None,
    seed: int = 17,
    partitions: int | None = None,
) -> DataFrame:
    """docs replicated so that each source has its share; adds copy (from 0), n_copies, rate and shuffle_key.

    weights: relative weights of sources; a source not named has default_weight. by: 'bytes' or 'rows', what shares
    are measured in. total: the size of the result in that unit; the size of docs if None.
    """
    spark = docs.sparkSession
    shared_dir(spark)
    out = ["copy", "n_copies", "rate", "shuffle_key"]
    docs = docs.drop(*out)
    rates = source_rates(docs, weights, default_weight, by, total)
    chunks = F.greatest(F.lit(1), F.ceil(F.col("rate") / CHUNK)).cast("int")
    rates = rates.select(F.col("source").alias("of"), "rate", chunks.alias("chunks"), poisson_table(F.col("rate") / chunks).alias("cdf"))
    if rates.limit(MAX_BROADCAST_SOURCES + 1).count() <= MAX_BROADCAST_SOURCES:
        rates = F.broadcast(rates)
    # the caller's columns stay in one struct, so no name of theirs can meet one of ours
    rows = docs.select(
        F.struct(*docs.columns).alias("doc"), F.col("source").alias("source"), row_key().alias("key")
    )
    joined = numbered(rows).join(rates, F.col("source").eqNullSafe(F.col("of")))
    uniforms = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1), lambda chunk: hashed_uniform(F.lit(seed), chunk, F.col("key"), F.col("number"))
    )
    count = F.aggregate(uniforms, F.lit(0), lambda n, u: n + F.size(F.filter("cdf", lambda c: c <= u)))
    exploded = (
        joined.withColumn("n_copies", count)
        .where("n_copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
        .withColumn("shuffle_key", F.xxhash64(F.lit(seed), "key", "number", F.col("copy")))
        .select("doc.*", *out)
    )
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return exploded.repartition(n, "shuffle_key").sortWithinPartitions(F.xxhash64("shuffle_key"), "shuffle_key")


def op1_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents, every source to an equal share of the bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs).select("doc_id", "source", "copy", "n_copies", "text", "lang", "n_chars")


SQL = f"""
WITH stats AS (
  SELECT source, sum(strlen(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
sums AS (SELECT count(*)::DOUBLE AS all_weight, sum(size) AS all_size FROM stats),
rates AS (
  SELECT source, CASE WHEN size > 0 THEN 1.0::DOUBLE / all_weight * all_size / size ELSE 0.0 END AS rate
  FROM stats, sums),
parts AS (
  SELECT source, greatest(1, ceil(rate / {CHUNK}))::INT AS chunks, rate / greatest(1, ceil(rate / {CHUNK})) AS mean
  FROM rates),
cdf AS (
  SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c
  FROM (SELECT source, k, exp(k * ln(mean) - mean - lgamma(k + 1)) AS p
        FROM parts, range(0, {TERMS} + 1) t(k) WHERE mean > 0)),
draws AS (
  SELECT d.row, d.doc_id, d.source, d.lang, d.n_chars, d.text, chunk,
         ('0x' || substr(md5(concat_ws('|', '17', chunk::VARCHAR, d.key, d.number::VARCHAR)), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE AS u
  FROM (SELECT *, row_number() OVER () AS row, row_number() OVER (PARTITION BY key) - 1 AS number
        FROM (SELECT *, concat_ws('|', coalesce(doc_id::VARCHAR, ''), coalesce(source, ''), md5(coalesce(text, ''))) AS key FROM documents)) d JOIN parts p ON d.source IS NOT DISTINCT FROM p.source, range(0, p.chunks) t(chunk)),
counts AS (
  SELECT first(doc_id) AS doc_id, first(d.source) AS source, first(lang) AS lang, first(n_chars) AS n_chars, first(text) AS text,
         sum((SELECT count(*) FROM cdf c WHERE c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u))::INT AS n_copies
  FROM draws d GROUP BY row)
SELECT doc_id, source, copy::INT AS copy, n_copies, text, lang, n_chars
FROM counts, range(0, n_copies) t(copy)
"""
