"""Uniform sharding with exact shard sizes by a hypergeometric communication matrix.

Rows fall into source blocks by a hash; rows that are equal very often are numbered first, and fall by hash and number, so
that no block holds them all. How many rows of each block go to each cell (a lane of a shard) is drawn
exactly: the matrix of counts with these row sums and column sums is multivariate hypergeometric, and is drawn by
halving the blocks again and again, each half getting a hypergeometric share of every cell. Then each block permutes
its rows, sends the first ones to cell 0, the next ones to cell 1 and so on (the exchange), and each cell permutes
what it got. Cell sizes are known beforehand, so slots need no second count, and a shard is permuted by as many
tasks as it has lanes. Blocks and lanes follow the number of rows, up to MAX_BLOCKS and MAX_CELLS. The result is a uniform permutation cut at exact shard sizes: counts are at most one apart.

Only DataFrame functions are used. Two exchanges of the rows; the matrix has blocks x shards x lanes numbers, a size
that the parameters bound and that does not follow the input.

Defined results
* the random keys hash all columns of a row, so nulls and empty texts in any column need no case of their own;
* rows that are equal in all columns are interchangeable: which of them takes which of their slots is not fixed;
* an empty table: no rows; fewer rows than shards: the first shards get one row each;
* a row may be of any size that a shuffle can carry; texts are not looked at, only hashed;
* extra columns of any name pass through; one called shard or slot is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.mixing import hashed_uniform, numbered
from quillstone.session import shared_dir, shared_path


#: Rows that a block or a lane is meant to hold, and the most blocks and cells: the matrix has 2**20 numbers at most.
ROWS = 2_000_000
MAX_BLOCKS = 1_024
MAX_CELLS = 1_024
#: Up to so many equal rows may stay in one block.
EQUAL = 1_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(total: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many good ones are among draws out of total, inverted from the uniform u.

    Summed from far below the mode to far above it (9 standard deviations and 40): what is beyond is under 1e-16.
    """
    t, g, n = (c.cast("double") for c in (total, good, draws))
    spread = F.sqrt(n * g / F.greatest(t, F.lit(1.0)) * (F.lit(1.0) - g / F.greatest(t, F.lit(1.0))) * (t - n) / F.greatest(t - 1, F.lit(1.0)))
    mode = F.floor((n + 1) * (g + 1) / (t + 2))
    width = (F.ceil(spread * 9) + 40).cast("long")
    first = F.greatest(F.lit(0).cast("long"), draws - (total - good), mode - width)
    last = F.least(draws, good, mode + width)

    def weight(k, before, a):
        j = (k - 1).cast("double")
        return F.when(k == a, F.lit(1.0)).otherwise(before * (g - j) * (n - j) / ((j + 1) * (t - g - n + j + 1)))

    def invert(ab):
        ks = F.sequence(ab["a"], F.greatest(ab["a"], ab["b"]))
        whole = F.aggregate(
            ks,
            F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum")),
            lambda s, k: let(weight(k, s["w"], ab["a"]), lambda w: F.struct(w.alias("w"), (s["sum"] + w).alias("sum"))),
            lambda s: s["sum"],
        )
        return let(
            u * whole,
            lambda goal: F.aggregate(
                ks,
                F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("sum"), ab["a"].alias("k")),
                lambda s, k: let(
                    weight(k, s["w"], ab["a"]),
                    lambda w: F.struct(
                        w.alias("w"),
                        (s["sum"] + w).alias("sum"),
                        F.when(s["sum"] + w <= goal, F.least(k + 1, ab["b"])).otherwise(s["k"]).alias("k"),
                    ),
                ),
                lambda s: s["k"],
            ),
        )

    return let(F.struct(first.alias("a"), last.alias("b")), invert)


def even_size(total: Column, parts: int, index: Column) -> Column:
    """Size of part index when total is cut into parts that are at most one apart, the larger ones first."""
    return F.floor(total / parts) + F.when(index < total % parts, 1).otherwise(0)


def even_start(total: Column, parts: int, index: Column) -> Column:
    return index * F.floor(total / parts) + F.least(index, total % parts)


def communication_matrix(counts: DataFrame, blocks: int, shards: int, lanes: int, seed: int) -> DataFrame:
    """block, total, upto: for each cell the rows that the block sends to this and the earlier cells.

    counts: one row with sizes, array<long> of the rows in each block. blocks: a power of two.
    """
    cells = shards * lanes
    add = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    total = add(F.col("sizes"))
    shard_rows = lambda q: even_size(F.col("total"), shards, F.floor(q / lanes))
    room = F.transform(
        F.sequence(F.lit(0), F.lit(cells - 1)),
        lambda q: let(shard_rows(q), lambda n: even_size(n, lanes, q % lanes)).cast("long"),
    )
    nodes = counts.withColumn("total", total).select("total", F.lit(0).alias("node"), "sizes", room.alias("room"))
    width = blocks
    while width > 1:
        half = width // 2

        def share(s, q):
            good = F.element_at(F.col("room"), q + 1)
            u = hashed_uniform(F.lit(seed), F.lit(half), F.col("node"), q)
            x = hypergeometric(s["rest"], good, s["draws"], u)
            return let(
                x,
                lambda got: F.struct(
                    (s["rest"] - good).alias("rest"),
                    (s["draws"] - got).alias("draws"),
                    F.concat(s["got"], F.array(got)).alias("got"),
                ),
            )

        left = F.slice("sizes", 1, half)
        start = F.struct(add(F.col("room")).alias("rest"), add(left).alias("draws"), F.array().cast("array<bigint>").alias("got"))
        nodes = nodes.withColumn(
            "left", F.aggregate(F.sequence(F.lit(0), F.lit(cells - 1)), start, share, lambda s: s["got"])
        )
        kids = F.array(
            F.struct((F.col("node") * 2).alias("node"), left.alias("sizes"), F.col("left").alias("room")),
            F.struct(
                (F.col("node") * 2 + 1).alias("node"),
                F.slice("sizes", half + 1, half).alias("sizes"),
                F.zip_with("room", "left", lambda a, b: a - b).alias("room"),
            ),
        )
        nodes = nodes.select("total", F.explode(kids).alias("kid")).select("total", "kid.*")
        if width == blocks // 8:
            nodes = nodes.repartition(8, "node")
        width = half
    upto = F.aggregate(
        "room",
        F.array().cast("array<bigint>"),
        lambda a, x: F.concat(a, F.array(x + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))),
    )
    return nodes.select(F.col("node").alias("block"), "total", upto.alias("upto"))


def in_blocks(docs: DataFrame, blocks: int, seed: int) -> DataFrame:
    """row (a struct of docs' columns, so no name of theirs can meet one of ours), key and block of every row."""
    rows = docs.select(F.struct(*docs.columns).alias("row")).withColumn("key", F.xxhash64(F.lit(seed), "row.*"))
    keyed = numbered(rows, often=EQUAL).select("row", F.xxhash64("key", "number").alias("key"))
    return keyed.withColumn("block", F.pmod(F.col("key"), F.lit(blocks)).cast("int"))


def shard_uniform(docs: DataFrame, shards: int = 8, blocks: int | None = None, lanes: int | None = None, seed: int = 23) -> DataFrame:
    """docs with shard (0 to shards - 1) and slot (gapless from 0 in each shard), a uniform random order.

    blocks: source blocks, a power of two, each sorted by one task. lanes: tasks that permute one shard. By default
    both are chosen so that a block and a lane hold about ROWS rows, but for the bounds.
    """
    shared_dir(docs.sparkSession)
    docs = docs.drop("shard", "slot")
    if blocks is None or lanes is None:
        parts = -(-docs.count() // ROWS)
        blocks = blocks or min(MAX_BLOCKS, max(64, 1 << max(0, parts - 1).bit_length()))
        lanes = lanes or max(1, min(MAX_CELLS // shards, max(8, -(-parts // shards))))
    cells = shards * lanes
    keyed = in_blocks(docs, blocks, seed)
    sizes = (
        keyed.groupBy("block")
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(F.map_from_entries(F.collect_list(F.struct("block", "n"))).alias("m"))
        .select(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0))).cast("array<bigint>").alias("sizes"))
    )
    # at most blocks x cells numbers, whatever the input's size
    matrix = F.broadcast(communication_matrix(sizes, blocks, shards, lanes, seed).checkpoint())
    placed = keyed.selectExpr("*", f"row_number() OVER (PARTITION BY block ORDER BY xxhash64({seed + 1}, key), key) AS at")
    steps = [1 << i for i in range((cells - 1).bit_length() - 1, -1, -1)]
    search = F.aggregate(  # the first cell with upto >= at, by bisection
        F.array(*[F.lit(s) for s in steps]).cast("array<int>"),
        F.lit(0),
        lambda i, s: F.when((i + s <= cells - 1) & (F.try_element_at("upto", i + s) < F.col("at")), i + s).otherwise(i),
    )
    sent = placed.join(matrix, "block").select("row", "key", "total", search.alias("cell"))
    local = sent.selectExpr("*", f"row_number() OVER (PARTITION BY cell ORDER BY xxhash64({seed + 2}, key), key) - 1 AS in_cell")
    shard = F.floor(F.col("cell") / lanes)
    lane_start = let(even_size(F.col("total"), shards, shard), lambda n: even_start(n, lanes, F.col("cell") % lanes))
    placed = local.select("row", F.struct(shard.cast("int").alias("shard"), (lane_start + F.col("in_cell")).cast("long").alias("slot")).alias("placed"))
    return placed.select("row.*", "placed.*")


def op2_shard_documents(spark, sf_dir: str) -> DataFrame:
    """All documents into shards 0 to 7, counts at most one apart; the digests are taken from the written shards.

    The whole rows go through both exchanges into a table of shards. It is written before the digests are computed,
    since Spark would else drop the columns that they do not need ahead of the exchanges.
    """
    path = shared_path(spark, "sharded")
    sharded = shard_uniform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sharded.write.option("compression", "zstd").parquet(path)  # beside two exchanges of the texts disk is scarce
    return spark.read.schema(sharded.schema).parquet(path).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
