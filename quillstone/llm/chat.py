"""Chat formatting: collapse logged snapshots of growing conversations, then render the maximal ones.

A service that logs the whole conversation after every turn leaves many rows that are prefixes of longer ones. Every
turn hashes with its position; the rolling XOR of these hashes over a conversation is the hash of each of its turn
prefixes. A conversation whose whole hash is the hash of a shorter prefix of another one goes (anti-join); of equal
conversations the one with the smallest conv_id stays. Hashes are 128 bits wide.

Texts do not travel before the maximal conversations are known: hashes are narrow rows, equal hashes are aggregated
before they are shuffled, so that a third of all conversations sharing turns or being copies meets as one row a task.
A rendered conversation is one value, so its own turns meet in one task; Spark's 2 GiB a value bounds them.

Defined results
* turns are ordered by turn (null first); those that tie by role, then by the MD5 of the text, so that texts need not
  be sorted;
* a text may be of any length, a conversation of any that one value can hold;
* rows equal in conv_id, turn, role and text count once;
* null role and null text count as empty; rows of null conv_id form one conversation;
* an empty table: no rows; extra columns are left out of the rendering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TEMPLATE = ("<|", "|>\n", "\n<|end|>\n")


def _content(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return turns.select(
        "conv_id", "turn", role.alias("role"), text.alias("text"), F.unhex(F.md5(text)).alias("_m")
    )


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """conv_id, at (1 for the first turn), n_turns, hash_a, hash_b: one row for every prefix of every conversation."""
    rows = _content(turns).select("conv_id", "turn", "role", "_m").distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "_m")
    rows = rows.withColumn("at", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return rows.select(
        "conv_id",
        "at",
        F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n_turns"),
        F.bit_xor(F.xxhash64("at", "role", "_m")).over(upto).alias("hash_a"),
        F.bit_xor(F.xxhash64("_m", "at", "role")).over(upto).alias("hash_b"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no longer one begins with, one of each set of equals."""
    hashes = prefix_hashes(turns)
    key = ["at", "hash_a", "hash_b"]
    whole = hashes.where("at = n_turns").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    shorter = hashes.where("at < n_turns").select(*key).distinct()
    return whole.join(shorter, key, "left_anti").select("conv_id", F.col("at").cast("long").alias("n_turns"), "n_copies")


def render_conversations(turns: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: the maximal conversations as one text each.

    Marks of the template inside a text are broken up by a space, so that a text cannot forge a turn.
    """
    keep = maximal_conversations(turns).withColumnRenamed("conv_id", "_conv")
    said = _content(turns).select("conv_id", F.struct("turn", "role", "_m", "text").alias("said"))
    kept = said.join(keep, F.col("conv_id").eqNullSafe(F.col("_conv")))
    opening, middle, end = template
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    one = lambda s: F.concat(F.lit(opening), safe(s["role"]), F.lit(middle), safe(s["text"]), F.lit(end))
    whole = kept.groupBy("conv_id").agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.sort_array(F.collect_list("said")).alias("said"))
    return whole.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform(F.array_distinct("said"), one), "").alias("rendered"))


def op7_format_chat(spark, sf_dir: str) -> DataFrame:
    """The maximal conversations of the whole table, rendered."""
    return render_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


SQL = """
WITH turns AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
convs AS (
  SELECT conv_id, count(*) AS n_turns, list({'r': role, 't': text} ORDER BY turn NULLS FIRST, role, md5(text)) AS said
  FROM turns GROUP BY conv_id),
prefixes AS (SELECT DISTINCT said[1:k] AS said FROM convs, range(1, n_turns) t(k)),
whole AS (SELECT min(conv_id) AS conv_id, n_turns, count(*) AS n_copies, said FROM convs GROUP BY n_turns, said)
SELECT conv_id, n_turns, n_copies,
  array_to_string(list_transform(said, lambda x: '<|' || replace(x.r, '<|', '< |') || '|>' || chr(10) || replace(x.t, '<|', '< |') || chr(10) || '<|end|>' || chr(10)), '') AS rendered
FROM whole w WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.said = w.said)
"""
