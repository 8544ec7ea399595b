"""Cues, numbers and changes of medicine in lines that are made of the tables' own columns; the SQL works the answers out from the same columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import cues as C
from quillstone.functions import number_words as W
from quillstone.functions import numbers as N
from quillstone.plans.registry import query
from quillstone.session import table


def said(*parts) -> Column:
    """A sentence of texts and columns."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def either(number: Column, *texts: Column) -> Column:
    """The text whose place is number modulo their count."""
    return F.element_at(F.array(*texts), (number % len(texts) + 1).cast("int"))


#: A line has a key, an amount q from 1 to 50, a count n from 1 to 7, a second amount m and a kind.
LINE = "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS q, l_linenumber::BIGINT AS n, (l_partkey % 40 + 1)::BIGINT AS m, (l_suppkey + l_linenumber)::BIGINT AS kind FROM lineitem"
KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "q"]
KEY = ", ".join(KEYS)


def lines(spark, sf_dir: str) -> DataFrame:
    long = lambda c: F.col(c).cast("long")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", long("l_quantity").alias("q"), long("l_linenumber").alias("n"), (long("l_partkey") % 40 + 1).alias("m"), (long("l_suppkey") + long("l_linenumber")).alias("kind")
    )


@query("""SELECT o_orderkey, coalesce(CASE o_orderpriority WHEN '1-URGENT' THEN true WHEN '2-HIGH' THEN o_orderstatus <> 'P' WHEN '3-MEDIUM' THEN true ELSE false END, false) AS warning,
  o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus <> 'F' AS urgent FROM orders""")
def warnings_and_urgency(spark, sf_dir: str) -> DataFrame:
    """Emergency warnings in six languages by words or kind, and questions that cannot wait, in notes about orders."""
    o = table(spark, sf_dir, "orders")
    key, state = F.col("o_orderkey"), F.col("o_orderstatus")
    urgent = F.when(state == "F", said("Go to the hospital right away if package ", key, " makes you faint.")).when(state == "O", said("Appelez le 911 pour la commande ", key)).otherwise(said("订单 ", key, " 出现胸闷请立即就医"))
    high = F.when(state == "P", said("If this is not an emergency, ask about ", key, " tomorrow.")).when(state == "F", said("Vaya al hospital por el pedido ", key)).otherwise(said("주문 ", key, " 응급실에 가세요"))
    asked = F.when(state == "F", said("My parcel ", key, " is loose.")).when(state == "O", said("Since order ", key, " I have chest pain.")).otherwise(said("No puedo respirar desde el pedido ", key))
    text = F.when(F.col("o_orderpriority") == "1-URGENT", urgent).when(F.col("o_orderpriority") == "2-HIGH", high).when(F.col("o_orderpriority") == "4-NOT SPECIFIED", asked).otherwise(said("Drink water after order ", key, "."))
    kind = F.when(F.col("o_orderpriority") == "3-MEDIUM", "warning").otherwise("todo")
    return o.select("o_orderkey", C.is_warning(text, kind).alias("warning"), C.is_urgent(text).alias("urgent"))


@query(f"""SELECT {KEY}, CASE kind % 8 WHEN 0 THEN CASE WHEN q <= 14 THEN 'soon' ELSE 'later' END WHEN 1 THEN CASE WHEN q <= 2 THEN 'soon' ELSE 'later' END WHEN 2 THEN 'daily' WHEN 3 THEN 'unclear'
  WHEN 4 THEN 'unclear' WHEN 5 THEN 'later' WHEN 6 THEN 'today' ELSE CASE WHEN n <= 4 THEN 'today' WHEN n <= 5 THEN 'soon' ELSE 'unclear' END END AS grp,
  CASE WHEN kind % 8 = 7 AND n = 5 THEN 'explanation' WHEN kind % 8 = 7 AND n > 5 THEN 'none' ELSE 'paper' END AS source FROM ({LINE})""")
def step_times(spark, sf_dir: str) -> DataFrame:
    """When a step is due: counted days and weeks, words, a stop, else a certified explanation; negations leave it open."""
    q, n, kind = F.col("q"), F.col("n"), F.col("kind") % 8
    texts = [
        said("Return in ", q, " days."), said("Come back in ", q, " weeks for test ", n, "."), said("Take ", q, " mg ", n, " times a day."), said("Do not come back in ", q, " days."), said("Call today, and again in ", q, " days."),
        said("Vuelva en ", q, " meses."), said("Start today and take ", q, " mg every day."), F.when(n <= 4, said("Stop taking part ", n, ".")).otherwise(said("Rest for part ", n, ".")),
    ]
    w = C.step_when(F.lit("medication"), either(kind, *texts), F.lit(""), F.lit("this week"), F.when(n == 5, "certified").otherwise("flagged"))
    return lines(spark, sf_dir).select(*KEYS, w.alias("w")).select(*KEYS, F.col("w.group").alias("grp"), "w.source")


@query(f"""SELECT {KEY}, CASE kind % 6 WHEN 2 THEN 'refusal' WHEN 3 THEN 'topic' WHEN 4 THEN 'empty' WHEN 5 THEN 'unreadable' END AS blocker,
  CASE WHEN kind % 6 = 1 AND q <> m AND m <> n THEN 'flagged' WHEN n = 7 THEN 'flagged' WHEN kind % 6 <= 1 THEN 'certified' ELSE 'unchecked' END AS seal FROM ({LINE})""")
def explanation_checks(spark, sf_dir: str) -> DataFrame:
    """Whether an explanation may carry the seal: what is not read, refusals, topics, numbers and a second reader together."""
    q, n, m, kind = F.col("q"), F.col("n"), F.col("m"), F.col("kind") % 6
    paper = F.when(kind == 2, said("Do not take ", q, " mg in ", n, " days.")).otherwise(said("Take ", q, " mg in ", n, " days."))
    told = either(kind, said("Take ", q, " mg in ", n, " days."), said("Take ", m, " mg in ", n, " days."), said("Take ", q, " mg in ", n, " days."), said("Take ", q, " mg in ", n, " days at bedtime."), F.lit(" "), said("Prenez ", q, " mg dans ", n, " jours"))
    rows = lines(spark, sf_dir).withColumn("paper", paper).withColumn("told", told)
    rows = rows.withColumn("c", N.number_check(F.col("paper"), F.col("told"))).withColumn("blocker", C.certify_blocker(F.col("paper"), F.col("told")))
    verdict = F.when(n == 7, "different").otherwise("same")
    return rows.select(*KEYS, "blocker", C.combined_check(verdict, F.col("c.unexpected"), F.col("c.uncheckable"), F.col("blocker")).alias("seal"))


@query(f"""SELECT {KEY}, CASE kind % 8 WHEN 0 THEN 'change' WHEN 1 THEN 'change' WHEN 2 THEN 'stop' WHEN 3 THEN 'ask' WHEN 4 THEN 'start' WHEN 5 THEN 'keep' ELSE 'ask' END AS row,
  CASE kind % 8 WHEN 3 THEN 'negated' WHEN 6 THEN 'conditional' WHEN 7 THEN 'mixed' END AS reason, split_part(p_name, ' ', 1) AS name,
  CASE kind % 8 WHEN 0 THEN q || ' mg > ' || m || ' mg' END AS dose FROM ({LINE}) JOIN part ON l_partkey = p_partkey""")
def medicine_changes(spark, sf_dir: str) -> DataFrame:
    """What a line does to a medicine (parts stand in), why it is unclear, its name and a changed dose."""
    name, q, m, kind = F.col("name"), F.col("q"), F.col("m"), F.col("kind") % 8
    text = either(
        kind, said("Increase ", name, " from ", q, " mg to ", m, " mg."), said("Lower your dose of ", name, " to ", q, " mg."), said("Stop taking ", name, "."), said("Do not stop taking ", name, "."), said("Start taking ", name, " at ", q, " mg."),
        said("Continue your ", name, "."), said("If you bleed, stop the ", name, "."), said("Stop ", name, " and start ", q, " mg of another."),
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.substring_index("p_name", " ", 1).alias("name"))
    rows = lines(spark, sf_dir).join(parts, "l_partkey").withColumn("text", text).withColumn("c", C.medicine_row(F.col("text"))).withColumn("d", C.dose_change(F.col("text")))
    return rows.select(*KEYS, "c.row", "c.reason", C.medicine_name(F.col("text")).alias("name"), F.when(F.col("d").isNotNull(), F.concat("d.was", F.lit(" > "), "d.now")).alias("dose"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE (2 + o_orderkey * 37 % 9998)::VARCHAR END AS numbers, o_orderkey % 7 = 0 AS uncheckable FROM orders")
def spelled_numbers(spark, sf_dir: str) -> DataFrame:
    """Numbers made of the orders' keys, written out in six languages and read again; two side by side are no number."""
    unit = {"en": " tablets", "es": " tabletas", "fr": " comprimés", "vi": " viên", "zh": "片", "ko": " 밀리그램"}
    language = either(F.col("o_orderkey"), *[F.lit(k) for k in unit])

    @F.pandas_udf("string")
    def written(keys: pd.Series, languages: pd.Series) -> pd.Series:
        glue = lambda x: "" if x in ("zh", "ko") else " "
        words = lambda k, x: glue(x).join(W.spelled(v, x) for v in ((34, 52) if k % 7 == 0 else (2 + k * 37 % 9998,)))
        return pd.Series([words(k, x) + unit[x] for k, x in zip(keys, languages, strict=True)])

    rows = table(spark, sf_dir, "orders").select("o_orderkey", language.alias("language")).withColumn("text", written("o_orderkey", "language"))
    got = rows.withColumn("n", W.read("text", "language"))
    return got.select("o_orderkey", F.array_join("n.numbers", ",").alias("numbers"), "n.uncheckable")


@query(f"""SELECT {KEY}, CASE kind % 4 WHEN 0 THEN n || '/' || q WHEN 1 THEN '' WHEN 2 THEN CASE WHEN n = 1 AND q = 2 THEN '1/2' ELSE n || '/' || q || ',1/2' END ELSE '' END AS parts, kind % 4 IN (1, 3) AS mixed FROM ({LINE})""")
def fractions_in_lines(spark, sf_dir: str) -> DataFrame:
    """Fractions of a line's numbers as one value each; mixed numbers and ordinals are not read by parts."""
    q, n = F.col("q"), F.col("n")
    f = N.fractions(either(F.col("kind"), said("take ", n, "/", q, " of it"), said("take ", q, " ", n, "/8"), said("take ", n, " ⁄ ", q, ", then half"), said("a third of ", q)))
    return lines(spark, sf_dir).select(*KEYS, f.alias("f")).select(*KEYS, F.array_join("f.values", ",").alias("parts"), "f.mixed")


@query(f"""SELECT {KEY}, CASE WHEN kind % 3 = 2 THEN q * 1000 || ':ml,' || n || ':day' ELSE q || ':mg,' || n || ':hour' END AS amounts, kind % 3 = 1 AND q <> n AS swapped FROM ({LINE})""")
def unit_checks(spark, sf_dir: str) -> DataFrame:
    """Numbers with their unit's class, and whether an explanation gives a number another one's unit."""
    q, n, kind = F.col("q"), F.col("n"), F.col("kind") % 3
    paper = F.when(kind == 2, said("Drink ", q, ",000 ml in ", n, " days.")).otherwise(said("Take ", q, " mg every ", n, " hours."))
    told = either(kind, said(q, " milligrams each ", n, " hrs"), said("Take ", n, " mg every ", q, " hours."), said("In ", n, " days drink ", q, ",000 milliliters."))
    rows = lines(spark, sf_dir).withColumn("paper", paper).withColumn("told", told)
    return rows.select(*KEYS, F.array_join(N.measured(F.col("paper")), ",").alias("amounts"), N.units_swapped(F.col("paper"), F.col("told")).alias("swapped"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) - 1 AS pos FROM documents),
h AS (SELECT *, CASE WHEN regexp_matches(line, '^[^.!?]{1,60}:[ \\t]*$') THEN pos END AS place FROM l),
w AS (SELECT *, max(place) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading FROM h)
SELECT doc_id, count(*) AS n, count(heading) AS n_under, count(DISTINCT heading) AS n_headings FROM w GROUP BY doc_id""")
def lines_under_headings(spark, sf_dir: str) -> DataFrame:
    """For every line the list heading above it; counted by document."""
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\\r?\\n")).alias("pos", "line"))
    at = F.when(F.col("line").rlike("^[^.!?]{1,60}:[ \\t]*$"), F.col("pos"))
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marked = lines.select("doc_id", F.last(at, ignorenulls=True).over(w).alias("heading"))
    return marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count("heading").alias("n_under"), F.count_distinct("heading").alias("n_headings"))
