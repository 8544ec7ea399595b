"""Queries on papers' languages, payloads, restated answers and plan events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quillstone.functions import payload
from quillstone.functions import text as T
from quillstone.functions.answers import restated_option
from quillstone.operators import languages as L
from quillstone.plans.registry import query
from quillstone.session import table
from quillstone.streaming import plan_events


@query()
def paper_languages(spark, sf_dir: str) -> DataFrame:
    """Languages that each document's coverage can be checked in, sentence by sentence; null where it cannot."""
    found = L.language_tallies(table(spark, sf_dir, "documents"), "doc_id")
    return found.select("doc_id", F.array_join(L.checkable_languages(), ",").alias("languages"))


_HITS = lambda k: f"len(list_filter(w, lambda x: list_contains(string_split('{L.ON_PHOTO[k]}', ' '), x)))"
_N = lambda p: f"length(regexp_replace(coalesce(text, ''), '[^{p}]', '', 'g'))"


@query(f"""WITH words AS (
  SELECT doc_id, {_N("\\p{L}")} AS n, {_N("\\p{Latin}")} AS n_latin, {_N("ăĂđĐơƠưƯẠ-ỹ")} AS n_vi,
    list_transform(regexp_extract_all(regexp_replace(lower(strip_accents(coalesce(text, ''))), '[-­‐‑][ \\t\\r]*\\n\\s*', '', 'g'), '\\S+'), lambda x: regexp_replace(x, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS w
  FROM documents),
hits AS (SELECT *, {_HITS("es")} AS es, {_HITS("en")} AS en, {_HITS("fr")} AS fr FROM words)
SELECT doc_id, CASE WHEN n - n_latin > 0.2 * n OR n_vi >= 3 AND n_vi > 0.02 * n OR fr >= 5 AND fr > 1.5 * es AND fr > 1.5 * en THEN NULL WHEN es >= 5 AND es > 1.5 * en THEN 'spa' ELSE 'eng' END AS reading_data FROM hits""")
def photo_languages(spark, sf_dir: str) -> DataFrame:
    """Which reading data a photo of each document needs; null for languages without any."""
    found = L.language_tallies(table(spark, sf_dir, "documents"), "doc_id")
    return found.select("doc_id", L.photo_language().alias("reading_data"))


@query("SELECT conv_id, count(*) AS n, bool_and(coalesce(length(text) > 0, false)) AND (coalesce(conv_id % 7, 0) = 0 OR conv_id % 7 = 6 AND count(DISTINCT text) = 1) AS valid FROM conversations GROUP BY conv_id")
def checked_payloads(spark, sf_dir: str) -> DataFrame:
    """Payloads of conversations' turns as sentences, six in seven of them damaged in one way each, by every rule.

    Groups that lead nowhere, a place before the text, a text that ends early, critical parts outside their sentence, no
    sentence at all, and turns in the group of a first one that reads otherwise.
    """
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    by = Window.partitionBy("conv_id").orderBy("turn", "text")
    same = Window.partitionBy("conv_id", F.md5(T.normalize(F.coalesce("text", F.lit("")))))
    placed = turns.withColumns({"i": F.row_number().over(by) - 1, "end": F.sum(F.coalesce(F.length("text"), F.lit(0)) + 1).over(by) - 1})
    placed = placed.withColumns({"lead": F.min("i").over(same), "start": F.col("end") - F.coalesce(F.length("text"), F.lit(0)), "k": F.coalesce(F.col("conv_id") % 7, F.lit(0))})
    k = F.col("k")
    start = F.col("start") - F.when(k == 2, 1).otherwise(0)
    critical = F.array(F.array("start", F.col("end") + F.when(k == 4, 1).otherwise(0)))
    group = F.when(k == 1, F.col("i") + 1).when(k == 6, 0).otherwise(F.col("lead"))
    sentence = F.struct("i", "text", start.alias("start"), "end", critical.alias("critical"), group.alias("group"))
    whole = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(sentence)).alias("s"), F.max("end").alias("length"), F.first("k").alias("k"))
    body = F.struct(F.lit(True).alias("show"), F.array(F.lit("en")).alias("languages"), F.create_map(F.lit("q"), F.array(F.array(F.lit(0), F.lit(1)))).alias("quotes"), F.when(k != 5, F.col("s")).otherwise(F.slice("s", 1, 0)).alias("sentences"))
    limit = F.col("length") - F.when(k == 3, 1).otherwise(0)
    return whole.select("conv_id", F.size("s").cast("long").alias("n"), payload.valid_missed_lines(F.to_json(body), limit).alias("valid"))


PLAN = "conv_id BIGINT, turns ARRAY<STRUCT<turn: BIGINT, role: STRING, text: STRING>>, notes MAP<STRING, STRUCT<said: STRING, times: INT>>"


@query("SELECT conv_id, count(*) AS n, md5(coalesce(string_agg(role || '=' || text, '|' ORDER BY turn, text, role), '')) AS said, md5(coalesce(min(text), '')) AS note FROM conversations GROUP BY conv_id")
def restored_payloads(spark, sf_dir: str) -> DataFrame:
    """Conversations as JSON with placeholders in every string, at any depth, that are put back through the schema."""
    kind = S.StructType.fromDDL(PLAN)
    pairs = [("[[NAME_1]]", "an"), ("[[MRN_2]]", "th")]
    hide = lambda c: F.replace(F.replace(c, F.lit("an"), F.lit("[[NAME_1]]")), F.lit("th"), F.lit("[[MRN_2]]"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text", "role"))).alias("t"), F.min("text").alias("first"))
    parts = F.transform("t", lambda x: F.struct(x["turn"].alias("turn"), hide(x["role"]).alias("role"), hide(x["text"]).alias("text")))
    note = F.create_map(F.lit("an"), F.struct(hide(F.col("first")).alias("said"), F.lit(1).alias("times")))
    json = F.to_json(F.struct("conv_id", parts.alias("turns"), note.alias("notes")))
    known = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(v).alias("value")) for t, v in pairs])
    back = turns.select("conv_id", F.from_json(payload.map_json_strings(json, kind, lambda c: payload.put_back(c, known)), kind).alias("p"))
    said = F.array_join(F.transform("p.turns", lambda x: F.concat(x["role"], F.lit("="), x["text"])), "|")
    return back.select("conv_id", F.size("p.turns").cast("long").alias("n"), F.md5(said).alias("said"), F.md5(F.coalesce(F.col("p.notes")["an"]["said"], F.lit(""))).alias("note"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 2 THEN 1 WHEN 3 THEN CASE WHEN p_partkey % 2 = 0 THEN 2 END WHEN 4 THEN CASE WHEN p_size = p_partkey % 3 + 1 THEN 0 END ELSE 0 END AS chosen FROM part")
def restated_options(spark, sf_dir: str) -> DataFrame:
    """Which of three dosings by a part's size an answer restates: other words, spoken numbers, a changed order."""
    k, size, n = F.col("p_partkey"), F.col("p_size"), F.col("p_partkey") % 3 + 1
    told = lambda pattern, *cells: F.format_string(pattern, *[c if isinstance(c, str) else c.cast("string") for c in cells])
    third = F.when(k % 2 == 0, told("Take %s mg %s times a day with food", size, n)).otherwise(told("Take %s mg %s times a day", size, n + 1))
    options = F.array(told("Take %s mg %s times a day", size, n), told("Take %s mg %s times a day", size + 1, n), third)
    pick = lambda *words: F.element_at(F.array(*map(F.lit, words)), n.cast("int"))
    answer = (
        F.when(k % 5 == 0, told("Um, I should take %s milligrams %s times a day, please.", size, n))
        .when(k % 5 == 1, told("taking %s mg %s times a day", size, pick("one", "two", "three")))
        .when(k % 5 == 2, told("Take %s mg %s a day", size + 1, pick("once", "twice", "thrice")))
        .when(k % 5 == 3, told("I think I take %s mg %s times a day with food", size, n))
        .otherwise(told("take %s mg %s times a day", n, size))
    )
    return table(spark, sf_dir, "part").select("p_partkey", restated_option(answer, options).alias("chosen"))


@query("""WITH e AS (SELECT conv_id, turn, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) - 1 AS last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN conv_id % 5 = 4 THEN 'broken' WHEN i = last AND i > 0 AND conv_id % 3 = 0 THEN 'finished' WHEN i = last AND i > 0 AND conv_id % 3 = 1 THEN 'failed' ELSE 'preview' END AS outcome,
  CASE WHEN conv_id % 5 = 4 THEN 0 WHEN i = last AND i > 0 AND conv_id % 3 < 2 THEN i - 1 ELSE i END AS n_steps
FROM e WHERE conv_id % 5 <> 4 OR i = 0""")
def plan_previews(spark, sf_dir: str) -> DataFrame:
    """What a reader of a plan is shown after each turn of a conversation: a start, steps and an end; some have no start."""
    by = Window.partitionBy("conv_id").orderBy("turn")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.row_number().over(by) - 1).alias("i"), (F.count(F.lit(1)).over(Window.partitionBy("conv_id")) - 1).alias("last"))
    c, final = F.col("conv_id"), (F.col("i") == F.col("last")) & (F.col("i") > 0)
    kind = F.when(final & (c % 3 == 0), "done").when(final & (c % 3 == 1), "error").when((F.col("i") == 0) & (c % 5 != 4), "start").otherwise("step")
    return plan_events.previews(turns.withColumn("kind", kind), "conv_id", "turn")
