"""What is shown of checked rows; notes are made of the tables' own columns and the SQL works the answers out from the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import views as V
from quillstone.plans import labs
from quillstone.plans.cues import KEY, KEYS, LINE, either, lines, said
from quillstone.plans.registry import query
from quillstone.session import table


@query(f"""SELECT {KEY}, CASE WHEN n = 7 THEN 'numbers' WHEN n = 6 THEN 'negation' WHEN kind % 6 = 0 THEN 'none' WHEN kind % 6 IN (1, 2) THEN 'negation' WHEN q % 5 IN (0, 1) THEN 'checking' WHEN q % 5 = 2 THEN 'check_failed'
  WHEN m % 3 = 0 THEN 'certified' WHEN m % 3 = 1 THEN 'flagged' ELSE 'unclear' END AS state,
  kind % 6 IN (1, 4) AS must_see, CASE kind % 6 WHEN 1 THEN 'Do not take ' || q || ' mg.' WHEN 4 THEN 'Call us about item ' || n || ' at 404-555-0199 if the amount of ' || q || ' mg is more than what you were told' ELSE 'Take ' || q || ' mg of the item that was handed to you in the shop on the corner…' END AS shown FROM ({LINE})""")
def explanation_views(spark, sf_dir: str) -> DataFrame:
    """What becomes of an explanation, and the closed row of its step: whole where it must be seen, else cut at a word."""
    q, n, m, kind = F.col("q"), F.col("n"), F.col("m"), F.col("kind") % 6
    usual = said("Take ", q, " mg of the item\n that was handed to you in the shop on the corner at the ", q, "th avenue.")
    quote = F.when(kind == 1, said("Do not  take ", q, " mg.")).when(kind == 4, said("Call us about item ", n, " at 404-555-0199 if\nthe amount of ", q, " mg is more than what you were told")).otherwise(usual)
    told = F.when(kind == 0, F.lit(None)).when(kind == 2, said("Never take more than ", q, " mg.")).otherwise(said("Use ", q, " mg."))
    state = V.explanation_state(F.col("quote"), F.col("told"), n == 7, n == 6, either(q, *map(F.lit, ("idle", "loading", "error", "done", "done"))), either(m, F.lit("certified"), F.lit("different"), F.lit(None).cast("string")))
    rows = lines(spark, sf_dir).withColumn("quote", quote).withColumn("told", told)
    return rows.select(*KEYS, state.alias("state"), V.closed_row(F.lit("take"), F.col("quote")).alias("r")).select(*KEYS, "state", F.col("r.full").alias("must_see"), F.col("r.quote").alias("shown"))


@query(f"""WITH r AS (SELECT *, CASE kind WHEN 0 THEN CASE WHEN {labs.VERDICT} IS NULL THEN 'inside' ELSE {labs.VERDICT} END WHEN 1 THEN 'high' WHEN 2 THEN 'unknown' WHEN 3 THEN coalesce({labs.VERDICT}, 'unknown') WHEN 4 THEN coalesce({labs.VERDICT}, 'unknown') ELSE 'flag' END AS chip FROM ({labs.RAW}))
SELECT report, row, chip, 'Test ' || chr(row % 26 + 65) || CASE WHEN kind = 4 AND v <> lo THEN ' ' || lo || '-' || hi ELSE '' END AS name FROM r""")
def result_chips(spark, sf_dir: str) -> DataFrame:
    """The tone of every result line and its test as the line prints it."""
    p = labs.printed(spark, sf_dir)
    v = labs.labs.read_lines(F.col("line"), F.col("test"), F.lit("mg/dL"), F.lit(""))
    rows = p.select("report", "row", "line", "test", F.col("v").cast("string").alias("value"), v.alias("x"))
    return rows.select("report", "row", V.result_chip(F.col("x.status"), F.col("x.direction")).alias("chip"), V.printed_name(F.col("line"), F.col("test"), F.col("value")).alias("name"))


@query("""WITH l AS (SELECT l_orderkey AS report, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_quantity::INT AS q, CASE WHEN l_quantity > 40 THEN 0 WHEN l_discount > 0.05 THEN 1 ELSE 2 END AS tone FROM lineitem),
a AS (SELECT *, row_number() OVER (PARTITION BY report ORDER BY tone, n, p, s, q) AS i FROM l WHERE tone < 2 AND q % 7 > 0)
SELECT report, count(*) FILTER (WHERE tone = 0) AS flagged, count(*) FILTER (WHERE tone = 1) AS unsure, count(*) FILTER (WHERE tone = 2) AS in_range,
  coalesce((SELECT string_agg(i || '. The report says: "Part ' || p || ' ' || q || '"' || chr(10) || '   Why ' || q || '?', chr(10) ORDER BY i) FROM a WHERE a.report = l.report), '') AS questions FROM l GROUP BY report""")
def result_questions(spark, sf_dir: str) -> DataFrame:
    """How many results are flagged, unsure and in range, and the questions about the first two after their lines."""
    tone = F.when(F.col("l_quantity") > 40, 0).when(F.col("l_discount") > 0.05, 1).otherwise(2)
    q = F.col("l_quantity").cast("int")
    row = F.struct(tone.alias("tone"), "l_linenumber", "l_partkey", "l_suppkey", q.alias("q"), said("Part ", F.col("l_partkey"), " ", q).alias("line"), F.when(q % 7 > 0, said(" Why ", q, "? ")).otherwise(" ").alias("ask"))
    count = lambda n, name: F.count_if(tone == n).alias(name)
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("report")).agg(count(0, "flagged"), count(1, "unsure"), count(2, "in_range"), F.sort_array(F.collect_list(F.when(tone < 2, row))).alias("rows"))
    return r.select("report", "flagged", "unsure", "in_range", V.numbered_questions(F.col("rows"), "The report says:").alias("questions"))


@query("""SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'call' WHEN 1 THEN 'directions' WHEN 2 THEN 'website' WHEN 3 THEN 'apply' END AS action,
  CASE s_suppkey % 5 WHEN 0 THEN 'tel:404555' || lpad((s_suppkey % 10000)::VARCHAR, 4, '0') WHEN 1 THEN 'https://maps.example/?to=' || replace(replace(replace(replace(s_suppkey || ' Main St #2 (rear), Town' || CASE WHEN s_nationkey % 2 = 0 THEN ', AL' ELSE ', GA' END || ' 30303', ' ', '%20'), '#', '%23'), ',', '%2C'), '/', '%2F')
  WHEN 2 THEN 'https://s.example/' || s_suppkey WHEN 3 THEN 'https://s.example/' || s_suppkey END AS href FROM supplier""")
def card_actions(spark, sf_dir: str) -> DataFrame:
    """The one button of a supplier's card: call, apply, website, directions, or none."""
    k = F.col("s_suppkey")
    kind = k % 5
    city = F.when(F.col("s_nationkey") % 2 == 0, "Town, AL").otherwise("Town")
    place = F.when(kind == 1, V.directions_link("https://maps.example/?to=", said(k, " Main St #2 (rear)"), city, F.lit("30303"), "GA"))
    phone = F.when(kind == 0, said("(404) 555-", F.lpad((k % 10000).cast("string"), 4, "0")))
    site = F.when(kind.isin(0, 2, 3), said("https://s.example/", k))
    act = V.main_action(phone, site, place, F.concat_ws(" ", "s_name", F.when(kind == 3, "You can apply here.")))
    return table(spark, sf_dir, "supplier").select(k, act.alias("a")).select("s_suppkey", "a.action", "a.href")


@query("""WITH l AS (SELECT l_orderkey AS plan, l_returnflag AS f, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity::INT, l_returnflag) AS i FROM lineitem)
SELECT plan, 'A suggestion.' || chr(10) || 'Plan ' || plan || chr(10) || string_agg(i || '. Step ' || q || '. Do it.' || CASE WHEN f = 'R' THEN chr(10) || 'Your paper says: "line ' || q || '"' ELSE '' END, chr(10) ORDER BY i) || CASE WHEN plan % 3 = 0 THEN chr(10) || 'This needs a person too: ask ' || plan ELSE '' END AS spoken,
  count(*) FILTER (WHERE f = 'R') = 0 AS paid_voice FROM l GROUP BY plan""")
def spoken_plans(spark, sf_dir: str) -> DataFrame:
    """A plan as it is read aloud, and whether a voice that may only read the plan's own text may read it."""
    quotes = F.when(F.col("l_returnflag") == "R", F.array(said("line ", F.col("q")))).otherwise(F.array().cast("array<string>"))
    step = F.struct("l_linenumber", "l_partkey", "l_suppkey", "q", "l_returnflag", said("Step ", F.col("q")).alias("title"), F.lit("Do it.").alias("action"), quotes.alias("quotes"))
    plans = table(spark, sf_dir, "lineitem").withColumn("q", F.col("l_quantity").cast("int")).groupBy(F.col("l_orderkey").alias("plan")).agg(F.sort_array(F.collect_list(step)).alias("steps"))
    reason = F.when(F.col("plan") % 3 < 2, said(" ask ", F.col("plan"))).otherwise(" ")
    text = lambda steps: F.array_join(V.plan_lines(F.lit("A suggestion."), said("Plan ", F.col("plan")), steps, F.col("plan") % 3 != 1, reason), "\n")
    return plans.select("plan", text(F.col("steps")).alias("spoken"), text(V.without_quotes(F.col("steps"))).alias("own")).select("plan", "spoken", (F.col("spoken") == F.col("own")).alias("paid_voice"))


@query(f"""SELECT {KEY}, CASE WHEN kind % 4 = 0 OR kind % 3 = 0 THEN NULL WHEN n % 2 = 0 THEN 'What of item ' || q || '?' WHEN kind % 5 = 0 THEN NULL WHEN kind % 5 = 1 THEN 'My paper says: "Take ' || q || ' now" Can you confirm what I should take?' ELSE 'My paper says: "Take ' || q || ' now" Can you help me understand what I should do?' END AS own,
  CASE WHEN kind % 3 = 0 THEN 'What of item ' || q || '?,' ELSE '' END || 'Is ' || m || ' enough?' AS general FROM ({LINE})""")
def visit_questions(spark, sf_dir: str) -> DataFrame:
    """A step's own question for the next visit, and the general ones that no step asks."""
    q, n, m, kind = F.col("q"), F.col("n"), F.col("m"), F.col("kind")
    own = F.when(kind % 3 > 0, said("What of item ", q, "?")).otherwise(" ")
    asked = V.step_question(either(kind % 5, F.lit("warning_sign"), F.lit("medication"), F.lit("diet"), F.lit("visit"), F.lit(None).cast("string")), said(" Take ", q, "\n now"), kind % 4 > 0, own, F.when(n % 2 == 0, "certified").otherwise("flagged"))
    general = V.general_questions(F.array(said("what of ITEM ", q), said("What of item ", q, "?"), F.lit(" ?! "), said("Is ", m, " enough?")), F.array(own))
    general = F.when(kind % 3 == 0, F.array_remove(general, said("what of ITEM ", q))).otherwise(general)
    return lines(spark, sf_dir).select(*KEYS, asked.alias("own"), F.array_join(general, ",").alias("general"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '' WHEN coalesce(n, 0) = 0 THEN 'every instruction is in a step' WHEN n = 1 THEN '1 line looks like instructions but is not in a step' ELSE n || ' lines look like instructions but are not in a step' END AS label
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey""")
def missed_line_labels(spark, sf_dir: str) -> DataFrame:
    """What is announced of lines that no step covers (returned ones stand in); nothing where the section is hidden."""
    n = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, sf_dir, "orders").join(n, "o_orderkey", "left")
    return o.select("o_orderkey", V.missed_lines_label(F.col("o_orderstatus") != "P", F.coalesce("n", F.lit(0))).alias("label"))


_AREA = "(c_custkey * 7919 % 1000)"


@query(f"""WITH c AS (SELECT c_custkey, lpad({_AREA}::VARCHAR, 3, '0') AS area, lpad((c_custkey * 104729 % 1000)::VARCHAR, 3, '0') AS exch, lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS rest FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 OR left(area, 1) < '2' OR left(exch, 1) < '2' OR right(area, 2) = '11' OR right(exch, 2) = '11' OR area IN ('900', '976', '800', '833', '844', '855', '866', '877', '888') OR exch IN ('900', '976') OR (exch = '555' AND left(rest, 2) = '01') THEN NULL ELSE '+1' || area || exch || rest END AS number,
  right(rest, 4) AS last4 FROM c""")
def callable_numbers(spark, sf_dir: str) -> DataFrame:
    """Phone numbers in four spellings as +1 and ten digits, or null where they may not be called."""
    pad = lambda c, n: F.lpad(c.cast("string"), n, "0")
    k = F.col("c_custkey")
    area, exch, rest = pad(k * 7919 % 1000, 3), pad(k * 104729 % 1000, 3), pad(k % 10000, 4)
    raw = either(k, said("(", area, ") ", exch, "-", rest), said(" +1 ", area, ".", exch, ".", rest), said("1", area, exch, rest), said("+44 ", area, exch, rest))
    return table(spark, sf_dir, "customer").select(k, V.us_phone(raw).alias("number"), V.public_call(F.lit("calling"), raw, F.lit(0), 3)["last4"].alias("last4"))


@query("""WITH e AS (SELECT event_id, user_id, CASE event_type WHEN 'error' THEN 'failed_sent' WHEN 'view' THEN 'not_sent' ELSE 'done' END AS outcome, 20 AS reserved, (floor(value)::INT % 50)::INT AS heard FROM events),
c AS (SELECT *, CASE outcome WHEN 'not_sent' THEN -reserved ELSE heard - reserved END AS site, CASE WHEN outcome = 'done' THEN heard - reserved + CASE WHEN heard > 35 THEN 600 ELSE 0 END ELSE 0 END AS client FROM e)
SELECT user_id, sum(site)::BIGINT AS site, sum(client)::BIGINT AS client FROM c GROUP BY user_id""")
def settled_budgets(spark, sf_dir: str) -> DataFrame:
    """What reservations change by when their calls end: who pays for what was heard, for failures and for overruns."""
    outcome = F.when(F.col("event_type") == "error", "failed_sent").when(F.col("event_type") == "view", "not_sent").otherwise("done")
    heard = F.floor("value").cast("int") % 50
    c = V.budget_changes(outcome, F.lit(20), heard, F.lit(600), 35)
    return table(spark, sf_dir, "events").select("user_id", c.alias("c")).groupBy("user_id").agg(F.sum("c.site").alias("site"), F.sum("c.client").alias("client"))
