"""Usage analytics over the events table.

The events of the test data stand in for usage events: kind is event_type, ms is value, the language is
``props.k % 7`` and production events are those that are no errors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.operators import quantiles, suppression
from quillstone.plans.registry import query
from quillstone.session import table
from quillstone.streaming import quotas, sessions


def production(spark, sf_dir: str) -> DataFrame:
    """Scan with the constant predicate pushed to Parquet, enums as columns."""
    return table(spark, sf_dir, "events").where("event_type <> 'error'")


LIVE_STATS = """
SELECT count(*) FILTER (WHERE event_type = 'view') AS views,
       count(*) FILTER (WHERE event_type = 'click') AS clicks,
       count(*) FILTER (WHERE event_type = 'purchase') AS purchases,
       count(*) FILTER (WHERE event_type = 'signup') AS signups,
       round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value) FILTER (WHERE event_type = 'view'), 6) AS median_view,
       round(percentile_cont(0.5) WITHIN GROUP (ORDER BY value) FILTER (WHERE event_type = 'purchase'), 6) AS median_purchase,
       round(sum(value) FILTER (WHERE event_type = 'purchase') / nullif(sum(value) FILTER (WHERE event_type IN ('purchase', 'click')), 0), 6) AS purchase_share,
       round(avg(value) FILTER (WHERE event_type = 'signup'), 6) AS avg_signup,
       min(ts) AS since
FROM events WHERE event_type <> 'error'
"""


@query(LIVE_STATS)
def live_stats(spark, sf_dir: str) -> DataFrame:
    """Filtered counts, exact medians, a guarded ratio, a filtered mean and the first timestamp."""
    e = production(spark, sf_dir)
    is_ = lambda *k: F.col("event_type").isin(*k)
    value = lambda *k: F.when(is_(*k), F.col("value"))
    whole = F.sum(value("purchase", "click"))
    middle = quantiles.medians(e.where(is_("view", "purchase")), "event_type", "value")
    middle = middle.agg(*[F.round(F.max(F.when(is_(k), F.col("median"))), 6).alias(f"median_{k}") for k in ("view", "purchase")])  # one row
    return e.agg(
        F.count_if(is_("view")).alias("views"),
        F.count_if(is_("click")).alias("clicks"),
        F.count_if(is_("purchase")).alias("purchases"),
        F.count_if(is_("signup")).alias("signups"),
        F.round(F.sum(value("purchase")) / F.when(whole != 0, whole), 6).alias("purchase_share"),
        F.round(F.avg(value("signup")), 6).alias("avg_signup"),
        F.min("ts").alias("since"),
    ).join(F.broadcast(middle))


def language(c: str = "props"):
    """The events' language: props.k % 7 as a code."""
    return F.concat(F.lit("l"), (F.get_json_object(c, "$.k").cast("int") % 7).cast("string"))


LANG = "'l' || (json_extract_string(props, '$.k')::INT % 7)"
PROD = f"(SELECT *, {LANG} AS lang FROM events WHERE event_type <> 'error')"
COUNTS = f"""SELECT lang, count(*) FILTER (WHERE event_type = 'purchase' AND ts >= now7) AS helper_7d, count(*) FILTER (WHERE ts >= now7) AS all_7d,
  count(*) FILTER (WHERE event_type = 'purchase') AS helper_all, count(*) AS all_all
FROM {PROD}, (SELECT max(ts) - INTERVAL 7 DAY AS now7 FROM events) GROUP BY lang"""


def funnel_counts(spark, sf_dir: str) -> DataFrame:
    """Two populations in two windows by language, one pass; now is the table's last timestamp."""
    now = table(spark, sf_dir, "events").agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("now7"))  # one row
    e = production(spark, sf_dir).join(F.broadcast(now)).withColumn("lang", language())
    recent, helper = F.col("ts") >= F.col("now7"), F.col("event_type") == "purchase"
    return e.groupBy("lang").agg(
        F.count_if(helper & recent).alias("helper_7d"), F.count_if(recent).alias("all_7d"), F.count_if(helper).alias("helper_all"), F.count(F.lit(1)).alias("all_all")
    )


query(COUNTS, "usage_funnel")(funnel_counts)


@query(f"""SELECT 'kind' AS dimension, event_type AS name, count(*) AS n FROM {PROD} GROUP BY event_type
UNION ALL SELECT 'language', lang, count(*) FROM {PROD} GROUP BY lang""")
def usage_breakdowns(spark, sf_dir: str) -> DataFrame:
    """Counts by kind and by language from one scan."""
    e = production(spark, sf_dir).withColumn("lang", language())
    sets = e.groupingSets([["event_type"], ["lang"]], "event_type", "lang").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    by_kind = F.col("g") == 1
    return sets.select(F.when(by_kind, "kind").otherwise("language").alias("dimension"), F.when(by_kind, F.col("event_type")).otherwise(F.col("lang")).alias("name"), "n")


@query(f"""WITH c AS (SELECT event_type || ' ' || user_id AS grp, count(*) AS n FROM events GROUP BY 1)
SELECT CASE WHEN n >= 10 THEN grp ELSE 'Other languages' END AS grp, sum(n)::BIGINT AS n FROM c GROUP BY 1""")
def folded_groups(spark, sf_dir: str) -> DataFrame:
    """Small groups folded into one."""
    e = table(spark, sf_dir, "events")
    counts = e.groupBy(F.concat(F.col("event_type"), F.lit(" "), F.col("user_id").cast("string")).alias("grp")).agg(F.count(F.lit(1)).alias("n"))
    return suppression.folded(counts, "grp", "n")


@query("""WITH c AS (SELECT floor(value)::INT::VARCHAR AS name, count(*) AS n FROM events GROUP BY 1),
f AS (SELECT sum(n) AS whole, sum(n) FILTER (WHERE n < 10) AS small, min({'n': n, 'name': name}) FILTER (WHERE n >= 10) AS least FROM c)
SELECT name, CASE WHEN n < 10 THEN '<10' WHEN whole >= 10 AND small < 10 AND least = {'n': n, 'name': name} THEN 'hidden' ELSE n::VARCHAR END AS cell FROM c, f""")
def suppressed_breakdown(spark, sf_dir: str) -> DataFrame:
    """A breakdown with small counts masked and complementary suppression."""
    counts = table(spark, sf_dir, "events").groupBy(F.floor("value").cast("int").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return suppression.breakdown(counts, "name", "n")


@query()
def suppressed_funnel(spark, sf_dir: str) -> DataFrame:
    """The funnel with primary and complementary suppression to a fixpoint, and its total."""
    return suppression.suppressed_funnel(funnel_counts(spark, sf_dir), "lang")


@query(f"""SELECT lang, CASE WHEN count(*) >= 10 THEN round(avg(value), 6) END AS avg_value, CASE WHEN count(*) < 10 THEN '<10' ELSE count(*)::VARCHAR END AS n FROM {PROD} GROUP BY lang""")
def supported_averages(spark, sf_dir: str) -> DataFrame:
    """Averages that rest on enough rows, counts masked if small."""
    e = production(spark, sf_dir).groupBy(language().alias("lang")).agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("c"))
    return e.select("lang", suppression.supported(F.col("c"), F.round("v", 6)).alias("avg_value"), suppression.shown(F.col("c")).alias("n"))


RULES = {"bad_kind": "event_type NOT IN ('view', 'click', 'purchase', 'signup')", "bad_value": "NOT (value BETWEEN 0 AND 40)", "bad_user": "user_id IS NULL OR user_id < 0"}


@query(f"SELECT coalesce(CASE {' '.join(f'WHEN {c} THEN {chr(39)}{r}{chr(39)}' for r, c in RULES.items())} END, 'kept') AS reason, count(*) AS n FROM events GROUP BY 1")
def event_drop_reasons(spark, sf_dir: str) -> DataFrame:
    """The first rule that a row breaks, counted: ordered drop reasons in one pass."""
    reason = F.coalesce(*[F.when(F.expr(c), r) for r, c in RULES.items()], F.lit("kept"))
    return table(spark, sf_dir, "events").groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT event_id, array_to_string(list_filter([{', '.join(f'CASE WHEN {c} THEN {chr(39)}{r}{chr(39)} END' for r, c in RULES.items())}], lambda x: x IS NOT NULL), ',') AS reasons FROM events WHERE {' OR '.join(f'({c})' for c in RULES.values())}")
def rejected_events(spark, sf_dir: str) -> DataFrame:
    """Rows that break a constraint with every reason."""
    reasons = F.array_compact(F.array(*[F.when(F.expr(c), F.lit(r)) for r, c in RULES.items()]))
    return table(spark, sf_dir, "events").where(F.size(reasons) > 0).select("event_id", F.array_join(reasons, ",").alias("reasons"))


@query("SELECT event_id, row_number() OVER (PARTITION BY ts::DATE, user_id % 50 ORDER BY ts, event_id) > 4 AS over_limit FROM events")
def daily_quota(spark, sf_dir: str) -> DataFrame:
    """Fixed-window quota: every use of a bucket's day beyond the limit is over it."""
    w = Window.partitionBy(F.to_date("ts"), F.col("user_id") % 50).orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", (F.row_number().over(w) > 4).alias("over_limit"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, floor(epoch(ts) / 3600)::BIGINT AS hour, greatest(1, 86400 - floor(epoch(ts))::BIGINT % 86400) AS seconds_left FROM events")
def time_buckets(spark, sf_dir: str) -> DataFrame:
    """UTC day and hour keys, and the seconds to the next UTC midnight."""
    s = F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)")
    return table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.floor(s / 3600).alias("hour"), F.greatest(F.lit(1).cast("long"), 86400 - s % 86400).alias("seconds_left"))


@query("SELECT event_id, user_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1")
def first_use_of_nonce(spark, sf_dir: str) -> DataFrame:
    """A one-time key is good once: its first row wins."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("event_id", "user_id", "ts")


@query("""SELECT user_id, arg_max(event_type, {'r': CASE event_type WHEN 'purchase' THEN 4 WHEN 'signup' THEN 3 WHEN 'click' THEN 2 WHEN 'view' THEN 1 ELSE 0 END, 'e': event_id}) AS status,
  arg_min(event_id, {'t': ts, 'e': event_id}) AS owner FROM events GROUP BY user_id""")
def session_status(spark, sf_dir: str) -> DataFrame:
    """The highest status a session has reached (it never moves back) and the first writer, who owns it."""
    rank = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(i)) for k, i in (("purchase", 4), ("signup", 3), ("click", 2), ("view", 1))], F.lit(0))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct(rank, "event_id")).alias("status"), F.min_by("event_id", F.struct("ts", "event_id")).alias("owner"))


@query("SELECT user_id, max(ts) AS last_seen, count(*) AS n FROM events GROUP BY user_id HAVING max(ts) < (SELECT max(ts) - INTERVAL 2 DAY FROM events)")
def expired_sessions(spark, sf_dir: str) -> DataFrame:
    """Sessions whose time to live has passed at the table's last timestamp."""
    e = table(spark, sf_dir, "events")
    now = e.agg((F.max("ts") - F.expr("INTERVAL 2 DAYS")).alias("cut"))
    last = e.groupBy("user_id").agg(F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("n"))
    return last.join(F.broadcast(now)).where("last_seen < cut").select("user_id", "last_seen", "n")


@query()
def sliding_rate_limit(spark, sf_dir: str) -> DataFrame:
    """Accepted or refused per event: at most 3 accepted ones of a user in any 10 hours; refused ones do not count."""
    return quotas.sliding_limit(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", 3, 36_000)


@query()
def ttl_counter(spark, sf_dir: str) -> DataFrame:
    """A counter whose window restarts when it has run out, with a cap."""
    return quotas.ttl_counter(table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", 2, 86_400)


KINDS = {"signup": "start", "click": "attempt", "view": "ringing", "purchase": "talking", "error": "failed"}


@query()
def call_sessions(spark, sf_dir: str) -> DataFrame:
    """Every event of a session through its state machine: what was applied and what was refused, and why."""
    e = table(spark, sf_dir, "events")
    kind = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in KINDS.items()], F.lit("other"))
    return sessions.sessions(e.select("user_id", "event_id", "ts", kind.alias("kind")), "user_id")


@query(f"""WITH s AS (SELECT user_id, event_type, event_id, (epoch_ms(ts) // 60000)::BIGINT AS s, (epoch_ms(ts) // 60000 + value::INT * 10)::BIGINT AS e FROM events)
SELECT user_id, count(*) AS expected, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM s f WHERE f.user_id = a.user_id AND f.event_type = 'view' AND f.s < a.e AND f.e > a.s)) AS found
FROM s a WHERE event_type = 'purchase' GROUP BY user_id""")
def answer_recall(spark, sf_dir: str) -> DataFrame:
    """Spans of an answer key and how many of them some found span overlaps."""
    from quillstone.operators import intervals
    from quillstone.plans.relational import spans

    s = spans(spark, sf_dir)
    key = s.where("event_type = 'purchase'").select("user_id", "event_id", "start", "end")
    found = s.where("event_type = 'view'").select("user_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    hit = intervals.overlapping(key, found, "user_id").select("event_id").distinct().withColumn("hit", F.lit(True))
    return key.join(hit, "event_id", "left").groupBy("user_id").agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.coalesce("hit", F.lit(False))).alias("found"))
