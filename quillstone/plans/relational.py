"""Joins, windows, ranking, set operations and geographic look-ups over the star schema.

Suppliers stand in for sites, customers for people, parts for resources; coordinates are fixed arithmetic on keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions.geo import KM_SQL, km
from quillstone.operators import intervals, nearest
from quillstone.plans.registry import query
from quillstone.session import table


def sites(spark, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", (30 + k * 7919 % 6000 / 1000.0).alias("p_lat"), (-90 + k * 104729 % 9000 / 1000.0).alias("p_lng"))


def people(spark, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", (30 + k * 6101 % 6000 / 1000.0).alias("lat"), (-90 + k * 75533 % 9000 / 1000.0).alias("lng"))


SITES = "(SELECT s_suppkey, 30 + (s_suppkey * 7919 % 6000) / 1000.0::DOUBLE AS lat, -90 + (s_suppkey * 104729 % 9000) / 1000.0::DOUBLE AS lng FROM supplier)"
PEOPLE = "(SELECT c_custkey, 30 + (c_custkey * 6101 % 6000) / 1000.0::DOUBLE AS lat, -90 + (c_custkey * 75533 % 9000) / 1000.0::DOUBLE AS lng FROM customer)"
KM = KM_SQL.format("p", "s")


@query(f"""SELECT c_custkey, s_suppkey, rank, km FROM (
  SELECT c_custkey, s_suppkey, round({KM}, 6) AS km, row_number() OVER (PARTITION BY c_custkey ORDER BY {KM}, s_suppkey)::INT AS rank
  FROM {PEOPLE} p, {SITES} s WHERE abs(p.lat - s.lat) <= 1 AND abs(p.lng - s.lng) <= 1.5 AND {KM} <= 60) WHERE rank <= 4""")
def nearest_sites(spark, sf_dir: str) -> DataFrame:
    """The 4 nearest sites within 60 km of everybody, box and grid cells before the exact distance."""
    found = nearest.k_nearest(people(spark, sf_dir), "c_custkey", sites(spark, sf_dir), "s_suppkey", 4, 60.0)
    return found.select("c_custkey", "s_suppkey", "rank", F.round("km", 6).alias("km"))


@query(f"""SELECT s_suppkey, round(km, 6) AS km FROM (SELECT s_suppkey, 12742.0 * asin(sqrt(pow(sin(radians(33.0 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(33.0)) * pow(sin(radians(-85.0 - lng) / 2), 2))) AS km FROM {SITES}) WHERE km <= 400""")
def sites_around(spark, sf_dir: str) -> DataFrame:
    """Sites within 400 km of one point: a filter on the distance."""
    s = sites(spark, sf_dir)
    return s.withColumn("km", km(F.col("p_lat"), F.col("p_lng"), F.lit(33.0), F.lit(-85.0))).where("km <= 400").select("s_suppkey", F.round("km", 6).alias("km"))


@query(f"""SELECT c_custkey, arg_min(s_suppkey, {{'m': m, 's': s_suppkey}}) AS s_suppkey, min(m) AS metres FROM (
  SELECT c_custkey, s_suppkey, round(2 * 6371008.8 * asin(sqrt(pow(sin(radians(s.lat - p.lat) / 2), 2) + cos(radians(p.lat)) * cos(radians(s.lat)) * pow(sin(radians(s.lng - p.lng) / 2), 2)))) AS m
  FROM {PEOPLE} p, {SITES} s) GROUP BY c_custkey""")
def nearest_stop(spark, sf_dir: str) -> DataFrame:
    """The nearest site of everybody in whole metres, at any distance."""
    return nearest.nearest_place(people(spark, sf_dir), "c_custkey", sites(spark, sf_dir), "s_suppkey")


@query(f"SELECT c_custkey, CASE WHEN lat BETWEEN 33 AND 34.5 AND lng BETWEEN -85 AND -83.5 THEN 'metro' WHEN lat < 35 AND lng > -85.6 THEN 'state' ELSE 'country' END AS region FROM {PEOPLE}")
def regions(spark, sf_dir: str) -> DataFrame:
    """Region rules in order."""
    p = people(spark, sf_dir)
    metro = F.col("lat").between(33, 34.5) & F.col("lng").between(-85, -83.5)
    return p.select("c_custkey", F.when(metro, "metro").when((F.col("lat") < 35) & (F.col("lng") > -85.6), "state").otherwise("country").alias("region"))


@query("SELECT DISTINCT l_suppkey, o_orderpriority FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def served_priorities(spark, sf_dir: str) -> DataFrame:
    """Distinct pairs of two joined tables, de-duplicated before and after the join."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").dropDuplicates()  # noqa: E741
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return l.join(o, "l_orderkey").select("l_suppkey", "o_orderpriority").distinct()


@query("SELECT n_name, count(*) AS n, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def customers_by_nation(spark, sf_dir: str) -> DataFrame:
    """Inner equi-join with a dimension, aggregated; the optimizer broadcasts the dimension by its size."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query("SELECT p_partkey, p_name FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)")
def returned_parts(spark, sf_dir: str) -> DataFrame:
    """Left semi join."""
    l = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity > 45")  # noqa: E741
    p = table(spark, sf_dir, "part")
    return p.join(l, p.p_partkey == l.l_partkey, "left_semi").select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def customers_without_finished(spark, sf_dir: str) -> DataFrame:
    """Left anti join, also the guard of an insert that must not repeat."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    c = table(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey, "left_anti").select("c_custkey", "c_name")


@query("""SELECT p_partkey, coalesce(a.q, b.q) AS quantity, CASE WHEN a.q IS NOT NULL THEN 'first' WHEN b.q IS NOT NULL THEN 'second' END AS origin
FROM part LEFT JOIN (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' AND l_shipdate >= '2001-01-01' GROUP BY 1) a ON a.l_partkey = p_partkey
LEFT JOIN (SELECT l_partkey, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) b ON b.l_partkey = p_partkey""")
def preferred_source(spark, sf_dir: str) -> DataFrame:
    """Two left joins, the first source before the second."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    a = l.where("l_returnflag = 'A' AND l_shipdate >= TIMESTAMP_NTZ '2001-01-01'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("qa"))
    b = l.where("l_returnflag = 'N'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("l_quantity").alias("qb"))
    p = table(spark, sf_dir, "part").select("p_partkey").join(a, "p_partkey", "left").join(b, "p_partkey", "left")
    return p.select("p_partkey", F.coalesce("qa", "qb").alias("quantity"), F.when(F.col("qa").isNotNull(), "first").when(F.col("qb").isNotNull(), "second").alias("origin"))


@query("""SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON starts_with(CAST(s_suppkey AS VARCHAR), CAST(n_nationkey AS VARCHAR)) AND regexp_matches(lower(n_name), 'a') AND NOT regexp_matches(n_name, 'IND')""")
def fuzzy_identity(spark, sf_dir: str) -> DataFrame:
    """Theta join: number prefix, a term in the name, and an exclusion; the dimension side is a fixed small table."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    same = F.startswith(F.col("s_suppkey").cast("string"), F.col("n_nationkey").cast("string")) & F.lower("n_name").contains("a") & ~F.col("n_name").contains("IND")
    return s.join(n, same).select("s_suppkey", "n_nationkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey, l_suppkey) IN (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_discount = 0.1 AND l_tax = 0.08)")
def row_value_semi_join(spark, sf_dir: str) -> DataFrame:
    """Semi join on two keys."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    some = l.where("l_discount = 0.1 AND l_tax = 0.08").select("l_partkey", "l_suppkey")
    return l.join(some, ["l_partkey", "l_suppkey"], "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, CASE WHEN q IS NULL THEN o_totalprice ELSE greatest(0, round(o_totalprice - q * 1000, 2)) END AS price FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def settled_prices(spark, sf_dir: str) -> DataFrame:
    """Update from another table, never below zero."""
    r = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    o = table(spark, sf_dir, "orders").join(r, "o_orderkey", "left")
    return o.select("o_orderkey", F.when(F.col("q").isNull(), F.col("o_totalprice")).otherwise(F.greatest(F.lit(0.0), F.round(F.col("o_totalprice") - F.col("q") * 1000, 2))).alias("price"))


@query("SELECT d.doc_id, coalesce(CASE toxic WHEN 1 THEN 'flagged' WHEN 0 THEN 'clear' END, 'unclear') AS verdict FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def verdicts(spark, sf_dir: str) -> DataFrame:
    """Look-up by id with a default when the verdict is missing."""
    d = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return d.select("doc_id", F.when(F.col("toxic") == 1, "flagged").when(F.col("toxic") == 0, "clear").otherwise("unclear").alias("verdict"))


SPANS = "SELECT user_id, (epoch_ms(ts) // 60000)::BIGINT AS s, (epoch_ms(ts) // 60000 + value::INT * 10)::BIGINT AS e FROM events"


def spans(spark, sf_dir: str) -> DataFrame:
    minute = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts) div 60000000")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", minute.alias("start"), (minute + F.rint("value").cast("int") * 10).alias("end"))


@query(f"""WITH s AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ({SPANS})),
i AS (SELECT *, sum(CASE WHEN m IS NULL OR s > m THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM s)
SELECT user_id, min(s) AS "start", max(e) AS "end" FROM i GROUP BY user_id, island""")
def merged_intervals(spark, sf_dir: str) -> DataFrame:
    """Touching intervals of a key joined into one."""
    return intervals.merged(spans(spark, sf_dir).select("user_id", "start", "end"), "user_id")


@query(f"""SELECT a.user_id, count(*) AS n FROM ({SPANS}) a JOIN ({SPANS}) b ON a.user_id = b.user_id AND a.s < b.e AND a.e > b.s GROUP BY a.user_id""")
def overlapping_intervals(spark, sf_dir: str) -> DataFrame:
    """Interval-overlap join inside a key."""
    left = spans(spark, sf_dir).drop("event_id", "event_type")
    right = spans(spark, sf_dir).select("user_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    return intervals.overlapping(left, right, "user_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, rn > 1 AS superseded FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderstatus = 'P')::INT DESC, o_orderdate DESC NULLS LAST, o_totalprice DESC, o_orderkey) AS rn FROM orders)")
def one_live_per_key(spark, sf_dir: str) -> DataFrame:
    """One live row a key: the others are superseded."""
    w = Window.partitionBy("o_custkey").orderBy((F.col("o_orderstatus") == "P").cast("int").desc(), F.col("o_orderdate").desc_nulls_last(), F.col("o_totalprice").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.row_number().over(w) > 1).alias("superseded"))


@query("SELECT o_custkey, o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) = 1")
def latest_wins(spark, sf_dir: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy("o_custkey", "o_orderpriority").orderBy(F.col("o_orderdate").desc(), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("o_custkey", "o_orderpriority", "o_orderkey")


@query("""WITH r AS (SELECT user_id, event_type, event_id, CASE WHEN event_type IS DISTINCT FROM lag(event_type) OVER w THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM r)
SELECT user_id, run::BIGINT AS run, any_value(event_type) AS event_type, count(*) AS n FROM g GROUP BY user_id, run""")
def runs_of_equal(spark, sf_dir: str) -> DataFrame:
    """Run-length groups of equal neighbours: gaps and islands."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    new = (~F.col("event_type").eqNullSafe(F.lag("event_type").over(w)) | F.lag("event_id").over(w).isNull()).cast("int")
    runs = table(spark, sf_dir, "events").withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("user_id", "run").agg(F.first("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first_doc FROM documents")
def first_of_equal_text(spark, sf_dir: str) -> DataFrame:
    """The first row with the same text; texts meet as digests, aggregated before the shuffle."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    first = d.groupBy("h").agg(F.min("doc_id").alias("first_doc"))
    return d.join(first, F.expr("true") & d.h.eqNullSafe(first.h)).select("doc_id", "first_doc")


@query("SELECT l_partkey, count(DISTINCT l_suppkey) AS barriers, count(*) AS steps, round(min(l_extendedprice), 2) AS km, row_number() OVER (ORDER BY count(DISTINCT l_suppkey) DESC, count(*) DESC, min(l_extendedprice) NULLS LAST, l_partkey)::INT AS place FROM lineitem GROUP BY l_partkey QUALIFY place <= 20")
def ranked_resources(spark, sf_dir: str) -> DataFrame:
    """Ranking by four keys, the first 20."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count_distinct("l_suppkey").alias("barriers"), F.count(F.lit(1)).alias("steps"), F.min("l_extendedprice").alias("km"))
    order = [F.col("barriers").desc(), F.col("steps").desc(), F.col("km").asc_nulls_last(), F.col("l_partkey").asc()]
    best = g.orderBy(*order).limit(20)  # a top-k, so the ranking window sees 20 rows
    return best.select("l_partkey", "barriers", "steps", F.round("km", 2).alias("km"), F.row_number().over(Window.orderBy(*order)).alias("place"))


@query("""WITH u AS (SELECT c_custkey AS id, lower(trim(c_mktsegment)) AS name, c_nationkey AS zip, c_acctbal AS far, 0 AS src FROM customer UNION ALL SELECT s_suppkey, 'machinery', s_nationkey, s_acctbal, 1 FROM supplier),
d AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY name, zip ORDER BY far, src, id) = 1)
SELECT zip, name, id, far FROM d QUALIFY row_number() OVER (PARTITION BY zip ORDER BY far, src, id) <= 4""")
def merged_ranked_lists(spark, sf_dir: str) -> DataFrame:
    """Two ranked lists together, one of each name and place, the nearest four."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lower(F.trim("c_mktsegment")).alias("name"), F.col("c_nationkey").alias("zip"), F.col("c_acctbal").alias("far"), F.lit(0).alias("src"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("machinery").alias("name"), F.col("s_nationkey").alias("zip"), F.col("s_acctbal").alias("far"), F.lit(1).alias("src"))
    one = Window.partitionBy("name", "zip").orderBy("far", "src", "id")
    top = Window.partitionBy("zip").orderBy("far", "src", "id")
    u = c.unionByName(s).withColumn("rn", F.row_number().over(one)).where("rn = 1")
    return u.withColumn("rn", F.row_number().over(top)).where("rn <= 4").select("zip", "name", "id", "far")


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority = '1-URGENT' ORDER BY o_orderkey) AS rn FROM orders) WHERE o_orderpriority = '1-URGENT' OR rn <= 3")
def two_tier_cap(spark, sf_dir: str) -> DataFrame:
    """All critical rows and the first three others of a key."""
    urgent = F.col("o_orderpriority") == "1-URGENT"
    w = Window.partitionBy("o_custkey", urgent).orderBy("o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("rn", F.row_number().over(w)).where(urgent | (F.col("rn") <= 3)).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem")
def difference(spark, sf_dir: str) -> DataFrame:
    """Keys of one list that the other lacks."""
    o = table(spark, sf_dir, "orders").select("o_orderkey").distinct()
    return o.join(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS done, count(*) AS total, bool_or(event_type = 'error') AS has_error, round(median(value)) AS mid, sum(least(greatest(value, 1), 20)::INT)::BIGINT AS minutes FROM events GROUP BY user_id")
def progress(spark, sf_dir: str) -> DataFrame:
    """Progress, an or-aggregate, a rounded median and a sum of clamped values by key."""
    clamped = F.rint(F.least(F.greatest("value", F.lit(1.0)), F.lit(20.0))).cast("int")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("done"), F.count(F.lit(1)).alias("total"), F.bool_or(F.col("event_type") == "error").alias("has_error"), F.round(F.percentile("value", 0.5)).alias("mid"), F.sum(clamped).alias("minutes")
    )


@query("SELECT coalesce(toxic, -1) AS toxic, coalesce(quality, -1) AS quality, count(*) AS n FROM labels GROUP BY GROUPING SETS ((toxic, quality), ())")
def totals(spark, sf_dir: str) -> DataFrame:
    """Groups and the total row in one aggregation."""
    sets = table(spark, sf_dir, "labels").groupingSets([["toxic", "quality"], []], "toxic", "quality").agg(F.count(F.lit(1)).alias("n"))
    return sets.select(F.coalesce("toxic", F.lit(-1)).alias("toxic"), F.coalesce("quality", F.lit(-1)).alias("quality"), "n")
