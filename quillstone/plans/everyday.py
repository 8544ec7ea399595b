"""Field rules, array rules, look-ups and orders that plans and views need, each with SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import fields as R
from quillstone.functions import text as T
from quillstone.plans.registry import query
from quillstone.session import dealt, table, written

DAY = "(extract(isodow FROM o_orderdate) - 1)::INT"
PERIODS = f"SELECT o_custkey, {DAY} AS day, lpad((o_orderkey % 14 + 6)::VARCHAR, 2, '0') || ':00' AS open, lpad((o_orderkey % 14 + 9)::VARCHAR, 2, '0') || ':30' AS close FROM orders"


def periods(spark, sf_dir: str) -> DataFrame:
    """customer, hours: opening periods as an array of (day, open, close); orders stand in for them."""
    hour = lambda n, m: F.concat(F.lpad((F.col("o_orderkey") % 14 + n).cast("string"), 2, "0"), F.lit(m))
    o = table(spark, sf_dir, "orders").select("o_custkey", F.struct(F.weekday("o_orderdate").alias("day"), hour(6, ":00").alias("open"), hour(9, ":30").alias("close")).alias("p"))
    return o.groupBy("o_custkey").agg(F.sort_array(F.collect_set("p")).alias("hours"))


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'web' END AS surface, CASE WHEN event_type = 'signup' THEN 'helper' END AS entry, CASE WHEN user_id % 3 = 0 THEN 'simple' WHEN user_id % 3 = 1 THEN 'detailed' ELSE 'standard' END AS level FROM events")
def normalized_fields(spark, sf_dir: str) -> DataFrame:
    """Allow-listed surface, an exact-match entry tag, and a picked value with a default."""
    e = table(spark, sf_dir, "events")
    level = F.element_at(F.array(F.lit("simple"), F.lit("detailed"), F.lit("verbose")), (F.col("user_id") % 3 + 1).cast("int"))
    return e.select("event_id", R.one_of(F.col("event_type"), ["view", "click"], "web").alias("surface"), R.exact(F.when(F.col("event_type") == "signup", "helper").otherwise("Helper"), "helper").alias("entry"), R.one_of(level, ["simple", "detailed"], "standard").alias("level"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax <= l_discount AND l_quantity BETWEEN 1 AND 40")
def consistent_lines(spark, sf_dir: str) -> DataFrame:
    """A rule over several fields of a row: a part is at most its whole."""
    return table(spark, sf_dir, "lineitem").where("l_tax <= l_discount AND l_quantity BETWEEN 1 AND 40").select("l_orderkey", "l_linenumber")


@query("""SELECT 'all' AS stage, count(*) AS n FROM part UNION ALL SELECT 'kept types', count(*) FILTER (WHERE p_size > 5) FROM part
UNION ALL SELECT 'not excluded', count(*) FILTER (WHERE p_size > 5 AND NOT contains(lower(p_name), 'green')) FROM part""")
def staged_counts(spark, sf_dir: str) -> DataFrame:
    """Rows left after each stage of a filter, counted in one pass."""
    return R.staged(table(spark, sf_dir, "part"), {"all": F.lit(True), "kept types": F.col("p_size") > 5, "not excluded": ~F.col("p_name").rlike("(?i)green")})


@query("SELECT p_partkey FROM part WHERE NOT (contains(lower(p_name), 'red') OR contains(lower(p_name), 'blue') OR ends_with(lower(p_type), 'steel'))")
def general_parts(spark, sf_dir: str) -> DataFrame:
    """Names of special fields left out by a pattern."""
    p = table(spark, sf_dir, "part")
    return p.where(~F.col("p_name").rlike("(?i)red|blue") & ~F.col("p_type").rlike("(?i)steel$")).select("p_partkey")


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) AND (o_custkey % 2 = 0 OR bool_or(o_orderstatus = 'O'))")
def matching_programs(spark, sf_dir: str) -> DataFrame:
    """Rows whose list meets the chosen one and whose scope allows it."""
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("barriers"), F.collect_set("o_orderstatus").alias("scopes"))
    chosen = F.array(F.lit("1-URGENT"), F.lit("2-HIGH"))
    return lists.where(F.arrays_overlap("barriers", chosen) & ((F.col("o_custkey") % 2 == 0) | F.array_contains("scopes", "O"))).select("o_custkey")


@query(f"SELECT o_custkey, bool_or(day < 5 AND close > '18:00') AS evenings, bool_or(day >= 5) AS weekends, bool_and(open < close) AS sound FROM ({PERIODS}) GROUP BY o_custkey")
def opening_kinds(spark, sf_dir: str) -> DataFrame:
    """Exists, every and filter over a nested array of opening periods."""
    h = periods(spark, sf_dir)
    return h.select("o_custkey", R.opens_evenings(F.col("hours")).alias("evenings"), R.opens_weekends(F.col("hours")).alias("weekends"), F.forall("hours", lambda p: p["open"] < p["close"]).alias("sound"))


@query(f"""WITH e AS (SELECT event_id, user_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS t FROM events)
SELECT event_id, bool_or(day = extract(isodow FROM t) - 1 AND open <= strftime(t, '%H:%M') AND strftime(t, '%H:%M') < close) AS is_open FROM e LEFT JOIN ({PERIODS}) ON o_custkey = user_id GROUP BY event_id""")
def open_now(spark, sf_dir: str) -> DataFrame:
    """Whether a place is open at a moment in its own time zone; null where no hours are known."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("o_custkey"), "ts").join(periods(spark, sf_dir), "o_custkey", "left")
    return e.select("event_id", R.open_at(F.col("hours"), F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.col("ts"))).alias("is_open"))


@query(f"""WITH p AS (SELECT DISTINCT * FROM ({PERIODS})), d AS (SELECT o_custkey, day, string_agg(replace(ltrim(open, '0'), ':00', '') || 'h-' || ltrim(close, '0') || 'h', ', ' ORDER BY open, close) AS h FROM p GROUP BY ALL),
r AS (SELECT *, day - row_number() OVER (PARTITION BY o_custkey, h ORDER BY day) AS run FROM d), g AS (SELECT o_custkey, min(day) AS a, max(day) AS b, any_value(h) AS h FROM r GROUP BY o_custkey, h, run),
n AS (SELECT ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'] AS name)
SELECT o_custkey, string_agg(name[a + 1] || CASE WHEN b > a THEN '-' || name[b + 1] ELSE '' END || ' ' || h, ', ' ORDER BY a) AS shown FROM g, n GROUP BY o_custkey""")
def formatted_hours(spark, sf_dir: str) -> DataFrame:
    """Runs of days with the same hours as one text a place."""
    plain = lambda t: F.concat(F.regexp_replace(F.ltrim(t, F.lit("0")), ":00$", ""), F.lit("h"))
    return periods(spark, sf_dir).select("o_custkey", R.format_hours(F.col("hours"), plain).alias("shown"))


@query("""WITH k AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 25)
SELECT o_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (WHERE l_orderkey IS NOT NULL), '') AS kept,
  coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey) FILTER (WHERE l_orderkey IS NULL), '') AS dropped FROM orders LEFT JOIN k ON l_orderkey = o_orderkey GROUP BY o_custkey""")
def known_references(spark, sf_dir: str) -> DataFrame:
    """Ids of an array that are known stay in order, unknown ones are named; one shuffled look-up, no broadcast."""
    ids = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("id"))
    known = table(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("id"), F.lit(True).alias("known")).distinct()
    listed = ids.join(known, "id", "left").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("known", F.lit(False)).alias("known")))).alias("ids"))
    some = lambda keep: F.array_join(F.transform(F.filter("ids", lambda x: x["known"] == keep), lambda x: x["id"].cast("string")), ",")
    return listed.select("o_custkey", some(True).alias("kept"), some(False).alias("dropped"))


@query("SELECT o_orderkey, 'see and step ' || o_custkey || '.' AS prose FROM orders")
def prose_without_ids(spark, sf_dir: str) -> DataFrame:
    """Internal ids taken out of prose with their labels and brackets; what is an id comes from the row."""
    o = table(spark, sf_dir, "orders")
    prose = F.concat(F.lit("see care id ord-"), F.col("o_orderkey"), F.lit(" (ord-"), F.col("o_orderkey") + 1, F.lit(") and step "), F.col("o_custkey"), F.lit("."))
    ids = F.array(F.concat(F.lit("ord-"), F.col("o_orderkey")), F.concat(F.lit("ord-"), F.col("o_orderkey") + 1))
    return o.select("o_orderkey", T.strip_ids(prose, ids).alias("prose"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN '10.0.' || event_id % 256 || '.7' WHEN 1 THEN '2001:db8:' || lower(to_hex(event_id % 65536)) || ':0::/64'
  WHEN 2 THEN 'fe80:0:0:0::/64' ELSE '192.168.1.' || event_id % 256 END AS net FROM events""")
def client_networks(spark, sf_dir: str) -> DataFrame:
    """Client addresses as rate-limit keys: the IPv4 address, or the /64 of an IPv6 one."""
    n = F.col("event_id")
    v4 = F.concat(F.lit("10.0."), n % 256, F.lit(".7"))
    long = F.concat(F.lit("2001:0DB8:"), F.lpad(F.hex(n % 65536), 4, "0"), F.lit(":0000:1:2:3:4"))
    ip = F.when(n % 4 == 0, v4).when(n % 4 == 1, long).when(n % 4 == 2, F.lit(" FE80::1 ")).otherwise(F.concat(F.lit("::ffff:192.168.1."), n % 256))
    return table(spark, sf_dir, "events").select("event_id", R.network(ip).alias("net"))


@query("SELECT event_id, CASE WHEN event_id % 5 <> 4 THEN 'en' END AS lang, CASE WHEN event_id % 5 <> 3 AND event_id % 2 = 0 THEN lpad((event_id % 100000)::VARCHAR, 5, '0') END AS zip FROM events WHERE event_id % 5 <> 0")
def link_presets(spark, sf_dir: str) -> DataFrame:
    """Presets of a link's fragment: allow-listed keys, a repeated key counts as absent, values are checked."""
    n = F.col("event_id")
    zip_ = F.when(n % 2 == 0, F.lpad((n % 100000).cast("string"), 5, "0")).otherwise("12x45")
    link = F.concat(F.lit("#try&via="), F.when(n % 5 == 0, "other").otherwise("helper"), F.when(n % 5 == 4, "&lang=xx").otherwise("&lang=en"), F.lit("&zip="), zip_, F.when(n % 5 == 3, F.concat(F.lit("&zip="), zip_)).otherwise(F.lit("")), F.lit("&junk=1"))
    got = T.let(R.fragment(link, ["via", "lang", "zip"]), lambda m: F.struct(m["via"].alias("via"), m["lang"].alias("lang"), m["zip"].alias("zip")))
    e = table(spark, sf_dir, "events").select("event_id", got.alias("p")).where("p.via = 'helper'")
    return e.select("event_id", R.exact(F.col("p.lang"), "en").alias("lang"), F.when(F.col("p.zip").rlike("^[0-9]{5}$"), F.col("p.zip")).alias("zip"))


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, o_orderstatus FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') ON l_orderkey = o_orderkey),
r AS (SELECT *, CASE WHEN o_orderstatus IS NULL THEN 'unknown_step' WHEN l_quantity > 45 THEN 'bad_options' END AS reason FROM d),
k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, reason IS NULL ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM r)
SELECT l_orderkey, l_linenumber, coalesce(reason, CASE WHEN rn > 1 THEN 'duplicate_step' WHEN rn > 0 THEN 'kept' END) AS reason FROM k""")
def checked_drafts(spark, sf_dir: str) -> DataFrame:
    """Drafts against known steps: ordered drop reasons, and a duplicate is one after a draft that is kept.

    Rows of one order and line number come out alike, so the order of drafts needs no other column than that number.
    """
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")  # noqa: E741
    rows = o.count() + l.count()
    o = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("known"))
    l, o = dealt(rows, "l_orderkey", l.select("l_orderkey", "l_linenumber", (F.col("l_quantity") > 45).alias("bad")), o)  # noqa: E741
    d = l.join(o, "l_orderkey", "left")
    reason = R.first_reason({"unknown_step": F.col("known").isNull(), "bad_options": F.col("bad")})
    return R.with_duplicates(d.withColumn("reason", reason), ["l_orderkey"], ["l_linenumber"], "duplicate_step").select("l_orderkey", "l_linenumber", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'R')")
def used_resources(spark, sf_dir: str) -> DataFrame:
    """Resources that some step's list of ids names."""
    steps = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("ids"))
    used = steps.select(F.explode("ids").alias("s_suppkey")).distinct()
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(used, "s_suppkey", "left_semi")


STATUS = "CASE WHEN l_quantity > 40 THEN 'outside' WHEN l_discount > 0.05 THEN 'unknown' ELSE 'inside' END"


@query(f"SELECT l_suppkey, count(*) FILTER (WHERE s = 'outside') AS outside, count(*) FILTER (WHERE s = 'inside') AS inside, count(*) FILTER (WHERE s = 'unknown') AS unknown FROM (SELECT l_suppkey, {STATUS} AS s FROM lineitem) GROUP BY l_suppkey")
def status_histogram(spark, sf_dir: str) -> DataFrame:
    """Counts of each status by key."""
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", F.expr(STATUS).alias("s"))  # noqa: E741
    return l.groupBy("l_suppkey").agg(*[F.count_if(F.col("s") == k).alias(k) for k in ("outside", "inside", "unknown")])


@query(f"SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE {STATUS} WHEN 'outside' THEN 0 WHEN 'unknown' THEN 1 ELSE 2 END, l_linenumber, l_partkey, l_suppkey)::INT AS place FROM lineitem")
def lines_by_status(spark, sf_dir: str) -> DataFrame:
    """A stable order by the priority of a status."""
    order = ["outside", "unknown", "inside"]
    w = Window.partitionBy("l_orderkey").orderBy(R.rank_of(F.expr(STATUS), order), "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(w).alias("place"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_type <> 'error', CASE event_type WHEN 'purchase' THEN 0 WHEN 'signup' THEN 1 WHEN 'click' THEN 2 ELSE 3 END, event_id)::INT AS place FROM events")
def walk_order(spark, sf_dir: str) -> DataFrame:
    """Warnings first, then groups in their order, inside a group the order of the source."""
    w = Window.partitionBy("user_id").orderBy((F.col("event_type") != "error"), R.rank_of(F.col("event_type"), ["purchase", "signup", "click"]), "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(w).alias("place"))


@query("SELECT o_orderkey FROM orders LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS placed FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1) ON l_orderkey = o_orderkey ORDER BY placed NULLS FIRST, o_orderkey LIMIT 20")
def oldest_sessions(spark, sf_dir: str) -> DataFrame:
    """A top-k with nulls first: a report of 20."""
    placed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'N'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("placed"))
    return table(spark, sf_dir, "orders").join(placed, "o_orderkey", "left").orderBy(F.col("placed").asc_nulls_first(), "o_orderkey").limit(20).select("o_orderkey")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
SELECT o_custkey, max(o_orderdate) AS newest, arg_min(o_orderkey, (pos - o_custkey % n + n) % n) FILTER (WHERE o_orderstatus = 'O') AS next_open FROM o GROUP BY o_custkey""")
def next_open_step(spark, sf_dir: str) -> DataFrame:
    """The next open step from a place on, around the end of the list, and the newest date."""
    by = Window.partitionBy("o_custkey")
    o = table(spark, sf_dir, "orders").withColumns({"pos": F.row_number().over(by.orderBy("o_orderkey")) - 1, "n": F.count(F.lit(1)).over(by)})
    around = (F.col("pos") - F.col("o_custkey") % F.col("n") + F.col("n")) % F.col("n")
    return o.groupBy("o_custkey").agg(F.max("o_orderdate").alias("newest"), F.min_by(F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey")), F.when(F.col("o_orderstatus") == "O", around)).alias("next_open"))


@query("SELECT n_name, n, row_number() OVER (ORDER BY n_name = 'Other', n DESC, n_name)::INT AS place FROM (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)")
def languages_by_count(spark, sf_dir: str) -> DataFrame:
    """Names by count and then by name, the collecting one last; the groups are 25."""
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"))
    g = c.join(table(spark, sf_dir, "nation"), "n_nationkey").select("n_name", "n")
    return g.withColumn("place", F.row_number().over(Window.orderBy(F.col("n_name") == "Other", F.col("n").desc(), "n_name")))


@query("SELECT event_id, (row_number() OVER w)::INT AS k, count(*) OVER (PARTITION BY user_id, event_type)::INT AS n FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY event_id)")
def occurrence_index(spark, sf_dir: str) -> DataFrame:
    """The k-th of n occurrences of a repeated value."""
    by = Window.partitionBy("user_id", "event_type")
    return table(spark, sf_dir, "events").select("event_id", F.row_number().over(by.orderBy("event_id")).alias("k"), F.count(F.lit(1)).over(by).cast("int").alias("n"))


@query("""WITH s AS (SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS a, list_sort(list(DISTINCT l_partkey % 100 + 1)) AS b FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, a = b AS equal, list_has_all(b, a) AS subset, len(list_distinct(list_concat(a, b))) AS n_union FROM s""")
def set_relations(spark, sf_dir: str) -> DataFrame:
    """Equality, subset and union of two sets of a row."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("a"), F.collect_set(F.col("l_partkey") % 100 + 1).alias("b"))
    return s.select("l_orderkey", R.same_set(F.col("a"), F.col("b")).alias("equal"), R.subset(F.col("a"), F.col("b")).alias("subset"), F.size(F.array_union("a", "b")).cast("long").alias("n_union"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') UNION ALL SELECT o_orderkey + 10000000 FROM orders WHERE o_orderstatus = 'P' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def without_tombstones(spark, sf_dir: str) -> DataFrame:
    """Rows whose key has been deleted go, whatever copy of them there is: a delete wins."""
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    o = table(spark, sf_dir, "orders").join(gone, "o_orderkey", "left_anti")
    return o.select("o_orderkey").unionByName(o.where("o_orderstatus = 'P'").select((F.col("o_orderkey") + 10000000).alias("o_orderkey")))


@query("SELECT user_id, map_from_entries(list_sort(list({'k': event_type, 'v': n}))) IS NOT NULL AS ok, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS shown FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id")
def rows_to_map(spark, sf_dir: str) -> DataFrame:
    """Rows of a key as one map, printed in key order."""
    g = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    m = g.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return m.select("user_id", F.col("m").isNotNull().alias("ok"), F.array_join(F.transform(F.map_entries("m"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",").alias("shown"))


@query("SELECT event_id, coalesce(json_extract_string(props, '$.k')::INT, -1) AS k, 'none' AS missing FROM events")
def parsed_with_defaults(spark, sf_dir: str) -> DataFrame:
    """JSON by schema with a default for what is absent or malformed."""
    p = F.from_json("props", "k INT, missing STRING", {"mode": "PERMISSIVE"})
    return table(spark, sf_dir, "events").select("event_id", p.alias("p")).select("event_id", F.coalesce("p.k", F.lit(-1)).alias("k"), F.coalesce("p.missing", F.lit("none")).alias("missing"))


@query("""WITH f AS (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY ALL), o AS (SELECT conv_id, role, 'id-' || row_number() OVER (PARTITION BY conv_id ORDER BY t, role) AS alias FROM f)
SELECT c.conv_id, turn, alias, o.role AS restored FROM conversations c JOIN o ON c.conv_id = o.conv_id AND c.role = o.role""")
def opaque_ids(spark, sf_dir: str) -> DataFrame:
    """Ids replaced by their order of appearance in a session, and put back."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    first = c.groupBy("conv_id", "role").agg(F.min("turn").alias("t"))
    names = first.select("conv_id", "role", F.concat(F.lit("id-"), F.row_number().over(Window.partitionBy("conv_id").orderBy("t", "role"))).alias("alias"))
    hidden = c.join(names, ["conv_id", "role"]).select("conv_id", "turn", "alias")
    return hidden.join(names.withColumnRenamed("role", "restored"), ["conv_id", "alias"]).select("conv_id", "turn", "alias", "restored")


@query("SELECT doc_id, (generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) - 1)::INT AS pos, md5(unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)))) AS line FROM documents")
def document_lines(spark, sf_dir: str) -> DataFrame:
    """Every line of every text with its place."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\\r?\\n")).alias("pos", "line")).select("doc_id", "pos", F.md5("line").alias("line"))


@query("SELECT s_suppkey, round(30 + (s_suppkey * 7919 % 6000) / 1000.0::DOUBLE, 1) AS lat, floor((s_acctbal + 0.05) * 10) / 10 AS km FROM supplier")
def rounded_places(spark, sf_dir: str) -> DataFrame:
    """Coordinates and distances rounded half up, toward plus infinity for negative ones."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.round(30 + k * 7919 % 6000 / 1000.0, 1).alias("lat"), (F.floor((F.col("s_acctbal") + 0.05) * 10) / 10).alias("km"))


@query("""SELECT doc_id, CASE WHEN length(t) <= 72 THEN t WHEN instr(substr(t, 1, 73), ' ') > 1 THEN regexp_replace(regexp_extract(substr(t, 1, 73), '^(.*) ', 1), '[\\s,;:.–(-]+$', '') || '…'
  WHEN instr(substr(t, 73), ' ') > 0 THEN regexp_replace(substr(t, 1, 71 + instr(substr(t, 73), ' ')), '[\\s,;:.–(-]+$', '') || '…' ELSE t END AS short
FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL)""")
def short_quotes(spark, sf_dir: str) -> DataFrame:
    """Quotes cut at a word's end to 72 characters."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.short_quote(F.col("text"), 72).alias("short"))


@query("SELECT doc_id, CASE WHEN text IS NOT NULL THEN (SELECT count(*) FROM benchmark b WHERE contains(d.text, b.text)) END AS n_found FROM documents d")
def quote_on_page(spark, sf_dir: str) -> DataFrame:
    """How many of all quotes a page holds; null where there is no page."""
    from quillstone.operators import grounding

    d, b = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    found = grounding.ground_across(d, "doc_id", b, "item_id").where("exact").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    known = d.select("doc_id", F.col("text").isNotNull().alias("there")).join(found, "doc_id", "left")
    return known.select("doc_id", F.when(F.col("there"), F.coalesce("n", F.lit(0))).alias("n_found"))


@query("""WITH c AS (SELECT c_custkey, '404-555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS p FROM customer) SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN p WHEN 1 THEN '404-555-0001' END AS target FROM c""")
def booking_targets(spark, sf_dir: str) -> DataFrame:
    """The first phone number of a quote that is not labelled as a fax or an account."""
    k = F.col("c_custkey")
    p = F.concat(F.lit("404-555-"), F.lpad((k % 10000).cast("string"), 4, "0"))
    quote = F.when(k % 3 == 0, F.concat(F.lit("Call "), p, F.lit(" or 404 555 9999"))).when(k % 3 == 1, F.concat(F.lit("Fax: "), p, F.lit(". Phone (404) 555-0001"))).otherwise(F.concat(F.lit("MRN "), p, F.lit("; or "), p, F.lit(" (fax)")))
    return table(spark, sf_dir, "customer").select("c_custkey", T.booking_target(quote).alias("target"))


@query("SELECT user_id, event_id FROM events QUALIFY ts = max(ts) OVER (PARTITION BY user_id) AND event_id = max(event_id) OVER (PARTITION BY user_id, ts)")
def newest_run(spark, sf_dir: str) -> DataFrame:
    """Only the newest run of a key counts; replies of older ones are left out."""
    e = table(spark, sf_dir, "events")
    last = e.groupBy("user_id").agg(F.max(F.struct("ts", "event_id")).alias("last"))
    return last.select("user_id", "last.event_id")


@query("SELECT o_orderkey, CASE WHEN o_orderdate < (SELECT max(o_orderdate) - INTERVAL 30 DAY FROM orders) AND o_orderstatus = 'O' THEN 'stale' ELSE 'live' END AS state FROM orders")
def stale_sessions(spark, sf_dir: str) -> DataFrame:
    """A session that was placed too long ago is refused when it is read."""
    o = table(spark, sf_dir, "orders")
    now = o.agg((F.max("o_orderdate") - F.expr("INTERVAL 30 DAYS")).alias("cut"))  # one row
    return o.join(F.broadcast(now)).select("o_orderkey", F.when((F.col("o_orderdate") < F.col("cut")) & (F.col("o_orderstatus") == "O"), "stale").otherwise("live").alias("state"))


@query("SELECT l_orderkey, l_linenumber, sha256(l_partkey || '|' || l_suppkey || '|' || l_returnflag) AS print, (l_partkey || '|' || l_suppkey || '|' || l_returnflag) = (lag(l_partkey || '|' || l_suppkey || '|' || l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS same FROM lineitem")
def input_fingerprints(spark, sf_dir: str) -> DataFrame:
    """A fingerprint of a row's inputs, and whether the row before had the same ones."""
    p = F.concat_ws("|", "l_partkey", "l_suppkey", "l_returnflag")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.sha2(p, 256).alias("print"), (p == F.lag(p).over(w)).alias("same"))


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT o_custkey, o_orderkey AS last_change, CASE o_orderstatus WHEN 'F' THEN 'closed' WHEN 'P' THEN 'renamed' ELSE 'open' END AS state FROM l WHERE rn = 1 AND o_orderpriority <> '5-LOW'""")
def saved_plans(spark, sf_dir: str) -> DataFrame:
    """A change log replayed: the last change of each key decides, and a delete takes the key away."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey")).alias("x"))
    state = F.when(F.col("x.o_orderstatus") == "F", "closed").when(F.col("x.o_orderstatus") == "P", "renamed").otherwise("open")
    return last.where("x.o_orderpriority <> '5-LOW'").select("o_custkey", F.col("x.o_orderkey").alias("last_change"), state.alias("state"))


@query("SELECT user_id, array_to_string((list(event_id ORDER BY ts, event_id))[-5:], ',') AS kept FROM events WHERE event_type = 'error' GROUP BY user_id")
def bounded_tombstones(spark, sf_dir: str) -> DataFrame:
    """The last five deletions of each key, in order: a stated bound of the store."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    w = Window.partitionBy("user_id").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    last = e.withColumn("rn", F.row_number().over(w)).where("rn <= 5").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id"))).alias("l"))
    return last.select("user_id", F.array_join(F.transform("l", lambda x: x["event_id"].cast("string")), ",").alias("kept"))


@query("SELECT c_custkey, 'via=helper&lang=' || CASE WHEN c_nationkey % 2 = 0 THEN 'en' ELSE 'es' END || CASE WHEN c_acctbal > 0 THEN '&zip=' || lpad((c_custkey % 100000)::VARCHAR, 5, '0') ELSE '' END AS link FROM customer")
def helper_links(spark, sf_dir: str) -> DataFrame:
    """Links built from the parts that are there."""
    parts = [F.lit("via=helper"), F.concat(F.lit("lang="), F.when(F.col("c_nationkey") % 2 == 0, "en").otherwise("es")), F.when(F.col("c_acctbal") > 0, F.concat(F.lit("zip="), F.lpad((F.col("c_custkey") % 100000).cast("string"), 5, "0")))]
    return table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws("&", *parts).alias("link"))


@query("SELECT doc_id, item_id, contains(d.text, b.text) AS device, strpos(d.text, b.text) > 0 AS server, true AS equal FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def parity_of_checkers(spark, sf_dir: str) -> DataFrame:
    """Two checkers' answers by key, equal with null as a value."""
    from quillstone.plans import text

    # both ask the same checker: it goes over the documents once, and its pairs are read by both
    found = written(text.grounded_items(spark, sf_dir), "grounded")
    a, b = found.withColumn("device", F.lit(True)), found.withColumn("server", F.lit(True))
    both = a.join(b, ["doc_id", "item_id"], "full")
    return both.select("doc_id", "item_id", F.coalesce("device", F.lit(False)).alias("device"), F.coalesce("server", F.lit(False)).alias("server"), F.col("device").eqNullSafe(F.col("server")).alias("equal"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'urgent' WHEN o_totalprice < 50000 THEN 'not_in_paper' WHEN n IS NULL THEN 'not_in_paper' ELSE 'answer' END AS kind FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def answer_kinds(spark, sf_dir: str) -> DataFrame:
    """The kind of an answer: urgent before not answered before no quotes before answer."""
    quotes = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("o_orderstatus") == "P", "urgent").when((F.col("o_totalprice") < 50000) | F.col("n").isNull(), "not_in_paper").otherwise("answer")
    return table(spark, sf_dir, "orders").join(quotes, "o_orderkey", "left").select("o_orderkey", kind.alias("kind"))


@query("""SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'certified' WHEN length(text) % 3 = 0 THEN 'flagged' ELSE 'unchecked' END AS seal,
  CASE WHEN role = 'user' THEN text ELSE '' END AS shared, role || ' · ' || turn AS label FROM conversations""")
def sealed_lines(spark, sf_dir: str) -> DataFrame:
    """What a view may show by the check of a line: only certified words are shared."""
    seal = F.when(F.col("role") == "user", "certified").when(F.length("text") % 3 == 0, "flagged").otherwise("unchecked")
    c = table(spark, sf_dir, "conversations").withColumn("seal", seal)
    return c.select("conv_id", "turn", "seal", F.when(F.col("seal") == "certified", F.col("text")).otherwise("").alias("shared"), F.concat_ws(" · ", "role", "turn").alias("label"))


@query("SELECT user_id, min(event_id) FILTER (WHERE event_type IN ('purchase', 'signup')) AS booked, min(event_id) FILTER (WHERE event_type <> 'view') AS current FROM events GROUP BY user_id")
def current_steps(spark, sf_dir: str) -> DataFrame:
    """The first row of the kinds that can be booked, and the first that is not done."""
    pick = lambda cond: F.min(F.when(cond, F.col("event_id")))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(pick(F.col("event_type").isin("purchase", "signup")).alias("booked"), pick(F.col("event_type") != "view").alias("current"))


@query("SELECT o_orderkey, o_custkey, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def lookups_by_id(spark, sf_dir: str) -> DataFrame:
    """Look-ups by id; the optimizer broadcasts the dimension by its size."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("n_nationkey"))
    return o.join(c, "o_custkey").join(table(spark, sf_dir, "nation"), "n_nationkey").select("o_orderkey", "o_custkey", "n_name")


KEY = b"only for the test tables"
_PADDED = {b: "".join(f"\\x{x ^ b:02X}" for x in KEY.ljust(64, b"\0")) for b in (0x36, 0x5C)}


@query(f"SELECT c_custkey, sha256('{_PADDED[0x5C]}'::BLOB || unhex(sha256('{_PADDED[0x36]}'::BLOB || encode(c_name)))) AS token FROM customer")
def keyed_tokens(spark, sf_dir: str) -> DataFrame:
    """Keyed hashes of names."""
    return table(spark, sf_dir, "customer").select("c_custkey", R.keyed_hash(F.col("c_name"), KEY).alias("token"))


@query("SELECT c_custkey, c_name AS again, true AS bound FROM customer")
def sealed_names(spark, sf_dir: str) -> DataFrame:
    """Names sealed with their row as context: they open with it and with no other one."""
    key, row = F.lit(b"0123456789abcdef"), F.col("c_custkey").cast("string")
    s = table(spark, sf_dir, "customer").select("c_custkey", R.sealed(F.col("c_name"), key, row).alias("s"))
    return s.select("c_custkey", R.opened(F.col("s"), key, row).alias("again"), R.opened(F.col("s"), key, F.concat(row, F.lit("x"))).isNull().alias("bound"))


@query("SELECT o_orderkey, strftime(d, '%Y%m%dT090000') AS starts, strftime(d, '%A, %B %-d') AS shown FROM (SELECT o_orderkey, unnest(range(o_orderdate::DATE + INTERVAL 1 DAY, o_orderdate::DATE + INTERVAL 4 DAY, INTERVAL 1 DAY)) AS d FROM orders)")
def calendar_options(spark, sf_dir: str) -> DataFrame:
    """The next three days as calendar starts and as texts."""
    day = F.to_date("o_orderdate")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.explode(F.sequence(F.date_add(day, 1), F.date_add(day, 3))).alias("d"))
    return o.select("o_orderkey", F.date_format("d", "yyyyMMdd'T090000'").alias("starts"), F.date_format("d", "EEEE, MMMM d").alias("shown"))


@query("SELECT doc_id, greatest(1, length(t) - length(replace(t, ' ', '')) + 1) AS n_words, ceil(length(t) / 15.0)::BIGINT AS seconds FROM (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'), ' ') AS t FROM documents WHERE text IS NOT NULL)")
def speech_chunks(spark, sf_dir: str) -> DataFrame:
    """Texts cut at words into chunks that are read aloud one by one; together they hold every word, and how long they take."""
    t = F.trim(F.regexp_replace("text", "\\s+", " "))
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", t.alias("t"), T.chunks(t, 300).alias("c"))
    words = F.aggregate("c", F.lit(0), lambda n, x: n + F.size(F.split(x, " ")))
    return d.select("doc_id", F.greatest(F.lit(1), words).cast("long").alias("n_words"), F.ceil(F.length("t") / 15.0).alias("seconds"))


_HOUR = "(c_custkey % 5 + 6)"
_DAYS = "['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday']"


@query(f"""WITH c AS (SELECT c_custkey, c_custkey % 7 AS a, (c_custkey // 7) % 7 AS b, (c_custkey // 49) % 7 AS x, c_custkey % 4 AS kind, {_HOUR} AS opens, c_custkey % 6 + 13 AS closes FROM customer),
d AS (SELECT *, unnest(range(0, 7)) AS day FROM c),
r AS (SELECT *, (day - a + 7) % 7 <= (b - a + 7) % 7 AS inside, a <> b AND x = day AND kind > 0 AND (day - a + 7) % 7 <= (b - a + 7) % 7 AS special FROM d)
SELECT c_custkey, day::INT AS day, CASE WHEN special AND kind = 1 THEN 'closed' WHEN special AND kind = 2 THEN 'closing' WHEN special THEN 'opening' WHEN inside THEN NULL
  WHEN day = x AND kind IN (1) THEN 'closed' WHEN day = x AND kind = 2 THEN 'opening' WHEN day = x AND kind = 3 THEN 'opening' ELSE 'other_day' END AS reason FROM r WHERE NOT (a = b AND x = a)""")
def hours_in_quotes(spark, sf_dir: str) -> DataFrame:
    """Whether each day's stated hours follow from a customer's sentence: ranges round the week, narrower parts, closed days."""
    from quillstone.functions import hours

    k = F.col("c_custkey")
    name = lambda n: F.element_at(F.array(*map(F.lit, ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"))), (n + 1).cast("int"))
    a, b, x, kind = k % 7, F.floor(k / 7) % 7, F.floor(k / 49) % 7, k % 4
    opens, closes = k % 5 + 6, k % 6 + 13
    wide = F.concat(name(a), F.lit(" - "), name(b), F.lit(" "), opens.cast("string"), F.lit(" a.m. – "), (closes - 12).cast("string"), F.lit("pm"))
    narrow = F.when(kind == 0, "").when(kind == 1, F.concat(F.lit("; "), name(x), F.lit(" closed"))).when(kind == 2, F.concat(F.lit(". Open late on "), name(x), F.lit("s until 11pm"))).otherwise(F.concat(F.lit("; "), name(x), F.lit(" 5am-11pm")))
    rows = table(spark, sf_dir, "customer").where(~((a == b) & (x == a))).select("c_custkey", F.concat(wide, narrow).alias("quote"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day"))
    clock = lambda h: F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":00"))
    return rows.select("c_custkey", "day", hours.hours_check(F.col("quote"), F.col("day"), clock(opens), clock(closes)).alias("reason"))


_STEPS = "SELECT *, (l_suppkey + row) % 6 AS kind FROM (SELECT l_orderkey AS report, l_suppkey, l_quantity::BIGINT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS row FROM lineitem)"


@query(f"""SELECT report, row, CASE kind WHEN 0 THEN CASE WHEN q > 1 THEN 'days_before' ELSE 'day_before' END WHEN 2 THEN 'day_before' WHEN 3 THEN 'morning_of' END AS slot,
  CASE kind WHEN 1 THEN 'clock_without_day' WHEN 4 THEN 'other_clause' WHEN 5 THEN NULL ELSE 'placed' END AS reason, kind = 5 AS held FROM ({_STEPS})""")
def preparation_steps(spark, sf_dir: str) -> DataFrame:
    """Steps of papers that are made of orders' lines: when each is due by its own sentence, and why it is not placed."""
    from quillstone.operators import preparation

    row, q, kind = F.col("row"), F.col("q"), F.col("kind")
    said = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.col("l_orderkey").alias("report"), F.col("l_quantity").cast("long").alias("q"), F.expr("row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)").cast("long").alias("row"))
    lines = lines.withColumn("kind", (F.col("l_suppkey") + row) % 6)
    line = F.element_at(
        F.array(
            said("Stop item ", row, " ", q, " days before your procedure."), said("Take item ", row, " at 8 PM."), said("Eat item ", row, " the day before your test."), said("Drink item ", row, " the morning of your exam."),
            said("Take item ", row, "; stop drinking ", q % 9 + 1, " hours before your procedure."), said("Bring item ", row, "."),
        ), (kind + 1).cast("int"),
    )
    quote = F.when(kind == 4, said("take item ", row)).when(kind == 5, said("Bring item ", row, "x")).otherwise(line)
    papers = lines.select("report", F.struct("row", line.alias("line"), quote.alias("quote")).alias("s")).groupBy("report").agg(F.sort_array(F.collect_list("s")).alias("s"))
    papers = papers.select("report", F.array_join(F.transform("s", lambda x: x["line"]), "\n").alias("text"), F.transform("s", lambda x: F.struct(x["row"], x["quote"])).alias("steps"))
    return preparation.prep_steps(papers, "report").select("report", "row", "slot", "reason", "held")
