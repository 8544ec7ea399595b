"""Secret scan: fixed patterns plus sliding-window Shannon entropy over candidate strings.

Candidates are maximal runs of base64 characters of at least one window, in the text without what the fixed patterns
found: a run is cut at their spans and its pieces are rated. A run's character class (hex, alnum, base64, single: letters
of one case, '-' and '_' and at least a sixth digits) decides the threshold. The entropy of a window of W characters is log2(W) - S / W with S
the sum of c * log2(c) over its character counts; moving the window by one character changes two counts, so the counts
and S are carried along (a count is five bits of one of six longs). A run whose highest window reaches the threshold
is a span, unless the allow-list knows it. Other runs without a digit or of one case only are words, paths and names:
they have no threshold, whatever their entropy.

Only SQL functions run; each document is one row from scan to result, so there is no shuffle. Offsets are code points,
running sums of the lengths of what a pattern splits the text into, in chunks of CHUNK and a sum for each chunk, so the
work for m matches is m * CHUNK + (m / CHUNK) ** 2 / 2 small steps.

Defined results: null text counts as empty and has no spans; a text may be of any length that one row can hold; spans
of equal start are in the order of their kinds; rows repeat as they are; an empty table gives no rows; extra columns
pass through the operator, those called like an output column are replaced. Cutting is done at the assign spans, then
at what the access and then the hex pattern find in what is left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.sharding import let

#: The three patterns of the scan. A span is the whole match.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the runs AKIA[A-Z0-9]+ of 20 characters or more
HEX = r"[0-9a-f]{24,}"  # the runs [0-9a-f]+ of 24 characters or more
BASE_KINDS = ("assign", "access", "hex")

WINDOW = 20
RUN = r"[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CHUNK = 64
#: Bits a character by class; a class that is absent is never a secret (digits: numbers and dates; word: no keys).
THRESHOLDS = {"hex": 3.25, "single": 3.7, "alnum": 3.75, "base64": 3.85}
#: Runs that are identifiers or placeholders rather than secrets.
ALLOW = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|(?i:example|sample|dummy|placeholder|lorem)|^(/[A-Za-z_-]+)+/?$|abcdefghij|0123456789"


def running_sums(lengths: Column) -> Column:
    """Sums of each element and all before it, in chunks, so that no array grows to its full length step by step."""
    add = lambda n, x: n + x
    zero, none = F.lit(0).cast("long"), F.array().cast("array<bigint>")
    last = lambda xs: F.coalesce(F.try_element_at(xs, F.lit(-1)), zero)
    chunks = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / CHUNK).cast("int"))
    part = lambda k: F.slice(lengths, k * CHUNK + 1, F.lit(CHUNK))
    before = F.aggregate(chunks, F.array(zero), lambda s, k: F.concat(s, F.array(last(s) + F.aggregate(part(k), zero, add))))
    inner = lambda start: lambda k: F.aggregate(part(k), none, lambda s, x: F.concat(s, F.array(F.coalesce(F.try_element_at(s, F.lit(-1)), F.element_at(start, k + 1)) + x)))
    return F.when(F.size(lengths) > 0, let(before, lambda start: F.flatten(F.transform(chunks, inner(start))))).otherwise(none)


def located(text: Column, pattern: str, matches: Column, keep: Column | None = None) -> Column:
    """array<struct<start,end,found>> of the matches, start and end in code points; keep: which of them stay."""
    gaps = F.split(text, pattern, -1)
    ends = running_sums(F.zip_with(matches, F.slice(gaps, F.lit(1), F.size(matches)), lambda m, g: (F.length(m) + F.length(g)).cast("long")))
    one = lambda m, e: F.struct((e - F.length(m)).cast("int").alias("start"), e.cast("int").alias("end"), m.alias("found"))
    spans = F.zip_with(matches, ends, one)
    if keep is not None:
        both = F.zip_with(spans, keep, lambda s, k: F.struct(s.alias("s"), k.alias("k")))
        spans = F.transform(F.filter(both, lambda x: x["k"]), lambda x: x["s"])
    return spans


def blanked(text: Column, pattern: str, matches: Column, keep: Column | None = None) -> Column:
    """The text with spaces in place of the matches (those that keep says); as many characters as before."""
    spaces = lambda m: F.repeat(F.lit(" "), F.length(m))
    filled = F.transform(matches, spaces) if keep is None else F.zip_with(matches, keep, lambda m, k: F.when(k, spaces(m)).otherwise(m))
    joined = F.array_join(F.zip_with(F.split(text, pattern, -1), filled, lambda g, m: F.concat(g, F.coalesce(m, F.lit("")))), "")
    return F.when(F.size(matches) > 0, joined).otherwise(text)


def character_class(run: Column) -> Column:
    digits = F.length(F.regexp_replace(run, "[^0-9]", ""))
    return (
        F.when(run.rlike("^[0-9_=+/-]+$"), "digits")
        .when(run.rlike("^([0-9a-f]+|[0-9A-F]+)$") & run.rlike("[a-fA-F]"), "hex")
        .when(run.rlike("^([a-z0-9_-]+|[A-Z0-9_-]+)$") & (digits * 6 >= F.length(run)), "single")
        .when(~run.rlike("[0-9]") | ~run.rlike("[A-Z]") | ~run.rlike("[a-z]"), "word")
        .when(run.rlike("^[A-Za-z0-9]+$"), "alnum")
        .otherwise("base64")
    )


def top_entropy(run: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits a character, of a window of the run; window: at most 31."""
    f = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 1)])
    grown = lambda c: F.element_at(f, c + 2) - F.element_at(f, c + 1)  # noqa: E731  one more of a character
    shift = lambda way, v, x: F.call_function(way, v, (x % 12 * 5).cast("int"))
    cell = lambda x: F.floor(x / 12).cast("int")
    count = lambda counts, x: shift("shiftright", F.element_at(counts, cell(x) + 1), x).bitwiseAND(F.lit(31)).cast("int")
    bumped = lambda counts, x, by: F.transform(counts, lambda v, i: v + F.when(i == cell(x), shift("shiftleft", F.lit(by).cast("long"), x)).otherwise(F.lit(0)))

    def of(chars):
        state = lambda counts, sum_, low: F.struct(counts.alias("counts"), sum_.alias("sum"), low.alias("low"))

        def slide(s, i):  # character i - window goes out, character i comes in
            come, go = F.element_at(chars, i), F.element_at(chars, F.greatest(i - window, F.lit(1)))
            less = state(bumped(s["counts"], go, -1), s["sum"] - grown(count(s["counts"], go) - 1), s["low"])
            more = lambda t: state(bumped(t["counts"], come, 1), t["sum"] + grown(count(t["counts"], come)), t["low"])
            full = let(F.when(i > window, less).otherwise(s), more)
            return let(full, lambda t: state(t["counts"], t["sum"], F.when(i >= window, F.least(t["low"], t["sum"])).otherwise(t["low"])))

        none = F.array(*[F.lit(0).cast("long")] * -(-len(ALPHABET) // 12))
        begin = state(none, F.lit(0.0), F.lit(math.inf))
        low = F.aggregate(F.sequence(F.lit(1), F.size(chars)), begin, slide, lambda s: s["low"])
        return F.lit(math.log2(window)) - low / window

    place = lambda c: F.position(c, F.lit(ALPHABET)) - 1
    return let(F.transform(F.regexp_extract_all(run, F.lit("(?s)."), F.lit(0)), place), of)


def scan_secrets(docs: DataFrame, thresholds: dict[str, float] | None = None, allow: str = ALLOW) -> DataFrame:
    """docs with secrets, array<struct<kind,start,end,found,entropy>> by start: the fixed patterns' and the added ones."""
    limits = THRESHOLDS if thresholds is None else thresholds
    docs = docs.drop("secrets")
    names = docs.columns
    all_of = lambda p, g=0: F.regexp_extract_all("_t", F.lit(p), F.lit(g))
    # the caller's columns stay in one struct, so no name of theirs can meet one of ours
    texts = docs.select(F.struct(*names).alias("_row"), F.coalesce("text", F.lit("")).alias("_t"))
    found = texts.select("_row", "_t", *[all_of(p).alias(f"_{k}") for k, p in zip(BASE_KINDS, (ASSIGN, ACCESS, HEX), strict=True)])
    enough = F.when(F.size("_assign") > 0, F.transform(all_of(ASSIGN, 2), lambda v: F.length(v) >= 6)).otherwise(F.array().cast("array<boolean>"))
    found = found.select(
        "_row",
        blanked(F.col("_t"), ASSIGN, F.col("_assign"), enough).alias("_left"),
        located(F.col("_t"), ASSIGN, F.col("_assign"), enough).alias("_assign"),
        located(F.col("_t"), ACCESS, F.col("_access")).alias("_access"),
        located(F.col("_t"), HEX, F.col("_hex")).alias("_hex"),
    )
    for p in (ACCESS, HEX):
        found = found.withColumn("_left", blanked(F.col("_left"), p, F.regexp_extract_all("_left", F.lit(p), F.lit(0))))
    found = found.withColumn("_runs", F.regexp_extract_all("_left", F.lit(RUN), F.lit(0)))
    as_spans = lambda c, kind, rank: F.transform(
        c, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["found"].alias("found"), F.lit(None).cast("double").alias("entropy"))
    )
    base = F.concat(*[as_spans(F.col(f"_{k}"), k, i) for i, k in enumerate(BASE_KINDS)])
    runs = located(F.col("_left"), RUN, F.col("_runs"))
    found = found.select("_row", base.alias("_base"), runs.alias("_runs"))

    limit = lambda kind: F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in limits.items()], F.lit(None).cast("double"))
    rated = F.transform(
        F.filter("_runs", lambda r: ~r["found"].rlike(allow) & limit(character_class(r["found"])).isNotNull()),
        lambda r: let(
            character_class(r["found"]),
            lambda kind: F.struct(
                r["start"].alias("start"),
                F.lit(len(BASE_KINDS)).alias("rank"),
                F.concat(F.lit("entropy_"), kind).alias("kind"),
                r["end"].alias("end"),
                r["found"].alias("found"),
                F.when(F.size("_runs") > 0, top_entropy(r["found"])).alias("entropy"),
                limit(kind).alias("limit"),
            ),
        ),
    )
    added = F.transform(
        F.filter(rated, lambda r: r["entropy"] >= r["limit"]),
        lambda r: F.struct(*[r[c].alias(c) for c in ("start", "rank", "kind", "end", "found", "entropy")]),
    )
    everything = F.sort_array(F.concat("_base", F.when(F.size("_runs") > 0, added).otherwise(F.slice("_base", 1, 0))))
    return found.select("_row", everything.alias("_all")).select(
        "_row.*",
        F.transform("_all", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"), s["entropy"].alias("entropy"))).alias("secrets"),
    )


def op6_scan_secrets(spark, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[n(k) for k in BASE_KINDS], F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


def _located_sql(pattern: str, source: str = "texts") -> str:
    p = pattern.replace("'", "''")
    return f"""SELECT doc_id, m AS found, sum(length(gap)) OVER w + sum(length(m)) OVER w - length(m) AS s
      FROM (SELECT doc_id, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap, generate_subscripts(ms, 1) AS i
            FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, string_split_regex(t, '{p}') AS gaps FROM {source}) WHERE len(ms) > 0)
      WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING)"""


def _blanked_sql(pattern: str, source: str, keep: str = "true") -> str:
    p = pattern.replace("'", "''")
    one = f"x[1] || CASE WHEN x[2] IS NULL THEN '' WHEN {keep} THEN repeat(' ', length(x[2])) ELSE x[2] END"
    return f"""SELECT doc_id, array_to_string(list_transform(list_zip(string_split_regex(t, '{p}'), regexp_extract_all(t, '{p}')), lambda x: {one}), '') AS t FROM {source}"""


_ASSIGN = ASSIGN.replace("'", "''")
_limit = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in THRESHOLDS.items()) + " END"
SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
assign AS (SELECT doc_id, 0 AS rank, 'assign' AS kind, s, s + length(found) AS e FROM ({_located_sql(ASSIGN)})
           WHERE length(regexp_extract(found, '{ASSIGN.replace("'", "''")}', 2)) >= 6),
access AS (SELECT doc_id, 1 AS rank, 'access' AS kind, s, s + length(found) AS e FROM ({_located_sql(ACCESS)})),
hex AS (SELECT doc_id, 2 AS rank, 'hex' AS kind, s, s + length(found) AS e FROM ({_located_sql(HEX)})),
base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
left1 AS ({_blanked_sql(ASSIGN, "texts", f"length(regexp_extract(x[2], '{_ASSIGN}', 2)) >= 6")}),
left2 AS ({_blanked_sql(ACCESS, "left1")}),
left3 AS ({_blanked_sql(HEX, "left2")}),
runs AS (
  SELECT doc_id, found, s, s + length(found) AS e,
    CASE WHEN regexp_full_match(found, '[0-9_=+/-]+') THEN 'digits'
         WHEN regexp_full_match(found, '[0-9a-f]+|[0-9A-F]+') THEN 'hex'
         WHEN regexp_full_match(found, '[a-z0-9_-]+|[A-Z0-9_-]+') AND length(regexp_replace(found, '[^0-9]', '', 'g')) * 6 >= length(found) THEN 'single'
         WHEN NOT (regexp_matches(found, '[0-9]') AND regexp_matches(found, '[A-Z]') AND regexp_matches(found, '[a-z]')) THEN 'word'
         WHEN regexp_full_match(found, '[A-Za-z0-9]+') THEN 'alnum' ELSE 'base64' END AS kind
  FROM ({_located_sql(RUN, "left3")}) WHERE NOT regexp_matches(found, '{ALLOW}')),
added AS (
  SELECT r.doc_id, 3 AS rank, 'entropy_' || kind AS kind, s, e FROM runs r
  WHERE list_max(list_transform(range(1, length(found) - {WINDOW} + 2), lambda i: list_aggregate(string_split(substr(found, i, {WINDOW}), ''), 'entropy'))) >= {_limit}),
listed AS (
  SELECT doc_id, string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) AS spans,
    string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, rank) FILTER (WHERE rank < 3) AS base,
    count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex
  FROM (SELECT * FROM base UNION ALL SELECT * FROM added) GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed USING (doc_id)
"""
