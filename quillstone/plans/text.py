"""Text queries over documents, benchmark items, pages and names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import alignment, coverage, grounding, reading, shield
from quillstone.plans.registry import query
from quillstone.session import table, written
from quillstone.streaming import scanner


def docs(spark, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *more)


NORM = "trim(regexp_replace(translate(lower(text), 'ς‘’‛′“”″‐‑‒–—―−•●▪·', 'σ''''''''\"\"\"-------    '), '[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ' ', 'g'))"


@query(f"SELECT doc_id, md5({NORM}) AS digest, length({NORM}) AS n FROM documents")
def normalized_text(spark, sf_dir: str) -> DataFrame:
    """Digest and length of every normalised text."""
    n = T.normalize(F.col("text"))
    return docs(spark, sf_dir).select("doc_id", F.md5(n).alias("digest"), F.length(n).cast("long").alias("n"))


@query(f"""WITH n AS (SELECT doc_id, {NORM} AS t FROM documents), p AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\\.\\.\\.|…'), lambda f: regexp_replace(f, '^[\"'' ]+|[\"'' ]+$', '', 'g')), lambda f: f <> '') AS f FROM n)
SELECT doc_id, CASE WHEN len(list_filter(f, lambda x: length(x) < 3)) > 0 THEN 0 ELSE len(f) END AS n_fragments FROM p""")
def quote_fragments(spark, sf_dir: str) -> DataFrame:
    """How many fragments each text has as a quote."""
    return docs(spark, sf_dir).select("doc_id", F.size(T.fragments(F.col("text"))).cast("long").alias("n_fragments"))


@query("SELECT item_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS key FROM benchmark")
def dedupe_keys(spark, sf_dir: str) -> DataFrame:
    """Keys that ignore case and punctuation."""
    return table(spark, sf_dir, "benchmark").select("item_id", T.dedupe_key(F.col("text")).alias("key"))


@query("SELECT p_partkey, CASE WHEN p_name = p_brand THEN 2 WHEN NOT regexp_matches(p_name, '[0-9]') AND NOT regexp_matches(p_type, '[0-9]') AND levenshtein(lower(p_name), lower(p_type)) <= floor(greatest(length(p_name), length(p_type)) / 4) THEN 1 ELSE 0 END AS score, levenshtein(p_name, p_type) AS distance FROM part")
def word_scores(spark, sf_dir: str) -> DataFrame:
    """Equal, close or different words by edit distance."""
    p = table(spark, sf_dir, "part")
    s = F.when(F.col("p_name") == F.col("p_brand"), 2).otherwise(F.least(F.lit(1), T.word_score(F.lower("p_name"), F.lower("p_type"))))
    return p.select("p_partkey", s.alias("score"), F.levenshtein("p_name", "p_type").cast("long").alias("distance"))


@query("""SELECT doc_id, length(regexp_replace(text, '\\b\\d{5,}(?:-\\d{4})?\\b', '#####', 'g')) AS n FROM documents""")
def masked_numbers(spark, sf_dir: str) -> DataFrame:
    """Texts with long numbers masked, by their length."""
    return docs(spark, sf_dir).select("doc_id", F.length(T.mask_numbers(F.col("text"))).cast("long").alias("n"))


@query("""WITH d AS (SELECT c_custkey, regexp_replace('(' || (1000000 + c_custkey * 7919)::VARCHAR || ')-' || c_nationkey::VARCHAR || '5', '[^0-9]', '', 'g') AS d FROM customer)
SELECT c_custkey, CASE WHEN length(CASE WHEN length(d) = 11 AND starts_with(d, '1') THEN substr(d, 2) ELSE d END) = 10
  THEN substr(CASE WHEN length(d) = 11 AND starts_with(d, '1') THEN substr(d, 2) ELSE d END, 1, 3) || '-' || substr(CASE WHEN length(d) = 11 AND starts_with(d, '1') THEN substr(d, 2) ELSE d END, 4, 3) || '-' || substr(CASE WHEN length(d) = 11 AND starts_with(d, '1') THEN substr(d, 2) ELSE d END, 7) ELSE '' END AS phone FROM d""")
def cleaned_phones(spark, sf_dir: str) -> DataFrame:
    """Phone numbers of ten digits in one form."""
    raw = F.concat(F.lit("("), (F.lit(1000000) + F.col("c_custkey") * 7919).cast("string"), F.lit(")-"), F.col("c_nationkey").cast("string"), F.lit("5"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.phone(raw).alias("phone"))


@query("SELECT page_id, CASE WHEN regexp_matches(url, '(?i)^https?://') THEN url ELSE 'https://' || ltrim(url, '/') END AS url, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def cleaned_urls(spark, sf_dir: str) -> DataFrame:
    """URLs with a scheme, and a slug of each."""
    return table(spark, sf_dir, "pages").select("page_id", T.url(F.col("url")).alias("url"), T.slug(F.col("url")).alias("slug"))


_BARE = "regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script>', ' ', 'g'), '(?is)<style\\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g')"
_NUMBERED = f"array_to_string(list_transform(list_zip(string_split_regex({_BARE}, '&#[0-9]{{1,7}};'), regexp_extract_all({_BARE}, '&#([0-9]{{1,7}});', 1)), lambda x: x[1] || coalesce(chr(x[2]::INT), '')), '')"
_NAMED = "replace(replace(replace(replace(replace(replace(" + _NUMBERED + ", '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&apos;', chr(39)), '&amp;', '&')"


@query(f"SELECT page_id, trim(regexp_replace({_NAMED}, '[ \\t\\n\\r\\f\\x{{00A0}}]+', ' ', 'g')) AS text FROM pages")
def page_texts(spark, sf_dir: str) -> DataFrame:
    """The text of every page without scripts, styles and tags, entities as characters."""
    return table(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


_WORD_CASE = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.WORD_NUMBERS.items()) + " END"


@query(f"""SELECT doc_id, len(list_distinct(list_concat(list_transform(regexp_extract_all(text, '\\d+(?:[.,]\\d+)*'), lambda n: regexp_replace(n, ',(\\d{{3}})\\b', '\\1', 'g')),
  list_transform(regexp_extract_all(lower(text), '\\b({'|'.join(T.WORD_NUMBERS)})\\b', 1), lambda w: {_WORD_CASE})))) AS n_numbers FROM documents""")
def numbers_in_texts(spark, sf_dir: str) -> DataFrame:
    """How many different numbers each text has, number words among them."""
    return docs(spark, sf_dir).select("doc_id", F.size(T.numbers_in(F.col("text"))).cast("long").alias("n_numbers"))


LINES = "(SELECT l_orderkey, l_linenumber, l_quantity AS v, round(l_discount * 400, 6) AS lo, round(l_tax * 600, 6) AS hi FROM lineitem)"


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN v > hi THEN 'high' WHEN v < lo THEN 'low' ELSE 'inside' END AS status FROM {LINES}")
def lab_verdicts(spark, sf_dir: str) -> DataFrame:
    """Measured values against printed ranges, both read from text."""
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_quantity AS v", "round(l_discount * 400, 6) AS lo", "round(l_tax * 600, 6) AS hi")
    plain = lambda c: F.col(c).cast("decimal(20,8)").cast("string")
    r = T.parse_range(F.concat(plain("lo"), F.lit(" - "), plain("hi")))
    v = T.parse_value(plain("v"))
    return rows.select("l_orderkey", "l_linenumber", T.classify(v, r).alias("status"))


@query("SELECT user_id, event_id, lpad(((event_id % 12 + CASE WHEN event_id % 2 = 1 THEN 12 ELSE 0 END))::VARCHAR, 2, '0') || ':' || CASE WHEN event_id % 4 = 0 THEN '30' ELSE '00' END AS opens FROM events")
def opening_times(spark, sf_dir: str) -> DataFrame:
    """Printed times as 24-hour times."""
    h = F.when(F.col("event_id") % 12 == 0, 12).otherwise(F.col("event_id") % 12).cast("string")
    printed = F.concat(h, F.when(F.col("event_id") % 4 == 0, ":30 ").otherwise(" "), F.when(F.col("event_id") % 2 == 1, "PM").otherwise("am"))
    return table(spark, sf_dir, "events").select("user_id", "event_id", T.to_24h(printed).alias("opens"))


_SHARE = {"ko": "Hangul", "am": "Ethiopic", "zh": "Han"}
_part = lambda cls: f"length(regexp_replace(t, '[^{cls}]', '', 'g'))"
_WORDS = " UNION ALL ".join(f"SELECT '{k}' AS code, unnest({v}) AS word" for k, v in {**T.STOP_WORDS, "other": T.OTHER_WORDS}.items())


@query(f"""WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), known AS ({_WORDS}),
s AS (SELECT doc_id, {_part("\\p{L}")} AS letters, {_part("\\p{Latin}")} AS latin, {_part("\\p{Hiragana}\\p{Katakana}")} AS kana, {', '.join(f'{_part(chr(92) + "p{" + v + "}")} AS {k}' for k, v in _SHARE.items())} FROM t),
w AS (SELECT doc_id, unnest(string_split_regex(t, '[^\\p{{L}}]+')) AS word FROM t),
n AS (SELECT doc_id, code, count(*) AS n FROM w JOIN known USING (word) GROUP BY ALL),
r AS (SELECT doc_id, max(n) FILTER (WHERE code <> 'other') AS best, arg_max(code, n) FILTER (WHERE code <> 'other') AS code, list_sort(list(n) FILTER (WHERE code <> 'other'), 'DESC')[2] AS second, max(n) FILTER (WHERE code = 'other') AS other FROM n GROUP BY doc_id)
SELECT doc_id, CASE WHEN letters = 0 THEN '' WHEN kana > 0.05 * letters THEN '' {' '.join(f"WHEN {k} > 0.5 * letters THEN '{k}'" for k in _SHARE)}
  WHEN latin >= 0.8 * letters AND (best >= 3 AND best >= 2 * second OR best >= 2 AND second IS NULL) AND coalesce(other, 0) * 2 < best THEN code ELSE '' END AS language
FROM s LEFT JOIN r USING (doc_id)""")
def document_languages(spark, sf_dir: str) -> DataFrame:
    """The language of every document by scripts and common words; '' when it is not clear."""
    return docs(spark, sf_dir).select("doc_id", T.detect_language(F.coalesce("text", F.lit(""))).alias("language"))


@query("SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')[1] AS first_email, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS n FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')")
def emails(spark, sf_dir: str) -> DataFrame:
    """Documents with an e-mail address."""
    found = F.regexp_extract_all("text", F.lit(T.EMAIL), F.lit(0))
    return docs(spark, sf_dir).select("doc_id", found.alias("f")).where(F.size("f") > 0).select("doc_id", F.try_element_at("f", F.lit(1)).alias("first_email"), F.size("f").cast("long").alias("n"))


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS summary FROM conversations GROUP BY conv_id")
def session_summaries(spark, sf_dir: str) -> DataFrame:
    """The lines of a session in order as one text."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("l"))
    return c.select("conv_id", F.array_join(F.transform("l", lambda s: F.concat(s["role"], F.lit(": "), s["text"])), "\n").alias("summary"))


@query("""SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def grounded_items(spark, sf_dir: str) -> DataFrame:
    """Which benchmark texts are quoted in which documents: one narrow pass over the documents."""
    d, q = docs(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    found = grounding.ground_across(d, "doc_id", q, "item_id").where("exact")
    return found.select("doc_id", "item_id")


def quotes_in(spark, sf_dir: str) -> DataFrame:
    """Every benchmark text that stands in a document: doc_id, item_id, start, end, exact, ranges."""
    q = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    return grounding.ground_across(docs(spark, sf_dir), "doc_id", q, "item_id").where("start IS NOT NULL")


@query()
def grounded_spans(spark, sf_dir: str) -> DataFrame:
    """The span of every grounded benchmark text in its document, on word and number boundaries."""
    return quotes_in(spark, sf_dir).select("doc_id", "item_id", "start", "end")


@query()
def verified_items(spark, sf_dir: str) -> DataFrame:
    """Grounded benchmark texts with the sentences around them; skipping over sentences or a long one is held back."""
    sentences = coverage.split_sentences(docs(spark, sf_dir), "doc_id").select("doc_id", "start", "end")
    return grounding.verified(quotes_in(spark, sf_dir), sentences, "doc_id").select("doc_id", "item_id", "s_start", "s_end", "status")


@query()
def planted_fakes(spark, sf_dir: str) -> DataFrame:
    """Planted mistakes (changed number, swapped word, added negation) of grounded quotes: how many are caught by kind."""
    d, q = docs(spark, sf_dir), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    held = grounding.ground_across(d, "doc_id", q, "item_id").where("start IS NOT NULL").select("doc_id", "item_id").join(q, "item_id").join(d, "doc_id")
    return grounding.catch_rates(held)


@query()
def document_sentences(spark, sf_dir: str) -> DataFrame:
    """Sentences of every document with their offsets."""
    return coverage.split_sentences(docs(spark, sf_dir), "doc_id").select("doc_id", "pos", "start", "end")


@query()
def instruction_coverage(spark, sf_dir: str) -> DataFrame:
    """Instructions of every document and how many a grounded benchmark quote covers."""
    s = coverage.split_sentences(docs(spark, sf_dir), "doc_id").withColumn("reason", coverage.instruction_reason(F.col("sentence"))).where("reason IS NOT NULL")
    return coverage.coverage_ratio(coverage.coverage(s, quotes_in(spark, sf_dir), "doc_id"), "doc_id")


@query()
def shielded_turns(spark, sf_dir: str) -> DataFrame:
    """Conversations with identifiers hidden, learnt and spread inside each conversation."""
    turns = table(spark, sf_dir, "conversations").withColumn("text", F.concat("text", F.lit(" MRN: A"), (F.col("conv_id") + 100000).cast("string")))
    s = shield.shield(turns, "conv_id", "turn")
    return s.select("conv_id", "turn", "redacted", F.size("segments").alias("n_hidden"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')) AS n_email, len(regexp_extract_all(text, '\\b\\d{3}-\\d{2}-\\d{4}\\b')) AS n_ssn FROM documents")
def identifier_counts(spark, sf_dir: str) -> DataFrame:
    """E-mail addresses and social security numbers by document."""
    n = lambda p: F.size(F.regexp_extract_all("text", F.lit(p), F.lit(0))).cast("long")
    return docs(spark, sf_dir).select("doc_id", n(T.EMAIL).alias("n_email"), n("\\b\\d{3}-\\d{2}-\\d{4}\\b").alias("n_ssn"))


@query("SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos FROM conversations")
def scanned_items(spark, sf_dir: str) -> DataFrame:
    """Objects of a JSON array that arrives in chunks of 37 characters, each as soon as it is complete."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("items"))
    whole = F.to_json(F.struct(F.lit("a \"[{").alias("note"), F.col("items")))
    chunks = turns.select("conv_id", F.posexplode(F.regexp_extract_all(whole, F.lit("(?s).{1,37}"), F.lit(0))).alias("seq", "chunk"))
    found = scanner.scanned(chunks, "conv_id", "seq")
    return found.select("conv_id", F.get_json_object("item", "$.turn").cast("long").alias("turn"), "pos")


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS pos, CASE turn % 5 WHEN 4 THEN 'malformed' WHEN 3 THEN 'not_found' ELSE 'grounded' END AS status FROM conversations")
def verified_stream_items(spark, sf_dir: str) -> DataFrame:
    """Items out of chunks of JSON, each parsed, checked by schema and grounded in its conversation's text."""
    from quillstone.streaming import sessions

    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("t"))
    item = lambda x: F.struct(F.when(x["turn"] % 5 != 4, "todo").alias("kind"), F.when(x["turn"] % 5 == 3, F.concat(F.lit("zzz "), x["text"])).otherwise(x["text"]).alias("quote"))
    whole = F.to_json(F.struct(F.transform("t", item).alias("items")))
    chunks = turns.select("conv_id", F.posexplode(F.regexp_extract_all(whole, F.lit("(?s).{1,37}"), F.lit(0))).alias("seq", "chunk"))
    sources = turns.select("conv_id", F.array_join(F.transform("t", lambda x: x["text"]), " | ").alias("text"))
    return sessions.verified_items(scanner.scanned(chunks, "conv_id", "seq"), sources, "conv_id").select("conv_id", "pos", "status")


MEMBER = "SELECT p_partkey, regexp_replace(p_name, '(^| )([a-z])', '\\1\\2', 'g') AS p_name, p_partkey + 1000000 AS mrn, (p_partkey % 12 + 1) || '/' || (p_partkey % 28 + 1) || '/' || (1930 + p_partkey % 70) AS dob FROM part"


@query(f"""WITH m AS (SELECT *, list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]) AS w FROM ({MEMBER}))
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(['DOB=' || dob, 'MRN=' || mrn, 'NAME=' || array_to_string(w, ' ')], CASE WHEN len(w) > 1 THEN list_transform(w, lambda x: 'NAME=' || x) ELSE [] END))), '; ') AS found FROM m""")
def labelled_identifiers(spark, sf_dir: str) -> DataFrame:
    """Names, dates and numbers of parts' records in five layouts: beside, below and across labels, in tables, disguised."""
    k = F.col("p_partkey")
    name, mrn = F.initcap("p_name"), (k + 1000000).cast("string")
    dob = F.concat_ws("/", k % 12 + 1, k % 28 + 1, 1930 + k % 70)
    wide = F.translate(mrn, "0123456789", "０１２３４５６７８９")
    forms = F.array(
        F.concat(F.lit("Patient: "), name, F.lit("\nDOB: "), dob, F.lit(", MRN "), mrn),
        F.concat(F.lit("Patient name:\n"), name, F.lit("\nDOB:\n"), dob, F.lit("\nMRN:\n"), mrn),
        F.concat(F.lit("Patient: "), name, F.lit("\nseen, Date of\nBirth: "), dob, F.lit("\nMedical Record\nNumber: "), mrn),
        F.concat(F.lit("Name                DOB          MRN\n"), name, F.lit("     "), dob, F.lit("     "), mrn),
        F.concat(F.lit("\ufeffPatient\u200b: "), name, F.lit("\nDOB\u200b: "), dob, F.lit("\nＭＲＮ： "), wide),
    )
    turns = table(spark, sf_dir, "part").select("p_partkey", F.lit(0).alias("turn"), F.element_at(forms, (k % 5 + 1).cast("int")).alias("text"))
    found = shield.learnt(turns, "p_partkey", "turn").select("p_partkey", F.concat_ws("=", "kind", "value").alias("v"))
    return found.groupBy("p_partkey").agg(F.array_join(F.sort_array(F.collect_set("v")), "; ").alias("found"))


_MAIL = "regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}')"
_MARKS = "(length(regexp_replace({0}, '[^.,]', '', 'g')))"


@query(f"""WITH m AS (SELECT doc_id, text, {_MAIL} AS mail, instr(text, {_MAIL}) - 1 AS place FROM documents)
SELECT doc_id, md5(text) AS digest, length(regexp_replace(text, '[^.,0-9]', '', 'g')) AS n_edits, NULL::VARCHAR AS refused,
  CASE WHEN mail <> '' THEN place + {_MARKS.format("text[1:place]")} END AS mail_start, CASE WHEN mail <> '' THEN place + length(mail) + {_MARKS.format("text[1:place + length(mail) - 1]")} END AS mail_end FROM m""")
def canonical_texts(spark, sf_dir: str) -> DataFrame:
    """Documents with hidden characters before their marks and wide digits, read in one form; places lead back to the raw text."""
    raw = F.translate(F.regexp_replace("text", "([.,])", "\u200b$1"), "0123456789", "０１２３４５６７８９")
    got = reading.canonical_texts(docs(spark, sf_dir).select("doc_id", raw.alias("text")))
    mail = F.regexp_extract("text", T.EMAIL, 0)
    at = F.when(mail != "", F.instr(F.col("text"), mail) - 1)
    back = lambda x: F.when(x.isNotNull(), reading.raw_offset(F.col("edits"), x)).cast("long")
    return got.select("doc_id", F.md5("text").alias("digest"), F.size("edits").cast("long").alias("n_edits"), "refused", back(at).alias("mail_start"), (back(at + F.length(mail) - 1) + 1).alias("mail_end"))


@query("SELECT kind, count(*) AS planted, CASE WHEN kind = 'keep' THEN 0 ELSE count(*) END AS caught, 0::BIGINT AS false_hides FROM documents, (VALUES ('NAME'), ('MRN'), ('DOB'), ('keep')) v(kind) WHERE kind <> 'DOB' OR doc_id % 2 = 0 GROUP BY kind")
def planted_identifiers(spark, sf_dir: str) -> DataFrame:
    """Identifiers planted behind every document's own text that the shield hides, and look-alikes that it leaves alone."""
    key = (F.col("doc_id") + 1000000).cast("string")
    name = F.concat(F.lit("Ana Zq"), F.translate(F.col("doc_id").cast("string"), "0123456789", "abcdefghij"))
    form = F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit("\nName          MRN          DOB\n{{NAME|"), name, F.lit("}}   {{MRN|"), key, F.lit("}}   {{DOB|3/4/1950}}"))
    ).otherwise(F.concat(F.lit("\nPatient: {{NAME|"), name, F.lit("}}\nMRN\u200b: {{MRN|"), F.translate(key, "0123456789", "０１２３４５６７８９"), F.lit("}}")))
    marked = docs(spark, sf_dir).select("doc_id", F.concat(F.regexp_replace("text", "\\{\\{|\\[\\[", "("), form, F.lit("\nTake [[dose|500 mg]] at noon.")).alias("text"))
    plants = written(shield.planted(marked, "doc_id"), "plants")  # read three times below
    hidden = shield.shield(plants.select("doc_id", F.lit(0).alias("turn"), "text"), "doc_id", "turn")
    return shield.hide_rates(plants, hidden, "doc_id")


@query()
def lines_on_photo(spark, sf_dir: str) -> DataFrame:
    """Every clause of every document found again among the words of a damaged copy: words lost, misread and added."""
    hurt = lambda w, i, n: (
        F.when((i + n) % 13 == 5, F.lit(None).cast("string")).when(((i + n) % 7 == 3) & (F.length(w) >= 8), F.concat(F.substring(w, 1, 3), F.lit("x"), F.substring(w, F.lit(5), F.length(w)))).when((i + n) % 17 == 4, F.concat(w, F.lit(" ~ zz"))).otherwise(w)
    )
    lines = F.split("text", "\n")
    damaged = F.flatten(F.transform(lines, lambda x, n: F.transform(F.split(F.array_join(F.transform(F.filter(F.split(x, "\\s+"), lambda w: w != ""), lambda w, i: hurt(w, i, n)), " "), " "), lambda w: F.struct(w.alias("text"), n.alias("line")))))
    rows = docs(spark, sf_dir).where("text IS NOT NULL").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "doc_id").select("doc_id", "text", alignment.clauses_as_quotes("text").alias("quotes"), F.filter(damaged, lambda w: w["text"] != "").alias("read"))
    return alignment.place_quotes(rows, "doc_id").select("doc_id", "pos", "status", "first", "last", "matched", "total")
