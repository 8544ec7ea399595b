import random
import re
import time
import zipfile

from pyspark.sql import functions as F

from quillstone.functions import fields as R
from quillstone.functions import text as T
from quillstone.operators import coverage, grounding, intervals, nearest, quantiles, shield, suppression
from quillstone.sources import files
from quillstone.streaming import quotas, reservations, scanner, sessions


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_grounding_boundaries():
    at = lambda source, quote: grounding.find_span(grounding.Source(source), quote)
    assert at("Swallow 350 units nightly", "50 units") is None
    assert at("Swallow 7.25 units", "25 units") is None
    assert at("Swallow 3/8 cup", "8 cup") is None and at("Swallow 3 / 8 cup", "8 cup") is None
    assert at("they forsake it all", "sake it") is None
    assert at("Keep  the WOUND\ndry.", "the wound dry") == (6, 19)
    assert at("Rest the arm. Then lift it.", "Rest the arm ... lift it") == (0, 26)
    assert at("abc", "a ... b") is None and at("", "abc") is None
    assert at("ΟΔΟΣ 12", "οδος 12") == (0, 7)
    assert at("彼は日本語を話します。", "日本語") == (2, 5)


def test_grounded_slices_normalise_to_their_fragment():
    r = random.Random(4)
    for _ in range(300):
        words = [r.choice(["İx", "mg", "10", "ﬁn", "take", "—", "’s", "日本", "é"]) for _ in range(12)]
        source = " ".join(words)
        a = r.randrange(len(words) - 2)
        quote = " ".join(words[a : a + 3])
        span = grounding.find_span(grounding.Source(source), quote)
        if span:
            assert grounding.mapped(source[span[0] : span[1]])[0].strip("\"' ") == grounding.parts(quote)[0]


def test_matcher_stays_within_two_steps_a_unit():
    for text, part in (("a" * 40_000, "a" * 600), ("ab" * 20_000, "ab" * 300 + "c"), ("aab" * 13_000, "aabaaa"), ("x" * 40_000, "y" * 600)):
        count = [0]
        places = list(grounding.occurrences(text, part, 0, count))
        assert places == [m.start() for m in re.finditer(f"(?={part})", text)] if len(part) < 10 else True
        assert 0 < count[0] <= 2 * (len(text) + len(part))
    source = grounding.Source("a" * 40_000)
    assert grounding.find_span(source, "a" * 600) is None  # inside a word at every place
    assert grounding.occurrences("abc", "") and list(grounding.occurrences("abc", "")) == []


def test_grounding_across_loses_nothing(spark, monkeypatch):
    texts = ["彼は日本語を話します。", "ὁδός ΟΔΟΣ end", "unbreakable", "one two three four", None, "", "the the the"]
    quotes = ["日本語", "οδος", "break", "two three", "the the", "missing here", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = spark.createDataFrame(list(enumerate(quotes)), "item_id long, quote string")
    want = {(i, j) for i, t in enumerate(texts) for j, q in enumerate(quotes) if t and q and (grounding.find_span(grounding.Source(t), q) or q in t)}
    for size in (2_000_000, 5):
        monkeypatch.setattr(grounding, "BLOCK_CHARS", size)
        assert {(r.doc_id, r.item_id) for r in grounding.ground_across(docs, "doc_id", asked, "item_id").collect()} == want
    assert (0, 0) in want and (1, 1) in want and (2, 2) in want  # part of a word is exact, though not grounded


def test_verification_by_sentences(spark):
    text = "Rest the arm. Then lift it slowly. W" + "ord word " * 100 + "end."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    quotes = ["Rest ... arm", "Rest the arm ... lift it", "lift it", "word word", "absent words"]
    asked = spark.createDataFrame([(1, text, q) for q in quotes], "doc_id long, text string, quote string")
    found = grounding.verified(grounding.ground(asked, ["doc_id", "quote"]), coverage.split_sentences(docs, "doc_id"), "doc_id").collect()
    assert {r.quote: r.status for r in found} == dict(zip(quotes, ["grounded", "skips_across", "grounded", "sentence_too_long", "not_found"], strict=True))
    assert {r.quote: (r.s_start, r.s_end) for r in found}["lift it"] == (14, 34)


def test_coverage_wants_what_is_critical(spark):
    text = "Take 2 pills for 10 days. Do not drive. Call the office."
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    s = coverage.split_sentences(docs, "doc_id").withColumn("reason", coverage.instruction_reason(F.col("sentence"))).where("reason IS NOT NULL")
    for quote, n in (("Take 2 pills", 0), ("Take 2 pills for 10 days", 1), ("drive", 0), ("Do not drive. Call", 2)):
        found = grounding.ground(docs.withColumn("quote", F.lit(quote)), ["doc_id"])
        assert coverage.coverage_ratio(coverage.coverage(s, found, "doc_id"), "doc_id").first()[1:] == (3, n), quote


def test_patterns_are_linear():
    began = time.perf_counter()
    for text in ("!" * 20_000 + "x", '."' * 10_000 + "x", "a" * 20_000, "a." * 10_000, "x\n" * 10_000, "1/" * 10_000, " " * 20_000):
        coverage.sentences_of(text)
        grounding.find_span(grounding.Source(text), "zzz")
        [list(re.finditer(p, text)) for _, p in shield.PATTERNS]
    assert time.perf_counter() - began < 5


def test_sentences():
    s = "Dr. Smith said: rest. Take 0.5 mg\ndaily. Call us!\n\nWarning\n12345\n"
    assert [s[a:b] for a, b in coverage.sentences_of(s)] == ["Dr. Smith said: rest.", "Take 0.5 mg\ndaily.", "Call us!", "Warning"]
    assert coverage.sentences_of("") == []


def test_instruction_reasons(spark):
    rows = [("Take one tablet.", "imperative"), ("Billing code 12.", None), ("If you feel worse you may call.", "conditional"), ("It is 5 mg in all.", "dose_or_timing"), ("Medicines", None), ("", None)]
    df = spark.createDataFrame([(t,) for t, _ in rows], "s string")
    assert [r[0] for r in df.select(coverage.instruction_reason(F.col("s"))).collect()] == [x for _, x in rows]


def test_shield_round_trip(spark):
    rows = [
        (1, 0, "Patient: Ana Lopez, DOB: 01/02/1970, MRN: AB12345. Mail ana@x.org."),
        (1, 1, "Ana Lopez called 404-555-1234; AB12345 again, not AB123456."),
        (2, 0, "AB12345 is not known here"),
        (3, 0, None),
    ]
    turns = spark.createDataFrame(rows, "s long, t long, text string")
    hidden = shield.shield(turns, "s", "t")
    got = {(r.s, r.t): r for r in hidden.collect()}
    assert "Ana Lopez" not in got[1, 1].redacted and "AB123456" in got[1, 1].redacted
    assert got[2, 0].redacted == "AB12345 is not known here" and got[3, 0].redacted == ""
    back = {(r.s, r.t): r.text for r in shield.restore(hidden, shield.learnt(turns, "s", "t"), "s").collect()}
    assert back == {(s, t): x or "" for s, t, x in rows}
    seg = got[1, 1].segments[0]
    df = hidden.where("s = 1 AND t = 1").select(shield.to_original(F.col("segments"), F.lit(seg.r_end)).alias("o"))
    assert df.first().o == seg.end
    assert [one(spark, shield.letters(F.lit(i))) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_suppression_never_leaves_a_small_difference(spark):
    r = random.Random(1)
    for _ in range(4):
        rows = []
        for i in range(r.randint(1, 6)):
            n = r.choice([12, 15, 30, 100])
            week = r.randint(0, n)
            rows.append((f"l{i}", min(week, h := r.randint(0, n)), week, h, n))
        rows = [(k, min(a, c), b, c, d) for k, a, b, c, d in rows]
        names = ["lang", *suppression.COLUMNS]
        cells = [x.asDict() for x in suppression.suppressed_funnel(spark.createDataFrame(rows, names), "lang").collect()]
        counts = {x[0]: dict(zip(names, x, strict=True)) for x in rows} | {"": {c: sum(x[i + 1] for x in rows) for i, c in enumerate(suppression.COLUMNS)}}
        for c in suppression.COLUMNS:
            total = next(x for x in cells if x["lang"] == "")
            off = [counts[x["lang"]][c] for x in cells if x["lang"] and not x[c].isdigit()]
            assert not total[c].isdigit() or not off or len(off) >= 2 and sum(off) >= suppression.SMALL
        for x in cells:
            for a, b in suppression.PARTS:
                assert not (x[a].isdigit() and x[b].isdigit()) or int(x[a]) - int(x[b]) >= suppression.SMALL


def test_breakdown_hides_as_much_as_one_after_another(spark):
    r = random.Random(2)
    for _ in range(6):
        rows = [(f"k{i}", r.choice([1, 3, 9, 10, 11, 40])) for i in range(r.randint(1, 6))]
        hidden = [n for _, n in rows if n < suppression.SMALL]
        left = sorted((n, k) for k, n in rows if n >= suppression.SMALL)
        names = set()
        while hidden and sum(hidden) < suppression.SMALL and left:  # the smallest first until the hidden ones are enough
            n, k = left.pop(0)
            hidden.append(n)
            names.add(k)
        got = {x.k: x.cell for x in suppression.breakdown(spark.createDataFrame(rows, "k string, n long"), "k", "n").collect()}
        assert {k for k, c in got.items() if c == "hidden"} == names


def test_medians(spark):
    import statistics

    r = random.Random(9)
    rows = [(f"g{n}", float(r.randrange(n + 3))) for n in (1, 2, 3, 10, 2001, 2500) for _ in range(n)] + [("g1", None), ("none", None)]
    got = {x.g: x.median for x in quantiles.medians(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert got == {g: statistics.median([v for k, v in rows if k == g and v is not None]) for g in got} and len(got) == 6


def test_intervals(spark):
    df = spark.createDataFrame([("a", 1, 3), ("a", 3, 5), ("a", 2, 4), ("a", 7, 8), ("b", 0, 1)], "k string, start long, end long")
    assert sorted(map(tuple, intervals.merged(df, "k").collect())) == [("a", 1, 5), ("a", 7, 8), ("b", 0, 1)]
    arrays = df.groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("r")).select("k", intervals.merge_array(F.col("r")).alias("m"))
    assert {r.k: [tuple(x) for x in r.m] for r in arrays.collect()} == {"a": [(1, 5), (7, 8)], "b": [(0, 1)]}


def test_nearest_place_at_any_distance(spark):
    from quillstone.functions.geo import metres

    r = random.Random(4)
    # the second site is 118 km to the east, the first 112 km to the north; the rest lie far away and beyond the date line
    sites = [(1, 31.007, -90.0), (2, 30.0, -88.775), (3, 30.0, -88.775), (4, 10.0, 179.9), (5, -60.0, 20.0), (6, None, 3.0)]
    asked = [(0, 30.0, -90.0), (1, 10.0, -179.9), (2, 89.0, 10.0), (3, None, 1.0)] + [(i, r.uniform(-85, 85), r.uniform(-180, 180)) for i in range(4, 60)]
    points = spark.createDataFrame(asked, "id long, lat double, lng double")
    places = spark.createDataFrame(sites, "site long, p_lat double, p_lng double")
    pairs = points.crossJoin(places).withColumn("m", metres(F.col("lat"), F.col("lng"), F.col("p_lat"), F.col("p_lng"))).where("m IS NOT NULL").collect()
    want = {i: min((p.m, p.site) for p in pairs if p.id == i) for i in {p.id for p in pairs}}
    got = nearest.nearest_place(points, "id", places, "site").collect()
    assert len(got) == len(want) == 59 and {g.id: (g.metres, g.site) for g in got} == want
    assert want[0][1] == 1 and want[1][1] == 4
    assert nearest.nearest_place(points, "id", places.limit(0), "site").count() == 0


def test_ranges_values_and_flags(spark):
    verdict = lambda v, r: one(spark, T.classify(T.parse_value(F.lit(v)), T.parse_range(F.lit(r))))
    assert [verdict("126", "70-99"), verdict("<0.5", "0.4 - 4.0"), verdict("5", "< 5"), verdict("5", "<=5"), verdict("1,200", "1,000 to 1,500"), verdict(">=200", "<200"), verdict("x", "1-2")] == [
        "high", "unknown", "high", "inside", "inside", "high", "unknown",
    ]
    flags = [one(spark, T.printed_flag(F.lit(t))) for t in ("126 H", "(L)", "high-density lipoprotein 50", "critical", "mg/L")]
    assert flags == ["high", "low", None, "abnormal", None]


def test_text_expressions(spark):
    assert one(spark, T.normalize(F.lit(" “ΟΔΟΣ” — x•y "))) == '"οδοσ" - x y'
    assert one(spark, T.numbers_in(F.lit("1,000 mg, 2.5 and twice"))) == ["1000", "2.5", "2"]
    assert [one(spark, T.to_24h(F.lit(t))) for t in ("8 AM", "12:30 pm", "12 am", "25")] == ["08:00", "12:30", "00:00", None]
    assert [one(spark, T.clock(F.lit(t))) for t in ("08:00", "12:30", "00:05")] == ["8am", "12:30pm", "12:05am"]
    assert [one(spark, T.phone(F.lit(t))) for t in ("1 (404) 555-1234", "555")] == ["404-555-1234", ""]
    assert one(spark, T.occurs_once(F.lit("abcabc"), F.lit("abc"))) is False and one(spark, T.occurs_once(F.lit("abcab"), F.lit("abc"))) is True
    languages = {"the cat and the dog of it": "en", "우리는 물을 마신다": "ko", "": "", "der die das und": "", "日本語を話す": "", "我们喝水": "zh", "ውሃ እንጠጣለን": "am", "các bạn và người của tôi là": "vi", "Привет мир": ""}
    assert {t: one(spark, T.detect_language(F.lit(t))) for t in languages} == languages
    assert one(spark, T.html_text(F.lit("<style>a</script>b</style><p>x &amp;lt; &#233;&nbsp;&#0;y</p>"))) == "x &lt; é y"
    long = "aaaa " * 30
    assert one(spark, T.short_quote(F.lit(long), 12)) == "aaaa aaaa…" and one(spark, T.short_quote(F.lit("x" * 90), 12)) == "x" * 90
    assert one(spark, T.span_context(F.lit("a\nb\nc\nd"), F.lit(4), F.lit(5), 1)).asDict() == {"before": "b\n", "quote": "c", "after": "\nd"}
    assert one(spark, T.strip_ids(F.lit("Rest (item-4, and item-5). See item id x-1 now ."), F.array(F.lit("item-4"), F.lit("item-5"), F.lit("x-1")))) == "Rest. See now."
    assert [one(spark, T.unreadable(F.lit(t))) for t in ("plain é 日", "zero\u200bwidth", "сyrillic", "٣")] == [False, True, True, True]
    assert one(spark, T.without_placeholders(F.lit("Ask ⟦NAME_A⟧ , then rest"))) == "Ask, then rest"
    assert one(spark, T.mask_numbers(F.lit("call 1234567 or 123"))) == "call ##### or 123"


def test_quotas_batch(spark):
    rows = [(1, i, float(t)) for i, t in enumerate([0, 1, 2, 3, 11, 12, 13])]
    df = spark.createDataFrame(rows, "k long, event_id long, s double").withColumn("ts", F.expr("timestampadd(SECOND, CAST(s AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')"))
    got = [r.accepted for r in quotas.sliding_limit(df, "k", 2, 10).orderBy("event_id").collect()]
    assert got == [True, True, False, False, True, True, False]
    got = [r.accepted for r in quotas.ttl_counter(df, "k", 2, 10).orderBy("event_id").collect()]
    assert got == [True, True, False, False, True, True, False]


def test_streams_equal_batch(spark, tmp_path):
    rows = [(r, i, c) for r in (1, 2) for i, c in enumerate(re.findall(r"(?s).{1,5}", '{"n": "[{", "items": [{"a": "}"}, {"b": [{}]}], "other": [{"c": 1}]}'))]
    df = spark.createDataFrame(rows, "req long, seq long, chunk string")
    batch = sorted(map(tuple, scanner.scanned(df, "req", "seq").collect()))
    assert batch == [(r, i, x) for r in (1, 2) for i, x in enumerate(['{"a": "}"}', '{"b": [{}]}'])]
    df.where("seq < 5").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    df.where("seq >= 5").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = scanner.scanned_stream(stream, "req", "seq").writeStream.format("memory").queryName("scanned").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("scanned").collect())) == batch


def test_reservations(spark):
    ask = lambda b, n, cap=10: {"bucket": b, "win": 0, "amount": n, "cap": cap}
    log = [("x", 0, "reserve", [ask("a", 6), ask("b", 6)]), ("x", 1, "reserve", [ask("a", 4), ask("b", 5)]), ("x", 2, "reserve", [ask("a", 4)]), ("x", 3, "adjust", [ask("b", -9)]), ("x", 4, "reserve", [ask("b", 10)]), ("y", 0, "reserve", [ask("a", 11)])]
    df = spark.createDataFrame(log, "scope string, seq long, op string, asks array<struct<bucket:string,win:long,amount:long,cap:long>>")
    got = {(r.scope, r.seq): (r.ok, r.full) for r in reservations.replay(df, "scope").collect()}
    assert got == {("x", 0): (True, ""), ("x", 1): (False, "b"), ("x", 2): (True, ""), ("x", 3): (True, ""), ("x", 4): (True, ""), ("y", 0): (False, "a")}


def test_sessions_batch_and_stream(spark, tmp_path):
    log = [("start", 0), ("attempt", 1), ("ringing", 2), ("placed", 3), ("talking", 4), ("start", 5), ("attempt", 6), ("attempt", 7), ("attempt", 8), ("done", 9), ("ringing", 10), ("start", 11), ("talking", 200_000)]
    rows = [(1, i, k, float(t)) for i, (k, t) in enumerate(log)] + [(2, 99, "talking", 0.0)]
    df = spark.createDataFrame(rows, "s long, event_id long, kind string, t double").withColumn("ts", F.expr("timestampadd(SECOND, CAST(t AS INT), TIMESTAMP_NTZ '2024-01-01 00:00:00')"))
    got = sorted(map(tuple, sessions.sessions(df, "s").collect()))
    assert [g[-1] for g in got] == ["applied", "applied", "applied", "no_move", "applied", "already_live", "applied", "applied", "too_many", "applied", "finished", "applied", "stale", "unknown"]
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = sessions.sessions_stream(stream, "s").writeStream.format("memory").queryName("called").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(120) and sorted(map(tuple, spark.table("called").collect())) == got


def test_more_files(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("stops.txt", "\ufeffid,lat,x\n1,2.5,q\n2,,r\n")
    assert sorted(map(tuple, files.read_zip_members(spark, str(tmp_path / "a.zip"), "stops.txt", ["id", "lat"]).collect())) == [("1", "2.5"), ("2", "")]
    assert files.read_zip_members(spark, str(tmp_path / "a.zip"), "none.txt", ["id"]).count() == 0
    (tmp_path / "n.json").write_text('{"rows": [{"a": 1, "b": [1]}, {"a": 2}]}')
    assert sorted(r.a for r in files.read_nested(spark, str(tmp_path / "n.json"), "rows").collect()) == [1, 2]
    whole = '{"a": 1}\n{"a": 2}\n{"a":'
    chunks = spark.createDataFrame([(r, i, c) for r in (1, 2) for i, c in enumerate(re.findall(r"(?s).{1,5}", whole))], "r long, seq long, chunk string")
    assert sorted(map(tuple, files.lines_of_chunks(chunks, "r", "seq").collect())) == [(r, i, x) for r in (1, 2) for i, x in enumerate(whole.split("\n"))]
    saved = spark.createDataFrame([(1, '{"id": "p", "title": "T"}'), (2, '{"id": "q", "name": "old"}'), (3, "{bad"), (4, '{"title": "x"}')], "n long, raw string")
    schema = files.T.StructType([files.T.StructField("id", files.T.StringType()), files.T.StructField("title", files.T.StringType())])
    assert sorted((r.n, r.id, r.title) for r in files.read_saved(saved, "raw", schema, ["id"], {"title": "name"}).collect()) == [(1, "p", "T"), (2, "q", "old")]
    known = spark.createDataFrame([("k1", 5)], "nonce string, rating int")
    new = spark.createDataFrame([("k1",), ("k2",), ("k2",), (None,), (None,)], "nonce string")
    assert sorted((r.nonce or "", r.rating) for r in files.record_once(new, known, "nonce").collect()) == [("", None), ("", None), ("k2", None)]
    files.write_report(known, str(tmp_path / "report"), ["nonce"])
    assert spark.read.json(str(tmp_path / "report")).count() == 1


def test_shield_fields_spread_over_columns(spark):
    df = spark.createDataFrame([(1, 0, "Patient: Ana Lopez", "for Ana Lopez"), (1, 1, "Ana Lopez again", None)], "s long, t long, title string, note string")
    got = {r.t: (r.title, r.note) for r in shield.shield_fields(df, "s", "t", ["title", "note"]).collect()}
    assert got == {0: ("Patient: ⟦NAME_A⟧", "for ⟦NAME_A⟧"), 1: ("⟦NAME_A⟧ again", "")}


def test_field_expressions(spark):
    assert [one(spark, R.network(F.lit(x))) for x in ("1.2.3.4", "::ffff:9.8.7.6", "2001:db8::1", "A:0b:00c:d:1:2:3:4", "::1")] == ["1.2.3.4", "9.8.7.6", "2001:db8:0:0::/64", "a:b:c:d::/64", "0:0:0:0::/64"]
    week = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    hours = lambda texts: spark.createDataFrame([([(d, t) for d, t in zip(week, texts, strict=False)],)], "h array<struct<day:string,hours:string>>").select(T.opening_periods(F.col("h")).alias("p"))
    got = hours(["8 to 11 AM, 1 PM to 5:30 PM"] + ["Closed"] * 6).first().p
    assert [tuple(p) for p in got] == [(0, "08:00", "11:00"), (0, "13:00", "17:30")]
    assert hours(["Open 24 hours"] * 7).first().p is None and hours(["9 AM to 5 PM"] * 6).first().p is None
    assert [one(spark, R.date_is_plausible(F.lit(x))) for x in ("01/02/1970", "31/12/99", "2020-02-03", "45/45/1990", "1/2")] == [True, True, True, False, False]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id ,name\n1,\"x, y\"\n")
    assert [tuple(r) for r in files.read_delimited(spark, str(tmp_path / "a.csv"), ["id", "name"]).collect()] == [("1", "x, y")]
    (tmp_path / "p.json").write_text('{"cols": ["a", "b"], "rows": [[1, "x"], [2]]}')
    assert [tuple(r) for r in files.read_positional(spark, str(tmp_path / "p.json")).collect()] == [("1", "x"), ("2", None)]
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, t string")
    files.write_lines(df, str(tmp_path / "lines"))
    assert sorted(map(tuple, files.read_events(spark, str(tmp_path / "lines"), df.schema).collect())) == [(1, "a"), (2, "b")]
    assert [r.value for r in files.write_positional(df).orderBy("value").collect()] == ['["1","a"]', '["2","b"]']
    assert one(spark, files.calendar_escape(F.lit("a,b;c\\d\ne"))) == "a\\,b\\;c\\\\d\\ne"
    folded = files.calendar_fold("é" * 100)
    assert all(len(line.encode()) <= 75 for line in folded.split("\r\n")) and folded.replace("\r\n ", "") == "é" * 100
