from pyspark.sql import functions as F

from quillstone.functions import views as V

PHONES = {
    "(404) 555-0199": None, "404-555-1999": "+14045551999", "+1 404 555 1999": "+14045551999", "1-404-555-1999": "+14045551999", "+404 555 1999": None, "+44 20 7946 0000": None, "911": None, "411-555-1234": None, "404-911-1234": None, "900-555-1234": None,
    "404-976-1234": None, "800-555-1234": None, "104-555-1234": None, "404-155-1234": None, "404-555-1999 ext 2": None, "": None, "4" * 41: None, None: None,
}
SEEN = {"Take 2 pills.": False, "Do not eat.": True, "Drink only water until noon.": True, "Call us.": True, "Recall the dose.": False, "Reach 404-555-0199.": True, "555.0199": True, "55.0199": False, "Go to the hospital.": True, "Avise a su médico.": True, "መድሃኒት ይውሰዱ": True, "": False}
NAMES = {
    ("HDL Cholesterol 38 mg/dL", "Cholesterol", "38"): "HDL Cholesterol", ("Vitamin B12 12 pg", "Vitamin", "12"): "Vitamin B12", ("CA-125 125 U", "CA-125", "125"): "CA-125", ("Glucose: 90", "glucose", "90"): "Glucose", ("Sodium   140", "Iron", "140"): "Sodium",
    ("Iron (total) high", "Iron", "7"): "Iron", ("Iron (total) high", "Iron", ""): "Iron", ("a.c 5", "a.c", "5"): "a.c", ("abc 5", "a.c", "5"): "abc 5",
}


def column(spark, rows, schema, made):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.x for r in df.select("i", made.alias("x")).orderBy("i").collect()]


def test_phones(spark):
    assert column(spark, [(p,) for p in PHONES], "p string", V.us_phone(F.col("p"))) == list(PHONES.values())


def test_must_see(spark):
    assert column(spark, [(q,) for q in SEEN], "q string", V.must_see(F.lit("take"), F.col("q"))) == list(SEEN.values())


def test_names_as_printed(spark):
    assert column(spark, list(NAMES), "line string, test string, value string", V.printed_name(F.col("line"), F.col("test"), F.col("value"))) == list(NAMES.values())


def test_explanations_fail_closed(spark):
    rows = {
        ("Take 2.", "Take 2 pills.", False, False, "done", "certified"): "certified", ("Take 2.", "Take 2 pills.", True, True, "done", "certified"): "numbers", ("Take 2.", None, None, None, "done", "certified"): "none", ("Do not take 2.", "Take 2.", None, None, "done", "certified"): "negation",
        ("Take 2.", "Take 2 pills.", None, None, "done", None): "unclear", ("Take 2.", "Take 2 pills.", None, None, None, None): "unclear", ("Take 2.", "Take 2 pills.", None, None, "idle", "certified"): "checking", ("Take 2.", "Take 2 pills.", None, None, "error", "certified"): "check_failed",
        ("Take 2.", "Take 2 pills.", None, None, "done", "different"): "flagged", (None, "ይውሰዱ", None, None, "done", "certified"): "negation",
    }
    names = "quote told numbers cues reader verdict".split()
    schema = "quote string, told string, numbers boolean, cues boolean, reader string, verdict string"
    assert column(spark, list(rows), schema, V.explanation_state(*map(F.col, names))) == list(rows.values())


def test_settlement_of_a_paid_call(spark):
    rows = {("done", 12): (-8, -8), ("done", 40): (20, 620), ("failed_sent", 20): (0, 0), ("failed_sent", 25): (5, 0), ("not_sent", 20): (-20, 0)}
    got = column(spark, list(rows), "outcome string, heard int", V.budget_changes(F.col("outcome"), F.lit(20), F.col("heard"), F.lit(600), 35))
    assert [tuple(x) for x in got] == list(rows.values())


def test_questions_and_speech(spark):
    one = spark.range(1)
    step = lambda *x: V.step_question(*map(F.lit, x))
    strings = lambda *x: F.array(*map(F.lit, x)).cast("array<string>")
    steps = F.array(F.struct(F.lit("A").alias("title"), F.lit("do").alias("action"), strings("a", "b").alias("quotes")))
    row = one.select(
        step("medication", " Take\n2 ", True, "Why?", "certified").alias("own"), step("medication", " Take\n2 ", True, "Why?", "flagged").alias("rule"), step("warning_sign", "Bleeding", True, "Why?", "flagged").alias("warning"), step("diet", "Eat", False, "Why?", "certified").alias("clear"),
        V.general_questions(strings("WHY", "How?", "", None), strings("Why?", None)).alias("general"), V.plan_lines(F.lit("f"), F.lit("s"), steps, F.lit(True), F.lit(" r ")).alias("lines"), V.plan_lines(F.lit("f"), F.lit("s"), V.without_quotes(steps), F.lit(True), F.lit(" ")).alias("plain"),
        V.encoded(F.lit("a b/é+(c)!*~'")).alias("encoded"), V.public_call(F.lit(None).cast("string"), F.lit("4045551999"), F.lit(1), 3).alias("gone"), V.public_call(F.lit("code"), F.lit("4045551999"), F.lit(5), 3).alias("call"),
    ).first()
    assert (row.own, row.rule, row.warning, row.clear) == ("Why?", 'My paper says: "Take 2" Can you confirm what I should take?', None, None)
    assert row.general == ["How?"] and row.encoded == "a%20b%2F%C3%A9%2B(c)!*~'"
    assert row.lines == ["f", "s", "1. A. do", 'Your paper says: "a"', 'Your paper says: "b"', "This needs a person too: r"] and row.plain == ["f", "s", "1. A. do"]
    assert tuple(row.gone) == ("gone", None, None) and tuple(row.call) == ("code", "1999", 0)
