"""Languages of papers, nested payloads, restated answers and plan events on small inputs."""

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quillstone.functions import answers, payload
from quillstone.operators import languages as L
from quillstone.streaming import plan_events

EN = "Take the tablet with food each day. Call your doctor if you have a fever. "
ES = "Tome la tableta con agua cada día por una semana. Llame al médico cuando tiene fiebre y dolor. "
FR = "Prenez le comprimé avec de l'eau chaque jour. Appelez votre médecin dans les deux jours. "
VI = "Uống một viên thuốc mỗi ngày với nước. Gọi bác sĩ nếu bạn bị sốt cao. "
KO = "매일 아침 물과 함께 한 알을 드십시오. 열이 나면 의사에게 전화하십시오. "


@pytest.mark.parametrize(
    "text, languages, photo",
    [
        (EN, ["en"], "eng"),
        (ES, ["es"], "spa"),
        (EN * 2 + ES * 2, ["en", "es"], "eng"),
        (FR, None, None),
        (VI, None, None),
        (KO, None, None),
        (EN * 5 + "Nehmen Sie die Tablette mit dem Wasser und nicht bei Fieber.", None, "eng"),  # one German sentence
        (EN * 2 + "Xray chest lungs clear bilaterally noted. Serum sodium potassium levels stable.", None, "eng"),  # two long ones unmarked
        (EN * 5 + "Xray chest lungs clear bilaterally noted. Serum sodium potassium levels stable.", ["en"], "eng"),
        ("12 34 !", None, "eng"),
        ("", None, "eng"),
        (None, None, "eng"),
    ],
)
def test_languages(spark, text, languages, photo):
    df = L.language_tallies(spark.createDataFrame([(1, text)], "id long, text string"), "id")
    row = df.select(L.checkable_languages().alias("l"), L.photo_language().alias("p")).first()
    assert (row.l, row.p) == (languages, photo)


def test_words_over_line_ends_and_accents():
    assert dict(zip(L.TALLIES, L.tally("mé-\n dico MÉDICO"), strict=True))["photo_es"] == 2
    assert L.letter_words("a²b Ünï_x 5mg") == ["a", "b", "ünï", "x", "mg"]


def test_strings_at_any_depth(spark):
    kind = S.StructType.fromDDL("a STRING, n INT, b ARRAY<STRUCT<c: STRING, d: MAP<STRING, ARRAY<STRING>>>>, e STRUCT<f: BIGINT>")
    value = {"a": "x", "n": 1, "b": [{"c": "y", "d": {"x": ["x", "z"]}}, {"c": None, "d": None}], "e": {"f": 2}}
    rows = spark.createDataFrame([(json.dumps(value),), ("null",), (None,), ("[broken",)], "j string")
    got = [r.v for r in rows.select(payload.map_json_strings(F.col("j"), kind, F.upper).alias("v")).collect()]
    assert json.loads(got[0]) == {"a": "X", "n": 1, "b": [{"c": "Y", "d": {"x": ["X", "Z"]}}, {}], "e": {"f": 2}}
    assert got[1] in (None, "{}") and got[2] is None and got[3] in (None, "{}")
    back = rows.limit(1).select(payload.put_back(F.lit("a [[T_1]] b"), F.array(F.struct(F.lit("[[T_1]]").alias("token"), F.lit("Ana").alias("value")))).alias("v"))
    assert back.first().v == "a Ana b"


def lines(**changes):
    one = {"text": "Take 5 mg.", "start": 0, "end": 10, "critical": [[5, 6]], "group": 0}
    two = {"text": "take  5 mg.", "start": 11, "end": 22, "critical": [], "group": 0}
    whole = {"show": True, "languages": ["en"], "quotes": {"q": [[0, 4]]}, "sentences": [one, two | changes.pop("second", {})]}
    return json.dumps({k: v for k, v in (whole | changes).items() if v is not None})


@pytest.mark.parametrize(
    "text, valid",
    [
        (lines(), True),
        (lines(quotes={}), True),
        (lines(show=False), False),
        (lines(show=None), False),
        (lines(languages=None), False),
        (lines(languages=["en", None]), False),
        (lines(quotes=None), False),
        (lines(quotes={"q": None}), False),
        (lines(quotes={"q": [[4, 4]]}), False),
        (lines(quotes={"q": [[-1, 2147483647]]}), False),
        (lines(quotes={"q": [[0, 1, 2]]}), False),
        (lines(sentences=[]), False),
        (lines(sentences=None), False),
        (lines(second={"end": 41}), False),
        (lines(second={"start": 1.5}), False),
        (lines(second={"text": "Other."}), False),
        (lines(second={"text": None}), False),
        (lines(second={"group": 2}), False),
        (lines(second={"group": -1}), False),
        (lines(second={"group": None}), False),
        (lines(second={"critical": [[10, 12]]}), False),
        (lines(second={"critical": None}), False),
        (lines(second={"group": 1, "text": "Other."}), True),
        ("[]", False),
        ("{", False),
        (None, False),
    ],
)
def test_payload_rules(spark, text, valid):
    df = spark.createDataFrame([(text, 40)], "j string, n int")
    assert df.select(payload.valid_missed_lines(F.col("j"), F.col("n")).alias("v")).first().v is valid


OPTIONS = ["Take 1 tablet 2 times a day", "Take 2 tablets 1 time a day", "Take 1.5 tablets twice a day", "Do not take it with food", "Take it with food", "不吃药5毫克"]


@pytest.mark.parametrize(
    "said, place",
    [
        ("um I should take one tablet twice a day", 0),
        ("taking two tablets once a day", 1),
        ("Take one and a half tablets two times a day", 2),
        ("take 1 1/2 tablets twice a day", 2),
        ("take one point five tablets, twice a day", 2),
        ("take 1,5 tablets twice a day", 2),
        ("don’t take it with food", 3),
        ("take with food", 4),
        ("take without food", None),
        ("food with take", None),
        ("take 1 tablet 2 times a week", None),
        ("take 1.2.3 tablets twice a day", None),
        ("take 1/0 tablets", None),
        ("take point tablets", None),
        ("我不吃药5毫克了", 5),
        ("um, I think so", None),
        ("", None),
        (None, None),
    ],
)
def test_restated(said, place):
    assert answers.restated(said, OPTIONS) == place


def test_two_equal_options_and_nulls(spark):
    assert answers.restated("take one pill", ["take 1 pill", "Take one pill."]) is None
    rows = [(1, "take one pill", ["take 1 pill", None]), (2, None, ["x"]), (3, "x", None), (4, "x", [])]
    df = spark.createDataFrame(rows, "id long, a string, o array<string>")
    assert {r.id: r.p for r in df.select("id", answers.restated_option("a", "o").alias("p")).collect()} == {1: 0, 2: None, 3: None, 4: None}
    assert answers.reading("take 1,500 mg and 0,250 g")[0] == (("1500.0", "mg", "dose"), ("0.25", "g", "dose"))


def test_plan_events_batch_and_stream(spark, tmp_path):
    logs = {1: "start step step done step", 2: "step start", 3: "start step start step", 4: "start error start", 5: "odd", 6: "done"}
    rows = [(r, i, k) for r, log in logs.items() for i, k in enumerate(log.split())] + [(3, 9, None)]
    df = spark.createDataFrame(rows, "req long, seq long, kind string")
    shown = plan_events.previews(df, "req", "seq")
    got = sorted(map(tuple, shown.collect()))
    loop = []
    for r in logs:
        state = plan_events.UNBEGUN
        for q, i, k in rows:
            if q == r:
                state, outcome, n = plan_events.step(state, k)
                loop += [(q, i, outcome, n)] if outcome else []
    assert got == sorted(loop) and (3, 3, "preview", 1) in got and (1, 3, "finished", 2) in got
    ends = {r.req: (r.ending, r.n_steps) for r in plan_events.endings(shown, "req", "seq").collect()}
    assert ends == {1: ("finished", 2), 2: ("broken", 0), 3: ("cut_off", 1), 4: ("failed", 0), 6: ("finished", 0)}
    df.where("seq < 2").coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    df.where("seq >= 2").coalesce(1).write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = plan_events.preview_stream(stream, "req", "seq").writeStream.format("memory").queryName("plans").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert run.awaitTermination(120) and sorted(map(tuple, spark.table("plans").collect())) == got
