"""Figures of round 3 that must not come back: work that grew faster than its input."""

import pytest
from pyspark.sql import functions as F

from quillstone.operators import nearest


def widest_join(spark, run):
    """The most pairs that one of run's joins by cell compares, seen through nearby."""
    seen, plain = [], nearest.nearby

    def counted(points, places, max_km, box=(nearest.BOX_LAT, nearest.BOX_LNG)):
        cell = lambda lat, lng: (F.floor(F.col(lat) / box[0]).alias("y"), F.floor(F.col(lng) / box[1]).alias("x"))
        a, b = points.groupBy(*cell("lat", "lng")).count(), places.groupBy(*cell("p_lat", "p_lng")).agg(F.count(F.lit(1)).alias("m"))
        seen.append(a.join(b, ["y", "x"]).agg(F.sum(F.col("count") * F.col("m"))).first()[0] or 0)
        return plain(points, places, max_km, box)

    nearest.nearby = counted
    try:
        run().count()
    finally:
        nearest.nearby = plain
    return max(seen)


@pytest.mark.parametrize("name", ["k_nearest", "nearest_place"])
def test_nearest_work_grows_with_points_only(spark, name):
    def run(n):
        places = spark.range(n).select(F.col("id").alias("p"), (30 + F.col("id") * 7919 % 6000 / 1000.0).alias("p_lat"), (-90 + F.col("id") * 104729 % 9000 / 1000.0).alias("p_lng"))
        points = spark.range(500).select("id", (30 + F.col("id") * 6101 % 6000 / 1000.0).alias("lat"), (-90 + F.col("id") * 75533 % 9000 / 1000.0).alias("lng"))
        return lambda: nearest.k_nearest(points, "id", places, "p", 4, 60.0) if name == "k_nearest" else nearest.nearest_place(points, "id", places, "p")

    few, many = widest_join(spark, run(1_000)), widest_join(spark, run(16_000))
    assert many <= 4 * few, (few, many)


def test_k_nearest_is_the_plain_answer_where_places_are_dense_and_lone(spark):
    places = spark.range(400).select(F.col("id").alias("p"), (50 + F.col("id") % 20 / 1e4).alias("p_lat"), (5 + F.floor(F.col("id") / 40) / 1e4).alias("p_lng"))
    places = places.union(spark.createDataFrame([(1000, 50.4, 5.0), (1001, 50.4, 5.0), (1002, None, 5.0)], places.schema))
    points = spark.createDataFrame([(1, 50.0005, 5.0003), (2, 50.45, 5.0), (3, 50.9, 5.0), (4, None, 5.0), (5, 50.2, 5.0)], "id long, lat double, lng double")
    got = nearest.k_nearest(points, "id", places, "p", 4, 60.0).select("id", "p", "rank").collect()
    plain = nearest.nearby(points, places, 60.0).orderBy("id", "km", "p").select("id", "p").collect()
    expected = [(i, p, n + 1) for i in (1, 2, 3, 5) for n, p in enumerate([r.p for r in plain if r.id == i][:4])]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_equal_result_lines_are_read_once(monkeypatch):
    import pandas as pd

    from quillstone.operators import labs

    asked, plain = [], labs.read_line
    monkeypatch.setattr(labs, "read_line", lambda *x: asked.append(x) or plain(*x))
    monkeypatch.setattr(labs.F, "pandas_udf", lambda kind: lambda f: f)
    columns = [pd.Series(x * 500, dtype=object) for x in (["Test B 5 1-9 mg/dL", "Test C 12 1-9 mg/dL H", None], ["Test B", "Test C", None], ["mg/dL"] * 3, ["", None, ""])]
    got = labs.read_lines(*columns)
    assert len(asked) == 3
    assert got["status"].tolist() == ["inside", "outside", "unknown"] * 500


def test_ascii_texts_map_as_others_do():
    from quillstone.operators import grounding

    def slow(source):  # a letter that is not ASCII takes the general way
        norm, origin = grounding.mapped(source + "é")
        return norm[:-1], list(origin)[:-1]

    for text in ("", " ", "\t\n A  b\x0b\x0cC\r\n", "Take 5 mg", "a\x1fb\x00C", "  x  "):
        norm, origin = grounding.mapped(text)
        assert (norm, list(origin)) == slow(text), repr(text)
    assert isinstance(grounding.mapped("Take 5 mg")[1], range)


def test_time_words_compile_no_pattern_a_row(spark):
    from quillstone.functions import cues

    texts = ["Do not come back in 3 days.", "Do\0not come back in 3 days.", "Come back in 3 days.", "Rest.", "Call today; not tomorrow"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(cues.when_told(F.col("t")).alias("w"))
    assert [r.w["group"] for r in df.collect()] == ["unclear", "unclear", "soon", "unclear", "unclear"]
    assert "split(lambda" not in df._jdf.queryExecution().analyzed().toString()


def test_quiz_reads_the_amounts_of_a_wrong_option_once(spark, monkeypatch):
    from quillstone.operators import drafts

    asked, plain = [], drafts.amounts
    monkeypatch.setattr(drafts, "amounts", lambda c: asked.append(1) or plain(c))
    steps, questions = "array<struct<step:int,quote:string>>", "array<struct<step:int,question:string,options:array<string>,correct:int,proof:string>>"
    paper = ("Take 2 cups with 3 pills.", [(1, "Take 2 cups with 3 pills.")], [(1, "How many?", ["2 cups", "2 and 3", "none"], 0, "2 cups with 3 pills")])
    got = drafts.checked_questions(spark.createDataFrame([(7, *paper)], f"k int, text string, steps {steps}, drafts {questions}"), "k").first()
    assert got.reason == "distractor_matches_quote"
    assert len(asked) == 3


def test_equal_clauses_are_laid_over_a_page_once_and_all_of_one_size_together(monkeypatch):
    from quillstone.operators import alignment as A

    calls, plain = [], A.aligned
    monkeypatch.setattr(A, "aligned", lambda jobs, n, m: calls.append(len(jobs)) or plain(jobs, n, m))
    lines = ["red green blue brown", *["stop the pills at noon"] * 40, *[f"{c}qu {c}zz {c}vo {c}k" for c in "abcdefghijlmnoprstuw"]]
    text, quotes, at = "\n".join(lines), [], 0
    for line in lines:
        quotes.append((at, at + len(line)))
        at += len(line) + 1
    got = list(A.placed_rows(iter([(1, text, quotes, [(w, n) for n, line in enumerate(lines) for w in line.split()])])))
    first = [sum(len(x.split()) for x in lines[:i]) for i in range(len(lines))]
    assert [r[4:7] for r in got] == [("found", a, a + len(x.split()) - 1) for a, x in zip(first, lines, strict=True)]
    assert len(calls) <= 3, calls  # before: one for each of the 61 clauses


def test_close_words_are_those_of_the_edit_distance():
    from random import Random

    from quillstone.operators import alignment as A

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, before = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
        return row[-1]

    draw = Random(3)
    word = lambda: "".join(draw.choices("abcé", k=draw.randint(1, 13)))
    ours, theirs = sorted({word() for _ in range(150)}), sorted({word() for _ in range(150)})
    got = {w: sorted(some) for w, some in A.close_words(ours, theirs).items() if some}
    near = {w: sorted(v for v in theirs if v != w and len(v) >= 4 and distance(w, v) <= max(len(v), len(w)) // 4) for w in ours if len(w) >= 4}
    assert got == {w: some for w, some in near.items() if some}


def test_steps_of_a_paper_map_its_text_once(monkeypatch):
    from quillstone.operators import coverage, grounding, preparation

    mapped, plain = [], grounding.Source.__init__
    monkeypatch.setattr(grounding.Source, "__init__", lambda self, text: mapped.append(text) or plain(self, text))
    lines = [f"Stop item {i} {i + 1} days before your procedure." for i in range(1, 30)]
    text = "\n".join([*lines, "Rest the day before your test.", "Rest the day before your test."])
    source, sentences = grounding.Source(text), coverage.sentences_of(text)
    got = [preparation.placed(source, text, sentences, q) for q in [*lines, "rest the day", "item 77", "1", "Stop … days"]]
    assert [g and (g["slot"], g["reason"]) for g in got] == [*[("days_before", "placed")] * 29, (None, "repeated"), None, None, None]
    assert len(mapped) == 2, len(mapped)  # the paper, and what follows a quote that may stand there again; before: one more for each step


def test_labels_are_tried_only_where_one_may_begin():
    import re

    from quillstone.operators import layout, shield

    texts = ["Plain words of any kind. " * 400, "PATİENT: Ana Bell\nSſN 123-45-6789, called MRN 12345", "Medical  Record\nNumber: A 12345", "Medical Record\nNumber: A12345\nNgày sinh: 1/2/1990 date of birth 2/3/1991", "Dr. Ann Lee, aged 93 years, 555-123-4567"]
    for text in texts:
        plain = [(k, m.group(m.lastindex), m.start(m.lastindex)) for k, p in shield.PATTERNS for m in re.finditer(p, text)]
        found = [x for x in shield.identified(text) if x in plain]
        assert found == plain, text
    assert not layout.placed_values(texts[0]) and len(layout.placed_values(texts[3])) >= 1
    assert shield.beginnings(texts[0]) == {} and set(shield.beginnings(texts[1])) == {"MRN", "NAME", "SSN"}  # before: every pattern went over every text


def test_planted_texts_are_made_once(spark, tmp_path, monkeypatch):
    from quillstone.operators import shield
    from quillstone.plans import text

    spark.createDataFrame([(i, f"A text {i}.") for i in range(6)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = text.planted_identifiers(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {("NAME", 6, 6, 0), ("MRN", 6, 6, 0), ("DOB", 3, 3, 0), ("keep", 6, 0, 0)}
    assert "unmark" not in got._jdf.queryExecution().executedPlan().toString() and "{{NAME" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_letters_are_named_once():
    from quillstone.operators import languages as L

    L.is_latin.cache_clear()
    text = "La señal está aquí. " * 30
    assert L.tally(text) == L.tally(text)
    assert L.is_latin.cache_info().misses <= len(set(text))  # before: every text named its letters again
    assert L.tally("Tomé, ΟΔΟΣ! díá coöpe-\nrate") == [20, 16, 0, 20, 16, 0, 5, 0, 1, 0, 1, 0, 0, 2, 0, 0]


def test_parity_goes_over_the_documents_once(spark, tmp_path):
    from quillstone.plans import everyday

    spark.createDataFrame([(1, "Take 5 mg now. Rest."), (2, "Nothing.")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "Take 5 mg now.")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = everyday.parity_of_checkers(spark, str(tmp_path))
    assert [tuple(r) for r in got.collect()] == [(1, 7, True, True, True)]
    assert "MapIn" not in got._jdf.queryExecution().executedPlan().toString()


def test_sentences_are_cut_a_slice_at_a_time():
    import pyarrow as pa

    from quillstone.operators import coverage

    class Rows:  # hands over the function that Spark would run
        dtypes = [("doc_id", "bigint"), ("text", "string")]

        def select(self, *columns):
            return self

        def mapInArrow(self, f, schema):
            return f

    texts = ["Take 5 mg now. " * 30_000, None, "", "Rest. " * 100_000, "Go home. " * 80_000]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(5)), "text": texts}, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]))
    out = list(coverage.split_sentences(Rows(), "doc_id")(iter([batch])))
    assert len(out) >= 2 and max(b.num_rows for b in out) < 210_000  # before: all 210,000 rows in one frame
    assert sum(b.num_rows for b in out) == 210_000
    assert out[0].slice(0, 1).to_pylist() == [{"doc_id": 0, "pos": 0, "start": 0, "end": 14, "sentence": "Take 5 mg now.", "critical": [{"start": 5, "end": 6}]}]


def test_equal_topics_are_looked_for_in_equal_quotes_once(monkeypatch):
    from quillstone.operators import drafts, grounding

    asked, plain = [], drafts.find_span
    monkeypatch.setattr(drafts, "find_span", lambda *x: asked.append(x) or plain(*x))
    drafts.span_in.cache_clear()
    assert [drafts.span_in("Take item 5 with cups.", "cups") for _ in range(3)] == [(17, 21)] * 3 and len(asked) == 1
    assert grounding.parts("Take … item") is grounding.parts("Take … item")
    sentences = [(10 * i, 10 * i + 9) for i in range(6)]
    assert [drafts.around(sentences, s) for s in ((12, 15), (19, 20), (5, 31), (59, 70), (9, 10))] == [(10, 19), (19, 20), (0, 39), (59, 70), (9, 10)]


def most_held(run, batch):
    """The most bytes that Python and numpy hold while run goes over a batch, and what it yields."""
    import tracemalloc

    tracemalloc.start()
    try:
        out = list(run(iter([batch])))
        return tracemalloc.get_traced_memory()[1], out
    finally:
        tracemalloc.stop()


def test_language_model_steps_hold_slices_of_a_batch(spark, monkeypatch):
    from types import SimpleNamespace
    from unittest.mock import MagicMock

    import numpy as np
    import pyarrow as pa

    from quillstone.llm import ppm

    texts = [f"The {i} cups of water were taken with food. " * 100 for i in range(10_000)]
    size = sum(map(len, texts))
    counted, scored = MagicMock(), MagicMock()
    ppm.string_counts(counted)
    most, out = most_held(counted.select().mapInArrow.call_args.args[0], pa.record_batch({"text": texts, "is_train": [i % 5 > 0 for i in range(len(texts))]}))
    assert most < size, (most, size)
    assert all(b.num_rows <= ppm.HANDED for b in out)
    assert sum(int(np.sum(b.column("n").to_numpy())) for b in out) == sum(len(t) + 1 for i, t in enumerate(texts) if i % 5)

    monkeypatch.setattr(ppm, "written", lambda df, name: df)
    table = MagicMock(count=lambda: 1)
    table.select().toArrow.return_value = pa.table({"key": pa.array([1], pa.int64()), "logp": [0.0]})
    scored.sparkSession.sparkContext.broadcast = lambda x: SimpleNamespace(value=x, unpersist=lambda: None)
    ppm.model_scores(scored, table)
    most, out = most_held(scored.select().mapInArrow.call_args.args[0], pa.record_batch({"row": list(range(len(texts))), "text": texts}))
    assert most < size, (most, size)
    assert pa.Table.from_batches(out).column("row").to_pylist() == list(range(len(texts)))


def test_drafts_are_dealt_to_tasks_of_bounded_rows(spark, monkeypatch):
    from quillstone import session
    from quillstone.plans import everyday

    monkeypatch.setattr(session, "ROWS_A_PARTITION", 500, raising=False)
    got = everyday.checked_drafts(spark, "/root/testdata/sf0.001")
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 1_000, sizes
