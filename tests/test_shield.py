import random

import pytest

from quillstone.operators import layout, reading, shield

ZW = "​"


def values(text):
    return {(k, v) for k, v, _ in shield.identified(reading.canonical(text).text)}


@pytest.mark.parametrize(
    "text,want",
    [
        ("DOB:\n01/02/1980\n", {("DOB", "01/02/1980")}),
        ("Medical Record\nNumber: 0041776\n", {("MRN", "0041776")}),
        ("Date of\nBirth: 3/4/1955", {("DOB", "3/4/1955")}),
        ("Name            DOB          MRN\nMaria Lopez     04/12/1961   88412907", {("NAME", "Maria Lopez"), ("NAME", "Maria"), ("NAME", "Lopez"), ("DOB", "04/12/1961"), ("MRN", "88412907")}),
        ("Name\tMRN\nana ruiz\t77712345", {("NAME", "ana ruiz"), ("NAME", "ana"), ("NAME", "ruiz"), ("MRN", "77712345")}),
        ("Patient name:\nLe Thi Hoa", {("NAME", "Le Thi Hoa"), ("NAME", "Le"), ("NAME", "Thi"), ("NAME", "Hoa")}),
        (f"MRN{ZW}: 1234567", {("MRN", "1234567")}),
        ("ＭＲＮ： １２３４５６７", {("MRN", "1234567")}),
        ("Paciente: José Ruiz\nFecha de\nnacimiento: 1/2/1970", {("NAME", "José Ruiz"), ("NAME", "José"), ("NAME", "Ruiz"), ("DOB", "1/2/1970")}),
    ],
)
def test_values_by_label_and_place(text, want):
    assert values(text) == want


@pytest.mark.parametrize("text", ["Name            Dose\nMetformin       500 mg", "DOB and name are on the card\nTake 2 pills", "Date of\nvisit: 01/02/2020", "MRN:\nClinic: open", "Item   Count\nName   DOB", "", "\n\n", "Phone calls\nare free"])
def test_look_alikes_stay(text):
    assert not {v for v in values(text) if v[0] != "NAME"} and "Metformin" not in {v for _, v in values(text)}


def turns(spark, rows):
    return spark.createDataFrame(rows, "s int, t int, text string")


def test_names_spread_by_their_parts(spark):
    rows = [(1, 0, "Patient: Maria Gomez"), (1, 1, "Maria called. Gomez, Maria was told; Mariana was not. maria"), (2, 0, "Maria is another session"), (1, 2, None), (1, 3, f"x{ZW}y"), (1, 4, "")]
    got = {(r.s, r.t): r for r in shield.shield(turns(spark, rows), "s", "t").collect()}
    assert got[1, 0].redacted == "Patient: ⟦NAME_A⟧"
    assert got[1, 1].redacted == "⟦NAME_B⟧ called. ⟦NAME_C⟧, ⟦NAME_B⟧ was told; Mariana was not. maria"
    assert got[2, 0].redacted == rows[2][2] and got[1, 2].redacted == "" and got[1, 4].redacted == ""
    assert (got[1, 3].redacted, got[1, 3].refused, got[1, 3].segments) == (None, "hidden_in_word", [])


def test_segments_are_raw_offsets_and_lead_back(spark):
    raw = f"﻿MRN{ZW}: ８８８１２３４, again 8881234, Dr. Ann Bo Cy; Bo Cy Di"
    rows = [(1, 0, raw), (1, 1, "Name: Bo Cy Di")]
    hidden = shield.shield(turns(spark, rows), "s", "t")
    got = hidden.where("t = 0").first()
    assert [raw[g.start : g.end] for g in got.segments] == ["８８８１２３４", "8881234", "Ann Bo Cy", "Bo Cy Di"]
    assert [got.redacted[g.r_start : g.r_end] for g in got.segments] == [g.token for g in got.segments]
    assert shield.unredacted(hidden).where("t = 0").first().text == reading.canonical(raw).text


def test_overlaps_leave_nothing_uncovered():
    form = reading.canonical("tell Ann Bo Cy Di now")
    tokens = {"Ann Bo Cy": "⟦NAME_A⟧", "Bo Cy Di": "⟦NAME_B⟧"}
    text, segments = shield.redact(form, shield.Matcher(tokens), tokens)
    assert text == "tell ⟦NAME_A⟧⟦NAME_B⟧ now" and [g["value"] for g in segments] == ["Ann Bo Cy", " Di"]


def test_many_values_in_one_pass():
    import time

    r = random.Random(1)
    tokens = {f"{r.randrange(10**8):08d}": "⟦MRN_A⟧" for _ in range(50_000)}
    machine = shield.Matcher(tokens)
    text = " ".join(r.choice(list(tokens)) if r.random() < 0.1 else "word" for _ in range(3_000))
    began = time.perf_counter()
    out, _ = shield.redact(reading.canonical(text), machine, tokens)
    assert time.perf_counter() - began < 1 and not any(c.isdigit() for c in out)


def test_layout_is_linear_in_a_long_text():
    import time

    for text in ("Name: \n" * 20_000, "Name  DOB\n" * 20_000, "date of\n" * 20_000, "x" * 200_000):
        began = time.perf_counter()
        layout.placed_values(text)
        assert time.perf_counter() - began < 10, text[:9]
