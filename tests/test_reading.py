import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quillstone.operators import automaton, reading

ZW = "\u200B"


@pytest.mark.parametrize(
    "raw,text",
    [
        ("plain text, 12.5 mg\nnext\tline", None),
        ("a\r\nb\rc\vd\fe", "a\nb\nc\nd\ne"),
        (f"MRN{ZW}: 1234567", "MRN: 1234567"),
        ("\uFEFFName:\u00A0Ana", "Name: Ana"),
        ("ｆｕｌｌ １２３", "full 123"),
        ("ﬁrst ㎎ Ⅳ", "first mg IV"),
        ("٨٨٤ and ४२", "884 and 42"),
        ("e\u0301tude", "étude"),
        ("hy\u00ADphen", "hyphen"),
        ("“a”–‘b’ 1⁄2 6∶30", "\"a\"-'b' 1/2 6:30"),
        ("m² CO₂ aspirin¹", None),
        ("① Take", "(1) Take"),
        ("take ½ of 5 µg at 37 ℃", None),
        ("⟦NAME_A⟧ and ⟦DOB_AB⟧", None),
        ("한국어 中文 አማርኛ Tiếng Việt Москва Ωμέγα", None),
    ],
)
def test_canonical_form(raw, text):
    got = reading.canonical(raw)
    assert got.refused is None and got.text == (raw if text is None else text)
    out, at = [], 0  # the edits alone make the text
    for a, b, new in got.edits:
        out += [raw[at:a], new]
        at = b
    assert "".join([*out, raw[at:]]) == got.text and all(raw[a:b] != new for a, b, new in got.edits)


@pytest.mark.parametrize(
    "raw,why",
    [
        (f"Ma{ZW}ria", "hidden_in_word"), (f"884{ZW}129", "hidden_in_word"), (f"x {ZW * 17} y", "hidden_run"), ("a\u2028b", "separator"), ("a\x00b", "control"), ("a\u202Eb", "direction"),
        ("⟦John⟧", "bracket"), ("⟦NAME_ABCD⟧", "bracket"), ("𝐀na", "styled"), ("①②", "styled"), ("nɑme", "lookalike"), ("555-12³4", "raised_digit"), ("x ³", "raised_digit"), ("nаme", "mixed_scripts"), ("Μаria", "mixed_scripts"),
        ("сору", "only_lookalikes"), ("ℌello", "compatibility"), ("½1", "compatibility"),
    ],
)
def test_refused(raw, why):
    assert reading.canonical(raw).refused == why and reading.canonical(raw).text == ""


def spelled(raw):
    """The canonical form character by character, with the raw place of each; only for texts of simple edits."""
    out = []
    for i, c in enumerate(raw):
        if c in (ZW, "\uFEFF"):
            continue
        for x in {"ﬁ": "fi", "㎎": "mg", "１": "1", "\u00A0": " ", "’": "'"}.get(c, c):
            out.append((x, i))
    return out


@pytest.mark.parametrize("seed", range(40))
def test_offsets_lead_back(seed):
    r = random.Random(seed)
    raw = "".join(r.choice(["ab", ". ", f"{ZW}.", "ﬁ", "㎎", "１", "\u00A0", "’", "\n", " \uFEFF "]) for _ in range(40))
    got, want = reading.canonical(raw), spelled(raw)
    assert got.text == "".join(c for c, _ in want)
    for _ in range(60):
        a, b = sorted(r.randrange(len(want)) for _ in range(2))
        assert got.raw_range(a, b + 1) == (want[a][1], want[b][1] + 1)
    assert got.raw_range(3, 3)[0] == got.raw_range(3, 3)[1]


def test_lenient_finds_disguised_placeholders():
    raw = f"see ⟦N{ZW}АМЕ_А⟧ and ⟦ＭＲＮ_Ｂ⟧\tx"
    got = reading.lenient(raw)
    spans = [got.raw_range(*m.span()) for m in reading.PLACEHOLDER.finditer(got.text)]
    assert [raw[a:b] for a, b in spans] == [f"⟦N{ZW}АМЕ_А⟧", "⟦ＭＲＮ_Ｂ⟧"]
    gone = reading.without_placeholders("Maria ⟦NAME_A⟧ Lopez⟦DOB_B⟧.")
    assert gone.text == "Maria Lopez." and gone.raw_range(6, 11) == (15, 20)


def test_long_texts_take_linear_time():
    import time

    for raw in ("é" * 100_000, f"a {ZW}" * 30_000, "e\u0301" * 50_000, "１" * 100_000, ("x" + ZW) * 20_000):
        began = time.perf_counter()
        reading.canonical(raw)
        reading.lenient(raw)
        assert time.perf_counter() - began < 5, raw[:4]


def test_canonical_texts_and_raw_offsets_in_sql(spark):
    rows = [(1, f"Name{ZW}: １２ﬁx"), (2, None), (3, "nаme"), (4, "")]
    got = reading.canonical_texts(spark.createDataFrame(rows, "id int, text string"))
    by = {r.id: r for r in got.collect()}
    assert by[1].text == "Name: 12fix" and by[2].text is None and by[3].refused == "mixed_scripts" and by[4].text == ""
    at = [r.at for r in got.where("id = 1").select(F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k"), "edits").select(reading.raw_offset(F.col("edits"), F.col("k")).alias("at")).collect()]
    assert at == [reading.canonical(rows[0][1]).raw_start(k) for k in range(11)]


@pytest.mark.parametrize("seed", range(20))
def test_automaton_finds_what_a_search_for_each_string_finds(seed):
    r = random.Random(seed)
    strings = ["".join(r.choice("abé") for _ in range(r.randint(0, 5))) for _ in range(30)]
    text = "".join(r.choice("abé ") for _ in range(200))
    want = sorted((m.start(), m.start() + len(s), s) for s in set(strings) if s for m in re.finditer(f"(?={re.escape(s)})", text))
    machine = automaton.Matcher(strings)
    assert sorted(machine.hits(text)) == want and machine.found(text) == {s for s in strings if s and s in text}
    some = automaton.apart(want)
    covered = set().union(*(range(a, b) for a, b, _ in want))
    assert [x for a, b, _ in some for x in range(a, b)] == sorted(covered) and all(text[a:b] == s for a, b, s in some)


def test_normal_forms_are_stable():
    for c in map(chr, range(0xA0, 0x3000)):
        got = reading.canonical(f"x {c} y")
        if got.refused is None:
            again = reading.canonical(got.text)
            assert (again.text, again.edits) == (got.text, []), hex(ord(c))
            assert unicodedata.is_normalized("NFC", got.text)
