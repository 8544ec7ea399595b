"""Numbers written as words in six languages, read by a grammar of places; what is no single number is said to be unread.

Every language says which words stand for a value, which multiply what stands before them, and which only link. A run of
such words is a number if the grammar takes all of it: a part under a thousand, then thousand, then a part again; a part
is hundreds, then tens and ones. "two three" is no number, and a text with such a run must not be compared by numbers.
The other way round, ``spelled`` writes a number in words.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import functions as F

# Number words, words that count, and words around which a word is no number.
_EN = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
_ES = "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte veintiuno veintidós veintitrés veinticuatro veinticinco veintiséis veintisiete veintiocho veintinueve"
_FR = "zéro un deux trois quatre cinq six sept huit neuf dix onze douze treize quatorze quinze seize"
_VI = "không một hai ba bốn năm sáu bảy tám chín mười"
_ES_HUNDREDS = "ciento doscientos trescientos cuatrocientos quinientos seiscientos setecientos ochocientos novecientos"
COUNTED = {
    "en": "tablet tablets pill pills capsule capsules dose doses time times drop drops puff puffs minute minutes second seconds hour hours day days week weeks month months year years mg mcg g ml l gram grams liter liters litre litres ounce ounces oz unit units patch patches injection injections cup cups glass glasses bottle bottles packet packets spoon spoons teaspoon teaspoons tablespoon tablespoons",
    "es": "tableta tabletas pastilla pastillas cápsula cápsulas capsula capsulas comprimido comprimidos dosis vez veces cucharada cucharadas cucharadita cucharaditas gota gotas hora horas día días dia dias semana semanas mes meses sobre sobres vaso vasos taza tazas inhalación inhalaciones minuto minutos segundo segundos año años gramo gramos litro litros onza onzas unidad unidades parche parches inyección inyecciones botella botellas frasco frascos mg mcg g ml l",
    "fr": "comprimé comprimés pilule pilules gélule gélules cachet cachets fois dose doses cuillère cuillères goutte gouttes heure heures jour jours semaine semaines mois sachet sachets verre verres tasse tasses inhalation inhalations bouffée bouffées minute minutes seconde secondes an ans année années gramme grammes litre litres once onces unité unités patch patchs injection injections bouteille bouteilles flacon flacons mg mcg g ml l",
    "vi": "viên lần liều phút giây giờ ngày tuần tháng năm gói cốc ly chai lọ giọt muỗng thìa nhát ống vỉ miếng mũi gam lít mg mcg g ml l",
}
NO_ARTICLE_AFTER = "once twice time times half quarter per every each and vitamin vitamins hepatitis hep type class grade stage group plan part step schedule category level phase section form option list blood strep influenza flu size ward wing building suite room floor zone area track lot"
YEAR_AFTER, YEAR_BEFORE = "mỗi hằng hàng các những", "nay ngoái tới sau"
ZH_DIGITS, ZH_COUNTED = "零一二三四五六七八九", "片粒颗顆次天日周週个個小时時分秒年月杯袋包滴勺匙支瓶毫克升贴貼针針"
ZH_NO_NUMBER = "一起 一定 一些 一样 一樣 一般 一直 一切 一下 一旦 统一 統一 唯一 万一 萬一 千万 千萬 百分之"
KO_DIGITS = "영일이삼사오육칠팔구"
KO_TENS = "열 스물 서른 마흔 쉰 예순 일흔 여든 아흔"
KO_ONES, KO_BEFORE = "하나 둘 셋 넷 다섯 여섯 일곱 여덟 아홉", "한 두 세 네 다섯 여섯 일곱 여덟 아홉"
KO_COUNTED = "알 정 번 시간 개월 개 잔 컵 봉 포 방울 회 캡슐 스푼 숟가락 일 주 달 분 초 년 밀리그램 밀리리터 그램 리터 mg ml"


@dataclass
class Words:
    """A language that puts blanks between number words."""

    values: dict[str, int]
    hundred: set[str] = field(default_factory=set)
    thousand: set[str] = field(default_factory=set)
    ten: set[str] = field(default_factory=set)  # multiplies a digit before it by ten
    links: set[str] = field(default_factory=set)
    articles: set[str] = field(default_factory=set)
    scores: bool = False  # sixty and eighty take eleven to nineteen behind them


def numbered(words: str, first: int = 0) -> dict[str, int]:
    return {w: i for i, w in enumerate(words.split(), first)}


def tens(words: str, first: int = 2) -> dict[str, int]:
    return {w: 10 * v for w, v in numbered(words, first).items()}


def bare(values: dict[str, int]) -> dict[str, int]:
    """The words, and those with an accent also without it."""
    return values | {w.translate(str.maketrans("áéíóú", "aeiou")): v for w, v in values.items()}


_HUNDREDS = {w: 100 * v for w, v in numbered(_ES_HUNDREDS, 1).items()}
LANGUAGES = {
    "en": Words(numbered(_EN) | tens("twenty thirty forty fifty sixty seventy eighty ninety") | {"once": 1, "twice": 2}, {"hundred"}, {"thousand"}, links={"and"}, articles={"a", "an"}),
    "es": Words(bare(numbered(_ES) | tens("treinta cuarenta cincuenta sesenta setenta ochenta noventa", 3) | {"una": 1, "un": 1, "veintiuna": 21, "cien": 100} | _HUNDREDS | {w[:-2] + "as": v for w, v in _HUNDREDS.items() if v > 100}), thousand={"mil"}, links={"y"}, articles={"un", "una"}),
    "fr": Words(numbered(_FR) | tens("vingt trente quarante cinquante soixante") | {"une": 1, "vingts": 20}, {"cent", "cents"}, {"mille"}, links={"et"}, articles={"un", "une"}, scores=True),
    "vi": Words(numbered(_VI) | {"mốt": 1, "tư": 4, "lăm": 5}, {"trăm"}, {"nghìn", "ngàn"}, {"mươi"}, {"linh", "lẻ"}, {"một"}),
}


def small(words: list[str], at: int, of: Words) -> tuple[int | None, int]:
    """A word's value and the place behind it; in French seventeen to nineteen are two words."""
    value = of.values.get(words[at]) if at < len(words) else None
    if of.scores and value == 10 and at + 1 < len(words) and 7 <= of.values.get(words[at + 1], 0) <= 9:
        return 10 + of.values[words[at + 1]], at + 2
    return value, at + 1


def under_hundred(words: list[str], at: int, of: Words) -> tuple[int, int]:
    """(value, place behind it) of tens and ones that begin here; the same place if there are none."""
    value, end = small(words, at, of)
    if value is None or value >= 100:
        return 0, at
    if of.scores and value == 4 and small(words, end, of)[0] == 20:
        value, end = 80, end + 1
    elif end < len(words) and words[end] in of.ten and 0 < value < 10:
        value, end = value * 10, end + 1
    then, behind = small(words, end, of)
    room = 20 if of.scores and value in (60, 80) else 10 if value >= 20 and value % 10 == 0 or of.ten and value == 10 else 0
    if then and then < room and not (behind < len(words) and words[behind] in of.hundred):
        return value + then, behind
    return value, end


def under_thousand(words: list[str], at: int, of: Words) -> tuple[int, int]:
    begin, value = at, 0
    if at < len(words) and words[at] in of.hundred:
        value, at = 100, at + 1
    elif at < len(words) and of.values.get(words[at], 0) >= 100:
        value, at = of.values[words[at]], at + 1
    else:
        some, behind = under_hundred(words, at, of)
        if behind == at or behind == len(words) or words[behind] not in of.hundred:
            return some, behind
        value, at = (some or 1) * 100, behind + 1
    rest, behind = under_hundred(words, at, of)
    return (value + rest, behind) if behind > begin else (value, at)


def one_number(words: list[str], of: Words) -> int | None:
    """The number that a run of number words is, or None."""
    words = [w for w in words if w not in of.links]
    value, at = under_thousand(words, 0, of)
    if at < len(words) and words[at] in of.thousand:
        rest, behind = under_thousand(words, at + 1, of)
        value, at = (value or 1) * 1000 + rest, behind
    return value if words and at == len(words) else None


def read_words(text: str, language: str) -> tuple[list[str], bool]:
    of, counted = LANGUAGES[language], set(COUNTED[language].split())
    known = set(of.values) | of.hundred | of.thousand | of.ten | of.links | of.articles
    text = text.lower()
    words = list(re.finditer(r"[^\W\d_]+", text))
    found, odd, at = [], False, 0
    while at < len(words):
        end = at
        while end < len(words) and words[end].group() in known and (end == at or re.fullmatch(r"[\s–-]*", text[words[end - 1].end() : words[end].start()])):
            end += 1
        run = [w.group() for w in words[at:end]]
        before = words[at - 1].group() if at else ""
        while run and run[-1] in of.links:
            run.pop()
        while run and run[0] in of.links:
            run.pop(0)
        # an article in a longer run of English belongs to it only before hundred or thousand
        if language == "en" and len(run) > 1 and run[-1] in of.articles and run[-2] not in of.links:
            run.pop()
            end -= 1
        then = words[end].group() if end < len(words) else ""
        at = max(end, at + 1)
        if not run or len(run) == 1 and lone(run[0], before, then, language, of, counted):
            continue
        value = one_number(["one" if language == "en" and w in of.articles else w for w in run], of)
        odd |= value is None
        found += [] if value is None else [str(value)]
    return found, odd


def lone(word: str, before: str, then: str, language: str, of: Words, counted: set[str]) -> bool:
    """Whether a number word on its own is an article or a year rather than a number."""
    if word in of.articles:
        return then not in counted or language == "en" and before in NO_ARTICLE_AFTER.split()
    return language == "vi" and word == "năm" and (before in YEAR_AFTER.split() or then in YEAR_BEFORE.split())


def by_places(text: str, digits: str, places: str, myriad: str, zero: str) -> int | None:
    """A number of digits and place signs: thousands, hundreds, tens and ones, ten thousands of the same before them."""
    gap = f"{zero}*" if zero else ""
    each = "".join(f"(?:([{digits}]?){p}{gap})?" for p in places) + f"([{digits}]?)"
    m = re.fullmatch(f"(?:{each}{myriad}{gap})?{each}", text)
    if not m or not text.strip(zero or " "):
        return 0 if m and text else None
    got = list(m.groups())
    n = len(places) + 1

    def part(cells: list[str | None]) -> int:
        scale = [10**k for k in range(n - 1, 0, -1)]
        return sum((digits.index(c) if c else 1) * s for c, s in zip(cells, scale, strict=False) if c is not None) + (digits.index(cells[-1]) if cells[-1] else 0)

    high = part(got[:n]) if any(c is not None for c in got[:n]) else 0
    return (max(high, 1) * 10_000 if re.search(myriad, text) else 0) + part(got[n:])


def read_chinese(text: str) -> tuple[list[str], bool]:
    text = re.sub("|".join(ZH_NO_NUMBER.split()), lambda m: " " * len(m.group()), text)
    found, odd = [], False
    for m in re.finditer("[零〇一二两兩三四五六七八九十百千万萬]+", text):
        if m.group() == "一" and text[m.end() : m.end() + 1] not in tuple(ZH_COUNTED):
            continue
        value = by_places(re.sub("[两兩]", "二", m.group().replace("〇", "零")), ZH_DIGITS, "千百十", "[万萬]", "零")
        odd |= value is None
        found += [] if value is None else [str(value)]
    return found, odd


def read_korean(text: str) -> tuple[list[str], bool]:
    found, odd, taken = [], False, []
    tens_, ones, before = tens(KO_TENS, 1) | {"스무": 20}, numbered(KO_ONES, 1), numbered(KO_BEFORE, 1)
    counted = f"(?:{'|'.join(KO_COUNTED.split())})"
    either = lambda words: "|".join(sorted(words, key=len, reverse=True))
    native = re.compile(rf"(?<![가-힣])(?:({either(tens_)})\s?(?:({either(ones)})(?![가-힣])|({either(before)})(?=\s*{counted}))?|({either(ones)})(?![가-힣])|({either(before)})(?=\s*{counted}))(?:(?![가-힣])|(?=\s*{counted}))")
    for m in native.finditer(text):
        ten, one, ahead, alone, short = m.groups()
        found.append(str(tens_.get(ten, 0) + (ones | before).get(one or ahead or alone or short or "", 0)))
        taken.append(m.span())
    for m in re.finditer(rf"(?<![가-힣])([일이삼사오육칠팔구십백천만]+?)(?:(?=\s*(?!일\s*{counted})({counted}))|(?![가-힣]))", text):
        run, mark = m.group(1), m.group(2)
        if any(a < m.end(1) and b > m.start(1) for a, b in taken) or not mark and not re.search("[십백천만]", run):
            continue
        value = by_places(run, KO_DIGITS, "천백십", "만", "")
        odd |= value is None
        found += [] if value is None else [str(value)]
    return found, odd


def read_numbers(text: str, language: str) -> tuple[list[str], bool]:
    """The numbers that a text has in words, in order, each once; and whether it has any that could not be read."""
    foreign = any(c.isnumeric() and not c.isascii() and c not in "零〇一二两兩三四五六七八九十百千万萬" for c in text)
    if language in LANGUAGES:
        found, odd = read_words(text, language)
    elif language in ("zh", "ko"):
        found, odd = (read_chinese if language == "zh" else read_korean)(text)
    else:
        found, odd = [], True
    return list(dict.fromkeys(found)), odd or foreign


def read(text, language):
    """Columns: a struct of numbers and uncheckable; a language that is not known here is uncheckable, nulls have no numbers."""

    @F.pandas_udf("numbers array<string>, uncheckable boolean")
    def each(texts: pd.Series, languages: pd.Series) -> pd.DataFrame:
        got = [read_numbers(t or "", x) for t, x in zip(texts, languages, strict=True)]
        return pd.DataFrame({"numbers": pd.Series([n for n, _ in got], dtype=object), "uncheckable": [u for _, u in got]})

    return each(text, language)


def spelled(n: int, language: str) -> str:
    """A number from 0 to 9,999 in words."""
    if language in ("zh", "ko"):
        digits, places = (ZH_DIGITS, "千百十") if language == "zh" else (KO_DIGITS, "천백십")
        if n == 0:
            return digits[0]
        out, gap = "", False
        for k, d in enumerate(f"{n:04d}"):
            if d == "0":
                gap = bool(out)
                continue
            sign = places[k] if k < 3 else ""
            digit = "" if d == "1" and sign and (language == "ko" or sign == "十" and not out) else digits[int(d)]
            out += ("零" if gap and language == "zh" else "") + digit + sign
            gap = False
        return out
    of = LANGUAGES[language]
    name = {v: w for w, v in reversed(of.values.items())}
    if language == "en":
        name |= {1: "one", 2: "two"}
    if language == "es":
        name |= {1: "uno", 100: "cien"}

    def low(k: int) -> list[str]:
        if k in name and (k < 100):
            return [name[k]]
        t, u = divmod(k, 10)
        if language == "vi":
            return [name[t], "mươi"] * (t > 1) + ["mười"] * (t == 1) + ([{1: "mốt" if t > 1 else "một", 5: "lăm"}.get(u, name[u])] if u else [])
        if language == "fr" and (k >= 80 or 60 < k < 80 or 16 < k < 20):
            base = 80 if k >= 80 else 60 if k > 60 else 10
            return (["quatre", "vingts" if k == 80 else "vingt"] if base == 80 else [name[base]]) + (["et"] if k in (61, 71) else []) + (low(k - base) if k > base else [])
        return [name[t * 10], *({"es": ["y"], "fr": ["et"] if u == 1 else []}.get(language, [])), name[u]]

    out, (thousands, rest) = [], divmod(n, 1000)
    if thousands:
        out += ([] if thousands == 1 and language in ("es", "fr") else low(thousands)) + [{"en": "thousand", "es": "mil", "fr": "mille", "vi": "nghìn"}[language]]
    hundreds, rest = divmod(rest, 100)
    if hundreds:
        if language == "es":
            out.append("cien" if hundreds == 1 and not rest else _ES_HUNDREDS.split()[hundreds - 1])
        else:
            out += ([] if hundreds == 1 and language == "fr" else low(hundreds)) + [{"en": "hundred", "fr": "cent", "vi": "trăm"}[language]]
    if rest or not n:
        out += (["linh"] if language == "vi" and out and rest < 10 else ["and"] if language == "en" and hundreds else []) + low(rest)
    return " ".join(out)
