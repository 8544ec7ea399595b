"""Steps before an appointment on a timeline: verify the quote, read when from its own sentence, place it or ask.

A time is read from the first clause of the quote's sentence only, and only if it says what it is relative to. A phrase
names a slot; several phrases are settled by SETTLED, what is left open is a conflict. A placed step is taken back if
its time may belong to another action of the sentence, to another copy of the words or to another sentence.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.functions.number_words import numbered
from quillstone.operators import coverage, grounding
from quillstone.operators.slices import arrow_schema, items, text_slices

SLOTS = ["days_before", "day_before", "evening_before", "day_of", "hours_before", "morning_of", "arrival", "after"]
# Numbers before a unit, what a time may be relative to, clock times, line ends, ellipses, joining words.
NUMBERS = numbered("one two three four five six seven eight nine ten eleven twelve thirteen fourteen", 1) | {"a": 1, "an": 1}
COUNT = rf"(\d{{1,2}}|{'|'.join(sorted(NUMBERS, key=len, reverse=True))})"
TARGET = r"(?:your|the|this)\s+(?:scheduled\s+)?(?:procedure|test|exam|examination|appointment|arrival|surgery|operation|colonoscopy|endoscopy|scope|scan)\b"
BEFORE = r"(?:before|prior\s+to)"
CLOCK = re.compile(r"(?<![\w:])(?:\d{1,2}(?::\d{2})?\s?(?:[ap]\.\s?m\.|[ap]\s?m)(?![a-z])|noon)", re.IGNORECASE)
MIDNIGHT = re.compile(r"\bmidnight\b", re.IGNORECASE)
LINE_END = re.compile("[\n\r\x0b\x0c\u0085  ]")
ELLIPSIS = re.compile("\\.\\s*\\.|[…⋯᠁︙]")
JOINS = "and then or but also y o luego et ou puis và rồi hoặc"
TIME_WORDS = "a an the your my of on at in by before after prior to until from starting beginning day days night nights morning evening afternoon week weeks hour hours minute minutes hr hrs min mins am pm a.m p.m noon midnight procedure exam test appointment surgery colonoscopy endoscopy scan visit arrival one two three four five six seven eight nine ten eleven twelve fourteen twenty thirty forty fifty sixty seventy seventy-two forty-eight twenty-four"
CONDITIONS = "if when unless while since because si cuando mientras quand lorsque nếu khi"

#: Phrases by the slot that they name; a phrase inside a longer one does not count.
PHRASES = [
    (rf"\b{COUNT}\s+(days?|weeks?)\s+{BEFORE}\s+{TARGET}", "counted"),
    (rf"\b(?:the\s+)?day\s+{BEFORE}\s+{TARGET}", "day_before"),
    (rf"\b(?:the\s+)?(?:night|evening)\s+{BEFORE}\s+{TARGET}", "evening_before"),
    (rf"\b{COUNT}\s+(?:hours?|hrs?|minutes?|mins?)\s+{BEFORE}\s+(?:{TARGET}|you\s+(?:arrive|check[- ]?in)\b)", "hours_before"),
    (rf"\b(?:the\s+)?morning\s+of\s+{TARGET}", "morning_of"),
    (rf"\b(?:on\s+)?the\s+day\s+of\s+{TARGET}", "day_of"),
    (rf"\bafter\s+{TARGET}", "after"),
]
#: (slots that are there, slot that goes): a more exact phrase for one moment wins.
SETTLED = [({"evening_before", "day_before"}, "day_before"), ({"day_of", "morning_of"}, "day_of"), ({"day_of", "hours_before"}, "day_of")]

# What says that one arrives, what makes it doubtful, and what only counts back from it.
_ARRIVE = re.compile(r"(?:^|[,;:]\s*)(?:(?:please|you\s+(?:must|should|need\s+to|will\s+need\s+to|have\s+to)|plan\s+to|be\s+sure\s+to|make\s+sure\s+to)\s+)?(?:arrive|check[- ]?in)\b|\b(?:arrival|check[- ]?in)\s+(?:time\s+)?(?:is|will\s+be)\b", re.IGNORECASE)
_MAYBE_LATE = re.compile(r"\b(?:if|unless|when|whenever|whether|in\s+case|cannot|can['’]?t|can\s+not|unable|impossible|late|miss|missed)\b", re.IGNORECASE)
_COUNTED_BACK = re.compile(rf"\b(?:{BEFORE}|after|until|till|by)\s+(?:you\s+(?:arrive|check[- ]?in)|(?:your|the)\s+(?:arrival|check[- ]?in)(?:\s+time)?)\b", re.IGNORECASE)


def first_clause(quote: str) -> tuple[str, bool]:
    """The quote's first sentence up to an ellipsis, and whether its end is doubtful (a stop before a small letter)."""
    text = re.sub(r"\s+", " ", quote).strip()
    text = re.split(r"\.\.\.|…", text)[0]
    ends = coverage.sentences_of(text)
    text = text[: ends[0][1]].strip() if ends else text.strip()
    return text, bool(re.search(r"\b[\w)]+\. +[a-z]", text)) and not re.search(r"(?i)\b(?:a\.m|p\.m|dr|mr|ms|mrs|e\.g|i\.e)\. +[a-z]", text)


def phrases_in(text: str) -> list[tuple[int, int, str]]:
    """(start, end, slot) of the time phrases of a text; the longest at a place."""
    found = []
    for pattern, slot in PHRASES:
        for m in re.finditer(pattern, text, re.IGNORECASE):
            if slot == "counted":
                n = int(m[1]) if m[1].isdigit() else NUMBERS[m[1].lower()]
                if n:
                    found.append((*m.span(), "days_before" if n > 1 or m[2].lower().startswith("week") else "day_before"))
            else:
                found.append((*m.span(), slot))
    return sorted(f for f in found if not any(o != f and o[0] <= f[0] and f[1] <= o[1] and o[1] - o[0] > f[1] - f[0] for o in found))


def is_arrival(text: str) -> bool:
    text = _COUNTED_BACK.sub(" ", text)
    return bool(_ARRIVE.search(text.strip())) and not _MAYBE_LATE.search(text)


def read_when(quote: str, many_lines: bool = False) -> tuple[str | None, str, list[str]]:
    """slot (null: ask), reason and the time words of a quote, in the order in which they stand there."""
    if many_lines or LINE_END.search(quote):
        return None, "multi_line", []
    text, doubtful = first_clause(quote)
    if doubtful:
        return None, "ambiguous_sentence", []
    days = phrases_in(text)
    clocks = [m.span() for m in CLOCK.finditer(text)]
    midnights = [m.span() for m in MIDNIGHT.finditer(text)]
    words = [text[a:b] for a, b in sorted([*((a, b) for a, b, _ in days), *clocks, *midnights])]
    slots = {s for _, _, s in days}
    if is_arrival(text) and (clocks or "hours_before" in slots):
        return (None, "conflict", words) if slots - {"day_of", "morning_of", "hours_before"} else ("arrival", "placed", words)
    if midnights and slots:  # midnight ends the evening before and fits nothing else
        slots = {"evening_before"} if slots <= {"day_before", "evening_before"} else slots | {"midnight"}
    for there, gone in SETTLED:
        if there <= slots:
            slots = slots - {gone}
    if len(slots) == 1:
        return slots.pop(), "placed", words
    if slots:
        return None, "conflict", words
    return (None, "clock_without_day", words) if clocks or midnights else (None, "no_time_words", [])


def acts(text: str) -> bool:
    """Whether a part of a sentence says more than when."""
    words = [w.strip(".'’-") for w in re.findall(r"[^\W\d_](?:[^\W\d_]|['’.-])*", text.lower())]
    return any(w and w not in TIME_WORDS.split() and w not in JOINS.split() for w in words)


_BREAK = re.compile(rf"[;:,•]|\s[-–—]\s|(?<![^\W\d_])(?:{JOINS.replace(' ', '|')})(?![^\W\d_])", re.IGNORECASE)


def of_other_clause(sentence: str, start: int, end: int, words: list[str]) -> bool:
    """Whether a time word is cut off from the matched words by a break, in a part that says more than when."""
    for word in words:
        m = re.search(r"\s+".join(map(re.escape, word.split())), sentence, re.IGNORECASE)
        if not m:
            return True
        a, b = m.span()
        if a < end and start < b:
            continue
        between = sentence[end:a] if a >= end else sentence[b:start]
        if not _BREAK.search(between):
            continue
        breaks = [x.span() for x in _BREAK.finditer(sentence)]
        if a >= end:
            region = sentence[end : next((x for x, _ in breaks if x >= b), len(sentence))]
        else:
            region = sentence[max((y for _, y in breaks if y <= a), default=0) : start]
        if acts(region):
            return True
    return False


def of_two_actions(sentence: str) -> bool:
    """Whether a sentence has two actions, so that one time may be either's. A condition belongs to what follows it."""
    verbs = "|".join(coverage.DO + ["never", "do not", "don't"])
    cuts = re.split(rf"[;•]|\s[-–—]\s|,\s*(?:(?:and\s+then|and|then|or|but)\s+)?(?=(?:{verbs})\b)|\s(?:and\s+then|and|then|but)\s+(?=(?:{verbs})\b)", sentence, flags=re.IGNORECASE)
    told = [c for c in cuts if c and acts(c) and not re.match(rf"\s*(?:{CONDITIONS.replace(' ', '|')})\b", c, re.IGNORECASE)]
    return len(told) > 1


#: Sentences and quotes repeat; so many readings of them are remembered in a worker.
REMEMBERED = 50_000


@lru_cache(maxsize=REMEMBERED)
def told(sentence: str) -> tuple[str | None, str, tuple[str, ...]]:
    """read_when of a whole sentence."""
    slot, reason, words = read_when(sentence, bool(LINE_END.search(sentence)))
    return slot, reason, tuple(words)


@lru_cache(maxsize=REMEMBERED)
def doubtful_owner(sentence: str, start: int, end: int) -> bool:
    """Whether the time of a sentence may belong to another action than that of its words from start to end."""
    return of_two_actions(sentence) or of_other_clause(sentence, start, end, list(told(sentence)[2]))


@lru_cache(maxsize=REMEMBERED)
def one_part(quote: str) -> str | None:
    """The normalised words of a quote; null if it is empty, too short or skips words."""
    asked = quote.strip()
    parts = grounding.parts(asked) if asked and not ELLIPSIS.search(asked) else []
    return parts[0] if len(parts) == 1 else None


def stands_again(source: grounding.Source, text: str, part: str, at: int, quote: str) -> bool:
    """Whether the quote stands in the text from place at on, read as a text of its own; part: its normalised words."""
    if source.norm.find(part, bisect_left(source.origin, at)) < 0:  # what is cut off is normalised as it was
        return False
    return grounding.find_span(grounding.Source(text[at:]), quote.strip()) is not None


def placed(source: grounding.Source, text: str, sentences: list[tuple[int, int]], quote: str) -> dict | None:
    """The sentence of a step's quote, its slot, reason and words; null if the quote is not in the text or skips words."""
    part = one_part(quote)
    at = next(source.places(part, 0), -1) if part else -1
    if at < 0:
        return None
    found = source.origin[at], source.origin[at + len(part) - 1] + 1
    # sentences follow each other: those that begin before the quote's end and end behind its beginning
    around = sentences[bisect_right(sentences, found[0], key=lambda s: s[1]) : bisect_left(sentences, found[1], key=lambda s: s[0])] or [found]
    start, end = around[0][0], around[-1][1]
    sentence = text[start:end]
    slot, reason, words = told(sentence)
    if slot is not None:
        why = "repeated" if stands_again(source, text, part, found[1], quote) else "multi_sentence" if len(around) > 1 else None
        if why is None and doubtful_owner(sentence, found[0] - start, found[1] - start):
            why = "other_clause"
        slot, reason = (None, why) if why else (slot, reason)
    return {"start": start, "end": end, "slot": slot, "reason": reason, "words": list(words)}


STEP = "row long, start int, end int, slot string, reason string, words array<string>, held boolean"


def prep_steps(papers: DataFrame, key: str) -> DataFrame:
    """key, row, start and end of the step's sentence, slot, reason, words, held (not in the paper).

    papers: key, text, steps array<struct<row,quote>>; a paper is mapped and cut into sentences once for all its steps.
    """

    schema = f"{key} {dict(papers.dtypes)[key]}, {STEP}"
    out = arrow_schema(schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            cuts, (numbers, quotes) = items(batch.column("steps"), ["row", "quote"])
            rows = []
            for i, (k, text) in enumerate(zip(batch.column(key).to_pylist(), batch.column("text").to_pylist(), strict=True)):
                source, sentences = grounding.Source(text or ""), coverage.sentences_of(text or "")
                for n, quote in zip(numbers[cuts[i] : cuts[i + 1]], quotes[cuts[i] : cuts[i + 1]], strict=True):
                    got = placed(source, text or "", sentences, quote or "")
                    rows.append((k, n, got["start"], got["end"], got["slot"], got["reason"], got["words"], False) if got else (k, n, None, None, None, None, None, True))
            columns = list(zip(*rows, strict=True)) or [[] for _ in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

    return papers.select(key, "text", "steps").mapInArrow(place, schema)


def timeline(steps: DataFrame, key: str) -> DataFrame:
    """key, slot (null: ask), rows in the paper's order: the groups of a timeline."""
    kept = steps.where("NOT held").groupBy(key, "slot").agg(F.sort_array(F.collect_list(F.struct("start", "row"))).alias("s"))
    return kept.select(key, "slot", F.transform("s", lambda x: x["row"]).alias("rows"))
