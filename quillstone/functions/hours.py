"""Opening hours in a sentence, as weekly sets of days with their times, and whether stated hours follow from it."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F

# How days, ranges of days and lists of days are written.
DAYS = ["mon(?:day)?s?", "tue(?:s(?:day)?)?s?", "wed(?:nesday)?s?", "thu(?:r(?:s(?:day)?s?)?)?", "fri(?:day)?s?", "sat(?:urday)?s?", "sun(?:day)?s?"]
RANGE, LIST = r"-|to|through|thru", r"&|and|,"
DAY = f"(?:{'|'.join(DAYS)})"
DAY_LIST = re.compile(rf"\b{DAY}(?:\s*(?:{RANGE}|{LIST})\s*{DAY}\b)*\b")
TIME = re.compile(r"(?<![\d:])(\d{1,2})(?::(\d{2}))?(?:\s*(am|pm)\b|(?=\s*(?:-|to)\s*\d))|\b(noon)\b")


@dataclass
class Part:
    """A day expression and what is said of these days: times with am or pm, times that take it from what follows, closed."""

    days: set[int]
    sure: list[int]
    bare: set[int]
    closed: bool
    timed: int


def plain(quote: str) -> str:
    q = quote.lower().replace("**", " ")
    q = re.sub("[–—]", "-", q).replace(" ", " ").replace(" ", " ")
    return re.sub(r"\s+", " ", re.sub(r"\b([ap])\.\s?m\.?", r"\1m", q)).strip()


def days_of(expression: str) -> set[int]:
    """The days of a list with ranges; a range goes round the end of the week."""
    found, days, last, ranged = re.findall(rf"{DAY}|{RANGE}|{LIST}", expression), set(), None, False
    for word in found:
        day = next((i for i, p in enumerate(DAYS) if re.fullmatch(p, word)), None)
        if day is None:
            ranged = bool(re.fullmatch(RANGE, word)) and last is not None
            continue
        days |= {(last + k) % 7 for k in range((day - last) % 7 + 1)} if ranged else {day}
        last, ranged = None if ranged else day, False
    return days


def part_of(days: set[int], text: str) -> Part:
    sure, bare, timed = [], set(), 0
    for m in TIME.finditer(text):
        if m[4]:
            timed += 1
            continue
        minutes = int(m[1]) % 12 * 60 + int(m[2] or 0)
        if not 1 <= int(m[1]) <= 12:
            continue
        if m[3]:
            sure.append(minutes + 720 * (m[3] == "pm"))
            timed += 1
        if re.match(r"\s*(?:-|to)\s*\d", text[m.end() :]):
            bare.add(minutes)
    return Part(days, sure, bare, bool(re.search(r"\bclosed\b", text)), timed)


def parts_of(quote: str) -> list[Part]:
    """The parts of a quote, each from a day expression to the next; times before the first one belong to it."""
    q = plain(quote)
    found = list(DAY_LIST.finditer(q))
    ends = [*(m.start() for m in found[1:]), len(q)][: len(found)]
    lead = q[: found[0].start()] + " " if found else ""
    return [part_of(days_of(m.group()), (lead if i == 0 else "") + q[m.end() : end]) for i, (m, end) in enumerate(zip(found, ends, strict=True))]


def minutes_of(clock: str) -> int:
    return int(clock[:2]) * 60 + int(clock[3:5])


def unsupported(parts: list[Part], day: int, opens: str, closes: str) -> str | None:
    """Why a period does not follow from the quote: no_days, other_day, closed, opening or closing; null if it does.

    The last part that covers a day counts; if it is narrower than another one it overrides it: without a time the day is
    closed, with one time it only moves the closing, with two it stands alone.
    """
    if not parts:
        return "no_days"
    covering = [p for p in parts if day in p.days]
    if not covering:
        return "other_day"
    last = covering[-1]
    narrower = any(len(p.days) > len(last.days) for p in covering[:-1])
    if last.closed or narrower and not last.timed:
        return "closed"
    a, b = minutes_of(opens), minutes_of(closes)
    # 8-5pm: the first time may go without am or pm if both have the same, or if it can only be morning
    twelve = lambda x: x // 60 % 12 or 12
    shared = (a < 720) == (b < 720) or a < 720 <= b and twelve(a) > twelve(b)
    opening = [last] if narrower and last.timed > 1 else covering
    if not any(a in p.sure or shared and a % 720 in p.bare for p in opening):
        return "opening"
    return None if any(b in p.sure for p in ([last] if narrower else covering)) else "closing"


def hours_check(quote, day, opens, closes):
    """Column: the reason of unsupported for each row, null where the hours follow from the quote."""

    @F.pandas_udf("string")
    def check(quotes: pd.Series, days: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[str, list[Part]] = {}
        out = []
        for q, d, x, y in zip(quotes, days, a, b, strict=True):
            if q not in known:
                known[q] = parts_of(q or "")
            out.append(unsupported(known[q], int(d), x, y))
        return pd.Series(out, dtype=object)

    return check(quote, day, opens, closes)
