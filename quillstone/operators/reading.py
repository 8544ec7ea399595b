"""How a text is read before it is searched for identifiers: one canonical form with a list of edits, and a lenient one.

The canonical form is what is searched and what is passed on. It differs from the raw text by a sorted list of edits
(start, end, replacement); this list is also the way back from its offsets to raw ones. Characters that could make a
reader see something other than what was searched are not guessed at: the text is refused, with a reason.

The lenient form only finds placeholders and identifiers in disguise: it drops what does not show, folds compatibility
forms and letters that look Latin, and reads digits of any script.
"""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators.slices import arrow_schema, text_slices

#: What is drawn as nothing, what is drawn as a blank, what turns the direction, what parts lines unseen.
HIDDEN = "\u00AD\u034F\u061C\u17B4\u17B5\u180B-\u180F\u200B-\u200F\u2060-\u2065\u206A-\u206F\uFE00-\uFE0F\uFEFF\uFFF0-\uFFFB\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff"
BLANKS = "\u115F\u1160\u3164\uFFA0"
TURNS = "\u202A-\u202E\u2066-\u2069"
SEPARATORS = "\u0085\u2028\u2029"
#: Punctuation that is passed on in its ASCII form, and letters that look like Latin ones.
PUNCTUATION = {ord(c): to for some, to in (("‐‑‒–—―−﹘﹣⁃", "-"), ("⁄∕⧸", "/"), ("꞉∶﹕", ":"), ("‘’‛ʼ`´′", "'"), ("“”‟″", '"')) for c in some}
CYRILLIC = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁһӏІЈЅԜԝУ", "ABEKMHOPCTXaeopcyxijsdhlIJSWwY", strict=True))
GREEK = dict(zip("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαικνρτυχ", "ABEZHIKMNOPTYXoaikvptux", strict=True))
LOOKALIKE = {ord(a): b for a, b in (CYRILLIC | GREEK).items()}
ODD_LATIN = "ıȷɐ-ʯᴀ-ᶿꜰ-ꟿꬰ-\uAB6F"
RAISED = "²³¹⁰⁴-⁹₀-₉"
#: Compatibility signs that papers use as they are.
SIGNS = "µ™℠℃℉ºª"
PLACEHOLDER = re.compile("⟦(?:NAME|DOB|AGE|MRN|ACCOUNT|MEMBER|LICENSE|SSN|PHONE|EMAIL|ADDRESS|ZIP)_[A-Z]{1,3}⟧")

_PLAIN = re.compile(r"[\n\t -_a-~]*")
#: Fixed value: letters beyond ASCII that are their own canonical form, whatever stands before them.
LETTERS = "À-ÖØ-öø-ÿăĂđĐĩĨũŨơƠưƯẠ-ỹ一-鿿ぁ-ゖァ-ヺ가-힣"
#: What needs a look: any other character that is not plain ASCII, and a letter or plain one before marks or hidden ones.
_PIECE = re.compile(rf"\r\n?|[^\n\t -_a-~{LETTERS}]|[ -~](?=[\u0300-\u036F])|[{LETTERS}](?=[^\n\t -_a-~{LETTERS}])")
_HIDDEN_RUN = re.compile(f"[{HIDDEN}]+")
_RAISED_RUN = re.compile(f"[{RAISED}]+")


@dataclass
class Reading:
    """A form of a raw text: edits are (start, end, replacement) in raw offsets, in order, apart from each other."""

    text: str
    raw_length: int
    edits: list[tuple[int, int, str]] = field(default_factory=list)
    refused: str | None = None

    def __post_init__(self) -> None:
        shift, self._at, self._ends = 0, [], []
        for a, b, new in self.edits:
            self._at.append(a + shift)
            shift += len(new) - (b - a)
            self._ends.append((b + shift, b))

    def raw_start(self, at: int) -> int:
        """The raw offset where the character at this offset begins (at the text's end: the raw text's end)."""
        i = bisect.bisect_right(self._at, at) - 1
        if i < 0:
            return at
        end, raw_end = self._ends[i]
        if at < end:
            return self.edits[i][0]
        return raw_end + at - end

    def raw_range(self, start: int, end: int) -> tuple[int, int]:
        """The raw stretch behind [start, end) of the text; an empty one stays empty."""
        if end <= start:
            at = self.raw_start(start)
            return at, at
        i = bisect.bisect_right(self._at, end - 1) - 1
        last = end - 1
        if i >= 0 and last < self._ends[i][0]:
            return self.raw_start(start), self.edits[i][1]
        return self.raw_start(start), self.raw_start(last) + 1


@lru_cache(maxsize=65_536)
def script(c: str) -> str:
    return unicodedata.name(c, "").partition(" ")[0]


def is_word(c: str) -> bool:
    return c.isalpha() or unicodedata.category(c)[0] in "NM"


def digits_in_ascii(s: str) -> str:
    return "".join(str(unicodedata.decimal(c)) if c > "\x7f" and unicodedata.category(c) == "Nd" else c for c in s)


class Refused(Exception):
    pass


def cluster_end(raw: str, at: int) -> int:
    """Behind the character at this place and the marks that belong to it; hidden characters before a mark belong too."""
    end = at + 1
    while end < len(raw):
        if unicodedata.category(raw[end])[0] == "M" and not _HIDDEN_RUN.match(raw[end]):
            end += 1
            continue
        run = _HIDDEN_RUN.match(raw, end)
        if not run or run.end() - end > 16 or run.end() >= len(raw) or unicodedata.category(raw[run.end()])[0] != "M":
            break
        end = run.end() + 1
    return end


def one_form(raw: str, at: int, before: str) -> tuple[int, str]:
    """The end of the piece that begins here, and its canonical form. before: the canonical text's last character."""
    c = raw[at]
    if c == "\r":
        return at + 1 + (raw[at + 1 : at + 2] == "\n"), "\n"
    if c in "\v\f":
        return at + 1, "\n"
    if c in SEPARATORS:
        raise Refused("separator")
    if c < " " or "\x7f" <= c < "\xa0":
        raise Refused("control")
    if re.match(f"[{TURNS}]", c):
        raise Refused("direction")
    if c in "⟦⟧":
        known = PLACEHOLDER.match(raw, at)
        if not known:
            raise Refused("bracket")
        return known.end(), known.group()
    if c in BLANKS or unicodedata.category(c) == "Zs" and c != " ":
        return at + 1, " "
    if run := _HIDDEN_RUN.match(raw, at):
        if run.end() - at > 16:
            raise Refused("hidden_run")
        inside = before and (before.isalpha() or before.isnumeric()) and run.end() < len(raw) and is_word(raw[run.end()])
        if inside and run.group().strip("\u00AD"):
            raise Refused("hidden_in_word")
        return run.end(), ""
    after = raw[at + 1 : at + 2]
    if "①" <= c <= "⑳" and not before.isnumeric() and not after.isnumeric():
        return at + 1, f"({ord(c) - 0x245F})"
    if "①" <= c <= "⓿" or "\U0001d400" <= c <= "\U0001d7ff":
        raise Refused("styled")
    if re.match(f"[{ODD_LATIN}]", c):
        raise Refused("lookalike")
    if run := _RAISED_RUN.match(raw, at):
        stretch = re.search(r"\S{0,64}\Z", raw[max(0, at - 64) : at]).group() + re.match(r"\S{0,64}", raw[run.end() : run.end() + 64]).group()
        if not before.isalpha() or run.end() - at > 3 or any(x.isnumeric() for x in stretch):
            raise Refused("raised_digit")
        return run.end(), run.group()
    end = cluster_end(raw, at)
    cluster = _HIDDEN_RUN.sub("", raw[at:end])
    form = unicodedata.normalize("NFC", cluster)
    marks = unicodedata.normalize("NFC", cluster[1:])
    if "！" <= c <= "～" or "ﬀ" <= c <= "ﬆ" or "㌀" <= c <= "㏟" and "㎀" <= c or "Ⅰ" <= c <= "ⅿ":
        return end, unicodedata.normalize("NFKC", c) + marks
    if ord(form[0]) in PUNCTUATION:
        return end, PUNCTUATION[ord(form[0])] + marks
    if c > "\x7f" and unicodedata.category(c) == "Nd":
        return end, digits_in_ascii(c) + marks
    wide = unicodedata.normalize("NFKC", cluster)
    if wide != form and any(x.isalpha() or x.isnumeric() for x in wide) and c not in SIGNS:
        fraction = unicodedata.category(c) == "No" and "⁄" in wide
        if not fraction or after.isnumeric():
            raise Refused("compatibility")
    return end, form


def mixed_word(text: str) -> str | None:
    """Why a word of the text is in disguise: it mixes Latin, Cyrillic and Greek letters, or has only letters that look Latin."""
    if not re.search("[Ͱ-ϿЀ-ԯἀ-\u1FFF]", text):
        return None
    for m in re.finditer(r"[^\W\d_](?:[^\W\d_]|[\u0300-\u036F])*", text):
        letters = [c for c in m.group() if c.isalpha()]
        used = {script(c) for c in letters} & {"LATIN", "CYRILLIC", "GREEK"}
        if len(used) > 1:
            return "mixed_scripts"
        if all(ord(c) in LOOKALIKE for c in letters):
            return "only_lookalikes"
    return None


def canonical(raw: str) -> Reading:
    """The form that is searched and passed on, with its edits; refused and empty where the text cannot be trusted."""
    if _PLAIN.fullmatch(raw):
        return Reading(raw, len(raw))
    out, edits, at = [], [], 0
    try:
        while piece := _PIECE.search(raw, at):
            out.append(raw[at : piece.start()])
            last = next((p[-1] for p in reversed(out) if p), "")
            end, form = one_form(raw, piece.start(), last)
            if form != raw[piece.start() : end]:
                edits.append((piece.start(), end, form))
            out.append(form)
            at = end
        text = "".join([*out, raw[at:]])
        if why := mixed_word(text):
            raise Refused(why)
    except Refused as why:
        return Reading("", len(raw), refused=str(why))
    return Reading(text, len(raw), edits)


def lenient(raw: str) -> Reading:
    """The form in which placeholders and disguised identifiers are found; nothing is refused."""
    edits, out, at = [], [], 0
    # a plain character is only part of a cluster if a mark follows it
    for m in re.finditer(rf"\r\n?|[\t\v\f`]|[^\x00-\x7f]|[ -~](?=[\u0300-\u036F])", raw):
        a = m.start()
        if a < at:
            continue
        c = raw[a]
        if c in "\r\v\f":
            b, form = m.end(), "\n"
        elif c == "\t":
            b, form = a + 1, "  "
        elif c in SEPARATORS or c in BLANKS or unicodedata.category(c) == "Zs" and c != " ":
            b, form = a + 1, " "
        elif run := re.compile(f"[{HIDDEN}{TURNS}]+").match(raw, a):
            b, form = run.end(), ""
        elif c in "⟦⟧":
            b, form = a + 1, c
        else:
            b = cluster_end(raw, a)
            cluster = _HIDDEN_RUN.sub("", raw[a:b])
            form = unicodedata.normalize("NFKC", cluster)
            form = form if len(form) <= 4 * len(cluster) else cluster
            form = digits_in_ascii(form.translate(LOOKALIKE).translate(PUNCTUATION))
        out += [raw[at:a], form]
        if form != raw[a:b]:
            edits.append((a, b, form))
        at = b
    return Reading("".join([*out, raw[at:]]), len(raw), edits)


def without_placeholders(text: str) -> Reading:
    """The text without exact placeholders; one between two blanks takes one of them along."""
    out, edits, at = [], [], 0
    for m in PLACEHOLDER.finditer(text):
        end = m.end() + (text[m.start() - 1 : m.start()] == " " == text[m.end() : m.end() + 1])
        out.append(text[at : m.start()])
        edits.append((m.start(), end, ""))
        at = end
    return Reading("".join([*out, text[at:]]), len(text), edits)


EDITS = "array<struct<start:int,end:int,repl:string>>"


def canonical_texts(df: DataFrame, column: str = "text") -> DataFrame:
    """df with the column in canonical form (empty if refused, null stays null), its edits and refused, the reason or null."""

    kept = [c for c in df.columns if c not in ("edits", "refused")]
    kinds = dict(df.dtypes)
    out = arrow_schema(f"edits {EDITS}, refused string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, column, most=1_000_000):
            got = [Reading(None, 0) if t is None else canonical(t) for t in batch.column(column).to_pylist()]
            cuts = pa.array([0, *accumulate(len(r.edits) for r in got)], pa.int32())
            parts = [pa.array([e[i] for r in got for e in r.edits], kind) for i, kind in enumerate((pa.int32(), pa.int32(), pa.string()))]
            edits = pa.ListArray.from_arrays(cuts, pa.StructArray.from_arrays(parts, fields=list(out.field("edits").type.value_type)), type=out.field("edits").type)
            texts = pa.array([r.text for r in got], batch.column(column).type)
            columns = [texts if c == column else batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, edits, pa.array([r.refused for r in got], pa.string())], [*kept, "edits", "refused"])

    return df.select(*kept).mapInArrow(read, ", ".join(f"`{c}` {kinds[c]}" for c in kept) + f", edits {EDITS}, refused string")


def raw_offset(edits, at):
    """The raw offset behind an offset of the canonical text, from its edits."""
    step = lambda s, e: F.when(
        e["start"] + s["shift"] > at, s
    ).otherwise(
        F.struct(
            F.when(at < e["start"] + s["shift"] + F.length(e["repl"]), e["start"]).otherwise(at - s["shift"] - F.length(e["repl"]) + e["end"] - e["start"]).cast("int").alias("at"),
            (s["shift"] + F.length(e["repl"]) - (e["end"] - e["start"])).cast("int").alias("shift"),
        )
    )
    return F.aggregate(edits, F.struct(at.cast("int").alias("at"), F.lit(0).alias("shift")), step, lambda s: s["at"])
