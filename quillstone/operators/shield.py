"""Reversible redaction of personal identifiers inside a session: detect, learn, spread, redact, restore."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.operators import reading
from quillstone.operators.automaton import Matcher, apart
from quillstone.operators.slices import in_slices

_D = r"\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}"
_NAME = r"[A-ZÀ-ÞĐ][\w'’-]+(?: [A-ZÀ-ÞĐ][\w'’-]+){0,3}"
_ID = r"[A-Za-z]{0,3}[- ]?\d{4,}"
#: Kinds that a label introduces: the labels (English, Spanish, French, Vietnamese) and what a value looks like.
LABELLED = {
    "DOB": (["dob", "date of birth", "birth date", "born(?: on)?", "fecha de nacimiento", "date de naissance", "ngày sinh"], _D),
    "MRN": (["mrn", "medical record(?: (?:number|no\\.?))?", "chart (?:no\\.?|number)", "expediente", "dossier(?: médical)?", "số hồ sơ"], _ID),
    "NAME": (["patient(?: name)?", "name", "attending", "provider", "physician", "paciente", "nombre", "nom", "médecin", "họ tên", "bệnh nhân"], _NAME),
    "ACCOUNT": (["account(?: (?:number|no\\.?))?", "acct", "cuenta", "compte"], _ID),
    "MEMBER": (["member(?: id)?", "subscriber(?: id)?", "policy(?: (?:number|no\\.?))?", "group(?: (?:number|no\\.?))?", "póliza", "assuré"], _ID),
    "LICENSE": (["license(?: (?:number|no\\.?))?", "npi", "dea", "licencia"], _ID),
    "PHONE": (["phone", "tel", "cell", "mobile", "fax", "teléfono", "téléphone", "điện thoại"], r"\+?[\d(][\d() .-]{6,}\d"),
    "ADDRESS": (["address", "dirección", "adresse", "địa chỉ"], r"\d+[^\n,;]{3,60}"),
    "ZIP": (["zip(?: code)?", "código postal", "code postal"], r"\d{5}(?:-\d{4})?"),
    "SSN": (["ssn", "social security(?: (?:number|no\\.?))?", "seguro social"], r"\d{3}[- ]?\d{2}[- ]?\d{4}"),
}
#: Kinds that show by themselves.
PLAIN = {
    "EMAIL": f"({T.EMAIL})",
    "SSN": r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])",
    "PHONE": r"(?<![\d-])(\+?\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4})(?![\d-])",
    "NAME": rf"\b(?:Mr|Mrs|Ms|Miss|Dr|Sr|Sra|Mme)\.? ({_NAME})",
    "AGE": r"(?i:\b(?:aged?|age:) |(?<!\d))(9\d|1[0-2]\d)(?=[ -](?:years?|yrs?|y/o|años|ans)\b|,? ?(?:yo|y\.o\.))",
}
#: Kinds whose label must end in a colon, since their values look like any other words.
COLON = {"NAME", "ADDRESS"}
PATTERNS = [(kind, rf"(?i:(?<!\w)(?:{'|'.join(labels)})) ?{':' if kind in COLON else '[:#]?'} ?({value})") for kind, (labels, value) in LABELLED.items()] + list(PLAIN.items())
LABEL_PATTERNS = {kind: re.compile(rf"(?i:(?<!\w)(?:{'|'.join(labels)})) ?{':' if kind in COLON else '[:#]?'} ?({value})") for kind, (labels, value) in LABELLED.items()}
#: How the labels of each kind begin, in lower case, up to what may be left out.
BEGINNINGS = [(re.match(r"[^(?\\]*(?![?])", label)[0], kind) for kind, (labels, _) in LABELLED.items() for label in labels]
#: What a text holds that has a value of PLAIN, by kind; cheap to look for.
SIGNS = {"EMAIL": "@", "SSN": r"\d-\d\d-\d{4}", "PHONE": r"\d{3}[ .-]\d{4}", "NAME": "M(?:rs?|s|iss|me)|Dr|Sr", "AGE": r"\d,?[ -]?[ya]"}
PLAIN_PATTERNS = [(kind, re.compile(SIGNS[kind]), re.compile(pattern)) for kind, pattern in PLAIN.items()]
#: Letters that a pattern takes for others when it ignores case, and lower() does not.
SAME_LETTERS = {"ſ": "s", "İ": "i", "ı": "i"}


def lowered(text: str) -> str:
    """The text in lower case, character by character, as patterns see it that ignore case."""
    for odd, plain in SAME_LETTERS.items() if not text.isascii() else ():
        text = text.replace(odd, plain)
    return text.lower()


def has_label(text: str) -> bool:
    """Whether a label may begin in a text."""
    low = lowered(text)
    for b, _ in BEGINNINGS:
        if b in low:
            return True
    return False


def beginnings(text: str) -> dict[str, set[int]]:
    """Where a label of each kind may begin; kinds without a place are left out, the others are in the order of LABELLED."""
    low, found = lowered(text), {}
    for b, kind in BEGINNINGS:
        if b in low:
            at = low.find(b)
            while at >= 0:
                found.setdefault(kind, set()).add(at)
                at = low.find(b, at + 1)
    return found


def matches_at(pattern: re.Pattern, text: str, places: set[int]) -> Iterator[re.Match]:
    """pattern.finditer(text), for a pattern that can begin at these places only."""
    done = 0
    for at in sorted(places):
        if at >= done and (m := pattern.match(text, at)):
            yield m
            done = m.end()


def labelled(text: str) -> Iterator[tuple[str, re.Match]]:
    """(kind, match) of the values behind labels, as the patterns find them."""
    for kind, places in beginnings(text).items():
        for m in matches_at(LABEL_PATTERNS[kind], text, places):
            yield kind, m


def letters(n: Column) -> Column:
    """0 to A, 25 to Z, 26 to AA: bijective base 26, up to seven letters."""
    step = lambda s, _: F.when(s["n"] > 0, F.struct(F.floor((s["n"] - 1) / 26).alias("n"), F.concat(F.chr(65 + (s["n"] - 1) % 26), s["out"]).alias("out"))).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(7)), F.struct((n + 1).cast("long").alias("n"), F.lit("").alias("out")), step, lambda s: s["out"])


#: Parts of names that are words of their own.
NO_PART = {"the", "and", "de", "del", "la", "las", "los", "van", "von", "da", "du", "jr", "sr", "ii", "iii", "may", "will", "rose", "mark"}


def name_parts(name: str) -> Iterator[tuple[int, str]]:
    """(place, part) of the parts of a name that give the person away on their own."""
    words = list(re.finditer(r"[^\s,]+", name))
    if len(words) > 1:
        for m in words:
            part = m.group().strip(".'’-")
            if len(part) > 1 and part.lower() not in NO_PART:
                yield m.start() + m.group().index(part), part


def identified(text: str) -> Iterator[tuple[str, str, int]]:
    """(kind, value, place) of what a canonical text identifies, in its lines, by its layout, and the parts of names."""
    from quillstone.operators import layout

    found = [*labelled(text), *((kind, m) for kind, sign, pattern in PLAIN_PATTERNS if sign.search(text) for m in pattern.finditer(text))]
    known = [(kind, m.group(m.lastindex), m.start(m.lastindex)) for kind, m in found]
    known += [(kind, text[a:b], a) for kind, a, b in layout.placed_values(text)]
    for kind, value, at in known:
        yield kind, value, at
        if kind == "NAME":
            yield from (("NAME", part, at + shift) for shift, part in name_parts(value))


def learnt(turns: DataFrame, session: str, order: str) -> DataFrame:
    """session, kind, value, token: what a session's turns identify, numbered by kind in order of appearance.

    Values are those of the canonical texts; refused texts give none. Detection is a narrow pass; only the found values
    are shuffled.
    """

    def find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for s, at, text in zip(frame[session], frame[order], frame["text"], strict=True):
                form = reading.canonical(text or "")
                rows += [(s, kind, value, at, place) for kind, value, place in identified(form.text)]
            yield pd.DataFrame(rows, columns=[session, "kind", "value", "turn_at", "place"])

    kinds = dict(turns.dtypes)
    found = in_slices(turns.select(session, order, "text"), find, f"{session} {kinds[session]}, kind string, value string, turn_at {kinds[order]}, place int")
    first = found.groupBy(session, "kind", "value").agg(F.min(F.struct("turn_at", "place")).alias("first"))
    ranked = first.selectExpr("*", f"row_number() OVER (PARTITION BY {session}, kind ORDER BY first, length(value) DESC, value) - 1 AS n")
    return ranked.select(session, "kind", "value", F.concat(F.lit("⟦"), "kind", F.lit("_"), letters(F.col("n")), F.lit("⟧")).alias("token"))


SEGMENTS = "array<struct<start:int,end:int,r_start:int,r_end:int,token:string,value:string>>"


def whole(text: str, start: int, end: int) -> bool:
    """Whether no letter or digit goes on over either edge."""
    return not (start and WORD.match(text[start - 1]) and WORD.match(text[start]) or end < len(text) and WORD.match(text[end - 1]) and WORD.match(text[end]))


WORD = re.compile(r"\w")


def redact(form: reading.Reading, machine: Matcher, tokens: dict[str, str]) -> tuple[str, list[dict]]:
    """The canonical text with tokens for values, and the segments that they stand for, in raw offsets.

    Overlaps go to the earliest, then the longest; what a later value has beyond it is hidden under that value's token.
    """
    text, out, segments, last, size = form.text, [], [], 0, 0
    held = {}
    for a, b, s in machine.hits(text):
        if whole(text, a, b):
            held[a, b] = s
    for a, b, rest in apart([(a, b, s) for (a, b), s in held.items()]):
        token = tokens[rest] if rest in tokens else next(tokens[s] for (_, end), s in held.items() if end == b and s.endswith(rest))
        raw = form.raw_range(a, b)
        out += [text[last:a], token]
        size += a - last
        segments.append({"start": raw[0], "end": raw[1], "r_start": size, "r_end": size + len(token), "token": token, "value": rest})
        size, last = size + len(token), b
    return "".join([*out, text[last:]]), segments


def shield(turns: DataFrame, session: str, order: str) -> DataFrame:
    """session, order, redacted, segments (start, end, r_start, r_end, token, value), refused: learnt values are hidden.

    A text is searched and passed on in its canonical form; start and end are offsets of the raw text. A text that has
    no safe form is not passed on: redacted is null and refused says why. All values of a session are found in one pass
    over a text by an automaton that is built once a session; the rows of a session follow each other after the join.
    """
    known = learnt(turns, session, order).groupBy(session).agg(F.collect_list(F.struct("value", "token")).alias("known"))
    rows = turns.select(session, order, "text").join(known, session, "left")

    def hide(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, machine, tokens = None, Matcher([]), {}
        for frame in frames:
            redacted, segments, refused = [], [], []
            for s, text, some in zip(frame[session], frame["text"], frame["known"], strict=True):
                if s != of:
                    tokens = {k["value"]: k["token"] for k in some} if some is not None else {}
                    of, machine = s, Matcher(tokens)
                form = reading.canonical(text or "")
                hidden, here = redact(form, machine, tokens)
                redacted.append(hidden if form.refused is None else None)
                segments.append(here)
                refused.append(form.refused)
            yield frame[[session, order]].assign(redacted=redacted, segments=segments, refused=refused)

    kinds = dict(turns.dtypes)
    return in_slices(rows, hide, f"{session} {kinds[session]}, {order} {kinds[order]}, redacted string, segments {SEGMENTS}, refused string")


def unredacted(hidden: DataFrame) -> DataFrame:
    """hidden (of shield) with column text: the canonical text again, from the segments alone."""
    step = lambda s, g: F.struct(F.concat(s["text"], F.substring(F.col("redacted"), s["at"] + 1, g["r_start"] - s["at"]), g["value"]).alias("text"), g["r_end"].alias("at"))
    done = F.aggregate("segments", F.struct(F.lit("").alias("text"), F.lit(0).alias("at")), step)
    rest = F.expr("substring(redacted, done.at + 1, length(redacted))")
    return hidden.withColumn("done", done).withColumn("text", F.concat("done.text", rest)).drop("done")


def restore(redacted: DataFrame, known: DataFrame, session: str) -> DataFrame:
    """The original texts again, as column text."""
    pairs = known.groupBy(session).agg(F.collect_list(F.struct("token", "value")).alias("pairs"))
    put_back = F.aggregate(F.coalesce("pairs", F.array().cast("array<struct<token:string,value:string>>")), F.col("redacted"), lambda t, p: F.replace(t, p["token"], p["value"]))
    return redacted.join(pairs, session, "left").withColumn("text", put_back).drop("pairs")


def to_original(segments, at):
    """Where offset at of the redacted text is in the original; inside a placeholder: its start."""
    return F.aggregate(
        segments,
        F.struct(at.cast("int").alias("at"), F.lit(0).alias("shift")),
        lambda s, g: F.when(at >= g["r_end"], F.struct(s["at"].alias("at"), (g["end"] - g["r_end"]).alias("shift")))
        .when(at >= g["r_start"], F.struct(g["start"].alias("at"), F.lit(0).alias("shift")))
        .otherwise(s),
        lambda s: s["at"] + s["shift"],
    )


def shield_fields(df: DataFrame, session: str, order: str, fields: list[str]) -> DataFrame:
    """session, order and the fields redacted: a value learnt in any field of a session is hidden in all of them."""
    cells = df.select(session, order, F.posexplode(F.array(*[F.col(f) for f in fields])).alias("field", "text"))
    cells = cells.withColumn("cell", F.struct(F.col(order).alias("o"), "field"))
    hidden = shield(cells.select(session, F.col("cell"), "text"), session, "cell")
    pivot = [F.max(F.when(F.col("cell.field") == i, F.col("redacted"))).alias(f) for i, f in enumerate(fields)]
    return hidden.groupBy(session, F.col("cell.o").alias(order)).agg(*pivot)


def planted(marked: DataFrame, key: str) -> DataFrame:
    """key, text, spans (kind, start, end, hide) of texts with {{KIND|value}} to hide and [[why|value]] to keep."""
    mark = re.compile(r"\{\{(\w+)\|(.*?)\}\}|\[\[(.*?)\|(.*?)\]\]", re.DOTALL)

    def unmark(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts, spans = [], []
            for t in frame["text"]:
                out, size, at, here = [], 0, 0, []
                for m in mark.finditer(t or ""):
                    value = m.group(2) if m.group(1) else m.group(4)
                    size += m.start() - at
                    here.append({"kind": m.group(1) or m.group(3), "start": size, "end": size + len(value), "hide": bool(m.group(1))})
                    out += [t[at : m.start()], value]
                    size, at = size + len(value), m.end()
                texts.append("".join([*out, (t or "")[at:]]))
                spans.append(here)
            yield frame[[key]].assign(text=texts, spans=spans)

    return in_slices(marked.select(key, "text"), unmark, f"{key} {dict(marked.dtypes)[key]}, text string, spans array<struct<kind:string,start:int,end:int,hide:boolean>>")


def hide_rates(plants: DataFrame, hidden: DataFrame, key: str) -> DataFrame:
    """kind, planted, caught, false_hides: planted spans that the shield's segments cover, kept ones that they touch."""
    both = plants.join(hidden.select(key, "segments"), key).select(F.explode("spans").alias("p"), "segments")
    covered = F.exists("segments", lambda g: (g["start"] <= F.col("p.start")) & (g["end"] >= F.col("p.end")))
    touched = F.exists("segments", lambda g: (g["start"] < F.col("p.end")) & (g["end"] > F.col("p.start")))
    hide = F.col("p.hide")
    return both.groupBy(F.when(hide, F.col("p.kind")).otherwise("keep").alias("kind")).agg(F.count(F.lit(1)).alias("planted"), F.count_if(hide & covered).alias("caught"), F.count_if(~hide & touched).alias("false_hides"))
