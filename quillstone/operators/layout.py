"""Identifiers that stand where a form puts them: under their label, under a header cell, or behind a label cut in two.

A text is read as lines of fields. A field is a label that shield.LABELLED knows; what follows up to the next field, a
wide gap or the line's end is its value. Three kinds of fields have their value on the next line: a label that ends its
line, a label of which the next line holds the second half, and the cells of a header line over a line of as many cells.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from quillstone.operators.shield import COLON, LABELLED, beginnings, has_label, matches_at

#: A cell: words with single blanks between them.
CELL = re.compile(r"\S+(?: \S+)*")
FIELD = re.compile(r"^[^\W\d_][\w .'#-]{0,30}:")
#: Kinds whose header cell makes a line a header.
LEADING = {"NAME", "DOB", "MRN"}
#: The longest part of a label that a line break can cut off.
TAIL_WORDS, TAIL_CHARS = 4, 48
LABEL = {kind: re.compile(rf"(?i:(?<!\w)(?:{'|'.join(labels)}))(?!\w)") for kind, (labels, _) in LABELLED.items()}
ANY_LABEL = re.compile("|".join(f"(?:{p.pattern})" for p in LABEL.values()))
VALUE = {kind: re.compile(rf"[ \t]*[:#]?[ \t]*({value})") for kind, (_, value) in LABELLED.items()}
#: A value right under its label may be in lower case there, and ends with its line or a wide gap.
BARE_NAME = re.compile(r"[ \t]*([^\W\d_][\w'’.-]*(?:,? [^\W\d_][\w'’.-]*){0,3})(?=[ \t]*$|[ \t]{2,}|\t)")


@dataclass(frozen=True)
class Line:
    start: int
    text: str


@dataclass(frozen=True)
class Label:
    kind: str
    start: int
    end: int
    marked: bool  # a colon or number sign follows


def lines_of(text: str) -> list[Line]:
    out, at = [], 0
    for part in text.split("\n"):
        out.append(Line(at, part))
        at += len(part) + 1
    return out


def labels_on(text: str) -> list[Label]:
    """The labels of a line, leftmost first and, of those that overlap, the longest."""
    found, known = [], beginnings(text)
    for kind in known:
        for m in matches_at(LABEL[kind], text, known[kind]):
            mark = re.match(r"[ \t]*[:#]", text[m.end() : m.end() + 8])
            found.append(Label(kind, m.start(), m.end() + (mark.end() if mark else 0), bool(mark)))
    out: list[Label] = []
    for label in sorted(found, key=lambda x: (x.start, -x.end)):
        if not out or label.start >= out[-1].end:
            out.append(label)
    return out


def value_at(kind: str, line: Line, at: int) -> tuple[str, int, int] | None:
    """(kind, start, end) of a value of this kind that begins at this place of the line, blanks before it left out."""
    m = VALUE[kind].match(line.text, at) or (BARE_NAME.match(line.text, at) if kind == "NAME" else None)
    return (kind, line.start + m.start(1), line.start + m.end(1)) if m and m.end(1) > m.start(1) else None


def below(line: Line, under: Line) -> list[tuple[str, int, int]]:
    """The value of a label that ends its line: at the beginning of the next one, unless that is a field itself."""
    labels = labels_on(line.text)
    if not labels or line.text[labels[-1].end :].strip() or FIELD.match(under.text.strip()):
        return []
    last = labels[-1]
    if not last.marked and (last.kind in COLON or len(labels) > 1 or line.text[: last.start].strip()):
        return []
    found = value_at(last.kind, under, 0)
    return [found] if found else []


def last_words(text: str) -> str:
    """The words at the end of a line that can be the first half of a label."""
    return " ".join(text.rstrip()[-TAIL_CHARS:].split()[-TAIL_WORDS:])


def cut_label(line: Line, under: Line) -> list[tuple[str, int, int]]:
    """The value behind a label that begins on this line and ends on the next one."""
    head = last_words(line.text)
    if not head:
        return []
    lead = len(under.text) - len(under.text.lstrip())
    joined = f"{head} {under.text[lead:]}"
    for label in labels_on(joined):
        inside = label.end - len(head) - 1
        if label.start < len(head) and inside > 0 and (label.marked or label.kind not in COLON):
            found = value_at(label.kind, under, lead + inside)
            if found:
                return [found]
    return []


def header_cells(line: Line, under: Line) -> list[tuple[str, int, int]]:
    """Values under a line of header cells, matched cell by cell; lines of fields are no values."""
    heads, values = list(CELL.finditer(line.text)), list(CELL.finditer(under.text))
    if len(heads) < 2 or len(heads) != len(values) or not has_label(line.text) or any(FIELD.match(v.group()) for v in values):
        return []
    kinds = [next((k for k, p in LABEL.items() if p.fullmatch(h.group().rstrip(":"))), None) for h in heads]
    if sum(k is not None for k in kinds) < 2 or not LEADING & set(kinds):
        return []
    cells = [value_at(kind, Line(under.start, under.text[: v.end()]), v.start()) for kind, v in zip(kinds, values, strict=True) if kind]
    return [c for c in cells if c]


def placed_values(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the values that only their place on the page gives away."""
    flat = " ".join(text.split())  # a label may be cut by a line's end
    if not has_label(flat):
        return []
    lines, out = lines_of(text), []
    for line, under in zip(lines, lines[1:], strict=False):
        # a label stands on the line, or begins in its last words and goes on where the next line begins
        if line.text.strip() and under.text.strip() and has_label(f"{line.text}\n{last_words(line.text)} {under.text.lstrip()[:TAIL_CHARS]}"):
            out += header_cells(line, under) or below(line, under) or cut_label(line, under)
    return out if out and ANY_LABEL.search(flat) else []
