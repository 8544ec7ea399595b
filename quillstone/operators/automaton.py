"""Many strings looked up in one pass over a text, whatever their number: Aho-Corasick automata inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick


class Matcher:
    """Finds every occurrence of every given string. Equal strings are one; empty ones are never found."""

    def __init__(self, strings: Iterable[str]):
        self.strings = list(dict.fromkeys(s for s in strings if s))
        self.machine = ahocorasick.Automaton()
        for i, s in enumerate(self.strings):
            self.machine.add_word(s, i)
        if self.strings:
            self.machine.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int, str]]:
        """(start, end, string) of all occurrences, overlapping ones too, by end."""
        if self.strings and text:
            for last, i in self.machine.iter(text):
                s = self.strings[i]
                yield last + 1 - len(s), last + 1, s

    def found(self, text: str) -> set[str]:
        """The strings that stand anywhere in the text."""
        if not self.strings or not text:
            return set()
        return {self.strings[i] for i in {i for _, i in self.machine.iter(text)}}


def apart(hits: Iterable[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Hits that do not overlap: the earliest, of those with one start the longest; one that goes on beyond it adds its rest.

    The rest of a hit that an earlier one cuts stays covered: it is a hit of its own, with the string that is left.
    """
    out: list[tuple[int, int, str]] = []
    end = 0
    for a, b, s in sorted(hits, key=lambda h: (h[0], -h[1])):
        if b <= end:
            continue
        start = max(a, end)
        out.append((start, b, s[start - a :]))
        end = b
    return out
