"""Which languages a paper can be checked in, sentence by sentence, and which reading data a photo of it needs.

One Arrow pass counts letters and marker words of each text; the rules are expressions over the counts. Both answers fail
closed: null where a text cannot be told, is in another language or mixes one in.

A null or empty text has no letters and no marker words: no language to check, and English as reading data.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.operators.coverage import sentences_of
from quillstone.operators.slices import in_slices

#: Marker words of the languages that papers are checked in, and of those that they are not.
CHECKED = {
    "en": "the and you your to of for with is if this are be will or at take call each after before have has by on it what when do not as from until then up out any all once twice daily every day days due week weeks month months times today visit clinic doctor mouth tablet tablets blood pain fever office our we was were may can should need use new than without about into get go see stop start keep eat drink",
    "es": "el los las usted su sus para con por una y del al es está esta cada día dia tome llame pero cuando tiene debe hasta después antes como",
}
UNCHECKED = "le les des vous votre vos et pour avec une du au aux est sont pas ne dans sur prenez appelez jours chaque você seu sua com os não uma dos das ao pou ak nan yo ou pa sie die der und mit nicht bei ist ein eine il di che per della non sono iyo ka ku waa haddii oo"
VIETNAMESE = "ăđơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"
#: Markers of the languages of photos, without accents.
ON_PHOTO = {
    "es": "el la los las de del que y en por para con una su sus se al es cada dia dias usted medico tome llame",
    "en": "the and to of a in for with your you is take call day days if or on by at",
    "fr": "le les des du et est vous votre vos avec pour dans une un pas ne au aux ce cette sur qui jour jours fois prenez appelez medecin avez",
}
#: The least share of Latin letters, the most of Vietnamese ones, of other marker words and of long sentences
#: without any; what makes a language present, and a sentence long.
LATIN_SHARE, VIETNAMESE_SHARE, OTHER_SHARE, UNMARKED_SHARE = 0.95, 0.01, 0.2, 0.2
LEAST_HITS, LEAST_SHARE, LONG = 3, 0.06, 5
#: Letters of a photo that rule reading data out, and by how much a language leads there.
PHOTO_OTHER_SHARE, PHOTO_VIETNAMESE, PHOTO_VIETNAMESE_SHARE, PHOTO_HITS, LEAD = 0.2, 3, 0.02, 5, 1.5

RUN = re.compile(r"[^\W\d_]+")
BROKEN = re.compile("[-­‐‑][^\\S\n]*\n\\s*(?=\\S)")
BEYOND_ASCII = re.compile("[^\x00-\x7f]+")
LANGUAGE_OF = {w: k for k, some in CHECKED.items() for w in some.split()}
OTHERS, RARE = frozenset(UNCHECKED.split()), frozenset(VIETNAMESE)
MARKERS = [some.split() for some in ON_PHOTO.values()]
TALLIES = ["letters", "latin", "vietnamese", "photo_letters", "photo_latin", "photo_vietnamese", "words", "en", "es", "other", "long", "unmarked", "foreign", "photo_es", "photo_en", "photo_fr"]


@lru_cache(maxsize=65_536)
def is_latin(letter: str) -> bool:
    return letter in "ªºKÅ" or "LATIN" in unicodedata.name(letter, "")


def letter_words(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return [p for w in RUN.findall(text.lower()) for p in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def letter_counts(characters: Counter, vietnamese) -> tuple[int, int, int]:
    """Letters, Latin ones and Vietnamese ones; different characters are looked up once."""
    seen = [(c, n, is_latin(c)) for c, n in characters.items() if c.isalpha()]
    return sum(n for _, n, _ in seen), sum(n for _, n, latin in seen if latin), sum(n for c, n, latin in seen if latin and vietnamese(c))


def tally(text: str) -> list[int]:
    """TALLIES of a text."""
    hits, size = Counter(), 0
    for w, n in Counter(letter_words(text)).items():
        size += n
        hits[LANGUAGE_OF.get(w)] += n
        hits["other"] += n * (w in OTHERS)
    long = unmarked = foreign = 0
    for a, b in sentences_of(text):
        words = letter_words(text[a:b])
        if len(words) >= LONG:
            known, strange = sum(map(LANGUAGE_OF.__contains__, words)), sum(map(OTHERS.__contains__, words))
            long, unmarked, foreign = long + 1, unmarked + (known == 0), foreign + (strange > known)
    composed = unicodedata.normalize("NFC", text)
    characters = Counter(text)
    photo = letter_counts(characters if composed == text else Counter(composed), lambda c: c in "ăĂđĐơƠưƯ" or "Ạ" <= c <= "ỹ")
    unmarked_text = BEYOND_ASCII.sub(lambda m: "".join(c for c in m.group() if not unicodedata.combining(c)), unicodedata.normalize("NFKD", BROKEN.sub("", text)))
    tokens: Counter = Counter()
    for w, n in Counter(unmarked_text.lower().split()).items():
        tokens[w if w.isalnum() else "".join(c for c in w if c.isalnum())] += n
    marked = [sum(tokens[w] for w in words) for words in MARKERS]
    return [*letter_counts(characters, lambda c: c.lower() in RARE), *photo, size, hits["en"], hits["es"], hits["other"], long, unmarked, foreign, *marked]


def language_tallies(docs: DataFrame, key: str) -> DataFrame:
    """key and TALLIES of each document."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([[k, *tally(t or "")] for k, t in zip(frame[key], frame["text"], strict=True)], columns=[key, *TALLIES])

    return in_slices(docs.select(key, "text"), count, f"{key} {dict(docs.dtypes)[key]}, " + ", ".join(f"{t} long" for t in TALLIES))


def checkable_languages() -> Column:
    """Array of en and es that a text is checked in, or null: over columns TALLIES."""
    c = F.col
    known = c("en") + c("es") + c("other")
    present = lambda k: (c(k) >= LEAST_HITS) & (c(k) >= c("words") * LEAST_SHARE)
    refused = (
        (c("letters") == 0) | (c("latin") < c("letters") * LATIN_SHARE) | (c("vietnamese") > c("letters") * VIETNAMESE_SHARE)
        | (known == 0) | (c("other") >= LEAST_HITS) & (c("other") > known * OTHER_SHARE)
        | (c("foreign") > 0) | (c("unmarked") > 1) & (c("unmarked") > c("long") * UNMARKED_SHARE)
    )
    found = F.array_compact(F.array(*[F.when(present(k), k) for k in CHECKED]))
    return F.when(~refused & (F.size(found) > 0), found)


def photo_language() -> Column:
    """eng, spa or null, the reading data for a photo: over columns TALLIES."""
    c = F.col
    script = (c("photo_letters") - c("photo_latin") > c("photo_letters") * PHOTO_OTHER_SHARE) | (c("photo_vietnamese") >= PHOTO_VIETNAMESE) & (c("photo_vietnamese") > c("photo_letters") * PHOTO_VIETNAMESE_SHARE)
    leads = lambda k, *rest: (c(f"photo_{k}") >= PHOTO_HITS) & (c(f"photo_{k}") > LEAD * F.greatest(F.lit(0), *[c(f"photo_{r}") for r in rest]))
    return F.when(~(script | leads("fr", "es", "en")), F.when(leads("es", "en"), "spa").otherwise("eng"))
