"""Compatibility decomposition without marks (NFKD, then everything that combines goes), as JVM expressions.

Marks go, so their order does not matter and each character is decomposed for itself. Most have one plain character, or are marks: `translate`
handles those in one pass. The few texts that hold a character with a longer decomposition go through it character by character. Hangul
syllables are not in the tables, their parts follow from their number."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column, functions as F

#: Hangul: first syllable, first leading consonant, vowel and trailing consonant; how many vowels and trailing consonants (with none) there are.
SYLLABLE, LEAD, VOWEL, TRAIL = 0xAC00, 0x1100, 0x1161, 0x11A7
VOWELS, TRAILS, SYLLABLES = 21, 28, 11_172


@cache
def tables() -> tuple[str, str, str, dict[str, str]]:
    """Characters with one plain one, those plain ones, characters that go, and longer decompositions, by the Unicode data of this Python."""
    one, plain, gone, longer = [], [], [], {}
    for code in range(0x110000):
        if 0xD800 <= code < 0xE000 or SYLLABLE <= code < SYLLABLE + SYLLABLES:
            continue
        c = chr(code)
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if not bare:
            gone.append(c)
        elif len(bare) > 1:
            longer[c] = bare
        elif bare != c:
            one.append(c)
            plain.append(bare)
    return "".join(one), "".join(plain), "".join(gone), longer


def _char(code: Column) -> Column:
    """The character of a code point of up to 16 bits."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def _syllable(c: Column) -> Column:
    at = F.ascii(c).cast("long") - SYLLABLE
    trail = at % TRAILS
    return F.concat(_char(LEAD + F.floor(at / (VOWELS * TRAILS))), _char(VOWEL + F.floor(at % (VOWELS * TRAILS) / TRAILS)), F.when(trail > 0, _char(TRAIL + trail)).otherwise(""))


def without_marks(text: Column) -> Column:
    """The text decomposed, without what combines."""
    one, plain, gone, longer = tables()
    simple = F.translate(text, one + gone, plain)
    names, values = F.array(*map(F.lit, longer)), F.array(*map(F.lit, longer.values()))
    hangul = f"[{chr(SYLLABLE)}-{chr(SYLLABLE + SYLLABLES - 1)}]"
    place = lambda c: F.array_position(names, c)
    apart = lambda c: F.when(c.rlike(hangul), _syllable(c)).when(place(c) > 0, F.element_at(values, place(c).cast("int"))).otherwise(c)
    slow = F.array_join(F.transform(F.regexp_extract_all(simple, F.lit("(?s)."), F.lit(0)), apart), "")
    rest = F.when(simple.rlike(f"[{''.join(longer)}]|{hangul}"), slow).otherwise(simple)
    # ASCII has no marks: most texts need no look at the tables.
    return F.when(text.rlike(r"^\p{ASCII}*$"), text).otherwise(rest)
