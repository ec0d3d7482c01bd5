"""Text functions as column expressions. Patterns are Unicode-aware where case or spaces matter."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from foliant.functions.unicode import without_marks

# Very common Spanish function words.
SPANISH_WORDS = (
    "de la el los las que en por para con del al un una se su sus lo como más es son será ser este esta estos estas no y o le "
    "les entre sobre cuando donde cada dicho dicha"
).split()


def squeeze(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def line_key(text: Column) -> Column:
    """What two lines must have in common to count as the same."""
    return F.lower(squeeze(text))


def words_of(text: Column, words: list[str] = SPANISH_WORDS) -> tuple[Column, Column]:
    """How many alphabetic tokens there are, and how many of them are among `words`."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit("[a-záéíóúüñ]+"), F.lit(0))
    return F.size(tokens), F.size(F.filter(tokens, lambda t: t.isin(*words)))


def word_share(text: Column, words: list[str] = SPANISH_WORDS) -> Column:
    """Share of the alphabetic tokens that are among `words`; 0 without tokens."""
    n, known = words_of(text, words)
    return F.when(n > 0, known / n).otherwise(F.lit(0.0))


def join_lines(lines: Column) -> Column:
    """Joins lines with spaces; a line that ends in a hyphen is glued to the next without it."""
    joined = F.array_join(lines, "\u0001")
    return F.trim(F.replace(F.replace(joined, F.lit("-\u0001"), F.lit("")), F.lit("\u0001"), F.lit(" ")))


#: Characters whose upper case is several ones, with the one that stands for it in simple case mapping.
SIMPLE_UPPER = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x80, 0x10000)) if len(c.upper()) > 1}


def upper(text: Column) -> Column:
    """Upper case, one character for one (simple case mapping): ß is ẞ and not SS, so lengths stay."""
    table = F.create_map(*[F.lit(x) for pair in SIMPLE_UPPER.items() for x in pair])
    each = F.transform(F.split(text, ""), lambda c: F.coalesce(F.element_at(table, c), F.upper(c)))
    return F.when(text.rlike(f"[{''.join(SIMPLE_UPPER)}]"), F.array_join(each, "")).otherwise(F.upper(text))


def word_count(text: Column) -> Column:
    """The default token counter: words without white space."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\S+"), F.lit(0)))


def preview(text: Column, chars: int = 160) -> Column:
    return F.substring(squeeze(text), 1, chars)


def with_artifacts(text: Column) -> Column:
    """A space after every third character that is not itself a space: what bad extraction looks like."""
    chars = F.split(text, "")
    return F.array_join(F.transform(chars, lambda c, i: F.when((i % 3 == 2) & (c != " "), F.concat(c, F.lit(" "))).otherwise(c)), "")


# --- cells of salary grids ---

#: Characters that a normalised label does not begin or end with.
LABEL_EDGES = " .:·-"

def label(text: Column) -> Column:
    """A header or label without accents, in lower case, with single spaces and bare ends. Null is the empty label."""
    return F.coalesce(F.btrim(F.lower(squeeze(without_marks(text))), F.lit(LABEL_EDGES)), F.lit(""))


def is_number(value: Column, kind: Column) -> Column:
    """Typed numbers, and strings of digits after dots and commas go. Signs and currencies do not count."""
    digits = F.regexp_replace(F.trim(value), "[.,]", "")
    return F.coalesce(kind.isin("int", "float", "bool") | digits.rlike(r"^\d+$"), F.lit(False))


def to_number(value: Column) -> Column:
    """With both comma and dot the comma is the decimal sign; a lone comma is too. Null if it is no number."""
    v = F.trim(value)
    spanish = v.contains(",") & v.contains(".")
    plain = F.when(spanish, F.replace(F.replace(v, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(v, F.lit(","), F.lit(".")))
    # A cast alone would take what Java writes after numbers, "14d" or "7f".
    return F.when(plain.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$") | plain.rlike(r"(?i)^[+-]?(nan|inf|infinity)$"), plain.try_cast("double"))


def year_in(name: Column) -> Column:
    """A four-digit year of the 20th or 21st century, else two digits standing alone as 20xx."""
    four = F.regexp_extract(name, r"((?:19|20)\d{2})", 1)
    two = F.regexp_extract(name, r"(?U)\b(\d{2})\b", 1)
    return F.coalesce(F.when(four != "", four).try_cast("int"), F.when(two != "", two).try_cast("int") + 2000)


def clean_label(text: Column) -> Column:
    """Single spaces, and no quotes around it."""
    return F.trim(F.btrim(squeeze(text), F.lit("'’‘\"`")))


def is_hours(header: Column) -> Column:
    """A bare number of three or four digits heads a column of hourly rates."""
    return header.rlike(r"^\d{3,4}$")
