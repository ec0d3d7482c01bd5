"""Article chunking: header anchors, segments, and pieces that keep to a size.

Anchors are found line by line and guarded by windows over a stream. The monotonic guard on
lower-case headers needs the largest number accepted so far, which is a running maximum over
all candidates before: a rejected one is smaller than that maximum and cannot change it.

Packing is a sequential fold with a token counter that need not be additive, so it runs in an
Arrow batch function, on segments, which are bounded by a document.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from foliant.config import DEFAULT, Settings
from foliant.functions.text import word_count
from foliant.functions.tokens import Counter, Words, counted
from foliant.shipping import ship

# How article headers, their ordinals and dispositions are written.
_ORDINALS = r"primero|segundo|tercero|cuarto|quinto|sexto|s[eé]ptimo|octavo|noveno|d[eé]cimo|und[eé]cimo|duod[eé]cimo|decimo\w*|vig[eé]simo\w*|trig[eé]simo\w*"
_BLANK = r"^[ \t]*"
ARTICLE = _BLANK + r"(?:ART[ÍI]CULO|Art[íi]culo|Art\.|ART\.|art\.|art[íi]culo|ART)(?U:\s)+(\d{1,3})"
# Possessive: the digits are not given back to avoid what follows.
SUBCLAUSE = _BLANK + r"(?:ART[ÍI]CULO|Art[íi]culo|Art\.|ART\.|art\.|art[íi]culo|ART)(?U:\s)+\d{1,3}+\.(?:\d|[A-Za-z](?![A-Za-z]))"
ORDINAL = rf"(?iuU){_BLANK}ART[ÍI]CULO\s+(?:{_ORDINALS})\b"
BASQUE = r"(?iu)^[ \t]*(\d{1,3})\.?(?U:\s)*artikulua"
DISPOSITION = r"(?iu)^[ \t]*Disposici[óo]n(?U:\s)+(?:adicional|transitoria|final|derogatoria)"
STREAM = ["doc_id", "lang"]


def line_units(docs: DataFrame, page_lines: int, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Plain texts as streams of one unit for each line, a page for so many lines. A null text has no units."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.posexplode(F.split(text_col, "\n")).alias("unit_no", "text"))
    return rows.select("doc_id", "lang", "unit_no", (F.floor(F.col("unit_no") / page_lines) + 1).cast("int").alias("page"), "text")


def lines(units: DataFrame) -> DataFrame:
    """The lines of each stream in order, with what separates each from the next: a line break, or a blank line between units."""
    parts = units.select(*STREAM, "unit_no", "page", F.split("text", "\n").alias("l"))
    rows = parts.select(*STREAM, "unit_no", "page", F.size("l").alias("n"), F.posexplode("l").alias("line_no", "line"))
    last = Window.partitionBy(*STREAM).orderBy("unit_no", "line_no")
    end = F.lead("line").over(last).isNull()
    return rows.withColumn("sep", F.when(end, "").when(F.col("line_no") == F.col("n") - 1, "\n\n").otherwise("\n")).drop("n")


def anchored(rows: DataFrame) -> DataFrame:
    """Lines (as from `lines`) with `is_anchor`, `num` and `segment`, the number of anchors so far in the stream."""
    order = Window.partitionBy(*STREAM).orderBy("unit_no", "line_no")
    # A header may run on: its number can stand on the next line that is not blank.
    # Read backwards, what is ahead is what came last: a running value, where a frame to the end would be walked again for each line.
    filled = F.when(F.trim("line") != "", F.col("line"))
    back = Window.partitionBy(*STREAM).orderBy(F.desc("unit_no"), F.desc("line_no")).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.last(filled, ignorenulls=True).over(back)
    rows = rows.withColumn("text2", F.concat("line", F.lit("\n"), F.coalesce(ahead, F.lit(""))))
    t, head = F.col("text2"), F.substring(F.ltrim(F.regexp_replace("line", r"^[ \t]+", "")), 1, 1)
    capital = head == F.upper(head)
    number = lambda p: F.regexp_extract(t, p, 1).try_cast("int")
    article, basque = t.rlike(ARTICLE) & ~t.rlike(SUBCLAUSE), t.rlike(BASQUE)
    num = F.when(article, number(ARTICLE)).when(basque, number(BASQUE))
    rows = rows.withColumns({"num": num, "capital": capital, "article": article, "basque": basque})
    before = F.coalesce(F.max("num").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    named = (t.rlike(ORDINAL) | t.rlike(DISPOSITION)) & capital
    rows = rows.withColumn("is_anchor", F.col("basque") | (F.col("article") & (F.col("capital") | (F.col("num") >= before))) | named)
    segment = F.sum(F.col("is_anchor").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("segment", segment).drop("text2", "capital", "article", "basque")


def segments(units: DataFrame) -> DataFrame:
    """(doc_id, lang, segment, n_anchors, pieces): article segments with the text and page of each line; segment 0 is what comes before the first."""
    rows = anchored(lines(units))
    # Blanks before a header belong to the segment before it.
    indent = F.regexp_extract("line", r"^[ \t]+", 0)
    own = F.struct("segment", F.lit(1).alias("part"), F.concat(F.when(F.col("is_anchor"), F.regexp_replace("line", r"^[ \t]+", "")).otherwise(F.col("line")), "sep").alias("text"))
    lead = F.struct((F.col("segment") - 1).alias("segment"), F.lit(0).alias("part"), indent.alias("text"))
    both = F.when(F.col("is_anchor") & (indent != ""), F.array(lead, own)).otherwise(F.array(own))
    rows = rows.withColumn("e", F.explode(both)).select(*STREAM, "unit_no", "line_no", "page", "e.*")
    out = rows.groupBy(*STREAM, "segment").agg(F.array_sort(F.collect_list(F.struct("unit_no", "line_no", "part", "text", "page"))).alias("p"))
    total = F.max("segment").over(Window.partitionBy(*STREAM))
    return out.select(*STREAM, "segment", total.alias("n_anchors"), F.transform("p", lambda x: F.struct(x["text"].alias("text"), x["page"].alias("page"))).alias("pieces"))


#: The default token counter.
count_words = Words()


def _reach(joined: Callable[[int], str], at: int, n: int, guess: int, count: Counter, cap: int) -> int:
    """The largest place up to n to which parts can be joined within the cap, for a counter that never falls as text is added.

    The search begins at a guess and gallops from there: a counter that adds up is called twice, any other a few times."""
    fits = lambda to: count(joined(to)) <= cap
    low, high, step = at, n + 1, 1
    if guess > at and fits(guess):
        low = guess
        while low + step <= n and fits(low + step):
            low, step = low + step, 2 * step
        high = min(low + step, n + 1)
    else:
        high = max(guess, at + 1)
        while high - step > at and not fits(high - step):
            high, step = high - step, 2 * step
        low = max(high - step, at)
        if low == at and high == at + 1 and guess <= at and fits(high):
            return _reach(joined, at, n, high, count, cap)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if fits(middle) else (low, middle)
    return low


def _grown(parts: list[str], joint: str, count: Counter, cap: int, too_big: Callable[[str, bool], tuple[list[str], str]]) -> tuple[list[str], str]:
    """Joins parts as long as the whole keeps to the cap; too_big says what becomes of a part that does not fit (whether something was waiting before it).

    Each part is counted once; sums of these counts say where the longest run of parts that fits should end, and the counter settles it."""
    parts = [p for p in parts if p.strip()]
    sums = list(accumulate(counted(count, [p.strip() for p in parts]), initial=0))
    done, waiting, at = [], "", 0
    while at < len(parts):
        joined = lambda to: joint.join([waiting, *map(str.rstrip, parts[at:to])] if waiting else [parts[at].strip(), *map(str.rstrip, parts[at + 1 : to])])  # noqa: B023, E731
        room = cap - (count(waiting) if waiting else 0) + sums[at]
        to = _reach(joined, at, len(parts), bisect_right(sums, room) - 1, count, cap)
        if to > at:
            waiting, at = joined(to), to
        if at < len(parts):
            had = bool(waiting)
            if had:
                done.append(waiting)
            more, waiting = too_big(parts[at], had)
            done += more
            at += 1
    return done, waiting


def split_words(text: str, count: Counter, cap: int) -> list[str]:
    """Pieces of whole words; a single word beyond the cap stands alone."""
    done, rest = _grown(text.split(), " ", count, cap, lambda w, had: ([], w) if had else ([w], ""))
    return [*done, rest] if rest else done


def pack(text: str, count: Counter, cap: int) -> list[str]:
    """Pieces of at most `cap` tokens: whole paragraphs, else sentences, else words.

    A sentence that is too long for a piece of its own is cut into words only if nothing was waiting before it; otherwise it waits whole."""
    text = text.strip()
    if not text or count(text) <= cap:
        return [text] if text else []

    def sentence(s: str, had: bool) -> tuple[list[str], str]:
        return ([], s.strip()) if had else (split_words(s, count, cap), "")

    def paragraph(p: str, had: bool) -> tuple[list[str], str]:
        return ([], p.strip()) if count(p) <= cap else _grown(re.split(r"(?<=[.;:])\s+", p), " ", count, cap, sentence)

    done, rest = _grown([p for p in re.split(r"\n\s*\n", text) if p.strip()] or [text], "\n\n", count, cap, paragraph)
    return [*done, rest] if rest else done


def placed(text: str, pieces: list[str]) -> list[tuple[int, int]]:
    """Where each piece of a text stands, judged by its first 40 characters: their first occurrence, else the start."""
    begins = [max(0, text.find(p[:40])) for p in pieces]
    return [(at, at + len(p)) for at, p in zip(begins, pieces, strict=True)]


def chunks_of(pieces: list[dict], article: bool, count: Counter, target: int, cap: int) -> list[dict]:
    """The chunks of one segment: an article whole or in pieces that repeat its first line, anything else packed to the target.

    The contents and the spans of the segment they stand for are made as two lists; pages come from the spans by bisection.
    Pieces of an article stand for all of it, so that each is cited with all its pages."""
    raw = "".join(p["text"] for p in pieces)
    whole = raw.strip()
    contents = pack(raw, count, cap if article else target)
    if article:
        first_line, _, _ = whole.partition("\n")
        head = f"{first_line.strip()}\n"
        contents = contents[:1] + [p if p.startswith(head[:-1]) else head + p for p in contents[1:]]
    spans = [(0, len(raw))] * len(contents) if article else placed(raw, contents)
    starts = list(accumulate((len(p["text"]) for p in pieces), initial=0))[:-1]
    # Units without text begin where the next one does, which counts.
    page = lambda at: pieces[bisect_right(starts, at) - 1]["page"]
    return [
        {"content": c.strip(), "page_from": page(a), "page_to": page(max(a, b - 1)), "token_count": count(c.strip())}
        for c, (a, b) in zip(contents, spans, strict=True)
        if c.strip()
    ]


#: Segments whose chunks go out at once; one at a time is unpacked, since its lines as Python objects take many times their Arrow form.
SEGMENTS = 64
CHUNK = "array<struct<content:string,page_from:int,page_to:int,token_count:int>>"


def chunks(units: DataFrame, count: Counter = count_words, settings: Settings = DEFAULT) -> DataFrame:
    """(doc_id, chunk_index, content, page_from, page_to, token_count, language) in order of page, Spanish before Basque."""
    kind = pa.list_(pa.struct([("content", pa.string()), ("page_from", pa.int32()), ("page_to", pa.int32()), ("token_count", pa.int32())]))
    target, cap = settings.chunk_token_target, settings.chunk_token_cap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SEGMENTS):
                batch = whole.slice(at, SEGMENTS)
                made = [chunks_of(p.as_py(), s.as_py() > 0, count, target, cap) for s, p in zip(batch.column("segment"), batch.column("pieces"), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*STREAM, "segment")), pa.array(made, kind)], [*STREAM, "segment", "c"])
            whole = batch = made = None
            pa.default_memory_pool().release_unused()

    ship(units.sparkSession)
    found = segments(units)
    ids = {f.name: f.dataType.simpleString() for f in found.schema if f.name in (*STREAM, "segment")}
    rows = found.select(*STREAM, "segment", "pieces").mapInArrow(run, ", ".join(f"{k} {v}" for k, v in ids.items()) + f", c {CHUNK}")
    rows = rows.select(*STREAM, "segment", F.posexplode("c").alias("n", "c"))
    order = Window.partitionBy("doc_id").orderBy("c.page_from", F.col("lang") == "eu", "segment", "n")
    return rows.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), "c.content", "c.page_from", "c.page_to", "c.token_count", F.col("lang").alias("language"))


def article_lengths(units: DataFrame, count: Callable[[Column], Column] = word_count) -> DataFrame:
    """Tokens of each article segment before it is cut, by a column function: words, or `tokens.column` of a counter."""
    rows = segments(units).filter("segment > 0").withColumn("text", F.trim(F.array_join(F.transform("pieces", lambda p: p["text"]), "")))
    return rows.filter("text <> ''").select(*STREAM, "segment", count(F.col("text")).alias("tokens"))
