"""Line dedup by a segment-partition edit join, in DataFrame operations only.

A line of at least `min_chars` characters goes when an earlier line (smaller document id, a
null id last, then text key, then place) is equal to it or within so many edits: `max_edits`, and more
for longer lines (`wider`); lengths count in steps of STEP characters, and the shorter of two lines decides. With
`short`, a shorter line that is not blank goes when an earlier line is equal to it; else it stays.

Near lines are found as follows. With k edits, k + 1 segments of equal length are laid out, for all lines of one step of
lengths alike, the first ones from the start of a line and the last ones from its end. Of two lines within k edits, one has a
segment i unchanged in the other with i - 1 edits before it and k + 1 - i after it at most, so that it stands there at most
that far from its place, counted from the nearer end. Index keys are (step, segment number, segment); a line probes the
places around, and lines just above a step of lengths also take part in the step below. Keys that one line alone has are
dropped before any text is moved. Texts of the rest meet on their key:
first counts of frequent letters (each edit changes them by two at most), then the banded edit
distance decide. A left-semi join asks only whether an earlier match exists, so a group of
alike lines yields a row for each line, never its pairs.

The distance is Spark's built-in `levenshtein` with a threshold, a banded computation that
stays in generated JVM code; a bit-parallel form built from higher-order functions is
interpreted for each character and is slower.

Defined cases: a null text has no lines, an empty text one empty line. Rows with the same id
and text are judged alike. Extra columns are ignored (`removals`) or kept (`drop_repeats`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliant.llm.marks import marked, marks
from foliant.llm.storage import materialise

MAX_EDITS, MIN_CHARS = 2, 40
#: From so many characters on, so many edits.
WIDER = ((160, 3), (480, 4))
#: Lengths for which segments are laid out alike.
STEP = 16
#: Characters whose counts are compared before the distance. Any choice gives the same result.
COUNTED = " etaonirsldhucmpg"


def _lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, short: bool = False) -> DataFrame:
    """(doc_id, key, pos, line, h1, h2) of each long line, and of short ones that are not blank if asked for; h1, h2: two hashes of the line."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    rows = rows.filter((F.length("line") >= min_chars) | F.col("line").rlike(r"\S") if short else F.length("line") >= min_chars)
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line")})


def _rank() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id"), F.col("key"), F.col("pos"))


def _base(n: Column, least: int) -> Column:
    """The smallest length of the step of lengths that a length is in."""
    return (n - (n - least) % STEP).cast("int")


def _edits(base: Column, k: int, wider: tuple[tuple[int, int], ...]) -> Column:
    out = F.lit(k)
    for length, more in sorted(wider):
        out = F.when(base >= length, max(k, more)).otherwise(out)
    return out


def _layout(k: int) -> list[tuple[int, int, bool]]:
    """(segment, places it is off, whether it is counted from the start) of the keys for k edits; the index keys are those not off."""
    reach = lambda i: min(i - 1, k + 1 - i)
    return [(i, d, i - 1 <= k + 1 - i) for i in range(1, k + 2) for d in range(-reach(i), reach(i) + 1)]


def _keys(lines: DataFrame, k: int, least: int, wider: tuple[tuple[int, int], ...]) -> DataFrame:
    """(s, id, kind): the keys of each line; kind 0 is an index key, 1 one that only probes.

    A line is exploded into the numbers of its keys and one expression makes any of them: an expression for each would
    be generated code too long for the JVM to compile."""
    cut = lines.select(F.col("h1").alias("id"), "line", F.length("line").alias("n")).withColumn("base", _base(F.col("n"), least))
    cut = cut.withColumns({"k": _edits(F.col("base"), k, wider), "below": _edits(F.col("base") - STEP, k, wider)})
    layouts = {e: _layout(e) for e in range(max(k, *(more for _, more in wider), 0) + 1)}
    rows = [row for e in layouts for row in layouts[e]]
    starts, at = [], 0
    for e in layouts:
        starts.append(at)
        at += len(layouts[e])
    literal = lambda values: F.array(*map(F.lit, values))
    of = lambda values, at: F.get(literal(values), at)
    sizes = [len(x) for x in layouts.values()]
    # Lines just above a step of lengths take part in the step below too.
    both = (F.col("base") > least) & (F.col("n") < F.col("base") + F.col("below"))
    cut = cut.withColumn("own", of(sizes, F.col("k"))).withColumn("all", F.col("own") + F.when(both, of(sizes, F.col("below"))).otherwise(0))
    # Bytes of a line of ASCII are cut without counting its characters; the bytes that are hashed are the same.
    cut = cut.withColumn("raw", F.when(F.octet_length("line") == F.col("n"), F.col("line").cast("binary")))
    one = cut.select("id", "line", "raw", "n", "base", "k", "below", "own", F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("j"))
    first = F.col("j") < F.col("own")
    one = one.select("id", "line", "raw", "n", F.when(first, F.col("base")).otherwise(F.col("base") - STEP).alias("b"), F.when(first, F.col("k")).otherwise(F.col("below")).alias("e"), F.when(first, F.col("j")).otherwise(F.col("j") - F.col("own")).alias("j"))
    one = one.withColumn("j", of(starts, F.col("e")) + F.col("j")).withColumn("size", F.floor(F.col("b") / (F.col("e") + 1)).cast("int"))
    one = one.withColumns({"i": of([r[0] for r in rows], F.col("j")), "d": of([r[1] for r in rows], F.col("j")), "left": of([r[2] for r in rows], F.col("j"))})
    place = F.when(F.col("left"), F.col("size") * (F.col("i") - 1)).otherwise(F.col("n") - F.col("size") * (F.col("e") + 2 - F.col("i"))) + 1 + F.col("d")
    segment = F.when(F.col("raw").isNotNull(), F.substring("raw", place, F.col("size"))).otherwise(F.substring("line", place, F.col("size")).cast("binary"))
    # An array of one is exploded so that what uses the key does not compute it again.
    return one.select(F.explode(F.array(F.xxhash64("b", "i", segment))).alias("s"), "id", (F.col("d") != 0).cast("int").alias("kind"))


def _near(lines: DataFrame, k: int, least: int, wider: tuple[tuple[int, int], ...]) -> DataFrame:
    """(h1, h2) of the lines that have an earlier, different one within k edits, or more for longer ones."""
    # Keys are made once and written: to make them again costs more than to read them.
    keys = materialise(_keys(lines, k, least, wider), "keys")
    shared = keys.groupBy("s").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.min("kind").alias("c")).filter("a <> b and c = 0").select("s")
    shared = materialise(shared, "shared")
    # Inner joins with unique keys: a semi join would be pushed below the filter, and all rows would be shuffled.
    hits = materialise(marked(keys, "s", marks(shared.select(F.col("s").alias("x")))).join(shared, "s").distinct(), "hits")
    ids = materialise(hits.select("id").distinct(), "ids")
    texts = marked(lines.withColumn("id", F.col("h1")), "id", marks(ids.select(F.col("id").alias("x")))).join(ids, "id")
    texts = texts.groupBy("id", "h1", "h2").agg(F.min(_rank()).alias("head"), F.first("line").alias("line"))
    texts = texts.select("*", F.length("line").alias("n"), *[(F.length("line") - F.length(F.replace("line", F.lit(c)))).alias(f"c{j}") for j, c in enumerate(COUNTED)])
    texts = texts.withColumn("k", _edits(_base(F.col("n"), least), k, wider))
    rows = materialise(texts.join(hits, "id"), "lines")
    moved = lambda a, b: sum((F.abs(F.col(f"{a}.c{j}") - F.col(f"{b}.c{j}")) for j in range(len(COUNTED))), F.lit(0))
    found = []
    for mine, other in (("kind = 0", "kind >= 0"), ("kind = 1", "kind = 0")):
        x, y = rows.filter(mine).alias("x"), rows.filter(other).alias("y")
        most = F.least("x.k", "y.k")
        same = (F.col("x.s") == F.col("y.s")) & (F.col("y.head") < F.col("x.head")) & (F.abs(F.col("x.n") - F.col("y.n")) <= most) & (moved("x", "y") <= 2 * most)
        found.append(x.join(y, same & F.expr("levenshtein(x.line, y.line, least(x.k, y.k)) >= 0"), "left_semi").select("h1", "h2"))
    return found[0].unionByName(found[1]).distinct()


def removals(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", short: bool = False, wider: tuple[tuple[int, int], ...] = WIDER) -> DataFrame:
    """A row for each document (id and text) with lines to remove: doc_id, key (hash of the text), the places (0-based,
    ascending) of the long lines that equal an earlier one, of those that are only near one, and of the short lines that equal one."""
    lines = _lines(docs, id_col, text_col, min_chars, short)
    again = lines.groupBy("h1", "h2").agg(F.count("*").alias("times")).filter("times > 1").select("h1", "h2", F.lit(False).alias("near"))
    if max_edits or wider:
        again = again.unionByName(_near(_lines(docs, id_col, text_col, min_chars), max_edits, min_chars, wider).withColumn("near", F.lit(True)))
    again = materialise(again.groupBy("h1", "h2").agg(F.bool_or("near").alias("near")), "again")
    # Only lines that recur or have a near one go on.
    placed = lines.select("h1", "h2", "doc_id", "key", "pos", (F.length("line") < min_chars).alias("short"))
    placed = materialise(marked(placed, "h1", marks(again.select(F.col("h1").alias("x")))).join(again, ["h1", "h2"]), "placed")
    # Written, so that the join below has two plain sides and a very common line can be split over tasks.
    heads = materialise(placed.groupBy("h1", "h2").agg(F.min(_rank()).alias("head")), "heads")
    judged = placed.join(heads, ["h1", "h2"]).withColumn("equal", _rank() != F.col("head")).filter("equal or near")
    places = lambda c: F.array_sort(F.array_distinct(F.collect_list(F.when(c, F.col("pos")))))
    return judged.groupBy("doc_id", "key").agg(places(F.expr("equal and not short")).alias("equal"), places(~F.col("equal")).alias("near"), places(F.expr("equal and short")).alias("short"))


def with_removals(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", short: bool = False, wider: tuple[tuple[int, int], ...] = WIDER) -> DataFrame:
    """doc_id, n_lines, and the places of lines to remove (`equal`, `near`, and `short` if asked for) of every document."""
    text = F.col(text_col).cast("string")
    found = removals(docs, max_edits, min_chars, id_col, text_col, short, wider).withColumnsRenamed({"doc_id": "i", "key": "k"})
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).alias("n_lines"))
    own = own.withColumn("n_lines", F.greatest("n_lines", F.lit(0)).cast("long"))
    none = F.array().cast("array<int>")
    return own.join(found, own["doc_id"].eqNullSafe(found["i"]) & (own["key"] == found["k"]), "left").select("doc_id", "n_lines", *[F.coalesce(c, none).alias(c) for c in ("equal", "near", "short")[: 3 if short else 2]])


def drop_repeats(docs: DataFrame, max_edits: int = MAX_EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text", short: bool = False, wider: tuple[tuple[int, int], ...] = WIDER) -> DataFrame:
    """The documents, all columns as they were but the text, which loses its repeated lines. A document that loses all its lines goes."""
    found = removals(docs, max_edits, min_chars, id_col, text_col, short, wider).select(F.col("doc_id").alias("i"), F.col("key").alias("k"), F.concat("equal", "near", "short").alias("gone"))
    # The caller's row travels as one column, so that no name of its own can meet one of these.
    rows = docs.select(F.struct("*").alias("own"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("key"))
    text = F.col("own").getField(text_col)
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("key") == F.col("k")), "left")
    kept = F.filter(F.split(text.cast("string"), "\n"), lambda line, at: ~F.array_contains(F.col("gone"), at))
    out = joined.withColumn("kept", F.when(F.col("gone").isNotNull(), kept)).filter("kept is null or size(kept) > 0")
    return out.select(*[(F.coalesce(F.array_join("kept", "\n"), text) if c == text_col else F.col("own").getField(c)).alias(c) for c in docs.columns])
