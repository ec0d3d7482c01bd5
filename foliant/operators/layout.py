"""From page geometry to clean text streams, one for each language of a document.

glyphs -> lines and blocks without false spaces -> furniture marked by repetition in the margins
-> page layout from positive evidence -> units of text in reading order.

Only furniture needs a whole document at once (an aggregation by document and line key); all
else is by page, line or block.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliant.config import DEFAULT, Settings
from foliant.functions import text as T

# What official bulletins print in their margins.
BOILERPLATE = (
    r"(?iu)(bolet[íi]n\s+oficial|aldizkari\s+ofiziala|d\.?\s*l\.?\s*:|issn|www\.[\w.-]+\.(?:eus|es|com|net)|n[úu]m\.\s*\d|"
    r"^\s*\d+\s*/\s*\d+\s*$|p[áa]g(?:ina)?s?\.?\s*\d)"
)
LINE = ["doc_id", "page", "block_no", "line_no"]
GUTTER, ROW_TOLERANCE, SHORT_CELL = 0.04, 6.0, 30


def _share(x: float) -> Column:
    """A share as a decimal: its product with a count is exact, where 0.55 * 100 as doubles is more than 55."""
    return F.lit(Decimal(str(x)))


def lines(glyphs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Text of each line of glyphs (LINE, glyph_no, c, x0, x1), a row for each glyph. Where a parser gives a line's glyphs together, `despaced` takes them without a shuffle."""
    return despaced(glyphs.groupBy(*LINE).agg(F.collect_list(F.struct("glyph_no", "c", "x0", "x1")).alias("g")), settings)


def page_lines(pages: DataFrame) -> DataFrame:
    """(LINE, g), as `despaced` takes them, of pages (doc_id, page, glyphs): glyphs are cut into lines within their page, and none is shuffled."""
    # Sorted they stand by block, line and number; a line begins where the block or line is another than before.
    rows = pages.filter(F.size("glyphs") > 0).select("doc_id", "page", F.sort_array("glyphs").alias("s"))
    other = lambda i, c: ~F.get("s", i)[c].eqNullSafe(F.get("s", i - 1)[c])
    begins = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: (i == 0) | other(i, "block_no") | other(i, "line_no"))
    rows = rows.withColumn("at", begins)
    ends = F.zip_with("at", F.slice("at", F.lit(2), F.size("at")), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    own = lambda e: F.transform(F.slice("s", e["a"] + 1, F.coalesce(e["b"], F.size("s")) - e["a"]), lambda x: F.struct(*[x[c].alias(c) for c in ("glyph_no", "c", "x0", "x1")]))
    first = lambda e: F.get("s", e["a"])
    cut = F.transform(ends, lambda e: F.struct(first(e)["block_no"].alias("block_no"), first(e)["line_no"].alias("line_no"), own(e).alias("g")))
    return rows.select("doc_id", "page", F.explode(cut).alias("l")).select("doc_id", "page", "l.*")


def despaced(rows: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Text of each line (LINE, g: its glyphs), spaces where the gap to the glyph before reaches a share of the line's median glyph width.

    White space among the glyphs is ignored, and lines of nothing else go. `long_tokens` counts runs that are suspiciously long."""
    rows = rows.select(*LINE, F.array_sort(F.filter("g", lambda x: ~x["c"].rlike(r"(?U)^\s+$"))).alias("g"))
    rows = rows.withColumn("w", F.array_sort(F.filter(F.transform("g", lambda x: x["x1"] - x["x0"]), lambda w: w > 0)))
    n = F.size("w")
    middle = (F.get("w", F.floor((n - 1) / 2).cast("int")) + F.get("w", F.floor(n / 2).cast("int"))) / 2
    rows = rows.withColumn("median", F.when(n > 0, middle).otherwise(1.0)).drop("w")
    before = lambda i: F.get(F.col("g"), i - 1)["x1"]
    spaced = F.transform("g", lambda x, i: F.concat(F.when((i > 0) & (x["x0"] - before(i) >= settings.space_gap_ratio * F.col("median")), " ").otherwise(""), x["c"]))
    # As an element that is exploded: a filter would be moved to where it makes all of this twice.
    made = F.when(F.size("g") > 0, F.array(F.struct(F.array_join(spaced, "").alias("text"), F.size("g").alias("n"))))
    out = rows.select(*LINE, F.explode(made).alias("o")).select(*LINE, "o.*")
    runs = F.size(F.filter(F.split("text", " "), lambda t: F.length(t) > settings.long_token))
    return out.select(*LINE, "text", F.when(F.col("n") > 1, runs).otherwise(0).alias("long_tokens"))


def block_texts(glyphs: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Text of each block of glyphs."""
    return joined(lines(glyphs, settings))


def joined(lines: DataFrame) -> DataFrame:
    """Text of each block: its lines (as from `despaced`) joined, words broken at line ends mended."""
    rows = lines.groupBy("doc_id", "page", "block_no").agg(F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("line_no", F.trim("text").alias("t"))))).alias("l"), F.sum("long_tokens").alias("long_tokens"))
    return rows.select("doc_id", "page", "block_no", T.join_lines(F.transform("l", lambda x: x["t"])).alias("text"), "long_tokens")


def blocks_of(glyphs: DataFrame, boxes: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Block texts with the geometry in boxes (doc_id, page, block_no, pw, ph, x0, x1, y0, y1); blocks without text go, a page size of zero is one."""
    return boxed(block_texts(glyphs, settings), boxes)


def boxed(texts: DataFrame, boxes: DataFrame) -> DataFrame:
    """As `blocks_of`, of texts of blocks (as from `joined`)."""
    b = boxes.join(texts.filter("text <> ''"), ["doc_id", "page", "block_no"])
    one = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c)).alias(c)
    return b.select("doc_id", "block_no", "page", one("pw"), one("ph"), "x0", "x1", "y0", "y1", ((F.col("x0") + F.col("x1")) / 2).alias("x_mid"), (F.col("x1") - F.col("x0")).alias("width"), "text", "long_tokens")


def in_margin(settings: Settings = DEFAULT) -> Column:
    return (F.col("y0") < settings.margin_top * F.col("ph")) | (F.col("y1") > settings.margin_bottom * F.col("ph"))


def repeating(blocks: DataFrame, doc_pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """(doc_id, key) of the margin lines that recur on enough pages; doc_pages (doc_id, page_count) counts pages without text too."""
    keyed = blocks.filter(in_margin(settings)).withColumn("key", T.line_key(F.col("text"))).filter(F.length("key").between(1, settings.furniture_key_chars))
    pages = keyed.groupBy("doc_id", "key").agg(F.countDistinct("page").alias("pages")).join(doc_pages, "doc_id")
    return pages.filter((F.col("page_count") > 1) & (F.col("pages") >= 2) & (F.col("pages") >= (_share(settings.repeat_page_fraction) * F.col("page_count")))).select("doc_id", "key")


def _marked(blocks: DataFrame, doc_pages: DataFrame, settings: Settings) -> DataFrame:
    """The blocks with the flag `furniture` and, where it is one, the repeating line as `again`."""
    again = repeating(blocks, doc_pages, settings).withColumn("again", F.lit(True))
    keyed = blocks.withColumn("key", T.line_key(F.col("text"))).join(again, ["doc_id", "key"], "left")
    known = (F.length("key") <= settings.furniture_key_chars) & F.col("text").rlike(BOILERPLATE)
    repeats = F.coalesce("again", F.lit(False))
    keyed = keyed.withColumns({"furniture": in_margin(settings) & (repeats | known), "again": F.when(in_margin(settings) & repeats, F.col("key"))})
    return keyed.drop("key")


def marked(blocks: DataFrame, doc_pages: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """The blocks with the flag `furniture`: in a margin, and repeating or known boilerplate."""
    return _marked(blocks, doc_pages, settings).drop("again")


def band_semi_join(left: DataFrame, right: DataFrame, keys: list[str], column: str, width: float) -> DataFrame:
    """The rows of left, each as often as it is there, that have a row of right with equal keys and a value of `column` less than `width` away.

    Values are binned by width and rows of right stand in three bins, so that the join is a left-semi equality join on keys and bin:
    it stops at the first match and makes no pairs."""
    spot = F.floor(F.col(column) / width)
    l = left.withColumn("__bin", spot)
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(column).alias("__v"), F.explode(F.sequence(spot - 1, spot + 1)).alias("__near")).distinct()
    same = [l[k] == r[f"__{k}"] for k in keys]
    met = (l["__bin"] == r["__near"]) & (F.abs(l[column] - r["__v"]) < width)
    for condition in same:
        met = condition & met
    return l.join(r, met, "left_semi").drop("__bin")


def pages(blocks: DataFrame, settings: Settings = DEFAULT) -> DataFrame:
    """Layout of each page with text: two_column, tabular, has_straddle, es_ratio of either side, bilingual.

    Two columns need positive evidence: balanced, tall, overlapping sides with a clear gutter, not a table of
    short cells in rows. All else is one column."""
    center, gutter = F.col("pw") / 2, GUTTER * F.col("pw")
    side = F.when((F.col("x0") < center - gutter) & (F.col("x1") > center + gutter), "s").when(F.col("x_mid") < center, "l").otherwise("r")
    half = F.when(F.col("x_mid") < center, "l").otherwise("r")
    # Blocks are joined by spaces, which are in no word: words and function words of a side are sums over its blocks.
    words, known = T.words_of(F.col("text"))
    b = blocks.withColumns({"side": side, "half": half, "chars": F.length("text"), "words": words, "known": known})
    # Right blocks that stand in a row with a left one, over a window of values instead of every two of a page.
    row = Window.partitionBy("doc_id", "page").orderBy("y0")
    y = F.when(F.col("side") == "r", F.col("y0"))
    above = F.max(y).over(row.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    # Read backwards, what is below came before: a running value, where a frame to the end would be walked again for each block.
    back = Window.partitionBy("doc_id", "page").orderBy(F.desc("y0"))
    below = F.min(y).over(back.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    near = lambda other: F.coalesce(F.abs(F.col("y0") - other) < ROW_TOLERANCE, F.lit(False))
    b = b.withColumn("paired", near(above) | near(below))
    vol = lambda s: F.coalesce(F.sum(F.when(F.col("side") == s, F.col("chars"))), F.lit(0)).alias(f"{s}vol")
    of = lambda f, s, c: f(F.when(F.col("side") == s, F.col(c)))
    total = lambda h, c: F.coalesce(F.sum(F.when(F.col("half") == h, F.col(c))), F.lit(0)).alias(f"{h}{c}")
    p = b.groupBy("doc_id", "page").agg(
        F.min_by("ph", "block_no").alias("ph"),
        *[vol(s) for s in "lrs"],
        *[F.count_if(F.col("side") == s).alias(f"{s}n") for s in "lr"],
        *[of(f, s, c).alias(f"{s}_{c}") for s in "lr" for f, c in ((F.min, "y0"), (F.max, "y1"))],
        F.count_if((F.col("side") == "l") & F.col("paired")).alias("paired"),
        F.count_if((F.col("side") != "s") & (F.col("chars") < SHORT_CELL)).alias("short"),
        *[total(h, c) for h in "lr" for c in ("words", "known")],
    )
    sides = F.col("ln") + F.col("rn")
    tabular = (F.col("ln") >= 3) & (F.col("paired") > _share(0.6) * F.col("ln")) & (sides > 0) & (F.col("short") > 0.5 * sides)
    span = lambda s: F.coalesce(F.col(f"{s}_y1") - F.col(f"{s}_y0"), F.lit(0.0))
    overlap = F.coalesce(F.greatest(F.lit(0.0), F.least("l_y1", "r_y1") - F.greatest("l_y0", "r_y0")), F.lit(0.0))
    overlap = F.when((F.col("ln") > 0) & (F.col("rn") > 0), overlap).otherwise(0.0)
    most, fewest = F.greatest("lvol", "rvol"), F.least("lvol", "rvol")
    two = (F.col("ln") >= 2) & (F.col("rn") >= 2) & (most > 0) & (fewest >= _share(0.55) * most) & (span("l") >= 0.5 * F.col("ph")) & (span("r") >= 0.5 * F.col("ph")) & (overlap >= 0.4 * F.col("ph"))
    two = two & (F.col("lvol") + F.col("rvol") > 0) & (F.col("svol") <= _share(0.15) * (F.col("lvol") + F.col("rvol"))) & ~F.col("tabular")
    p = p.withColumn("tabular", tabular).withColumn("two_column", two).withColumn("has_straddle", F.col("svol") > 0)
    p = p.withColumns({f"{h}_ratio": F.when(F.col(f"{h}words") > 0, F.col(f"{h}known") / F.col(f"{h}words")).otherwise(0.0) for h in "lr"})
    low, high = F.least("l_ratio", "r_ratio"), F.greatest("l_ratio", "r_ratio")
    return p.select("doc_id", "page", "two_column", "tabular", "has_straddle", "l_ratio", "r_ratio", (F.col("two_column") & (low < 0.05) & (high > 0.07)).alias("bilingual"))


def units(blocks: DataFrame, layout: DataFrame) -> DataFrame:
    """(doc_id, lang, unit_no, page, text): the blocks in reading order, in the stream of their language.

    On a bilingual page the side with fewer Spanish function words is Basque. On other pages of two columns the left column comes first."""
    b = blocks.join(layout, ["doc_id", "page"])
    left = F.col("x_mid") < F.col("pw") / 2
    basque = F.col("bilingual") & (left == (F.col("l_ratio") <= F.col("r_ratio")))
    col = F.when(F.col("two_column") & ~F.col("bilingual") & ~left, 1).otherwise(0)
    b = b.withColumns({"lang": F.when(basque, "eu").otherwise("es"), "col": col})
    order = Window.partitionBy("doc_id", "lang").orderBy("page", "col", "y0", "block_no")
    return b.select("doc_id", "lang", (F.row_number().over(order) - 1).alias("unit_no"), "page", "text")


def stats(all_blocks: DataFrame, layout: DataFrame, doc_pages: DataFrame) -> DataFrame:
    """Counters and lists of each document; all_blocks holds the flag `furniture` and the repeating lines as `again`."""
    b = all_blocks.groupBy("doc_id").agg(F.count("*").alias("blocks_total"), F.count_if(~F.col("furniture")).alias("column_blocks_kept"), F.count_if("furniture").alias("furniture_blocks_stripped"), F.sum("long_tokens").alias("long_token_flags"), F.sort_array(F.collect_set("again")).alias("repeating_furniture_lines"))
    unclear = (F.col("bilingual") & F.col("has_straddle")) | (~F.col("two_column") & F.col("tabular"))
    p = layout.groupBy("doc_id").agg(F.count_if("two_column").alias("two_column_pages"), F.count_if("bilingual").alias("bilingual_pages"), F.count_if(~F.col("two_column")).alias("single_column_pages"), F.count_if("tabular").alias("tabular_pages"), F.sort_array(F.collect_set(F.when(unclear, F.col("page")))).alias("pages_not_cleanly_split"))
    out = doc_pages.join(b, "doc_id", "left").join(p, "doc_id", "left")
    counts = ["blocks_total", "column_blocks_kept", "furniture_blocks_stripped", "long_token_flags", "two_column_pages", "bilingual_pages", "single_column_pages", "tabular_pages"]
    return out.select("doc_id", "page_count", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts], F.coalesce("repeating_furniture_lines", F.array().cast("array<string>")).alias("repeating_furniture_lines"), F.coalesce("pages_not_cleanly_split", F.array().cast("array<int>")).alias("pages_not_cleanly_split"))


def language_streams(blocks: DataFrame, doc_pages: DataFrame, settings: Settings = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """Units and statistics of documents whose blocks and page counts are given."""
    flagged = _marked(blocks, doc_pages, settings)
    kept = flagged.filter(~F.col("furniture")).drop("again")
    layout = pages(kept, settings)
    return units(kept, layout), stats(flagged, layout, doc_pages)
