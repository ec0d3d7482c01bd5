"""Exact dedup over an extendible-hash index on shared files, in DataFrame operations only.

Texts are equal when they are after all white space (space, tab to carriage return) is deleted. Of equal texts the row with the most
code points in the original text stays, then the one with the smallest id.

A key is a 64-bit hash of the normalised text; an entry holds a key, how many rows have it, and which of them would stay.
The directory has slots by the leading bits of a key. It begins as one bucket; as long as a bucket holds more than `capacity` entries, the
directory doubles and the bucket is split by the next bit, up to 2^MAX_DEPTH slots. Whether a bucket splits depends on the entries below its
prefix alone, so all rounds are one aggregation over the slots, of which there are 65,536 at most whatever the input. A bucket that is still
too full then stays as it is: larger, not cut off. Index files hold entries by ranges of buckets, sorted by key; a reader that looks for a key
skips files and row groups by their minima and maxima.

Equal keys are not yet equal texts. Texts of keys with more than one row are compared byte by byte: rows are grouped by
key and text before they move, so that a group of copies moves once a task and not once a row, and go to owner tasks by ranges of
buckets, which chain the different texts of a key. A key whose chain has one link is settled. The rows of
longer chains are read again and find their link by key and text.

Defined cases: a null text counts as empty. A null id comes after all others. Rows that are equal in id and text are marked alike, so each repeat of
the row that stays is `kept`; `drop_copies` leaves one of them (any, if their other columns differ). Empty tables give no
rows. Extra columns are ignored (`groups`) or kept (`drop_copies`), whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliant.llm.marks import marked, marks
from foliant.llm.storage import materialise

#: Entries of a bucket beyond which it is split, and the bits of a key that the directory can use.
CAPACITY, MAX_DEPTH = 50_000, 16


@dataclass(frozen=True)
class Index:
    """`directory` (slot, depth, bucket), `entries` (bucket, h, n, chars, id) and `chains` (bucket, h, link, links, norm), all on shared files."""

    directory: DataFrame
    entries: DataFrame
    chains: DataFrame


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", "")


def _key(norm: Column, bits: int) -> Column:
    return F.xxhash64(norm).bitwiseAND(F.lit(-1 << (64 - bits)))


def _rows(docs: DataFrame, bits: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, chars, h, norm) of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("chars"), normalised(F.col(text_col)).alias("norm"))
    return rows.withColumn("h", _key(F.col("norm"), bits))


def _slot(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - MAX_DEPTH).cast("int")


def _kept() -> tuple[Column, Column, Column]:
    """Number of rows, and code points and id of the one that stays, of a group of (doc_id, chars). An inverted id is largest for the smallest one, and null is below all."""
    best = F.max(F.struct("chars", F.bitwise_not("doc_id").alias("last")))
    return F.count("*").alias("n"), best["chars"].alias("chars"), F.bitwise_not(best["last"]).alias("id")


def directory(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(slot, depth, bucket) for every slot that holds a key: the bits its bucket uses, and the bucket, named by its first slot."""
    slots = entries.groupBy(_slot(F.col("h")).alias("slot")).agg(F.count("*").alias("n"))
    # The bucket of a slot in each round of doubling.
    rounds = slots.select("slot", "n", F.explode(F.sequence(F.lit(0), F.lit(MAX_DEPTH))).alias("depth"))
    rounds = rounds.withColumn("bucket", F.expr(f"shiftleft(shiftright(slot, {MAX_DEPTH} - depth), {MAX_DEPTH} - depth)"))
    sizes = rounds.groupBy("depth", "bucket").agg(F.sum("n").alias("size"))
    # Splitting ends in the first round in which the bucket fits. There are fewer than 2^(MAX_DEPTH + 1) buckets of all rounds.
    ends = rounds.join(F.broadcast(sizes), ["depth", "bucket"]).filter((F.col("size") <= capacity) | (F.col("depth") == MAX_DEPTH))
    return ends.groupBy("slot").agg(F.min("depth").alias("depth"), F.min_by("bucket", "depth").alias("bucket"))


def _in_buckets(keyed: DataFrame, slots: DataFrame) -> DataFrame:
    """Rows with `h` with their bucket; the directory is broadcast, it has at most 2^MAX_DEPTH rows."""
    return keyed.withColumn("slot", _slot(F.col("h"))).join(F.broadcast(slots.select("slot", "bucket")), "slot").drop("slot")


def build(docs: DataFrame, rows: DataFrame, capacity: int = CAPACITY, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index of all documents; `rows` holds their (doc_id, chars, h)."""
    keys = materialise(rows.groupBy("h").agg(*_kept()), "keys")
    slots = materialise(directory(keys, capacity), "directory")
    entries = _in_buckets(keys, slots).repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h")
    entries = materialise(entries.select("bucket", "h", "n", "chars", "id"), "buckets")
    again = marks(entries.filter("n > 1").select(F.col("h").alias("x")))
    texts = marked(_rows(docs, bits, id_col, text_col).select("h", "norm"), "h", again).groupBy("h", "norm").agg(F.count("*").alias("n"))
    owned = _in_buckets(texts, slots).repartitionByRange("bucket", "h")
    chain = Window.partitionBy("bucket", "h")
    links = owned.withColumns({"link": F.row_number().over(chain.orderBy("norm")), "links": F.count("*").over(chain)})
    # A text is needed again only where another one has its key.
    chains = links.select("bucket", "h", "link", "links", F.when(F.col("links") > 1, F.col("norm")).alias("norm"))
    return Index(slots, entries, materialise(chains.filter("links > 1"), "chains"))


def _found(docs: DataFrame, capacity: int, bits: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, chars, h, sha, n, best, id): every row with its group; `best` and `id` are code points and id of the one that stays."""
    read = _rows(docs, bits, id_col, text_col)
    rows = materialise(read.select("doc_id", "chars", "h", F.sha2(F.col("norm").cast("binary"), 256).alias("sha")), "rows")
    index = build(docs, rows, capacity, bits, id_col, text_col)
    chained = index.chains.select("h").distinct()
    # Both sides are plain files, so that a key with very many rows can be split over tasks.
    single = rows.join(index.entries.select("h", "n", F.col("chars").alias("best"), "id"), "h")
    if index.chains.isEmpty():
        return single.select("doc_id", "chars", "h", "sha", "n", "best", "id")
    again = marked(read, "h", marks(chained.select(F.col("h").alias("x"))))
    again = materialise(again.join(index.chains.select("h", "norm", "link"), ["h", "norm"]).select("doc_id", "chars", "h", "link", F.sha2(F.col("norm").cast("binary"), 256).alias("sha")), "linked")
    links = materialise(again.groupBy("h", "link").agg(*_kept()), "links").withColumnRenamed("chars", "best")
    single = single.join(materialise(chained, "chained"), "h", "left_anti")
    return single.select("doc_id", "chars", "h", "sha", "n", "best", "id").unionByName(again.join(links, ["h", "link"]).select("doc_id", "chars", "h", "sha", "n", "best", "id"))


def _stays() -> Column:
    return (F.col("chars") == F.col("best")) & F.col("doc_id").eqNullSafe(F.col("id"))


def groups(docs: DataFrame, capacity: int = CAPACITY, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id (the id of the row that stays), group_size, kept, text_sha256 of every row. `bits`: leading bits of the hash that are
    used; any number gives the same result, a small one makes long chains."""
    return _found(docs, capacity, bits, id_col, text_col).select("doc_id", F.col("id").alias("keep_id"), F.col("n").alias("group_size"), _stays().alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, capacity: int = CAPACITY, bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, all columns as they were."""
    stay = _found(docs, capacity, bits, id_col, text_col).filter(_stays()).select(F.col("doc_id").alias("i"), F.col("sha").alias("s"), F.col("chars").alias("c")).distinct()
    own = docs.select(F.struct("*").alias("own"), F.col(id_col).cast("long").alias("id"), F.sha2(normalised(F.col(text_col)).cast("binary"), 256).alias("sha"), F.length(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).cast("long").alias("chars"))
    found = own.join(stay, F.col("id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s")) & (F.col("chars") == F.col("c")), "left_semi")
    return found.dropDuplicates(["id", "sha", "chars"]).select("own.*")
