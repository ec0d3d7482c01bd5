"""Records of WARC files, read by Spark's text source: no file is gathered, and files that are not compressed are split.

A file is cut before each line that begins a record, `WARC/1.` after the blank lines that end the one before; gzip files
of one member a record are read through as one stream. Values stay bytes: only headers are decoded. Columns: version,
headers (names in lower case, repeated ones joined by a comma), block (the bytes that Content-Length names) and whole (whether
so many were there).

Defined cases: a record without Content-Length has the whole rest as its block. A block that itself holds the start of a record after
blank lines is cut there: such a record is not `whole`, and the pieces that follow have no type. Empty files have no
records. Headers without a colon are left out; folded ones are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_END = "\r\n\r\n"
#: The profile of revisits that stand for a response that was not modified.
NOT_MODIFIED = "server-not-modified"


def _headers(head: Column) -> Column:
    """A map of the lines `name: value` of a text."""
    lines = F.filter(F.split(F.regexp_replace(head, r"\r?\n[ \t]+", " "), r"\r?\n"), lambda x: F.instr(x, ":") > 1)
    name = lambda x: F.lower(F.trim(F.substring_index(x, ":", 1)))
    value = lambda x: F.trim(F.substr(x, F.instr(x, ":") + 1))
    pairs = F.transform(lines, lambda x: F.struct(name(x).alias("n"), value(x).alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["n"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_join(F.transform(F.filter(pairs, lambda p: p["n"] == n), lambda p: p["v"]), ", ")))


def _after(raw: Column, head: Column) -> Column:
    """The bytes after the blank line that ends a head."""
    return F.substr(raw, F.octet_length(head) + 1 + len(_END))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """The records of the files under `path`, plain or gzip."""
    rows = spark.read.option("lineSep", f"{_END}WARC/1.").text(path).filter(F.octet_length("value") > 0)
    head = F.substring_index("value", _END, 1)
    # The first record of a file still has the mark before which the others are cut.
    rows = rows.select(F.regexp_replace(F.substring_index(head, "\r\n", 1), r"^WARC/1\.", "").alias("minor"), _headers(head).alias("headers"), _after(F.col("value").cast("binary"), head).alias("rest"))
    size = F.try_element_at("headers", F.lit("content-length")).try_cast("int")
    block = F.when(size.isNull(), F.col("rest")).otherwise(F.substr("rest", F.lit(1), size))
    return rows.select(F.concat(F.lit("1."), "minor").alias("version"), "headers", block.alias("block"), F.coalesce(F.octet_length("rest") >= size, F.lit(True)).alias("whole"))


def captures(records: DataFrame) -> DataFrame:
    """Responses and not-modified revisits as `revisits.resolve` takes them, with the payload; other records are left out.

    Status and headers are those of the HTTP head in the block. The digest is that of the record, else the SHA-1 of the payload, in hexadecimal."""
    own = lambda name: F.try_element_at("headers", F.lit(name))
    revisit = (own("warc-type") == "revisit") & F.coalesce(own("warc-profile").contains(NOT_MODIFIED), F.lit(False))
    rows = records.withColumn("kind", F.when(own("warc-type") == "response", "response").when(revisit, "revisit")).filter("kind is not null")
    head = F.substring_index(F.col("block").cast("string"), _END, 1)
    rows = rows.withColumns({"head": head, "payload": _after(F.col("block"), head)})
    return rows.select(
        own("warc-record-id").alias("record_id"),
        F.regexp_replace(own("warc-target-uri"), "^<(.*)>$", "$1").alias("url"),
        F.try_to_timestamp(own("warc-date")).alias("captured_at"),
        "kind",
        F.regexp_extract("head", r"^HTTP/\S+\s+(\d{3})", 1).try_cast("int").alias("status"),
        _headers(F.col("head")).alias("headers"),
        F.coalesce(own("warc-payload-digest"), F.concat(F.lit("sha1:"), F.sha1("payload"))).alias("digest"),
        F.octet_length("payload").cast("long").alias("length"),
        own("warc-refers-to").alias("named"),
        "payload",
    )
