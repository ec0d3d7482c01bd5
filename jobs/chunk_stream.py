"""Incremental job: keeps a folder of chunks in step with a growing folder of documents. Users run it whenever documents came in, before the
chunks are embedded and stored for retrieval; a document that comes again replaces its chunks, one that comes without text loses them.

    python -m jobs.chunk_stream --documents DIR --out DIR --checkpoint DIR [--config jobs/chunk_stream.json]

A file stream takes the Parquet files under `documents` (a folder, or a pattern of files or folders) that its checkpoint does not know yet (trigger availableNow), in batches. Each batch is
chunked with the library's operators and writes, by Spark's dynamic partition overwrite, the partitions of its own number and no others:
`out/chunks/batch=<n>/lang=<lang>/` and then `out/seen/batch=<n>/`, one row a document of the batch. A batch that fails is taken again
under its number and writes the same rows over what it left. `current` reads what holds now: for each document the chunks of the last batch
that has seen it. A chunk counts only once its batch is in `seen`, so readers never meet half a batch.

The checkpoint belongs to the output: keep both, or start both anew. Within a batch the version of the latest file wins, among versions of one
time the one with the largest hash. Documents need doc_id, text, lang and source; rows without doc_id cannot be replaced later
and are counted and left out. A blank or null text has no chunks.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.config import Settings
from foliant.functions.tokens import Subwords, Words
from foliant.operators import chunking
from foliant.shipping import ship
from jobs.common import LOG, main

DEFAULTS = {"page_lines": 6, "chunk_token_target": 512, "chunk_token_cap": 800, "tokenizer": "", "files_per_batch": 1000}
DOCUMENT = "doc_id long, text string, lang string, source string"
CHUNK = "doc_id long, source string, chunk_index int, page_from int, page_to int, content string, token_count int, batch long, lang string"
SEEN = "doc_id long, batch long"


def newest(rows: DataFrame) -> DataFrame:
    """One version of each document of a batch (doc_id, text, lang, source, changed)."""
    version = F.struct("text", "lang", "source")
    return rows.groupBy("doc_id").agg(F.max_by(version, F.struct("changed", F.xxhash64("text", "lang", "source"))).alias("v")).select("doc_id", "v.*")


def take(batch: DataFrame, number: int, out: str, page_lines: int, counter, settings: Settings) -> int:
    """Writes one batch, and returns how many rows it had."""
    named = batch.filter("doc_id is not null")
    # Language and source travel together as the name of the stream.
    units = chunking.line_units(newest(named).withColumn("lang", F.to_json(F.struct("lang", "source"))), page_lines)
    made = chunking.chunks(units, counter, settings).withColumn("of", F.from_json("language", "lang string, source string"))
    chunks = made.select("doc_id", "of.source", "chunk_index", "page_from", "page_to", "content", "token_count", F.lit(number).cast("long").alias("batch"), "of.lang")
    written = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    written(chunks).partitionBy("batch", "lang").parquet(f"{out}/chunks")
    written(named.select("doc_id").distinct().withColumn("batch", F.lit(number).cast("long"))).partitionBy("batch").parquet(f"{out}/seen")
    own = lambda name, schema: batch.sparkSession.read.schema(schema).parquet(f"{out}/{name}").filter(F.col("batch") == number).count()
    rows, nameless = batch.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
    LOG.info("batch %d: read %d rows (%d without id), wrote %d documents and %d chunks", number, rows, nameless, own("seen", SEEN), own("chunks", CHUNK))
    return rows


def current(spark: SparkSession, out: str) -> DataFrame:
    """The chunks that hold now."""
    last = spark.read.schema(SEEN).parquet(f"{out}/seen").groupBy("doc_id").agg(F.max("batch").alias("batch"))
    return spark.read.schema(CHUNK).parquet(f"{out}/chunks").join(last, ["doc_id", "batch"])


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, page_lines: int = 6, chunk_token_target: int = 512, chunk_token_cap: int = 800, tokenizer: str = "", files_per_batch: int = 1000) -> DataFrame:
    """Takes what is new, waits until that is done, and returns the chunks that hold then."""
    out = out.rstrip("/")
    settings = dataclasses.replace(Settings.of(spark), chunk_token_target=chunk_token_target, chunk_token_cap=chunk_token_cap)
    counter = Subwords(tokenizer) if tokenizer else Words()
    ship(spark)
    for name, schema, parts in (("chunks", CHUNK, ["batch", "lang"]), ("seen", SEEN, ["batch"])):  # folders to read from, if nothing has come yet
        spark.createDataFrame([], schema).write.mode("append").partitionBy(*parts).parquet(f"{out}/{name}")
    files = spark.readStream.schema(DOCUMENT).option("maxFilesPerTrigger", files_per_batch).parquet(documents)
    rows = files.select("*", F.col("_metadata.file_modification_time").alias("changed"))
    taken: list[int] = []
    query = rows.writeStream.foreachBatch(lambda batch, number: taken.append(take(batch, number, out, page_lines, counter, settings))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    LOG.info("read %d new rows in %d batches from %s", sum(taken), len(taken), documents)
    return current(spark, out)


if __name__ == "__main__":
    main(run, DEFAULTS, ["documents", "out", "checkpoint"], __doc__)
