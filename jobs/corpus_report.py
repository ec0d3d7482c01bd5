"""Batch job: how a corpus chunks. Documents are cut into chunks as for the retrieval store, the chunks are written by language, and a report
tells the number of chunks, their tokens and the distribution of these over the whole corpus, by language, by source, by both, and
by document. Users read it before they settle or change the size of chunks (`chunk_token_target`, `chunk_token_cap`), and after, to see what moved.

    python -m jobs.corpus_report --documents DIR --out DIR [--config jobs/corpus_report.json] [--label 2024-06] [--against 2024-05]

Output, Parquet: `out/chunks/run=<label>/lang=<lang>/` (doc_id, source, chunk_index, page_from, page_to, content, token_count) and
`out/report/run=<label>/level=<level>/`. With `against`, the label of an earlier run, `out/moved/run=<label>/kind=<kind>/` names the documents
that are new, gone, or have other chunks or tokens than then, with both numbers: the guard against a change that cuts more than was meant. A run owns the folders of its label and writes them as a whole, so that running it again with the
same label leaves the same files' rows, and other labels stay for comparison.

Documents need doc_id, text, lang and source. A null or blank text has no chunks; rows without doc_id are one document for each language and source, and so are repeated ids:
their lines are chunked together, by number. A null source is a value of its own; a null or empty
language is null in the output (Spark's default partition).
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession, functions as F

from foliant.config import Settings
from foliant.functions.tokens import Subwords, Words
from foliant.operators import analytics, chunking
from jobs.common import LOG, main

#: page_lines: lines that make a page; tokenizer: a tokenizer's file that counts tokens, empty for words.
DEFAULTS = {"label": "current", "against": "", "page_lines": 6, "chunk_token_target": 512, "chunk_token_cap": 800, "tokenizer": ""}
MOVED = "lang string, source string, doc_id long, chunks_was long, chunks_now long, tokens_was long, tokens_now long, max_was long, max_now long, kind string"
LEVELS = [[], ["lang"], ["source"], ["lang", "source"], ["lang", "source", "doc_id"]]


def run(spark: SparkSession, documents: str, out: str, label: str = "current", against: str = "", page_lines: int = 6, chunk_token_target: int = 512, chunk_token_cap: int = 800, tokenizer: str = "") -> DataFrame:
    """Writes chunks and report, and returns the report as it stands in the files."""
    settings = dataclasses.replace(Settings.of(spark), chunk_token_target=chunk_token_target, chunk_token_cap=chunk_token_cap)
    docs = spark.read.parquet(documents).select("doc_id", "text", "lang", "source")
    LOG.info("read %d documents from %s", docs.count(), documents)
    # Language and source travel together as the name of the stream.
    units = chunking.line_units(docs.withColumn("lang", F.to_json(F.struct("lang", "source"))), page_lines)
    made = chunking.chunks(units, Subwords(tokenizer) if tokenizer else Words(), settings).withColumn("of", F.from_json("language", "lang string, source string"))
    chunks = made.select("doc_id", "of.source", "chunk_index", "page_from", "page_to", "content", "token_count", "of.lang")
    at = f"{out.rstrip('/')}/chunks/run={label}"
    chunks.write.mode("overwrite").partitionBy("lang").parquet(at)
    written = spark.read.schema(chunks.schema).parquet(at)
    n, tokens = written.agg(F.count("*"), F.coalesce(F.sum("token_count"), F.lit(0))).first()
    LOG.info("wrote %d chunks of %d tokens to %s", n, tokens, at)
    report = analytics.report(written, LEVELS)
    to = f"{out.rstrip('/')}/report/run={label}"
    # Levels with few rows share a task; a document's row is dealt by its id.
    report.repartition("level", F.pmod(F.xxhash64("doc_id"), F.lit(32))).write.mode("overwrite").partitionBy("level").parquet(to)
    found = spark.read.schema(report.schema).parquet(to)
    LOG.info("wrote %d rows of the report to %s", found.count(), to)
    if against:
        before = spark.read.schema(report.schema).parquet(f"{out.rstrip('/')}/report/run={against}")
        path = f"{out.rstrip('/')}/moved/run={label}"
        moved(before, found).write.mode("overwrite").partitionBy("kind").parquet(path)
        LOG.info("wrote %d documents that moved since %s to %s", spark.read.schema(MOVED).parquet(path).count(), against, path)
    return found


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """The documents of two reports that are in one of them alone, or have other chunks, tokens or a longer chunk."""
    of = lambda report, name: report.filter("level = 'lang+source+doc_id'").select("lang", "source", "doc_id", F.struct("chunks", "tokens", "max").alias(name))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("lang", "source", "doc_id")]
    both = of(before, "was").alias("a").join(of(after, "now").alias("b"), same[0] & same[1] & same[2], "full")
    kind = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "gone").otherwise("changed")
    keys = [F.when(F.col("now").isNull(), F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in ("lang", "source", "doc_id")]
    numbers = [F.col(f"{side}.{c}").alias(f"{c}_{side}") for c in ("chunks", "tokens", "max") for side in ("was", "now")]
    return both.filter(~F.col("was").eqNullSafe(F.col("now"))).select(*keys, *numbers, kind.alias("kind"))


if __name__ == "__main__":
    main(run, DEFAULTS, ["documents", "out"], __doc__)
