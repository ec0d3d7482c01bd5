"""The jobs as queries over the driver's tables, and the same in DuckDB SQL. Each runs twice into one new folder of the shared directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.plans.reference import PACK, report_sql
from foliant.shared import unused_path
from jobs import chunk_stream, corpus_report


def job1_corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = unused_path(spark, "corpus-report")
    corpus_report.run(spark, f"{sf_dir}/documents.parquet", out)
    return corpus_report.run(spark, f"{sf_dir}/documents.parquet", out)


def job2_chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = unused_path(spark, "chunk-stream")
    documents = f"{sf_dir}/documents.parquet*"  # a pattern: the table may be a single file, which a file stream takes by pattern only
    chunk_stream.run(spark, documents, out, f"{out}/checkpoint")
    return chunk_stream.run(spark, documents, out, f"{out}/checkpoint").drop("batch")


QUERIES = {f.__name__: f for f in (job1_corpus_report, job2_chunk_stream)}
ORACLE = {
    "job1_corpus_report": f"WITH RECURSIVE {PACK}, x AS (SELECT p.lang, d.source, p.doc_id, CAST(token_count AS BIGINT) AS t FROM packed p JOIN documents d USING (doc_id)) "
    + report_sql("x", {"all": "", "lang": "lang", "source": "source", "lang+source": "lang+source", "lang+source+doc_id": "lang+source+doc_id"}),
    "job2_chunk_stream": f"WITH RECURSIVE {PACK} SELECT p.doc_id, d.source, chunk_index, page_from, page_to, content, token_count, p.lang FROM packed p JOIN documents d USING (doc_id)",
}
