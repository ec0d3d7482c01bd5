"""The jobs, over copies of the given tables: reruns, growing input, failed batches."""

import json
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from foliant.functions.tokens import Subwords
from foliant.operators import chunking
from jobs import chunk_stream, common, corpus_report

ROOT = Path(__file__).resolve().parent.parent


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def chunked(docs, page_lines=6):
    """What the stream should hold for a table of documents."""
    made = chunking.chunks(chunking.line_units(docs, page_lines))
    return made.select("doc_id", "chunk_index", "page_from", "page_to", "content", "token_count", F.col("language").alias("lang"))


def held(df):
    return df.select("doc_id", "chunk_index", "page_from", "page_to", "content", "token_count", "lang")


def test_report_reruns_and_keeps_other_labels(spark, sf_dir, tmp_path):
    out = str(tmp_path / "out")
    found = corpus_report.run(spark, f"{sf_dir}/documents.parquet", out, label="a")
    first, total = rows(found), found.filter("level = 'all'").first()["chunks"]
    corpus_report.run(spark, f"{sf_dir}/documents.parquet", out, label="b", chunk_token_target=100)
    assert rows(corpus_report.run(spark, f"{sf_dir}/documents.parquet", out, label="a")) == first
    labels = {r["run"]: r["n"] for r in spark.read.parquet(f"{out}/chunks").groupBy("run").agg(F.count("*").alias("n")).collect()}
    assert labels["b"] > labels["a"] == total
    assert len(list((tmp_path / "out/report/run=a").glob("level=*"))) == 5


def test_report_tells_what_moved(spark, tmp_path):
    put = lambda name, rows: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / name)) or str(tmp_path / name)
    old = put("old", [(1, "a b c", "es", "s"), (2, "d e", "es", None), (3, "f", None, "s"), (4, "g g g", "es", "s")])
    new = put("new", [(1, "a b c", "es", "s"), (2, "d e f", "es", None), (4, "g g g", "eu", "s"), (5, "h", "es", "s")])
    out = str(tmp_path / "out")
    corpus_report.run(spark, old, out, label="old")
    for _ in range(2):
        corpus_report.run(spark, new, out, label="new", against="old")
        found = spark.read.schema(corpus_report.MOVED).parquet(f"{out}/moved/run=new")
        assert {(r["kind"], r["lang"], r["doc_id"], r["tokens_was"], r["tokens_now"]) for r in found.collect()} == {("changed", "es", 2, 2, 3), ("gone", None, 3, 1, None), ("gone", "es", 4, 3, None), ("new", "eu", 4, None, 3), ("new", "es", 5, None, 1)}
        assert found.count() == 5


def test_report_counts_with_a_tokenizer(spark, sf_dir, tmp_path):
    words = corpus_report.run(spark, f"{sf_dir}/documents.parquet", str(tmp_path / "w")).filter("level = 'all'").first()
    path = "/opt/tokenizers/byte_bpe_50k.json"
    pieces = corpus_report.run(spark, f"{sf_dir}/documents.parquet", str(tmp_path / "p"), tokenizer=path).filter("level = 'all'").first()
    assert pieces["chunks"] > words["chunks"] and pieces["tokens"] > 2 * words["tokens"] and pieces["median"] <= 512
    count = Subwords(path)
    made = spark.read.parquet(f"{tmp_path}/p/chunks/run=current").select("content", "token_count").limit(20).collect()
    assert all(count(r["content"]) == r["token_count"] for r in made)


def test_report_over_odd_rows(spark, tmp_path):
    docs = [(1, "one two\nthree", "es", None, 5), (2, None, "es", "s", 5), (3, "  ", "eu", "s", 5), (4, "four", None, "s", 5), (None, "no id", "es", "s", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, token_count int").write.parquet(str(tmp_path / "docs"))
    found = corpus_report.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"), page_lines=1)
    assert {(r["lang"], r["source"], r["doc_id"], r["tokens"]) for r in found.filter("level = 'lang+source+doc_id'").collect()} == {("es", None, 1, 3), (None, "s", 4, 1), ("es", "s", None, 2)}
    assert found.filter("level = 'all'").first()["tokens"] == 6
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "none"))
    assert corpus_report.run(spark, str(tmp_path / "none"), str(tmp_path / "empty")).filter("level <> 'all'").count() == 0


def test_stream_takes_only_what_is_new(spark, sf_dir, tmp_path, caplog):
    caplog.set_level("INFO", "foliant.jobs")
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    source, out, mark = (str(tmp_path / n) for n in ("docs", "out", "mark"))
    old = table.filter("doc_id < 120")
    old.coalesce(1).write.parquet(source)
    assert rows(held(chunk_stream.run(spark, source, out, mark))) == rows(chunked(old))
    # More documents, a changed one, one that lost its text; a row without id is left out.
    change = spark.createDataFrame([(5, "quite new\ntext", "es", "src1"), (7, None, "en", "src1"), (None, "nobody's", "en", "src1")], "doc_id long, text string, lang string, source string")
    more = table.filter("doc_id >= 120").unionByName(change)
    more.coalesce(1).write.mode("append").parquet(source)
    caplog.clear()
    now = table.filter("doc_id not in (5, 7)").unionByName(change.filter("doc_id = 5"))
    assert rows(held(chunk_stream.run(spark, source, out, mark))) == rows(chunked(now))
    assert any(f"read {more.count()} rows (1 without id)" in r.getMessage() for r in caplog.records)
    assert any(f"read {more.count()} new rows in 1 batches" in r.getMessage() for r in caplog.records)
    # Nothing new: the same rows, and nothing read.
    caplog.clear()
    assert rows(held(chunk_stream.run(spark, source, out, mark))) == rows(chunked(now))
    assert any("read 0 new rows in 0 batches" in r.getMessage() for r in caplog.records)


def test_batches_of_few_files_end_as_one_batch_does(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").limit(30).cache()
    source, out, mark = (str(tmp_path / n) for n in ("docs", "out", "mark"))
    docs.repartition(3).write.parquet(source)
    settings = {k: v for k, v in spark.sparkContext.getConf().getAll()} | {"rows": spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), "mode": spark.conf.get("spark.sql.sources.partitionOverwriteMode")}
    assert rows(held(chunk_stream.run(spark, source, out, mark, files_per_batch=1))) == rows(chunked(docs))
    assert len(list((tmp_path / "out/seen").glob("batch=*"))) == 3
    assert settings == {k: v for k, v in spark.sparkContext.getConf().getAll()} | {"rows": spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), "mode": spark.conf.get("spark.sql.sources.partitionOverwriteMode")}


def test_a_failed_batch_is_taken_again(spark, sf_dir, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").limit(40).cache()
    source, out, mark = (str(tmp_path / n) for n in ("docs", "out", "mark"))
    docs.coalesce(1).write.parquet(source)
    real = chunk_stream.take

    def fails(batch, number, *more):
        real(batch, number, *more)
        raise RuntimeError("lost after its writes")

    monkeypatch.setattr(chunk_stream, "take", fails)
    with pytest.raises(Exception, match="lost after its writes"):
        chunk_stream.run(spark, source, out, mark)
    monkeypatch.setattr(chunk_stream, "take", real)
    assert rows(held(chunk_stream.run(spark, source, out, mark))) == rows(chunked(docs))


def test_the_latest_version_in_a_batch_wins(spark):
    at = F.timestamp_seconds
    seen = spark.createDataFrame([(1, "old", "es", "s", 10), (1, "new", "es", "s", 20), (1, "older", "es", "s", 5), (2, None, None, None, 1)], "doc_id long, text string, lang string, source string, t int").withColumn("changed", at("t"))
    assert rows(chunk_stream.newest(seen)) == [(1, "new", "es", "s"), (2, None, None, None)]


def test_an_empty_folder_gives_no_chunks(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    assert chunk_stream.run(spark, str(tmp_path / "docs"), str(tmp_path / "out"), str(tmp_path / "mark")).count() == 0


def test_settings_come_from_file_and_command_line(tmp_path):
    file = tmp_path / "c.json"
    file.write_text(json.dumps({"page_lines": 3}))
    found = common.configured(chunk_stream.DEFAULTS, str(file), {"tokenizer": None, "chunk_token_cap": 9})
    assert (found["page_lines"], found["chunk_token_cap"], found["tokenizer"]) == (3, 9, "")
    file.write_text(json.dumps({"page_line": 3}))
    with pytest.raises(ValueError, match="page_line"):
        common.configured(chunk_stream.DEFAULTS, str(file), {})
    for job in (corpus_report, chunk_stream):
        assert json.loads((ROOT / f"{job.__name__.replace('.', '/')}.json").read_text()) == job.DEFAULTS


def test_command_line(sf_dir, tmp_path):
    code = [sys.executable, "-m", "jobs.chunk_stream", "--documents", f"{sf_dir}/documents.parquet*", "--out", str(tmp_path / "out"), "--checkpoint", str(tmp_path / "mark"), "--config", "jobs/chunk_stream.json", "--chunk-token-target", "50"]
    done = subprocess.run(code, cwd=ROOT, check=True, timeout=240, capture_output=True, text=True)
    assert "batch 0: read 200 rows" in done.stderr and (tmp_path / "out/chunks/batch=0").is_dir()
