"""Token ids in ORC files.

Ids are written as ORC list columns: integers are run-length encoded, stripes hold row
indexes, and Bloom filters stand on the document id, so that a reader can take stripes in
parallel and skip those (and row groups in them) that cannot hold an id it looks for.

Documents are dealt by ranges of their id and sorted in each range, so that files, taken by
number, are in ascending order (a null id comes first; equal ids by the hash of their
text). Beside the ids each row holds the number of its file and its offset there; the sum of
the files before, which a reader takes from two narrow columns, gives the start over all.

Defined cases: a null or empty text has no ids but the end id. Repeated rows are each
written. Extra columns are not.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from foliant.llm.batches import bytes_of, id_and_text, python_stage, slices
from foliant.llm.counts import model

FILE_SCHEMA = "doc_id long, part int, offset long, n_tokens long, ids array<int>"
ORC_OPTIONS = {
    "orc.stripe.size": str(64 << 20),
    "orc.row.index.stride": "1000",
    "orc.create.index": "true",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "compression": "lz4",
}


def write_ids(docs: DataFrame, path: str, file: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes all texts, appends `end_id` to each, and writes them under `path` in ascending order of id."""
    ordered = id_and_text(docs, id_col, text_col).withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, at = model(file), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text"):
                flat, sizes = bpe.encode_texts(bytes_of(piece))
                flat = np.insert(flat, np.cumsum(sizes), end_id)
                bounds = np.append(0, np.cumsum(sizes + 1))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int32()))
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(np.full(len(sizes), part), pa.int32()), pa.array(at + bounds[:-1], pa.int64()), pa.array(sizes + 1, pa.int64()), lists], ["doc_id", "part", "offset", "n_tokens", "ids"])
                at += int(bounds[-1])

    python_stage(ordered.drop("tie"), run, FILE_SCHEMA, "counts").write.options(**ORC_OPTIONS).orc(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files; a filter on doc_id skips stripes and row groups by their indexes and Bloom filters."""
    return spark.read.schema(FILE_SCHEMA).orc(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """By file number, the ids in all files before. One row for each file is gathered."""
    sums = read_ids(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy()
            flat = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), "<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            n = pa.array(np.diff(bounds), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("offset"), n, pa.array(crc, pa.int64())], ["doc_id", "part", "offset", "n_tokens", "ids_crc32"])

    rows = python_stage(read_ids(spark, path), run, "doc_id long, part int, offset long, n_tokens long, ids_crc32 long", "counts")
    return rows.join(starts(spark, path), "part").select("doc_id", (F.col("base") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
