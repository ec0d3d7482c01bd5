"""Objects in a store, the registry of documents, page images, JSON responses."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A store that speaks S3 with path-style addresses; for spark.hadoop settings of a session.
S3_SETTINGS = {"fs.s3a.path.style.access": "true"}


def use_store(spark: SparkSession, endpoint: str | None = None, **settings: str) -> None:
    """Applies S3_SETTINGS, an endpoint and further settings (dots written as double underscores) to what the session reads from then on."""
    conf = spark._jsc.hadoopConfiguration()
    for name, value in {**S3_SETTINGS, **({"fs.s3a.endpoint": endpoint} if endpoint else {}), **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        conf.set(name, value)


def read_objects(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """Whole objects as path, modificationTime, length, content; content is read only if it is asked for."""
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path)


def write_objects(objects: DataFrame, root: str) -> int:
    """Writes rows (key, content) as objects under root, replacing those that exist, and returns how many.

    Each task writes its own rows through the file system that pyarrow knows for the address."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for key, content in zip(batch.column("key").to_pylist(), batch.column("content"), strict=True):
                path = f"{base}/{key}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    return objects.select("key", "content").mapInArrow(put, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def page_image_key(document: Column, page: Column) -> Column:
    return F.format_string("documents/%s/pages/%04d.jpg", document, page)


def find_document(registry: DataFrame, like: str) -> DataFrame:
    """The first document, by id, whose file name matches a pattern without regard to case."""
    return registry.filter(F.col("source_filename").ilike(like)).orderBy("id").limit(1)


def is_alive(spark: SparkSession) -> bool:
    return spark.sql("SELECT 1 AS ok").first()["ok"] == 1


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON text."""
    return rows.select(F.to_json(F.struct("*")).alias("json"))
