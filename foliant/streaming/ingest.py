"""Ingest of documents, from parser to store, and continuous ingest, an extension: a stream of units replaces the chunks of the documents it names.

Each micro-batch goes through the same operators as a batch run and through ChunkStore.replace,
which is idempotent, so a batch that is run again leaves the same rows. What is costly is made once and written: pages when their object is
parsed, chunks before they are embedded, stored and counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant import providers
from foliant.config import DEFAULT, Settings
from foliant.operators import chunking, layout, store
from foliant.shared import unused_path
from foliant.shipping import ship

UNIT_SCHEMA = "doc_id long, lang string, unit_no int, page int, text string"


def _written(df: DataFrame, name: str) -> DataFrame:
    path = unused_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _stored(units: DataFrame, documents: DataFrame, scopes: DataFrame, target: store.ChunkStore, factory: Callable[[], providers.Embedder], settings: Settings) -> DataFrame:
    """Chunks, embeds and stores `documents` (document_id), and returns their chunks."""
    ship(units.sparkSession)
    made = _written(chunking.chunks(units, settings=settings).withColumnRenamed("doc_id", "document_id"), "chunks")
    vectors = providers.embedded(made.select("document_id", "chunk_index", "content"), factory=factory, settings=settings)
    target.replace(documents, _written(store.assemble(made.drop("language"), vectors.drop("content"), scopes), "assembled"))
    return made


def ingest(units: DataFrame, scopes: DataFrame, target: store.ChunkStore, factory: Callable[[], providers.Embedder] = providers.StubEmbedder, settings: Settings = DEFAULT) -> None:
    """Chunks, embeds and stores the documents in `units`; one whose units hold no text loses its chunks."""
    _stored(units, units.select(F.col("doc_id").alias("document_id")).distinct(), scopes, target, factory, settings)


def _named(objects: DataFrame) -> DataFrame:
    return objects.select("doc_id", "content", F.sha2("content", 256).alias("hash"))


#: Bytes of a row group of parsed pages: Spark's reader holds 4,096 rows of a group at once, whose glyphs take several times what they take in the file.
GROUP_BYTES = 8 << 20


def parsed_once(objects: DataFrame, parser: Callable[[], providers.PageParser], pages: str) -> DataFrame:
    """(hash, page, boxes, glyphs) of the contents of objects (doc_id, path, content) at least, from a folder of parsed pages that belongs to one parser.

    Objects are known by the hash of their content: what the folder does not hold is parsed and added, once for each content; the rest is only read.
    The folder holds `pages` and `parsed`, the hashes whose pages are all there; pages of a run that failed between the two are
    parsed again, and stand there twice."""
    spark = objects.sparkSession
    named = _named(objects)
    layout_of = providers.parsed_layout(spark.createDataFrame([], "path string, content binary"), parser).withColumnRenamed("path", "hash")
    for name, schema in (("pages", layout_of.schema), ("parsed", "hash string")):  # folders to read from
        spark.createDataFrame([], schema).write.mode("append").parquet(f"{pages}/{name}")
    known = spark.read.schema("hash string").parquet(f"{pages}/parsed").distinct()
    none_known = known.isEmpty()
    fresh = _written(named.join(known, "hash", "left_anti").dropDuplicates(["hash"]).select("hash", "content"), "fresh")
    made = providers.parsed_layout(fresh.withColumnRenamed("hash", "path"), parser).withColumnRenamed("path", "hash")
    made.write.option("parquet.block.size", GROUP_BYTES).mode("append").parquet(f"{pages}/pages")
    fresh.select("hash").write.mode("append").parquet(f"{pages}/parsed")
    held = spark.read.schema(layout_of.schema).parquet(f"{pages}/pages")
    # Pages of a new folder are all asked for; their glyphs need not meet the names.
    return held if none_known else held.join(named.select("hash").distinct(), "hash", "left_semi")


def pages_of(objects: DataFrame, parser: Callable[[], providers.PageParser], settings: Settings = DEFAULT, pages: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Blocks, as the layout operators take them, and page counts (doc_id, page_count) of objects (doc_id, path, content). `pages`: a folder of parsed pages to keep.

    Blocks are made once for each content, where their page is read, and written; only their texts move."""
    held = parsed_once(objects, parser, pages or unused_path(objects.sparkSession, "pages"))
    named = _named(objects).select("doc_id", "hash").distinct()
    own = held.withColumnRenamed("hash", "doc_id")
    lines = layout.despaced(layout.page_lines(own), settings).dropDuplicates(layout.LINE)  # pages that stand there twice
    boxes = own.select("doc_id", "page", "boxes").dropDuplicates(["doc_id", "page"]).select("doc_id", "page", F.explode("boxes").alias("b")).select("doc_id", "page", "b.*")
    blocks = layout.boxed(layout.joined(lines), boxes)
    columns = blocks.columns
    blocks = named.join(blocks.withColumnRenamed("doc_id", "hash"), "hash").select(*columns)
    counts = named.join(held.select("hash", "page").distinct(), "hash").groupBy("doc_id").agg(F.countDistinct("page").cast("int").alias("page_count"))
    return _written(blocks, "blocks"), counts


def ingest_documents(objects: DataFrame, scopes: DataFrame, target: store.ChunkStore, parser: Callable[[], providers.PageParser], factory: Callable[[], providers.Embedder] = providers.StubEmbedder, settings: Settings = DEFAULT, pages: str | None = None) -> DataFrame:
    """Parses, lays out, chunks, embeds and stores objects (doc_id, path, content), replacing what the store holds of them.

    Returns for each document the chunks written, in all and by language, and the statistics of its extraction. A document
    without text loses its chunks. With a folder for `pages` an object whose content was parsed before is not parsed again."""
    blocks, counts = pages_of(objects, parser, settings, pages)
    units, stats = layout.language_streams(blocks, counts, settings)
    made = _stored(units, objects.select(F.col("doc_id").cast("long").alias("document_id")).distinct(), scopes, target, factory, settings)
    written = made.groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("chunks_written"), *[F.count_if(F.col("language") == x).alias(f"chunks_{x}") for x in ("es", "eu")])
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks_written", "chunks_es", "chunks_eu")]
    return objects.select("doc_id").distinct().join(written, "doc_id", "left").join(stats, "doc_id", "left").select("doc_id", *zero, *[c for c in stats.columns if c != "doc_id"])


def stream(spark: SparkSession, source: str, scopes: DataFrame, target: store.ChunkStore, checkpoint: str, factory: Callable[[], providers.Embedder] = providers.StubEmbedder) -> StreamingQuery:
    """Takes new Parquet files of units (whole documents) under `source` as they come."""
    units = spark.readStream.schema(UNIT_SCHEMA).parquet(source)
    return units.writeStream.foreachBatch(lambda batch, _: ingest(batch, scopes, target, factory)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
