"""The chunk table: replacing a document's chunks as one, positional insert, scope columns."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SCOPE = ["convenio_id", "territory_id", "sector_id", "validity_start", "validity_end", "retrieval_status", "authority_level"]
SCHEMA = (
    "document_id long, chunk_index int, page_from int, page_to int, content string, token_count int, embedding array<float>, "
    "convenio_id long, territory_id long, sector_id long, validity_start date, validity_end date, retrieval_status string, authority_level string"
)


def assemble(chunks: DataFrame, embeddings: DataFrame, scopes: DataFrame) -> DataFrame:
    """Chunks (document_id, chunk_index, ...) with the embedding at the same place and their document's scope.

    Every chunk must have one embedding and every embedding a chunk; otherwise the query fails when it runs."""
    e = embeddings.select("document_id", "chunk_index", "embedding", F.lit(True).alias("__e"))
    both = chunks.withColumn("__c", F.lit(True)).join(e, ["document_id", "chunk_index"], "full")
    paired = both.withColumn("__ok", F.assert_true(F.col("__e").isNotNull() & F.col("__c").isNotNull(), "chunks and embeddings differ in number"))
    # The check must not be pruned, so a column that is kept depends on it.
    paired = paired.withColumn("content", F.when(F.col("__ok").isNull(), F.col("content")))
    scoped = paired.join(scopes, "document_id", "left")
    return scoped.select("document_id", "chunk_index", "page_from", "page_to", "content", F.coalesce("token_count", F.lit(0)).alias("token_count"), "embedding", *SCOPE)


#: Folders of agreements in a layout by scope.
SLOTS = 64


def _places(slots: Column) -> dict[str, Column]:
    """Where a layout by scope puts a chunk: whether it is national law, and the slot of its agreement (-1 without one)."""
    return {"law": F.coalesce(F.col("authority_level") == "national_law", F.lit(False)), "slot": F.coalesce(F.pmod("convenio_id", slots), F.lit(-1)).cast("int")}


def write_by_scope(chunks: DataFrame, path: str, slots: int = SLOTS, file_rows: int = 1_000_000) -> None:
    """Writes the chunks laid out for retrieval by scope, beside a table that is laid out by document.

    Folders are national law or not and slots of agreements, so that a scope opens its own alone; files follow status and validity,
    whose minima and maxima let a reader pass over the rest. Rows are dealt by ranges, so a large agreement is written by many tasks."""
    order = ["law", "slot", "retrieval_status", "validity_start", "validity_end", "id"]
    rows = chunks.withColumn("slots", F.lit(slots)).withColumns(_places(F.lit(slots)))
    rows.repartitionByRange(*order).sortWithinPartitions(*order).write.option("maxRecordsPerFile", file_rows).partitionBy("slots", "law", "slot").parquet(path)


def read_by_scope(spark: SparkSession, path: str, convenio_id: int | None, include_national_law: bool = True) -> DataFrame:
    """The chunks of a layout by scope that an agreement or national law can be answered from; folders of others are not opened."""
    own = F.lit(False) if convenio_id is None else F.col("slot") == F.pmod(F.lit(convenio_id), F.col("slots"))
    return spark.read.parquet(path).filter(own | F.col("law") if include_national_law else own).drop("slots", "law", "slot")


def replaced(table: DataFrame, documents: DataFrame, new: DataFrame) -> DataFrame:
    """The table without any chunk of `documents` (document_id) and with the new rows. A document with no new rows just goes."""
    return table.join(documents.select("document_id").distinct(), "document_id", "left_anti").unionByName(new)


#: How often a replacement begins anew because another writer was first.
ATTEMPTS = 20


class ChunkStore:
    """A Parquet table in buckets of documents. A replacement rewrites the buckets it touches and no other.

    The folder holds `buckets/<bucket>/<version>` and `versions/<n>`, an immutable list of the version of each bucket. Writers add
    new bucket versions beside the old ones and then create the next list, which is one rename; readers take the last list.
    So a reader sees all of a replacement or nothing, and a writer that fails leaves only folders that no list names. Of two
    writers that meet, the second one finds the name of its list taken, and replaces again on top of the first.
    This needs a file system whose rename is one step and refuses a name that exists, as HDFS; on an object store let one writer work at a time.
    The number of buckets belongs to the table and is set with its first list: about one for each `bucket_rows` chunks then."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, bucket_rows: int = 500_000):
        self.spark, self.path, self._wanted, self._bucket_rows = spark, path.rstrip("/"), buckets, bucket_rows

    def _fs(self):
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return root.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def _listed(self) -> tuple[int, int | None, dict[int, str]]:
        """The number of the last list (0 for none), the number of buckets, and the version of each bucket that holds rows."""
        fs, path = self._fs()
        if not fs.exists(path(f"{self.path}/versions")):
            return 0, None, {}
        names = [f.getPath().getName() for f in fs.listStatus(path(f"{self.path}/versions"))]
        last = max((int(n) for n in names if n.isdigit()), default=0)
        if not last:
            return 0, None, {}
        stream = fs.open(path(f"{self.path}/versions/{last}"))
        try:
            found = json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()
        return last, found["buckets"], {int(b): v for b, v in found["versions"].items()}

    def _publish(self, number: int, buckets: int, versions: dict[int, str]) -> bool:
        """Creates the next list; False if another writer has made one of that number."""
        fs, path = self._fs()
        draft = path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps({"buckets": buckets, "versions": versions}).encode()))
        out.close()
        final = path(f"{self.path}/versions/{number}")
        done = not fs.exists(final) and fs.rename(draft, final)
        if not done:
            fs.delete(draft, False)
        return done

    @property
    def buckets(self) -> int | None:
        """How many buckets the table has; None before the first replacement."""
        return self._listed()[1]

    def _rows(self, versions: dict[int, str]) -> DataFrame:
        schema = f"{SCHEMA}, created_at timestamp, updated_at timestamp, bucket int"
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/buckets/{b}/{v}" for b, v in sorted(versions.items())])

    def read(self) -> DataFrame:
        return self._rows(self._listed()[2])

    def document(self, document_id: int) -> DataFrame:
        """One document's chunks; only its bucket is read."""
        _, buckets, versions = self._listed()
        own = document_id % buckets if buckets else 0
        return self._rows({b: v for b, v in versions.items() if b == own}).filter(F.col("document_id") == document_id)

    def replace(self, documents: DataFrame, new: DataFrame) -> None:
        """Deletes all chunks of `documents` and inserts `new`, all at once; doing it twice leaves the same rows."""
        for _ in range(ATTEMPTS):
            if self._replaced(documents, new):
                return
        raise RuntimeError(f"{ATTEMPTS} other writers came first at {self.path}")

    def _replaced(self, documents: DataFrame, new: DataFrame) -> bool:
        number, buckets, versions = self._listed()
        if buckets is None:
            if not self._wanted:
                # Written before it is counted, so that what makes the rows runs once.
                first = f"{self.path}/.first-{uuid.uuid4().hex}"
                new.write.parquet(first)
                new = self.spark.read.schema(new.schema).parquet(first)
            buckets = self._wanted or max(64, -(-new.count() // self._bucket_rows))
        bucket = F.pmod(F.col("document_id"), F.lit(buckets)).cast("int")
        touched = [r["bucket"] for r in documents.select(bucket.alias("bucket")).distinct().collect()]
        if not touched:
            return True
        old = self._rows({b: versions[b] for b in touched if b in versions})
        stamped = new.withColumns({"created_at": F.current_timestamp(), "updated_at": F.current_timestamp(), "bucket": bucket})
        rows = replaced(old, documents, stamped.select(*old.columns))
        version, (fs, path) = uuid.uuid4().hex, self._fs()
        stage = f"{self.path}/.stage-{version}"
        # Dealt by document, not by bucket: a large bucket is written by many tasks, each in files of its own.
        rows.repartition("document_id").sortWithinPartitions("bucket", "document_id", "chunk_index").withColumn("b", F.col("bucket")).write.partitionBy("b").parquet(stage)
        for b in touched:  # a bucket that is now empty has no staged folder, and only goes from the list
            versions.pop(b, None)
            if fs.exists(path(f"{stage}/b={b}")):
                fs.mkdirs(path(f"{self.path}/buckets/{b}"))
                fs.rename(path(f"{stage}/b={b}"), path(f"{self.path}/buckets/{b}/{version}"))
                versions[b] = version
        fs.delete(path(stage), True)
        fs.mkdirs(path(f"{self.path}/versions"))
        return self._publish(number + 1, buckets, versions)

    def vacuum(self, keep: int = 1) -> None:
        """Deletes all lists but the last `keep` and the bucket versions that none of those names. Not while a writer works."""
        last, *_ = self._listed()
        fs, path = self._fs()
        held: set[tuple[str, str]] = set()
        for f in fs.listStatus(path(f"{self.path}/versions")) if last else []:
            name = f.getPath().getName()
            if not name.isdigit() or int(name) <= last - keep:
                fs.delete(f.getPath(), False)
                continue
            stream = fs.open(f.getPath())
            held |= set(json.loads(bytes(stream.readAllBytes()).decode())["versions"].items())
            stream.close()
        for b in fs.listStatus(path(f"{self.path}/buckets")) if fs.exists(path(f"{self.path}/buckets")) else []:
            for v in fs.listStatus(b.getPath()):
                if (b.getPath().getName(), v.getPath().getName()) not in held:
                    fs.delete(v.getPath(), True)
