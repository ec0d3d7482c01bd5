"""Scope-filtered exact retrieval: a filter that reaches the scan, the few that can be among the nearest, their ranks, their texts.

There is no approximate index: every eligible chunk is weighed, by `scoring` and only as far as it takes to know that it is out. Those left are ranked by
their exact distance, and only then is text read, for the hits alone. Ties in distance go by id, which names one chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from datetime import date

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from foliant.functions import vectors
from foliant.operators import scoring
from foliant.shared import unused_path

HIT = ["id", "document_id", "chunk_index", "page_from", "page_to", "content", "retrieval_status", "authority_level", "convenio_id"]
#: Requests that one pass may broadcast: with vectors of 1,024 floats about 40 MB. Of shorter vectors and few hits it may broadcast more: as many as take
#: BLOCK_BYTES, ask for BLOCK_HITS, and MOST_REQUESTS at most.
BLOCK_REQUESTS, BLOCK_BYTES, BLOCK_HITS, MOST_REQUESTS = 10_000, 40 << 20, 500_000, 100_000
#: Bytes of a block's vectors in double precision when all rows meet all, and rows for which a block of their own pays.
NEAR_BYTES, NEAR_ROWS = 8 << 20, 256


def eligible(convenio_id: int | None, include_national_law: bool, statuses: Sequence[str], as_of: date | None) -> Column:
    """The scope predicate. Parts that constants settle are left out, so what remains reaches the scan as simple comparisons."""
    scope = F.lit(False)
    if convenio_id is not None:
        scope = F.col("convenio_id") == convenio_id
    if include_national_law:
        law = F.col("authority_level") == "national_law"
        scope = law if convenio_id is None else scope | law
    out = scope & F.col("retrieval_status").isin(*statuses) if statuses else F.lit(False)
    if as_of is not None:
        day = F.lit(as_of)
        out = out & (F.col("validity_start").isNull() | (F.col("validity_start") <= day)) & (F.col("validity_end").isNull() | (F.col("validity_end") >= day))
    return out


#: What ranking needs of a hit; its text comes later.
NARROW = [c for c in HIT if c != "content"]


def with_text(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Ranked hits (of NARROW and more) with their content."""
    return hits.join(chunks.select(F.col("id").alias("of"), "content"), F.col("id") == F.col("of"), "left").drop("of")


def _nearest_few(found: DataFrame, k: Column) -> DataFrame:
    """Of the candidates of all tasks those within scoring.SLACK of the k-th best of their request."""
    order = Window.partitionBy("request").orderBy(F.desc_nulls_last("cosine"), "id")
    ranked = found.filter("id is not null").withColumn("n", F.row_number().over(order))
    bar = F.min(F.when(F.col("n") == k, F.col("cosine"))).over(Window.partitionBy("request"))
    return ranked.withColumn("bar", bar).filter((F.col("n") <= k) | F.col("bar").isNull() | (F.col("cosine") >= F.col("bar") - scoring.SLACK))


def _ranked(rows: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    near = rows.withColumn("distance", vectors.cosine_distance(F.col("embedding"), vectors.literal(query)))
    top = near.select(*NARROW, "distance").orderBy(F.asc_nulls_last("distance"), "id").limit(k)
    return with_text(top, rows).select(*HIT, vectors.rounded(1 - F.col("distance"), 6).alias("score"))


def retrieve(chunks: DataFrame, query: Sequence[float], convenio_id: int | None = None, include_national_law: bool = True, statuses: Sequence[str] = ("active",), as_of: date | None = None, k: int = 8) -> DataFrame:
    """The k nearest eligible chunks."""
    rows = chunks.filter(eligible(convenio_id, include_national_law, statuses, as_of))
    few = _nearest_few(scoring.candidates(rows, [list(query)], [k]), F.lit(k)).select(F.col("id").alias("of"))
    return _ranked(rows.join(few, F.col("id") == F.col("of"), "left_semi"), query, k)


def retrieve_in_document(chunks: DataFrame, query: Sequence[float], document_id: int, k: int = 8) -> DataFrame:
    """The k nearest chunks of one document, whatever their scope."""
    return _ranked(chunks.filter(F.col("document_id") == document_id), query, k)


def count_eligible(chunks: DataFrame, convenio_id: int | None = None, include_national_law: bool = True, statuses: Sequence[str] = ("active",), as_of: date | None = None) -> DataFrame:
    return chunks.filter(eligible(convenio_id, include_national_law, statuses, as_of)).agg(F.count("*").alias("eligible"))


def answerable(chunks: DataFrame, query: str, embed: Callable[[str], Sequence[float]], convenio_id: int | None = None, include_national_law: bool = True, statuses: Sequence[str] = ("active",), as_of: date | None = None, k: int = 8) -> DataFrame:
    """Text in, hits out: the k nearest eligible chunks, in order (`rank`, from 1), each with the number of all eligible ones.

    Ranking and counting share one scan: the count is a sum over the partitions, and a row of it alone stays if nothing is eligible."""
    scope = (convenio_id, include_national_law, statuses, as_of)
    hits = retrieve(chunks, embed(query), *scope, k=k)
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "id"))  # of at most k rows
    total = count_eligible(chunks, *scope).withColumnRenamed("eligible", "eligible_total")
    return total.join(hits.withColumn("rank", rank), F.lit(True), "left")


def retrieve_batch(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """The k nearest eligible chunks for each row of requests (req_id, query_vec, convenio_id, include_national_law, statuses, as_of_date, k).

    Requests go to the workers in blocks, each block against all chunks; each task gives only its own best, without text."""
    return with_text(ranked_batch(chunks, requests), chunks).select("req_id", "rank", *HIT, "score")


def ranked_batch(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """As `retrieve_batch`, without text."""
    out, blocks = None, _batches(requests)
    narrow = chunks.select("embedding", *NARROW, *[c for c in scoring.SCOPE if c not in NARROW])
    if len(blocks) > 1:  # what gives the chunks runs once, not for each block
        path = unused_path(chunks.sparkSession, "narrow")
        narrow.write.parquet(path)
        narrow = chunks.sparkSession.read.schema(narrow.schema).parquet(path)
    kind = requests.schema["req_id"].dataType.simpleString()
    for block in blocks:
        for names, candidates in _weighed(narrow, block, kind):
            few = _nearest_few(candidates.join(F.broadcast(names), "request"), F.col("k")).select("req_id", "k", F.col("id").alias("near_id"))
            pairs = few.join(F.broadcast(block.select("req_id", "query_vec")), "req_id").join(narrow.select("embedding", *NARROW), F.col("near_id") == F.col("id")).drop("near_id")
            pairs = pairs.withColumn("distance", vectors.cosine_distance(F.col("embedding"), F.col("query_vec"))).drop("embedding", "query_vec")
            rank = F.row_number().over(Window.partitionBy("req_id").orderBy(F.asc_nulls_last("distance"), "id"))
            hits = pairs.withColumn("rank", rank).filter(F.col("rank") <= F.col("k"))
            out = hits if out is None else out.unionByName(hits)
    return out.select("req_id", "rank", *NARROW, vectors.rounded(1 - F.col("distance"), 6).alias("score"))


def _batches(requests: DataFrame) -> list[DataFrame]:
    """The requests in blocks that a pass may broadcast."""
    n, width, k = requests.agg(F.count("*"), F.coalesce(F.max(F.size("query_vec")), F.lit(0)), F.coalesce(F.max("k"), F.lit(0))).first()
    most = max(BLOCK_REQUESTS, min(BLOCK_BYTES // (4 * max(1, width)), BLOCK_HITS // max(1, k), MOST_REQUESTS))
    return _dealt(requests, "req_id", max(1, -(-n // most)))


def _weighed(chunks: DataFrame, block: DataFrame, kind: str) -> list[tuple[DataFrame, DataFrame]]:
    """The requests of a block (request, req_id, k), by the length of their vectors, with their candidates."""
    spark, scope = chunks.sparkSession, ["convenio_id", "include_national_law", "statuses", "as_of_date"]
    rows = block.select("req_id", "query_vec", F.coalesce("k", F.lit(0)).cast("long").alias("k"), *scope).toArrow().combine_chunks()
    sizes, out = pc.fill_null(pc.list_value_length(rows["query_vec"]), 0), []
    for width in pc.unique(sizes).to_pylist() or [0]:
        own = rows.filter(pc.equal(sizes, width))
        ids, ks = own["req_id"].to_pylist(), own["k"].to_pylist()
        vectors_of = pa.concat_arrays(own["query_vec"].chunks) if own.num_rows else pa.array([], pa.list_(pa.float32()))
        found = scoring.candidates(chunks, vectors_of, ks, own.select(scope).to_pylist())
        out.append((spark.createDataFrame(list(zip(range(len(ids)), ids, ks, strict=True)), f"request int, req_id {kind}, k long"), found))
    return out


def weighing(chunks: DataFrame, requests: DataFrame) -> DataFrame:
    """How many vectors counted for any request of its block, and how many products were computed to the end: what `retrieve_batch` costs."""
    kind = requests.schema["req_id"].dataType.simpleString()
    work = [scoring.work(found) for block in _batches(requests) for _, found in _weighed(chunks, block, kind)]
    out = work[0]
    for more in work[1:]:
        out = out.unionByName(more)
    return out.agg(F.sum("seen").alias("seen"), F.sum("scored").alias("scored"))


def fan_out(hits: DataFrame) -> DataFrame:
    """Hits of several sub-queries as one list: each chunk once, with its best score."""
    best = Window.partitionBy("id").orderBy(F.desc("score"), "req_id")
    return hits.withColumn("n", F.row_number().over(best)).filter("n = 1").drop("n", "rank")


def _dealt(requests: DataFrame, key: str, parts: int) -> list[DataFrame]:
    return [requests] if parts == 1 else [requests.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == p) for p in range(parts)]


def _packed(rows: DataFrame) -> DataFrame:
    """The rows in blocks for `scoring.nearest`: at most BLOCK_REQUESTS rows and NEAR_BYTES in each, and so many that their pairs keep all cores busy."""
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    most = max(1, min(BLOCK_REQUESTS, NEAR_BYTES // (8 * max(1, width))))
    busy = min(-(-n // NEAR_ROWS), math.isqrt(4 * rows.sparkSession.sparkContext.defaultParallelism))
    # In files they are packed once, not for each pair, and Spark deals them evenly.
    path = unused_path(rows.sparkSession, "blocks")
    scoring.packed(rows, most, max(1, -(-n // most), busy)).write.parquet(path)
    return rows.sparkSession.read.schema("block binary").parquet(path)


def nearest(left: DataFrame, right: DataFrame, same_row: bool = False, other: str | None = None) -> DataFrame:
    """For each row of left (id, embedding) the row of right with the largest dot product, the smallest id among equals.

    Every row of left meets every row of right, as matrix products of blocks (`scoring.nearest`): both sides are packed into blocks of bounded size, which
    the tasks fetch in pairs, so that nothing passes through the driver; a pair of blocks gives one row for each row of left. Unless same_row, rows of the
    same id do not match; `other` names a column of both in which they must differ."""
    columns = ["id", "embedding", *([F.col(other).alias("other")] if other else [])]
    asked = _packed(left.select(*columns))
    found = scoring.nearest(asked, asked if left is right else _packed(right.select(*columns)), same_row)
    order = F.struct("similarity", F.col("near_id").isNotNull(), F.bitwise_not("near_id"))
    return found.groupBy("id").agg(F.max_by(F.struct("near_id", "similarity"), order).alias("m")).select("id", "m.near_id", "m.similarity")


def self_retrieval(queries: DataFrame, corpus: DataFrame, gate: float = 0.85) -> DataFrame:
    """How many queries (id, embedding) have the corpus row of their own id as nearest, and whether that passes the gate."""
    hit = F.coalesce(F.col("id") == F.col("near_id"), F.lit(False)).cast("long")
    return nearest(queries, corpus, same_row=True).agg(F.sum(hit).alias("hits"), F.count("*").alias("n"), (F.sum(hit) / F.count("*")).alias("accuracy")).withColumn("passed", F.col("accuracy") >= gate)
