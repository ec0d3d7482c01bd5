"""Target-distribution importance resampling: documents whose words look like a target's are likelier to be drawn.

A text's features are its runs of 1 to `n` consecutive words, hashed into buckets. The gain of a bucket is the logarithm of
how much more of the target than of the corpus falls into it, both smoothed by one feature a bucket; a document's
weight is the mean gain of its features. Adding Gumbel noise that depends on the id alone and taking the highest
sums draws without replacement, in proportion to the exponential of the weight.

Long texts are cut so that no task gets more than others: a text of over `CHUNK` bytes becomes chunks, cut between words. A chunk
owns the features that begin in it and carries the next n - 1 words, so that each feature is counted exactly once; counts
and gains of the chunks are summed by document. Chunks are dealt anew over the tasks, short texts stay where they were read.

Only numbers leave the workers: at most `buckets` sums a task, and a row a document. The ranks need no global sort: scores are
whole numbers in a range of some 90,000 at most (26,007 values of the noise, and a gain within 32,000 of zero for fewer than 10^18 features),
so a histogram of them, which the driver gets, tells for each how many documents stand above, and rows are numbered within equal scores alone.

Defined cases: a null or empty text, or one without words, has no features and the weight 0. A null id is drawn by the noise of an
empty id and comes after all others among equal scores. Repeated rows are documents of their own, with ranks of their own. An empty
target has gains by the corpus alone. Extra columns are ignored (`ranked`) or kept (`drawn`), whatever their names.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from foliant.llm.batches import bytes_of, id_and_text, python_stage, slices
from foliant.llm.storage import materialise

BUCKETS, CHUNK = 10_000, 64 << 10
#: What makes a byte part of a word: digits, letters, and all beyond ASCII. Capitals become small letters, the rest parts words.
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]|\Z")
_FOLD = bytes(ord(chr(b).lower()) if _WORD.match(bytes([b])) and b < 128 else b if b >= 128 else 32 for b in range(256))
_PIECES = "row long, doc_id long, own binary, carry binary"


def words(raw: bytes) -> list[bytes]:
    return raw.translate(_FOLD).split()


def split(raw: bytes, n: int, size: int = CHUNK) -> Iterator[tuple[bytes, bytes]]:
    """Chunks of about `size` bytes, cut between words, each with what follows up to its next n - 1 words."""
    at = 0
    while at < len(raw):
        end = _GAP.search(raw, min(at + size, len(raw))).start()
        last = end
        for found, _ in zip(_WORD.finditer(raw, end), range(n - 1)):
            last = found.end()
        yield raw[at:end], raw[end:last]
        at = end


def features(own: bytes, carry: bytes, n: int, buckets: int) -> tuple[int, np.ndarray]:
    """The number of words, and the bucket of each feature that begins in `own`."""
    mine = words(own)
    line = mine + words(carry)[: n - 1]
    runs = [mine] + [[b" ".join(line[i : i + k]) for i in range(min(len(mine), len(line) - k + 1))] for k in range(2, n + 1)]
    found = [np.fromiter(map(zlib.crc32, run), np.int64, len(run)) for run in runs]
    return len(mine), np.concatenate(found) % buckets


def pieces(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """Texts of at most `size` bytes as they are, and the chunks of the longer ones, which share the number of their row."""
    rows = id_and_text(docs, id_col, text_col).withColumn("long", F.coalesce(F.octet_length("text") > size, F.lit(False)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, row, doc_id, text in zip(range(batch.num_rows), batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), bytes_of(batch), strict=True):
                for part, (own, carry) in enumerate(split(text, n, size)):
                    yield pa.RecordBatch.from_pylist([{"row": row, "doc_id": doc_id, "own": own, "carry": carry, "part": part}], schema=_schema)

    _schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("own", pa.binary()), ("carry", pa.binary()), ("part", pa.int32())])
    long = python_stage(rows.filter("long").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), cut, f"{_PIECES}, part int")
    chunks = materialise(long.repartition("row", "part").drop("part"), "chunks")
    short = rows.filter("not long").select(F.lit(None).cast("long").alias("row"), "doc_id", F.col("text").cast("binary").alias("own"), F.lit(b"").alias("carry"))
    return short, chunks


def bucket_sums(parts: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How many features of all the texts are in each bucket. A task gives one row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for piece in slices(batch, "own"):
                for own, carry in zip(bytes_of(piece, "own"), bytes_of(piece, "carry"), strict=True):
                    total += np.bincount(features(own, carry, n, buckets)[1], minlength=buckets) if own else 0
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["bucket", "features"])

    out = np.zeros(buckets, np.int64)
    for row in python_stage(parts, count, "bucket long, features long").groupBy("bucket").agg(F.sum("features").alias("features")).collect():
        out[row["bucket"]] = row["features"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))), in doubles."""
    b, big_s, big_t = float(len(corpus)), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (big_s + b) / ((s + 1.0) * (big_t + b)))) for s, t in zip(map(float, corpus), map(float, target), strict=True)], np.int64)


def _sums(parts: DataFrame, gain: np.ndarray, n: int) -> DataFrame:
    """For each piece its words, features and the sum of their gains."""
    table, buckets = gain.tobytes(), len(gain)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = np.frombuffer(table, np.int64)
        for batch in batches:
            for piece in slices(batch, "own"):
                out = []
                for own, carry in zip(bytes_of(piece, "own"), bytes_of(piece, "carry"), strict=True):
                    n_words, found = features(own, carry, n, buckets)
                    out.append((n_words, len(found), int(gain[found].sum())))
                columns = np.array(out, np.int64).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([piece.column("row"), piece.column("doc_id"), *map(pa.array, columns)], ["row", "doc_id", "n_words", "n_features", "gain"])

    return python_stage(parts, add, "row long, doc_id long, n_words long, n_features long, gain long")


def weighted(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", size: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document, weighed against all texts of the target."""
    short, chunks = pieces(docs, n, id_col, text_col, size)
    goal = pieces(target.select(F.lit(0).alias("doc_id"), F.col(target_col).alias("text")), n, size=size)
    gain = gains(bucket_sums(short.unionByName(chunks), n, buckets), bucket_sums(goal[0].unionByName(goal[1]), n, buckets))
    whole = _sums(chunks, gain, n).groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")])
    weight = F.coalesce(F.floor(F.try_divide(F.col("gain") - F.pmod("gain", F.greatest("n_features", F.lit(1))), F.col("n_features"))), F.lit(0))
    return _sums(short, gain, n).unionByName(whole).select("doc_id", "n_words", "n_features", weight.cast("long").alias("weight"))


def ranked(docs: DataFrame, target: DataFrame, percent: int = 10, n: int = 1, buckets: int = BUCKETS, seed: int = 2024, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", size: int = CHUNK) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every document. Of those with at least `min_words` words, the given
    percentage (rounded down) with the highest scores is drawn and ranked from 1; ties go to the smaller id. Others have no rank."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = materialise(weighted(docs, target, n, buckets, id_col, text_col, target_col, size).withColumn("score", F.col("weight") + noise), "scores")
    able = F.col("n_words") >= min_words
    counts = {r["score"]: r["n"] for r in rows.filter(able).groupBy("score").agg(F.count("*").alias("n")).collect()}
    draws = percent * sum(counts.values()) // 100
    above, seen = [], 0
    for score in sorted(counts, reverse=True):
        if seen >= draws:
            break
        above.append((score, seen))
        seen += counts[score]
    least = above[-1][0] if above else None
    inside = F.coalesce(able & (F.col("score") >= F.lit(least)), F.lit(False)) if above else F.lit(False)
    place = F.col("above") + F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features"))
    best = rows.filter(inside).join(F.broadcast(docs.sparkSession.createDataFrame(above, "score long, above long")), "score").withColumn("rank", place)
    best = best.select(*rows.columns, F.when(F.col("rank") <= draws, F.col("rank")).cast("long").alias("rank"))
    return best.unionByName(rows.filter(~inside).withColumn("rank", F.lit(None).cast("long")))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows, all columns, of the ids that are drawn. `settings` as for `ranked`."""
    ids = ranked(docs, target, id_col=id_col, text_col=text_col, **settings).filter("rank is not null").select(F.col("doc_id").alias("i")).distinct()
    packed = docs.select(F.struct("*").alias("own"), F.col(id_col).cast("long").alias("id"))
    return packed.join(ids, F.col("id").eqNullSafe(F.col("i")), "left_semi").select("own.*")
