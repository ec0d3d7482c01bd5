import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from foliant.llm import exactdedup
from tests.llm.conftest import same_rows, texts_by_id


def brute(rows):
    held = defaultdict(list)
    for i, text in rows:
        held[re.sub("[\x20\x09-\x0d]", "", text or "")].append((i, len(text or "")))
    out = []
    for norm, members in held.items():
        best = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        out += [(i, best[0], len(members), (i, n) == best, hashlib.sha256(norm.encode()).hexdigest()) for i, n in members]
    return out


@pytest.fixture(scope="module")
def texts(spark):
    r = random.Random(3)
    base = ["".join(r.choices("ab c\n\té中", k=r.randrange(0, 9))) for _ in range(60)]
    return [(r.randrange(10**6) - 5 * 10**5, r.choice(base) + r.choice(["", " ", "\x0b\x0c", "x"])) for _ in range(500)]


@pytest.mark.parametrize("bits,capacity", [(64, 50_000), (64, 3), (6, 2), (1, 1)])
def test_groups_against_brute_force(spark, texts, bits, capacity):
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    same_rows(exactdedup.groups(docs, capacity, bits).collect(), brute(texts))


def test_odd_rows(spark, odd_docs, no_docs):
    same_rows(exactdedup.groups(odd_docs).collect(), brute(texts_by_id(odd_docs)))
    assert exactdedup.groups(no_docs).collect() == []
    assert exactdedup.drop_copies(no_docs).columns == no_docs.columns


@pytest.mark.parametrize("bits", [64, 2])
def test_drop_copies_keeps_one_row_of_each_text(spark, odd_docs, bits):
    clashing = odd_docs.selectExpr("doc_id", "text", "lang as h", "source as norm", "n_chars as sha", "n_words as id", "ids as own", "part as __k")
    kept = exactdedup.drop_copies(clashing, bits=bits)
    assert kept.columns == clashing.columns
    norms = [re.sub("[\x20\x09-\x0d]", "", r["text"] or "") for r in kept.collect()]
    assert len(norms) == len(set(norms)) == len({re.sub("[\x20\x09-\x0d]", "", t) for _, t in texts_by_id(odd_docs)})


def test_directory_splits_until_buckets_fit(spark):
    keys = spark.range(4000).select(F.xxhash64("id").alias("h"))
    slots = exactdedup.directory(keys, capacity=100)
    in_buckets = exactdedup._in_buckets(keys, slots).groupBy("bucket").count().collect()
    assert max(r["count"] for r in in_buckets) <= 100 and sum(r["count"] for r in in_buckets) == 4000
    # A bucket and the one it was split from together do not fit.
    depth = {r["bucket"]: r["depth"] for r in slots.collect()}
    size = {r["bucket"]: r["count"] for r in in_buckets}
    for bucket, d in depth.items():
        top = 1 << (exactdedup.MAX_DEPTH - d + 1)
        assert sum(n for b, n in size.items() if b // top == bucket // top) > 100
    assert {r["depth"] for r in exactdedup.directory(keys, capacity=4000).collect()} == {0}
    # Keys that share all bits of the directory stay together, whole.
    one = spark.range(300).select((F.col("id") % 7).alias("h"))
    assert [(r["slot"], r["depth"]) for r in exactdedup.directory(one, capacity=2).collect()] == [(0, exactdedup.MAX_DEPTH)]


def test_index_files_are_in_ranges_of_keys(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = exactdedup._rows(docs, 64, "doc_id", "text").drop("norm")
    index = exactdedup.build(docs, rows, capacity=10)
    spans = index.entries.groupBy(F.input_file_name().alias("f")).agg(F.min("h").alias("a"), F.max("h").alias("b"), F.min("bucket").alias("p"), F.max("bucket").alias("q")).collect()
    spans = sorted((s["p"], s["q"]) for s in spans)
    assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert index.chains.count() == 0


def test_no_python_on_the_main_path(spark, sf_dir):
    plan = exactdedup.groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
