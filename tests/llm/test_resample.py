import hashlib
import math
import random
import re
import zlib

import pytest

from foliant.llm import resample
from tests.llm.conftest import same_rows, texts_by_id


def found(text, n):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, n, buckets=10_000, percent=10, seed=2024, min_words=20):
    s, t = [0] * buckets, [0] * buckets
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in found(text, n)[1]:
                side[f % buckets] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + buckets) / ((a + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    rows = []
    for i, text in docs:
        n_words, fs = found(text, n)
        weight = sum(gain[f % buckets] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n_words, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    draws = percent * len(able) // 100
    rank = {id(r): p for p, r in enumerate(able[:draws], 1)}
    return [(*r, rank.get(id(r))) for r in rows]


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(11)
    vocabulary = ["Maß", "alpha", "beta1", "x" * 40, "中文", "d", "2024", "é"]
    join = lambda k: "".join(w + r.choice([" ", "\n", "-", "'", ", ", "\x00"]) for w in r.choices(vocabulary, k=k))
    return [(i, join(r.choice([0, 1, 5, 19, 20, 25, 60, 800]))) for i in range(300)], [join(30) for _ in range(12)]


@pytest.mark.parametrize("n,size,percent", [(1, 64 << 10, 10), (1, 100, 50), (2, 64 << 10, 10), (3, 50, 100), (3, 1, 7)])
def test_against_brute_force(spark, corpus, n, size, percent):
    docs, target = corpus
    got = resample.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(t,) for t in target], "text string"), percent=percent, n=n, size=size)
    same_rows(got.collect(), brute(docs, target, n, percent=percent))


def test_chunks_own_each_feature_once():
    r = random.Random(5)
    for _ in range(200):
        raw = "".join(r.choices("ab1é  -\n", k=r.randrange(0, 120))).encode()
        n, size = r.randrange(1, 5), r.randrange(1, 30)
        parts = list(resample.split(raw, n, size))
        assert b"".join(own for own, _ in parts) == raw
        whole = sorted(resample.features(raw, b"", n, 997)[1])
        assert sorted(f for own, carry in parts for f in resample.features(own, carry, n, 997)[1]) == whole


def test_odd_rows(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([("one two three",), (None,)], "text string")
    same_rows(resample.ranked(odd_docs, bench, percent=50, min_words=1).collect(), brute(texts_by_id(odd_docs), ["one two three", None], 1, percent=50, min_words=1))
    assert resample.ranked(no_docs, bench).collect() == []
    assert resample.ranked(odd_docs, bench.limit(0)).count() == odd_docs.count()


def test_many_rows_with_one_score(spark):
    docs = [(4, "a b c")] * 40 + [(i, "a b c") for i in range(40)]
    got = resample.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("a",)], "text string"), percent=60, min_words=3)
    same_rows(got.collect(), brute(docs, ["a"], 1, percent=60, min_words=3))


def test_drawn_rows_keep_their_columns(spark, odd_docs):
    clashing = odd_docs.selectExpr("doc_id", "text", "lang as score", "source as rank", "n_chars as own", "n_words as id", "ids as i")
    got = resample.drawn(clashing, odd_docs.select("text"), percent=100, min_words=1)
    assert got.columns == clashing.columns and got.filter("text is null or trim(text) = ''").count() == 0


def test_resembling_documents_are_drawn_more_often(spark):
    r = random.Random(1)
    docs = [(i, " ".join(r.choices("abcdefgh" if i % 2 else "pqrstuvw", k=50))) for i in range(400)]
    got = resample.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(" ".join("abcdefgh" * 20),)], "text string"), percent=10)
    drawn = [x["doc_id"] % 2 for x in got.filter("rank is not null").collect()]
    assert len(drawn) == 40 and sum(drawn) >= 30
