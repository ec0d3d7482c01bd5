import hashlib
import re

from foliant.llm import decontaminate, queries
from foliant.llm.decontaminate import Windows, words_of
from tests.llm.conftest import same_rows, texts_by_id

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))


def brute(docs, items, window=10):
    index = {}
    for item, text in items:
        if item is None:
            continue
        w = words(text or "")
        for at in range(max(1, len(w) - window + 1) if w else 0):
            index.setdefault(tuple(w[at : at + window]), set()).add(str(item))
    lengths = {len(k) for k in index}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in lengths:
            for at in range(len(w) - n + 1):
                if (key := tuple(w[at : at + n])) in index:
                    hit |= set(range(at, at + n))
                    found |= index[key]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


def test_words():
    text = "Don't — naïve\x7fX9{y}`z`[A]Ünï"
    assert [w.decode() for w in words_of(text.encode())] == words(text)


def test_search_finds_every_occurrence():
    import random

    r = random.Random(3)
    for _ in range(300):
        text = " ".join(r.choice("abc") for _ in range(r.randint(0, 60)))
        items = [(str(i), " ".join(r.choice("abc") for _ in range(r.randint(0, 9)))) for i in range(5)]
        tables = Windows([(i, t.encode()) for i, t in items], 4)
        spans, found = tables.search(words_of(text.encode()))
        (_, _, hit, n, _, _), = brute([(0, text)], items, 4)
        assert sum(b - a + 1 for a, b in spans) == hit and len(found) == n


def test_query_against_brute_force(spark, sf_dir):
    docs, items = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    same_rows(queries.op1_decontaminate(spark, sf_dir).collect(), brute(texts_by_id(docs), [tuple(r) for r in items.collect()]))


def test_odd_rows_and_shards(spark, odd_docs, no_docs, monkeypatch):
    items = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven twelve"), (1, "one"), (2, None), (None, "one"), (3, ""), (4, "aaaa " * 12), (5, "Zwei DREI"), (6, "one")], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 40)
    found = decontaminate.scan(odd_docs, items)
    rows = [(r["doc_id"], r["n_words"], sum(s["last"] - s["first"] + 1 for s in r["spans"]), len(r["items"])) for r in found.collect()]
    same_rows(rows, [r[:4] for r in brute(texts_by_id(odd_docs), [tuple(r) for r in items.collect()])])
    clean = decontaminate.drop_contaminated(odd_docs, items)
    assert clean.columns == odd_docs.columns and clean.count() == sum(r[2] == 0 for r in rows)
    assert decontaminate.scan(no_docs, items).count() == 0
    assert decontaminate.scan(odd_docs, items.limit(0)).filter("size(spans) > 0").count() == 0
