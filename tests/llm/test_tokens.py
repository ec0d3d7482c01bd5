import hashlib
import random
import zlib

import numpy as np
import pytest

from foliant.llm import counts, pieces, queries, tokenio
from foliant.llm.storage import fresh_path
from tests.llm.conftest import ODD_TEXTS, same_rows, texts_by_id

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def noise(n, seed=5):
    r = random.Random(seed)
    alphabet = [" ", "  ", "a", "the", "▁", "\n", "\n ", "é", "中", "😀", "\x00", "<s>", "<|endoftext|>", "ing", "....", "\t", "aaaa", "'s", "12", "́", "\x1c", "\x85", "　"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_pieces_equal_the_library(sp):
    model = pieces.Pieces(P.path("piece_bpe_32k.model"))
    for text in [t or "" for t in ODD_TEXTS] + noise(3000):
        ids = sp.encode(text)
        assert model.encode(text) == ids
        assert model.decode(ids) == sp.decode(ids)
    r = random.Random(2)
    for _ in range(3000):
        ids = [r.choice([r.randrange(32000), r.randrange(3, 259), 28705, 0, 1, 2]) for _ in range(r.randint(0, 8))]
        assert model.decode(ids) == sp.decode(ids)


def many(model, texts):
    """(ids, decoded) of texts encoded together; None for those that the batch leaves out."""
    numbers, counts, flags = model.words([t.encode() for t in texts])
    flat, sizes = model.ids.take(numbers)
    at = pieces._bounds(counts, sizes)
    return [None if f else (flat[a:b].tolist(), model.decode(flat[a:b].tolist())) for a, b, f in zip(at[:-1], at[1:], flags, strict=True)]


def test_pieces_of_many_texts_equal_the_library(sp, monkeypatch):
    monkeypatch.setattr(pieces, "CACHE_WORDS", 400)  # so that words are dropped and come again
    monkeypatch.setattr(pieces, "PAIR_BITS", 8)
    model = pieces.Pieces(P.path("piece_bpe_32k.model"))
    r = random.Random(9)
    words = lambda n: " ".join("".join(r.choice("etaoinshr\u00e9\u00fc\u0434\u4e2d0-.,\n") for _ in range(r.choice([1, 3, 7, 15, 60]))) for _ in range(n))
    texts = [t or "" for t in ODD_TEXTS] + noise(2000, 6) + [words(r.randrange(30)) for _ in range(600)]
    left_out = 0
    for at in range(0, len(texts), 150):
        for text, found in zip(texts[at : at + 150], many(model, texts[at : at + 150]), strict=True):
            ids = sp.encode(text)
            left_out += found is None
            assert found is None or found == (ids, sp.decode(ids))
    assert 0 < left_out < len(texts) / 2


def test_piece_query(spark, sf_dir, odd_docs, no_docs, sp):
    def brute(rows):
        for doc, text in rows:
            ids = sp.encode(text)
            yield doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()

    same_rows(queries.op3_pieces(spark, sf_dir).collect(), brute(texts_by_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
    same_rows(pieces.digests(odd_docs, P.path("piece_bpe_32k.model")).collect(), brute(texts_by_id(odd_docs)))
    same_rows(((r[0], r[1], r[2]) for r in pieces.encode(odd_docs, P.path("piece_bpe_32k.model")).collect()), ((d, sp.encode(t), sp.decode(sp.encode(t))) for d, t in texts_by_id(odd_docs)))
    assert pieces.digests(no_docs, P.path("piece_bpe_32k.model")).count() == 0


def test_texts_encoded_together_equal_the_library(hf, monkeypatch):
    monkeypatch.setattr(counts, "CACHE", 500)  # so that words are dropped and come again
    monkeypatch.setattr(counts, "JOINED", 5)
    bpe = counts.ByteBpe(P.path("byte_bpe_50k.json"))
    r = random.Random(3)
    signs = ["'", "'s", "'ll", "'re", "'t", "s", "ll", "Don't", " ", "  ", "\n", "\r\n", "\t", "\u00a0", "\u2028", "\u3000", "\u2019s", "\u00e9t\u00e9", "\u4e2d\u6587", "12", "\u0663", "\u2167", "-", "...", "\U0001f600", "abcdefghijklmnopqrstu", "\u085f"]
    texts = [t or "" for t in ODD_TEXTS] + noise(1500, 8) + ["".join(r.choice(signs) for _ in range(r.randrange(25))) for _ in range(3000)]
    for at in range(0, len(texts), 200):
        flat, sizes = bpe.encode_texts([t.encode() for t in texts[at : at + 200]])
        found = [x.tolist() for x in np.split(flat, np.cumsum(sizes)[:-1])]
        assert found == [hf.encode(t, add_special_tokens=False).ids for t in texts[at : at + 200]]


def test_summaries_of_words_keep_the_frequent_ones(hf):
    bpe = counts.ByteBpe(P.path("byte_bpe_50k.json"))
    import pyarrow as pa

    texts = [" ".join(["often"] * 30 + [f"once{k}x{j}" for j in range(20)]) for k in range(60)]
    found = counts._summary(bpe, (pa.RecordBatch.from_arrays([pa.array(texts[k : k + 6])], ["text"]) for k in range(0, 60, 6)), 8)
    assert found.words()[0] == " often" and len(found.words()) <= 8 and found.counts[0] >= 60 * 29 - 60 * 40 / 8
    assert np.all(np.diff(found.counts) <= 0) or len(found.counts) < 8


def test_token_counts(spark, sf_dir, odd_docs, no_docs, hf):
    brute = lambda rows: [(d, len(t.encode()), (n := len(hf.encode(t, add_special_tokens=False).ids)), n > 1024) for d, t in rows]
    same_rows(queries.op6_token_counts(spark, sf_dir).collect(), brute(texts_by_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet")
    same_rows(counts.count_tokens(texts, P.path("byte_bpe_50k.json"), frequent_size=1).collect(), [r[:3] for r in brute(texts_by_id(texts))])
    for size in (1, 50):
        same_rows(counts.count_tokens(odd_docs, P.path("byte_bpe_50k.json"), frequent_size=size).collect(), [r[:3] for r in brute(texts_by_id(odd_docs))])
    assert counts.count_tokens(no_docs, P.path("byte_bpe_50k.json")).count() == 0
    texts = spark.createDataFrame(list(enumerate(noise(2000))), "doc_id long, text string")
    same_rows(counts.count_tokens(texts, P.path("byte_bpe_50k.json")).collect(), [r[:3] for r in brute(texts_by_id(texts))])


def test_token_files(spark, sf_dir, odd_docs, no_docs, hf):
    def brute(rows):
        at = 0
        for doc, text in sorted(rows):
            ids = [*hf.encode(text, add_special_tokens=False).ids, 0]
            yield doc, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())
            at += len(ids)

    same_rows(queries.op8_token_files(spark, sf_dir).collect(), brute(texts_by_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
    noisy = spark.createDataFrame(list(enumerate(noise(2000))), "doc_id long, text string")
    tokenio.write_ids(noisy.repartition(7), path := fresh_path(spark, "t"), P.path("byte_bpe_50k.json"))
    same_rows(tokenio.digests(spark, path).collect(), brute(texts_by_id(noisy)))
    one = tokenio.read_ids(spark, path).filter("doc_id = 77").collect()
    assert len(one) == 1 and one[0]["ids"][:-1] == hf.encode(texts_by_id(noisy.filter("doc_id = 77"))[0][1], add_special_tokens=False).ids
    tokenio.write_ids(odd_docs, path := fresh_path(spark, "t"), P.path("byte_bpe_50k.json"))
    rows = sorted(tokenio.digests(spark, path).collect(), key=lambda r: r["start"])
    assert len(rows) == odd_docs.count() and rows[0]["doc_id"] is None
    assert all(a["start"] + a["n_tokens"] == b["start"] for a, b in zip(rows, rows[1:]))
    same_rows([(r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in rows[1:]], [(d, n, c) for d, _, n, c in brute([x for x in texts_by_id(odd_docs) if x[0] is not None])])
    tokenio.write_ids(no_docs, path := fresh_path(spark, "t"), P.path("byte_bpe_50k.json"))
    assert tokenio.digests(spark, path).count() == 0


def scanned(frame):
    """Rows that the scans of an executed query gave."""
    frame.collect()
    plan, rows, todo = frame._jdf.queryExecution().executedPlan(), 0, []
    todo.append(plan)
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif node.nodeName().startswith("Scan"):
            rows += node.metrics().apply("numOutputRows").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return rows


def test_lookups_skip_row_groups_and_files_hold_bloom_filters(spark, tmp_path):
    from foliant.llm import tokenio
    from foliant.llm.queries import tokenizer_file

    n = 20_000
    docs = spark.range(n).selectExpr("id * 3 AS doc_id", "concat('word ', id) AS text")
    path = f"file://{tmp_path}/ids"
    tokenio.write_ids(docs.coalesce(1), path, tokenizer_file("byte_bpe_50k.json"))
    rows = tokenio.read_ids(spark, path)
    assert scanned(rows) == n
    # One key, and a key that is not there: groups of 1,000 rows are skipped by minima and maxima.
    assert rows.filter("doc_id = 3000").count() == 1 and scanned(rows.filter("doc_id = 3000")) <= 1000
    assert scanned(rows.filter("doc_id > 59000")) <= 2000
    # Within a group a key that is not there (3 does not divide it) is told by the Bloom filter alone.
    absent = [scanned(rows.filter(f"doc_id = {k}")) for k in range(3001, 3031, 3)]
    assert sorted(absent)[len(absent) // 2] == 0
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    kinds = set()
    for file in tmp_path.glob("ids/*.orc"):
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(str(file)), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        batches = reader.rows()
        for stripe in range(reader.getStripes().size()):
            streams = batches.readStripeFooter(reader.getStripes().get(stripe)).getStreamsList()
            kinds |= {streams.get(i).getKind().name() for i in range(streams.size())}
        batches.close()
        reader.close()
    assert {"ROW_INDEX", "BLOOM_FILTER_UTF8"} <= kinds
