import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.llm import gam, queries, toxicity
from tests.llm.conftest import same_rows

NO_LABELS = "doc_id long, quality int, toxic int"


def held(doc, modulus, value):
    return doc is not None and zlib.crc32(str(doc).encode()) % modulus == value


@pytest.mark.parametrize("query, column, modulus, value, least", [(queries.op4_quality, "quality", 3, 1, 0.95), (queries.op10_toxicity, "toxic", 5, 0, 0.9)])
def test_held_out_accuracy(spark, query, column, modulus, value, least):
    sf_dir = "/root/testdata/sf0.01"
    rows = query(spark, sf_dir).collect()
    labels = {r["doc_id"]: r[column] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(r["held_out"] == held(r["doc_id"], modulus, value) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    known = [(labels[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert np.mean([a == b for a, b in known]) >= least


@pytest.mark.parametrize("operator", [gam, toxicity])
def test_odd_rows(spark, odd_docs, no_docs, operator):
    none = spark.createDataFrame([], NO_LABELS)
    assert {r["score"] for r in operator.classify(odd_docs, none).collect()} == {0.5}
    one = spark.createDataFrame([(i, 1, 1) for i in range(14)] + [(3, 0, 0), (None, 1, 1), (2, None, None)], NO_LABELS)
    rows = operator.classify(odd_docs, one).collect()
    assert len(rows) == odd_docs.count() and len({r["score"] for r in rows}) == 1 and rows[0]["score"] > 0.5
    assert operator.classify(no_docs, one).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    for operator, column, modulus, value in ((gam, "quality", 3, 1), (toxicity, "toxic", 5, 0)):
        turned = [(r["doc_id"], *(1 - r[c] if c == column and held(r["doc_id"], modulus, value) else r[c] for c in ("quality", "toxic"))) for r in labels]
        a, b = (operator.classify(docs, spark.createDataFrame(x, NO_LABELS)).select("doc_id", "score").collect() for x in ([tuple(r) for r in labels], turned))
        same_rows(a, b)


def test_additive_model_learns_an_interaction():
    r = np.random.default_rng(1)
    x = r.uniform(size=(4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = gam.train(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x[3000:]) > 0.5) == y[3000:]) > 0.95


def test_ngram_weights_find_words_inside_words(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows = [(i, " ".join([word() for _ in range(40)] + [f"{word()}zzqzz{word()}"] * (i % 3 == 0))) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(600)], NO_LABELS)
    out = toxicity.classify(spark.createDataFrame(rows, "doc_id long, text string"), labels).collect()
    assert np.mean([x["predicted"] == (x["doc_id"] % 3 == 0) for x in out if x["held_out"]]) == 1


def test_scores_equal_a_plain_loop_over_ngrams():
    r = random.Random(5)
    letters = ["a", "b", "ab", "ba", " ", "  ", "-", "\n", "É", "ß", "中", "_", "7", "\U00020001", "\x00", "İ"]
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(60))) for _ in range(400)] + ["", "ab" * 4000]
    weight = {g: r.uniform(-1, 1) for g in {g for t in texts[:50] for w in toxicity.words_of(t) for g in toxicity.grams(w)}}
    model = toxicity.Model(-0.3, weight)

    def plain(text):
        total = model.bias
        words = set(re.findall(r"\w+", text.lower()))
        for g, v in weight.items():
            total += v * math.log2(1 + sum(any(f" {w} "[i : i + len(g)] == g for i in range(len(w) + 3 - len(g))) for w in words))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, total))))

    scorer = toxicity.Scorer(model)
    scorer.table.most = 40  # so that words are dropped and come again
    for at in range(0, len(texts), 60):
        found = scorer.scores(texts[at : at + 60])
        assert np.allclose(found, [plain(t) for t in texts[at : at + 60]], atol=1e-12)


def test_ngram_model_equals_a_plain_fit(spark):
    """Ratios and kept n-grams by plain counting, weights by plain gradient descent to the same minimum."""
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcd") for _ in range(5))
    rows = [(i, " ".join([word() for _ in range(12)] + ["zzq"] * (i % 3 == 0 and r.random() < 0.8))) for i in range(240)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(240)], NO_LABELS)
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels, F.lit(True))
    y = np.array([float(i % 3 == 0) for i in range(240)])
    sets = [set().union(*map(toxicity.grams, toxicity.words_of(t))) for _, t in rows]
    kept = {}
    for g in set().union(*sets):
        pos, neg = (sum(g in s for s, v in zip(sets, y) if v == k) for k in (1, 0))
        both = (pos + neg) / 240
        if pos + neg >= toxicity.MIN_TEXTS and both < 1 and abs(pos / 80 - neg / 160) / math.sqrt(both * (1 - both) * (1 / 80 + 1 / 160)) >= toxicity.MIN_Z:
            kept[g] = math.log((pos + 1) / 82) - math.log((neg + 1) / 162)
    assert model.weight.keys() == kept.keys() and len(kept) > 2
    names = list(kept)
    x = np.array([[kept[g] * math.log2(1 + sum(g in toxicity.grams(w) for w in toxicity.words_of(t))) for g in names] for _, t in rows])
    loss = lambda w, b: np.mean(np.log1p(np.exp(x @ w + b)) - y * (x @ w + b)) + toxicity.PENALTY / 2 * w @ w
    w, b = np.zeros(len(names)), 0.0
    for _ in range(20_000):
        error = (1 / (1 + np.exp(-(x @ w + b))) - y) / 240
        w, b = w - 0.5 * (x.T @ error + toxicity.PENALTY * w), b - 0.5 * error.sum()
    assert abs(loss(np.array([model.weight[g] / kept[g] for g in names]), model.bias) - loss(w, b)) < 2e-3


def test_trees_and_scores_of_the_additive_model_equal_plain_loops():
    r = np.random.default_rng(3)
    for _ in range(30):
        g, h = r.normal(size=7), r.uniform(0.1, 1, 7)
        gain = lambda cuts: sum(g[a:b].sum() ** 2 / (h[a:b].sum() + gam.SMOOTH) for a, b in zip([0, *cuts], [*cuts, 7]))
        cuts = []
        for _ in range(2):  # a cut that gains nothing is not made
            best = max((c for c in range(1, 7) if c not in cuts), key=lambda c: gain(sorted([*cuts, c])))
            if gain(sorted([*cuts, best])) <= gain(cuts) + 1e-9:
                break
            cuts = sorted([*cuts, best])
        wanted = np.concatenate([np.full(b - a, g[a:b].sum() / (h[a:b].sum() + gam.SMOOTH)) for a, b in zip([0, *cuts], [*cuts, 7])])
        assert np.allclose(gam._grow(g, h), wanted)
        g2, h2 = r.normal(size=(4, 5)), r.uniform(0.1, 1, (4, 5))
        best = max(((i, j) for i in range(3) for j in range(4)), key=lambda c: sum(g2[a, b].sum() ** 2 / (h2[a, b].sum() + gam.SMOOTH) for a in (slice(0, c[0] + 1), slice(c[0] + 1, None)) for b in (slice(0, c[1] + 1), slice(c[1] + 1, None))))
        found = gam._quadrants(g2, h2)[1]
        for a in (slice(0, best[0] + 1), slice(best[0] + 1, None)):
            for b in (slice(0, best[1] + 1), slice(best[1] + 1, None)):
                assert np.allclose(found[a, b], g2[a, b].sum() / (h2[a, b].sum() + gam.SMOOTH))
    x = r.uniform(size=(300, 4))
    model = gam.train(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float))
    for row, s in zip(x[:50], model.score(x[:50])):
        at = [sum(v > e for e in edges) for v, edges in zip(row, model.edges)]
        total = model.intercept + sum(t[k] for t, k in zip(model.tables, at)) + sum(t[at[j], at[k]] for (j, k), t in model.pairs.items())
        assert abs(s - 1 / (1 + math.exp(-total))) < 1e-12


def test_samples_are_the_smallest_hashes(spark):
    rows = spark.range(9000).selectExpr("id as doc_id")
    found = [r["doc_id"] for r in gam.smallest_hashes(rows, 300).collect()]
    order = [r["doc_id"] for r in rows.orderBy(F.expr(f"pmod(xxhash64(doc_id), {1 << 40})"), "doc_id").limit(300).collect()]
    assert sorted(found) == sorted(order)
    assert gam.smallest_hashes(rows, 20_000).count() == 9000


def test_a_repeated_document_counts_once_in_the_sample(spark, sf_dir):
    from pyspark.sql import functions as F

    from foliant.llm import toxicity
    from foliant.llm.batches import id_and_text

    texts = id_and_text(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    toxic = labels.filter("toxic = 1").first()["doc_id"]
    many = texts.unionByName(texts.filter(F.col("doc_id") == toxic).withColumn("c", F.explode(F.sequence(F.lit(1), F.lit(500)))).drop("c"))
    sizes = {r["y"]: r["count"] for r in toxicity.sample(many, labels, F.lit(True), "toxic", 20).groupBy("y").count().collect()}
    assert 0 < sizes[1] <= 20 and sizes[0] == 20


def test_the_fit_finds_the_minimum(spark):
    import numpy as np

    from foliant.llm import toxicity

    r = np.random.default_rng(5)
    found = [np.unique(r.integers(0, 30, 8)) for _ in range(200)]
    times = [r.integers(1, 5, len(f)).astype(float) for f in found]
    ratio = r.normal(size=30)
    y = np.array([float(7 in f or r.random() < 0.2) for f in found])
    w, bias = toxicity._logistic(y, found, times, ratio)
    x = np.zeros((200, 30))
    for row, f, t in zip(x, found, times):
        row[f] = ratio[f] * np.log2(1 + t)
    p = 1 / (1 + np.exp(-(x @ w + bias)))
    slope = x.T @ (p - y) / len(y) + toxicity.PENALTY * w
    assert np.abs(slope).max() < 1e-3 and abs(np.mean(p - y)) < 1e-3


def test_what_reaches_the_driver_is_bounded(spark, monkeypatch):
    """More labels than the samples may hold: op4 and op10 take no more rows than that to the driver."""
    from pyspark.sql import functions as F

    from foliant.llm import gam, toxicity
    from foliant.llm.batches import id_and_text

    labels = spark.range(48_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"), (F.col("id") % 3 == 0).cast("int").alias("quality"))
    texts = labels.select("doc_id", F.concat(F.lit("text "), F.when(F.col("toxic") == 1, "bad ").otherwise("good "), (F.col("doc_id") % 97).cast("string")).alias("text"))
    assert toxicity.sample(id_and_text(texts), labels, F.lit(True), "toxic", 300).count() == 600
    seen, train = [], gam.train
    monkeypatch.setattr(gam, "train", lambda x, y: seen.append(len(y)) or train(x[:500], y[:500]))
    assert gam.classify(texts, labels).count() == 48_000 and seen == [gam.MAX_ROWS] == [20_000]
