import random
import re
from collections import Counter

from foliant.llm import queries, rules
from tests.llm.conftest import same_rows, texts_by_id

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_base_counts(spark, sf_dir, odd_docs):
    for docs, found in ((spark.read.parquet(f"{sf_dir}/documents.parquet"), queries.op5_rules(spark, sf_dir)), (odd_docs, rules.judge(odd_docs, spark.createDataFrame([], "doc_id long, quality int")))):
        rows = found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()
        same_rows(rows, [(d, *brute(t)) for d, t in texts_by_id(docs)])


def test_bound_is_clopper_pearson():
    # The upper 95 % bound for 0 of 59 is 1 - 0.05 ** (1 / 59) = 0.0495; 58 texts are too few for 0.05.
    assert rules.admissible(0, 59, 0.05, 0.05) and not rules.admissible(0, 58, 0.05, 0.05)
    assert abs(rules.binomial_cdf(2, 10, 0.3) - 0.3827827864) < 1e-9
    assert not rules.admissible(0, 0, 0.5, 0.5) and not rules.admissible(9, 9, 0.5, 0.5)


def labelled(spark, n):
    good = " ".join(f"word{i} goes{i * 7} here" for i in range(30))
    bad = " ".join(f"w{i}$$$ {i}%%%" for i in range(40))
    rows = [(i, (good if i % 4 else bad) + f" {i}", ("en", "de", None)[i % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(n)], "doc_id long, quality int")


def test_cutoffs_reject_bad_texts_only_when_proven(spark):
    docs, labels = labelled(spark, 1800)
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(docs, labels).collect()}
    assert all(kept[i] == (i % 4 > 0) for i in range(1800))
    few, few_labels = labelled(spark, 60)
    assert all(r["kept"] for r in rules.judge(few, few_labels).collect())


def test_as_many_strata_as_there_are(spark):
    docs, labels = labelled(spark, 1800)
    docs = docs.unionByName(docs.selectExpr("doc_id + 10000 as doc_id", "text", "'only' || doc_id % 5 as lang"))
    found = rules.calibrate(rules.with_counts(docs), labels.unionByName(labels.selectExpr("doc_id + 10000 as doc_id", "quality"))).collect()
    assert {"", "de", "en"} <= {r["s"] for r in found} and "*" not in {r["s"] for r in found}
    # A stratum without labels of its own has no cutoff, whatever others have.
    kept = {r["doc_id"]: r["kept"] for r in rules.judge(docs, labels).collect()}
    assert all(kept[i] == (i % 4 > 0) for i in range(1800)) and all(kept[10_000 + i] for i in range(1800))


def test_copies_count_once(spark):
    good, bad = (" ".join(f"word{i} goes{i * 7} here" for i in range(30)), " ".join(f"w{i}$$$ {i}%%%" for i in range(40)))
    docs = spark.createDataFrame([(i, good if i % 4 else bad, "en") for i in range(1200)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(1200)], "doc_id long, quality int")
    trials = rules._trials(rules.with_counts(docs), labels, "lang", "doc_id")
    assert sorted(r["q"] for r in trials.collect()) == [0, 1]
    turned = labels.selectExpr("doc_id", "case when doc_id = 4 then 1 else quality end as quality")
    assert [r["q"] for r in rules._trials(rules.with_counts(docs), turned, "lang", "doc_id").collect()] == [1]
    assert all(r["kept"] for r in rules.judge(docs, labels).collect())


def test_false_rejection_stays_below_the_risk():
    """Draws of copies of texts with one statistic: the walk by the same functions, many times."""
    r = random.Random(7)
    risk, delta, ladder, exceeded, used = 0.1, 0.05, (0.9, 0.8, 0.7, 0.6, 0.5), 0, 0
    for _ in range(1000):
        # The statistic of a good text is uniform, so that a cutoff c rejects 1 - c of them; each stands there in up to 30 copies.
        seen = {round(r.random(), 9) for _ in range(300)}
        rows = [x for x in seen for _ in range(r.choice([1, 1, 2, 30]))]
        trials = set(rows)
        cut = None
        for c in ladder:
            if not rules.admissible(sum(x > c for x in trials), len(trials), risk, delta):
                break
            cut = c
        used += cut is not None
        exceeded += cut is not None and 1 - cut > risk + 1e-12
    assert exceeded <= 65, exceeded  # 5 in 100 draws, and room for chance


def test_odd_labels_and_columns(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (6, None), (999, 1)], "doc_id long, quality int")
    out = rules.keep_good(odd_docs, labels)
    assert out.columns == odd_docs.columns and out.schema == odd_docs.schema
    assert rules.judge(no_docs, labels).count() == 0 and rules.keep_good(no_docs, labels).count() == 0
