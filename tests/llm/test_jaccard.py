import random
import re
from itertools import combinations

import numpy as np
import pytest

from foliant.llm import graph, jaccard, queries
from tests.llm.conftest import same_rows, texts_by_id


def shingle_set(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset()


def brute(rows, percent=85):
    """(doc_id, n, component) with the smallest id, by comparing all pairs."""
    sets = [shingle_set(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = group[i], group[j]
            group = [a if g == b else g for g in group]
    for i, (doc, _) in enumerate(rows):
        ids = [rows[k][0] for k in range(len(rows)) if group[k] == group[i] and rows[k][0] is not None]
        yield doc, len(sets[i]), (min(ids, default=None) if sets[i] else doc)


def mutated(r, words, times):
    words = list(words)
    for _ in range(times):
        words[r.randrange(len(words))] = f"n{r.randrange(10**6)}"
    return words


def corpus(seed=1):
    """Groups of near copies around the threshold, chains, boilerplate shared by many, and short texts."""
    r = random.Random(seed)
    rows = []
    shared = [f"b{i}" for i in range(60)]
    for _ in range(12):
        base = [f"w{r.randrange(4000)}" for _ in range(r.choice([5, 12, 40, 120, 400]))]
        for _ in range(r.choice([1, 2, 5, 20])):
            base = mutated(r, base, r.choice([0, 0, 1, 2, 3])) if r.random() < 0.5 else base
            rows.append(mutated(r, base, r.choice([0, 1, 1, 2, 4])))
    rows += [shared + [f"x{r.randrange(9999)}" for _ in range(r.choice([2, 6, 12, 30]))] for _ in range(40)]
    rows += [[w] for w in ("a", "A", "b")] + [["a", "b", "c"], ["A", "b", "C"], []]
    r.shuffle(rows)
    return [(i * 3 % 1009, r.choice([" ", "\n", "  "]).join(w)) for i, w in enumerate(rows)]


def test_groups_equal_brute_force(spark, monkeypatch):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    wanted = list(brute(rows))
    assert len({c for *_, c in wanted}) < len(wanted)
    same_rows(jaccard.groups(docs).collect(), wanted)
    monkeypatch.setattr(jaccard, "SUB_BLOCK", 300)
    monkeypatch.setattr(jaccard, "BUCKET", 2000)
    same_rows(jaccard.groups(docs).collect(), wanted)


def test_components_with_little_in_common_are_searched_by_shingle(spark, monkeypatch):
    # Each text shares all its shingles with the texts beside it, seven of eight with the next, which is not enough for a link.
    base = [f"w{k}" for k in range(420)]
    rows = [(k, " ".join(base[k : k + 11])) for k in range(400)] + [(1000 + k, " ".join([*base[k : k + 40], "end"])) for k in (3, 3, 4, 99, 200, 201)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    kinds = []
    real = jaccard._blocks
    monkeypatch.setattr(jaccard, "SUB_BLOCK", 200)
    monkeypatch.setattr(jaccard, "_blocks", lambda found: kinds.append(real(found)) or kinds[-1])
    same_rows(jaccard.groups(docs).collect(), brute(rows))
    assert any(len(r["block"]) <= 8 for r in kinds[0].collect())


def test_two_sub_blocks_meet_in_a_task_of_their_own(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SUB_BLOCK", 300)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    sets = spark.createDataFrame([(bytes([k] * 16), b"12345678") for k in range(9)], "cls binary, hashes binary")
    blocks = sets.selectExpr("cls", "100 as n", "unhex('00') as block")
    for threshold in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        plan = jaccard._links(sets, blocks, 85)._jdf.queryExecution().executedPlan().toString()
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        below = plan[plan.index("FlatMapGroupsInArrow") :].splitlines()[1:4]
        assert any("Exchange hashpartitioning(" in x and " i#" in x and " j#" in x for x in below), below


def test_repeated_rows_leave_a_defined_one(spark):
    rows = [(1, "a b c d e f", x) for x in ("de", "en", None, "ar")] + [(2, "other words here now", "x"), (None, "a b c d e f", "y"), (3, None, "z"), (3, None, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for n in (1, 3, 7):
        assert sorted(map(str, map(tuple, jaccard.one_of_each(docs.repartition(n)).collect()))) == sorted(map(str, [(1, "a b c d e f", "ar"), (2, "other words here now", "x"), (3, None, "q")]))


def test_query(spark, sf_dir):
    same_rows(queries.op2_jaccard(spark, sf_dir).collect(), brute(texts_by_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))))


def test_odd_rows(spark, odd_docs, no_docs):
    same_rows(jaccard.groups(odd_docs).collect(), brute(texts_by_id(odd_docs)))
    one = jaccard.one_of_each(odd_docs)
    assert one.schema == odd_docs.schema
    groups = {(c, d if c is None or n == 0 else None) for d, n, c in brute(texts_by_id(odd_docs))}
    assert one.count() == len(groups)
    assert jaccard.groups(no_docs).count() == 0 and jaccard.one_of_each(no_docs).count() == 0


def test_one_of_each(spark):
    rows = corpus(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    heads = {c if n else d for d, n, c in brute(rows)}
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(docs).collect()) == sorted(heads)


def test_divide_skip_counts_exactly():
    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 50))).astype(np.uint64) for _ in range(60)]
    lists = jaccard.Lists(sets)
    for s in sets:
        for least in (1, 2, 5, 20):
            found, share = lists.search(s, least, np.ones(60, bool))
            wanted = {k: n for k, x in enumerate(sets) if (n := len(np.intersect1d(s, x))) >= least}
            assert dict(zip(found.tolist(), share.tolist(), strict=True)) == wanted


def test_components(spark):
    r = random.Random(6)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (None, 1)]
    group = {}
    for a, b in edges:
        if a is None or a == b:
            continue
        x, y = group.setdefault(a, {a}), group.setdefault(b, {b})
        if x is not y:
            x |= y
            group |= dict.fromkeys(x, x)
    found = graph.components(spark.createDataFrame(edges, "a long, b long"))
    same_rows(found.collect(), [(n, min(g)) for n, g in group.items()])
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_that_do_not_settle_are_an_error(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="not settled in 2 rounds"):
        graph.components(path, rounds=2)
    same_rows(graph.components(path).collect(), [(k, 0) for k in range(41)])
