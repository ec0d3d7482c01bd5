import random

import corpus_pipeline
from foliant.llm import linededup, queries
from tests.llm.conftest import same_rows


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, k, least):
    """(doc_id, n_lines, equal, near) by comparing every two lines."""
    lines = sorted(((d is None, d or 0, p, line) for d, t in rows if t is not None for p, line in enumerate(t.split("\n")) if len(line) >= least))
    gone = {}
    for n, (*at, p, line) in enumerate(lines):
        earlier = [x[3] for x in lines[:n]]
        if line in earlier:
            gone[*at, p] = "equal"
        elif any(abs(len(x) - len(line)) <= k and distance(x, line) <= k for x in earlier):
            gone[*at, p] = "near"
    # A near line's copies are equal to an earlier line; a line equal to none may be near one.
    for d, t in rows:
        at = (d is None, d or 0)
        lines_of = t.split("\n") if t is not None else []
        yield d, len(lines_of), [p for p in range(len(lines_of)) if gone.get((*at, p)) == "equal"], [p for p in range(len(lines_of)) if gone.get((*at, p)) == "near"]


def edited(r, line, times):
    line = list(line)
    for _ in range(times):
        at = r.randrange(len(line))
        kind = r.randrange(3)
        if kind == 0:
            line[at] = r.choice("abcxé中")
        elif kind == 1:
            line.insert(at, r.choice("abcxé中"))
        else:
            del line[at]
    return "".join(line)


def corpus(seed, docs=60):
    r = random.Random(seed)
    bases = ["".join(r.choice("ab é") for _ in range(r.choice([8, 12, 13, 20, 31]))) for _ in range(14)]
    return [(i, "\n".join(r.choice([edited(r, r.choice(bases), r.choice([0, 0, 1, 2, 3])), "ab", ""]) for _ in range(r.randrange(5)))) for i in range(docs)]


def test_equal_to_brute_force(spark):
    for k in (0, 1, 2, 3):
        rows = corpus(k)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        same_rows(linededup.with_removals(docs, k, 8).collect(), brute(rows, k, 8))


def edits_for(n, least, k, wider):
    base = n - (n - least) % linededup.STEP
    return max([k, *(more for length, more in wider if base >= length)])


def brute_wider(rows, k, least, wider):
    """The places of near lines by document, comparing every two lines; the shorter one decides how many edits."""
    lines = sorted((d, p, line) for d, t in rows for p, line in enumerate(t.split("\n")) if len(line) >= least)
    different = {}
    for d, p, line in lines:
        different.setdefault(line, (d, p))
    near = set()
    for line, at in different.items():
        for other, before in different.items():
            if before < at:
                most = edits_for(min(len(line), len(other)), least, k, wider)
                near |= {line} if abs(len(line) - len(other)) <= most and sum(abs(line.count(c) - other.count(c)) for c in set(line + other)) <= 2 * most and distance(line, other) <= most else set()
    return sorted((d, p) for d, p, line in lines if line in near and different[line] == (d, p))


def test_longer_lines_may_differ_more(spark):
    for seed, (k, least, wider) in enumerate([(1, 8, ((24, 2), (40, 4))), (2, 10, ((26, 3), (42, 5))), (0, 9, ((25, 1),))]):
        r = random.Random(seed)
        bases = ["".join(r.choice("abc é") for _ in range(r.choice([8, 10, 23, 24, 25, 26, 27, 39, 40, 41, 42, 43, 57, 58, 59]))) for _ in range(16)]
        rows = [(i, "\n".join(edited(r, r.choice(bases), r.randrange(7)) for _ in range(4))) for i in range(70)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        found = [(x["doc_id"], p) for x in linededup.with_removals(docs, k, least, wider=wider).collect() for p in x["near"]]
        wanted = brute_wider(rows, k, least, wider)
        assert len(wanted) > 10 and sorted(found) == wanted


def test_near_lines_of_the_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    r = random.Random(4)
    long = sorted({line for _, t in rows for line in t.split("\n") if len(line) >= linededup.MIN_CHARS})[::9]
    rows += [(10_000 + i, "\n".join(edited(r, r.choice(long), r.randrange(6)) for _ in range(3))) for i in range(60)]
    found = {x["doc_id"]: x for x in linededup.with_removals(spark.createDataFrame(rows, "doc_id long, text string"), short=True).collect()}
    wanted = brute_wider(rows, linededup.MAX_EDITS, linededup.MIN_CHARS, linededup.WIDER)
    assert len(wanted) > 50 and sorted((d, p) for d, x in found.items() for p in x["near"]) == wanted
    made = {x["doc_id"]: (x["n_near"], x["removed"]) for x in queries.op9_lines(spark, sf_dir).collect()}
    # Rows that come later change nothing for those before.
    assert made == {d: (len(x["near"]), sorted([*x["equal"], *x["near"], *x["short"]])) for d, x in found.items() if d < 10_000}


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    found = queries.op9_lines(spark, sf_dir)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    seen, wanted = set(), []
    for d, t in rows:  # equal lines only; near ones are checked by the other tests
        gone = []
        for p, line in enumerate(t.split("\n")):
            if len(line) >= linededup.MIN_CHARS:
                gone += [p] if line in seen else []
                seen.add(line)
        wanted.append((d, len(t.split("\n")), len(gone)))
    same_rows(found.select("doc_id", "n_lines", "n_equal").collect(), wanted)


def test_odd_rows(spark, odd_docs, no_docs):
    found = {r["doc_id"]: r for r in linededup.with_removals(odd_docs).collect()}
    assert found[0]["n_lines"] == 0 and found[1]["n_lines"] == 1 and found[3]["n_lines"] == 3
    assert linededup.with_removals(odd_docs).count() == odd_docs.count()
    assert linededup.drop_repeats(odd_docs).schema == odd_docs.schema
    assert linededup.drop_repeats(odd_docs).count() == odd_docs.count()
    assert linededup.with_removals(no_docs).count() == 0 and linededup.drop_repeats(no_docs).count() == 0


def test_texts_lose_their_repeated_lines(spark):
    long = "this line is long enough to be compared with the others"
    rows = [(1, f"{long}\nshort"), (2, f"short\n{long}!\nshort"), (3, long), (4, f"{long}\n\n{long}?"), (None, long), (5, None), (6, "")]
    out = linededup.drop_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: f"{long}\nshort", 2: "short\nshort", 4: "", 5: None, 6: ""}


def test_short_lines_lose_exact_repeats(spark, sf_dir):
    long = "this line is long enough to be compared with the others"
    rows = [(1, f"{long}\nshort\n \n"), (2, f"short\n{long}!\nshorts\nshort"), (3, "short"), (4, " \n\nx\nx"), (None, "x\ny"), (5, None), (6, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = [(r["doc_id"], r["equal"], r["near"], r["short"]) for r in linededup.with_removals(docs, short=True).collect()]
    same_rows(found, [(1, [], [], []), (2, [], [1], [0, 3]), (3, [], [], [0]), (4, [], [], [3]), (None, [], [], [0]), (5, [], [], []), (6, [], [], [])])
    out = corpus_pipeline.line_dedup(spark, docs, sf_dir)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: f"{long}\nshort\n \n", 2: "shorts", 4: " \n\nx", None: "y", 5: None, 6: ""}
    seen, wanted = set(), {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda r: r["doc_id"]):
        lines = r["text"].split("\n")
        wanted[r["doc_id"]] = [p for p, x in enumerate(lines) if x.strip() and x in seen.union(lines[:p])]
        seen |= set(lines)
    made = queries.op9_lines(spark, sf_dir).collect()
    assert any(r["n_short"] for r in made)
    assert all(set(wanted[r["doc_id"]]) <= set(r["removed"]) and len(r["removed"]) == len(wanted[r["doc_id"]]) + r["n_near"] for r in made)
