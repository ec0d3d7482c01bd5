import corpus_pipeline
from foliant.llm import jaccard
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import shingle_set
from tests.llm.test_rules import brute as counts


def test_stages_follow_each_other(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, spark.createDataFrame(seen[-1], docs.schema), sf_dir)
        assert out.columns == docs.columns, name
        seen.append(out.collect())
        assert {r["doc_id"] for r in seen[-1]} <= {r["doc_id"] for r in seen[-2]}
    first, good, lines, single, clean = seen
    kept = {r["doc_id"] for r in good}
    assert all(r["doc_id"] not in kept for r in first if counts(r["text"])[-1])
    assert all(r["doc_id"] in kept for r in first if not counts(r["text"])[-1] and quality.get(r["doc_id"]) == 1)
    was = {r["doc_id"]: r["text"].split("\n") for r in good}
    assert all(set(r["text"].split("\n")) <= set(was[r["doc_id"]]) for r in lines)
    long = [x for r in lines for x in r["text"].split("\n") if len(x) >= 40]
    assert len(long) == len(set(long))
    sets = [shingle_set(r["text"], 5) for r in single]
    assert not any(a and b and 100 * len(a & b) >= 80 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    assert {r["doc_id"] for r in clean} == {d for d, *_, hit in contaminated([(r["doc_id"], r["text"]) for r in single], items) if not hit}
    ids = corpus_pipeline.STAGES[-1][1](spark, spark.createDataFrame(clean, docs.schema), sf_dir).collect()
    assert {r["doc_id"]: r["decoded"] for r in ids} == {r["doc_id"]: r["text"] for r in clean}
    assert jaccard.SIZE == 4  # the query's own size is another than the stage's


def test_run_gives_what_the_stages_give(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "ids", "decoded"] and 0 < out.count() < spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_stages_on_odd_rows(spark, sf_dir, odd_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, odd_docs, sf_dir)
        rows = out.collect()
        assert 0 <= len(rows) <= odd_docs.count(), name
        assert {r["doc_id"] for r in rows} <= {r["doc_id"] for r in odd_docs.collect()}
        assert stage(spark, no_docs, sf_dir).count() == 0
        if name != "sentencepiece_coding":
            assert out.columns == odd_docs.columns
    held = {n: {r["doc_id"] for r in f(spark, odd_docs, sf_dir).collect()} for n, f in corpus_pipeline.STAGES[:-1]}
    assert not {0, 1} & held["quality_rules"] and {0, 1} <= held["line_dedup"] and {0, 1} <= held["near_duplicates"] and {0, 1} <= held["benchmark_decontamination"]


def test_near_lines_go_in_the_pipeline(spark, sf_dir):
    line = "a line of a document that stands in another one with hardly any difference"
    rows = [(1, f"{line}\nfirst", "en", "s", 1), (2, f"second\n{line[:30]}{line[31:]}!", "en", "s", 1), (3, f"{line[:-12]}\nthird", "en", "s", 1)]
    out = corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), sf_dir)
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: f"{line}\nfirst", 2: "second", 3: f"{line[:-12]}\nthird"}


def test_intermediate_tables_can_be_released(spark, sf_dir):
    from foliant.llm import storage

    made = storage.materialise(spark.range(5), "x")
    path = storage._MADE[-1]
    assert made.count() == 5 and storage.release(spark) > 0 and not storage._MADE
    import os

    assert not os.path.exists(path.removeprefix("file://"))


def test_stages_keep_columns_of_any_name(spark, sf_dir):
    names = "bits word x y z s b __hit __s __k __row __kept __seen __counts __id __key own id key gone kept i k lang_ r h label head".split()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    wide = docs.selectExpr("*", *[f"doc_id + {j} AS `{n}`" for j, n in enumerate(names)], "map('a', doc_id) AS `a map`")
    # A few repeats, so that every path of the stages is taken.
    wide = wide.unionByName(wide.limit(5)).cache()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, sf_dir)
        plain = stage(spark, wide.select(*docs.columns), sf_dir)
        assert out.schema.simpleString() == wide.schema.simpleString(), name
        rows = out.collect()
        assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted((r["doc_id"], r["text"]) for r in plain.collect()), name
        assert all(r[n] == r["doc_id"] + j for r in rows for j, n in enumerate(names)), name
