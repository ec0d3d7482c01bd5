"""Exact retrieval by bounds, intervals as equality joins."""

import random
from datetime import date, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.functions import vectors
from foliant.operators import intervals, retrieval, scoring, store
from foliant.plans import reference

CHUNK = "id long, document_id long, chunk_index int, page_from int, page_to int, content string, retrieval_status string, authority_level string, convenio_id long, embedding array<float>, validity_start date, validity_end date"
REQUEST = "req_id string, query_vec array<float>, convenio_id long, include_national_law boolean, statuses array<string>, as_of_date date, k int"


def day(r):
    return r.choice([None, date(2024, 1, 1) + timedelta(r.randrange(60))])


@pytest.fixture(scope="module")
def odd_chunks(spark):
    """Copies, zero vectors, other lengths, nulls in every column of the scope."""
    r = random.Random(8)
    some = [[float(r.randrange(-3, 4)) for _ in range(6)] for _ in range(25)]
    pick = lambda: r.choice([None, [], [0.0] * 6, [1.0, 2.0], *some, *some])
    rows = [(i, i // 4, i % 4, 1, 2, f"t{i}", r.choice([None, "active", "archived", "x"]), r.choice([None, "national_law", "official_convenio"]), r.choice([None, 1, 2]), pick(), day(r), day(r)) for i in range(400)]
    rows += [(1000 + i, 0, 0, 1, 1, "copy", "active", "national_law", 1, some[0], None, None) for i in range(300)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, CHUNK).repartition(5).cache(), some


def plain_batch(chunks, requests):
    """Every eligible pair, ranked by the JVM's own arithmetic."""
    c, q = chunks.alias("c"), requests.alias("q")
    scope = (F.col("c.convenio_id") == F.col("q.convenio_id")) | (F.col("q.include_national_law") & (F.col("c.authority_level") == "national_law"))
    d = F.col("q.as_of_date")
    live = F.array_contains("q.statuses", F.col("c.retrieval_status")) & (d.isNull() | F.col("validity_start").isNull() | (F.col("validity_start") <= d)) & (d.isNull() | F.col("validity_end").isNull() | (F.col("validity_end") >= d))
    pairs = c.join(q, scope & live).withColumn("distance", vectors.cosine_distance(F.col("embedding"), F.col("query_vec")))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("req_id").orderBy(F.asc_nulls_last("distance"), "id"))
    return pairs.withColumn("rank", rank).filter("rank <= k").select("req_id", "rank", "id", "content", F.round(1 - F.col("distance"), 6).alias("score"))


def test_batches_of_odd_requests(spark, odd_chunks):
    chunks, some = odd_chunks
    r = random.Random(4)
    ask = lambda: r.choice([None, [0.0] * 6, [2.0, 1.0], *some])
    rows = [(f"q{i}", ask(), r.choice([None, 1, 2, 9]), r.choice([True, False, None]), r.choice([None, [], ["active"], ["active", "archived", None]]), day(r), r.choice([0, 1, 3, 12, 500])) for i in range(60)]
    rows += [("copies", some[0], 1, True, ["active"], None, 5), ("all", some[1], 1, True, ["active", "archived", "x"], None, 900)]
    requests = spark.createDataFrame(rows, REQUEST)
    key = lambda x: (x["req_id"], x["rank"])
    got = sorted(retrieval.retrieve_batch(chunks, requests).select("req_id", "rank", "id", "content", "score").collect(), key=key)
    assert got == sorted(plain_batch(chunks, requests).collect(), key=key) and len(got) > 500


def test_one_request(spark, odd_chunks):
    chunks, some = odd_chunks
    for k in (1, 4, 350):
        got = [(x["id"], x["score"]) for x in retrieval.retrieve(chunks.filter("id >= 1000 or id % 7 <> 0"), some[3], convenio_id=1, k=k).collect()]
        one = spark.createDataFrame([("q", some[3], 1, True, ["active"], None, k)], REQUEST)
        wanted = plain_batch(chunks.filter("id >= 1000 or id % 7 <> 0"), one).collect()
        assert sorted(map(str, got)) == sorted(str((x["id"], x["score"])) for x in wanted)


def test_no_requests(spark, odd_chunks):
    assert retrieval.retrieve_batch(odd_chunks[0], spark.createDataFrame([], REQUEST)).count() == 0
    assert retrieval.retrieve(odd_chunks[0].limit(0), [1.0] * 6, convenio_id=1).count() == 0


def test_fewer_products_than_vectors(spark):
    sf_dir = "/root/testdata/sf0.01"
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    c = reference.chunks(spark, sf_dir).coalesce(1)
    one = spark.createDataFrame([("q", reference.query_vector(spark, sf_dir), 3, True, ["active", "archived"], None, 4)], REQUEST)
    try:
        work = retrieval.weighing(c, one).first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert 0 < work["scored"] < work["seen"] < c.count()
    # On vectors whose first half says more, as after a rotation, most products end half-way.
    r = np.random.default_rng(0)
    x = r.normal(size=(4000, 32)) * np.r_[np.ones(16), np.full(16, 0.1)]
    best = scoring.Best(scoring.Requests([x[0].tolist()], [5], None))
    for at in range(0, 4000, 500):
        best.add(pa.RecordBatch.from_arrays([pa.array(range(at, at + 500)), pa.array(x[at : at + 500].astype("f4").tolist(), pa.list_(pa.float32()))], ["id", "embedding"]))
    assert best.seen == 4000 and best.scored < 1200 and 0 in best.sort_out()[1]


def test_a_task_keeps_few_of_many_copies():
    q = scoring.Requests([[1.0, 0.0, 0.0, 0.0]], [3], None)
    best = scoring.Best(q)
    for start in range(0, 5000, 500):
        ids = list(range(5000 - start, 4500 - start, -1))
        best.add(pa.RecordBatch.from_arrays([pa.array(ids), pa.array([[1.0, 1.0, 0.0, 0.0]] * 500, pa.list_(pa.float32()))], ["id", "embedding"]))
        assert sum(len(h[0]) for h in best.held) <= 600
    assert sorted(best.sort_out()[1].tolist()) == [1, 2, 3]


def test_text_is_read_after_ranking(spark, sf_dir):
    for frame in (reference.retrieve_topk(spark, sf_dir), reference.batch_retrieve_topk(spark, sf_dir)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        for part in ("Window", "GlobalLimit"):
            for at in [i for i, line in enumerate(plan.split("\n")) if part in line]:
                lines = plan.split("\n")
                depth = lambda x: len(x) - len(x.lstrip(" :+-"))
                below = []
                for line in lines[at + 1 :]:
                    if depth(line) <= depth(lines[at]):
                        break
                    below.append(line)
                assert not any("content" in line or "text#" in line for line in below if "Relation" not in line), part


def test_intervals_against_comparisons(spark):
    r = random.Random(6)
    some = lambda: r.choice([None, date(1, 1, 1), date(9999, 12, 31), date(2024, 1, 1) + timedelta(r.randrange(40))])
    rows = spark.createDataFrame([(i, some(), some(), i % 2) for i in range(200)], "i int, a date, b date, k int")
    days = spark.createDataFrame([(j, some(), j % 2) for j in range(80)], "j int, d date, k int")
    got = sorted((x["i"], x["j"]) for x in intervals.holding(rows, "a", "b", days, "d", ["k"]).collect())
    assert got == sorted((x["i"], x["j"]) for x in rows.alias("r").join(days.alias("s"), (F.col("r.k") == F.col("s.k")) & ((F.col("a").isNull()) | (F.col("a") <= F.col("d"))) & (F.col("b").isNull() | (F.col("b") >= F.col("d"))) & F.col("d").isNotNull()).collect())
    plan = intervals.holding(rows, "a", "b", days, "d", ["k"])._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def files_read(frame):
    frame.collect()
    out, todo = 0, [frame._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        elif node.nodeName().startswith("Scan"):
            out += node.metrics().apply("numFiles").value()
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def test_a_scope_opens_its_own_files(spark, odd_chunks, tmp_path):
    chunks, some = odd_chunks
    path = str(tmp_path / "scoped")
    store.write_by_scope(chunks, path, slots=4, file_rows=100)
    whole, every = spark.read.parquet(path), files_read(spark.read.parquet(path))
    assert sorted(r["id"] for r in whole.collect()) == sorted(r["id"] for r in chunks.collect())
    for convenio, law in ((1, True), (2, False), (5, False), (None, True), (None, False)):
        rows = store.read_by_scope(spark, path, convenio, law)
        scope = retrieval.eligible(convenio, law, ("active",), None)
        assert sorted(r["id"] for r in rows.filter(scope).collect()) == sorted(r["id"] for r in chunks.filter(scope).collect())
        assert files_read(store.read_by_scope(spark, path, convenio, law)) < every
    assert files_read(store.read_by_scope(spark, path, None, False)) == 0


def test_many_requests_in_blocks_by_scope(spark, sf_dir, odd_chunks, monkeypatch):
    from foliant.operators import answering

    chunks, requests = reference.chunks(spark, sf_dir), reference.requests(spark, sf_dir)
    key = lambda x: (x["req_id"], x["rank"])
    whole = sorted(retrieval.retrieve_batch(chunks, requests).collect(), key=key)
    for name in ("BLOCK_REQUESTS", "MOST_REQUESTS"):
        monkeypatch.setattr(retrieval, name, 4)
    blocks = retrieval.retrieve_batch(chunks, requests)
    assert sorted(blocks.collect(), key=key) == whole and len(whole) > 20
    # Blocks read what the chunks need once, beside the text of the hits.
    plan = blocks._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window") > 3 and plan.count("doc_id") == reference.chunks(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("doc_id")
    asked = requests.withColumn("turn_id", F.col("req_id")).withColumn("pos", F.lit(0)).drop("req_id")
    found = answering.sources(chunks, asked)
    assert {r["turn_id"]: [(c["chunk_id"], c["content"], c["score"]) for c in r["chunks"]] for r in found.collect()} == {q: [(r["id"], r["content"], r["score"]) for r in whole if r["req_id"] == q] for q in {r["req_id"] for r in whole}}
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_vectors_meet_the_requests_of_their_scope_alone(monkeypatch):
    r = np.random.default_rng(3)
    x, scope = r.normal(size=(3000, 8)).astype("f4"), [k % 30 for k in range(3000)]
    scopes = [dict(convenio_id=k % 30, include_national_law=False, statuses=["active"], as_of_date=None) for k in range(300)]
    asked = r.normal(size=(300, 8))
    batch = pa.RecordBatch.from_pydict({"id": list(range(3000)), "embedding": pa.array(x.tolist(), pa.list_(pa.float32())), "convenio_id": pa.array(scope, pa.int64()), "authority_level": pa.array([None] * 3000, pa.string()), "retrieval_status": ["active"] * 3000, "validity_start": pa.array([None] * 3000, pa.date32()), "validity_end": pa.array([None] * 3000, pa.date32())})
    cells, eligible = [], scoring.Requests.eligible
    for most in (256, 0):  # by scope, and all together
        monkeypatch.setattr(scoring, "SCOPES", most)
        monkeypatch.setattr(scoring.Requests, "eligible", lambda self, *a: (out := eligible(self, *a), cells.append(out.size))[0])
        best = scoring.Best(scoring.Requests(asked.tolist(), [3] * 300, scopes))
        best.add(batch)
        request, ids, cosine, _ = best.sort_out()
        unit = x / np.linalg.norm(x, axis=1)[:, None].astype("f8")
        for q in range(0, 300, 17):
            own = np.flatnonzero(np.array(scope) == q % 30)
            wanted = own[np.argsort(-(unit[own] @ asked[q]))[:3]]
            assert set(wanted) <= set(ids[request == q]) and len(ids[request == q]) < 6
        assert best.seen == 3000
        cells, spent = [], sum(cells)
        assert spent == (3000 * 30 if most else 3000 * 300)
