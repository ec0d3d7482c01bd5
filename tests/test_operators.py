"""Operators that SQL cannot express, written-out cases, and properties."""

import random
import re
import zipfile
from datetime import date

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo

from foliant import providers
from foliant.config import Settings
from foliant.functions import text as T, tokens, vectors
from foliant.functions.unicode import without_marks
from foliant.operators import analytics, answering, answers, chunking, layout, retrieval, salary, store
from foliant.plans import reference
from foliant.sources import objects, workbook
from foliant.streaming import ingest
from tests import written

words = chunking.count_words


def test_pack_by_paragraphs_sentences_and_words():
    assert chunking.pack("a b c\n\nd e", words, 3) == ["a b c", "d e"]
    assert chunking.pack("a b\n \nc\n\nd e f g", words, 3) == ["a b\n\nc", "d e f", "g"]
    assert chunking.pack("  \n ", words, 3) == []
    # A sentence that is too long after something waiting stays whole; first of all it is cut into words.
    assert chunking.pack("s x. l l l l l. z.", words, 3) == ["s x.", "l l l l l.", "z."]
    assert chunking.pack("l l l l. b.", words, 3) == ["l l l", "l.", "b."]
    # A word beyond the cap stands alone.
    assert chunking.pack("abcdef gh i", len, 4) == ["abcdef", "gh i"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab .;\n", max_size=80), st.integers(1, 6))
def test_pack_keeps_all_words_in_order(text, cap):
    assert " ".join(chunking.pack(text, words, cap)).split() == text.split()


def units(spark, *texts, lang="es", pages=None):
    return spark.createDataFrame([(1, lang, k, (pages or range(1, 99))[k], t) for k, t in enumerate(texts)], ingest.UNIT_SCHEMA)


def made(spark, *texts, count=words, cap=800, target=512, **more):
    return [(r["content"], r["page_from"], r["page_to"]) for r in chunking.chunks(units(spark, *texts, **more), count, Settings(chunk_token_cap=cap, chunk_token_target=target)).orderBy("chunk_index").collect()]


def test_oversized_article_repeats_its_first_line_and_has_its_own_pages(spark):
    body = "uno dos tres. cuatro cinco seis."
    out = made(spark, "Artículo 1. Título", body, "Artículo 2. Fin", cap=4)
    assert out == [("Artículo 1. Título", 1, 2), ("Artículo 1. Título\nuno dos tres.", 1, 2), ("Artículo 1. Título\ncuatro cinco seis.", 1, 2), ("Artículo 2. Fin", 3, 3)]


def test_preamble_pieces_are_placed_by_their_beginning(spark):
    # The third piece begins like the first, so the first place wins, and its page puts it before the second.
    assert made(spark, "a b", "x y z", "a b", target=3) == [("a b", 1, 1), ("a b", 1, 1), ("x y z", 2, 2)]


def test_streams_without_headers_and_headers_that_run_on(spark):
    assert made(spark, "solo texto", "más") == [("solo texto\n\nmás", 1, 2)]
    assert [c for c, *_ in made(spark, "intro", "Artículo", "5 cinco", "ARTICULO 13.2 no")] == ["intro", "Artículo\n\n5 cinco\n\nARTICULO 13.2 no"]
    assert [c for c, *_ in made(spark, "x\n  Artículo 7 a\ny\nver Artículo 8")] == ["x", "Artículo 7 a\ny\nver Artículo 8"]


def test_segments_cover_the_stream(spark):
    r = random.Random(3)
    lines = ["Artículo {}. T", "artículo {} x", "texto {}", "{}. artikulua", "Disposición final {}", "Art. {}.1 sub", "  ART {} y", ""]
    texts = [r.choice(lines).format(r.randrange(30)) + r.choice(["", "\nmás", "\n\n Artículo 3"]) for _ in range(60)]
    rows = chunking.segments(units(spark, *texts)).orderBy("segment").collect()
    assert "".join(p["text"] for row in rows for p in row["pieces"]) == "\n\n".join(texts)
    assert [x["segment"] for x in rows] == sorted({x["segment"] for x in rows})


def test_running_maximum_is_the_sequential_guard(spark):
    r = random.Random(5)
    nums = [(r.choice(["Artículo", "artículo"]), r.randrange(1, 40)) for _ in range(200)]
    last, wanted = 0, []
    for word, n in nums:
        ok = word[0] == "A" or n >= last
        wanted.append(ok)
        last = max(last, n) if ok else last
    found = chunking.anchored(chunking.lines(units(spark, *[f"{w} {n} x" for w, n in nums], pages=range(200)))).orderBy("unit_no").collect()
    assert [x["is_anchor"] for x in found] == wanted


BLOCK = "doc_id long, block_no int, page int, pw double, ph double, x0 double, x1 double, y0 double, y1 double, x_mid double, width double, text string, long_tokens int"


def block(page, no, x0, x1, y0, y1, text, doc=1):
    return (doc, no, page, 600.0, 800.0, x0, x1, y0, y1, (x0 + x1) / 2, x1 - x0, text, 0)


def test_bilingual_pages_part_and_footers_go(spark):
    basque, spanish = "hitzarmen honen eremua da langileen baldintzak " * 3, "el convenio de la empresa es para las personas que trabajan en ella " * 2
    rows = []
    for page in (1, 2, 3):
        rows += [block(page, 10 * page, 40, 280, 120, 350, basque), block(page, 10 * page + 1, 40, 280, 360, 690, basque), block(page, 10 * page + 2, 320, 560, 120, 350, spanish), block(page, 10 * page + 3, 320, 560, 360, 690, spanish)]
        rows += [block(page, 10 * page + 4, 40, 560, 750, 780, "Pie  común"), block(page, 10 * page + 5, 40, 560, 60, 80, f"BOLETÍN OFICIAL {page}")]
    rows += [block(4, 40, 40, 560, 60, 400, "cuerpo que no se repite")]
    frame = spark.createDataFrame([tuple(float(v) if isinstance(v, int) and k in (5, 6, 7, 8, 9, 10) else v for k, v in enumerate(r)) for r in rows], BLOCK)
    found, stats = layout.language_streams(frame, spark.createDataFrame([(1, 5)], "doc_id long, page_count int"))
    streams = {(r["lang"], r["unit_no"]): r["text"] for r in found.collect()}
    assert [k[0] for k in sorted(streams)].count("eu") == 6 and streams["eu", 0] == basque and streams["es", 0] == spanish and streams["es", 6].startswith("cuerpo")
    s = stats.first()
    assert (s["bilingual_pages"], s["two_column_pages"], s["single_column_pages"], s["furniture_blocks_stripped"], s["repeating_furniture_lines"]) == (3, 3, 1, 6, ["pie común"])


def test_tables_and_weak_evidence_stay_in_one_column(spark):
    rows = [block(1, k, 40.0 if k % 2 == 0 else 320.0, 280.0 if k % 2 == 0 else 560.0, 100.0 * (k // 2), 100.0 * (k // 2) + 90, "celda") for k in range(12)]
    rows += [block(2, 20, 40.0, 560.0, 100.0, 700.0, "ancho")]
    p = {r["page"]: r for r in layout.pages(spark.createDataFrame(rows, BLOCK)).collect()}
    assert p[1]["tabular"] and not p[1]["two_column"] and not p[2]["two_column"] and p[2]["has_straddle"]


def chunk_table(spark, rows):
    return spark.createDataFrame(rows, "id long, document_id long, chunk_index int, page_from int, page_to int, content string, embedding array<float>, convenio_id long, validity_start date, validity_end date, retrieval_status string, authority_level string")


def test_eligible_chunks_are_all_reached_under_nulls(spark):
    r = random.Random(2)
    pick = lambda *x: r.choice(x)
    rows = [(i, i // 4, i % 4, 1, 1, "c", [r.random(), r.random()], pick(1, 2, None), pick(date(2024, 1, 1), None), pick(date(2024, 6, 1), None), pick("active", "archived", None), pick("national_law", "official_convenio", None)) for i in range(200)]
    table = chunk_table(spark, rows)
    for convenio in (1, None):
        for law in (True, False):
            for statuses in (("active",), ("active", "archived"), ()):
                for day in (None, date(2024, 1, 1), date(2024, 6, 1), date(2025, 1, 1)):
                    def fits(x):
                        scope = (convenio is not None and x[7] == convenio) or (law and x[11] == "national_law")
                        return scope and x[10] in statuses and (day is None or ((x[8] is None or x[8] <= day) and (x[9] is None or x[9] >= day)))

                    wanted = {x[0] for x in rows if fits(x)}
                    args = dict(convenio_id=convenio, include_national_law=law, statuses=statuses, as_of=day)
                    assert table.filter(retrieval.eligible(convenio, law, statuses, day)).count() == len(wanted)
    hits = retrieval.retrieve(table, [1.0, 0.0], k=10**6, **args | {"statuses": ("active", "archived"), "convenio_id": 1, "include_national_law": True, "as_of": None}).collect()
    assert len(hits) == retrieval.count_eligible(table, 1, True, ("active", "archived")).first()["eligible"]
    assert [x["score"] for x in hits] == sorted((x["score"] for x in hits), reverse=True)


def test_filter_reaches_the_scan(spark, tmp_path):
    chunk_table(spark, [(1, 1, 0, 1, 1, "c", [1.0], 1, None, None, "active", None)]).write.parquet(str(tmp_path / "t"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = retrieval.retrieve(spark.read.parquet(str(tmp_path / "t")), [1.0], 1)._jdf.queryExecution().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "TakeOrderedAndProject" in plan and "EqualTo(retrieval_status,active)" in plan


def test_vectors(spark):
    row = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0], [1.0])], "a array<float>, b array<float>, z array<float>, s array<float>")
    a, b, z, s = (F.col(c) for c in "abzs")
    out = row.select(vectors.dot(a, b), vectors.norm(a), vectors.cosine_distance(a, b), vectors.cosine_distance(a, z), vectors.dot(a, s), vectors.normalised(a), vectors.normalised(z), vectors.text_literal(a)).first()
    assert out[0] == 24 and out[1] == 5 and abs(out[2] - 0.04) < 1e-12 and out[3] is None and out[4] is None and out[5] == [0.6, 0.8] and out[6] == [0, 0] and out[7] == "[3.00000000,4.00000000]"


def stored(spark, target):
    return sorted((r["document_id"], r["chunk_index"], r["content"]) for r in target.read().collect())


def test_replacing_documents(spark, tmp_path):
    target = store.ChunkStore(spark, f"file://{tmp_path}/chunks", buckets=4)
    scopes = spark.createDataFrame([(d, 7, None, None, date(2024, 1, 1), None, "active", "official_convenio") for d in range(6)], "document_id long, " + ", ".join(f"{c} {t}" for c, t in zip(store.SCOPE, ("long", "long", "long", "date", "date", "string", "string"), strict=True)))

    def put(documents, *texts):
        u = spark.createDataFrame([(d, "es", 0, 1, t) for d, t in texts], ingest.UNIT_SCHEMA)
        gone = spark.createDataFrame([(d, "es", 0, 1, "") for d in documents], ingest.UNIT_SCHEMA)
        ingest.ingest(u.unionByName(gone.join(u, "doc_id", "left_anti")), scopes, target)

    put([1, 2, 5], (1, "Artículo 1 a\nArtículo 2 b"), (2, "x"), (5, "y"))
    first = stored(spark, target)
    assert first == [(1, 0, "Artículo 1 a"), (1, 1, "Artículo 2 b"), (2, 0, "x"), (5, 0, "y")]
    put([1, 2, 5], (1, "Artículo 1 a\nArtículo 2 b"), (2, "x"), (5, "y"))
    assert stored(spark, target) == first
    put([1], (1, "solo"))
    assert stored(spark, target) == [(1, 0, "solo"), (2, 0, "x"), (5, 0, "y")]
    put([2])
    assert stored(spark, target) == [(1, 0, "solo"), (5, 0, "y")]
    row = target.document(5).first()
    assert row["convenio_id"] == 7 and len(row["embedding"]) == 1024 and row["created_at"] is not None


def test_chunks_and_embeddings_must_match(spark):
    c = spark.createDataFrame([(1, 0, 1, 1, "a", 1), (1, 1, 1, 1, "b", None)], "document_id long, chunk_index int, page_from int, page_to int, content string, token_count int")
    e = spark.createDataFrame([(1, 0, [1.0])], "document_id long, chunk_index int, embedding array<float>")
    scopes = spark.createDataFrame([], "document_id long, " + ", ".join(f"{x} string" for x in store.SCOPE))
    with pytest.raises(Exception, match="differ in number"):
        store.assemble(c, e, scopes).collect()
    assert store.assemble(c.filter("chunk_index = 0"), e, scopes).count() == 1


def test_streaming_ingest(spark, tmp_path):
    source = f"{tmp_path}/units"
    scopes = spark.createDataFrame([], "document_id long, " + ", ".join(f"{c} {t}" for c, t in zip(store.SCOPE, ("long", "long", "long", "date", "date", "string", "string"), strict=True)))
    target = store.ChunkStore(spark, f"file://{tmp_path}/chunks", buckets=2)
    for texts in ([(1, "uno"), (2, "dos")], [(1, "otro")]):
        spark.createDataFrame([(d, "es", 0, 1, t) for d, t in texts], ingest.UNIT_SCHEMA).write.mode("append").parquet(source)
        ingest.stream(spark, source, scopes, target, f"{tmp_path}/check").awaitTermination()
    assert stored(spark, target) == [(1, 0, "otro"), (2, 0, "dos")]


def workbook_bytes(path, sheets):
    """A minimal workbook: strings are shared, numbers are written plainly."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    shared = []

    def cell(r, c, v):
        ref = f"{chr(65 + c)}{r + 1}"
        if v is None:
            return ""
        if isinstance(v, str):
            shared.append(v)
            return f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
        return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>' if isinstance(v, bool) else f'<c r="{ref}"><v>{v}</v></c>'

    with zipfile.ZipFile(path, "w") as z:
        for k, (_, rows) in enumerate(sheets):
            body = "".join(f'<row r="{r + 1}">{"".join(cell(r, c, v) for c, v in enumerate(row))}</row>' for r, row in enumerate(rows))
            z.writestr(f"xl/worksheets/sheet{k + 1}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")
        z.writestr("xl/workbook.xml", f"<workbook {ns}><sheets>{''.join(f'<sheet name="{n}" sheetId="{k + 1}" r:id="rId{k + 1}"/>' for k, (n, _) in enumerate(sheets))}</sheets></workbook>")
        rel = "".join(f'<Relationship Id="rId{k + 1}" Target="worksheets/sheet{k + 1}.xml"/>' for k in range(len(sheets)))
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rel}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}>{''.join(f'<si><t>{s}</t></si>' for s in shared)}</sst>")


def test_workbooks(spark, tmp_path):
    workbook_bytes(tmp_path / "a.xlsx", [("smi 26", [["x"], ["Grupo", None, "total anual", "hora"], ["A", None, 14000.5, 9]]), ("notas", [["uno", True]])])
    workbook.register(spark)
    found = spark.read.format("workbook").load(str(tmp_path)).collect()
    assert [(r["sheet"], r["row_no"], r["col_no"], r["v"], r["v_type"]) for r in found if r["row_no"] == 2] == [("smi 26", 2, 0, "A", "string"), ("smi 26", 2, 1, None, None), ("smi 26", 2, 2, "14000.5", "float"), ("smi 26", 2, 3, "9", "int")]
    assert ("notas", "True", "bool") in {(r["sheet"], r["v"], r["v_type"]) for r in found}
    cells = workbook.cells_of(objects.read_objects(spark, str(tmp_path), "*.xlsx"))
    assert cells.count() == len(found)
    row = salary.rows(cells).first()
    assert (row["year"], row["job_category_name"], row["gross_annual"], row["base_salary_monthly"], row["hourly_rate"]) == (2026, "A", 14000.5, 1000.04, 9.0)


def test_each_sheet_is_a_task_and_others_stay_shut(spark, tmp_path):
    for name in ("a", "b"):
        workbook_bytes(tmp_path / f"{name}.xlsx", [("smi 26", [["Grupo", "total anual", "hora"], ["A", 14000, 9]]), ("notas", [["uno"]]), ("x", [["dos"]])])
    # A sheet that cannot be read does not matter to those that leave it out.
    with zipfile.ZipFile(tmp_path / "b.xlsx") as z:
        parts = {n: z.read(n) for n in z.namelist()}
    broken = next(n for n in parts if n.endswith("sheet2.xml"))
    with zipfile.ZipFile(tmp_path / "b.xlsx", "w") as z:
        for n, p in parts.items():
            z.writestr(n, b"<broken" if n == broken else p)
    workbook.register(spark)
    reader = workbook._PushingReader(str(tmp_path))
    assert len(reader.partitions()) == 6
    assert list(reader.pushFilters([EqualTo(("sheet",), "x"), EqualTo(("v",), "dos")])) == [EqualTo(("v",), "dos")] and len(reader.partitions()) == 2
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = lambda: spark.read.format("workbook").option("pushdown", "true").load(str(tmp_path))
        assert read().filter("sheet in ('smi 26', 'x')").count() == 14
        assert read().filter("sheet = 'x' and v = 'dos'").count() == 2 and read().filter("sheet = 'none'").count() == 0
        with pytest.raises(Exception, match="not well-formed|unclosed token"):
            read().filter("sheet = 'notas'").count()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_a_large_sheet_is_read_row_by_row(tmp_path):
    import tracemalloc

    workbook_bytes(tmp_path / "a.xlsx", [("s", [[k, k + 0.5, True] for k in range(40_000)])])
    tracemalloc.start()
    with open(tmp_path / "a.xlsx", "rb") as f:
        assert sum(1 for _ in workbook.Workbook(f).cells(0)) == 120_000
    assert tracemalloc.get_traced_memory()[1] < 5e6  # the sheet alone is 4 MB of XML, and some 40 MB as a tree
    tracemalloc.stop()


def test_salary_tables_from_bytes(spark, tmp_path):
    workbook_bytes(tmp_path / "a.xlsx", [("smi 26", [["x"], ["Grupo", None, "total anual", "hora"], ["A", None, 14000.5, 9]]), ("notas", [["uno", True], ["dos", 1]])])
    rows, said = workbook.salary_tables(objects.read_objects(spark, str(tmp_path), "*.xlsx"))
    assert [(r["sheet"], r["job_category_name"], r["gross_annual"]) for r in rows.collect()] == [("smi 26", "A", 14000.5)] and rows.first()["path"].endswith("a.xlsx")
    assert {r["sheet"]: r["warning"] for r in said.collect()} == {"smi 26": "sheet 'smi 26': header on row 1, 1 category rows, year 2026", "notas": "sheet 'notas' skipped (no salary-grid header found)"}


def test_salary_grids_written_out(spark):
    cells = spark.createDataFrame(written.CELLS, written.CELL_SCHEMA)
    rows = {(r["sheet"], r["row_no"]): r for r in salary.rows(cells).collect()}
    assert rows.keys() == {("smi 26", 2), ("smi 26", 4), ("Tablas 2025", 2), ("Tablas 2025", 3)}
    assert rows["smi 26", 2]["raw_values"] == {"1742": "9,75", "sb": "1.000,50", "total": "1652.135"}
    assert rows["Tablas 2025", 2]["raw_values"] == {"bruto ano": "15000", "bruto anual": "14.000,00", "hora nocturna": "abc", "plus nocturno": "1.652", "x": "7"}
    first = rows["smi 26", 2]
    assert (first["year"], first["group_code"], first["job_category_name"], first["gross_annual"], first["hourly_rate"]) == (2026, "2.1", "Monitor de tiempo libre", 1652.14, 9.75)
    heads = {r["sheet"]: (r["width"], r["header_row"]) for r in salary.headers(cells).collect()}
    assert heads == {"smi 26": (5, 1), "Tablas 2025": (6, 1), "junk": (2, None), "one": (1, None)}


def test_anchors_written_out(spark):
    units = spark.createDataFrame(written.UNITS, written.UNIT_SCHEMA)
    assert {(r["lang"], r["unit_no"]) for r in chunking.anchored(chunking.lines(units)).filter("is_anchor").collect()} == written.ANCHORED
    assert [r["content"] for r in chunking.chunks(units).filter("doc_id = 1 and language = 'eu'").orderBy("chunk_index").collect()] == ["1. artikulua Eremua", "12 ARTIKULUA\n\ntestua 3. artikulua"]


def test_glyphs_written_out(spark):
    found = {(r["doc_id"], r["block_no"], r["line_no"]): (r["text"], r["long_tokens"]) for r in layout.lines(spark.createDataFrame(written.GLYPHS, written.GLYPH_SCHEMA)).collect()}
    assert found == {(1, 0, 0): ("hit za-", 0), (1, 0, 1): ("mena puz", 0), (1, 1, 0): ("X", 0), (1, 2, 0): ("ab c", 0), (2, 0, 0): ("x" * 30, 1)}


def test_answers_written_out(spark):
    out = {r["turn_id"]: r for r in answers.synthesis(spark.createDataFrame(written.ANSWERS, f"turn_id int, question string, raw_text string, {written.SOURCE_SCHEMA}")).collect()}
    assert {t: (r["answer"], [c["chunk_id"] for c in r["citations"]], r["confidence"], r["parse_error"], r["grounded"]) for t, r in out.items()} == {
        1: ("A [Fuente 1], B [Fuente 2].", [12, 11], 0.9, False, True),
        2: ("C [Fuente 1] y [Fuente 1] y; D", [11], 0.5, False, True),
        3: ("", [], 0.0, True, False),
        4: ("", [], 0.0, False, False),
        5: ("E", [], 0.0, False, False),
    }


def test_numbers_and_years_written_out(spark):
    one = lambda f, cases: {r["v"]: r["x"] for r in spark.createDataFrame([(k,) for k in cases], "v string").select("v", f(F.col("v")).alias("x")).collect()}
    assert one(T.to_number, written.NUMBERS) == written.NUMBERS and one(T.year_in, written.YEARS) == written.YEARS


def pieces_one_by_one(parts, joint, count, cap, too_big):
    """The fold that packing stands for: a part at a time, the whole counted at each step."""
    done, waiting = [], ""
    for part in parts:
        both = f"{waiting}{joint}{part}".strip() if waiting else part.strip()
        if count(both) <= cap:
            waiting = both
            continue
        had = bool(waiting)
        done += [waiting] if had else []
        more, waiting = too_big(part, had)
        done += more
    return done, waiting


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .;\né", max_size=120), st.integers(1, 9), st.sampled_from([words, len, lambda t: 3 * len(t.split()) + len(t) // 4]))
def test_galloping_packs_as_the_fold_does(text, cap, count):
    galloping, chunking._grown = chunking._grown, pieces_one_by_one
    try:
        wanted = chunking.pack(text, count, cap)
    finally:
        chunking._grown = galloping
    assert chunking.pack(text, count, cap) == wanted


def test_packing_counts_a_bounded_number_of_times():
    for n in (500, 4000):
        seen = []
        count = lambda t: seen.append(len(t)) or len(t.split())  # noqa: B023, E731
        chunking.pack(" ".join(["word"] * n) + ".", count, 50)
        assert sum(seen) < 12 * 5 * n


def test_subword_counters(spark):
    path = "/opt/tokenizers/byte_bpe_50k.json"
    count, texts = tokens.Subwords(path), ["hola mundo", "", "ñandú 12", None]
    assert count.many(texts[:3]) == [count(t) for t in texts[:3]] and count("") == 0
    assert [r["n"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(tokens.column(count)(F.col("t")).alias("n")).collect()] == [*count.many(texts[:3]), 0]
    assert tokens.Subwords("/opt/tokenizers/piece_bpe_32k.model")("hola mundo") > 1
    units = spark.createDataFrame([(1, "es", k, 1, "Artículo " + str(k) + ". " + "palabra larga " * 400) for k in range(1, 4)], "doc_id long, lang string, unit_no int, page int, text string")
    made = chunking.chunks(units, count).collect()
    assert all(r["token_count"] == count(r["content"]) for r in made) and len(made) > 3
    lengths = {r["segment"]: r["tokens"] for r in chunking.article_lengths(units, tokens.column(count)).collect()}
    assert len(lengths) == 3 and min(lengths.values()) > 800


@pytest.mark.parametrize("few,accuracy", [(1, 4), (3, 10), (1000, 100)])
def test_quantiles_of_any_column(spark, few, accuracy):
    r = random.Random(few)
    for n in (0, 1, 7, 300):
        values = [r.choice([None, r.random() ** 9 * 1e6, float(r.randrange(3)), 5.0]) for _ in range(n)]
        places, known = [0, 0.1, 0.5, 0.99, 1.0], sorted(v for v in values if v is not None)
        got = analytics.quantiles(spark.createDataFrame([(v,) for v in values], "x double"), "x", places, few, accuracy)
        assert got == (len(known), [known[int(len(known) * p)] if int(len(known) * p) < len(known) else None for p in places])


def test_a_report_counts_chunks_without_tokens(spark):
    rows = spark.createDataFrame([("a", 3), ("a", None), (None, 5)], "lang string, token_count int")
    found = {(r["level"], r["lang"]): (r["chunks"], r["tokens"], r["median"], r["max"]) for r in analytics.report(rows, [[], ["lang"]]).collect()}
    assert found == {("all", None): (3, 8, 5, 5), ("lang", "a"): (2, 3, 3, 3), ("lang", None): (1, 5, 5, 5)}


def test_every_code_point_is_decomposed(spark):
    import unicodedata

    chars = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    # Some in a row, so that marks and others meet; every character once.
    texts = ["".join(chars[k : k + 40]) for k in range(0, len(chars), 40)] + ["Convenío ﬁnal ½ 각 é́x", "", None]
    found = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", without_marks(F.col("t")).alias("t")).collect()
    bare = lambda t: t and "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    assert {r["i"]: r["t"] for r in found} == {i: bare(t) for i, t in enumerate(texts)}


def test_labels(spark):
    cases = {" Año.  de\nAntigüedad: ": "ano. de antiguedad", "COMP.": "comp", "café": "cafe", "·x·": "x", "Ｔｏｔａｌ": "total", "Ǆ ½": "dz 1⁄2", None: ""}
    frame = spark.createDataFrame([(k,) for k in cases], "v string").select("v", T.label(F.col("v")).alias("l"))
    assert {r["v"]: r["l"] for r in frame.collect()} == cases


def test_renumbered_answers_name_only_displayed_sources(spark):
    r = random.Random(9)
    sources = [(k % 3, k, None, None, f"t{k}", 0.1 * k, None, False) for k in range(4)]
    rows = [(t, "q", '{"answer": "' + " ".join(f"x [Fuente {r.randrange(6)}]" for _ in range(5)) + f'", "cited_sources": {[r.randrange(6) for _ in range(3)]}' + "}", sources) for t in range(50)]
    out = answers.synthesis(spark.createDataFrame(rows, f"turn_id long, question string, raw_text string, {written.SOURCE_SCHEMA}")).collect()
    import re

    assert all({int(n) for n in re.findall(r"\[Fuente (\d+)\]", x["answer"])} <= set(range(1, x["citation_count"] + 1)) for x in out)
    assert all(len({c["chunk_id"] for c in x["citations"]}) == x["citation_count"] for x in out)


class Failing(providers.StubProvider):
    def classify(self, prompt, api_key, max_tokens):
        raise RuntimeError("down")

    def ground(self, prompt, api_key, max_tokens):
        return ("{", "max_tokens") if max_tokens == 4096 else ('{"claims": []}', "end_turn")


class Pages(providers.PageParser):
    def pages(self, content):
        for k, t in enumerate(content.decode().split("|"), 1):
            yield {"page_number": k, "text": t, "image": b"x", "boxes": [{"block_no": 0, "pw": 1.0, "ph": 1.0, "x0": 0.0, "x1": 1.0, "y0": 0.0, "y1": 1.0}], "glyphs": [{"block_no": 0, "line_no": 0, "glyph_no": i, "c": c, "x0": float(i), "x1": i + 1.0} for i, c in enumerate(t)]}


def test_providers(spark, tmp_path):
    prompts = spark.createDataFrame([(1, "a [Fuente 1]"), (2, "b")], "turn_id long, prompt string")
    assert {r["turn_id"]: r["error"] for r in providers.asked(prompts, "classify", "k", Failing).collect()} == {1: "provider_error", 2: "provider_error"}
    assert {r["stop_reason"] for r in providers.asked(prompts, "ground", "k", Failing).collect()} == {"end_turn"}
    assert answers.route(providers.asked(prompts, "classify", "k")).filter("label = 'prose'").count() == 2
    v = providers.embedded(spark.createDataFrame([("hola mundo",), (None,), ("hola mundo",)], "content string")).collect()
    assert abs(np.linalg.norm(v[0]["embedding"]) - 1) < 1e-6 and v[0]["embedding"] == v[2]["embedding"]
    assert objects.write_objects(spark.createDataFrame([("d/a.txt", b"uno|"), ("b.txt", b"dos")], "key string, content binary"), f"file://{tmp_path}/o") == 2
    files = objects.read_objects(spark, f"{tmp_path}/o/d")
    assert [(r["page_number"], r["text"], bytes(r["image"])) for r in providers.parsed_pages(files, Pages).orderBy("page_number").collect()] == [(1, "uno", b"x"), (2, "", b"x")]
    g = providers.parsed_layout(files, Pages).filter("page = 1").select(F.lit(1).alias("doc_id"), "page", F.explode("glyphs").alias("g")).select("doc_id", "page", "g.*")
    assert layout.block_texts(g).first()["text"] == "uno"
    assert objects.is_alive(spark) and objects.as_json(prompts).count() == 2


def test_chunks_hold_whole_documents(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = reference.chunks(spark, sf_dir).select("id", "document_id", "chunk_index", "content").collect()
    assert all(r["content"] == texts.get(r["id"]) for r in found) and max(len(r["content"] or "") for r in found) > 200
    content = {(r["document_id"], r["chunk_index"]): r["content"] for r in found}
    made = reference.insert_with_scope(spark, sf_dir).collect()
    assert len(made) == len(found)
    assert all(r["content"] == content[r["document_id"], r["chunk_index"]] and r["token_count"] == len(r["content"] or "") for r in made)
    hits = reference.retrieve_topk(spark, sf_dir).collect()
    assert hits and all(r["content"] == texts.get(r["id"]) for r in hits)


def test_renumber_markers_keeps_every_row(spark, tmp_path):
    texts = ["# Uno", "a [Fuente 3], b [Fuente 2] y [Fuente 7] .", "#1 [Fuente 1]x[Fuente  2]", "[Fuente x] # [Fuente #1]", "sin", "", None]
    spark.createDataFrame([(1, n, t) for n, t in enumerate(texts)], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")

    def brute(turn, text):
        out = re.sub(r"\[Fuente\s+(\d+)\]", lambda m: {"2": "[Fuente 1]", "3": "[Fuente 2]"}.get(m[1], ""), f"{text} [Fuente {turn % 4 + 1}] fin [Fuente 9] .")
        return re.sub(r"\s+([.,;:])", r"\1", re.sub(r"\s{2,}", " ", out)).strip()

    found = {r["turn"]: r["answer"] for r in reference.renumber_markers(spark, str(tmp_path)).collect()}
    assert found == {n: None if t is None else brute(n, t) for n, t in enumerate(texts)}


def test_artifacts_over_the_whole_preview(spark, sf_dir):
    rows = reference.text_previews(spark, sf_dir).collect()
    assert any(len(r["lead"]) == 120 for r in rows)
    assert all(r["broken"] == "".join(c + (" " if i % 3 == 2 and c != " " else "") for i, c in enumerate(r["lead"])) for r in rows)


def test_band_semi_join_keeps_repeated_rows(spark):
    left = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 11.0), (2, 5.0), (1, None), (None, 5.0)], "k int, v double")
    right = spark.createDataFrame([(1, 5.5), (1, 4.0), (2, 11.1), (None, 5.0)], "k int, v double")
    found = layout.band_semi_join(left, right, ["k"], "v", 6.0)
    assert sorted((r["k"], r["v"]) for r in found.collect()) == [(1, 5.0), (1, 5.0), (1, 11.0)]
    assert "LeftSemi" in found._jdf.queryExecution().optimizedPlan().toString()


def test_look_ahead_is_a_running_window(spark):
    plan = chunking.anchored(chunking.lines(units(spark, "a")))._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedfollowing" not in plan.lower()


def test_store_replaces_all_at_once(spark, tmp_path):
    target = store.ChunkStore(spark, f"file://{tmp_path}/chunks")
    rows = lambda *ids: spark.createDataFrame([(d, c, 1, 1, f"{d}-{c}", 1, [0.5], *[None] * 7) for d, c in ids], store.SCHEMA)
    named = lambda *ids: spark.createDataFrame([(d,) for d in ids], "document_id long")
    assert target.read().count() == 0 and target.buckets is None
    target.replace(named(1, 2, 66), rows((1, 0), (1, 1), (2, 0), (66, 0)))
    assert target.buckets == 64
    before = target.read()
    real = store.ChunkStore._publish
    try:  # a writer that ends before its list is there leaves no trace in what is read
        store.ChunkStore._publish = lambda self, *a: 1 / 0
        with pytest.raises(ZeroDivisionError):
            target.replace(named(2), rows((2, 7)))
    finally:
        store.ChunkStore._publish = real
    kept = lambda frame: sorted((r["document_id"], r["chunk_index"]) for r in frame.collect())
    assert kept(target.read()) == [(1, 0), (1, 1), (2, 0), (66, 0)]
    taken = []
    try:  # another writer takes the next number first
        def late(self, number, buckets, versions):
            if not taken:
                taken.append(number)
                real(self, number, buckets, {**self._listed()[2]})
            return real(self, number, buckets, versions)

        store.ChunkStore._publish = late
        target.replace(named(2), rows((2, 9)))
    finally:
        store.ChunkStore._publish = real
    assert kept(target.read()) == [(1, 0), (1, 1), (2, 9), (66, 0)]
    assert kept(target.document(66)) == [(66, 0)] and kept(before) == [(1, 0), (1, 1), (2, 0), (66, 0)]
    target.vacuum()
    assert kept(target.read()) == [(1, 0), (1, 1), (2, 9), (66, 0)]


def test_nearest_in_blocks(spark, monkeypatch):
    e = spark.createDataFrame([(k, [float(k % 7), 1.0, float(k % 3)]) for k in range(40)], "id long, embedding array<float>")
    whole = retrieval.nearest(e, e).collect()
    monkeypatch.setattr(retrieval, "BLOCK_REQUESTS", 9)
    assert sorted(retrieval.nearest(e, e).collect()) == sorted(whole) and len(whole) == 40


def test_text_in_hits_out(spark):
    texts = ["vacaciones anuales", "jornada de trabajo", "salario base mensual", "permiso retribuido"]
    rows = [(k, 1, k, 1, 1, t, providers.embed_query(t), "active" if k < 3 else "archived", None, 7, None, None) for k, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "id long, document_id long, chunk_index int, page_from int, page_to int, content string, embedding array<float>, retrieval_status string, authority_level string, convenio_id long, validity_start date, validity_end date")
    found = retrieval.answerable(chunks, "el salario base", providers.embed_query, convenio_id=7, k=2).orderBy("rank").collect()
    assert [(r["rank"], r["eligible_total"]) for r in found] == [(1, 3), (2, 3)] and found[0]["content"] == texts[2] and found[0]["score"] > found[1]["score"]
    (none,) = retrieval.answerable(chunks, "x", providers.embed_query, convenio_id=8).collect()
    assert none["eligible_total"] == 0 and none["id"] is None


class Bulletin(providers.PageParser):
    """Each line of the bytes is a block of its own; a form feed begins a page."""

    def pages(self, content):
        for k, page in enumerate(content.decode().split("\f")):
            lines = page.split("\n")
            boxes = [dict(block_no=n, pw=600.0, ph=800.0, x0=40.0, x1=560.0, y0=200.0 + 20 * n, y1=215.0 + 20 * n) for n in range(len(lines))]
            glyphs = [dict(block_no=n, line_no=0, glyph_no=g, c=c, x0=5.0 * g, x1=5.0 * g + 5) for n, line in enumerate(lines) for g, c in enumerate(line)]
            # White space is found again from the gaps between glyphs.
            yield {"page_number": k + 1, "text": page, "image": None, "boxes": boxes, "glyphs": glyphs}


def test_ingest_from_parser_to_store(spark, tmp_path):
    target = store.ChunkStore(spark, f"file://{tmp_path}/chunks", buckets=4)
    scopes = spark.createDataFrame([(1, 7, None, None, None, None, "active", "official_convenio")], "document_id long, " + ", ".join(f"{c} {t}" for c, t in zip(store.SCOPE, ("long", "long", "long", "date", "date", "string", "string"), strict=True)))

    def put(*rows):
        objects = spark.createDataFrame([(d, f"/{d}.pdf", bytearray(t.encode())) for d, t in rows], "doc_id long, path string, content binary")
        return {r["doc_id"]: r for r in ingest.ingest_documents(objects, scopes, target, Bulletin).collect()}

    out = put((1, "Artículo 1. Objeto\ntexto uno\fArtículo 2. Fin"), (2, "solo texto"))
    assert stored(spark, target) == [(1, 0, "Artículo 1. Objeto\n\ntexto uno"), (1, 1, "Artículo 2. Fin"), (2, 0, "solo texto")]
    assert (out[1]["chunks_written"], out[1]["chunks_es"], out[1]["chunks_eu"], out[1]["page_count"], out[1]["blocks_total"]) == (2, 2, 0, 2, 3)
    row = target.document(1).orderBy("chunk_index").first()
    assert row["convenio_id"] == 7 and len(row["embedding"]) == 1024 and target.document(2).first()["convenio_id"] is None
    out = put((1, ""))
    assert stored(spark, target) == [(2, 0, "solo texto")] and out[1]["chunks_written"] == 0


def test_pages_are_parsed_in_small_batches_and_glyphs_stay_in_place(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(providers, "ship", lambda _: None)
    out = []

    class Frames:
        """A table whose one Arrow batch holds all rows."""

        sparkSession = spark
        schema = "path string, content binary"

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            out.extend(run(iter([pa.RecordBatch.from_pydict({"path": [str(k) for k in range(400)], "content": [b"abc def\n" * 100] * 400})])))

    providers.parsed_layout(Frames(), Bulletin)
    assert sum(b.num_rows for b in out) == 400 and max(b.num_rows for b in out) < 100
    objects_ = spark.createDataFrame([(1, "a", bytearray("uno dos\ntres\f\fcuatro".encode())), (2, "b", bytearray(b"uno"))], "doc_id long, path string, content binary")
    blocks, counts = ingest.pages_of(objects_, Bulletin)
    assert sorted((r["doc_id"], r["page"], r["block_no"], r["text"]) for r in blocks.collect()) == [(1, 1, 0, "uno dos"), (1, 1, 1, "tres"), (1, 3, 0, "cuatro"), (2, 1, 0, "uno")]
    assert {r["doc_id"]: r["page_count"] for r in counts.collect()} == {1: 3, 2: 1}
    # Glyphs out of order, of two lines and without a block; blocks are files by now.
    g = [(0, 1, 1, "d", 5.0, 10.0), (0, 0, 1, "b", 5.0, 10.0), (None, 0, 0, "x", 0.0, 5.0), (0, 0, 0, "a", 0.0, 5.0), (0, 1, 0, "c", 0.0, 5.0), (1, 0, 0, "e", 0.0, 5.0)]
    page = spark.createDataFrame([(1, 1, g), (2, 1, []), (3, 1, None)], "doc_id long, page int, glyphs array<struct<block_no:int,line_no:int,glyph_no:int,c:string,x0:double,x1:double>>")
    cut = layout.page_lines(page)
    rows = page.select("doc_id", "page", F.explode("glyphs").alias("g")).select("doc_id", "page", "g.*")
    both = [sorted(map(str, x.collect())) for x in (layout.despaced(cut), layout.lines(rows))]
    assert both[0] == both[1] and len(both[0]) == 4
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in (layout.despaced(cut), blocks)]
    assert not any("Exchange" in p for p in plans)


class CountingParser(Bulletin):
    """Leaves a file for each call."""

    calls = None

    def pages(self, content):
        import uuid
        from pathlib import Path

        Path(self.calls, uuid.uuid4().hex).write_bytes(content)
        yield from super().pages(content)


class CountingEmbedder(providers.StubEmbedder):
    calls = None

    def embed(self, texts):
        import uuid
        from pathlib import Path

        Path(self.calls, uuid.uuid4().hex).write_text("\0".join(texts))
        return super().embed(texts)


def test_objects_are_parsed_and_chunks_embedded_once(spark, tmp_path):
    import functools

    seen, asked = tmp_path / "seen", tmp_path / "asked"
    seen.mkdir(), asked.mkdir()
    parser, model = functools.partial(counting, CountingParser, str(seen)), functools.partial(counting, CountingEmbedder, str(asked))
    target = store.ChunkStore(spark, f"file://{tmp_path}/chunks")
    scopes = spark.createDataFrame([], "document_id long, " + ", ".join(f"{c} {t}" for c, t in zip(store.SCOPE, ("long", "long", "long", "date", "date", "string", "string"), strict=True)))

    def put(*rows):
        objects = spark.createDataFrame([(d, f"/{d}.pdf", bytearray(t.encode())) for d, t in rows], "doc_id long, path string, content binary")
        return {r["doc_id"]: r["chunks_written"] for r in ingest.ingest_documents(objects, scopes, target, parser, model, pages=f"file://{tmp_path}/pages").collect()}

    assert put((1, "Artículo 1. Uno\nArtículo 2. Dos"), (2, "texto"), (3, "texto")) == {1: 2, 2: 1, 3: 1}
    assert sorted(p.read_bytes() for p in seen.iterdir()) == [b"Art\xc3\xadculo 1. Uno\nArt\xc3\xadculo 2. Dos", b"texto"]
    assert sorted(t for p in asked.iterdir() for t in p.read_text().split("\0")) == ["Artículo 1. Uno", "Artículo 2. Dos", "texto", "texto"]
    # The same bytes again, under another id too, and one new object.
    assert put((1, "Artículo 1. Uno\nArtículo 2. Dos"), (9, "texto"), (4, "nuevo")) == {1: 2, 9: 1, 4: 1}
    assert len(list(seen.iterdir())) == 3
    assert [r[:2] for r in stored(spark, target)] == [(1, 0), (1, 1), (2, 0), (3, 0), (4, 0), (9, 0)]


def counting(kind, calls):
    made = kind()
    made.calls = calls
    return made


class Scripted(providers.AnswerProvider):
    """Splits questions at '/', fails on some, cites the last source first, and leaves a file for each call."""

    calls = None

    def _seen(self, name):
        import uuid
        from pathlib import Path

        Path(self.calls, f"{name}-{uuid.uuid4().hex}").touch()

    def classify(self, prompt, api_key, max_tokens):
        self._seen("classify")
        if "fails" in prompt:
            raise RuntimeError(api_key)
        return '{"label": "%s", "confidence": 1, "subqueries": %s}' % ("salary" if "sueldo" in prompt else "prose", str(prompt.split("/")).replace("'", '"') if "/" in prompt else "[]")

    def synthesise(self, prompt, api_key, max_tokens):
        self._seen("synthesise")
        n = len(re.findall(r"\[Fuente \d+\]", prompt))
        return '{"answer": "x [Fuente %d], y [Fuente 1].", "cited_sources": [%d, 1], "confidence": 0.5}' % (n, n) if "mudo" not in prompt else "nada"

    def ground(self, prompt, api_key, max_tokens):
        self._seen("ground")
        return '{"claims": [{"claim": "x", "tipo": "sustantiva", "grounded": %s}]}' % ("false" if "duda" in prompt else "true"), "end_turn"


def test_questions_to_checked_answers(spark, tmp_path):
    import functools

    texts = ["vacaciones anuales", "jornada de trabajo", "salario base", "permiso retribuido"]
    rows = [(k, 1, k, 1, 1, t, providers.embed_query(t), "active", None, 7, None, None) for k, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "id long, document_id long, chunk_index int, page_from int, page_to int, content string, embedding array<float>, retrieval_status string, authority_level string, convenio_id long, validity_start date, validity_end date")
    asked = {1: "vacaciones anuales/jornada de trabajo", 2: "el sueldo", 3: "fails permiso retribuido", 4: "mudo", 5: "duda sobre salario base", 6: "nadie"}
    questions = spark.createDataFrame([(t, q, 7 if t != 6 else 8, False, ["active"], None, 2) for t, q in asked.items()], "turn_id long, question string, convenio_id long, include_national_law boolean, statuses array<string>, as_of_date date, k int")
    out = {r["turn_id"]: r for r in answering.answered(questions, chunks, "k", functools.partial(counting, Scripted, str(tmp_path))).collect()}
    assert {t: (r["label"], r["reason"], r["n_sources"], r["answer"], r["grounded"], r["outcome"], r["claims_grounded"]) for t, r in out.items()} == {
        1: ("prose", "llm", 2, "x [Fuente 1], y [Fuente 2].", True, "checked", True),
        2: ("salary", "llm", None, None, None, None, None),
        3: ("prose", "router_parse_error", 2, "x [Fuente 1], y [Fuente 2].", True, "checked", True),
        4: ("prose", "llm", 2, "", False, None, None),
        5: ("prose", "llm", 2, "x [Fuente 1], y [Fuente 2].", True, "checked", False),
        6: ("prose", "llm", None, None, None, None, None),
    }
    # Each sub-query brings its own best chunk; the last source is cited first.
    assert sorted(c["chunk_id"] for c in out[1]["citations"]) == [0, 1] and out[5]["ungrounded"] == ["x"]
    calls = [p.name.partition("-")[0] for p in tmp_path.iterdir()]
    assert {c: calls.count(c) for c in set(calls)} == {"classify": 6, "synthesise": 4, "ground": 3}


def test_settings_of_a_store(spark):
    objects.use_store(spark, "http://localhost:9000", fs__s3a__connection__maximum="64")
    conf = spark._jsc.hadoopConfiguration()
    assert [conf.get(k) for k in ("fs.s3a.path.style.access", "fs.s3a.endpoint", "fs.s3a.connection.maximum")] == ["true", "http://localhost:9000", "64"]


def test_prompts_close_as_they_should(spark):
    row = spark.sql("select array(named_struct('page_from', 1, 'page_to', 2, 'authority_level', 'national_law', 'content', 'c', 'is_tabular', true)) as s")
    a, b = row.select(answers.user_prompt(F.lit("q"), F.col("s")), answers.ground_prompt(F.lit("q"), F.lit("r"), F.col("s"))).first()
    assert a.endswith("p. 1–2): c\n\n" + answers.CLOSING) and b.endswith("[TABLA/COLUMNAS]: c\n\n" + answers.GROUND_CLOSING)


def test_salary_grids_read_cells_twice_and_headers_once(spark):
    cells = spark.createDataFrame([(1, 0, "Tablas 2024", r, c, v, "string") for r, row in enumerate([["Grupo", "Bruto año", "Pagas extra"], ["A", "1.200,50", "10"]]) for c, v in enumerate(row)], written.CELL_SCHEMA).repartition(7)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(salary.headers(cells)).count("LogicalRDD") == 1
    assert plan(salary.rows(cells)).count("LogicalRDD") <= 2
    row = salary.rows(cells).first()
    assert (row["gross_annual"], row["extra_pay"], row["job_category_name"]) == (1200.5, 10.0, "A")


def _page_of(spark, left, right):
    rows = [(1, n, 1, 600.0, 800.0, x0, x0 + 240.0, y0, y0 + 250.0, x0 + 120.0, 240.0, "x" * size, 0) for n, (x0, y0, size) in enumerate([(40.0, 20.0, left[0]), (40.0, 400.0, left[1]), (320.0, 100.0, right[0]), (320.0, 480.0, right[1])])]
    blocks = spark.createDataFrame(rows, "doc_id long, block_no int, page int, pw double, ph double, x0 double, x1 double, y0 double, y1 double, x_mid double, width double, text string, long_tokens int")
    return blocks, layout.pages(blocks).first()


def test_two_columns_at_the_exact_share(spark):
    assert 0.55 * 100 > 55  # as doubles
    _, page = _page_of(spark, (50, 50), (25, 30))
    assert page["two_column"]
    assert not _page_of(spark, (50, 50), (25, 29))[1]["two_column"]


def test_streams_and_statistics_at_the_exact_share(spark):
    blocks, _ = _page_of(spark, (50, 50), (25, 30))
    units, stats = layout.language_streams(blocks.withColumn("y0", F.col("y0") + 100).withColumn("y1", F.col("y1") - 50), spark.createDataFrame([(1, 2)], "doc_id long, page_count int"))
    assert stats.first()["two_column_pages"] == 1
    assert [len(r["text"]) for r in units.orderBy("unit_no").collect()] == [50, 50, 25, 30]


def test_vector_literal_rounds_ties_as_printf(spark):
    values = [53 / 512, 55 / 512, -53 / 512, 1e-12, -1e-12, 0.0, 3.5, 123456.789]
    rows = spark.createDataFrame([(values,)], "v array<float>")
    floats = [float(np.float32(x)) for x in values]
    assert rows.select(vectors.text_literal(F.col("v"))).first()[0] == "[" + ",".join("%.8f" % x for x in floats) + "]"


def test_rounding_keeps_the_sign_of_zero(spark):
    rows = spark.createDataFrame([(x,) for x in (-3e-7, 3e-7, -5e-7, 0.5, None)], "x double")
    assert [repr(r[0]) for r in rows.select(vectors.rounded(F.col("x"), 6)).collect()] == ["-0.0", "0.0", "-1e-06", "0.5", "None"]


def test_upper_case_as_in_duckdb(spark):
    import duckdb

    texts = ["straße", "", None, "ño", *T.SIMPLE_UPPER]
    ours = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(T.upper(F.col("t"))).collect()]
    assert ours == [duckdb.execute("SELECT upper(?::VARCHAR)", [t]).fetchone()[0] for t in texts]


def test_nearest_by_products_is_exact(spark):
    random_ = np.random.default_rng(3)
    v = random_.normal(size=(60, 8)).astype(np.float32)
    v[20:30] = v[5]  # copies: the smallest id that may match wins
    rows = [(k, v[k].tolist() if k != 59 else None, k % 3 if k != 58 else None) for k in range(60)]
    e = spark.createDataFrame(rows, "id long, embedding array<float>, label int").repartition(4)
    dot = lambda a, b: sum(float(x) * float(y) for x, y in zip(v[a], v[b], strict=True))
    for other in (None, "label"):
        fit = lambda a, b: a != b and (other is None or (b != 58 and a % 3 != b % 3))  # noqa: B023, E731
        wanted = {a: max((b for b in range(59) if fit(a, b)), key=lambda b: (dot(a, b), -b)) for a in range(58)}  # noqa: B023
        found = retrieval.nearest(e.filter("id < 58"), e, other=other)
        assert {r["id"]: r["near_id"] for r in found.collect()} == wanted
        assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_segments_are_unpacked_one_at_a_time(spark, monkeypatch):
    units = spark.createDataFrame([(d, "es", n, 1, f"linea {n}") for d in range(70) for n in range(3)], "doc_id long, lang string, unit_no int, page int, text string").coalesce(1)
    monkeypatch.setattr(chunking, "SEGMENTS", 8)
    found = chunking.chunks(units).collect()
    assert sorted(r["doc_id"] for r in found) == list(range(70)) and {r["content"] for r in found} == {"linea 0\n\nlinea 1\n\nlinea 2"}


def test_lines_whose_glyphs_are_together_need_no_shuffle(spark, sf_dir):
    rows = reference.line_glyphs(spark, sf_dir)
    found = layout.despaced(rows)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    apart = rows.select(*layout.LINE, F.explode("g").alias("x")).select(*layout.LINE, "x.*")
    assert sorted(found.collect()) == sorted(layout.lines(apart.repartition(3)).collect())


def test_nearest_other_label_asks_for_every_row(spark, sf_dir):
    found = reference.nearest_other_label(spark, sf_dir)
    assert {r["id"] for r in found.collect()} == {r["vec_id"] for r in reference.table(spark, sf_dir, "embeddings").select("vec_id").collect()}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("asks", [{"other": "label"}, {"same_row": True}, {}])
def test_nearest_of_odd_vectors_as_in_duckdb(spark, monkeypatch, tmp_path, asks):
    import duckdb

    random_ = np.random.default_rng(7)
    rows = [[k, x, k % 3] for k, x in enumerate(random_.integers(-2, 3, size=(90, 3)).astype(float).tolist())]
    for k, x in ((4, None), (40, None), (5, [0.0, -0.0, 0.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 0.0, -1.0]), (8, [float("-inf"), 1.0, 2.0]), (9, [3e38, 3e38, -3e38])):
        rows[k][1] = x
    rows[10][2], rows[11][2], rows[12][0], rows[14][0], rows[15][0] = None, None, None, 13, 13
    schema = "id long, embedding array<float>, label int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/e")
    e = spark.read.schema(schema).parquet(f"{tmp_path}/e")
    on = {"other": "a.id <> b.id AND a.label <> b.label", "same_row": "true"}.get(next(iter(asks), None), "a.id <> b.id")
    wanted = duckdb.connect().execute(f"""WITH e AS (FROM '{tmp_path}/e/*.parquet'), p AS (SELECT a.id, b.id AS near_id, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM e a JOIN e b ON {on})
        SELECT id, near_id, s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, near_id) AS n FROM p) WHERE n = 1""").fetchall()
    for most in (10_000, 17):
        monkeypatch.setattr(retrieval, "BLOCK_REQUESTS", most)
        assert sorted(map(repr, map(tuple, retrieval.nearest(e, e, **asks).collect()))) == sorted(map(repr, wanted))


def test_self_nn_accuracy_asks_for_every_row(spark, sf_dir):
    (found,) = reference.self_nn_accuracy(spark, sf_dir).collect()
    assert found["n"] == reference.table(spark, sf_dir, "embeddings").count() and found["hits"] <= found["n"]


def test_nearest_of_vectors_too_long_for_their_squares(spark):
    e = spark.createDataFrame([(0, [1e200, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0])], "id long, embedding array<double>")
    assert {r["id"]: r["near_id"] for r in retrieval.nearest(e, e).collect()} == {0: 1, 1: 0, 2: 1}
