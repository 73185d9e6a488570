"""Decoding of files, and the engine from questions to answers."""

from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from marginalia.engine import Engine

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def p(text, style=""):
    return f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>'


def row(*cells):
    return "<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in cells) + "</w:tr>"


def test_docx_to_sections(spark, tmp_path):
    body = p("Введение", "Heading1") + p("Текст") + p("Глава", "Heading1") + p("Часть", "Heading 2") + p("Таблица 1.2 — Итоги") + f"<w:tbl>{row('a', 'b', '')}{row('', '')}{row('c', '', 'd')}</w:tbl>" + p("Вторая", "Heading2")
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    (tmp_path / "y.docx").write_bytes(b"no zip")
    (tmp_path / "z.txt").write_text("plain")
    got = {}
    for r in Engine(spark).ingest(str(tmp_path)).collect():
        got.setdefault(r["path"].rpartition("/")[2], []).append(r)
    rows = sorted(got["x.docx"], key=lambda r: r["ord"])
    assert [(r["element_type"], r["text"]) for r in rows][5:7] == [("table_row", "a | b"), ("table_row", "c |  | d")]
    assert rows[1]["section_path"] == "1 Введение" and rows[3]["section_path"] == "2 Глава / 2.1 Часть" and rows[-1]["section_path"] == "2 Глава / 2.2 Вторая"
    assert rows[4]["caption"]["number"] == "1.2" and rows[4]["caption"]["kind"] == "table"
    assert got["y.docx"][0]["error"].startswith("BadZipFile") and got["z.txt"][0]["text"] == "plain"


def test_questions_to_answers(spark):
    docs = spark.createDataFrame([(1, "the profit of the company grew strongly last year " * 4), (2, "weather report"), (3, "company profile")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "company profit"), (2, "zzz")], "q_id int, query string")
    got = {r["q_id"]: r for r in Engine(spark, answer=lambda c: F.upper(c)).ask(docs, asked).collect()}
    assert "PROFIT" in got[1]["answer"] and got[2]["answer"] is None and got[1]["type"] == "semantic"
    embed = lambda c: F.array(F.length(c).cast("float"), F.lit(1.0).cast("float"))
    hits = Engine(spark, embed=embed).search(docs, asked).where("q_id = 1").collect()
    assert {r["doc_id"] for r in hits} == {1, 2, 3}


def test_binary_files_are_errors(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.png").write_bytes(b"\x89PNG\0\0")
    (tmp_path / "c.txt").write_text("plain")
    from marginalia.sources import decoders

    got = {r["path"][-5:]: (r["element_type"], r["text"]) for r in decoders.read_sections(spark, str(tmp_path)).collect()}
    assert got["c.txt"] == ("paragraph", "plain") and got["a.pdf"][0] == got["b.png"][0] == "error"


def test_cached_rows(spark, tmp_path):
    from marginalia.sources import versions

    made = []
    make = lambda: made.append(1) or spark.range(3)
    for version in (1, 1, 2):
        assert versions.cached(spark, str(tmp_path), "key", version, make).count() == 3
    assert len(made) == 2


def test_engine_on_reports_and_grids(spark):
    from pyspark.sql import functions as F

    from marginalia.engine import Engine
    from marginalia.plans import context_queries, grid_queries

    data = "/root/testdata/sf0.001"
    chunks = context_queries.reports(spark, data)
    doc = chunks.agg(F.min("doc_id")).first()[0]
    asked = spark.createDataFrame([(1, doc, "Опиши таблицу 1.1")], "q_id int, doc_id long, query string")
    r = Engine(spark, answer=lambda prompt: F.length(prompt)).ask_reports(chunks, asked).first()
    assert r["type"] == "table" and r["context"].startswith("Таблица 1.1") and r["answer"] > len(r["context"])
    grid = grid_queries._grid(spark, data)
    none = spark.createDataFrame([("о чём работа",)], "query string")
    assert Engine(spark).check(grid, none).count() == 0
    assert {r["kind"] for r in Engine(spark).check(grid).select("kind").distinct().collect()} >= {"table_total", "table_delta", "cross_table"}


def test_figures_and_references_of_a_docx(spark, tmp_path):
    from marginalia.sources import decoders

    drawing = '<w:p><w:r><w:drawing><wp:inline xmlns:wp="wp"><wp:docPr id="1" name="Chart 1" descr="{}"/></wp:inline></w:drawing></w:r></w:p>'
    body = p("Глава", "Heading1") + drawing.format("Доли") + p("Рисунок 1.1 — Структура") + p("Текст") + p("Рис. 2 Итог") + drawing.format("") + p("Список литературы", "Heading1") + p("1. Иванов") + p("2. Петров") + p("Приложение", "Heading1") + p("прочее")
    with zipfile.ZipFile(tmp_path / "x.docx", "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    sections = decoders.captioned(decoders.read_sections(spark, str(tmp_path)))
    figures = [r for r in decoders.with_figure_captions(sections).orderBy("ord").collect() if r["element_type"] == "figure"]
    assert [(r["text"], r["figure_caption"]["number"]) for r in figures] == [("Доли", "1.1"), ("Chart 1", "2")]
    told = [(r["text"], r["ref_no"]) for r in decoders.with_references(sections).orderBy("ord").collect() if r["element_type"] == "reference"]
    assert told == [("1. Иванов", 1), ("2. Петров", 2)]


def test_codes_and_their_verdicts(spark):
    from marginalia.streaming import queues

    codes = spark.createDataFrame([("AAAA-BBBB-0001", 100, 1, False, None), ("AAAA-BBBB-0002", 50, 2, False, 40), ("AAAA-BBBB-0003", 10, 1, True, None)], "code string, duration long, most int, revoked boolean, expires_at long")
    rows = [(1, 1, " aaaa-bbbb-0001", 10), (2, 2, "AAAA-BBBB-0001", 11), (1, 3, "AAAA-BBBB-0002", 20), (2, 4, "AAAA-BBBB-0002", 40), (1, 5, "AAAA-BBBB-0003", 21), (1, 6, "bad", 22), (1, 7, None, 23), (1, 8, "AAAA-BBBB-0009", 24), (2, 9, "AAAA-BBBB-0002", 39)]
    got = {r["event_id"]: (r["verdict"], r["until"]) for r in queues.redeemed(spark.createDataFrame(rows, "user_id long, event_id long, code string, at long"), codes).collect()}
    assert got == {1: ("accepted", 110), 2: ("used", None), 3: ("accepted", 160), 4: ("expired", None), 5: ("revoked", None), 6: ("form", None), 7: ("form", None), 8: ("unknown", None), 9: ("accepted", 89)}


def test_candidates_of_evidence(spark):
    from marginalia.operators import candidates

    chunks = [(1, 1, "text", "a", "в 2020 году 15 человек"), (1, 2, "text", "a", "всего 5000 штук"), (1, 3, "", "a", "прибыль выросла"), (1, 4, "heading", "a", "глава 5000"), (1, 5, "text", "a", "доля 40 от 100"), (2, 1, "text", "b", "5 + 5"), (2, 2, "text", "b", None), (2, 3, "text", "b", "100 %")]
    schema = "doc_id int, id int, element_type string, section_path string, text string"
    found = candidates.of_chunks(spark.createDataFrame(chunks, schema), ["doc_id"])
    assert sorted((r["doc_id"], r["id"]) for r in found.collect()) == [(1, 2), (1, 3), (1, 5), (2, 1), (2, 3)]
    sections = [(1, 9, "text", "a", "всего   5000 ШТУК"), (2, 8, "text", "b", "доля 40 от 100"), (2, 9, None, "b", "итого 7")]
    every = candidates.with_sections(found, spark.createDataFrame(sections, schema), ["doc_id"], least=3)
    assert sorted((r["doc_id"], r["id"], r["from_sections"]) for r in every.collect()) == [(1, 2, 0), (1, 3, 0), (1, 5, 0), (2, 1, 0), (2, 3, 0), (2, 9, 1)]
