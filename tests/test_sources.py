"""Files, sinks and streams."""

import io
import json
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from dossier.plans import record, render
from dossier.sources import files
from dossier.streaming import ingest

LINES = ["Jane Roe", "jane@roe.org", "SKILLS", "Python (3), Docker"]


def pdf(lines, squeeze=False, link="https://roe.org/cv"):
    body = "BT " + " ".join("({}) Tj".format(x.replace("(", "\\(").replace(")", "\\)")) for x in lines) + " [(Ab) -3 (cd)] TJ ET"
    data = zlib.compress(body.encode("latin-1")) if squeeze else body.encode("latin-1")
    return b"%PDF-1.4\n1 0 obj <<>> stream\n" + data + b"\nendstream endobj\n<< /URI (" + link.encode() + b") >>\n%%EOF"


def docx(paragraphs, rows=()):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    xml = f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{p(paragraphs[0])}{table}{"".join(map(p, paragraphs[1:]))}</w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("cvs")
    (at / "a.pdf").write_bytes(pdf(LINES))
    (at / "b.docx").write_bytes(docx(LINES, [["Go", "", "Rust"]]))
    (at / "c.txt").write_text("text")
    (at / "d.pdf").write_bytes(b"%P")
    (at / "e.docx").write_bytes(b"not a zip file")
    (at / "f").write_bytes(pdf(LINES, squeeze=True))
    return str(at)


def test_files(spark, folder):
    got = {r.path.rsplit("/", 1)[1]: r for r in files.read_files(spark, folder).collect()}
    assert got["a.pdf"].text == "\n".join([*LINES, "Abcd", "https://roe.org/cv"]) == got["f"].text
    assert got["a.pdf"].links == ["https://roe.org/cv"]
    assert got["b.docx"].text == "\n".join([*LINES, "Go | Rust"])
    assert {k: r.error.code for k, r in got.items() if r.error} == {"c.txt": "unsupported", "d.pdf": "empty", "e.docx": "unreadable"}
    assert [r.path.rsplit("/", 1)[1] for r in files.read_folder(spark, folder).select("path").collect()] == ["a.pdf", "b.docx", "d.pdf", "e.docx"]
    with pytest.raises(Exception, match="unsupported|unreadable|empty"):
        files.read_files(spark, folder, strict=True).collect()
    assert files.docx_text(docx(LINES, [["Go"]]), "xml").split("\n")[1] == "Go"
    with pytest.raises(files.UnsupportedFormat):
        files.format_of("x.doc", b"")


def test_records_from_files_and_sinks(spark, folder, tmp_path):
    rows = record.parse_files(spark, folder)
    assert rows.count() == 6
    good = rows.where("error IS NULL")
    one = good.where(F.col("path").endswith("a.pdf")).select(render.record_json().alias("j"), render.two_columns().alias("h"), render.single_column().alias("s")).first()
    assert json.loads(one.j)["contact"]["email"] == "jane@roe.org"
    assert "<h1>Jane Roe</h1>" in one.h and "Projects" not in one.s
    render.write_json(good, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == good.count()
    assert spark.range(1).select(render.escaped(F.lit("<a&b>\nc")).alias("x")).first().x == "&lt;a&amp;b&gt;<br>c"


def test_jobs_are_compared(spark):
    texts = spark.createDataFrame([(1, "SKILLS\nPython, Docker"), (2, "nothing")], "doc_id LONG, text STRING")
    jobs = spark.createDataFrame([(7, "Python, Docker and Tableau")], "jd_id LONG, text STRING")
    got = record.compare(record.parse_text(texts), jobs).collect()
    assert [tuple(r) for r in got] == [(1, 7, 3, 2, 66)]


def test_a_stream_of_files(spark, folder, tmp_path):
    found = ingest.stream_files(spark, folder).where("error IS NULL")
    q = ingest.stream_records(found).writeStream.format("memory").queryName("records").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.path.rsplit("/", 1)[1] for r in spark.table("records").where("contact.email = 'jane@roe.org'").collect()} == {"a.pdf", "b.docx", "f"}


def test_tabs_breaks_and_nested_tables_of_docx():
    run = "<w:p><w:r><w:t>Engineer</w:t><w:tab/><w:t>2020</w:t><w:br/><w:t>Acme</w:t></w:r></w:p>"
    inner = "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>inner</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    table = f"<w:tbl><w:tr><w:tc><w:p><w:r><w:t>outer</w:t></w:r></w:p>{inner}</w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{run}<w:p/>{table}</w:body></w:document>')
    assert files.docx_text(out.getvalue()) == "Engineer\t2020\nAcme\n\nouter"
    assert files.docx_text(out.getvalue(), "xml") == "Engineer2020Acme\n\nouter\ninner"


def test_links_of_pdf_files():
    image = b"%PDF-1.4\n1 0 obj <<>> stream\n\xff\xd8 no strings\nendstream endobj\n<< /URI (https://roe.org/caf\xc3\xa9 menu) >>\n%%EOF"
    assert files.pdf_text(image) == ("https://roe.org/café menu", ["https://roe.org/café menu"])
    assert files.pdf_text(b"%PDF-1.4\nplain line one\nab\n")[0] == "%PDF-1.4\nplain line one"


def test_annotations_through_a_pdf_library(monkeypatch):
    import sys
    import types

    note = types.SimpleNamespace(get_object=lambda: {"/A": {"/URI": "https://roe.org/x"}})
    page = type("Page", (dict,), {"extract_text": lambda self: self["text"]})
    pages = [page({"text": "A page with more than twenty characters", "/Annots": [note]}), page({"text": ""})]
    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=lambda _: types.SimpleNamespace(pages=pages)))
    assert files.pdf_text(b"%PDF") == ("A page with more than twenty characters\nhttps://roe.org/x", ["https://roe.org/x"])


def test_a_model_of_named_entities(spark):
    text = "xx\nMarie de la Tour\nWORK EXPERIENCE\nWarden\nGreenfields Trust\n2001 - 2004\n- kept order\nEDUCATION\nHolds M.C.A honours\nOld Mill Works in Kent"
    found = {"people": ["Marie de la Tour"], "organisations": ["Greenfields Trust", "Old Mill College"]}
    model = lambda df: df.select("doc_id", *(F.array(*map(F.lit, v)).alias(k) for k, v in found.items()))
    df = spark.createDataFrame([(1, text)], "doc_id LONG, text STRING")
    plain = record.parse_text(df).first()
    got = record.parse_text(df, record.Settings(entities=model)).first()
    assert plain.experience[0].company == "" and got.experience[0].company == "Greenfields Trust"
    assert "Greenfields Trust" in got.experience[0].description
    assert got.education[0].degree.startswith("M.C.A") and plain.education == []
    assert got.contact.name == "Marie De La Tour"


def test_records_need_one_scan_and_no_shuffle(spark, tmp_path):
    spark.createDataFrame([(1, "SKILLS\nPython")], "doc_id LONG, text STRING").write.parquet(str(tmp_path / "t"))
    plan = record.parse_text(spark.read.parquet(str(tmp_path / "t")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
    assert plan.count("EvalPython") + plan.count("InPandas") + plan.count("InArrow") <= 1


def test_pairs_without_a_common_skill_on_request(spark):
    texts = spark.createDataFrame([(1, "SKILLS\nPython, Docker"), (2, "nothing")], "doc_id LONG, text STRING")
    jobs = spark.createDataFrame([(7, "Python, Docker and Tableau")], "jd_id LONG, text STRING")
    got = record.compare(record.parse_text(texts), jobs, zero=True).orderBy("doc_id").collect()
    assert [(r.doc_id, r.matched, r.score) for r in got] == [(1, 2, 66), (2, 0, 0)]


def test_exports():
    import dossier

    assert all(getattr(dossier, name) is not None for name in dossier.__all__)
