from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from lorequarry.sources import files as src


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = '<w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Two </w:t></w:r><w:r><w:t>runs</w:t></w:r></w:p><w:p/>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def xlsx() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c><v>3</v></c></row><row><c t="inlineStr"><is><t> x </t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def corpus(path):
    (path / "sub").mkdir()
    (path / "a.md").write_text("# A\n\ntext of a\n- item")
    (path / "b.TXT").write_text("one\n\n\n two ")
    (path / "sub/c.csv").write_bytes("﻿h1,h2\n 1 ,\n,\nx,y".encode())
    (path / "d.xml").write_text('<r xmlns="urn:x"><s>one<t>two</t>tail</s></r>')
    (path / "e.html").write_text("<html><head><title>t</title></head><body><h2>H</h2><p>Para <b>bold</b></p><ul><li>li</ul><script>no()</script></body></html>")
    (path / "f.docx").write_bytes(docx())
    (path / "g.xlsx").write_bytes(xlsx())
    (path / "h.rtf").write_bytes(rb"{\rtf1{\fonttbl{\f0 Arial;}}First \b bold\b0\par Second \'e9 end}")
    (path / "i.eml").write_text("Subject: Hello\nContent-Type: text/plain\n\nBody one\n\nBody two\n")
    (path / "j.pdf").write_bytes(b"%PDF")
    (path / "k.bin").write_bytes(b"x")
    return f"file://{path}"


def test_every_format(spark, tmp_path):
    files = src.scan(spark, corpus(tmp_path))
    assert files.count() == 10
    elements, errors = src.ingest(files)
    got = {}
    for r in elements.orderBy("file_path", "seq").collect():
        got.setdefault(r["file_path"].rpartition("/")[2], []).append((r["element_type"], r["text"], r["level"]))
    assert got == {
        "a.md": [("heading", "A", 1), ("paragraph", "text of a", 0), ("list_item", "item", 0)],
        "b.TXT": [("paragraph", "one", 0), ("paragraph", "two", 0)],
        "c.csv": [("paragraph", "h1 | h2", 0), ("paragraph", "1", 0), ("paragraph", "x | y", 0)],
        "d.xml": [("paragraph", "one", 1), ("paragraph", "two", 2), ("paragraph", "tail", 1)],
        "e.html": [("heading", "H", 2), ("paragraph", "Para bold", 0), ("list_item", "li", 0)],
        "f.docx": [("heading", "Head", 2), ("paragraph", "Two runs", 0)],
        "g.xlsx": [("paragraph", "name | 3", 0), ("paragraph", "x", 0)],
        "h.rtf": [("paragraph", "First bold", 0), ("paragraph", "Second é end", 0)],
        "i.eml": [("heading", "Hello", 1), ("paragraph", "Body one", 0), ("paragraph", "Body two", 0)],
    }
    assert [(r["file_path"].rpartition("/")[2], r["error"]) for r in errors.collect()] == [("j.pdf", "ValueError: not a PDF file")]
    paths = {r["text"]: r["section_path"] for r in src.elements_with_paths(elements.where(F.col("file_path").endswith("a.md") | F.col("file_path").endswith("d.xml"))).collect()}
    assert paths["item"] == ["A"] and paths["two"] == ["r", "s", "t"]


def test_incremental_scan(spark, tmp_path):
    root = corpus(tmp_path)
    files = src.scan(spark, root)
    src.mark_processed(spark.createDataFrame([], "file_path string, content_hash string"), files.select("file_path", "content_hash")).write.parquet(f"{tmp_path}-registry")
    registry = spark.read.parquet(f"{tmp_path}-registry")
    assert src.needs_processing(files, registry).count() == 0
    (tmp_path / "a.md").write_text("# changed")
    again = src.needs_processing(src.scan(spark, root), registry)
    assert [r["file_path"].rpartition("/")[2] for r in again.collect()] == ["a.md"]
    assert src.mark_processed(registry, again.select("file_path", "content_hash")).count() == 10


def test_uploads(tmp_path):
    with zipfile.ZipFile(tmp_path / "u.zip", "w") as z:
        z.writestr("ok/x.md", "x")
        z.writestr("../evil.md", "x")
        z.writestr("__MACOSX/y.md", "x")
        z.writestr("z.exe", "x")
    assert [p.rpartition("/")[2] for p in src.unzip_safely(str(tmp_path / "u.zip"), str(tmp_path / "out"))] == ["x.md"]
    assert src.rejected_uploads(["a.MD", "b.exe", "c.zip", "noext"]) == ["b.exe", "noext"]


def test_read_extraction_tolerates_text_lineage(spark, tmp_path):
    (tmp_path / "extraction.json").write_text('{"corpus": "demo", "units": [{"id": "u1", "text": "t", "unit_type": "best_practice", "lineage": "by hand", "confidence": 0.5, "concepts": [{"iri": "i", "label": "L"}]}, {"id": "u2", "lineage": [{"stage": "s"}]}]}')
    got = src.read_extraction(spark, f"file://{tmp_path}/extraction.json", "concepts").orderBy("ord").collect()
    assert [(r["id"], r["unit_type"], r["lineage"]) for r in got] == [("u1", "best_practice", "by hand"), ("u2", None, '[{"stage": "s"}]')]


def test_corpus_status(spark):
    c = spark.createDataFrame([("a",), ("b",), ("c",)], "corpus string")
    j = spark.createDataFrame([("a", "failed", 1, "j1"), ("a", "processing", 2, "j2")], "corpus string, status string, updated_at int, id string")
    e = spark.createDataFrame([("a",), ("b",)], "corpus string")
    assert [(r["corpus"], r["status"]) for r in src.corpus_status(c, j, e).collect()] == [("a", "processing"), ("b", "completed"), ("c", "pending")]
