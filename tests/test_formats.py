"""PDF files, Word documents of the binary format, and messages, against what they were made from."""

from __future__ import annotations

import random
import re
import struct
import zlib

import pytest

from lorequarry.plans import fixture_files as made
from lorequarry.sources import compound, files, layout, pdf


def texts(content):
    return [p.text for p in pdf.pieces(content)]


def joined(content):
    return " ".join(re.sub(r" +", " ", "".join(texts(content)).replace("  ", " ")).split())


def small(content: bytes, resources: bytes, *more: bytes) -> bytes:
    """A file of one page, without references: they are found by scanning."""
    objects = [b"<</Type /Catalog /Pages 2 0 R>>", b"<</Type /Pages /Kids [3 0 R] /Resources %s>>" % resources, b"<</Type /Page /Contents 4 0 R>>", b"<</Length %d>>\nstream\n%s\nendstream" % (len(content), content), *more]
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in enumerate(objects, 1))


FONT = b"<</Font <</F <</Type /Font /Subtype /Type1 /Encoding <</BaseEncoding /WinAnsiEncoding /Differences [65 /eacute /fi /quoteright 70 /uni6F22]>>>>>>>>"


def test_strings_encodings_and_operators():
    page = rb"""BT /F 10 Tf 12 TL (a\(b\)\\ \101(c)) Tj T* <4142 43> Tj (F) ' 1 2 (x y) " % a comment
0 -5 Td [(k) -300 (ern) 5] TJ ET"""
    got = list(pdf.pieces(small(page, FONT)))
    assert [p.text for p in got] == ["a(b)\\ é(c)", "éfi’", "漢", "x y", "k", "ern"]
    assert [p.y for p in got] == [0, -12, -24, -36, -41, -41]
    assert got[4].right == pytest.approx(5 + 2) and got[5].x == pytest.approx(5 + 2 + 3)


def test_forms_images_and_matrices():
    form = b"BT /F 5 Tf 1 0 0 1 10 10 Tm (inner) Tj ET /X Do"  # refers to itself
    resources = b"<</Font <</F <</Subtype /Type1>>>> /XObject <</X 5 0 R>>>>"
    page = b"q 2 0 0 2 100 100 cm /X Do Q BI /W 1 ID \x00(not text) Tj\xff EI BT /F 9 Tf (after) Tj ET"
    content = small(page, resources, b"<</Subtype /Form /Matrix [1 0 0 1 1 1] /Length %d>>\nstream\n%s\nendstream" % (len(form), form))
    got = list(pdf.pieces(content))
    assert (got[0].text, got[0].x, got[0].y, got[0].size) == ("inner", 122, 122, 10)
    assert got[-1].text == "after" and "not text" not in "".join(p.text for p in got) and len(got) < 60


@pytest.mark.parametrize("kind", [0, 1, 2])
def test_files_round_trip_also_when_damaged(kind):
    words = [["Ærø", "(x)", "\\", "naïve", "“q”"] * 40, ["end."]]
    content = made.pdf("Title", words, kind, lines_a_page=3)
    want = " ".join(["Title", *words[0], *words[1]])
    assert sorted("".join(want.split())) == sorted("".join(joined(content).split()))
    assert len({p.page for p in pdf.pieces(content)}) > 3
    moved = content.replace(b"%PDF-1.5\n", b"%PDF-1.5\n% a line more, so that no reference is right\n", 1)
    assert joined(moved) == joined(content)
    cut = content[: content.rindex(b"startxref")]
    assert joined(cut) == joined(content)


def test_what_is_no_readable_file():
    good = made.pdf("t", [["a"]], 0)
    for bad in (b"", b"%PDF-1.4 nothing", b"text", good.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 1 0 R"), made.pdf("t", [["a"]], 1).replace(b"FlateDecode", b"LZWDecodeXX")):
        with pytest.raises(ValueError):
            list(pdf.pieces(bad))
    assert list(pdf.pieces(small(b"BT ET", FONT))) == []


def test_predictors_and_text_filters():
    rows = bytes(range(40))
    coded = bytearray()
    above = bytes(10)
    for k, kind in enumerate((0, 1, 2, 3)):
        row = rows[10 * k : 10 * k + 10]
        left = b"\0" + row[:-1]
        coded += bytes([kind]) + bytes((x - (0, a, b, (a + b) // 2)[kind]) & 255 for x, a, b in zip(row, left, above, strict=True))
        above = row
    assert pdf._unpredict(bytes(coded), {"Predictor": 15, "Columns": 10}) == rows
    doc = pdf.Document(made.pdf("t", [["a"]], 0))
    assert doc.decode(pdf.Stream({"Filter": [pdf.Name("ASCIIHexDecode"), pdf.Name("FlateDecode")]}, zlib.compress(b"x" * 9).hex().encode() + b">")) == b"x" * 9
    assert doc.decode(pdf.Stream({"Filter": pdf.Name("ASCII85Decode")}, b"<~87cURD]i,\"Ebo80~>")) == b"Hello World!"


def test_layout(spark, tmp_path):
    page = (
        b"BT /F 20 Tf 1 0 0 1 50 700 Tm (Big title) Tj /F 14 Tf 1 0 0 1 50 660 Tm (Section) Tj /F 10 Tf 1 0 0 1 50 640 Tm (First line of a) Tj 1 0 0 1 50 628 Tm (paragraph,) Tj"
        b" 1 0 0 1 104 628 Tm (that goes on.) Tj 1 0 0 1 50 600 Tm (Another one.) Tj 1 0 0 1 50 588 Tm (\225 an item) Tj 1 0 0 1 50 576 Tm (2. a second) Tj 1 0 0 1 50 564 Tm (of two lines) Tj"
        b" 1 0 0 1 300 640 Tm ( and more.) Tj ET"
    )
    for name, content in (("a.pdf", small(page, b"<</Font <</F <</Subtype /Type1>>>>>>")), ("b.pdf", b"%PDF broken"), ("c.pdf", small(b"", FONT)), ("d.doc", b"x"), ("e.msg", made.message("Sub", "one\r\n\r\ntwo"))):
        (tmp_path / name).write_bytes(content)
    elements, errors = files.ingest(files.scan(spark, f"file://{tmp_path}"))
    got = [(r.file_path[-5:], r.element_type, r.level, r.text) for r in elements.orderBy("file_path", "seq").collect()]
    assert got == [
        ("a.pdf", "heading", 1, "Big title"), ("a.pdf", "heading", 2, "Section"), ("a.pdf", "paragraph", 0, "First line of a and more. paragraph, that goes on."),
        ("a.pdf", "paragraph", 0, "Another one."), ("a.pdf", "list_item", 0, "• an item"), ("a.pdf", "list_item", 0, "2. a second of two lines"),
        ("e.msg", "heading", 1, "Sub"), ("e.msg", "paragraph", 0, "one"), ("e.msg", "paragraph", 0, "two"),
    ]
    assert {r.file_path[-5:]: r.error for r in errors.collect()}.keys() == {"b.pdf", "c.pdf", "d.doc"}
    assert layout.elements(layout.lines(layout.pieces(files.scan(spark, f"file://{tmp_path}").limit(0)))).count() == 0


def test_own_pdf_parser_takes_the_place_of_ours(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"anything")
    elements, errors = files.ingest(files.scan(spark, f"file://{tmp_path}"), {".pdf": lambda c: [("own", "paragraph", 0, [])]})
    assert [r.text for r in elements.collect()] == ["own"] and errors.count() == 0


def test_compound_files_of_any_size():
    r = random.Random(1)
    streams = {f"s{i}": r.randbytes(n) for i, n in enumerate((0, 1, 63, 64, 65, 4095, 4096, 4097, 100_000, 8_000_000))}
    c = compound.Compound(made.compound(streams))
    assert {k: c.read(k) for k in streams} == streams
    whole = made.compound({"a": b"x" * 9000})
    for n in (0, 7, 511, 700, 3000):
        with pytest.raises((ValueError, struct.error)):
            compound.Compound(whole[:n]).read("a")
    circle = bytearray(whole)
    fat = 512 * (1 + struct.unpack_from("<I", whole, 76)[0])
    struct.pack_into("<I", circle, fat + 4, 0)  # the second sector of the stream leads to the first
    with pytest.raises(ValueError):
        compound.Compound(bytes(circle)).read("a")


def test_word_documents():
    paras = [("Head", 1), ("plain “quotes”", 0), ("漢字 " * 300, 0), ("", 0), ("Sub", 2), ("😀 tail", 9)] + [(f"p {i}", i % 3) for i in range(100)]
    got = compound.parse_doc(made.word(paras, piece_chars=57))
    assert got == [(" ".join(t.split()), "heading" if s else "paragraph", s, []) for t, s in paras if t.strip()]
    field = "see \x13 HYPERLINK \x13 inner \x14x\x15 \x14the page\x15 here\x07cell"
    assert [t for t, *_ in compound.parse_doc(made.word([(field, 0)]))] == ["see the page here", "cell"]
    with pytest.raises(ValueError):
        compound.parse_doc(made.message("a", "b"))


def test_messages_with_html_and_rich_text():
    parse = lambda streams: compound.parse_msg(made.compound({"__properties_version1.0": bytes(32), **streams}), files.parse_html, files.parse_rtf)
    assert parse({"__substg1.0_0037001E": b"S\xe9", "__substg1.0_10130102": b"<p>one<p>two"}) == [("Sé", "heading", 1, []), ("one", "paragraph", 0, []), ("two", "paragraph", 0, [])]
    # the known example of compressed rich text: a run that refers to what stands before
    packed = bytes.fromhex("2d0000002b0000004c5a4675f1c5c7a703000a007263706731323542320af32068656c090020627705b06c647d0a800fa0")
    assert compound.rich_text(packed) == b"{\\rtf1\\ansi\\ansicpg1252\\pard hello world}\r\n"
    assert parse({"__substg1.0_10090102": packed}) == [("hello world", "paragraph", 0, [])]
    with pytest.raises(ValueError):
        compound.parse_msg(made.compound({"x": b"y"}), files.parse_html, files.parse_rtf)


def test_a_file_is_parsed_once(spark, tmp_path):
    """Elements and errors are read from what was parsed."""
    log = f"{tmp_path}/parsed"

    def parser(content):
        with open(log, "a") as f:
            f.write("x")
        if content == b"bad":
            raise ValueError("odd")
        return [("text", "paragraph", 0, [])]

    rows = [(f"{i}.odd", ".odd", "odd", b"bad" if i % 5 == 0 else b"good") for i in range(20)]
    found, errors = files.ingest(spark.createDataFrame(rows, "file_path string, suffix string, format string, content binary"), {".odd": parser})
    assert (found.count(), errors.count()) == (16, 4)
    assert len(open(log).read()) == 20


def test_rows_leave_python_before_the_batch_is_read():
    """What a worker holds doesn't grow with the rows of a batch."""
    import pyarrow as pa

    class Files:
        select = lambda self, *names: self
        mapInArrow = lambda self, run, schema: run

    seen = []
    run = files.parse_binary(Files(), {".odd": lambda c: seen.append(c) or [("text", "paragraph", 0, [])]})
    batch = pa.RecordBatch.from_pydict({"file_path": [str(i) for i in range(1000)], "suffix": [".odd"] * 1000, "content": [b"x"] * 1000})
    out = run(iter([batch]))
    assert next(out).num_rows == len(seen) < 100
    assert sum(b.num_rows for b in out) + 64 == len(seen) == 1000


def test_a_file_s_lines_are_shuffled_once(spark):
    """Windows, aggregations and joins of a layout share one shuffle by file."""
    import re

    from lorequarry.sources import layout

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    pieces = spark.createDataFrame([("a", 0, 1, 1.0, 9.0, 2.0, 10.0, "x", None)], "file_path string, no int, page int, x double, y double, right double, size double, text string, error string")
    lines = layout.lines(pieces)
    kept = spark.createDataFrame(lines.collect(), lines.schema)
    for df in (lines, layout.elements(kept)):
        assert {re.sub(r"#\d+", "", x).split(", ")[0] for x in re.findall(r"hashpartitioning\(([^)]*)\)", plan(df))} == {"file_path"}
        assert not re.search(r"hashpartitioning\(file_path#\d+L?, [a-z]", plan(df))
    assert [tuple(r)[:3] for r in layout.elements(kept).collect()] == [("a", 0, "x")]
