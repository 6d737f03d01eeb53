"""Files of binary formats made from texts, for queries and tests that read them back."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import slices
from ..sources.compound import MAGIC
from .fixtures import table


def paragraphs(text: str | None) -> list[list[str]]:
    """The words of each line that has any."""
    return [w for line in (text or "").split("\n") if (w := re.findall(r"[^\x20\x09-\x0D]+", line))]


def _wrapped(words: list[str], width: int) -> Iterator[str]:
    begin = size = 0
    for i, w in enumerate(words):
        if size and size + len(w) > width:
            yield " ".join(words[begin:i])
            begin, size = i, 0
        size += len(w) + 1
    yield " ".join(words[begin:])


def pdf(title: str, paras: list[list[str]], kind: int, lines_a_page: int = 50) -> bytes:
    """A title in 18 points and paragraphs in 10. ``kind`` 0: a table of references and plain streams; 1: compressed streams and
    kerned text; 2: objects in streams, a stream of references, and codes of two bytes that a map makes text of."""
    lines = [(18, title)]
    for p in paras:
        lines += [(10, x) if i else (-10, x) for i, x in enumerate(_wrapped(p, 80))]  # a negative size begins a paragraph
    chars = "".join(dict.fromkeys("".join(x for _, x in lines)))
    wide = kind == 2 or any(c.encode("cp1252", "ignore") == b"" for c in chars)
    code = {c: i + 1 for i, c in enumerate(chars)}
    hexed = {c: f"{i:04X}" for c, i in code.items()}
    quoted = lambda s: b"(" + re.sub(rb"([\\()])", rb"\\\1", s.encode("cp1252")).replace(b"\r", rb"\r") + b")"
    shown = lambda s: b"<" + "".join(map(hexed.__getitem__, s)).encode() + b">" if wide else quoted(s)
    contents = []
    for at in range(0, len(lines), lines_a_page):
        out, y = [b"BT"], 780
        for size, s in lines[at : at + lines_a_page]:
            y -= 24 if size < 0 or size == 18 else 12
            words = s.split(" ")
            half = len(words) // 2
            left = " ".join(words[:half]) + " " if half else ""
            text = shown(s) + b" Tj" if kind != 1 or not half else b"[" + shown(left) + b" -20 " + shown(" ".join(words[half:])) + b"] TJ"
            out.append(b"/F1 %d Tf 1 0 0 1 60 %d Tm %s" % (abs(size), y, text))
        contents.append(b"\n".join([*out, b"ET"]))
    pack = (lambda b: (b"/Filter /FlateDecode", zlib.compress(b))) if kind else (lambda b: (b"", b))
    objects: dict[int, bytes] = {}

    def stream(n: int, info: bytes, body: bytes) -> None:
        how, body = pack(body)
        objects[n] = b"<<%s %s /Length %d>>\nstream\n%s\nendstream" % (info, how, len(body), body)

    pages = [10 + 2 * i for i in range(len(contents))]
    objects[1] = b"<</Type /Catalog /Pages 2 0 R>>"
    objects[2] = b"<</Type /Pages /Count %d /Kids [%s] /Resources <</Font <</F1 3 0 R>>>>>>" % (len(pages), b" ".join(b"%d 0 R" % p for p in pages))
    if wide:
        objects[3] = b"<</Type /Font /Subtype /Type0 /BaseFont /F /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R>>"
        objects[4] = b"<</Type /Font /Subtype /CIDFontType2 /BaseFont /F /DW 500>>"
        maps = [b"<%04X> <%s>" % (i, c.encode("utf-16-be", "replace").hex().encode()) for c, i in code.items()]
        stream(5, b"", b"begincodespacerange\n1 begincodespacerange <0000> <FFFF> endcodespacerange\n" + b"".join(b"%d beginbfchar\n%s\nendbfchar\n" % (len(m), b"\n".join(m)) for m in (maps[i : i + 100] for i in range(0, len(maps), 100))))
    else:
        objects[3] = b"<</Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding>>"
    for p, body in zip(pages, contents, strict=True):
        objects[p] = b"<</Type /Page /Parent 2 0 R /Contents %d 0 R>>" % (p + 1)
        stream(p + 1, b"", body)
    last = max(objects) + 1
    where: dict[int, tuple[int, int, int]] = {0: (0, 0, 65535)}
    if kind == 2:
        plain = [n for n in objects if not objects[n].endswith(b"endstream")]
        bodies = [objects.pop(n) for n in plain]
        places = [sum(map(len, bodies[:i])) + i for i in range(len(bodies))]
        head = b" ".join(b"%d %d" % x for x in zip(plain, places, strict=True)) + b"\n"
        stream(last, b"/Type /ObjStm /N %d /First %d" % (len(plain), len(head)), head + b"\n".join(bodies))
        where |= {n: (2, last, i) for i, n in enumerate(plain)}
        last += 1
    out = bytearray(b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n")
    for n in sorted(objects):
        where[n] = (1, len(out), 0)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, objects[n])
    begin = len(out)
    if kind == 2:
        where[last] = (1, begin, 0)
        rows = b"".join(struct.pack(">BIH", *where.get(n, (0, 0, 0))) for n in range(last + 1))
        stream(last, b"/Type /XRef /W [1 4 2] /Size %d /Root 1 0 R" % (last + 1), rows)
        out += b"%d 0 obj\n%s\nendobj\n" % (last, objects[last])
    else:
        out += b"xref\n0 %d\n" % last
        for n in range(last):
            out += b"%010d %05d %s \n" % ((where[n][1], 0, b"n") if n and n in where else (0, 65535, b"f"))
        out += b"trailer\n<</Size %d /Root 1 0 R>>\n" % last
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % begin)


def compound(streams: dict[str, bytes]) -> bytes:
    """Short streams lie in short sectors, the others in chains of their own."""
    sectors: list[bytes] = []
    nexts: list[int] = []
    end, free, mine = 0xFFFFFFFE, 0xFFFFFFFF, 0xFFFFFFFD

    def chain(body: bytes) -> int:
        parts = [body[i : i + 512].ljust(512, b"\0") for i in range(0, len(body), 512)]
        first = len(sectors)
        sectors.extend(parts)
        nexts.extend([first + i + 1 for i in range(len(parts) - 1)] + [end] * bool(parts))
        return first if parts else end

    small, small_next, starts = bytearray(), [], {}
    for name, body in streams.items():
        if len(body) < 4096:
            first, n = len(small) // 64, -(-len(body) // 64)
            small += body.ljust(64 * n, b"\0")
            small_next += [first + i + 1 for i in range(n - 1)] + [end] * bool(n)
            starts[name] = first if n else end
        else:
            starts[name] = chain(body)
    small_start = chain(bytes(small))
    minifat = chain(b"".join(struct.pack("<I", x) for x in small_next))

    def entry(name: str, kind: int, right: int, child: int, start: int, size: int) -> bytes:
        coded = name.encode("utf-16-le")
        return coded.ljust(64, b"\0") + struct.pack("<HBB3I36xIQ", len(coded) + 2, kind, 1, free, right, child, start, size)

    rows = [entry("Root Entry", 5, free, 1 if streams else free, small_start, len(small))]
    for i, (name, body) in enumerate(streams.items(), 1):
        rows.append(entry(name, 2, i + 1 if i < len(streams) else free, free, starts[name], len(body)))
    directory = chain(b"".join(rows))
    n_fat = 1
    while n_fat * 128 < len(sectors) + n_fat + -(-max(0, n_fat - 109) // 127):
        n_fat += 1
    n_more = -(-max(0, n_fat - 109) // 127)
    fat_at = list(range(len(sectors), len(sectors) + n_fat))
    more_at = list(range(len(sectors) + n_fat, len(sectors) + n_fat + n_more))
    nexts += [mine] * n_fat + [0xFFFFFFFC] * n_more
    nexts += [free] * (n_fat * 128 - len(nexts))
    body = b"".join(sectors) + struct.pack(f"<{len(nexts)}I", *nexts)
    rest = fat_at[109:]
    for i, _ in enumerate(more_at):
        held = rest[127 * i : 127 * (i + 1)]
        body += struct.pack("<128I", *held, *[free] * (127 - len(held)), more_at[i + 1] if i + 1 < n_more else end)
    head = MAGIC + bytes(16) + struct.pack("<5H6x9I", 0x3E, 3, 0xFFFE, 9, 6, 0, n_fat, directory, 0, 4096, minifat if small_next else end, -(-len(small_next) // 128), more_at[0] if more_at else end, n_more)
    return head + struct.pack("<109I", *(fat_at[:109] + [free] * max(0, 109 - n_fat))) + body


def word(paras: list[tuple[str, int]], piece_chars: int = 700) -> bytes:
    """Paragraphs with their styles; the text lies in pieces of one or two bytes a character."""
    text = "".join(p + "\r" for p, _ in paras)
    main, pieces, cp = bytearray(0x800), [], 0
    starts = []  # the first byte of each piece, and its width unless characters vary
    for at in range(0, len(text), piece_chars):
        part = text[at : at + piece_chars]
        narrow = part.encode("cp1252", "ignore").decode("cp1252") == part
        pieces.append((cp, len(main) * 2 | 1 << 30 if narrow else len(main)))
        starts.append((len(main), narrow))
        coded = part.encode("cp1252") if narrow else part.encode("utf-16-le", "replace")
        main += coded
        cp += len(part) if narrow else len(coded) // 2

    def where(n: int) -> int:
        """The first byte of the n-th character."""
        if n == len(text):
            return len(main)
        (first, narrow), over = starts[n // piece_chars], n % piece_chars
        return first + (over if narrow else len(text[n - over : n].encode("utf-16-le", "replace")))

    bounds, n = [where(0)], 0
    for p, _ in paras:
        n += len(p) + 1
        bounds.append(where(n))
    main += bytes(-len(main) % 512)
    pages = []
    for at in range(0, len(paras), 24):
        part = paras[at : at + 24]
        page, styles = bytearray(512), sorted({style for _, style in part})
        struct.pack_into(f"<{len(part) + 1}I", page, 0, *bounds[at : at + len(part) + 1])
        for k, (_, style) in enumerate(part):
            page[4 * (len(part) + 1) + 13 * k] = 253 - 2 * styles.index(style)
        for k, style in enumerate(styles):
            struct.pack_into("<BH", page, 506 - 4 * k, 2, style)
        page[511] = len(part)
        pages.append((bounds[at], len(main) // 512))
        main += page
    clx = b"\x02" + struct.pack("<I", 4 + 12 * len(pieces)) + struct.pack(f"<{len(pieces) + 1}I", *[a for a, _ in pieces], cp) + b"".join(struct.pack("<HIH", 0, fc, 0) for _, fc in pieces)
    plc = struct.pack(f"<{len(pages) + 1}I", *[a for a, _ in pages], bounds[-1]) + struct.pack(f"<{len(pages)}I", *[p for _, p in pages])
    struct.pack_into("<H", main, 0, 0xA5EC)
    struct.pack_into("<H", main, 0x0A, 0x0200)
    struct.pack_into("<I", main, 0x4C, cp)
    struct.pack_into("<II", main, 0x0102, len(clx), len(plc))
    struct.pack_into("<II", main, 0x01A2, 0, len(clx))
    return compound({"1Table": clx + plc, "WordDocument": bytes(main)})


def message(subject: str, body: str) -> bytes:
    text = lambda s: s.encode("utf-16-le", "replace")
    return compound({"__properties_version1.0": bytes(32), "__substg1.0_0037001F": text(subject), "__substg1.0_1000001F": text(body)})


def of_documents(spark: SparkSession, sf: str, suffix: str, build: Callable[[int, str | None], bytes]) -> DataFrame:
    """``file_path, format, suffix, content_hash, content``, as a scan gives them: a file of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids, texts = (part.column(c).to_pylist() for c in ("doc_id", "text"))
            yield pa.RecordBatch.from_arrays([pa.array([f"{i}{suffix}" for i in ids], pa.string()), pa.array([build(i, t) for i, t in zip(ids, texts, strict=True)], pa.binary())], names=["file_path", "content"])

    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    made = table(spark, sf, "documents").select("doc_id", "text").repartition(parts, "doc_id").mapInArrow(run, "file_path string, content binary")
    return made.select("file_path", F.lit("").alias("format"), F.lit(suffix).alias("suffix"), F.sha2("content", 256).alias("content_hash"), "content")
