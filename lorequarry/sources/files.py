"""Files of a corpus: scan, change detection, and elements from every format that the standard library can read."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import elements as el
from ..operators.lineage import cut, slices
from . import layout
from .compound import parse_doc, parse_msg

# Suffixes that are read, and the names of their formats.
FORMATS = {
    ".md": "markdown", ".txt": "plain_text", ".docx": "word", ".doc": "word", ".pdf": "pdf", ".html": "html", ".htm": "html", ".rtf": "rtf",
    ".eml": "email", ".msg": "email", ".csv": "csv", ".xlsx": "excel", ".tsv": "tsv", ".xml": "xml", ".wpd": "wordperfect",
}
_ELEMENT = "file_path string, seq int, text string, element_type string, level int, section_path array<string>, page int, ok boolean, error string"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """``file_path, format, content_hash, content`` of the files below ``root`` with a known suffix, in any case."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.[^./]+$", 0))
    names = F.create_map(*[F.lit(x) for kv in FORMATS.items() for x in kv])
    return f.select(F.col("path").alias("file_path"), F.try_element_at(names, suffix).alias("format"), suffix.alias("suffix"), F.sha2("content", 256).alias("content_hash"), "content").where("format is not null")


def needs_processing(files: DataFrame, registry: DataFrame) -> DataFrame:
    """Files whose path and hash aren't registered."""
    return files.join(registry.select("file_path", "content_hash"), ["file_path", "content_hash"], "left_anti")


def mark_processed(registry: DataFrame, files: DataFrame) -> DataFrame:
    """The registry with a row for each of ``files``, in place of the file's former row."""
    return registry.join(files.select("file_path"), "file_path", "left_anti").unionByName(files.select(*registry.columns))


class _Html(HTMLParser):
    """Headings, paragraphs and list items; what scripts and styles hold is skipped."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, int]] = []
        self.kind, self.level, self.buffer, self.skip = "paragraph", 0, [], 0

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            self.found.append((text, self.kind, self.level))
        self.buffer, self.kind, self.level = [], "paragraph", 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "template", "head"):
            self.skip += 1
        elif re.fullmatch("h[1-6]", tag):
            self.flush()
            self.kind, self.level = "heading", int(tag[1])
        elif tag == "li":
            self.flush()
            self.kind = "list_item"
        elif tag in ("p", "div", "section", "article", "table", "tr", "ul", "ol", "blockquote", "pre", "body", "nav", "footer", "header", "td", "th"):
            self.flush()
        elif tag == "br":
            self.buffer.append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style", "template", "head"):
            self.skip = max(0, self.skip - 1)
        elif re.fullmatch("h[1-6]", tag) or tag in ("p", "li", "div", "section", "article", "tr", "ul", "ol", "blockquote", "pre", "td", "th"):
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.buffer.append(data)


Parsed = list[tuple[str, str, int, list[str]]]


def parse_html(content: bytes) -> Parsed:
    p = _Html()
    p.feed(content.decode("utf-8", "replace"))
    p.close()
    p.flush()
    return [(t, k, lv, []) for t, k, lv in p.found]


def parse_xml(content: bytes) -> Parsed:
    """Texts and tails in document order; the path of tags without namespaces, and the depth as level."""
    out: Parsed = []
    stack = [(ElementTree.fromstring(content), [], 0, False)]
    while stack:
        node, path, depth, tail = stack.pop()
        if tail:
            if node.tail and node.tail.strip():
                out.append((node.tail.strip(), "paragraph", depth, path))
            continue
        own = [*path, str(node.tag).rpartition("}")[2]]
        if node.text and node.text.strip():
            out.append((node.text.strip(), "paragraph", depth, own))
        for child in reversed(node):
            stack.append((child, own, depth, True))
            stack.append((child, own, depth + 1, False))
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def parse_docx(content: bytes) -> Parsed:
    out: Parsed = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    for p in root.iter(f"{_W}p"):
        text = "".join(t.text or "" for t in p.iter(f"{_W}t")).strip()
        style = p.find(f"{_W}pPr/{_W}pStyle")
        name = (style.get(f"{_W}val") or "") if style is not None else ""
        if text:
            m = re.fullmatch(r"(?i)heading\s*([1-9])", name)
            listed = p.find(f"{_W}pPr/{_W}numPr") is not None
            out.append((text, "heading" if m else "list_item" if listed else "paragraph", int(m[1]) if m else 0, []))
    return out


_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def parse_xlsx(content: bytes) -> Parsed:
    out: Parsed = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter(f"{_S}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{_S}si")] if "xl/sharedStrings.xml" in names else []
        for sheet in sorted(n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)):
            for row in ElementTree.fromstring(z.read(sheet)).iter(f"{_S}row"):
                cells = []
                for c in row.iter(f"{_S}c"):
                    v = c.find(f"{_S}v")
                    text = "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (v.text or "") if v is not None else ""
                    cells.append(shared[int(text)] if c.get("t") == "s" and text else text)
                if line := " | ".join(x.strip() for x in cells if x.strip()):
                    out.append((line, "paragraph", 0, []))
    return out


def parse_rtf(content: bytes) -> Parsed:
    """Paragraphs of the plain text; destinations such as font tables are skipped."""
    s = content.decode("latin-1")
    out, stack, skip, i = [], [], False, 0
    while i < len(s):
        c = s[i]
        if c == "{":
            stack.append(skip)
            skip = skip or s.startswith(("{\\*", "{\\fonttbl", "{\\colortbl", "{\\stylesheet", "{\\info", "{\\pict"), i)
        elif c == "}":
            skip = stack.pop() if stack else False
        elif c == "\\":
            m = re.compile(r"\\(?:'([0-9a-fA-F]{2})|([a-zA-Z]+)(-?\d+)? ?|(.))", re.S).match(s, i)
            if m:
                i = m.end()
                if not skip:
                    if m[1]:
                        out.append(bytes.fromhex(m[1]).decode("cp1252", "replace"))
                    elif m[2] in ("par", "line", "sect", "page"):
                        out.append("\n\n")
                    elif m[2] == "tab":
                        out.append("\t")
                    elif m[2] == "u" and m[3]:
                        out.append(chr(int(m[3]) % 65536))
                        i += 1 if s[i : i + 1] == "?" else 0
                    elif m[4] in ("\\", "{", "}"):
                        out.append(m[4])
                continue
        elif not skip and c not in "\r\n":
            out.append(c)
        i += 1
    return [(t.strip(), "paragraph", 0, []) for t in "".join(out).split("\n\n") if t.strip()]


def parse_eml(content: bytes) -> Parsed:
    message = email.message_from_bytes(content, policy=email.policy.default)
    out: Parsed = [(message["subject"], "heading", 1, [])] if message["subject"] else []
    body = message.get_body(preferencelist=("plain", "html"))
    if body is not None:
        text = body.get_content()
        if body.get_content_type() == "text/html":
            return out + parse_html(text.encode())
        out += [(t.strip(), "paragraph", 0, []) for t in re.split(r"\n\s*\n", text) if t.strip()]
    return out


def parse_delimited(content: bytes, sep: str) -> Parsed:
    """Each row's cells that aren't empty, joined by bars; a header row is a row."""
    rows = csv.reader(io.StringIO(content.decode("utf-8-sig", "replace")), delimiter=sep)
    return [(" | ".join(c), "paragraph", 0, []) for r in rows if (c := [x.strip() for x in r if x.strip()])]


#: Parsers by suffix, besides those of ``layout``. A caller may add others or replace them.
PARSERS: dict[str, Callable[[bytes], Parsed]] = {
    ".html": parse_html,
    ".htm": parse_html,
    ".xml": parse_xml,
    ".docx": parse_docx,
    ".doc": parse_doc,
    ".msg": lambda c: parse_msg(c, parse_html, parse_rtf),
    ".xlsx": parse_xlsx,
    ".rtf": parse_rtf,
    ".eml": parse_eml,
    ".csv": lambda c: parse_delimited(c, ","),
    ".tsv": lambda c: parse_delimited(c, "\t"),
}


def parse_binary(files: DataFrame, parsers: dict[str, Callable[[bytes], Parsed]] | None = None) -> DataFrame:
    """``files(file_path, suffix, content)`` -> elements, and a row with ``ok`` false and the error for each file that
    can't be read. The others go on."""
    known = {**PARSERS, **(parsers or {})}

    names = [x.split()[0] for x in _ELEMENT.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for path, suffix, content in zip(*(part.column(c).to_pylist() for c in ("file_path", "suffix", "content")), strict=True):
                try:
                    if suffix not in known:
                        raise ValueError(f"no parser for {suffix}")
                    rows += [(path, i, t, k, lv, sp, None, True, None) for i, (t, k, lv, sp) in enumerate(known[suffix](content))]
                except Exception as e:  # a file's error is a row, so that the rest of the corpus is read
                    rows.append((path, None, None, None, None, None, None, False, f"{type(e).__name__}: {e}"))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return files.select("file_path", "suffix", "content").mapInArrow(run, _ELEMENT)


def ingest(files: DataFrame, parsers: dict[str, Callable[[bytes], Parsed]] | None = None) -> tuple[DataFrame, DataFrame]:
    """``scan``'s rows -> ``elements(file_path, seq, text, element_type, level, section_path)`` and ``errors(file_path, error)``.

    Markdown and plain text are parsed by column functions; PDF files are read as placed pieces of text, of which plans make lines
    and paragraphs; the rest goes to parsers in Python. A text format that a parser was added for, and which gave nothing,
    falls back to the column functions.
    """
    text = files.where(F.col("suffix").isin(".md", ".txt")).select("file_path", "suffix", F.decode("content", "UTF-8").alias("text"))
    none = F.array().cast("array<string>")
    md = el.markdown_elements(text.where("suffix = '.md'").select("file_path", "text"))
    plain = el.plain_elements(text.where("suffix = '.txt'").select("file_path", "text"))
    native = el.with_whole_text(text.select("file_path", "text"), md.unionByName(plain)).withColumn("section_path", none)
    placed = [] if ".pdf" in (parsers or {}) else [".pdf"]
    # both are read twice, and parsed once
    other = cut(parse_binary(files.where(~F.col("suffix").isin(".md", ".txt", *placed)), parsers))
    pieces = cut(layout.pieces(files.where(F.col("suffix").isin(placed))))
    errors = other.where("not ok").select("file_path", "error").unionByName(pieces.where("error is not null").select("file_path", "error"))
    good = other.where("ok").select(*native.columns).unionByName(layout.elements(cut(layout.lines(pieces))).select(*native.columns))
    return native.unionByName(good), errors


def elements_with_paths(found: DataFrame) -> DataFrame:
    """Normalised elements with section paths and offsets; paths that a parser gave are kept."""
    e = el.char_offsets(el.section_paths(el.normalize_elements(found).withColumnRenamed("section_path", "_given")))
    return e.withColumn("section_path", F.when(F.size(F.coalesce("_given", F.array().cast("array<string>"))) > 0, F.col("_given")).otherwise(F.col("section_path"))).drop("_given")


def read_extraction(spark: SparkSession, path: str, tags: str = "tags") -> DataFrame:
    """Units of an extraction file, read tolerantly: a lineage that is text stays text. ``tags`` is the name of the field
    that holds a unit's concepts."""
    units = f"array<struct<id:string,text:string,unit_type:string,source_file:string,source_section:array<string>,confidence:double,surprise_score:double,content_hash:string,lineage:string,`{tags}`:array<struct<iri:string,label:string,confidence:double,extraction_path:string,branch:string>>>>"
    raw = spark.read.schema(f"corpus string, units {units}").json(path, multiLine=True)
    u = raw.select("corpus", F.posexplode("units").alias("ord", "u"))
    return u.select("corpus", "ord", "u.*").withColumnRenamed(tags, "tags")


def file_counts(elements: DataFrame) -> DataFrame:
    return elements.groupBy("file_path").agg(F.count("*").alias("elements"))


def corpus_status(corpora: DataFrame, jobs: DataFrame, extracted: DataFrame) -> DataFrame:
    """``corpora(corpus)``: the status of its last job, else completed if it has an extraction, else pending."""
    w = Window.partitionBy("corpus").orderBy(F.desc("updated_at"), "id")
    last = jobs.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("corpus", "status")
    have = extracted.select("corpus").distinct().withColumn("_e", F.lit(True))
    return corpora.join(last, "corpus", "left").join(have, "corpus", "left").withColumn("status", F.coalesce("status", F.when(F.col("_e"), "completed"), F.lit("pending"))).drop("_e").orderBy("corpus")


def unzip_safely(archive: str, into: str) -> list[str]:
    """Extract the supported files of a ZIP; members that point outside, and those of macOS, are left out."""
    from pathlib import Path

    base, out = Path(into).resolve(), []
    with zipfile.ZipFile(archive) as z:
        for m in z.infolist():
            target = (base / m.filename).resolve()
            if m.is_dir() or "__MACOSX" in m.filename or not target.is_relative_to(base) or target.suffix.lower() not in FORMATS:
                continue
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(z.read(m))
            out.append(str(target))
    return out


def rejected_uploads(names: list[str]) -> list[str]:
    """Names that make a whole upload fail."""
    return [n for n in names if "." + n.rpartition(".")[2].lower() not in {*FORMATS, ".zip"}]
