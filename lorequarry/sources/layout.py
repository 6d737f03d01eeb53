"""Lines, paragraphs and headings from placed pieces of text.

Python reads what a file shows and where; the rest are windows: over the pieces of a page for lines, and over the lines of
a file, which is as much as one row of the scan held, for paragraphs.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.lineage import slices
from . import pdf

_PIECE = "file_path string, no int, page int, x double, y double, right double, size double, text string, error string"

#: Pieces that leave Python together.
TOGETHER = 20_000
#: In heights of a glyph: what pieces of a line differ in height at most, what is a blank, and what lines of a paragraph are apart at most.
SAME_LINE, BLANK, SAME_PARAGRAPH = 0.4, 0.15, 1.7
#: A heading is so much larger than what most of the file is in, and so many characters long at most.
HEADING, HEADING_CHARS = 1.15, 250
_LISTED = r"^(?:[•‣▪◦·–*-]|\(?(?:\d{1,3}|[A-Za-z])[.)])\s+\S"


def pieces(files: DataFrame) -> DataFrame:
    """``files(file_path, content)`` of PDF files -> ``file_path, no, page, x, y, right, size, text, error``, a row per piece in
    the order of the file, and one with only the error for each file that can't be read or shows no text."""

    names = [x.split()[0] for x in _PIECE.split(", ")]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for part in slices(batches):
            rows: list[tuple] = []
            for path, content in zip(*(part.column(c).to_pylist() for c in ("file_path", "content")), strict=True):
                try:
                    found = [(path, i, *p, None) for i, p in enumerate(pdf.pieces(content))]
                    rows += found or [(path, *[None] * 7, "no text layer")]
                except Exception as e:  # a file's error is a row, so that the rest of the corpus is read
                    rows.append((path, *[None] * 7, f"{type(e).__name__}: {e}"))
                if len(rows) >= TOGETHER:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    return files.select("file_path", "content").mapInArrow(run, _PIECE)


def lines(found: DataFrame) -> DataFrame:
    """``pieces`` -> ``file_path, page, line, x, y, size, text``: from the top of a page down, pieces of like height from left to
    right, with a blank where they are apart."""
    page = Window.partitionBy("file_path", "page")
    down = page.orderBy(F.desc("y"), "x", "no")
    p = found.where("error is null").repartition("file_path")  # for all that follows
    drop = F.lag("y").over(down) - F.col("y")
    p = p.withColumn("new", F.coalesce(drop > SAME_LINE * F.greatest("size", F.lag("size").over(down)), F.lit(False)))
    p = p.withColumn("line", F.sum(F.col("new").cast("int")).over(down))
    across = Window.partitionBy("file_path", "page", "line").orderBy("x", "no")
    apart = F.coalesce(F.col("x") - F.lag("right").over(across) > BLANK * F.col("size"), F.lit(False))
    p = p.withColumn("text", F.concat(F.when(apart, F.lit(" ")).otherwise(F.lit("")), F.col("text")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("x", "no", "text"))), lambda t: t["text"])
    got = p.groupBy("file_path", "page", "line").agg(
        F.min("x").alias("x"), F.max("y").alias("y"), F.max_by("size", F.length("text")).alias("size"), F.trim(F.regexp_replace(F.array_join(ordered, ""), r"[\t\n\r ]+", " ")).alias("text")
    )
    return got.where("text <> ''")


def elements(found: DataFrame) -> DataFrame:
    """``lines`` -> ``file_path, seq, text, element_type, level, section_path, page``, as parsers give them.

    A paragraph ends where the size changes, where lines are far apart, before a list item, and at the end of a page or column
    if a sentence ends there. Lines larger than what most characters of the file are in are headings, those of the largest
    size of level 1.
    """
    found = found.repartition("file_path").withColumn("size", F.round("size", 1))  # one shuffle for windows, aggregations and joins
    used = found.groupBy("file_path", "size").agg(F.sum(F.length("text")).alias("n"))
    body = used.groupBy("file_path").agg(F.max_by("size", F.struct("n", -F.col("size"))).alias("body"))
    by_size = Window.partitionBy("file_path").orderBy(F.desc("size"))
    ranks = used.join(body, "file_path").where(F.col("size") >= HEADING * F.col("body")).select("file_path", "size", F.dense_rank().over(by_size).alias("level"))
    levels = ranks.groupBy("file_path").agg(F.map_from_entries(F.collect_list(F.struct("size", "level"))).alias("levels"))
    order = Window.partitionBy("file_path").orderBy("page", "line")
    before = lambda c: F.lag(c).over(order)
    drop = before("y") - F.col("y")
    onward = (before("page") != F.col("page")) | (drop < 0)
    ends = F.rlike(before("text"), F.lit(r"[.!?:;]['\"”’)\]]*$"))
    breaks = (before("size") != F.col("size")) | F.rlike("text", F.lit(_LISTED)) | (onward & ends) | (~onward & (drop > SAME_PARAGRAPH * F.col("size")))
    l = found.withColumn("new", F.coalesce(breaks, F.lit(True)).cast("int"))
    l = l.withColumn("seq", F.sum("new").over(order) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda t: t["text"]), " ")
    e = l.groupBy("file_path", "seq").agg(F.min("page").alias("page"), F.first("size").alias("size"), text.alias("text"))
    e = e.join(levels, "file_path", "left").withColumn("level", F.try_element_at("levels", F.col("size")))
    heading = F.col("level").isNotNull() & (F.length("text") <= HEADING_CHARS)
    kind = F.when(heading, "heading").when(F.rlike("text", F.lit(_LISTED)), "list_item").otherwise("paragraph")
    return e.select(
        "file_path", F.col("seq").cast("int").alias("seq"), "text", kind.alias("element_type"), F.when(heading, F.least("level", F.lit(6))).otherwise(0).cast("int").alias("level"),
        F.array().cast("array<string>").alias("section_path"), "page",
    )
