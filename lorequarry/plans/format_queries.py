"""Queries that write documents as files of other formats and read them back, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import site
from ..operators.lineage import cut
from ..sources import files as src
from . import fixture_files as made
from . import fixtures as fix
from .queries import query


def _read(files: DataFrame) -> DataFrame:
    """Of each file its headings, and the digest of its other elements' texts in order, or its error."""
    elements, errors = src.ingest(files)
    texts = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("seq", "text")))), lambda t: t["text"]), " ")
    heading = F.col("element_type") == "heading"
    e = elements.groupBy("file_path").agg(texts(heading).alias("heading"), F.sha2(texts(~heading), 256).alias("text_sha256"), F.lit("").alias("error"))
    e = e.unionByName(errors.select("file_path", F.lit("").alias("heading"), F.lit("").alias("text_sha256"), "error"))
    return e.select(F.regexp_extract("file_path", r"(\d+)\.\w+$", 1).cast("long").alias("doc_id"), "heading", "text_sha256", "error")


_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_DOCS = f"SELECT doc_id, concat('Document ', doc_id) AS title, array_to_string({_WORDS.format("coalesce(text, '')")}, ' ') AS t, text FROM documents"
_READ = f"SELECT doc_id, title AS heading, sha256(t) AS text_sha256, '' AS error FROM ({_DOCS})"
# the title is in larger type, but a heading only if most characters are not
_LINES = f"list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: length(array_to_string({_WORDS.format('l').replace('lambda x: x', 'lambda w: w')}, ' ')))"
_PLACED = f"""SELECT doc_id, CASE WHEN n >= length(title) THEN title ELSE '' END AS heading, sha256(CASE WHEN n >= length(title) THEN t ELSE trim(concat(title, ' ', t)) END) AS text_sha256, '' AS error
FROM (SELECT *, list_sum({_LINES}) AS n FROM ({_DOCS}))"""


@query("", _PLACED)
def pdf_elements(spark, sf):
    """Every document as a PDF file, of three kinds by its id."""
    return _read(made.of_documents(spark, sf, ".pdf", lambda i, t: made.pdf(f"Document {i}", made.paragraphs(t), i % 3)))


@query("", _READ)
def word_elements(spark, sf):
    """Every document as a Word file of the binary format, with a heading."""
    return _read(made.of_documents(spark, sf, ".doc", lambda i, t: made.word([(f"Document {i}", 1)] + [(" ".join(p), 0) for p in made.paragraphs(t)])))


@query("", _READ)
def message_elements(spark, sf):
    """Every document as a saved message."""
    return _read(made.of_documents(spark, sf, ".msg", lambda i, t: made.message(f"Document {i}", "\r\n\r\n".join(" ".join(p) for p in made.paragraphs(t)))))


@query("tasks links units", f"""SELECT t.task_id, CAST(coalesce(c.n, 0) + coalesce(u.n, 0) AS BIGINT) AS items, CAST(greatest(1, ceil((coalesce(c.n, 0) + coalesce(u.n, 0)) / {site.PAGE}.0)) AS BIGINT) AS pages, CAST(0 AS BIGINT) AS dangling
FROM (SELECT task_id FROM tasks UNION ALL SELECT '') t LEFT JOIN (SELECT coalesce(parent_task_id, '') AS p, count(*) AS n FROM tasks GROUP BY ALL) c ON c.p = t.task_id
LEFT JOIN (SELECT l.task_id, count(*) AS n FROM links l JOIN units u ON u.ord = l.unit_ord GROUP BY ALL) u ON u.task_id = t.task_id""")
def site_pages(spark, sf):
    """The site of all tasks: for each the items and pages, and how many of their links lead nowhere."""
    t = fix.tasks(spark, sf).withColumn("ord", F.substring("task_id", 2, 20).cast("long"))
    for flag in ("is_procedural", "has_contradictions", "jurisdiction_sensitive"):
        t = t.withColumn(flag, F.lit(False))
    u = fix.units(spark, sf)
    made_ = cut(site.scanned(site.pages(t, fix.links(spark, sf).join(u.select(F.col("ord").alias("unit_ord"), F.col("id").alias("unit_id")), "unit_ord").select("task_id", "unit_id"), u)))
    lost = site.page_links(made_).where("not found").groupBy("path").agg(F.count("*").alias("dangling"))
    p = made_.where("path like '%.html'").select("path", "items", F.regexp_replace("path", r"-\d+\.html$", ".html").alias("first")).join(lost, "path", "left")
    p = p.groupBy("first").agg(F.sum("items").cast("long").alias("items"), F.count("*").alias("pages"), F.coalesce(F.sum("dangling"), F.lit(0)).alias("dangling"))
    name = fix.tasks(spark, sf).select("task_id").unionByName(spark.range(1).select(F.lit("").alias("task_id")))
    return name.select("task_id", site.page_path(F.col("task_id")).alias("first")).join(p, "first").drop("first")
