"""Elements of documents: parsing texts into them, section paths, offsets, and boundaries of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx

#: Heading levels that paths are made of; deeper ones count as the last.
LEVELS = 6
#: A paragraph longer than this may hold several ideas.
AMBIGUOUS_CHARS = 500
#: Shortest text of a unit.
MIN_UNIT_CHARS = 10


def markdown_elements(docs: DataFrame) -> DataFrame:
    """``docs(file_path, text)`` -> ``file_path, seq, text, element_type, level``.

    Headings and list items are elements of a line each; runs of other lines, up to a blank one, are paragraphs.
    """
    lines = docs.select("file_path", F.posexplode(F.split("text", "\n")).alias("no", "line")).withColumn("line", fx.strip(F.col("line")))
    lines = lines.withColumn("kind", fx.line_class(F.col("line")))
    w = Window.partitionBy("file_path").orderBy("no")
    # a run begins at every line that isn't text, and at text after such a line
    start = (F.col("kind") != "text") | (F.lag("kind", 1, "blank").over(w) != "text")
    lines = lines.withColumn("run", F.sum(start.cast("int")).over(w)).where("kind <> 'blank'")
    runs = lines.groupBy("file_path", "run", "kind").agg(F.min("no").alias("no"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"]), "\n").alias("raw"))
    item = F.when(F.col("raw").rlike(fx.BULLET), F.regexp_extract("raw", fx.BULLET, 1)).otherwise(F.regexp_extract("raw", fx.NUMBERED, 1))
    body = F.when(F.col("kind") == "heading", F.regexp_extract("raw", fx.HEADING, 2)).when(F.col("kind") == "list", item).otherwise(F.col("raw"))
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("raw", fx.HEADING, 1))).otherwise(0)
    kind = F.when(F.col("kind") == "heading", "heading").when(F.col("kind") == "list", "list_item").otherwise("paragraph")
    seq = F.row_number().over(Window.partitionBy("file_path").orderBy("no")) - 1
    return runs.select("file_path", seq.alias("seq"), fx.strip(body).alias("text"), kind.alias("element_type"), level.cast("int").alias("level"))


def plain_elements(docs: DataFrame) -> DataFrame:
    """Parts between empty lines as paragraphs."""
    parts = docs.select("file_path", F.posexplode(F.split("text", "\n\n")).alias("no", "part")).withColumn("part", fx.strip(F.col("part"))).where("part <> ''")
    seq = F.row_number().over(Window.partitionBy("file_path").orderBy("no")) - 1
    return parts.select("file_path", seq.alias("seq"), F.col("part").alias("text"), F.lit("paragraph").alias("element_type"), F.lit(0).alias("level"))


def normalize_elements(elements: DataFrame) -> DataFrame:
    """Stripped texts without empty ones; known types, and levels that fit them."""
    e = elements.withColumn("text", fx.strip(F.col("text"))).where("text <> ''")
    e = e.withColumn("element_type", F.when(F.col("element_type").isin("heading", "list_item"), F.col("element_type")).otherwise("paragraph"))
    level = F.when(F.col("element_type") != "heading", 0).when(F.coalesce("level", F.lit(0)) <= 0, 1).otherwise(F.col("level"))
    return e.withColumn("level", level.cast("int"))


def with_whole_text(docs: DataFrame, elements: DataFrame) -> DataFrame:
    """Documents that gave no element, but have a text, become one paragraph each."""
    bare = docs.join(elements.select("file_path").distinct(), "file_path", "left_anti").where(fx.strip(F.col("text")) != "")
    return elements.unionByName(bare.select("file_path", F.lit(0).alias("seq"), fx.strip(F.col("text")).alias("text"), F.lit("paragraph").alias("element_type"), F.lit(0).alias("level")))


def section_paths(elements: DataFrame) -> DataFrame:
    """``elements(file_path, seq, text, level)``, level 0 for no heading -> with ``section_path``, a heading's own included.

    A heading ends all of its level and below. So the last heading of level k is alive if none of a higher level came
    after it, which running maxima tell: one shuffle and no state.
    """
    w = Window.partitionBy("file_path").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    level = F.least(F.col("level"), F.lit(LEVELS))
    last = [F.max(F.when(level == k, F.struct("seq", "text"))).over(w) for k in range(1, LEVELS + 1)]
    e = elements.select("*", *[x.alias(f"_h{k}") for k, x in enumerate(last, 1)])
    alive: list[Column] = []
    for k in range(1, LEVELS + 1):
        at, above = F.col(f"_h{k}.seq"), [F.coalesce(F.col(f"_h{j}.seq"), F.lit(-1)) for j in range(1, k)]
        ok = at.isNotNull() if k == 1 else at > (above[0] if len(above) == 1 else F.greatest(*above))
        alive.append(F.when(ok, F.col(f"_h{k}.text")))
    return e.withColumn("section_path", F.filter(F.array(*alive), lambda x: x.isNotNull())).drop(*[f"_h{k}" for k in range(1, LEVELS + 1)])


def char_offsets(elements: DataFrame) -> DataFrame:
    """With ``char_offset_start`` and ``char_offset_end`` in the texts joined by one character each."""
    w = Window.partitionBy("file_path").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).cast("long")
    return elements.withColumn("char_offset_start", start).withColumn("char_offset_end", F.col("char_offset_start") + F.length("text"))


def merge_runs(rows: DataFrame, key: str, order: str, kind: Column, text: str) -> DataFrame:
    """Consecutive rows of one ``kind`` as one: ``key, island, kind, first, last, n, text``."""
    w = Window.partitionBy(key).orderBy(order)
    r = rows.withColumn("kind", kind)
    new = F.coalesce(F.lag("kind").over(w) != F.col("kind"), F.lit(True))
    r = r.withColumn("island", F.sum(new.cast("int")).over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))), lambda x: x["t"]), "\n")
    return r.groupBy(key, "island", "kind").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), joined.alias("text"))


def parts_with_positions(text: Column, parts: Column) -> Column:
    """Each part with its place in the text, sought from the end of the part before; 0-based, end exclusive."""
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<part:string,start:int,end:int>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        found = F.position(p, text, s["at"] + 1)
        start = F.when(found > 0, found - 1).otherwise(s["at"])
        return F.struct((start + F.length(p)).alias("at"), F.array_append(s["out"], F.struct(p.alias("part"), start.alias("start"), (start + F.length(p)).alias("end"))).alias("out"))

    return F.aggregate(parts, first, step)["out"]


def structural_boundaries(elements: DataFrame) -> DataFrame:
    """``elements(file_path, seq, text, element_type, section_path, char_offset_start, char_offset_end)`` -> boundaries
    ``file_path, seq, part, start, end, text, section_path, confidence, method``.

    A heading has confidence 1, a list item 0.9, a paragraph 0.7 or, with a transition, 0.8. A paragraph with blank
    lines inside splits there.
    """
    e = elements.withColumn("found", F.when((F.col("element_type") == "paragraph"), parts_with_positions(F.col("text"), fx.blocks(F.col("text")))))
    whole = F.array(F.struct(F.col("text").alias("part"), F.lit(0).alias("start"), F.length("text").alias("end")))
    e = e.withColumn("split", F.coalesce(F.size("found") > 1, F.lit(False)))
    e = e.select("*", F.posexplode(F.when(F.col("split"), F.col("found")).otherwise(whole)).alias("part", "p"))
    t = fx.has_transition(F.col("p.part"))
    paragraph = F.col("element_type") == "paragraph"
    confidence = F.when(F.col("element_type") == "heading", 1.0).when(F.col("element_type") == "list_item", 0.9).when(t, 0.8).otherwise(0.7)
    method = (
        F.when(paragraph & t, "structural_transition")
        .when(paragraph & F.col("split"), "structural_paragraph_break")
        .when(paragraph, "structural_paragraph")
        .when(F.col("element_type") == "heading", "structural_heading")
        .otherwise("structural_list")
    )
    base = F.col("char_offset_start")
    return e.select("file_path", "seq", "part", (base + F.col("p.start")).alias("start"), (base + F.col("p.end")).alias("end"), F.col("p.part").alias("text"), "section_path", confidence.alias("confidence"), method.alias("method"))


def ambiguous(boundaries: DataFrame) -> Column:
    """Whether a boundary goes on to the second tier: a long whole paragraph."""
    return (F.col("end") - F.col("start") > AMBIGUOUS_CHARS) & (F.col("method") == "structural_paragraph")


def semantic_splits(sentences: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``sentences(paragraph, no, text, embedding)`` -> ``paragraph, segment, text, n``.

    A segment ends where the cosine of neighbours falls below ``threshold``; its sentences are joined by spaces.
    Paragraphs that stay whole, and those of fewer than two sentences, are not returned. With ``start`` and ``end`` of the
    sentences, segments have theirs.
    """
    span = [F.min("start").alias("start"), F.max("end").alias("end")] if {"start", "end"} <= set(sentences.columns) else []
    w = Window.partitionBy("paragraph").orderBy("no")
    s = sentences.withColumn("similarity", fx.dot(F.lag("embedding").over(w), F.col("embedding")))
    s = s.withColumn("segment", F.sum(F.coalesce((F.col("similarity") < threshold).cast("int"), F.lit(0))).over(w))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]), " ")
    parts = s.groupBy("paragraph", "segment").agg(joined.alias("text"), F.count("*").alias("n"), *span)
    return parts.withColumn("_all", F.count("*").over(Window.partitionBy("paragraph"))).where("_all > 1").drop("_all")


def sentences_of(boundaries: DataFrame) -> DataFrame:
    """``paragraph, no, text, start, end`` of the sentences of ambiguous boundaries; ``paragraph`` is their key."""
    key = F.struct("file_path", "seq", "part").alias("paragraph")
    found = boundaries.where(ambiguous(boundaries)).select(key, F.col("start").alias("base"), F.posexplode(parts_with_positions(F.col("text"), fx.sentences(F.col("text")))).alias("no", "p"))
    return found.select("paragraph", "no", F.col("p.part").alias("text"), (F.col("base") + F.col("p.start")).alias("start"), (F.col("base") + F.col("p.end")).alias("end"))


def semantic_tier(sentences: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``sentences_of`` with ``embedding`` -> the segments that ``refine`` takes as those of the second tier."""
    parts = semantic_splits(sentences, threshold)
    return parts.select("paragraph.file_path", "paragraph.seq", "paragraph.part", "start", "end", "text", F.lit(0.75).alias("confidence"), F.lit("semantic").alias("method"))


def refine(boundaries: DataFrame, semantic: DataFrame, model: DataFrame) -> DataFrame:
    """The tiers in order: ambiguous boundaries are replaced by their semantic segments, else by those of the model, else
    they stay. ``semantic`` and ``model``: ``file_path, seq, part, start, end, text, confidence, method``."""
    key = ["file_path", "seq", "part"]
    b = boundaries.withColumn("_a", ambiguous(boundaries))
    open_ = b.where("_a").drop("_a")
    second = semantic.join(open_.select(*key, "section_path"), key)
    left = open_.join(semantic.select(*key).distinct(), key, "left_anti")
    third = model.join(left.select(*key, "section_path"), key)
    rest = left.join(model.select(*key).distinct(), key, "left_anti")
    out = b.where("not _a").drop("_a")
    for more in (second, third, rest):
        out = out.unionByName(more.select(*out.columns))
    return out


def model_segments(replies: DataFrame, near: int = 20) -> DataFrame:
    """``replies(file_path, seq, part, start, text, candidates array<long>, reply json)`` -> segments of the third tier.

    The reply lists spans within the text; a missing start or end is the text's. They are clamped, those that are empty or blank
    are dropped, and one alone is no split. A span that begins less than ``near`` characters from a candidate, a place in
    the text, has confidence 0.85, else 0.75.
    """
    spans = F.from_json("reply", "boundaries array<struct<start:long,end:long>>")["boundaries"]
    r = replies.withColumn("n", F.length("text").cast("long")).withColumn("spans", F.coalesce(spans, F.array().cast("array<struct<start:long,end:long>>")))
    clamped = lambda c, missing: F.greatest(F.lit(0), F.least(F.coalesce(c, missing), F.col("n")))
    piece = lambda s: fx.strip(F.substring(F.col("text"), s["a"].cast("int") + 1, (s["b"] - s["a"]).cast("int")))
    cut = F.transform("spans", lambda s: F.struct(clamped(s["start"], F.lit(0)).alias("a"), clamped(s["end"], F.col("n")).alias("b")))
    r = r.withColumn("spans", F.filter(cut, lambda s: (s["b"] > s["a"]) & (piece(s) != ""))).where(F.size("spans") > 1).select("*", F.explode("spans").alias("s"))
    close = F.exists(F.coalesce("candidates", F.array().cast("array<bigint>")), lambda c: F.abs(c - F.col("s.a")) < near)
    out = r.select("file_path", "seq", "part", (F.col("start") + F.col("s.a")).alias("start"), (F.col("start") + F.col("s.b")).alias("end"), piece(F.col("s")).alias("text"), F.when(close, 0.85).otherwise(0.75).alias("confidence"), F.lit("llm").alias("method"))
    return out


def knowledge_units(boundaries: DataFrame) -> DataFrame:
    """Boundaries as units: no headings, no texts below ``MIN_UNIT_CHARS``; ids from file and span, so reruns agree."""
    b = boundaries.where("method <> 'structural_heading'").withColumn("text", fx.strip(F.col("text"))).where(F.length("text") >= MIN_UNIT_CHARS)
    b = b.withColumn("ord", F.row_number().over(Window.partitionBy("file_path").orderBy("seq", "part", "start")))
    return b.select(
        fx.content_id(F.col("file_path"), F.col("start").cast("string"), F.col("end").cast("string"), F.col("text")).alias("id"),
        "ord",
        "text",
        F.struct("start", "end", F.col("file_path").alias("source_file")).alias("original_span"),
        F.lit("advice").alias("unit_type"),
        F.col("file_path").alias("source_file"),
        F.col("section_path").alias("source_section"),
        "confidence",
        F.sha2("text", 256).alias("content_hash"),
        F.array(lineage("boundary_detection", "split", F.col("method"), F.col("confidence"))).alias("lineage"),
        F.array().cast("array<string>").alias("cross_references"),
    )


def lineage(stage: str, action: str, detail: Column, confidence: Column | None = None, at: Column | None = None) -> Column:
    """One event of a unit's history; the clock is given from outside."""
    none = F.lit(None)
    return F.struct(F.lit(stage).alias("stage"), F.lit(action).alias("action"), detail.cast("string").alias("detail"), (none if confidence is None else confidence).cast("double").alias("confidence"), (none if at is None else at).cast("timestamp").alias("timestamp"))


def record(units: DataFrame, stage: str, action: str, detail: Column, confidence: Column | None = None, at: Column | None = None) -> DataFrame:
    return units.withColumn("lineage", F.array_append("lineage", lineage(stage, action, detail, confidence, at)))
