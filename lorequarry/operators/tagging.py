"""Concept tags of units: dictionary and search paths, and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from .lineage import cut
from .similarity import nearest

TAG = "struct<iri:string,label:string,confidence:double,contributing_paths:array<string>,branch:string>"
RULER_CONFIDENCE, LLM_CONFIDENCE = 0.72, 0.5
SEMANTIC_MIN, SEMANTIC_K = 0.3, 10
RESOLVE_MIN = 0.6
#: Up to so many labels their first words, or what was found for them, are broadcast.
BROADCAST_LABELS = 200_000


def ruler(units: DataFrame, concepts: DataFrame, longest: int | None = None) -> DataFrame:
    """``units(id, text)``, ``concepts(iri, label, branch)`` -> ``id, pos, iri, label, branch, confidence``: labels that
    occur in the text as whole words, in any case.

    Words of the text meet the labels' first words, and the n-grams from there on the labels, so that the cost doesn't
    grow with their number. With ``longest``, longer labels are left out.
    """
    if longest is None:
        longest = concepts.agg(F.max(F.size(F.filter(F.split(F.lower("label"), r"[^\p{L}\p{N}]+"), lambda w: w != "")))).first()[0] or 1
        longest = max(longest, 1)
    split = lambda c: F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    names = concepts.withColumn("words", split("label")).withColumn("gram", F.array_join("words", " ")).where("gram <> ''")
    # labels are looked for where their first word is
    starts = names.groupBy(F.get("words", F.lit(0)).alias("word")).agg(F.array_sort(F.collect_set(F.size("words"))).alias("sizes"))
    starts = F.broadcast(starts) if concepts.count() <= BROADCAST_LABELS else starts
    ahead = F.transform("words", lambda w, i: F.struct(i.alias("pos"), w.alias("word"), F.slice("words", i + 1, longest).alias("ahead")))
    at = units.select("id", split("text").alias("words")).select("id", F.inline(ahead)).join(starts, "word")
    at = at.select("id", "pos", F.explode(F.transform(F.filter("sizes", lambda n: n <= F.size("ahead")), lambda n: F.array_join(F.slice("ahead", 1, n), " "))).alias("gram"))
    found = at.join(names.select("gram").distinct(), "gram", "left_semi").groupBy("id", "gram").agg(F.min("pos").alias("pos"))
    return found.join(names.drop("words"), "gram").select("id", "pos", "iri", "label", "branch", F.lit(RULER_CONFIDENCE).alias("confidence"))


def label_search(headings: DataFrame, concepts: DataFrame, least: float = 0.3) -> DataFrame:
    """``headings(id, depth, text)`` -> the best concept for each by the likeness of labels: 1 if equal in lower case, else
    one minus the edit distance over the longer length. Candidates share a word."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    h = headings.select("id", "depth", F.lower(fx.clean_heading(F.col("text"))).alias("clean")).where(F.length("clean") >= 3)
    # equal headings are looked for once, and a pair meets at the first word it shares: nothing is made distinct
    left = h.select("clean").distinct().withColumn("ws", words("clean")).withColumn("w", F.explode("ws"))
    right = concepts.select("iri", "label", "branch", words("label").alias("rs")).withColumn("w", F.explode("rs"))
    pairs = left.join(right, "w").where(F.get(F.array_intersect("ws", "rs"), F.lit(0)) == F.col("w"))
    low = F.lower("label")
    score = F.when(low == F.col("clean"), 1.0).otherwise(1 - F.levenshtein(low, F.col("clean")) / F.greatest(F.length(low), F.length("clean")))
    place = F.struct((-F.col("score")).alias("back"), "iri", "label", "branch")
    best = cut(pairs.withColumn("score", score).where(F.col("score") >= least).groupBy("clean").agg(F.min(place).alias("best")))
    best = F.broadcast(best) if best.count() <= BROADCAST_LABELS else best
    found = h.join(best, "clean").groupBy("id", "depth").agg(F.min("best").alias("best"))
    return found.select("id", "depth", "best.iri", "best.label", "best.branch", (-F.col("best.back")).alias("score"))


def heading_concepts(headings: DataFrame, concepts: DataFrame) -> DataFrame:
    """``headings(id, section_path)`` -> ``id, pos, iri, label, branch, confidence``, the deepest heading first."""
    h = headings.select("id", F.posexplode(F.reverse("section_path")).alias("depth", "text"))
    hit = label_search(h, concepts).withColumn("confidence", fx.heading_confidence(F.col("score"), fx.proximity_weight(F.col("depth")), F.col("depth")))
    return hit.where("confidence is not null").select("id", F.col("depth").alias("pos"), "iri", "label", "branch", "confidence")


def model_concepts(replies: DataFrame) -> DataFrame:
    """``replies(id, concepts json)``, a list of ``concept_text`` and ``confidence`` -> ``id, pos, iri, label, branch,
    confidence``; what can't be read is no concept, and a missing confidence is LLM_CONFIDENCE."""
    said = F.from_json("concepts", "array<struct<concept_text:string,confidence:double>>")
    c = replies.select("id", F.posexplode(said).alias("pos", "c")).where("c.concept_text is not null")
    return c.select("id", "pos", F.lit("").alias("iri"), F.col("c.concept_text").alias("label"), F.lit("").alias("branch"), F.coalesce("c.confidence", F.lit(LLM_CONFIDENCE)).alias("confidence"))


def semantic_concepts(units: DataFrame, concepts: DataFrame) -> DataFrame:
    """``units(id, embedding)``, ``concepts(iri, label, branch, embedding)`` -> ``id, pos, iri, label, branch, confidence``:
    of each unit's SEMANTIC_K nearest concepts those of at least SEMANTIC_MIN."""
    centres = concepts.where("embedding is not null").select(F.col("iri").alias("centre"), F.col("iri").alias("ord"), F.col("embedding").alias("cv"))
    near = nearest(units.where("embedding is not null").select("id", F.col("embedding").alias("v")), centres, SEMANTIC_K).where(F.col("similarity") >= SEMANTIC_MIN)
    named = near.join(concepts.select(F.col("iri").alias("centre"), "label", "branch"), "centre")
    return named.select("id", (F.col("rank") - 1).alias("pos"), F.col("centre").alias("iri"), "label", "branch", F.col("similarity").alias("confidence"))


def label_matches(labels: DataFrame, concepts: DataFrame) -> DataFrame:
    """``labels(label)`` -> the matches that ``resolve`` takes, by the likeness of labels."""
    found = label_search(labels.distinct().select(F.col("label").alias("id"), F.lit(0).alias("depth"), F.col("label").alias("text")), concepts)
    return found.select(F.col("id").alias("label"), F.col("iri").alias("match_iri"), F.col("label").alias("match_label"), F.col("branch").alias("match_branch"), "score")


def as_concepts(rows: DataFrame, name: str) -> DataFrame:
    """``rows(id, pos, iri, label, branch, confidence)`` -> ``id`` and an ordered array."""
    fields = F.struct("pos", F.coalesce("iri", F.lit("")).alias("iri"), F.coalesce("label", F.lit("")).alias("label"), "confidence", F.coalesce("branch", F.lit("")).alias("branch"))
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(fields)).alias(name))


def _tag(c: Column, path: str) -> Column:
    return F.struct(c["iri"].alias("iri"), c["label"].alias("label"), c["confidence"].cast("double").alias("confidence"), F.array(F.lit(path)).alias("contributing_paths"), c["branch"].alias("branch"))


def _add_path(r: Column, by: float, path: str) -> Column:
    paths = F.when(F.array_contains(r["contributing_paths"], path), r["contributing_paths"]).otherwise(F.array_append(r["contributing_paths"], F.lit(path)))
    return F.struct(r["iri"].alias("iri"), r["label"].alias("label"), F.least(F.lit(1.0), r["confidence"] + by).alias("confidence"), paths.alias("contributing_paths"), r["branch"].alias("branch"))


def _first_match(out: Column, hit, last: bool) -> Column:
    """1-based place of the first or last entry that ``hit`` accepts, 0 if none."""
    places = F.transform(out, lambda r, i: F.when(hit(r), i + 1).otherwise(0))
    return F.array_max(places) if last else F.coalesce(F.array_min(F.filter(places, lambda p: p > 0)), F.lit(0))


def _boost_at(out: Column, place: Column, by: float, path: str) -> Column:
    return F.transform(out, lambda r, i: F.when(i + 1 == place, _add_path(r, by, path)).otherwise(r))


def merge_ruler_llm(ruler_: Column, llm: Column) -> Column:
    """All dictionary concepts, then the model's: one of a known IRI adds 0.05 to the first entry of that IRI, others follow."""
    start = F.transform(ruler_, lambda c: _tag(c, "entity_ruler"))

    def step(out: Column, c: Column) -> Column:
        place = _first_match(out, lambda r: (r["iri"] == c["iri"]) & (c["iri"] != ""), last=False)
        return F.when(place > 0, _boost_at(out, place, 0.05, "llm")).otherwise(F.array_append(out, _tag(c, "llm")))

    return F.aggregate(llm, start.cast(f"array<{TAG}>"), step)


def integrate(base: Column, more: Column, path: str, by: float) -> Column:
    """Each concept of ``more``, in order, raises the entry of its IRI, else that of its label, else follows as a new one.
    Of several entries with the same IRI or label the last one counts."""

    def step(out: Column, c: Column) -> Column:
        iri = _first_match(out, lambda r: (r["iri"] == c["iri"]) & (c["iri"] != ""), last=True)
        label = _first_match(out, lambda r: (F.lower(r["label"]) == F.lower(c["label"])) & (c["label"] != ""), last=True)
        place = F.when(F.coalesce(iri, F.lit(0)) > 0, iri).otherwise(F.coalesce(label, F.lit(0)))
        return F.when(place > 0, _boost_at(out, place, by, path)).otherwise(F.array_append(out, _tag(c, path)))

    return F.aggregate(more, base, step)


def reconcile(units: DataFrame) -> DataFrame:
    """``units(id, ruler, llm, semantic, heading)``, arrays of concepts or null -> with ``concepts``, the four paths merged."""
    none = F.array().cast("array<struct<pos:int,iri:string,label:string,confidence:double,branch:string>>")
    c = {p: F.coalesce(F.col(p), none) for p in ("ruler", "llm", "semantic", "heading")}
    out = integrate(integrate(merge_ruler_llm(c["ruler"], c["llm"]), c["semantic"], "semantic", 0.1), c["heading"], "heading_context", 0.05)
    return units.withColumn("concepts", out)


def resolve(tags: DataFrame, matches: DataFrame) -> DataFrame:
    """``tags(id, pos, iri, label, confidence, contributing_paths, branch)``; those without an IRI take that of the best of
    ``matches(label, match_iri, match_label, match_branch, score)`` if it scores 0.6, else they propose a new class."""
    w = Window.partitionBy("label").orderBy(F.desc("score"), "match_iri")
    best = matches.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").where(F.col("score") >= RESOLVE_MIN)
    t = tags.join(best, "label", "left")
    bare, found = F.coalesce(F.col("iri"), F.lit("")) == "", F.col("match_iri").isNotNull()
    return t.select(
        "id",
        "pos",
        F.when(bare & found, F.col("match_iri")).when(bare, "").otherwise(F.col("iri")).alias("iri"),
        F.when(bare & found, F.col("match_label")).otherwise(F.col("label")).alias("label"),
        "confidence",
        F.when(bare & ~found, "proposed_class").otherwise(F.element_at("contributing_paths", 1)).alias("extraction_path"),
        F.when(bare & found, F.col("match_branch")).otherwise(F.col("branch")).alias("branch"),
    )


def proposed_classes(tags: DataFrame) -> DataFrame:
    """``tags(ord, pos, iri, label, confidence)`` -> of the labels that have no IRI the first tag each."""
    first = Window.partitionBy("label").orderBy("ord", "pos")
    p = tags.where("coalesce(iri, '') = '' and label <> ''").withColumn("_r", F.row_number().over(first))
    return p.where("_r = 1").drop("_r")


def unit_confidence(tags: Column, before: Column) -> Column:
    """The largest confidence of the tags; without any, what it was."""
    return F.coalesce(F.array_max(F.transform(tags, lambda t: t["confidence"])), before)
