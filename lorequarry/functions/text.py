"""Column functions on texts, labels and scores, each defined once."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Openings that signal a new idea, matched at the start of a text in any case.
TRANSITIONS = [
    "However,", "In contrast,", "Alternatively,", "Note that", "Warning:", "Tip:", "Important:", "Caution:", "But ", "On the other hand,",
    "Conversely,", "Instead,", "Nevertheless,", "Nonetheless,", "Rather,", "Be aware", "Keep in mind", "Remember that", "Practice tip:",
]
# Phrases that make a text depend on a jurisdiction.
JURISDICTION = [
    "in federal court", "in state court", "some states", "varies by state", "varies by jurisdiction", "jurisdictional", "under .{2,30} law",
    "depending on the jurisdiction", "most jurisdictions", "minority of jurisdictions", "federal rules?", "state rules?",
]
# Unit types in display order, and their labels.
TYPE_LABELS = {
    "best_practice": "Best Practices",
    "principle": "Principles",
    "pitfall": "Pitfalls",
    "procedural_rule": "Procedural Rules",
    "citation": "Citations",
    "advice": "Advice",
    "unknown": "Other",
}
#: The types that a classifier may give, the first by default.
UNIT_TYPES = ("advice", "principle", "citation", "procedural_rule", "pitfall")
# Weights of the headings of a path, the deepest first.
PROXIMITY = (1.0, 0.7, 0.4)
HIGH, MEDIUM = 0.8, 0.5

HEADING = r"^(#{1,6})\s+(.+)$"
BULLET = r"^[\s]*[-*+]\s+(.+)$"
NUMBERED = r"^[\s]*\d+\.\s+(.+)$"
TRANSITION = "(?i)^\\s*(?:" + "|".join(TRANSITIONS) + ")"
JURISDICTIONAL = r"(?i)\b(" + "|".join(JURISDICTION) + r")\b"


def strip(text: Column) -> Column:
    """Without white space of any script at either end; ``trim`` takes spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def band(confidence: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    return F.when(confidence >= high, "high").when(confidence >= medium, "medium").otherwise("low")


def review_bucket(confidence: Column, high: float = HIGH, medium: float = MEDIUM) -> Column:
    """Where a unit goes for review."""
    return F.when(confidence >= high, "auto_approved").when(confidence >= medium, "spot_check").otherwise("needs_review")


def edited_label(edited: Column, label: Column) -> Column:
    """The edited label; a missing or empty one falls through."""
    return F.coalesce(F.nullif(edited, F.lit("")), label)


def line_class(line: Column) -> Column:
    """Of a stripped line: heading, list, blank or text."""
    return F.when(line == "", "blank").when(line.rlike(HEADING), "heading").when(line.rlike(BULLET) | line.rlike(NUMBERED), "list").otherwise("text")


def has_transition(text: Column) -> Column:
    return text.rlike(TRANSITION)


def is_jurisdictional(text: Column, pattern: str = JURISDICTIONAL) -> Column:
    return text.rlike(pattern)


def sentences(text: Column) -> Column:
    """Split after a full stop, exclamation or question mark before a capital; blanks are dropped."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+(?=[A-Z])"), strip), lambda s: s != "")


def blocks(text: Column) -> Column:
    """Parts between blank lines."""
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), strip), lambda s: s != "")


def clean_heading(heading: Column) -> Column:
    """Without a chapter prefix and leading section numbers."""
    bare = F.regexp_replace(heading, r"(?i)^(?:Chapter|Section|Part|Appendix)\s+\d+[.:]\s*", "")
    return strip(F.regexp_replace(bare, r"^[\d.]+\s+", ""))


def proximity_weight(depth: Column) -> Column:
    """Of a heading ``depth`` levels above the deepest."""
    return F.element_at(F.array(*map(F.lit, PROXIMITY)), (F.least(depth, F.lit(len(PROXIMITY) - 1)) + 1).cast("int"))


def heading_confidence(score: Column, weight: Column, depth: Column) -> Column:
    """Of a concept found by a heading's text; null drops it."""
    c = F.when(score >= 0.7, score * weight).when(score >= 0.5, score * weight * 0.7).when((depth == 0) & (score >= 0.3), score * weight * 0.5)
    return F.round(c, 3)


def blend(concept: Column, heading: Column, concept_weight: float = 0.7, heading_weight: float = 0.3) -> Column:
    return concept * concept_weight + heading * heading_weight


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def unit_type(reply: Column) -> Column:
    """A classifier's word as a type; anything unknown is advice."""
    word = F.lower(strip(reply))
    return F.when(word.isin(*UNIT_TYPES), word).otherwise(UNIT_TYPES[0])


def breadcrumb(path: Column) -> Column:
    return F.coalesce(F.nullif(F.array_join(path, " > "), F.lit("")), F.lit("N/A"))


def slugify(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def type_label(kind: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(known, kind), F.initcap(F.replace(kind, F.lit("_"), F.lit(" "))))


def type_rank(kind: Column) -> Column:
    """Place in the display order; other types come after."""
    at = F.array_position(F.array(*map(F.lit, TYPE_LABELS)), kind)
    return F.when(at == 0, len(TYPE_LABELS) + 1).otherwise(at)


def content_id(*parts: Column) -> Column:
    """A repeatable id from what a row says: 16 hex digits."""
    return F.substring(F.sha2(F.concat_ws("\n", *parts), 256), 1, 16)


def mint_iri(entity: Column, namespace: str) -> Column:
    """A repeatable IRI: the id's hash in base64, letters and digits only."""
    raw = F.base64(F.unhex(F.substring(F.sha2(entity, 256), 1, 32)))
    return F.concat(F.lit(namespace), F.regexp_replace(raw, "[^A-Za-z0-9]", ""))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; of normalised vectors their cosine."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def first_words(text: Column, n: int = 5, most: int = 60) -> Column:
    """A label from a text: its first words, shortened to ``most`` characters with an ellipsis."""
    label = F.array_join(F.slice(F.split(strip(text), r"\s+"), 1, n), " ")
    return F.when(F.length(label) > most, F.concat(F.substring(label, 1, most - 3), F.lit("..."))).otherwise(label)


def window_of(text: Column, start: Column, end: Column, around: int = 500) -> Column:
    """The text around a span, clamped at both ends."""
    a = F.greatest(F.lit(0), start - around)
    b = F.least(F.length(text), end + around)
    return F.substring(text, a.cast("int") + 1, F.greatest(F.lit(0), b - a).cast("int"))


def span_of(text: Column, start: Column, end: Column) -> Column:
    a = F.greatest(F.lit(0), F.least(F.length(text), start))
    b = F.greatest(a, F.least(F.length(text), end))
    return F.substring(text, a.cast("int") + 1, (b - a).cast("int"))


def heading_trail(text: Column, start: Column) -> Column:
    """All headings above a position, back to the nearest of level 1, in order; siblings included."""
    lines = F.transform(F.split(F.substring(text, F.lit(1), start.cast("int")), "\n"), strip)
    heads = F.filter(lines, lambda x: x.rlike(HEADING))
    last_top = F.aggregate(F.transform(heads, lambda x, i: F.when(x.rlike(r"^#\s"), i + 1).otherwise(0)), F.lit(0), lambda s, v: F.greatest(s, v))
    kept = F.slice(heads, F.greatest(last_top, F.lit(1)), F.greatest(F.size(heads), F.lit(1)))
    return F.transform(kept, lambda x: F.regexp_extract(x, HEADING, 2))
