"""Models behind a common surface. The offline ones are repeatable stand-ins; others are passed in as functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as fx
from .elements import record

BATCH = 15

#: Cases, statutes and reporters; a hit makes a unit a citation.
CITATION = r"\b\d{1,4}\s+(?:U\.S\.|S\.\s?Ct\.|F\.(?:2d|3d|4th)?|F\.\s?Supp\.(?:\s?[23]d)?|[A-Z][a-z]{1,5}\.\s?(?:2d|3d)?)\s+\d{1,5}\b|\b\d+\s+U\.S\.C\.\s+§+\s*\d+|§+\s*\d+(?:\.\d+)*|\bv\.\s+[A-Z]"
# Words by which the offline classifier tells types, the first that matches counts.
RULES = (
    ("pitfall", r"(?i)\b(?:avoid|never|do not|don't|mistake|beware|danger|careful)\b"),
    ("procedural_rule", r"(?i)\b(?:must|shall|required|deadline|within \d+ days|rule \d+)\b"),
    ("principle", r"(?i)\b(?:principle|always|generally|doctrine|purpose)\b"),
)


def classify_by_rules(units: DataFrame) -> DataFrame:
    kind, sure = F.lit("advice"), F.lit(0.5)
    for name, rule in reversed(RULES):
        hit = F.col("text").rlike(rule)
        kind, sure = F.when(hit, name).otherwise(kind), F.when(hit, 0.7).otherwise(sure)
    out = units.withColumn("unit_type", kind).withColumn("confidence", sure.cast("double"))
    return record(out, "knowledge_classifier", "classify", F.col("unit_type"), F.col("confidence")) if "lineage" in units.columns else out


def override_citations(units: DataFrame, pattern: str = CITATION) -> DataFrame:
    hit = F.col("text").rlike(pattern)
    return units.withColumn("unit_type", F.when(hit, "citation").otherwise(F.col("unit_type")))


def map_rows(rows: DataFrame, call: Callable[[list[dict]], list[dict]], schema: str, batch: int = BATCH) -> DataFrame:
    """Rows through a model in batches; ``call`` returns a reply for each. A batch that fails gives rows of nulls besides
    its inputs' ids, which the callers read as "keep what was there"."""
    names = [x.strip().split()[0] for x in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            records = pdf.to_dict("records")
            for i in range(0, len(records), batch):
                part = records[i : i + batch]
                try:
                    replies = call(part)
                    if len(replies) != len(part):
                        raise ValueError("a reply for each row is needed")
                except Exception:  # the model's failure must not end the job
                    replies = [{} for _ in part]
                out += [[r.get(n, x.get(n)) if n == "id" else r.get(n) for n in names] for x, r in zip(part, replies, strict=True)]
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(run, schema)


def embed(rows: DataFrame, call: Callable[[list[dict]], list[dict]], key: str = "id") -> DataFrame:
    """``rows(key, text, ...)`` with ``embedding``, an array of doubles from the replies' ``embedding``; null where the model
    failed. ``key`` tells rows apart."""
    name = F.to_json(F.struct(key))
    got = map_rows(rows.select(name.alias("id"), "text"), call, "id string, embedding array<double>").withColumnRenamed("id", "_id")
    return rows.join(got, name == F.col("_id"), "left").drop("_id")


def distill(units: DataFrame, call: Callable[[list[dict]], list[dict]] | None = None) -> DataFrame:
    """Texts made shorter by a model; an empty or missing reply keeps the text. The hash follows the text."""
    if call is None:
        return units
    got = map_rows(units.select("id", "text"), call, "id string, distilled_text string").withColumnRenamed("id", "_id")
    u = units.join(got, F.col("id") == F.col("_id"), "left").drop("_id")
    new = F.nullif(fx.strip(F.coalesce("distilled_text", F.lit(""))), F.lit(""))
    failed = F.col("distilled_text").isNull()
    u = u.withColumn("_failed", failed).withColumn("text", F.coalesce(new, "text")).withColumn("content_hash", F.sha2("text", 256)).drop("distilled_text")
    if "lineage" in units.columns:
        u = record(u, "distiller", "distill", F.when(F.col("_failed"), "failed").otherwise(F.length("text").cast("string")))
    return u.drop("_failed")


def classify(units: DataFrame, call: Callable[[list[dict]], list[dict]] | None = None) -> DataFrame:
    """Types and confidences by a model, clamped and mapped to the known types; without a reply advice and 0."""
    if call is None:
        return override_citations(classify_by_rules(units))
    got = map_rows(units.select("id", "text"), call, "id string, unit_type string, confidence double").toDF("_id", "_t", "_c")
    u = units.join(got, F.col("id") == F.col("_id"), "left")
    u = u.withColumn("unit_type", F.coalesce(fx.unit_type(F.col("_t")), F.lit("advice"))).withColumn("confidence", fx.clamp(F.coalesce("_c", F.lit(0.0)))).drop("_id", "_t", "_c")
    return override_citations(u)


def novelty(units: DataFrame, call: Callable[[list[dict]], list[dict]] | None = None) -> DataFrame:
    if call is None:
        return units.withColumn("surprise_score", F.lit(0.0))
    got = map_rows(units.select("id", "text"), call, "id string, score double").toDF("_id", "_s")
    return units.join(got, F.col("id") == F.col("_id"), "left").withColumn("surprise_score", fx.clamp(F.coalesce("_s", F.lit(0.0)))).drop("_id", "_s")


def contradictions(pairs: DataFrame, confirm: Callable[[list[dict]], list[dict]] | None = None, keep_unconfirmed: bool = False) -> DataFrame:
    """Screened pairs ``(id, task_id, a, b, text_a, text_b, score)`` read by a second model: its type and explanation.
    Pairs that it doesn't confirm are left out, or kept with ``keep_unconfirmed``."""
    if confirm is None:
        none = F.lit(None).cast("string")
        return pairs.withColumn("contradiction_type", none).withColumn("explanation", none) if keep_unconfirmed else pairs.where(F.lit(False)).withColumn("contradiction_type", none).withColumn("explanation", none)
    got = map_rows(pairs.select("id", "text_a", "text_b"), confirm, "id string, contradiction_type string, explanation string")
    return pairs.join(got, "id", "left") if keep_unconfirmed else pairs.join(got.where("contradiction_type is not null"), "id")


def route(task: str, env: dict[str, str], default: tuple[str, str]) -> tuple[str, str]:
    """Provider and model of a task: its own setting, else the default."""
    key = task.upper()
    return env.get(f"LLM_{key}_PROVIDER", default[0]), env.get(f"LLM_{key}_MODEL", default[1])
