"""A training corpus in five stages, each from the documents that its predecessor kept.

``STAGES`` lists them; each is written as Parquet and read again before the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorequarry.llm import decontaminate, langid, linededup, mixing, neardup
from lorequarry.llm.workspace import Workspace, scratch


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go. The classifiers learn from the documents' own labels.

    A null text, or one without a letter, goes. A null label teaches nothing; without any label all documents go. Repeated
    rows fare alike. Other columns pass through, whatever their names. An empty table stays empty.
    """
    return langid.keep_identified(docs, langid.fit(langid.training_rows(docs)))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents that had no other line.

    Of similar lines that of the smallest doc_id and place stays; of repeated rows all lose the lines that stand in an
    earlier document. Rows without a doc_id, and null or empty texts, stay as they are. ``n_chars`` follows the text where it
    changed. Other columns pass through, whatever their names. An empty table stays empty.
    """
    return linededup.dedup(docs, drop_empty=True, counts=False)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays, that of the smallest doc_id.

    Rows that repeat a doc_id and text become one. Rows without a doc_id, and null or empty texts, stay. Other columns pass
    through, whatever their names. An empty table stays empty.
    """
    return neardup.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, all rows of their doc_id.

    Rows without a doc_id, and null or empty texts, stay. Other columns pass through, whatever their names. An empty table
    stays empty, and without items all documents stay.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, a row for each.

    A null or empty text has size 0 and is never taken; a null source is a source; rows without a doc_id take part. Ties
    go by doc_id and size. An empty table gives an empty result.
    """
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("lines", dedup_lines),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("mixing", mix_sources),
]

#: SQL can't express the first two stages; tests hold them against plain versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ws = Workspace(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch():
            docs = ws.save(stage(spark, docs, sf_dir), name)
    return docs
