"""The engine's tables as views over the driver's, in Spark and as DuckDB text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import UNIT_TYPES


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def units(spark: SparkSession, sf: str) -> DataFrame:
    """``ord, id, text, source_file, section_2, confidence, unit_type, content_hash``."""
    i = F.col("doc_id")
    return table(spark, sf, "documents").select(
        i.alias("ord"),
        F.concat(F.lit("unit-"), F.lpad(i.cast("string"), 6, "0")).alias("id"),
        "text",
        F.col("source").alias("source_file"),
        F.col("lang").alias("section_2"),
        (((i * 37) % 101).cast("double") / 100.0).alias("confidence"),
        F.element_at(F.array(*map(F.lit, UNIT_TYPES)), (i % 5 + 1).cast("int")).alias("unit_type"),
        F.sha2("text", 256).alias("content_hash"),
    )


def tags(spark: SparkSession, sf: str) -> DataFrame:
    """Two tags a unit, every tenth unit without; concepts are nations, branches their regions."""
    d = table(spark, sf, "documents").where("doc_id % 10 <> 9").select(F.col("doc_id").alias("ord"), F.explode(F.array(F.lit(0), F.lit(1))).alias("pos"))
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    concepts = n.join(r, n.n_regionkey == r.r_regionkey, "left").select("n_nationkey", "n_name", "r_name")
    key = (F.col("ord") * 7 + F.col("pos") * 11) % 27
    d = d.withColumn("k", key).join(concepts, F.col("k") == F.col("n_nationkey"), "left")
    return d.select(
        "ord",
        "pos",
        F.when(F.col("n_nationkey").isNull(), "").otherwise(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string"))).alias("iri"),
        F.coalesce("n_name", F.concat(F.lit("PROPOSED_"), F.col("k").cast("string"))).alias("label"),
        F.coalesce("r_name", F.lit("")).alias("branch"),
        (((F.col("ord") * 13 + F.col("pos") * 29) % 101).cast("double") / 100.0).alias("confidence"),
    )


def tagged_units(spark: SparkSession, sf: str) -> DataFrame:
    """Units with their tags as an ordered array, empty where there are none."""
    t = tags(spark, sf).groupBy("ord").agg(F.array_sort(F.collect_list(F.struct("pos", "iri", "label", "branch", "confidence"))).alias("tags"))
    return units(spark, sf).join(t, "ord", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<struct<pos:int,iri:string,label:string,branch:string,confidence:double>>")))


def tasks(spark: SparkSession, sf: str) -> DataFrame:
    """``task_id, label, parent_task_id``: a tree of regions, nations and customers."""
    r, n, c = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    key = lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    a = r.select(key("R", "r_regionkey").alias("task_id"), F.col("r_name").alias("label"), F.lit(None).cast("string").alias("parent_task_id"))
    b = n.select(key("N", "n_nationkey"), "n_name", key("R", "n_regionkey"))
    return a.union(b).union(c.select(key("C", "c_custkey"), "c_name", key("N", "c_nationkey")))


def links(spark: SparkSession, sf: str) -> DataFrame:
    """``task_id, unit_ord``; some lead to no unit."""
    o = table(spark, sf, "orders")
    return o.select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("task_id"), ((F.col("o_orderkey") * 3) % 1200).alias("unit_ord")).distinct()


def decisions(spark: SparkSession, sf: str) -> DataFrame:
    """The review log ``event_id, reviewed_at, unit_ord, status``."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("purchase", "error", "click"))
    status = F.when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "error", "rejected").otherwise("edited")
    return e.select("event_id", F.col("ts").alias("reviewed_at"), F.col("user_id").alias("unit_ord"), status.alias("status"))


def outline(spark: SparkSession, sf: str) -> DataFrame:
    """``file_path, seq, text, level``: conversations as documents; level 0 is no heading."""
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2 + F.col("turn") % 3).otherwise(0)
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("file_path"), F.col("turn").alias("seq"), "text", level.cast("int").alias("level"))


# The same as DuckDB text. A query lists the views that it needs.
SQL = {
    "units": """SELECT doc_id AS ord, concat('unit-', lpad(CAST(doc_id AS VARCHAR), 6, '0')) AS id, text, source AS source_file, lang AS section_2,
       CAST((doc_id * 37) % 101 AS DOUBLE) / 100.0 AS confidence,
       CASE doc_id % 5 WHEN 0 THEN 'advice' WHEN 1 THEN 'principle' WHEN 2 THEN 'citation' WHEN 3 THEN 'procedural_rule' ELSE 'pitfall' END AS unit_type,
       sha256(text) AS content_hash FROM documents""",
    "tags": """SELECT d.doc_id AS ord, p.pos, CASE WHEN n.n_nationkey IS NULL THEN '' ELSE concat('nation/', CAST(n.n_nationkey AS VARCHAR)) END AS iri,
       coalesce(n.n_name, concat('PROPOSED_', CAST((d.doc_id * 7 + p.pos * 11) % 27 AS VARCHAR))) AS label, coalesce(r.r_name, '') AS branch,
       CAST((d.doc_id * 13 + p.pos * 29) % 101 AS DOUBLE) / 100.0 AS confidence
FROM documents d CROSS JOIN (VALUES (0), (1)) AS p(pos) LEFT JOIN nation n ON n.n_nationkey = (d.doc_id * 7 + p.pos * 11) % 27
LEFT JOIN region r ON r.r_regionkey = n.n_regionkey WHERE d.doc_id % 10 <> 9""",
    "tasks": """SELECT concat('R', CAST(r_regionkey AS VARCHAR)) AS task_id, r_name AS label, CAST(NULL AS VARCHAR) AS parent_task_id FROM region
UNION ALL SELECT concat('N', CAST(n_nationkey AS VARCHAR)), n_name, concat('R', CAST(n_regionkey AS VARCHAR)) FROM nation
UNION ALL SELECT concat('C', CAST(c_custkey AS VARCHAR)), c_name, concat('N', CAST(c_nationkey AS VARCHAR)) FROM customer""",
    "links": "SELECT DISTINCT concat('C', CAST(o_custkey AS VARCHAR)) AS task_id, (o_orderkey * 3) % 1200 AS unit_ord FROM orders",
    "decisions": """SELECT event_id, ts AS reviewed_at, user_id AS unit_ord,
       CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'edited' END AS status
FROM events WHERE event_type IN ('purchase', 'error', 'click')""",
    "outline": """SELECT conv_id AS file_path, turn AS seq, text, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 + turn % 3 ELSE 0 END AS level
FROM conversations""",
}


def sql(views: str, body: str) -> str:
    """``body`` after the named views."""
    return "WITH RECURSIVE " + ",\n".join(f"{v} AS ({SQL[v]})" for v in views.split()) + "\n" + body
