"""Queries over the driver's tables, one for each operator or group of operators, and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import discovery, elements, graph, review, similarity, tagging
from ..operators.lineage import numbered
from ..sources import files as src
from ..streaming import jobs
from . import fixtures as fix

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

MODULE = "https://example.org/modules/knowledge"


def query(views: str = "", sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = fix.sql(views, sql) if views else sql
        return f

    return add


# --- Aggregations over units and tags


@query("units", "SELECT b.band, CAST(count(u.band) AS BIGINT) AS n FROM (VALUES ('high'), ('medium'), ('low')) AS b(band) LEFT JOIN (SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM units) u ON u.band = b.band GROUP BY b.band")
def confidence_bands(spark, sf):
    return review.confidence_bands(fix.units(spark, sf))


@query("units", """, d AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY confidence DESC, ord) AS r FROM units)
SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, unit_type, CAST(count(*) AS BIGINT) AS n FROM d WHERE r = 1 GROUP BY ALL""")
def extraction_summary(spark, sf):
    u = similarity.exact_dedup(fix.units(spark, sf))
    return u.groupBy(fx.band(F.col("confidence")).alias("band"), "unit_type").agg(F.count("*").alias("n"))


@query("units", "SELECT unit_type, CAST(count(*) AS BIGINT) AS n FROM units GROUP BY unit_type")
def unit_type_counts(spark, sf):
    return fix.units(spark, sf).groupBy("unit_type").agg(F.count("*").alias("n"))


@query("tags", "SELECT CAST(count(DISTINCT iri) AS BIGINT) AS n FROM tags WHERE iri <> ''")
def distinct_concepts(spark, sf):
    return fix.tags(spark, sf).where("iri <> ''").agg(F.count_distinct("iri").alias("n"))


@query("units", "SELECT CASE WHEN confidence >= 0.8 THEN 'auto_approved' WHEN confidence >= 0.5 THEN 'spot_check' ELSE 'needs_review' END AS bucket, id FROM units")
def review_buckets(spark, sf):
    return fix.units(spark, sf).select(fx.review_bucket(F.col("confidence")).alias("bucket"), "id")


@query("tags", "SELECT ord, max(confidence) AS confidence, CAST(count(*) AS BIGINT) AS n FROM tags GROUP BY ord")
def unit_confidence(spark, sf):
    u = fix.tagged_units(spark, sf).where(F.size("tags") > 0)
    return u.select("ord", tagging.unit_confidence(F.col("tags"), F.col("confidence")).alias("confidence"), F.size("tags").cast("long").alias("n"))


# --- Deduplication


@query("units", """, g AS (SELECT *, row_number() OVER (PARTITION BY content_hash ORDER BY confidence DESC, ord) AS r, min(ord) OVER (PARTITION BY content_hash) AS f FROM units)
SELECT a.id, a.f AS ord, a.confidence, coalesce(string_agg(b.id, '|' ORDER BY b.r), '') AS refs, CAST(count(b.id) AS BIGINT) AS merged
FROM g a LEFT JOIN g b ON b.content_hash = a.content_hash AND b.r > 1 WHERE a.r = 1 GROUP BY ALL""")
def exact_dedup(spark, sf):
    u = similarity.exact_dedup(fix.units(spark, sf))
    return u.select("id", "ord", "confidence", F.array_join("cross_references", "|").alias("refs"), "merged")


@query()
def near_dedup(spark, sf):
    e = fix.table(spark, sf, "embeddings").select(F.col("vec_id").alias("ord"), F.concat(F.lit("v"), "vec_id").alias("id"), ((F.col("vec_id") * 37 % 101) / 100).alias("confidence"), "embedding")
    return similarity.near_dedup(e, 0.4).select("ord", "id", "confidence", F.array_join("cross_references", "|").alias("refs"))


@query("", "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.35")
def similar_pairs(spark, sf):
    return similarity.similar_pairs(fix.table(spark, sf, "embeddings"), 0.35, key="vec_id").select("a", "b")


@query("", "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.45")
def bucketed_pairs(spark, sf):
    return similarity.bucketed_pairs(fix.table(spark, sf, "embeddings"), 0.45, key="vec_id").select("a", "b")


@query()
def average_linkage(spark, sf):
    return similarity.cluster(fix.table(spark, sf, "embeddings"), 0.6, key="vec_id")


# means of a label's vectors, rounded so that both engines agree on them
_CENTRES = """WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS v FROM embeddings), m AS (SELECT label, i, round(avg(CAST(v AS DOUBLE)), 6) AS v FROM x GROUP BY ALL),
c AS (SELECT label AS centre, list(v ORDER BY i) AS cv FROM m GROUP BY label),
s AS (SELECT e.vec_id AS id, c.centre, CAST(row_number() OVER (PARTITION BY e.vec_id ORDER BY list_dot_product(CAST(e.embedding AS DOUBLE[]), c.cv) DESC, c.centre) AS INTEGER) AS rank FROM embeddings e, c)"""


def _centres(spark, sf):
    x = fix.table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    m = x.groupBy("label", "i").agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("v"))
    c = m.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("a"))
    return c.select(F.col("label").alias("centre"), F.col("label").alias("ord"), F.col("a.v").alias("cv"))


def _vectors(spark, sf):
    return fix.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query("", _CENTRES + " SELECT id, centre FROM s WHERE rank = 1")
def nearest_centroid(spark, sf):
    return similarity.nearest(_vectors(spark, sf), _centres(spark, sf)).select("id", "centre")


@query("", _CENTRES + " SELECT id, centre, rank FROM s WHERE rank <= 5")
def topk_neighbours(spark, sf):
    return similarity.nearest(_vectors(spark, sf), _centres(spark, sf), 5).select("id", "centre", "rank")


@query("", """WITH s AS (SELECT vec_id, vec_id // 8 AS paragraph, vec_id % 8 AS no, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
l AS (SELECT *, lag(v) OVER (PARTITION BY paragraph ORDER BY no) AS p FROM s),
g AS (SELECT *, sum(CASE WHEN p IS NOT NULL AND list_dot_product(p, v) < 0.0 THEN 1 ELSE 0 END) OVER (PARTITION BY paragraph ORDER BY no) AS segment FROM l),
t AS (SELECT paragraph, segment, string_agg(CAST(vec_id AS VARCHAR), ' ' ORDER BY no) AS text, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY ALL)
SELECT paragraph, CAST(segment AS BIGINT) AS segment, text, n FROM (SELECT *, count(*) OVER (PARTITION BY paragraph) AS k FROM t) WHERE k > 1""")
def semantic_segments(spark, sf):
    e = fix.table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 8).alias("paragraph"), (F.col("vec_id") % 8).alias("no"), F.col("vec_id").cast("string").alias("text"), "embedding")
    return elements.semantic_splits(e, 0.0).select("paragraph", F.col("segment").cast("long").alias("segment"), "text", "n")


# --- Concepts and units


@query("units tags", ", t AS (SELECT DISTINCT ord FROM tags WHERE iri = 'nation/7') SELECT u.id, u.unit_type FROM units u JOIN t ON t.ord = u.ord")
def units_by_concept(spark, sf):
    return review.list_units(fix.tagged_units(spark, sf), "nation/7").select("id", "unit_type")


@query("units", "SELECT id FROM units WHERE ord % 10 = 9 AND confidence >= 0.5 AND confidence < 0.8")
def untagged_units(spark, sf):
    return review.list_units(fix.tagged_units(spark, sf), "__untagged__", "medium").select("id")


@query("tags", "SELECT iri, arg_min(label, ord * 10 + pos) AS label, arg_min(branch, ord * 10 + pos) AS branch, CAST(count(*) AS BIGINT) AS n FROM tags GROUP BY iri")
def concept_flat(spark, sf):
    return review.concept_counts(fix.tags(spark, sf))


@query("units tags", """, c AS (SELECT iri, arg_min(label, ord * 10 + pos) AS label, coalesce(nullif(arg_min(branch, ord * 10 + pos), ''), 'Uncategorized') AS branch, count(*) AS n FROM tags GROUP BY iri)
SELECT 'concept' AS kind, iri AS id, label, branch, CAST(n AS BIGINT) AS n FROM c
UNION ALL SELECT 'branch', branch, branch, branch, CAST(sum(n) AS BIGINT) FROM c GROUP BY branch
UNION ALL SELECT 'virtual', '__all__', 'All Units', '', (SELECT count(*) FROM units)
UNION ALL SELECT 'virtual', '__untagged__', 'Untagged', '', (SELECT count(*) FROM units) - (SELECT count(DISTINCT ord) FROM tags)""")
def concept_tree(spark, sf):
    return review.concept_tree(fix.tags(spark, sf), fix.units(spark, sf))


@query("tags", ", p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY ord, pos) AS r FROM tags WHERE iri = '' AND label <> '') SELECT label, ord, confidence FROM p WHERE r = 1")
def proposed_classes(spark, sf):
    return tagging.proposed_classes(fix.tags(spark, sf)).select("label", "ord", "confidence")


# --- Review


@query("units decisions", """, l AS (SELECT *, row_number() OVER (PARTITION BY unit_ord ORDER BY reviewed_at DESC, event_id DESC) AS r FROM decisions)
SELECT u.id, coalesce(l.status, 'unreviewed') AS review_status FROM units u LEFT JOIN l ON l.unit_ord = u.ord AND l.r = 1""")
def review_state(spark, sf):
    last = review.latest(fix.decisions(spark, sf), ["unit_ord"], "reviewed_at", "event_id")
    u = fix.units(spark, sf)
    d = last.join(u.select("ord", "id"), F.col("unit_ord") == F.col("ord")).select("id", "status")
    return review.with_review(u, d).select("id", "review_status")


_STATS = """, l AS (SELECT *, row_number() OVER (PARTITION BY unit_ord ORDER BY reviewed_at DESC, event_id DESC) AS r FROM decisions), d AS (SELECT * FROM l WHERE r = 1)
SELECT (SELECT count(*) FROM units) AS total, (SELECT count(*) FROM units WHERE confidence >= 0.8) AS high_confidence, (SELECT count(*) FROM units WHERE confidence >= 0.5 AND confidence < 0.8) AS medium_confidence,
(SELECT count(*) FROM units WHERE confidence < 0.5) AS low_confidence, (SELECT count(*) FROM d WHERE status = 'approved') AS approved, (SELECT count(*) FROM d WHERE status = 'rejected') AS rejected,
(SELECT count(*) FROM d WHERE status = 'edited') AS edited, (SELECT count(*) FROM units) - (SELECT count(*) FROM d) AS unreviewed"""


@query("units decisions", _STATS)
def review_stats(spark, sf):
    return review.review_stats(fix.units(spark, sf), review.latest(fix.decisions(spark, sf), ["unit_ord"], "reviewed_at", "event_id"))


@query("units decisions", """, l AS (SELECT unit_ord, status, reviewed_at, event_id FROM decisions UNION ALL SELECT ord, 'approved', TIMESTAMP '2030-01-01', -1 FROM units WHERE confidence >= 0.8),
r AS (SELECT *, row_number() OVER (PARTITION BY unit_ord ORDER BY reviewed_at DESC, event_id DESC) AS r FROM l) SELECT status, CAST(count(*) AS BIGINT) AS n FROM r WHERE r = 1 GROUP BY status""")
def bulk_approve_high(spark, sf):
    u = fix.units(spark, sf)
    rows = review.bulk_approve(u, F.lit("2030-01-01").cast("timestamp_ntz").cast("timestamp"), least=0.8)
    d = fix.decisions(spark, sf)
    new = rows.join(u.select("id", "ord"), "id").select(F.lit(-1).cast("long").alias("event_id"), F.col("reviewed_at").cast(d.schema["reviewed_at"].dataType).alias("reviewed_at"), F.col("ord").alias("unit_ord"), "status")
    return review.latest(review.append(d, new), ["unit_ord"], "reviewed_at", "event_id").groupBy("status").agg(F.count("*").alias("n"))


# --- Tasks


def _links(spark, sf):
    """Links by unit id; those to no unit keep a made-up id."""
    return fix.links(spark, sf).withColumn("unit_id", F.concat(F.lit("unit-"), F.lpad(F.col("unit_ord").cast("string"), 6, "0")))


def _contradictions(spark, sf):
    """A stand-in: orders of high priority as contradictions of the customers' tasks, resolved where the order is done."""
    o = fix.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    done = F.when(F.col("o_orderstatus") == "F", "keep_both")
    return o.select(F.col("o_orderkey").alias("contradiction_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("task_id"), done.alias("resolution"))


_CONTRA = "c AS (SELECT o_orderkey AS contradiction_id, concat('C', CAST(o_custkey AS VARCHAR)) AS task_id, CASE WHEN o_orderstatus = 'F' THEN 'keep_both' END AS resolution FROM orders WHERE o_orderpriority = '1-URGENT')"


@query("tasks links", f""", {_CONTRA} SELECT t.task_id, t.label, t.parent_task_id, CAST(coalesce(u.n, 0) AS BIGINT) AS unit_count, CAST(coalesce(x.n, 0) AS BIGINT) AS contradiction_count FROM tasks t
LEFT JOIN (SELECT task_id, count(*) AS n FROM links GROUP BY task_id) u ON u.task_id = t.task_id
LEFT JOIN (SELECT task_id, count(*) AS n FROM c WHERE resolution IS NULL GROUP BY task_id) x ON x.task_id = t.task_id""")
def task_tree_counts(spark, sf):
    return review.task_list(fix.tasks(spark, sf), _links(spark, sf), _contradictions(spark, sf))


@query("tasks", """, d AS (SELECT task_id, 0 AS depth, task_id AS root, task_id AS path FROM tasks WHERE parent_task_id IS NULL
UNION ALL SELECT t.task_id, d.depth + 1, d.root, concat(d.path, '/', t.task_id) FROM tasks t JOIN d ON t.parent_task_id = d.task_id) SELECT * FROM d""")
def task_depth(spark, sf):
    return discovery.depths(fix.tasks(spark, sf)).select("task_id", "depth", "root", F.array_join("path", "/").alias("path"))


@query("tasks units links", "SELECT l.task_id, t.label, u.id, u.unit_type, u.confidence FROM links l JOIN tasks t ON t.task_id = l.task_id JOIN units u ON u.ord = l.unit_ord")
def task_units(spark, sf):
    u = fix.units(spark, sf)
    return _links(spark, sf).join(fix.tasks(spark, sf), "task_id").join(u.withColumnRenamed("id", "unit_id"), "unit_id").select("task_id", "label", F.col("unit_id").alias("id"), "unit_type", "confidence")


@query("units links", "SELECT id FROM units WHERE ord NOT IN (SELECT unit_ord FROM links)")
def orphan_units(spark, sf):
    return discovery.orphans(fix.units(spark, sf), _links(spark, sf)).select("id")


@query("units links", "SELECT CAST(count(*) AS BIGINT) AS n FROM links l LEFT JOIN units u ON u.ord = l.unit_ord WHERE u.ord IS NULL")
def dangling_links(spark, sf):
    return _links(spark, sf).join(fix.units(spark, sf).select(F.col("id").alias("unit_id")), "unit_id", "left_anti").agg(F.count("*").alias("n"))


@query("units tasks links decisions", f""", {_CONTRA}, s AS (SELECT task_id, parent_task_id, CASE WHEN ascii(right(task_id, 1)) % 3 = 0 THEN 'approved' ELSE 'unreviewed' END AS status FROM tasks)
SELECT (SELECT count(*) FROM s) AS total_tasks, (SELECT count(*) FROM s WHERE parent_task_id IS NOT NULL) AS subtasks, (SELECT count(*) FROM s WHERE status <> 'unreviewed') AS reviewed,
(SELECT count(DISTINCT unit_ord) FROM links) AS assigned_units, (SELECT count(*) FROM c) AS contradictions, (SELECT count(*) FROM c WHERE resolution IS NOT NULL) AS resolved,
(SELECT count(*) FROM units WHERE ord NOT IN (SELECT unit_ord FROM links)) AS orphan_units,
round((SELECT count(*) FROM s WHERE status <> 'unreviewed') / (SELECT count(*) FROM s) * 100.0, 1) AS review_progress""")
def discovery_stats(spark, sf):
    t = fix.tasks(spark, sf).withColumn("status", F.when(F.ascii(F.right("task_id", F.lit(1))) % 3 == 0, "approved").otherwise("unreviewed"))
    return review.discovery_stats(t, _links(spark, sf), fix.units(spark, sf), _contradictions(spark, sf))


@query("units links", "SELECT unit_type, CAST(count(*) AS BIGINT) AS n FROM units WHERE ord IN (SELECT unit_ord FROM links) GROUP BY unit_type")
def assigned_by_type(spark, sf):
    return review.assigned_counts(fix.units(spark, sf), _links(spark, sf), "unit_type")


@query("units links", "SELECT source_file, CAST(count(*) AS BIGINT) AS n FROM units WHERE ord IN (SELECT unit_ord FROM links) GROUP BY source_file")
def source_coverage(spark, sf):
    return review.assigned_counts(fix.units(spark, sf), _links(spark, sf), "source_file")


@query("units links", "SELECT l.task_id, u.unit_type, CAST(count(*) AS BIGINT) AS n FROM links l JOIN units u ON u.ord = l.unit_ord GROUP BY ALL")
def task_type_counts(spark, sf):
    return discovery.type_counts(_links(spark, sf), fix.units(spark, sf))


@query("units links", r", p AS (SELECT l.task_id, regexp_matches(u.text, '(?i)\b(stupid|idiot|token)\b') AS j FROM links l JOIN units u ON u.ord = l.unit_ord) SELECT task_id, CAST(bool_or(j) AS INTEGER) AS flag FROM p GROUP BY task_id")
def jurisdiction_flag(spark, sf):
    """The phrases looked for don't occur in the driver's prose; other words take their place."""
    f = discovery.jurisdiction_flags(_links(spark, sf), fix.units(spark, sf), r"(?i)\b(stupid|idiot|token)\b")
    return f.select("task_id", F.col("jurisdiction_sensitive").cast("int").alias("flag"))


@query("units links", ", k AS (SELECT l.task_id, u.id, u.ord FROM links l JOIN units u ON u.ord = l.unit_ord) SELECT a.task_id, a.id AS a, b.id AS b FROM k a JOIN k b ON a.task_id = b.task_id AND a.ord < b.ord")
def contradiction_pairs(spark, sf):
    return discovery.unit_pairs(_links(spark, sf), fix.units(spark, sf))


@query("tasks", f""", {_CONTRA} SELECT contradiction_id, task_id FROM c WHERE resolution IS NULL""")
def unresolved_contradictions(spark, sf):
    return review.contradiction_list(_contradictions(spark, sf), "unresolved").select("contradiction_id", "task_id")


# --- Discovery


@query("units", """SELECT section_2 AS label, concat(source_file, '>', section_2) AS path, CAST(count(*) AS BIGINT) AS n, min(ord) AS first, CAST(0.7 AS DOUBLE) AS confidence, string_agg(id, '|' ORDER BY ord) AS unit_ids
FROM units GROUP BY source_file, section_2 HAVING count(*) >= 2""")
def heading_candidates(spark, sf):
    u = fix.units(spark, sf).withColumn("source_section", F.array("source_file", "section_2"))
    c = discovery.heading_candidates(u)
    return c.select("label", F.array_join("heading_path", ">").alias("path"), F.size("unit_ids").cast("long").alias("n"), "first", "confidence", F.array_join("unit_ids", "|").alias("unit_ids"))


_CT = ", t AS (SELECT u.source_file AS candidate, t.ord * 10 + t.pos AS pos, t.iri, t.label, t.confidence FROM tags t JOIN units u ON u.ord = t.ord)"


@query("units tags", _CT + """, n AS (SELECT candidate, iri, count(*) AS n, min(pos) AS first, arg_max(label, pos) AS label FROM t GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY candidate ORDER BY n DESC, first) AS r FROM n)
SELECT r.candidate, r.iri, r.label, CAST(r.n AS BIGINT) AS n, round((SELECT avg(confidence) FROM t WHERE t.candidate = r.candidate), 6) AS mean_confidence FROM r WHERE r = 1""")
def concept_mode(spark, sf):
    t = fix.tags(spark, sf).join(fix.units(spark, sf).select("ord", F.col("source_file").alias("candidate")), "ord")
    m = discovery.concept_mode(t.select("candidate", (F.col("ord") * 10 + F.col("pos")).alias("pos"), "iri", "label", "confidence"))
    return m.withColumn("mean_confidence", F.round("mean_confidence", 6))


@query("units", """, c AS (SELECT CAST(row_number() OVER (ORDER BY source_file, section_2) AS BIGINT) AS ord, section_2 AS label FROM (SELECT DISTINCT source_file, section_2 FROM units)),
r AS (SELECT *, row_number() OVER (PARTITION BY lower(label) ORDER BY ord) AS r FROM c) SELECT label, ord FROM r WHERE r = 1""")
def tasks_from_candidates(spark, sf):
    c = fix.units(spark, sf).select("source_file", "section_2").distinct()
    c = numbered(c, "source_file", "section_2").select("ord", F.col("section_2").alias("label"))
    return discovery.to_tasks(c).select("label", "ord")


@query("", """WITH p AS (SELECT r_name AS a, n_name AS b, c_name AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
t AS (SELECT DISTINCT a AS path, 1 AS k FROM p UNION SELECT DISTINCT concat(a, '>', b, '>', c), 3 FROM p UNION SELECT DISTINCT concat(a, '>', b), 2 FROM p WHERE length(b) % 2 = 0)
SELECT t.path AS task_id, arg_max(u.path, u.k) AS parent_task_id FROM t JOIN t u ON u.k < t.k AND starts_with(t.path, concat(u.path, '>')) GROUP BY t.path""")
def heading_parents(spark, sf):
    c, n, r = (fix.table(spark, sf, t) for t in ("customer", "nation", "region"))
    p = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select("r_name", "n_name", "c_name")
    t = p.select(F.array("r_name").alias("heading_path")).union(p.select(F.array("r_name", "n_name", "c_name"))).union(p.where(F.length("n_name") % 2 == 0).select(F.array("r_name", "n_name"))).distinct()
    t = t.withColumn("task_id", F.array_join("heading_path", ">")).withColumn("ord", F.xxhash64("task_id"))
    return discovery.heading_parents(t)


def _snapshots(spark, sf):
    k = F.col("c_custkey")
    t = fix.table(spark, sf, "customer").select(F.concat(F.lit("C"), k.cast("string")).alias("task_id"), F.col("c_name").alias("label"), F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("parent_task_id"), k.alias("k"))
    before = t.where("k % 11 <> 0").select("task_id", "label", "parent_task_id", F.concat(F.lit("iri/"), F.col("k").cast("string")).alias("iri"), (F.col("k") % 4).alias("n_units"))
    after = t.where("k % 13 <> 0").select(
        "task_id",
        F.when(F.col("k") % 17 == 0, F.concat("label", F.lit("*"))).otherwise(F.col("label")).alias("label"),
        F.when(F.col("k") % 19 == 0, F.lit(None)).otherwise(F.col("parent_task_id")).alias("parent_task_id"),
        F.concat(F.lit("iri/"), F.when(F.col("k") % 23 == 0, F.lit("x")).otherwise(F.col("k").cast("string"))).alias("iri"),
        (F.col("k") % 5).alias("n_units"),
    )
    return before, after


@query()
def task_diff(spark, sf):
    return discovery.task_diff(*_snapshots(spark, sf))


ORACLES["task_diff"] = """WITH b AS (SELECT c_custkey AS k, concat('C', CAST(c_custkey AS VARCHAR)) AS task_id, c_name AS label, concat('N', CAST(c_nationkey AS VARCHAR)) AS parent, concat('iri/', CAST(c_custkey AS VARCHAR)) AS iri, c_custkey % 4 AS n FROM customer WHERE c_custkey % 11 <> 0),
a AS (SELECT c_custkey AS k, concat('C', CAST(c_custkey AS VARCHAR)) AS task_id, CASE WHEN c_custkey % 17 = 0 THEN concat(c_name, '*') ELSE c_name END AS label,
CASE WHEN c_custkey % 19 <> 0 THEN concat('N', CAST(c_nationkey AS VARCHAR)) END AS parent, concat('iri/', CASE WHEN c_custkey % 23 = 0 THEN 'x' ELSE CAST(c_custkey AS VARCHAR) END) AS iri, c_custkey % 5 AS n FROM customer WHERE c_custkey % 13 <> 0),
j AS (SELECT coalesce(a.task_id, b.task_id) AS task_id, a.task_id AS a_id, b.task_id AS b_id, a.label AS al, b.label AS bl, a.parent AS ap, b.parent AS bp, a.iri AS ai, b.iri AS bi, a.n AS an, b.n AS bn FROM a FULL JOIN b ON a.task_id = b.task_id)
SELECT task_id, 'added' AS change, concat('New task: ', al) AS description FROM j WHERE b_id IS NULL
UNION ALL SELECT task_id, 'removed', concat('Task removed: ', bl) FROM j WHERE a_id IS NULL
UNION ALL SELECT task_id, 'changed', concat('Label changed: ''', bl, ''' -> ''', al, '''') FROM j WHERE a_id IS NOT NULL AND b_id IS NOT NULL AND al <> bl
UNION ALL SELECT task_id, 'changed', concat('Parent changed for: ', al) FROM j WHERE a_id IS NOT NULL AND b_id IS NOT NULL AND ap IS DISTINCT FROM bp
UNION ALL SELECT task_id, 'changed', concat('Concept changed for: ', al) FROM j WHERE a_id IS NOT NULL AND b_id IS NOT NULL AND ai <> bi
UNION ALL SELECT task_id, 'changed', concat(CAST(an - bn AS VARCHAR), ' units added to: ', al) FROM j WHERE an > 0 AND bn > 0 AND an > bn
UNION ALL SELECT task_id, 'changed', concat(CAST(bn - an AS VARCHAR), ' units removed from: ', al) FROM j WHERE an > 0 AND bn > 0 AND an < bn"""


@query()
def merged_tasks(spark, sf):
    """Merges by concept, then by similar labels, settled in order and applied."""
    t = fix.table(spark, sf, "embeddings").select(F.concat(F.lit("T"), "vec_id").alias("task_id"), F.col("vec_id").alias("ord"), F.when(F.col("vec_id") % 9 == 0, F.concat(F.lit("c/"), F.col("label"))).otherwise("").alias("iri"), (F.col("vec_id") * 37 % 101 / 100).alias("confidence"), F.concat(F.lit("f"), F.col("vec_id") % 5).alias("source_file"), "embedding")
    a = discovery.iri_merges(t).withColumn("stage", F.lit(0))
    b = discovery.label_merges(t, t.select("ord", "embedding"), 0.4).withColumn("stage", F.lit(1))
    return discovery.settle_merges(a.unionByName(b).select("stage", "first", "ord", "canonical", "merged"))


@query("", """WITH t AS (SELECT vec_id, CASE WHEN vec_id % 9 = 0 THEN concat('c/', CAST(label AS VARCHAR)) ELSE '' END AS iri, (vec_id * 37 % 101) / 100.0 AS confidence, vec_id % 5 AS f FROM embeddings),
g AS (SELECT iri, count(DISTINCT f) AS files, count(*) AS n FROM t WHERE iri <> '' GROUP BY iri),
r AS (SELECT t.*, first_value(vec_id) OVER (PARTITION BY t.iri ORDER BY confidence DESC, vec_id) AS c FROM t JOIN g ON g.iri = t.iri WHERE n > 1 AND files >= 2)
SELECT concat('T', CAST(c AS VARCHAR)) AS canonical, concat('T', CAST(vec_id AS VARCHAR)) AS merged FROM r WHERE vec_id <> c""")
def iri_merges(spark, sf):
    t = fix.table(spark, sf, "embeddings").select(F.concat(F.lit("T"), F.col("vec_id").cast("string")).alias("task_id"), F.col("vec_id").alias("ord"), F.when(F.col("vec_id") % 9 == 0, F.concat(F.lit("c/"), F.col("label").cast("string"))).otherwise("").alias("iri"), (F.col("vec_id") * 37 % 101 / 100).alias("confidence"), (F.col("vec_id") % 5).cast("string").alias("source_file"))
    return discovery.iri_merges(t).select("canonical", "merged")


# --- Documents


@query("outline", """, l AS (SELECT *, max(CASE WHEN level = 1 THEN seq END) OVER w AS q1, max(CASE WHEN level = 2 THEN seq END) OVER w AS q2, max(CASE WHEN level = 3 THEN seq END) OVER w AS q3, max(CASE WHEN level = 4 THEN seq END) OVER w AS q4
FROM outline WINDOW w AS (PARTITION BY file_path ORDER BY seq ROWS UNBOUNDED PRECEDING)),
a AS (SELECT file_path, seq, q1, CASE WHEN q2 > coalesce(q1, -1) THEN q2 END AS a2, CASE WHEN q3 > greatest(coalesce(q1, -1), coalesce(q2, -1)) THEN q3 END AS a3, CASE WHEN q4 > greatest(coalesce(q1, -1), coalesce(q2, -1), coalesce(q3, -1)) THEN q4 END AS a4 FROM l)
SELECT a.file_path, a.seq, concat_ws(' > ', o1.text, o2.text, o3.text, o4.text) AS path FROM a LEFT JOIN outline o1 ON o1.file_path = a.file_path AND o1.seq = a.q1 LEFT JOIN outline o2 ON o2.file_path = a.file_path AND o2.seq = a.a2
LEFT JOIN outline o3 ON o3.file_path = a.file_path AND o3.seq = a.a3 LEFT JOIN outline o4 ON o4.file_path = a.file_path AND o4.seq = a.a4""")
def section_paths(spark, sf):
    return elements.section_paths(fix.outline(spark, sf)).select("file_path", "seq", F.array_join("section_path", " > ").alias("path"))


@query("outline", """SELECT file_path, seq, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY file_path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a,
CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY file_path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) AS BIGINT) AS b FROM outline""")
def char_offsets(spark, sf):
    return elements.char_offsets(fix.outline(spark, sf)).select("file_path", "seq", F.col("char_offset_start").alias("a"), F.col("char_offset_end").alias("b"))


@query("outline", """, k AS (SELECT *, level > 0 AS kind FROM outline), s AS (SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY file_path ORDER BY seq) = kind THEN 0 ELSE 1 END AS n FROM k),
g AS (SELECT *, sum(n) OVER (PARTITION BY file_path ORDER BY seq) AS island FROM s)
SELECT file_path, CAST(island AS BIGINT) AS island, min(seq) AS first, max(seq) AS last, CAST(count(*) AS BIGINT) AS n, md5(string_agg(text, chr(10) ORDER BY seq)) AS digest FROM g GROUP BY file_path, island""")
def paragraph_islands(spark, sf):
    m = elements.merge_runs(fix.outline(spark, sf), "file_path", "seq", F.col("level") > 0, "text")
    return m.select("file_path", F.col("island").cast("long").alias("island"), "first", "last", "n", F.md5("text").alias("digest"))


def _lines(spark, sf):
    d = fix.table(spark, sf, "documents").select(F.col("doc_id").alias("file_path"), F.posexplode(F.split("text", "\n")).alias("seq", "text"))
    e = d.withColumn("text", fx.strip(F.col("text"))).where("text <> ''").withColumn("element_type", F.lit("paragraph")).withColumn("level", F.lit(0)).withColumn("section_path", F.array().cast("array<string>"))
    return elements.char_offsets(e)


_TRANS = r"(?i)^\s*(?:However,|In contrast,|Alternatively,|Note that|Warning:|Tip:|Important:|Caution:|But |On the other hand,|Conversely,|Instead,|Nevertheless,|Nonetheless,|Rather,|Be aware|Keep in mind|Remember that|Practice tip:)"
_LINES = """WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
l AS (SELECT doc_id AS file_path, seq, trim(line, ' ' || chr(9) || chr(13)) AS text FROM x WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''),
o AS (SELECT *, coalesce(sum(length(text) + 1) OVER (PARTITION BY file_path ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM l)"""


@query("", _LINES + rf""" SELECT file_path, CAST(seq AS INTEGER) AS seq, CAST(a AS BIGINT) AS a, CAST(a + length(text) AS BIGINT) AS b, CASE WHEN regexp_matches(text, '{_TRANS}') THEN CAST(0.8 AS DOUBLE) ELSE 0.7 END AS confidence,
CASE WHEN regexp_matches(text, '{_TRANS}') THEN 'structural_transition' ELSE 'structural_paragraph' END AS method FROM o""")
def structural_boundaries(spark, sf):
    b = elements.structural_boundaries(_lines(spark, sf))
    return b.select("file_path", "seq", F.col("start").cast("long").alias("a"), F.col("end").cast("long").alias("b"), "confidence", "method")


@query("", _LINES + rf" SELECT file_path, CAST(seq AS INTEGER) AS seq FROM o WHERE length(text) > 500 AND NOT regexp_matches(text, '{_TRANS}')")
def ambiguous_boundaries(spark, sf):
    b = elements.structural_boundaries(_lines(spark, sf))
    return b.where(elements.ambiguous(b)).select("file_path", "seq")


@query("", r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS s FROM documents)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(trim(s, ' ' || chr(9) || chr(10) || chr(13)))) AS BIGINT) AS chars FROM s WHERE trim(s, ' ' || chr(9) || chr(10) || chr(13)) <> '' GROUP BY doc_id""")
def sentence_split(spark, sf):
    s = fix.table(spark, sf, "documents").select("doc_id", F.explode(fx.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"))


@query("", _LINES + " SELECT sha256(concat(CAST(file_path AS VARCHAR), chr(10), CAST(CAST(a AS BIGINT) AS VARCHAR), chr(10), CAST(CAST(a + length(text) AS BIGINT) AS VARCHAR), chr(10), text))[1:16] AS id, sha256(text) AS content_hash FROM o WHERE length(text) >= 10")
def knowledge_units(spark, sf):
    b = elements.structural_boundaries(_lines(spark, sf)).withColumn("file_path", F.col("file_path").cast("string"))
    return elements.knowledge_units(b).select("id", "content_hash")


@query("", r"""WITH c AS (SELECT conv_id AS file_path, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS no, trim(concat(CASE role WHEN 'system' THEN '# ' WHEN 'user' THEN '- ' ELSE '' END, replace(text, chr(10), ' '))) AS line FROM conversations),
k AS (SELECT *, CASE WHEN line = '' THEN 'blank' WHEN regexp_matches(line, '^#{1,6}\s+.+$') THEN 'heading' WHEN regexp_matches(line, '^([-*+]|\d+\.)\s+.+$') THEN 'list_item' ELSE 'paragraph' END AS kind FROM c),
s AS (SELECT *, CASE WHEN kind <> 'paragraph' OR coalesce(lag(kind) OVER w, 'blank') <> 'paragraph' THEN 1 ELSE 0 END AS first FROM k WINDOW w AS (PARTITION BY file_path ORDER BY no)),
r AS (SELECT *, sum(first) OVER (PARTITION BY file_path ORDER BY no) AS run FROM s),
e AS (SELECT file_path, run, kind, min(no) AS no, string_agg(line, chr(10) ORDER BY no) AS raw FROM r WHERE kind <> 'blank' GROUP BY file_path, run, kind)
SELECT file_path, CAST(row_number() OVER (PARTITION BY file_path ORDER BY no) - 1 AS INTEGER) AS seq, trim(CASE kind WHEN 'heading' THEN regexp_replace(raw, '^#{1,6}\s+', '') WHEN 'list_item' THEN regexp_replace(raw, '^([-*+]|\d+\.)\s+', '') ELSE raw END) AS text,
kind AS element_type, CAST(CASE kind WHEN 'heading' THEN length(regexp_extract(raw, '^#{1,6}')) ELSE 0 END AS INTEGER) AS level FROM e""".replace("\\\\", "\\"))
def markdown_elements(spark, sf):
    """Conversations as Markdown: the system's text a heading, the user's a list item, the assistant's a paragraph."""
    c = fix.table(spark, sf, "conversations")
    line = F.concat(F.when(F.col("role") == "system", "# ").when(F.col("role") == "user", "- ").otherwise(""), F.replace("text", F.lit("\n"), F.lit(" ")))
    d = c.withColumn("line", line).groupBy(F.col("conv_id").alias("file_path")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return elements.markdown_elements(d)


@query("", """WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS part FROM documents), s AS (SELECT doc_id, trim(part, ' ' || chr(9) || chr(10) || chr(13)) AS t FROM p)
SELECT doc_id AS file_path, CAST(count(*) AS BIGINT) AS n, CAST(sum(length(t)) AS BIGINT) AS chars FROM s WHERE t <> '' GROUP BY doc_id""")
def plain_elements(spark, sf):
    e = elements.plain_elements(fix.table(spark, sf, "documents").select(F.col("doc_id").alias("file_path"), "text"))
    return e.groupBy("file_path").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query()
def html_elements(spark, sf):
    p = fix.table(spark, sf, "pages").select(F.col("url").alias("file_path"), F.lit(".html").alias("suffix"), F.encode("html", "UTF-8").alias("content"))
    return src.parse_binary(p).select("file_path", "seq", "text", "element_type", "level")


@query("", """SELECT concat(source, '/', CAST(doc_id AS VARCHAR)) AS file_path, sha256(text) AS content_hash FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0""")
def new_files(spark, sf):
    """A registry that lacks some documents and has an old hash of others."""
    d = fix.table(spark, sf, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file_path"), F.sha2("text", 256).alias("content_hash"), "doc_id")
    old = d.where("doc_id % 7 <> 0").select("file_path", F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("content_hash")).alias("content_hash"))
    return src.needs_processing(d, old).select("file_path", "content_hash")


@query("", r"""SELECT c_custkey, regexp_replace(regexp_replace(lower(concat(c_name, ' / ', c_mktsegment)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM customer""")
def slugs(spark, sf):
    return fix.table(spark, sf, "customer").select("c_custkey", fx.slugify(F.concat_ws(" / ", "c_name", "c_mktsegment")).alias("slug"))


@query("", """SELECT doc_id, text[greatest(0, (doc_id * 13) % 900 - 500) + 1 : least(length(text), (doc_id * 13) % 900 + 40 + 500)] AS context FROM documents""")
def source_windows(spark, sf):
    at = (F.col("doc_id") * 13) % 900
    return fix.table(spark, sf, "documents").select("doc_id", fx.window_of(F.col("text"), at, at + 40).alias("context"))


@query("units", r"""SELECT id, CASE WHEN length(w) > 60 THEN concat(w[1:57], '...') ELSE w END AS label FROM (SELECT id, array_to_string(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\s+')[1:5], ' ') AS w FROM units)""")
def fallback_labels(spark, sf):
    return fix.units(spark, sf).select("id", fx.first_words(F.col("text")).alias("label"))


# --- Tagging


# a concept a step: the model's tags look for the first entry of their IRI, later paths for the last one, then for the label
@query("tags", """, i AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY path, p) AS n FROM (SELECT CAST(floor(ord / 4.0) AS BIGINT) AS id, (ord + pos) % 4 AS path, ord * 10 + pos AS p, iri, label, confidence, branch FROM tags) x),
r AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS n, CAST([] AS STRUCT(iri VARCHAR, label VARCHAR, confidence DOUBLE, paths VARCHAR[], branch VARCHAR)[]) AS o FROM i
UNION ALL SELECT id, n, CASE WHEN place = 0 THEN list_append(o, {'iri': iri, 'label': label, 'confidence': confidence, 'paths': [name], 'branch': branch})
    ELSE list_transform(o, lambda e, k: CASE WHEN k = place THEN {'iri': e.iri, 'label': e.label, 'confidence': least(1.0, e.confidence + more), 'paths': CASE WHEN list_contains(e.paths, name) THEN e.paths ELSE list_append(e.paths, name) END, 'branch': e.branch} ELSE e END) END
  FROM (SELECT *, ['entity_ruler', 'llm', 'semantic', 'heading_context'][path + 1] AS name, [0.0, 0.05, 0.1, 0.05][path + 1] AS more,
      CASE WHEN path = 0 THEN 0 WHEN path = 1 THEN coalesce(list_min(same), 0) ELSE coalesce(list_max(same), list_max(named), 0) END AS place
    FROM (SELECT i.*, r.o, list_filter(list_transform(r.o, lambda e, k: CASE WHEN e.iri = i.iri AND i.iri <> '' THEN k END), lambda k: k IS NOT NULL) AS same,
        list_filter(list_transform(r.o, lambda e, k: CASE WHEN lower(e.label) = lower(i.label) AND i.label <> '' THEN k END), lambda k: k IS NOT NULL) AS named
      FROM r JOIN i ON i.id = r.id AND i.n = r.n + 1) a) b),
f AS (SELECT id, arg_max(o, n) AS o FROM r GROUP BY id),
g AS (SELECT id, generate_subscripts(o, 1) AS k, unnest(o) AS c FROM f)
SELECT id, CAST(k - 1 AS INTEGER) AS pos, c.iri AS iri, c.label AS label, round(c.confidence, 6) AS confidence, array_to_string(c.paths, '+') AS paths, c.branch AS branch FROM g""")
def four_path_reconcile(spark, sf):
    """Tags dealt onto the four paths by unit and place."""
    t = fix.tags(spark, sf).withColumn("id", F.floor(F.col("ord") / 4)).withColumn("path", (F.col("ord") + F.col("pos")) % 4).withColumn("pos", (F.col("ord") * 10 + F.col("pos")).cast("int"))
    u = t.select("id").distinct()
    for k, name in enumerate(("ruler", "llm", "semantic", "heading")):
        u = u.join(tagging.as_concepts(t.where(F.col("path") == k), name), "id", "left")
    r = tagging.reconcile(u).select("id", F.posexplode("concepts").alias("pos", "c"))
    return r.select("id", "pos", "c.iri", "c.label", F.round("c.confidence", 6).alias("confidence"), F.array_join("c.contributing_paths", "+").alias("paths"), "c.branch")


@query("", """WITH w AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS word FROM documents) x WHERE word <> '')
SELECT w.doc_id AS id, c.iri FROM w JOIN (VALUES ('c/1', 'the'), ('c/2', 'that'), ('c/3', 'stupid'), ('c/4', 'und')) AS c(iri, label) ON c.label = w.word""".replace("\\\\", "\\"))
def dictionary_tags(spark, sf):
    c = spark.createDataFrame([("c/1", "The", ""), ("c/2", "that", ""), ("c/3", "Stupid", ""), ("c/4", "und", "")], "iri string, label string, branch string")
    d = fix.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return tagging.ruler(d, c, 1).select("id", "iri")


@query("tags", """, h AS (SELECT ord, pos, confidence AS score, pos AS depth FROM tags), w AS (SELECT *, CASE depth WHEN 0 THEN 1.0 ELSE 0.7 END AS w FROM h)
SELECT ord, pos, round(CASE WHEN score >= 0.7 THEN score * w WHEN score >= 0.5 THEN score * w * 0.7 WHEN depth = 0 AND score >= 0.3 THEN score * w * 0.5 END, 3) AS confidence FROM w WHERE score >= 0.5 OR (depth = 0 AND score >= 0.3)""")
def heading_confidences(spark, sf):
    t = fix.tags(spark, sf).withColumn("c", fx.heading_confidence(F.col("confidence"), fx.proximity_weight(F.col("pos")), F.col("pos")))
    return t.where("c is not null").select("ord", "pos", F.col("c").alias("confidence"))


# --- Graph


def _graph(spark, sf):
    t = fix.tasks(spark, sf).where("label is not null").withColumn("iri", F.concat(F.lit(f"{MODULE}/"), "task_id")).withColumn("is_procedural", F.col("task_id").startswith("R"))
    u = fix.units(spark, sf).withColumn("iri", F.when(F.col("ord") % 6 != 0, F.concat(F.lit(f"{MODULE}/unit/"), "id"))).withColumn("novelty", F.when(F.col("ord") % 4 == 0, F.col("confidence") / 2))
    return t, _links(spark, sf).select("task_id", "unit_id"), u


@query("units tasks links", f""", t AS (SELECT *, concat('{MODULE}/', task_id) AS iri FROM tasks), u AS (SELECT *, concat('{MODULE}/unit/', id) AS iri FROM units WHERE ord % 6 <> 0),
x AS (SELECT u.*, t.iri AS task_iri FROM links l JOIN t ON t.task_id = l.task_id JOIN u ON u.ord = l.unit_ord), a AS (SELECT DISTINCT t.iri, n.unit_type, n.text FROM links l JOIN t ON t.task_id = l.task_id JOIN units n ON n.ord = l.unit_ord WHERE n.unit_type IN ('principle', 'pitfall'))
SELECT p, CAST(count(*) AS BIGINT) AS n FROM (
SELECT 'type' AS p FROM t UNION ALL SELECT 'label' FROM t UNION ALL SELECT 'isProcedural' FROM t WHERE task_id LIKE 'R%' UNION ALL SELECT 'subClassOf' FROM t WHERE parent_task_id IS NOT NULL
UNION ALL SELECT unit_type FROM a UNION ALL SELECT 'type' FROM (SELECT DISTINCT iri FROM x) UNION ALL SELECT 'type' FROM (SELECT DISTINCT iri, task_iri FROM x)
UNION ALL SELECT unnest(['label', 'note', 'unitType', 'confidence', 'wasDerivedFrom', 'source']) FROM (SELECT DISTINCT iri FROM x) UNION ALL SELECT 'noveltyScore' FROM (SELECT DISTINCT iri FROM x WHERE ord % 4 = 0)
UNION ALL SELECT 'type' FROM range(10) UNION ALL SELECT 'label' UNION ALL SELECT 'description') GROUP BY p""")
def triple_counts(spark, sf):
    t = graph.triples(*_graph(spark, sf))
    return t.groupBy(F.regexp_extract("p", r"[^/#]+$", 0).alias("p")).agg(F.count("*").alias("n"))


def _ntriples_sql() -> str:
    x, k = "http://www.w3.org/2001/XMLSchema#", MODULE
    esc = lambda c: "replace(replace(replace(replace(replace(" + c + r""", '\\', '\\\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t')"""
    line = lambda s, p, o, kind="literal", t="": f"SELECT concat('<', {s}, '> <{p}> ', " + (f"'<', {o}, '>'" if kind == "iri" else f"chr(34), {esc(o)}, chr(34)" + (f", '^^<{t}>'" if t else "")) + ", ' .') AS value FROM"
    g = graph
    rows = [
        f"{line(f"'{k}'", g.RDF + 'type', f"'{g.OWL}Ontology'", 'iri')} range(1)",
        f"{line(f"'{k}'", g.RDFS + 'label', "'Knowledge module'")} range(1)",
        f"{line(f"'{k}'", g.DC + 'description', "'Knowledge extracted from documents'")} range(1)",
        f"{line(f"concat('{k}/', p)", g.RDF + 'type', f"'{g.OWL}AnnotationProperty'", 'iri')} (SELECT unnest([{', '.join(f"'{p}'" for p in g.PROPERTIES)}]) AS p)",
        f"{line('iri', g.RDF + 'type', f"'{g.OWL}Class'", 'iri')} t",
        f"{line('iri', g.RDFS + 'label', 'label')} t",
        f"{line('iri', k + '/isProcedural', "'true'", t=x + 'boolean')} t WHERE task_id LIKE 'R%'",
        f"{line('iri', g.RDFS + 'subClassOf', f"concat('{k}/', parent_task_id)", 'iri')} t WHERE parent_task_id IS NOT NULL",
        *[f"{line('task_iri', f'{k}/{p}', 'text')} x WHERE unit_type = '{p}'" for p in ("principle", "pitfall")],
        f"{line('iri', g.RDF + 'type', f"'{g.OWL}NamedIndividual'", 'iri')} v",
        f"{line('iri', g.RDF + 'type', 'task_iri', 'iri')} v",
        f"{line('iri', g.RDFS + 'label', 'text[1:100]')} v",
        f"{line('iri', g.SKOS + 'note', 'text')} v",
        f"{line('iri', k + '/unitType', 'unit_type')} v",
        f"{line('iri', k + '/confidence', 'CAST(confidence AS VARCHAR)', t=x + 'float')} v",
        f"{line('iri', k + '/noveltyScore', 'CAST(confidence / 2 AS VARCHAR)', t=x + 'float')} v WHERE ord % 4 = 0",
        f"{line('iri', g.PROV + 'wasDerivedFrom', 'source_file')} v",
        f"{line('iri', g.DC + 'source', 'source_file')} v",
    ]
    return f""", t AS (SELECT *, concat('{k}/', task_id) AS iri FROM tasks), x AS (SELECT u.*, concat('{k}/unit/', u.id) AS iri, t.iri AS task_iri FROM links l JOIN t ON t.task_id = l.task_id JOIN units u ON u.ord = l.unit_ord), v AS (SELECT * FROM x WHERE ord % 6 <> 0)
SELECT DISTINCT value FROM ({" UNION ALL ".join(rows)})"""


@query("units tasks links", _ntriples_sql())
def ntriples(spark, sf):
    return graph.ntriples(graph.triples(*_graph(spark, sf)))


@query("tasks", f"SELECT 'dangling_reference' AS rule, concat('{MODULE}/', task_id) AS s FROM tasks WHERE parent_task_id = 'R2' UNION ALL SELECT 'class_without_label', concat('{MODULE}/', task_id) FROM tasks WHERE task_id LIKE 'N%' AND task_id LIKE '%3'")
def graph_validation(spark, sf):
    """The graph with a region's triples and some labels taken out."""
    t = graph.triples(*_graph(spark, sf)).where(F.col("s") != f"{MODULE}/R2")
    t = t.where(~((F.col("p") == graph.RDFS + "label") & F.col("s").rlike("/N[0-9]*3$")))
    return graph.validate(t, f"{MODULE}/")


@query("units tasks links", f"""SELECT (SELECT count(*) FROM tasks) AS classes, (SELECT count(DISTINCT u.ord) FROM links l JOIN units u ON u.ord = l.unit_ord WHERE u.ord % 6 <> 0) AS individuals, (SELECT CAST(sum(n) AS BIGINT) FROM ({ORACLES["triple_counts"]}) x) AS triples""")
def graph_stats(spark, sf):
    return graph.graph_stats(graph.triples(*_graph(spark, sf)))


@query("tasks", f"""SELECT concat('{MODULE}/', task_id) AS s, CASE WHEN task_id LIKE '%7' AND task_id LIKE 'C%' THEN 'added' WHEN task_id LIKE 'N%' THEN 'changed' ELSE 'unchanged' END AS change FROM tasks""")
def graph_diff(spark, sf):
    t, l, u = _graph(spark, sf)
    before = t.where(~(F.col("task_id").startswith("C") & F.col("task_id").endswith("7"))).withColumn("label", F.when(F.col("task_id").startswith("N"), F.lower("label")).otherwise(F.col("label")))
    no = l.where(F.lit(False))
    return graph.graph_diff(graph.triples(before, no, u), graph.triples(t, no, u)).where("kind = 'class'").select("s", "change")


@query("units tasks links", """SELECT t.task_id, CAST((SELECT count(*) FROM tasks c WHERE c.parent_task_id = t.task_id) AS INTEGER) AS subtasks,
CAST((SELECT count(DISTINCT u.ord) FROM links l JOIN units u ON u.ord = l.unit_ord WHERE concat('R', CAST(u.ord % 5 AS VARCHAR)) = t.task_id) AS INTEGER) AS units,
coalesce((SELECT md5(string_agg(text[1:100], '|' ORDER BY ord)) FROM (SELECT DISTINCT u.ord, u.text FROM links l JOIN units u ON u.ord = l.unit_ord WHERE concat('R', CAST(u.ord % 5 AS VARCHAR)) = t.task_id)), md5('')) AS digest FROM tasks t WHERE t.parent_task_id IS NULL""")
def jsonld_root_chunks(spark, sf):
    """Units are linked to regions too, by their number."""
    t, l, u = _graph(spark, sf)
    more = l.select(F.concat(F.lit("R"), F.expr("cast(substring(unit_id, 6) as bigint) % 5").cast("string")).alias("task_id"), "unit_id").distinct()
    c = graph.jsonld_chunks(t, l.unionByName(more), u)
    v = F.from_json("value", "`fi:subtasks` array<struct<`@id`:string>>, `fi:units` array<struct<`@id`:string,`rdfs:label`:string>>")
    labels = F.transform("v.`fi:units`", lambda x: x["rdfs:label"])
    return c.withColumn("v", v).select("task_id", F.size(F.coalesce(F.col("v.`fi:subtasks`"), F.array())).alias("subtasks"), F.size("v.`fi:units`").alias("units"), F.md5(F.array_join(labels, "|")).alias("digest"))


# the types of the view in display order
_SHOWN = "(VALUES ('principle', '002', 'Principles'), ('pitfall', '003', 'Pitfalls'), ('procedural_rule', '004', 'Procedural Rules'), ('citation', '005', 'Citations'), ('advice', '006', 'Advice')) AS k(unit_type, rank, shown)"


@query("units tasks links", f""", t AS (SELECT *, lpad(CAST(row_number() OVER (ORDER BY task_id) AS VARCHAR), 12, '0') AS o FROM tasks WHERE label IS NOT NULL),
d AS (SELECT task_id, label, 0 AS depth, o AS key FROM t WHERE parent_task_id IS NULL UNION ALL SELECT t.task_id, t.label, d.depth + 1, concat(d.key, '/', t.o) FROM t JOIN d ON t.parent_task_id = d.task_id),
x AS (SELECT d.key, repeat('  ', d.depth) AS indent, k.rank, k.shown, u.ord, u.text, u.confidence FROM links l JOIN d ON d.task_id = l.task_id JOIN units u ON u.ord = l.unit_ord JOIN {_SHOWN} ON k.unit_type = u.unit_type)
SELECT concat(key, '!0') AS sort, concat(repeat('  ', depth), '- **', label, '**', CASE WHEN task_id LIKE 'R%' THEN ' (procedural -- ordered steps)' ELSE '' END) AS value FROM d
UNION ALL SELECT DISTINCT concat(key, '!1', rank, 'a'), concat(indent, '  - *', shown, '*:') FROM x
UNION ALL SELECT concat(key, '!1', rank, 'b', lpad(CAST(ord AS VARCHAR), 12, '0')), concat(indent, '    - ', regexp_replace(text, '^\\s+|\\s+$', '', 'g'), ' (confidence: ', printf('%.2f', confidence), ')') FROM x""")
def markdown_outline(spark, sf):
    t, l, u = _graph(spark, sf)
    return graph.outline_lines(numbered(t, "task_id"), l, u)


@query("tasks", """, d AS (SELECT task_id, parent_task_id FROM tasks WHERE contains(lower(label), 'n_1') UNION SELECT t.task_id, t.parent_task_id FROM tasks t JOIN d ON d.parent_task_id = t.task_id) SELECT DISTINCT task_id FROM d""")
def tree_search(spark, sf):
    return discovery.matching_subtrees(fix.tasks(spark, sf), "N_1").select("task_id")


@query("tasks", ", r AS (SELECT task_id, 0 AS hops FROM tasks WHERE task_id = 'R1' UNION ALL SELECT t.task_id, r.hops + 1 FROM tasks t JOIN r ON t.parent_task_id = r.task_id) SELECT task_id AS id, hops FROM r WHERE hops > 0")
def retraction_cascade(spark, sf):
    e = fix.tasks(spark, sf).where("parent_task_id is not null").select(F.col("task_id").alias("id"), F.col("parent_task_id").alias("depends_on"))
    return review.dependents(e, spark.createDataFrame([("R1",)], "id string"))


@query("decisions", """, v AS (SELECT *, lead(reviewed_at) OVER (PARTITION BY unit_ord ORDER BY reviewed_at, event_id) AS valid_to FROM decisions)
SELECT unit_ord, event_id, status FROM v WHERE reviewed_at <= TIMESTAMP '2024-01-15' AND (valid_to IS NULL OR TIMESTAMP '2024-01-15' < valid_to)""")
def decisions_as_of(spark, sf):
    d = fix.decisions(spark, sf)
    w = Window.partitionBy("unit_ord").orderBy("reviewed_at", "event_id")
    v = d.withColumn("valid_from", F.col("reviewed_at")).withColumn("valid_to", F.lead("reviewed_at").over(w))
    return review.valid_at(v, F.lit("2024-01-15").cast("timestamp_ntz")).select("unit_ord", "event_id", "status")


# --- Streams, as batches over the same rows


@query("decisions", "SELECT strftime(date_trunc('day', reviewed_at), '%Y-%m-%d') AS day, status, CAST(count(*) AS BIGINT) AS n FROM decisions GROUP BY ALL")
def review_activity_tumbling(spark, sf):
    return jobs.activity(fix.decisions(spark, sf)).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "status", "n")


@query("decisions", """, p AS (SELECT *, CASE WHEN lag(reviewed_at) OVER w >= reviewed_at - INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM decisions WINDOW w AS (PARTITION BY unit_ord ORDER BY reviewed_at)),
g AS (SELECT *, sum(n) OVER (PARTITION BY unit_ord ORDER BY reviewed_at, event_id) AS s FROM p) SELECT unit_ord, strftime(min(reviewed_at), '%Y-%m-%d %H:%M:%S') AS start, CAST(count(*) AS BIGINT) AS n FROM g GROUP BY unit_ord, s""")
def review_activity_session(spark, sf):
    return jobs.sessions(fix.decisions(spark, sf), "6 hours").select("unit_ord", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


from . import cluster_queries, format_queries, ledger_queries, operator_queries  # noqa: E402, F401  register their queries
