"""Further queries over the driver's tables, for operators that the first module doesn't reach, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import discovery, elements, graph, providers, review, similarity, tagging
from . import fixtures as fix
from .queries import _CENTRES, _CONTRA, _centres, _contradictions, _links, _vectors, query

# --- Projections


@query("tasks", "SELECT task_id, CASE WHEN task_id LIKE '%3' THEN concat(label, ' (edited)') ELSE label END AS label FROM tasks")
def edited_labels(spark, sf):
    edited = F.when(F.col("task_id").endswith("3"), F.concat("label", F.lit(" (edited)"))).when(F.col("task_id").endswith("4"), "")
    return fix.tasks(spark, sf).select("task_id", fx.edited_label(edited, F.col("label")).alias("label"))


@query("tags", "SELECT ord, pos, round(greatest(0.0, least(1.0, confidence * 3 - 1)), 6) AS clamped, round(confidence * 0.7 + (pos / 2.0) * 0.3, 6) AS blended FROM tags")
def blended_confidences(spark, sf):
    t = fix.tags(spark, sf)
    return t.select("ord", "pos", F.round(fx.clamp(F.col("confidence") * 3 - 1), 6).alias("clamped"), F.round(fx.blend(F.col("confidence"), F.col("pos") / 2), 6).alias("blended"))


_TYPES = "('advice'), ('principle'), ('citation'), ('procedural_rule'), ('pitfall')"


@query("", f"SELECT p_partkey, CASE WHEN k.t IS NULL THEN 'advice' ELSE k.t END AS unit_type FROM (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'principle' WHEN 1 THEN 'citation' WHEN 2 THEN 'pitfall' WHEN 3 THEN 'other' WHEN 4 THEN 'procedural_rule' ELSE p_type END AS w FROM part) p LEFT JOIN (VALUES {_TYPES}) AS k(t) ON k.t = p.w")
def reply_types(spark, sf):
    """Replies of a classifier, in odd case and with spaces around, and some that are no type."""
    k = F.col("p_partkey") % 7
    said = F.when(k == 0, " Principle").when(k == 1, "CITATION ").when(k == 2, "\tpitfall\n").when(k == 3, "other").when(k == 4, "Procedural_Rule").otherwise(F.col("p_type"))
    return fix.table(spark, sf, "part").select("p_partkey", fx.unit_type(said).alias("unit_type"))


@query("", "SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'N/A' ELSE concat(n_name, ' > ', c_name) END AS crumb FROM customer JOIN nation ON n_nationkey = c_nationkey")
def breadcrumbs(spark, sf):
    c, n = fix.table(spark, sf, "customer"), fix.table(spark, sf, "nation")
    path = F.when(F.col("c_custkey") % 5 != 0, F.array("n_name", "c_name")).otherwise(F.array().cast("array<string>"))
    return c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", fx.breadcrumb(path).alias("crumb"))


@query("", "SELECT doc_id, text[(doc_id * 7) % 500 + 1 : greatest(least((doc_id * 7) % 500 + 30, length(text)), 0)] AS span FROM documents")
def source_spans(spark, sf):
    at = (F.col("doc_id") * 7) % 500
    return fix.table(spark, sf, "documents").select("doc_id", fx.span_of(F.col("text"), at, at + 30).alias("span"))


@query("", """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS digest FROM pages""")
def escaped_pages(spark, sf):
    return fix.table(spark, sf, "pages").select("page_id", F.md5(fx.escape_html(F.col("html"))).alias("digest"))


@query("", "SELECT c_custkey, concat('https://example.org/', regexp_replace(to_base64(unhex(sha256(concat('C', CAST(c_custkey AS VARCHAR)))[1:32])), '[^A-Za-z0-9]', '', 'g')) AS iri FROM customer")
def minted_iris(spark, sf):
    return fix.table(spark, sf, "customer").select("c_custkey", fx.mint_iri(F.concat(F.lit("C"), F.col("c_custkey").cast("string")), "https://example.org/").alias("iri"))


@query("", """WITH d AS (SELECT conv_id, turn, text, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 0 END AS level FROM conversations),
h AS (SELECT *, max(CASE WHEN level = 1 THEN turn END) OVER (PARTITION BY conv_id) AS top FROM d)
SELECT conv_id, coalesce(string_agg(concat('t', CAST(turn AS VARCHAR)), ' > ' ORDER BY turn) FILTER (level > 0 AND turn >= coalesce(top, -1)), '') AS trail FROM h GROUP BY conv_id""")
def heading_trails(spark, sf):
    """Conversations as Markdown with a heading a turn; the trail of what stands at the end."""
    line = F.concat(F.when(F.col("role") == "system", "# ").when(F.col("role") == "user", "## ").otherwise("x"), F.lit("t"), F.col("turn").cast("string"))
    d = fix.table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return d.select("conv_id", F.array_join(fx.heading_trail(F.col("text"), F.length("text") + 1), " > ").alias("trail"))


# --- Elements


@query("outline", """SELECT file_path, seq, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text, CASE WHEN level > 0 THEN 'heading' WHEN seq % 3 = 1 THEN 'list_item' ELSE 'paragraph' END AS element_type, CASE WHEN level > 0 THEN greatest(level - 2, 1) ELSE 0 END AS level
FROM outline WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def normalized_elements(spark, sf):
    """Elements of odd kinds and levels."""
    o = fix.outline(spark, sf)
    kind = F.when(F.col("level") > 0, "heading").when(F.col("seq") % 3 == 1, "list_item").when(F.col("seq") % 3 == 2, "table").otherwise("paragraph")
    e = o.select("file_path", "seq", F.concat(F.lit(" "), "text", F.lit("\n")).alias("text"), kind.alias("element_type"), (F.col("level") - 2).alias("level"))
    return elements.normalize_elements(e)


@query("", """WITH e AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 3 <> 0) SELECT d.doc_id AS file_path, md5(CASE WHEN e.doc_id IS NULL THEN trim(text, ' ' || chr(9) || chr(10) || chr(13)) ELSE 'known' END) AS digest FROM documents d LEFT JOIN e ON e.doc_id = d.doc_id
WHERE e.doc_id IS NOT NULL OR trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''""")
def whole_text_elements(spark, sf):
    d = fix.table(spark, sf, "documents").select(F.col("doc_id").alias("file_path"), "text")
    known = d.where("file_path % 3 <> 0").select("file_path", F.lit(0).alias("seq"), F.lit("known").alias("text"), F.lit("paragraph").alias("element_type"), F.lit(0).alias("level"))
    return elements.with_whole_text(d, known).select("file_path", F.md5("text").alias("digest"))


_BOUNDS = """WITH b AS (SELECT doc_id AS file_path, 0 AS seq, doc_id * 10 AS a, doc_id * 10 + CASE WHEN doc_id % 4 = 3 THEN 100 ELSE 600 END AS z, doc_id % 4 AS k, md5(text) AS digest FROM documents)"""


@query("", _BOUNDS + """ SELECT file_path, CAST(a AS BIGINT) AS a, CAST(z AS BIGINT) AS z, 'structural_paragraph' AS method, digest FROM b WHERE k IN (2, 3)
UNION ALL SELECT file_path, CAST(a + 300 * p AS BIGINT), CAST(a + 300 * p + 300 AS BIGINT), CASE k WHEN 0 THEN 'semantic' ELSE 'llm' END, digest FROM b, (VALUES (0), (1)) AS p(p) WHERE k IN (0, 1)""")
def refined_boundaries(spark, sf):
    """Long paragraphs, of which some have semantic segments, some those of a model, some both, some none."""
    k = F.col("doc_id") % 4
    b = fix.table(spark, sf, "documents").select(F.col("doc_id").alias("file_path"), F.lit(0).alias("seq"), F.lit(0).alias("part"), (F.col("doc_id") * 10).alias("start"), (F.col("doc_id") * 10 + F.when(k == 3, 100).otherwise(600)).alias("end"), "text", F.array(F.lit("h")).alias("section_path"), F.lit(0.7).alias("confidence"), F.lit("structural_paragraph").alias("method"))
    halves = lambda d, m: d.select("file_path", "seq", "part", F.explode(F.array(F.lit(0), F.lit(300))).alias("_o"), "start", "text", "confidence").select("file_path", "seq", "part", (F.col("start") + F.col("_o")).alias("start"), (F.col("start") + F.col("_o") + 300).alias("end"), "text", "confidence", F.lit(m).alias("method"))
    which = F.col("file_path") % 4
    out = elements.refine(b, halves(b.where(which.isin(0, 3)), "semantic"), halves(b.where(which.isin(0, 1)), "llm"))
    return out.select("file_path", F.col("start").alias("a"), F.col("end").alias("z"), "method", F.md5("text").alias("digest"))


@query("", """WITH r AS (SELECT doc_id, length(text) AS n, text FROM documents WHERE doc_id % 3 <> 2), s AS (SELECT doc_id, n, text, greatest(0, least(x, n)) AS a, greatest(0, least(y, n)) AS b, near FROM (
SELECT doc_id, n, text, 0 AS x, 40 AS y, 1 AS near FROM r UNION ALL SELECT doc_id, n, text, 40, 90, 0 FROM r WHERE doc_id % 3 = 0 UNION ALL SELECT doc_id, n, text, 90, 9000000, 0 FROM r WHERE doc_id % 3 = 0)),
k AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS spans FROM s WHERE b > a AND trim(text[a + 1 : b], ' ' || chr(9) || chr(10) || chr(13)) <> '')
SELECT doc_id AS file_path, CAST(5 + a AS BIGINT) AS a, CAST(5 + b AS BIGINT) AS z, CASE near WHEN 1 THEN CAST(0.85 AS DOUBLE) ELSE 0.75 END AS confidence FROM k WHERE spans > 1""")
def model_boundaries(spark, sf):
    """Replies of a model as JSON: three spans, one, and none that can be read."""
    k = F.col("doc_id") % 3
    three = '{"boundaries": [{"start": -3, "end": 40}, {"start": 40, "end": 90}, {"start": 90, "end": 9000000}]}'
    reply = F.when(k == 0, three).when(k == 1, '{"boundaries": [{"start": 0, "end": 40}]}').otherwise("no json")
    d = fix.table(spark, sf, "documents").select(F.col("doc_id").alias("file_path"), F.lit(0).alias("seq"), F.lit(0).alias("part"), F.lit(5).cast("long").alias("start"), "text", F.array(F.lit(12).cast("long")).alias("candidates"), reply.alias("reply"))
    return elements.model_segments(d).select("file_path", F.col("start").alias("a"), F.col("end").alias("z"), "confidence")


# --- Tags


@query("tags", """, m AS (SELECT n_name AS label, concat('found/', CAST(n_nationkey AS VARCHAR)) AS iri, (n_nationkey * 17 % 100) / 100.0 AS score FROM nation UNION ALL SELECT 'PROPOSED_25', 'found/p', 0.6 UNION ALL SELECT 'PROPOSED_25', 'found/q', 0.6 UNION ALL SELECT 'PROPOSED_26', 'found/r', 0.59)
SELECT ord, pos, CASE WHEN t.iri <> '' THEN t.iri WHEN t.label = 'PROPOSED_25' THEN 'found/p' ELSE '' END AS iri, CASE WHEN t.iri = '' AND t.label = 'PROPOSED_26' THEN 'proposed_class' ELSE 'llm' END AS extraction_path FROM tags t""")
def resolved_tags(spark, sf):
    t = fix.tags(spark, sf).select(F.col("ord").alias("id"), "pos", "iri", "label", "confidence", F.array(F.lit("llm")).alias("contributing_paths"), "branch")
    n = fix.table(spark, sf, "nation").select(F.col("n_name").alias("label"), F.concat(F.lit("found/"), F.col("n_nationkey").cast("string")).alias("match_iri"), F.col("n_name").alias("match_label"), F.lit("").alias("match_branch"), (F.col("n_nationkey") * 17 % 100 / 100).alias("score"))
    extra = spark.createDataFrame([("PROPOSED_25", "found/q", "q", "", 0.6), ("PROPOSED_25", "found/p", "p", "", 0.6), ("PROPOSED_26", "found/r", "r", "", 0.59)], "label string, match_iri string, match_label string, match_branch string, score double")
    r = tagging.resolve(t, n.unionByName(extra))
    return r.select(F.col("id").alias("ord"), "pos", "iri", "extraction_path")


_HEADS = """WITH c AS (SELECT concat('n/', CAST(n_nationkey AS VARCHAR)) AS iri, lower(concat(n_name, ' of ', r_name)) AS low FROM nation JOIN region ON r_regionkey = n_regionkey),
h AS (SELECT c_custkey AS id, lower(concat(CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'the ' ELSE 'some other ' END, n_name, ' of ', r_name)) AS clean FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
s AS (SELECT h.id, c.iri, CASE WHEN low = clean THEN 1.0 ELSE 1 - CAST(levenshtein(low, clean) AS DOUBLE) / greatest(length(low), length(clean)) END AS score FROM h, c),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, iri) AS r FROM s WHERE score >= 0.3)"""


@query("", _HEADS + " SELECT id, iri, round(score, 6) AS score FROM b WHERE r = 1")
def label_search(spark, sf):
    """All labels share the word "of", so every one is compared."""
    c, n, r = (fix.table(spark, sf, t) for t in ("customer", "nation", "region"))
    name = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.concat("n_name", F.lit(" of "), "r_name").alias("label"))
    concepts = name.select(F.concat(F.lit("n/"), F.col("n_nationkey").cast("string")).alias("iri"), "label", F.lit("").alias("branch"))
    k = F.col("c_custkey") % 3
    before = F.when(k == 0, "2.1 ").when(k == 1, "Chapter 3: the ").otherwise("some other ")
    h = c.join(name, c.c_nationkey == name.n_nationkey).select(F.col("c_custkey").alias("id"), F.lit(0).alias("depth"), F.concat(before, "label").alias("text"))
    return tagging.label_search(h, concepts).select("id", "iri", F.round("score", 6).alias("score"))


@query("units tags", "SELECT CAST(count(*) AS BIGINT) AS total, CAST((SELECT count(DISTINCT ord) FROM tags) AS BIGINT) AS tagged FROM units")
def tagged_totals(spark, sf):
    return review.tagged_count(fix.tagged_units(spark, sf))


@query("units", f"SELECT k.t AS unit_type, CAST(count(u.ord) AS BIGINT) AS n FROM (VALUES {_TYPES}) AS k(t) LEFT JOIN (SELECT * FROM units WHERE unit_type <> 'pitfall') u ON u.unit_type = k.t GROUP BY k.t")
def type_histogram(spark, sf):
    """Of units without pitfalls, which are counted as zero."""
    return review.type_histogram(fix.units(spark, sf).where("unit_type <> 'pitfall'"))


# --- Discovery


@query("units", """, c AS (SELECT *, ord // 10 AS ten, ord % 10 < 2 AS pair FROM units) SELECT ten, pair, CAST(count(*) AS BIGINT) AS n, min(ord) AS first, string_agg(id, '|' ORDER BY ord) AS unit_ids FROM c GROUP BY ten, pair
HAVING count(*) >= 3 AND CAST(count(*) FILTER (ord % 5 < ten % 5) AS DOUBLE) / count(*) <= 0.7""")
def cluster_candidates(spark, sf):
    """Pairs of units, which are too few, and clusters of eight, of which headings cover none to three quarters."""
    u, ten = fix.units(spark, sf), F.floor(F.col("ord") / 10)
    pair = F.col("ord") % 10 < 2
    g = discovery.cluster_candidates(u, u.select("id", F.concat_ws("-", ten.cast("string"), pair.cast("string")).alias("cluster")), u.where(F.col("ord") % 5 < ten % 5).select("id"))
    return g.select(F.floor(F.col("first") / 10).alias("ten"), (F.col("first") % 10 < 2).alias("pair"), F.size("unit_ids").cast("long").alias("n"), "first", F.array_join("unit_ids", "|").alias("unit_ids"))


@query("units", ", c AS (SELECT *, ord % 40 AS cluster FROM units), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY ord) AS r FROM c) SELECT cluster, md5(string_agg(text, '|' ORDER BY ord)) AS digest, CAST(count(*) AS BIGINT) AS n FROM r WHERE r <= 20 GROUP BY cluster")
def prompt_texts(spark, sf):
    u = fix.units(spark, sf)
    c = u.select("id", (F.col("ord") % 40).alias("cluster"))
    return discovery.prompt_texts(u, c).select("cluster", F.md5(F.array_join("texts", "|")).alias("digest"), F.size("texts").cast("long").alias("n"))


@query("units links", ", r AS (SELECT l.task_id, u.ord, u.text, row_number() OVER (PARTITION BY l.task_id ORDER BY u.ord) AS r FROM links l JOIN units u ON u.ord = l.unit_ord) SELECT task_id, md5(string_agg(text, ' ' ORDER BY ord)) AS digest FROM r WHERE r <= 10 GROUP BY task_id")
def centroid_texts(spark, sf):
    return discovery.centroid_texts(_links(spark, sf), fix.units(spark, sf)).select("task_id", F.md5("text").alias("digest"))


@query("", _CENTRES + " SELECT concat('u', CAST(id AS VARCHAR)) AS unit_id, concat('t', CAST(centre AS VARCHAR)) AS task_id FROM s WHERE rank = 1")
def assigned_orphans(spark, sf):
    """All vectors as units without a task, the means of labels as tasks."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string")).alias(c)
    return discovery.assign_orphans(_vectors(spark, sf).select(name("u", "id"), "v"), _centres(spark, sf).select(name("t", "centre"), "ord", "cv"))


@query("", """WITH t AS (SELECT n_nationkey AS k, n_regionkey AS r, concat('iri/', CAST(n_nationkey AS VARCHAR)) AS iri FROM nation),
p AS (SELECT k, pos, CASE pos WHEN 0 THEN k + 40 WHEN 1 THEN k WHEN 2 THEN (k * 3 + 1) % 30 ELSE (k + 5) % 25 END AS up FROM t, (VALUES (0), (1), (2), (3)) AS x(pos))
SELECT concat('T', CAST(p.k AS VARCHAR)) AS task_id, concat('T', CAST(arg_min(t.k, p.pos) AS VARCHAR)) AS parent_task_id FROM p JOIN t ON t.k = p.up AND t.k <> p.k GROUP BY p.k""")
def concept_parents(spark, sf):
    """Concepts with parents that no task has, their own, and others."""
    k = F.col("n_nationkey")
    t = fix.table(spark, sf, "nation").select(F.concat(F.lit("T"), k.cast("string")).alias("task_id"), k.alias("ord"), F.concat(F.lit("iri/"), k.cast("string")).alias("iri"), k)
    iri = lambda x: F.concat(F.lit("iri/"), x.cast("string"))
    c = t.select("iri", F.array(iri(k + 40), iri(k), iri((k * 3 + 1) % 30), iri((k + 5) % 25)).alias("parent_iris"))
    return discovery.concept_parents(t.drop("n_nationkey"), c)


@query("", """WITH c AS (SELECT c_custkey AS k, c_nationkey AS n, lower(c_name) AS low FROM customer),
s AS (SELECT n_nationkey AS cand, k, CASE WHEN low = own THEN 1.0 ELSE 1 - CAST(levenshtein(low, own) AS DOUBLE) / greatest(length(low), length(own), 1) END AS score FROM (SELECT n_nationkey, lower(concat('Customer#', lpad(CAST(n_nationkey * 3 AS VARCHAR), 9, '0'))) AS own FROM nation) x JOIN c ON c.n = x.n_nationkey),
b AS (SELECT cand, arg_max(concat('c/', lpad(CAST(k AS VARCHAR), 9, '0')), struct_pack(s := score, i := concat('c/', lpad(CAST(k AS VARCHAR), 9, '0')))) AS iri FROM s WHERE score >= 0.5 GROUP BY cand)
SELECT n_nationkey AS candidate, coalesce(b.iri, concat('n/', CAST(n_nationkey AS VARCHAR))) AS iri FROM nation LEFT JOIN b ON b.cand = n_nationkey""")
def deepest_concepts(spark, sf):
    """Nations as concepts, their customers as the children."""
    n, c = fix.table(spark, sf, "nation"), fix.table(spark, sf, "customer")
    key = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    cand = n.select(F.col("n_nationkey").alias("candidate"), key("n/", F.col("n_nationkey")).alias("iri"), F.concat(F.lit("4.2 Customer#"), F.lpad((F.col("n_nationkey") * 3).cast("string"), 9, "0")).alias("label"))
    concepts = c.select(F.concat(F.lit("c/"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("iri"), F.col("c_name").alias("label"), F.array(key("n/", F.col("c_nationkey"))).alias("parent_iris"))
    return discovery.deepest_concept(cand, concepts).select("candidate", "iri")


@query("tasks", """, o AS (SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 2 = 0)
SELECT t.task_id, coalesce(CASE WHEN t.task_id LIKE 'C%' AND t.parent_task_id IN (SELECT concat('N', CAST(k AS VARCHAR)) FROM o) AND CAST(t.task_id[2:] AS BIGINT) < 200 THEN 199 - CAST(t.task_id[2:] AS BIGINT) END, -1) AS canonical_order,
t.task_id IN (SELECT concat('N', CAST(k AS VARCHAR)) FROM o) AS is_procedural FROM tasks t""")
def procedural_orders(spark, sf):
    """Orders of the customers of every second nation, the later first, in odd case; labels of others are in the lists too."""
    t = fix.tasks(spark, sf)
    labels = F.transform(F.sequence(F.lit(199), F.lit(0), F.lit(-1)), lambda i: F.concat(F.lit(" CUSTOMER#"), F.lpad(i.cast("string"), 9, "0")))
    o = fix.table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("parent_task_id"), labels.alias("labels"))
    return discovery.procedural_order(t, o).select("task_id", F.coalesce(F.col("canonical_order").cast("long"), F.lit(-1).cast("long")).alias("canonical_order"), "is_procedural")


@query("tasks", """, k AS (SELECT task_id, label, parent_task_id, CASE WHEN task_id LIKE 'C%' THEN CAST(task_id[2:] AS BIGINT) % 4 END AS c FROM tasks), o AS (SELECT *, CASE WHEN c > 0 THEN c END AS canonical_order FROM k)
SELECT task_id, CAST(row_number() OVER (PARTITION BY parent_task_id ORDER BY canonical_order ASC NULLS FIRST, label, task_id) AS INTEGER) AS place FROM o""")
def canonical_places(spark, sf):
    c = F.when(F.col("task_id").startswith("C"), F.expr("cast(substring(task_id, 2) as bigint) % 4"))
    return review.in_canonical_order(fix.tasks(spark, sf).withColumn("canonical_order", F.when(c > 0, c))).select("task_id", "place")


@query("tags", ", c AS (SELECT DISTINCT branch, label, iri FROM tags) SELECT branch, label, iri, CAST(row_number() OVER (PARTITION BY branch ORDER BY label, iri) AS INTEGER) AS place FROM c")
def concepts_by_label(spark, sf):
    c = fix.tags(spark, sf).select("branch", "label", F.col("iri").alias("id")).distinct()
    return review.in_label_order(c, "branch").withColumnRenamed("id", "iri")


@query("tasks links", """, m AS (SELECT concat('C', CAST(c_custkey AS VARCHAR)) AS merged, concat('C', CAST(c_custkey - 1 AS VARCHAR)) AS canonical FROM customer WHERE c_custkey % 5 = 1)
SELECT DISTINCT coalesce(m.canonical, l.task_id) AS task_id, l.unit_ord FROM links l LEFT JOIN m ON m.merged = l.task_id""")
def merged_links(spark, sf):
    m = fix.table(spark, sf, "customer").where("c_custkey % 5 = 1").select(F.concat(F.lit("C"), (F.col("c_custkey") - 1).cast("string")).alias("canonical"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("merged"))
    _, moved = discovery.apply_merges(fix.tasks(spark, sf), fix.links(spark, sf).withColumnRenamed("unit_ord", "unit_id"), m)
    return moved.select("task_id", F.col("unit_id").alias("unit_ord"))


@query("tasks", """, m AS (SELECT concat('N', CAST(n_nationkey AS VARCHAR)) AS merged, concat('N', CAST(n_nationkey - 1 AS VARCHAR)) AS canonical FROM nation WHERE n_nationkey % 5 = 1)
SELECT t.task_id, coalesce(m.canonical, t.parent_task_id) AS parent_task_id FROM tasks t LEFT JOIN m ON m.merged = t.parent_task_id WHERE t.task_id NOT IN (SELECT merged FROM m)""")
def reparented_tasks(spark, sf):
    m = fix.table(spark, sf, "nation").where("n_nationkey % 5 = 1").select(F.concat(F.lit("N"), (F.col("n_nationkey") - 1).cast("string")).alias("canonical"), F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("merged"))
    t, _ = discovery.apply_merges(fix.tasks(spark, sf), fix.links(spark, sf).withColumnRenamed("unit_ord", "unit_id"), m)
    return t.select("task_id", "parent_task_id")


@query("tasks", "SELECT task_id, CASE WHEN task_id LIKE '%7' THEN concat(label, '!') WHEN task_id LIKE '%2' THEN label ELSE concat('new ', label) END AS label, CASE WHEN task_id LIKE '%7' THEN 'edited' WHEN task_id LIKE '%2' THEN 'approved' ELSE 'unreviewed' END AS status FROM tasks")
def locked_tasks(spark, sf):
    """Tasks found anew, of which those that a reviewer decided on keep what they had."""
    old = fix.tasks(spark, sf).withColumn("status", F.when(F.col("task_id").endswith("7"), "edited").when(F.col("task_id").endswith("2"), "approved").otherwise("unreviewed"))
    old = old.withColumn("edited_label", F.when(F.col("status") == "edited", F.concat("label", F.lit("!"))))
    new = fix.tasks(spark, sf).withColumn("label", F.concat(F.lit("new "), "label")).withColumn("status", F.lit("unreviewed"))
    return discovery.with_locked(new.select("task_id", "label", "status"), review.locked_tasks(old).select("task_id", "label", "status"))


_PAIRS = ", k AS (SELECT l.task_id, u.id, u.ord FROM links l JOIN units u ON u.ord = l.unit_ord), p AS (SELECT a.task_id, a.id AS a, b.id AS b, ((a.ord * 31 + b.ord * 17) % 101) / 100.0 AS score FROM k a JOIN k b ON a.task_id = b.task_id AND a.ord < b.ord)"


@query("units links", _PAIRS + " SELECT task_id, a, b, score FROM p WHERE score > 0.7")
def screened_contradictions(spark, sf):
    """Pairs of a task's units with scores of a stand-in model; those above the threshold stay."""
    p = discovery.unit_pairs(_links(spark, sf), fix.units(spark, sf))
    n = lambda c: F.substring(c, 6, 9).cast("long")
    scores = p.select("a", "b").distinct().withColumn("score", ((n("a") * 31 + n("b") * 17) % 101).cast("double") / 100.0)
    return discovery.screen(p, scores)


# --- Review


@query("", """WITH l AS (SELECT concat('f', CAST(user_id % 13 AS VARCHAR)) AS source_file, CAST(floor(value) AS INTEGER) % 14 - 1 AS authority_level, ts, event_id FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY ts DESC, event_id DESC) AS r FROM l WHERE authority_level BETWEEN 1 AND 10) SELECT source_file, authority_level FROM r WHERE r = 1""")
def source_authorities(spark, sf):
    """A log of levels, some out of range."""
    e = fix.table(spark, sf, "events")
    log = e.select(F.lit("c").alias("corpus_name"), F.concat(F.lit("f"), (F.col("user_id") % 13).cast("string")).alias("source_file"), (F.floor("value").cast("int") % 14 - 1).alias("authority_level"), F.col("ts").alias("at"), "event_id")
    return review.authorities(log).select("source_file", "authority_level")


@query("decisions", "SELECT event_id FROM decisions WHERE status IN ('approved', 'edited')")
def valid_statuses(spark, sf):
    d = fix.decisions(spark, sf).withColumn("status", F.when(F.col("status") == "rejected", F.lit(None)).otherwise(F.col("status")))
    return d.where(review.valid(F.col("status"), review.UNIT_STATUS)).select("event_id")


_OLD_NEW = f"WITH {_CONTRA}, o AS (SELECT contradiction_id, task_id, resolution FROM c WHERE contradiction_id % 3 <> 0), n AS (SELECT contradiction_id, concat(task_id, 'x') AS task_id, 'merge' AS resolution FROM c WHERE contradiction_id % 2 = 0)"


@query("", _OLD_NEW + " SELECT coalesce(o.contradiction_id, n.contradiction_id) AS contradiction_id, coalesce(o.task_id, n.task_id) AS task_id, CASE WHEN n.contradiction_id IS NOT NULL THEN n.resolution ELSE o.resolution END AS resolution FROM o FULL JOIN n ON n.contradiction_id = o.contradiction_id")
def upserted_contradictions(spark, sf):
    """A row that is there keeps its task, and takes the new resolution."""
    c = _contradictions(spark, sf)
    new = c.where("contradiction_id % 2 = 0").withColumn("task_id", F.concat("task_id", F.lit("x"))).withColumn("resolution", F.lit("merge"))
    return review.upsert(c.where("contradiction_id % 3 <> 0"), new, ["contradiction_id"], ["resolution"])


@query("", _OLD_NEW + " SELECT * FROM o UNION ALL SELECT * FROM n WHERE contradiction_id NOT IN (SELECT contradiction_id FROM o)")
def inserted_contradictions(spark, sf):
    c = _contradictions(spark, sf)
    new = c.where("contradiction_id % 2 = 0").withColumn("task_id", F.concat("task_id", F.lit("x"))).withColumn("resolution", F.lit("merge"))
    return review.insert_ignore(c.where("contradiction_id % 3 <> 0"), new.unionByName(new), ["contradiction_id"])


@query("", f"""WITH {_CONTRA}, e AS (SELECT contradiction_id, CASE ev.user_id % 4 WHEN 0 THEN 'merge' WHEN 1 THEN 'prefer_a' WHEN 2 THEN 'prefer_b' ELSE 'unknown' END AS r, ts, event_id FROM c JOIN events ev ON ev.event_id = c.contradiction_id OR ev.event_id = c.contradiction_id + 1),
l AS (SELECT *, row_number() OVER (PARTITION BY contradiction_id ORDER BY ts DESC, event_id DESC) AS k FROM e WHERE r <> 'unknown')
SELECT c.contradiction_id, coalesce(l.r, c.resolution) AS resolution FROM c LEFT JOIN l ON l.contradiction_id = c.contradiction_id AND l.k = 1""")
def resolved_contradictions(spark, sf):
    c, e = _contradictions(spark, sf), fix.table(spark, sf, "events")
    k = F.col("user_id") % 4
    said = F.when(k == 0, "merge").when(k == 1, "prefer_a").when(k == 2, "prefer_b").otherwise("unknown")
    log = e.select("event_id", F.col("ts").alias("at"), said.alias("resolution"), F.explode(F.array("event_id", F.col("event_id") - 1)).alias("contradiction_id"))
    return review.resolve_contradiction(c, log.join(c.select("contradiction_id"), "contradiction_id", "left_semi")).select("contradiction_id", "resolution")


@query("tasks links", """, m AS (SELECT task_id, label, CASE task_id WHEN 'C5' THEN 'R1' ELSE parent_task_id END AS parent FROM tasks WHERE task_id NOT IN ('N3', 'C7'))
SELECT m.task_id, m.parent, CAST((SELECT count(DISTINCT unit_ord) FROM links l WHERE CASE l.task_id WHEN 'C7' THEN 'C8' ELSE l.task_id END = m.task_id) AS BIGINT) AS n FROM m""")
def edited_hierarchy(spark, sf):
    """A task is moved, one is merged into another, and one is deleted, whose children keep its id."""
    t, l = review.delete_task(fix.tasks(spark, sf), fix.links(spark, sf).withColumnRenamed("unit_ord", "unit_id"), "N3")
    t, l = review.merge_task(review.move_task(t, "C5", "R1"), l, "C7", "C8")
    n = l.groupBy("task_id").agg(F.count("*").alias("n"))
    return t.join(n, "task_id", "left").select("task_id", F.col("parent_task_id").alias("parent"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


_TASK_REVIEWS = """, t AS (SELECT *, CAST(substr(task_id, 2) AS BIGINT) * 37 % 101 / 100.0 AS confidence FROM tasks),
l AS (SELECT concat('C', user_id) AS task_id, CASE event_type WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE 'edited' END AS status, CASE WHEN event_type = 'click' THEN concat('label ', event_id) END AS edited_label, ts AS tm, event_id AS seq, true AS one FROM events WHERE event_type <> 'view'
  UNION ALL SELECT task_id, 'approved', NULL, TIMESTAMP '2024-01-16 00:00:00', -1, false FROM t WHERE confidence >= 0.5),
a AS (SELECT task_id, arg_max(status, row(tm, seq)) AS status, max(tm) AS tm FROM l GROUP BY task_id),
b AS (SELECT task_id, edited_label FROM (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY tm DESC, seq DESC) AS r FROM l WHERE one) WHERE r = 1)
SELECT t.task_id, coalesce(a.status, 'unreviewed') AS status, b.edited_label, a.tm AS reviewed_at FROM t LEFT JOIN a ON a.task_id = t.task_id LEFT JOIN b ON b.task_id = t.task_id"""


@query("tasks", _TASK_REVIEWS)
def task_reviews(spark, sf):
    """Reviews of tasks one by one, some of a status that isn't allowed or of tasks that there aren't, and a bulk approval."""
    t = fix.tasks(spark, sf).withColumn("confidence", F.expr("bigint(substr(task_id, 2)) * 37 % 101 / 100.0"))
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "approved").when(kind == "error", "rejected").when(kind == "view", "seen").otherwise("edited")
    e = fix.table(spark, sf, "events").select(F.concat(F.lit("C"), F.col("user_id").cast("string")).alias("task_id"), status.alias("status"), F.when(kind == "click", F.concat(F.lit("label "), F.col("event_id").cast("string"))).alias("edited_label"), F.lit(None).cast("string").alias("note"), F.col("ts").alias("reviewed_at"), F.col("event_id").alias("seq"))
    at = F.lit("2024-01-16 00:00:00").cast(e.schema["reviewed_at"].dataType)
    log = review.append(review.review_tasks(t, e), review.bulk_approve_tasks(t, at, F.lit(-1), least=0.5))
    return review.reviewed_tasks(t, log).select("task_id", "status", "edited_label", "reviewed_at")


@query("tasks links", ", gone AS (SELECT * FROM tasks WHERE parent_task_id = 'N3') SELECT task_id, 'delete' AS action, concat('Deleted task: ', label) AS detail, CAST((SELECT count(*) FROM links l WHERE l.task_id = gone.task_id) AS BIGINT) AS orphaned FROM gone")
def deleted_tasks(spark, sf):
    """The log of a deletion, with the number of units that lose their task; an id that isn't there leaves no row."""
    t, links = fix.tasks(spark, sf), fix.links(spark, sf)
    ids = t.where("parent_task_id = 'N3'").select("task_id").unionByName(spark.createDataFrame([("none",)], "task_id string"))
    log = review.audit(t.limit(0), "", F.lit("2024-05-01").cast("timestamp"))
    left, kept, log = review.delete_tasks(t, links, log, ids, F.lit("2024-05-01").cast("timestamp"))
    orphaned = links.join(kept, links.columns, "left_anti").groupBy("task_id").agg(F.count("*").alias("orphaned"))
    log = log.join(left.select("task_id"), "task_id", "left_anti")
    return log.join(orphaned, "task_id", "left").select("task_id", "action", "detail", F.coalesce("orphaned", F.lit(0).cast("long")).alias("orphaned"))


@query("tasks", """SELECT task_id AS entity_id, CASE WHEN task_id LIKE 'R%' THEN concat('old/', task_id) ELSE concat('new/', regexp_replace(to_base64(unhex(sha256(task_id)[1:32])), '[^A-Za-z0-9]', '', 'g')) END AS iri, CASE WHEN task_id = 'R2' THEN '2024-05-01' END AS deprecated, CASE WHEN task_id = 'R2' THEN 'old/R3' END AS successor FROM tasks""")
def iri_registry(spark, sf):
    """Regions have IRIs, others get them; one is deprecated in favour of another."""
    t = fix.tasks(spark, sf)
    old = t.where(F.col("task_id").startswith("R")).select(F.col("task_id").alias("entity_id"), F.concat(F.lit("old/"), "task_id").alias("iri"), F.lit(None).cast("timestamp").alias("deprecated_at"))
    r = review.iri_registry(old, t.select(F.col("task_id").alias("entity_id")), "new/")
    r = review.deprecate(r, "R2", F.lit("2024-05-01").cast("timestamp"), "old/R3")
    return r.select("entity_id", "iri", F.date_format("deprecated_at", "yyyy-MM-dd").alias("deprecated"), "successor")


@query("decisions", ", v AS (SELECT *, lead(reviewed_at) OVER (PARTITION BY unit_ord ORDER BY reviewed_at) AS valid_to FROM (SELECT DISTINCT ON (unit_ord, reviewed_at) * FROM decisions)) SELECT unit_ord, strftime(reviewed_at, '%Y-%m-%d %H:%M:%S') AS a, strftime(valid_to, '%Y-%m-%d %H:%M:%S') AS z FROM v")
def supersession(spark, sf):
    d = fix.decisions(spark, sf).dropDuplicates(["unit_ord", "reviewed_at"])
    f = "yyyy-MM-dd HH:mm:ss"
    return review.supersession(d, "unit_ord", "reviewed_at").select("unit_ord", F.date_format("reviewed_at", f).alias("a"), F.date_format("valid_to", f).alias("z"))


@query("units tasks links", f""", {_CONTRA}, o AS (SELECT DISTINCT task_id FROM c WHERE resolution IS NULL), n AS (SELECT l.task_id, u.unit_type, count(*) AS n FROM links l JOIN units u ON u.ord = l.unit_ord GROUP BY ALL)
SELECT t.task_id, n.unit_type, CAST(coalesce(n.n, 0) AS BIGINT) AS n, t.task_id IN (SELECT task_id FROM o) AS has_unresolved FROM tasks t LEFT JOIN n ON n.task_id = t.task_id""")
def task_details(spark, sf):
    return review.task_detail(fix.tasks(spark, sf), _links(spark, sf), fix.units(spark, sf), _contradictions(spark, sf))


@query("units links", """, l AS (SELECT *, ((unit_ord * 7 + CAST(task_id[2:] AS BIGINT)) % 11) / 10.0 AS sure FROM links), f AS (SELECT *, row_number() OVER (PARTITION BY unit_ord ORDER BY sure DESC, task_id) AS r FROM l)
SELECT f.task_id, u.id AS unit_id, f.sure AS assignment_confidence, f.r = 1 AS is_canonical FROM f JOIN units u ON u.ord = f.unit_ord""")
def canonical_links(spark, sf):
    l = _links(spark, sf).withColumn("assignment_confidence", ((F.col("unit_ord") * 7 + F.expr("cast(substring(task_id, 2) as bigint)")) % 11).cast("double") / 10.0)
    return review.task_units(l, fix.units(spark, sf)).select("task_id", "unit_id", "assignment_confidence", "is_canonical")


@query("tasks", "SELECT task_id FROM tasks WHERE task_id LIKE 'C%' AND task_id LIKE '%5' AND CAST(task_id[2:] AS BIGINT) % 3 = 0 AND CAST(task_id[2:] AS BIGINT) % 100 >= 80")
def filtered_tasks(spark, sf):
    n = F.coalesce(F.expr("cast(substring(task_id, 2) as bigint)"), F.lit(0))
    t = fix.tasks(spark, sf).withColumn("status", F.when(F.col("task_id").startswith("C") & F.col("task_id").endswith("5"), "approved").otherwise("unreviewed"))
    t = t.withColumn("confidence", (n % 100) / 100).withColumn("has_contradictions", F.when(n % 3 == 0, True))
    return review.filter_tasks(t, "approved", "high", ("has_contradictions",)).select("task_id")


@query("units tasks links", "SELECT CAST((SELECT count(*) FROM tasks WHERE task_id LIKE '%1') AS BIGINT) AS total_tasks, CAST((SELECT count(*) FROM links WHERE task_id LIKE '%1') AS BIGINT) AS linked_units, CAST((SELECT count(*) FROM units) AS BIGINT) AS total_units")
def export_totals(spark, sf):
    return review.export_totals(fix.tasks(spark, sf).where(F.col("task_id").endswith("1")), _links(spark, sf), fix.units(spark, sf))


@query("units tasks links", f""", {_CONTRA}, b AS (SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM units GROUP BY ALL)
SELECT CAST((SELECT count(*) FROM tasks WHERE parent_task_id IS NULL) AS BIGINT) AS top_level, CAST((SELECT count(*) FROM c WHERE resolution IS NULL) AS BIGINT) AS pending, (SELECT band FROM b ORDER BY n DESC LIMIT 1) AS majority_band""")
def dashboard(spark, sf):
    u = fix.units(spark, sf)
    s = review.discovery_stats(fix.tasks(spark, sf).withColumn("status", F.lit("unreviewed")), _links(spark, sf), u, _contradictions(spark, sf))
    return review.dashboard(s, review.confidence_bands(u)).select("top_level", "pending", "majority_band")


@query("units decisions", """, l AS (SELECT *, row_number() OVER (PARTITION BY unit_ord ORDER BY reviewed_at DESC, event_id DESC) AS r FROM decisions)
SELECT u.id FROM units u JOIN l ON l.unit_ord = u.ord AND l.r = 1 WHERE l.status = 'approved' AND u.unit_type IN ('principle', 'pitfall') AND u.confidence < 0.5""")
def filtered_units(spark, sf):
    u = fix.tagged_units(spark, sf)
    d = review.latest(fix.decisions(spark, sf), ["unit_ord"], "reviewed_at", "event_id").join(u.select("ord", "id"), F.col("unit_ord") == F.col("ord")).select("id", "status")
    return review.list_units(review.with_review(u, d), confidence="low", status="approved", types=("principle", "pitfall")).select("id")


@query("decisions", "SELECT event_id FROM decisions WHERE unit_ord % 2 = 1")
def reset_reviews(spark, sf):
    log = fix.decisions(spark, sf).withColumn("id", F.col("unit_ord"))
    return review.reset(log, fix.units(spark, sf).select(F.col("ord").alias("id")).where("id % 2 = 0").union(spark.range(0, 100_000, 2).toDF("id")).distinct()).select("event_id")


# --- Models


@query("units", r"""SELECT id, CASE WHEN regexp_matches(text, '(?i)\b(?:avoid|never|do not|don''t|mistake|beware|danger|careful)\b') THEN 'pitfall' WHEN regexp_matches(text, '(?i)\b(?:must|shall|required|deadline|within \d+ days|rule \d+)\b') THEN 'procedural_rule'
WHEN regexp_matches(text, '(?i)\b(?:principle|always|generally|doctrine|purpose)\b') THEN 'principle' ELSE 'advice' END AS unit_type FROM (SELECT id, concat(text, CASE ord % 4 WHEN 0 THEN ' never' WHEN 1 THEN ' Rule 12' WHEN 2 THEN ' ALWAYS' ELSE '' END) AS text FROM units)""")
def classified_by_rules(spark, sf):
    k = F.col("ord") % 4
    more = F.when(k == 0, " never").when(k == 1, " Rule 12").when(k == 2, " ALWAYS").otherwise("")
    u = fix.units(spark, sf).withColumn("text", F.concat("text", more))
    return providers.classify_by_rules(u).select("id", "unit_type")


@query("units", "SELECT id, CASE WHEN ord % 3 = 0 THEN 'short' WHEN ord % 3 = 1 THEN text ELSE text END AS text, sha256(CASE WHEN ord % 3 = 0 THEN 'short' ELSE text END) AS content_hash FROM units")
def distilled_units(spark, sf):
    """A model that shortens some texts, gives blanks for others, and fails on the rest."""

    def call(rows):
        if any(int(r["id"][5:]) % 3 == 2 for r in rows):
            raise TimeoutError
        return [{"distilled_text": "short" if int(r["id"][5:]) % 3 == 0 else "  "} for r in rows]

    u = fix.units(spark, sf)
    parts = [providers.distill(u.where(F.col("ord") % 3 == k), call) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select("id", "text", "content_hash")


@query("", "SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) > 0.3 AND a.vec_id % 5 <> b.vec_id % 5")
def label_merges(spark, sf):
    """Tasks of several files whose labels' vectors are alike; the more confident of a pair stays."""
    e = fix.table(spark, sf, "embeddings")
    t = e.select(F.col("vec_id").alias("ord"), F.col("vec_id").cast("string").alias("task_id"), F.lit(1.0).alias("confidence"), F.concat(F.lit("f"), (F.col("vec_id") % 5).cast("string")).alias("source_file"))
    m = discovery.label_merges(t, e.select(F.col("vec_id").alias("ord"), "embedding"), 0.3)
    return m.select(F.col("first").alias("a"), F.col("ord").alias("b"))


@query("tasks", """SELECT concat('https://example.org/modules/knowledge/', task_id) AS s, 'class_and_individual' AS rule FROM tasks WHERE task_id LIKE 'R%'
UNION ALL SELECT concat('https://example.org/modules/knowledge/', task_id), 'individual_without_provenance' FROM tasks WHERE task_id LIKE 'R%'""")
def graph_type_clashes(spark, sf):
    """Regions that are declared as classes and as individuals, and say nothing of where they are from."""
    s = F.concat(F.lit("https://example.org/modules/knowledge/"), "task_id")
    t = fix.tasks(spark, sf)
    row = lambda d, p, o, kind="iri": d.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit(kind).alias("kind"), F.lit("").alias("datatype"))
    g = row(t, graph.RDF + "type", F.lit(graph.OWL + "Class")).unionByName(row(t, graph.RDFS + "label", F.col("label"), "literal")).unionByName(row(t.where(F.col("task_id").startswith("R")), graph.RDF + "type", F.lit(graph.OWL + "NamedIndividual")))
    return graph.validate(g, "https://example.org/modules/knowledge/").select("s", "rule")


@query("units", ", r AS (SELECT source_file, id, confidence, row_number() OVER (PARTITION BY source_file ORDER BY confidence DESC, id) AS rank FROM units) SELECT source_file, id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 7")
def surest_units(spark, sf):
    return similarity.top_k(fix.units(spark, sf), "source_file", F.col("confidence"), 7, "id").select("source_file", "id", "rank")


@query("units links", ", f AS (SELECT l.task_id, min(u.ord) AS first FROM links l JOIN units u ON u.ord = l.unit_ord GROUP BY l.task_id) SELECT task_id, first FROM f")
def first_units(spark, sf):
    w = Window.partitionBy("task_id").orderBy("ord")
    u = _links(spark, sf).join(fix.units(spark, sf).select(F.col("id").alias("unit_id"), "ord"), "unit_id").withColumn("_r", F.row_number().over(w))
    return u.where("_r = 1").select("task_id", F.col("ord").alias("first"))
