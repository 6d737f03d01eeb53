"""The engine end to end: extract units from files, discover tasks, export them. Every stage is a written table.

A corpus is a folder: ``registry``, ``units``, ``tasks``, ``links`` and ``decisions`` as Parquet, and ``export`` for what others read.
Runs write versions, ``name/v=N``, and the last one with a success mark counts, so that a run that dies leaves the one before. A
run that is called again goes on after the last stage that was finished with the same inputs and parameters.
"""

from __future__ import annotations

import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import discovery, elements, graph, providers, review, similarity, site, tagging
from ..operators.lineage import numbered
from ..sources import files as src
from ..sources import named_files
from .stages import Run, Store, name_of

TASK = "task_id string, label string, iri string, parent_task_id string, is_procedural boolean, confidence double, source_file string, heading_path array<string>, ord long, status string, canonical_order int, has_contradictions boolean, has_orphans boolean, jurisdiction_sensitive boolean"
LINK = "task_id string, unit_id string"
REGISTRY = "file_path string, content_hash string, format string"
CONTRADICTION = "contradiction_id string, task_id string, unit_id_a string, unit_id_b string, score double, contradiction_type string, explanation string, resolution string"
#: What is exported; ``site`` is a folder of pages.
FORMATS = ("nt", "ttl", "rdf", "jsonld", "html", "site", "md", "json")
CONCEPT = "iri string, label string, branch string, parent_iris array<string>"


def extract(spark: SparkSession, source: str, store: Store, concepts: DataFrame | None = None, high: float = fx.HIGH, medium: float = fx.MEDIUM, models: dict[str, Callable] | None = None, near: float | None = 0.85, parsers: dict | None = None, progress: Callable[[str, str, float], None] | None = None) -> DataFrame:
    """Units of the files below ``source`` that are new or changed, together with those of the files seen before.

    ``concepts(iri, label, branch, parent_iris)`` is the ontology; without one units get no tags. ``models`` may hold functions
    from a list of rows, each with ``id`` and ``text``, to a list of replies: ``distill``, ``classify``, ``novelty``, ``embed``
    (``embedding``; for the second tier of boundaries and the semantic tags), ``boundaries`` (``reply``, JSON; for the third
    tier) and ``concepts`` (``concepts``, JSON; tags). What isn't there is left out. ``near`` is the cosine above which
    units are near-duplicates, None for none. ``progress`` is told each stage's name and state, and the share that is done.
    """
    models = models or {}
    run = Run(store, "extract", "registry", progress, of=12 + 2 * len(models))
    registry = run.base("registry", REGISTRY)
    files = src.scan(spark, source)
    # what is new is told by the files' sizes and times, so that no content is read for it
    run.table("files", spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source).select("path", "length", "modificationTime"))
    run.table("ontology", concepts)
    of = lambda *names: [(n, name_of(models.get(n))) for n in names]
    new = src.needs_processing(files, registry)
    found, errors = src.ingest(new, parsers)
    e = run.stage("elements", lambda: src.elements_with_paths(found), ["files", "base:registry"], sorted(parsers or {}))

    def units_of() -> DataFrame:
        units = elements.knowledge_units(boundaries(run, e, models))
        units = providers.distill(units, models.get("distill"))
        return providers.novelty(providers.classify(units, models.get("classify")), models.get("novelty"))

    classified = run.stage("classified", units_of, ["elements"], of("embed", "boundaries", "distill", "classify", "novelty"))
    old = run.base("units_all")  # before deduplication: copies may lose the unit they went into

    def merged() -> DataFrame:
        units = tag(classified, concepts, models)
        if old is not None:  # units of files that were read again are replaced
            kept = old.join(new.select(F.col("file_path").alias("_f")), F.col("source_file") == F.col("_f"), "left_anti")
            units = kept.unionByName(units, allowMissingColumns=True)
        return numbered(units.drop("ord"), "source_file", "original_span.start", "id")

    units = run.stage("units_all", merged, ["classified", "base:units_all", "ontology"], of("embed", "concepts"))
    exact = lambda: similarity.exact_dedup(units).drop("merged")
    if near is not None:
        v = run.stage("unit_vectors", lambda: exact().withColumn("embedding", similarity.hash_embedding(F.col("text"), 256)), ["units_all"])
        kept = run.stage("units", lambda: similarity.near_dedup(v, near).drop("embedding"), ["unit_vectors"], near)
    else:
        kept = run.stage("units", exact, ["units_all"])
    run.stage("errors", lambda: errors, ["elements"])
    run.stage("summary", lambda: extraction_summary(kept, high, medium), ["units"], high, medium)
    run.stage("review", lambda: kept.select("id", fx.review_bucket(F.col("confidence"), high, medium).alias("bucket"), review_reason(high, medium).alias("reason")), ["units"], high, medium)
    run.stage("registry", lambda: src.mark_processed(registry, new.select("file_path", "content_hash", "format")), ["elements", "units", "review", "summary"])
    return kept


def review_reason(high: float = fx.HIGH, medium: float = fx.MEDIUM) -> Column:
    """Why a unit is in its bucket of the review."""
    c = F.format_number(F.col("confidence"), 2)
    below = lambda x: F.concat(F.lit("confidence "), c, F.lit(f" below {x:.2f}"))
    return F.when(F.col("confidence") >= high, F.concat(F.lit("confidence "), c)).when(F.col("confidence") >= medium, below(high)).otherwise(below(medium))


def boundaries(run: Run, e: DataFrame, models: dict[str, Callable]) -> DataFrame:
    """The three tiers: by structure; where a paragraph is long, by the likeness of its sentences; else by a model's reply."""
    b = run.stage("boundaries", lambda: elements.structural_boundaries(e), ["elements"])
    none = b.where(F.lit(False)).select("file_path", "seq", "part", "start", "end", "text", "confidence", "method")
    semantic = model = none
    if "embed" in models:
        sentences = elements.sentences_of(b).withColumn("id", F.struct("paragraph", "no"))
        semantic = run.stage("semantic_segments", lambda: elements.semantic_tier(providers.embed(sentences, models["embed"]).drop("id")), ["boundaries"], name_of(models["embed"]))
    if "boundaries" in models:
        key = ["file_path", "seq", "part"]
        left = b.where(elements.ambiguous(b)).join(semantic.select(*key).distinct(), key, "left_anti").withColumn("id", F.to_json(F.struct(*key)))
        got = providers.map_rows(left.select("id", "text"), models["boundaries"], "id string, reply string")
        # the paragraph's own beginning is the one place where structure and model can agree
        replies = left.join(got, "id").withColumn("candidates", F.array(F.lit(0).cast("long")))
        model = run.stage("model_segments", lambda: elements.model_segments(replies).select(*none.columns), ["boundaries", *["semantic_segments"] * ("embed" in models)], name_of(models["boundaries"]))
    return elements.refine(b, semantic.select(*none.columns), model)


def tag(units: DataFrame, concepts: DataFrame | None, models: dict[str, Callable] | None = None) -> DataFrame:
    """Units with ``tags``: the dictionary, the headings and, with their models, the likeness to concepts and a model's own
    concepts, reconciled. Concepts without an IRI are looked up by label, else they propose a class."""
    kind, models = "array<struct<iri:string,label:string,confidence:double,extraction_path:string,branch:string>>", models or {}
    if concepts is None:
        return units.withColumn("tags", F.array().cast(kind))
    r = tagging.as_concepts(tagging.ruler(units.select("id", "text"), concepts), "ruler")
    h = tagging.as_concepts(tagging.heading_concepts(units.select("id", F.col("source_section").alias("section_path")), concepts), "heading")
    none = F.lit(None).cast("array<struct<pos:int,iri:string,label:string,confidence:double,branch:string>>")
    u = units.select("id").join(r, "id", "left").join(h, "id", "left")
    if "concepts" in models:
        said = providers.map_rows(units.select("id", "text", fx.breadcrumb(F.col("source_section")).alias("section")), models["concepts"], "id string, concepts string")
        u = u.join(tagging.as_concepts(tagging.model_concepts(said), "llm"), "id", "left")
    else:
        u = u.withColumn("llm", none)
    if "embed" in models:
        near = tagging.semantic_concepts(providers.embed(units.select("id", "text"), models["embed"]), providers.embed(concepts.withColumn("text", F.col("label")), models["embed"], "iri"))
        u = u.join(tagging.as_concepts(near, "semantic"), "id", "left")
    else:
        u = u.withColumn("semantic", none)
    flat = tagging.reconcile(u).select("id", F.posexplode("concepts").alias("pos", "c")).select("id", "pos", "c.*")
    bare = flat.where("coalesce(iri, '') = ''").select("label")
    found = tagging.resolve(flat, tagging.label_matches(bare, concepts))
    tags = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.struct("iri", "label", "confidence", "extraction_path", "branch").alias("t")))), lambda x: x["t"])
    found = found.groupBy(F.col("id").alias("_id")).agg(tags.alias("tags"))
    u = units.join(found, F.col("id") == F.col("_id"), "left").drop("_id").withColumn("tags", F.coalesce("tags", F.array()).cast(kind))
    return u.withColumn("confidence", tagging.unit_confidence(F.col("tags"), F.col("confidence")))


def extraction_summary(units: DataFrame, high: float = fx.HIGH, medium: float = fx.MEDIUM) -> DataFrame:
    """``measure, key, n``: units, bands, types and distinct concepts."""
    row = lambda d, m, k: d.select(F.lit(m).alias("measure"), k.cast("string").alias("key"), F.col("n").cast("long").alias("n"))
    total = units.agg(F.count("*").alias("n"))
    concepts = units.select(F.explode("tags.iri").alias("iri")).where("iri <> ''").agg(F.count_distinct("iri").alias("n"))
    out = row(total, "total", F.lit("units")).unionByName(row(review.confidence_bands(units, high, medium), "band", F.col("band")))
    out = out.unionByName(row(units.groupBy("unit_type").agg(F.count("*").alias("n")), "type", F.col("unit_type")))
    return out.unionByName(row(concepts, "concepts", F.lit("distinct")))


def discover(spark: SparkSession, store: Store, concepts: DataFrame | None = None, cluster_threshold: float = 0.5, merge_threshold: float = 0.85, models: dict[str, Callable] | None = None, progress: Callable[[str, str, float], None] | None = None) -> DataFrame:
    """Tasks of the corpus' units with their links; tasks that a reviewer approved or edited stay as they are.

    ``models`` may hold functions from a list of rows to a list of replies: ``labels`` (rows of ``id, texts``, replies of
    ``label, confidence``), ``order`` (rows of a parent's ``id, label, children``, replies of ``ordered``, labels in order
    or null), ``contradiction`` (rows of ``id, text_a, text_b``, replies of ``score``), and ``confirm`` (the same rows,
    replies of ``contradiction_type, explanation``).
    """
    models = models or {}
    units = store.read("units")
    if units is None:
        raise ValueError("nothing has been extracted")
    run = Run(store, "discover", "diff", progress, of=18 + ("order" in models))
    stage, model = run.stage, lambda *names: [(n, name_of(models.get(n))) for n in names]
    run.given("units", [store.last("units"), store.marked("units", store.last("units")).get("print")])
    run.table("ontology", concepts)
    known = concepts if concepts is not None else spark.createDataFrame([], CONCEPT)
    before, before_links = with_columns(run.base("tasks", TASK), TASK), run.base("links", LINK)
    heads = discovery.heading_candidates(units)
    vectors = stage("discovery_vectors", lambda: units.select("id", similarity.hash_embedding(F.col("text"), 256).alias("embedding")), ["units"])
    found = stage("clusters", lambda: similarity.cluster(vectors, cluster_threshold), ["discovery_vectors"], cluster_threshold)

    def candidates() -> DataFrame:
        labels = None
        if "labels" in models:
            prompts = discovery.prompt_texts(units, found).select(F.col("cluster").cast("string").alias("id"), "texts")
            labels = providers.map_rows(prompts, models["labels"], "id string, label string, confidence double").withColumnRenamed("id", "cluster")
        clusters = discovery.cluster_candidates(units, found, heads.select(F.explode("unit_ids").alias("id")), labels)
        cand = heads.withColumn("_s", F.lit(0)).unionByName(clusters.withColumn("_s", F.lit(1)))
        cand = numbered(cand, "_s", "first", "label").drop("_s", "first")
        return cand.withColumn("candidate", F.col("ord"))

    cand = stage("candidates", candidates, ["units", "clusters"], model("labels"))

    def mapping() -> DataFrame:
        t = cand.select("candidate", F.posexplode("unit_ids").alias("up", "id")).join(units.select("id", F.posexplode("tags").alias("tp", "t")), "id")
        modes = discovery.concept_mode(t.select("candidate", (F.col("up") * 1000 + F.col("tp")).alias("pos"), "t.iri", "t.label", "t.confidence"))
        return discovery.map_candidates(cand, modes)

    mapped = stage("mapped", mapping, ["candidates"])

    def tasks_of() -> DataFrame:
        deeper = discovery.deepest_concept(mapped.select("candidate", "iri", "label"), known).select("candidate", F.col("iri").alias("_iri"))
        return discovery.to_tasks(mapped.join(deeper, "candidate", "left").withColumn("iri", F.coalesce("_iri", "iri")).drop("_iri"))

    first = stage("tasks_found", tasks_of, ["mapped", "ontology"])
    links = stage("links_found", lambda: first.select("task_id", F.explode("unit_ids").alias("unit_id")), ["tasks_found"])
    unset = lambda kind: F.lit(None).cast(kind)

    def parented() -> DataFrame:
        t = discovery.parents(first, known.select("iri", "parent_iris"))
        return t.withColumn("is_procedural", F.lit(False)).withColumn("status", F.lit("unreviewed")).withColumn("iri", F.coalesce("iri", F.lit(""))).withColumn("canonical_order", unset("int"))

    cols = [c.strip().split()[0] for c in TASK.split(", ")]

    def ordered() -> DataFrame:
        t = parented()
        if "order" in models:
            t = stage("tasks_unordered", parented, ["tasks_found", "ontology"])
            child = t.where("parent_task_id is not null").groupBy(F.col("parent_task_id").alias("task_id")).agg(F.array_sort(F.collect_list("label")).alias("children"))
            asked = t.where("not is_procedural").select("task_id", "label").join(child, "task_id").withColumnRenamed("task_id", "id")
            orders = providers.map_rows(asked, models["order"], "id string, ordered array<string>").where("ordered is not null").select(F.col("id").alias("parent_task_id"), F.col("ordered").alias("labels"))
            t = discovery.procedural_order(t.drop("canonical_order"), orders).withColumn("canonical_order", F.col("canonical_order").cast("int"))
        for flag in ("has_contradictions", "has_orphans", "jurisdiction_sensitive"):
            t = t.withColumn(flag, F.lit(False))
        return t.select(*cols)

    tasks = stage("tasks_parented", ordered, ["tasks_found", "ontology"], model("order"))
    assigned = stage("links_assigned", lambda: links_with_orphans(run, tasks, links, units), ["links_found", "tasks_parented", "units"])
    v = stage("label_vectors", lambda: tasks.select("ord", similarity.hash_embedding(F.col("label"), 256).alias("embedding")), ["tasks_parented"])

    def merging() -> DataFrame:
        m = discovery.iri_merges(tasks).withColumn("stage", F.lit(0)).unionByName(discovery.label_merges(tasks, v, merge_threshold).withColumn("stage", F.lit(1)))
        return m.select("stage", "first", "ord", "canonical", "merged")

    wanted = stage("merge_candidates", merging, ["tasks_parented", "label_vectors"], merge_threshold)
    merges = stage("merges", lambda: discovery.settle_merges(wanted), ["merge_candidates"])
    merged, merged_links = discovery.apply_merges(tasks, assigned, merges)
    kept_links = stage("links_merged", lambda: merged_links.select("task_id", "unit_id"), ["links_assigned", "merges"])
    against = stage("contradictions", lambda: find_contradictions(spark, kept_links, units, models), ["links_merged", "units"], model("contradiction", "confirm"))

    def final() -> DataFrame:
        t = flagged(merged, kept_links, units, against, store.read("orphans", "unit_id string, task_id string"))
        return discovery.with_locked(t.select(*cols), before.where(F.col("status").isin("approved", "edited")).select(*cols))

    done = stage("tasks", final, ["tasks_parented", "merges", "links_merged", "contradictions", "base:tasks"])
    done_links = stage("links", lambda: kept_links, ["links_merged", "base:links"])
    counted = lambda t, l: t.select("task_id", "label", "parent_task_id", "iri").join(l.groupBy("task_id").agg(F.count("*").alias("n_units")), "task_id", "left").withColumn("n_units", F.coalesce("n_units", F.lit(0).cast("long")))
    stage("diff", lambda: discovery.task_diff(counted(before, before_links), counted(done, done_links)), ["tasks", "links"])
    return done


def with_columns(rows: DataFrame, schema: str) -> DataFrame:
    """Rows of an earlier version with nulls for the columns that they don't have yet."""
    for c in schema.split(", "):
        name, kind = c.strip().split(maxsplit=1)
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows


def links_with_orphans(run: Run, tasks: DataFrame, links: DataFrame, units: DataFrame) -> DataFrame:
    """Links, and those of the units without a task to the task whose units' texts are most like theirs; ``orphans`` keeps them."""
    left = discovery.orphans(units, links)
    vector = lambda name: similarity.hash_embedding(F.col("text"), 256).alias(name)
    texts = discovery.centroid_texts(links, units).join(tasks.select("task_id", "ord"), "task_id")
    centre = run.stage("centroids", lambda: texts.select(F.col("task_id").alias("centre"), "ord", vector("cv")), ["links_found", "tasks_parented", "units"])
    found = run.stage("orphans", lambda: discovery.assign_orphans(left.select("id", vector("v")), centre), ["centroids"])
    return links.unionByName(found.select("task_id", "unit_id"))


def find_contradictions(spark: SparkSession, links: DataFrame, units: DataFrame, models: dict[str, Callable]) -> DataFrame:
    """Pairs of a task's units that the first model scores above the threshold and the second confirms; without the first
    there are none, without the second none are confirmed."""
    if "contradiction" not in models:
        return spark.createDataFrame([], CONTRADICTION)
    pairs = discovery.unit_pairs(links, units)
    hits = discovery.screen(pairs, discovery.scored_pairs(pairs, units, models["contradiction"]))
    text = lambda c: units.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}"))
    hits = hits.join(text("a"), "a").join(text("b"), "b").withColumn("id", fx.content_id(F.col("task_id"), F.col("a"), F.col("b")))
    found = providers.contradictions(hits, models.get("confirm"))
    return found.select(F.col("id").alias("contradiction_id"), "task_id", F.col("a").alias("unit_id_a"), F.col("b").alias("unit_id_b"), "score", "contradiction_type", "explanation", F.lit(None).cast("string").alias("resolution"))


def flagged(tasks: DataFrame, links: DataFrame, units: DataFrame, contradictions: DataFrame, orphans: DataFrame) -> DataFrame:
    """Tasks with their flags: contradictions, units that were assigned as orphans, and texts that hang on a jurisdiction."""
    law = discovery.jurisdiction_flags(links, units).withColumnRenamed("jurisdiction_sensitive", "_law")
    has = lambda d, name: d.select("task_id").distinct().withColumn(name, F.lit(True))
    late = links.join(orphans.select("unit_id").distinct(), "unit_id", "left_semi")
    t = tasks.join(law, "task_id", "left").join(has(contradictions, "_con"), "task_id", "left").join(has(late, "_late"), "task_id", "left")
    t = t.withColumn("jurisdiction_sensitive", F.coalesce("_law", F.lit(False))).withColumn("has_contradictions", F.coalesce("_con", F.lit(False))).withColumn("has_orphans", F.coalesce("_late", F.lit(False)))
    return t.drop("_law", "_con", "_late")


def export(spark: SparkSession, store: Store, into: str, formats: tuple[str, ...] = FORMATS, approved_only: bool = False, module: str = graph.MODULE, whole_files: bool = True) -> dict[str, str]:
    """Files below the local folder ``into``, and the triples as a version of the corpus; a validation report is always
    among them. Returns their paths by format.

    The site is a folder below the corpus, ``export/site``, a page a file. Without ``whole_files`` the other formats are folders of text files below the corpus, ``export/<format>``, that executors write
    in parallel; the reports stay in ``into``."""
    tasks, links, units = store.read("tasks", TASK), store.read("links", LINK), store.read("units")
    if units is None:
        raise ValueError("nothing has been extracted")
    if approved_only:
        tasks = tasks.where(F.col("status").isin("approved", "edited"))
    registry = store.read("iris", "entity_id string, iri string, deprecated_at timestamp")
    wanted = tasks.where("iri = ''").select(F.col("task_id").alias("entity_id")).union(units.select("id"))
    registry = store.write("iris", review.iri_registry(registry, wanted, module + "/"))
    minted = registry.select(F.col("entity_id").alias("_e"), F.col("iri").alias("_i"))
    t = tasks.join(minted, F.col("task_id") == F.col("_e"), "left").withColumn("iri", F.coalesce(F.nullif("iri", F.lit("")), "_i")).drop("_e", "_i")
    u = units.join(minted, F.col("id") == F.col("_e"), "left").select("ord", "id", F.col("_i").alias("iri"), "text", "unit_type", "confidence", F.col("surprise_score").alias("novelty"), "source_file")
    previous = store.read("triples")
    triples = store.write("triples", graph.triples(t, links, u, store.read("contradictions"), module=module))
    base = Path(into)
    base.mkdir(parents=True, exist_ok=True)
    out: dict[str, str] = {}

    def lines(name: str, df: DataFrame, head: str = "", foot: str = "") -> None:
        kind = name.rpartition(".")[2]
        if not whole_files:
            out[kind] = f"{store.root}/export/{kind}"
            df.write.mode("overwrite").text(out[kind])
            return
        path = base / name
        with path.open("w", encoding="utf-8") as f:  # rows come a partition at a time
            f.write(head)
            f.writelines(r["value"] + "\n" for r in df.toLocalIterator())
            f.write(foot)
        out[kind] = str(path)

    outline = graph.outline_lines(t, links, u).orderBy("sort")
    if "nt" in formats:
        lines("graph.nt", graph.ntriples(triples).orderBy("value"))
    if "ttl" in formats:
        lines("graph.ttl", graph.turtle(triples, module).orderBy("s").select("value"), graph.turtle_head(module))
    if "rdf" in formats:
        lines("graph.rdf", graph.rdfxml(triples, module).orderBy("s").select("value"), graph.rdfxml_head(module), "</rdf:RDF>\n")
    if "jsonld" in formats:
        lines("tasks.jsonld", graph.jsonld_chunks(t, links, u).orderBy("task_id").select("value"))
    if "md" in formats:
        lines("tasks.md", outline.select("value"), "# Task Hierarchy\n\n")
    if "html" in formats:
        row = F.concat(F.lit('<div style="white-space:pre-wrap">'), fx.escape_html(F.col("value")), F.lit("</div>"))
        lines("tasks.html", outline.select(row.alias("value")), '<!DOCTYPE html><html><head><meta charset="utf-8"><title>Tasks</title></head><body>\n', "</body></html>\n")
    if "site" in formats:
        out["site"] = named_files.write(spark, site.pages(t, links, u), f"{store.root}/export/site")
    if "json" in formats:
        lines("tasks.json", graph.tree_json(t).orderBy("ord").select("value"))
    rules = {r["rule"]: r["n"] for r in graph.validate(triples, module + "/").groupBy("rule").agg(F.count("*").alias("n")).collect()}
    stats = graph.graph_stats(triples).first()
    report = ["# Validation report", "", "**FAILED**" if rules else "**PASSED**", ""] + [f"- {k}: {n} violations" for k, n in sorted(rules.items())] + [f"- {k}: {stats[k]}" for k in ("classes", "individuals", "triples")]
    (base / "validation-report.md").write_text("\n".join(report) + "\n")
    out["validation"] = str(base / "validation-report.md")
    diff = graph.graph_diff(previous if previous is not None else triples.where(F.lit(False)), triples)
    (base / "CHANGELOG.md").write_text("\n".join(["# Changelog", "", *graph.changelog(diff)]) + "\n")
    out["changelog"] = str(base / "CHANGELOG.md")
    return out


def reports(store: Store, into: str) -> dict[str, str]:
    """JSON files below the local folder ``into``, a row a line: ``extraction`` (the units), ``summary``, ``review`` (the units'
    buckets and why) and ``proposed_classes``. Returns their paths."""
    units = store.read("units")
    if units is None:
        raise ValueError("nothing has been extracted")
    tags = units.select("ord", F.posexplode("tags").alias("pos", "t")).select("ord", "pos", "t.iri", "t.label", "t.confidence")
    rows = {
        "extraction": units.orderBy("ord").select(F.to_json(F.struct(*units.columns)).alias("value")),
        "review": store.read("review").orderBy("bucket", "id").select(F.to_json(F.struct("bucket", "id", "reason")).alias("value")),
        "summary": store.read("summary").orderBy("measure", "key").select(F.to_json(F.struct("measure", "key", "n")).alias("value")),
        "proposed_classes": tagging.proposed_classes(tags).orderBy("label").select(F.to_json(F.struct("label", "ord", "confidence")).alias("value")),
    }
    base = Path(into)
    base.mkdir(parents=True, exist_ok=True)
    for name, df in rows.items():
        with (base / f"{name}.json").open("w", encoding="utf-8") as f:  # a JSON array with a row a line, a partition at a time
            f.write("[")
            for i, r in enumerate(df.toLocalIterator()):
                f.write(("," if i else "") + "\n" + r["value"])
            f.write("\n]\n")
    return {name: str(base / f"{name}.json") for name in rows}


def bundle(paths: dict[str, str], into: str) -> str:
    with zipfile.ZipFile(into, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(paths.values()):
            base = Path(p.removeprefix("file://").removeprefix("file:"))
            for f in [base] if base.is_file() else sorted(x for x in base.rglob("*") if x.is_file()):
                z.write(f, f.relative_to(base.parent))
    return into
