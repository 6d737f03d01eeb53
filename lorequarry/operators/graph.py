"""Export of tasks and units as a graph of triples, its checks, its differences, and renderings of the task tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from .discovery import depths
from .lineage import cut

# Namespaces of public vocabularies.
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
SKOS = "http://www.w3.org/2004/02/skos/core#"
PROV = "http://www.w3.org/ns/prov#"
DC = "http://purl.org/dc/elements/1.1/"
#: The module that exports belong to; callers set their own.
MODULE = "https://example.org/modules/knowledge"

# Annotation properties of the module, and the unit types that annotate a task.
PROPERTIES = ("bestPractice", "principle", "pitfall", "confidence", "noveltyScore", "unitType", "isProcedural", "sourceFile", "contradictionNote")
ANNOTATING = {"best_practice": "bestPractice", "principle": "principle", "pitfall": "pitfall"}

COLUMNS = ("s", "p", "o", "kind", "datatype")


def _triple(s: Column, p: str | Column, o: Column, kind: str = "literal", datatype: str = "") -> Column:
    p = F.lit(p) if isinstance(p, str) else p
    return F.struct(s.alias("s"), p.alias("p"), o.cast("string").alias("o"), F.lit(kind).alias("kind"), F.lit(datatype).alias("datatype"))


def _said(rows: DataFrame, *statements: Column) -> DataFrame:
    """The statements on each row, in one pass over them; null ones are left out."""
    return rows.select(F.explode(F.filter(F.array(*statements), lambda x: x.isNotNull())).alias("x")).select("x.*")


def triples(tasks: DataFrame, links: DataFrame, units: DataFrame, contradictions: DataFrame | None = None, module: str = MODULE, imports: tuple[str, ...] = ()) -> DataFrame:
    """``tasks(task_id, label, iri, parent_task_id, is_procedural)``, ``links(task_id, unit_id)``, ``units(id, iri, text,
    unit_type, confidence, novelty, source_file)`` -> distinct ``s, p, o, kind, datatype``.

    Tasks are read once, and so are linked units; a unit without an IRI says nothing of itself. ``imports`` are the
    ontologies that the module builds on.
    """
    spark, fi = tasks.sparkSession, f"{module}/"
    iri = lambda ns, x: F.lit(f"{ns}{x}")
    m, s = F.lit(module), F.col("iri")
    out = _said(spark.range(1), _triple(m, f"{RDF}type", iri(OWL, "Ontology"), "iri"), _triple(m, f"{RDFS}label", F.lit("Knowledge module")), _triple(m, f"{DC}description", F.lit("Knowledge extracted from documents")), *[_triple(F.lit(fi + p), f"{RDF}type", iri(OWL, "AnnotationProperty"), "iri") for p in PROPERTIES], *[_triple(m, f"{OWL}imports", F.lit(x), "iri") for x in imports])
    up = tasks.select(F.col("task_id").alias("parent_task_id"), F.col("iri").alias("up"))
    out = out.unionByName(_said(
        tasks.join(up, "parent_task_id", "left"),
        _triple(s, f"{RDF}type", iri(OWL, "Class"), "iri"),
        _triple(s, f"{RDFS}label", F.col("label")),
        F.when(F.col("is_procedural"), _triple(s, f"{fi}isProcedural", F.lit("true"), "literal", f"{XSD}boolean")),
        F.when(F.col("up").isNotNull(), _triple(s, f"{RDFS}subClassOf", F.col("up"), "iri")),
    ))
    # what a unit says of itself is said once, not once a link; of a text that annotates a task only the digest meets the links
    own = F.coalesce(s, F.lit("")) != ""
    named = F.create_map(*[F.lit(x) for k, v in ANNOTATING.items() for x in (k, fi + v)])
    u = units.withColumnRenamed("id", "unit_id")
    held = links.select("task_id", "unit_id").distinct().join(tasks.select("task_id", F.col("iri").alias("task_iri")), "task_id").select("task_iri", "unit_id")
    out = out.unionByName(_said(held.join(u.select("unit_id", "iri").where(own), "unit_id"), _triple(s, f"{RDF}type", F.col("task_iri"), "iri")))
    out = out.unionByName(_said(
        u.where(own).join(held.select("unit_id").distinct(), "unit_id", "left_semi"),
        _triple(s, f"{RDF}type", iri(OWL, "NamedIndividual"), "iri"),
        _triple(s, f"{RDFS}label", F.substring("text", 1, 100)),
        _triple(s, f"{SKOS}note", F.col("text")),
        _triple(s, f"{fi}unitType", F.coalesce("unit_type", F.lit("unknown"))),
        _triple(s, f"{fi}confidence", F.coalesce("confidence", F.lit(0.0)), "literal", f"{XSD}float"),
        F.when(F.col("novelty").isNotNull(), _triple(s, f"{fi}noveltyScore", F.col("novelty"), "literal", f"{XSD}float")),
        _triple(s, f"{PROV}wasDerivedFrom", F.coalesce("source_file", F.lit(""))),
        _triple(s, f"{DC}source", F.coalesce("source_file", F.lit(""))),
    ))
    notes, digest = u.where(F.col("unit_type").isin(*ANNOTATING)), F.coalesce(F.sha2("text", 256), F.lit("")).alias("digest")
    said = notes.select("unit_id", F.try_element_at(named, F.col("unit_type")).alias("p"), digest)
    once = held.join(said, "unit_id").groupBy("task_iri", "p", "digest").agg(F.min("unit_id").alias("unit_id"))
    notes = once.join(notes.select("unit_id", "text", digest).dropDuplicates(["unit_id", "digest"]), ["unit_id", "digest"])
    annotations = notes.select(F.col("task_iri").alias("s"), "p", F.col("text").alias("o"), F.lit("literal").alias("kind"), F.lit("").alias("datatype"))
    if contradictions is not None:
        c = contradictions.join(tasks.select("task_id", "iri"), "task_id")
        note = F.concat(F.lit("Contradiction between "), "unit_id_a", F.lit(" and "), "unit_id_b", F.lit(" (type: "), F.coalesce("contradiction_type", F.lit("unknown")), F.lit(", resolution: "), F.coalesce("resolution", F.lit("unresolved")), F.lit(")"))
        out = out.unionByName(_said(c, _triple(s, f"{fi}contradictionNote", note)))
    # no other statement has their predicates
    return out.dropDuplicates().unionByName(annotations)


def _literal() -> Column:
    text = F.col("o")
    for raw, safe in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return F.concat(F.lit('"'), text, F.lit('"'), F.when(F.col("datatype") != "", F.concat(F.lit("^^<"), "datatype", F.lit(">"))).otherwise(""))


def ntriples(t: DataFrame) -> DataFrame:
    """A line of N-Triples each."""
    obj = F.when(F.col("kind") == "iri", F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(_literal())
    return t.select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), obj, F.lit(" .")).alias("value"))


def prefixes(module: str = MODULE) -> dict[str, str]:
    return {"rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "skos": SKOS, "prov": PROV, "dc": DC, "fi": f"{module}/"}


def _short(iri: Column, module: str) -> Column:
    """The prefixed name of an IRI whose namespace has a prefix and whose rest is a plain name, else null."""
    cases = [F.when(F.startswith(iri, F.lit(ns)) & F.substring(iri, len(ns) + 1, 1 << 20).rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"), F.concat(F.lit(f"{p}:"), F.substring(iri, len(ns) + 1, 1 << 20))) for p, ns in prefixes(module).items()]
    return F.coalesce(*cases)


def turtle(t: DataFrame, module: str = MODULE) -> DataFrame:
    """A block of Turtle for each subject: ``s, value``, to follow ``turtle_head``."""
    name = lambda c: F.coalesce(_short(F.col(c), module), F.concat(F.lit("<"), c, F.lit(">")))
    obj = F.when(F.col("kind") == "iri", name("o")).otherwise(_literal())
    said = F.concat(F.when(F.col("p") == f"{RDF}type", "a").otherwise(name("p")), F.lit(" "), obj)
    g = t.select("s", said.alias("said"), (F.col("p") != f"{RDF}type").alias("later")).groupBy("s").agg(F.array_sort(F.collect_set(F.struct("later", "said"))).alias("x"))
    return g.select("s", F.concat(name("s"), F.lit(" "), F.array_join(F.transform("x", lambda x: x["said"]), " ;\n    "), F.lit(" .")).alias("value"))


def turtle_head(module: str = MODULE) -> str:
    return "".join(f"@prefix {p}: <{ns}> .\n" for p, ns in prefixes(module).items()) + "\n"


def rdfxml(t: DataFrame, module: str = MODULE) -> DataFrame:
    """An element of RDF/XML for each subject: ``s, value``, to stand between ``rdfxml_head`` and its end tag. Predicates
    without a prefix are left out, as XML has no name for them."""
    esc = lambda c: fx.escape_html(F.col(c))
    kind = F.when(F.col("datatype") != "", F.concat(F.lit(' rdf:datatype="'), esc("datatype"), F.lit('"'))).otherwise("")
    body = F.when(F.col("kind") == "iri", F.concat(F.lit(' rdf:resource="'), esc("o"), F.lit('"/>'))).otherwise(F.concat(kind, F.lit(">"), esc("o"), F.lit("</"), "n", F.lit(">")))
    g = t.withColumn("n", _short(F.col("p"), module)).where("n is not null").select("s", F.concat(F.lit("    <"), "n", body).alias("x")).groupBy("s").agg(F.array_sort(F.collect_set("x")).alias("x"))
    return g.select("s", F.concat(F.lit('  <rdf:Description rdf:about="'), esc("s"), F.lit('">\n'), F.array_join("x", "\n"), F.lit("\n  </rdf:Description>")).alias("value"))


def rdfxml_head(module: str = MODULE) -> str:
    return '<?xml version="1.0" encoding="utf-8"?>\n<rdf:RDF' + "".join(f'\n    xmlns:{p}="{ns}"' for p, ns in prefixes(module).items()) + ">\n"


def _of_type(t: DataFrame, kind: str) -> DataFrame:
    return t.where((F.col("p") == f"{RDF}type") & (F.col("o") == f"{OWL}{kind}")).select("s").distinct()


def missing(t: DataFrame, kind: str, predicate: str) -> DataFrame:
    """Entities of a type that lack a predicate."""
    return _of_type(t, kind).join(t.where(F.col("p") == predicate).select("s").distinct(), "s", "left_anti")


def dangling_references(t: DataFrame, namespace: str) -> DataFrame:
    """Triples to an IRI of the namespace that is no subject; namespaces themselves are exempt."""
    refs = t.where((F.col("kind") == "iri") & F.startswith(F.col("o"), F.lit(namespace)) & ~F.endswith(F.col("o"), F.lit("/")))
    return refs.join(t.select(F.col("s").alias("_s")).distinct(), F.col("o") == F.col("_s"), "left_anti")


def twofold(t: DataFrame) -> DataFrame:
    """IRIs that are a class and an individual."""
    return _of_type(t, "Class").intersect(_of_type(t, "NamedIndividual"))


def auto_prefixes(text: Column) -> Column:
    """Whether a rendering has prefixes that a serializer made up."""
    return text.rlike(r"\bns(?:1?[0-9]):")


def validate(t: DataFrame, namespace: str) -> DataFrame:
    """``rule, s``: every violation. The rules look at subjects, predicates and IRIs, which are written once for all of them."""
    t = cut(t.select("s", "p", F.when(F.col("kind") == "iri", F.col("o")).alias("o"), "kind").distinct())
    rows = [
        missing(t, "Class", f"{RDFS}label").withColumn("rule", F.lit("class_without_label")),
        missing(t, "NamedIndividual", f"{PROV}wasDerivedFrom").withColumn("rule", F.lit("individual_without_provenance")),
        dangling_references(t, namespace).select("s").withColumn("rule", F.lit("dangling_reference")),
        twofold(t).withColumn("rule", F.lit("class_and_individual")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("rule", "s")


def graph_stats(t: DataFrame) -> DataFrame:
    typed = lambda k: F.count_if((F.col("p") == f"{RDF}type") & (F.col("o") == f"{OWL}{k}"))
    return t.agg(typed("Class").alias("classes"), typed("NamedIndividual").alias("individuals"), F.count("*").alias("triples"))


def entities(t: DataFrame) -> DataFrame:
    """``s, kind, label`` of classes and individuals; without a label the IRI."""
    labels = t.where(F.col("p") == f"{RDFS}label").groupBy("s").agg(F.min("o").alias("label"))
    both = _of_type(t, "Class").withColumn("kind", F.lit("class")).unionByName(_of_type(t, "NamedIndividual").withColumn("kind", F.lit("individual")))
    return both.join(labels, "s", "left").withColumn("label", F.coalesce("label", "s"))


def graph_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """``s, kind, change, old_label, new_label``; change is added, removed, changed or unchanged."""
    o = entities(before).withColumnRenamed("label", "old_label")
    n = entities(after).withColumnRenamed("label", "new_label")
    j = o.join(n, ["s", "kind"], "full")
    change = F.when(F.col("old_label").isNull(), "added").when(F.col("new_label").isNull(), "removed").when(F.col("old_label") == F.col("new_label"), "unchanged").otherwise("changed")
    return j.select("s", "kind", change.alias("change"), "old_label", "new_label")


def changelog(diff: DataFrame, kind: str = "class") -> list[str]:
    """The lines of a changelog: counts, then the entries by IRI. Only what changed comes to the driver."""
    n = {r["change"]: r["n"] for r in diff.where(F.col("kind") == kind).groupBy("change").agg(F.count("*").alias("n")).collect()}
    lines = [f"- {n.get(c, 0)} {c}" for c in ("added", "removed", "changed", "unchanged")]
    for r in diff.where((F.col("kind") == kind) & (F.col("change") != "unchanged")).orderBy("s").toLocalIterator():
        what = f"{r['old_label']} -> {r['new_label']}" if r["change"] == "changed" else r["new_label"] or r["old_label"]
        lines.append(f"- {r['change']}: {what} ({r['s']})")
    return lines


def jsonld_chunks(tasks: DataFrame, links: DataFrame, units: DataFrame) -> DataFrame:
    """One JSON object for each root task, with its units and direct subtasks: ``task_id, value``."""
    child = tasks.where("parent_task_id is not null").groupBy("parent_task_id").agg(F.array_sort(F.collect_list(F.struct("task_id", F.struct(F.col("iri").alias("@id"), F.col("label").alias("rdfs:label")).alias("c")))).alias("cs"))
    child = child.select(F.col("parent_task_id").alias("task_id"), F.transform("cs", lambda x: x["c"]).alias("subtasks"))
    unit = F.struct(F.coalesce("iri", F.lit("")).alias("@id"), F.lit("owl:NamedIndividual").alias("@type"), F.substring("text", 1, 100).alias("rdfs:label"), F.col("text").alias("skos:note"), F.coalesce("unit_type", F.lit("unknown")).alias("fi:unitType"), F.coalesce("confidence", F.lit(0.0)).alias("fi:confidence"), F.coalesce("source_file", F.lit("")).alias("dc:source"))
    roots = tasks.where("parent_task_id is null")
    held = links.join(roots.select("task_id"), "task_id").join(units.withColumnRenamed("id", "unit_id"), "unit_id")
    held = held.groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("ord", unit.alias("u")))).alias("us")).select("task_id", F.transform("us", lambda x: x["u"]).alias("units"))
    j = roots.join(child, "task_id", "left").join(held, "task_id", "left")
    none = F.array().cast(held.schema["units"].dataType)
    obj = F.struct(F.lit("./context.jsonld").alias("@context"), F.col("iri").alias("@id"), F.lit("owl:Class").alias("@type"), F.col("label").alias("rdfs:label"), F.coalesce("is_procedural", F.lit(False)).alias("fi:isProcedural"), F.col("subtasks").alias("fi:subtasks"), F.coalesce("units", none).alias("fi:units"))
    return j.select("task_id", F.to_json(obj).alias("value"))


def outline_lines(tasks: DataFrame, links: DataFrame, units: DataFrame) -> DataFrame:
    """The task tree as lines of Markdown in order: ``sort, value``. Subtrees of a missing parent are left out.

    Tasks come by ``ord`` below their parent, each followed by its units by type in display order, then by its children.
    """
    top = tasks.where("parent_task_id is null").select("task_id")
    d = depths(tasks).join(top.select(F.col("task_id").alias("root")), "root").where("depth is not null")
    place = d.select("task_id", "depth", F.posexplode("path").alias("i", "step")).join(tasks.select(F.col("task_id").alias("step"), F.col("ord").alias("o")), "step")
    # a task's key is the places of the tasks on its path, padded; a blank part sorts its own lines before its children's
    key = place.groupBy("task_id", "depth").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "o"))), lambda x: F.lpad(x["o"].cast("string"), 12, "0")), "/").alias("key"))
    t = tasks.join(key, "task_id")
    indent = F.repeat(F.lit("  "), F.col("depth"))
    head = t.select(F.concat("key", F.lit("!0")).alias("sort"), F.concat(indent, F.lit("- **"), "label", F.lit("**"), F.when(F.col("is_procedural"), " (procedural -- ordered steps)").otherwise("")).alias("value"))
    # texts meet their lines last, so that no window or shuffle of links has them
    kind = F.coalesce("unit_type", F.lit("unknown"))
    u = links.join(t.select("task_id", "depth", "key"), "task_id").join(units.select(F.col("id").alias("unit_id"), F.col("ord").alias("unit_ord"), kind.alias("unit_type")), "unit_id")
    first = F.min("unit_ord").over(Window.partitionBy("task_id", "unit_type"))
    u = u.withColumn("rank", F.concat(F.lpad(fx.type_rank(F.col("unit_type")).cast("string"), 3, "0"), F.when(fx.type_rank(F.col("unit_type")) > len(fx.TYPE_LABELS), F.lpad(first.cast("string"), 12, "0")).otherwise("")))
    group = u.select("key", "depth", "unit_type", "rank").distinct().select(F.concat("key", F.lit("!1"), "rank", F.lit("a")).alias("sort"), F.concat(indent, F.lit("  - *"), fx.type_label(F.col("unit_type")), F.lit("*:")).alias("value"))
    shown = units.select(F.col("id").alias("unit_id"), F.concat(fx.strip(F.col("text")), F.lit(" (confidence: "), F.format_string("%.2f", F.coalesce("confidence", F.lit(0.0))), F.lit(")")).alias("shown"))
    line = u.select("unit_id", F.concat("key", F.lit("!1"), "rank", F.lit("b"), F.lpad(F.col("unit_ord").cast("string"), 12, "0")).alias("sort"), "depth").join(shown, "unit_id")
    line = line.select("sort", F.concat(indent, F.lit("    - "), "shown").alias("value"))
    return head.unionByName(group).unionByName(line)


def tree_json(tasks: DataFrame) -> DataFrame:
    """Each root task as JSON with its subtasks nested, in the order of ``ord``: ``task_id, ord, value``.

    Levels are joined from the deepest up, so that no tree passes through the driver. Tasks below a missing parent, or on a
    cycle, are left out.
    """
    top = tasks.where("parent_task_id is null").select(F.col("task_id").alias("root"))
    t = cut(tasks.select("task_id", "label", "iri", "parent_task_id", "ord").join(depths(tasks).select("task_id", "depth", "root"), "task_id").join(top, "root", "left_semi").where("depth is not null"))
    deepest = t.agg(F.max("depth")).first()[0]
    child = None
    for d in range(-1 if deepest is None else deepest, -1, -1):
        level = t.where(F.col("depth") == d)
        level = level.join(child, "task_id", "left") if child is not None else level.withColumn("children", F.lit(None).cast("string"))
        own = F.to_json(F.struct("task_id", "label", "iri"))
        value = F.concat(F.regexp_replace(own, r"\}$", ""), F.lit(',"children":['), F.coalesce("children", F.lit("")), F.lit("]}"))
        level = level.select("task_id", "parent_task_id", "ord", value.alias("value"))
        if d == 0:
            return level.select("task_id", "ord", "value")
        child = level.groupBy(F.col("parent_task_id").alias("task_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]), ",").alias("children"))
    return t.select("task_id", "ord", F.lit("").alias("value"))


def nested(rows: list[dict], orphans_as_roots: bool = True) -> list[dict]:
    """A list of tasks, in order, as a nested tree; on the driver, as no Spark type nests without end."""
    by_id = {r["task_id"]: {**r, "children": []} for r in rows}
    roots = []
    for r in by_id.values():
        up = by_id.get(r.get("parent_task_id"))
        if up is not None:
            up["children"].append(r)
        elif r.get("parent_task_id") is None or orphans_as_roots:
            roots.append(r)
    return roots
