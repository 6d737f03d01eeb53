"""The review store: append-only logs with latest-wins views, and the statistics over units, tasks and decisions."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from .lineage import cut, one_row

UNIT_STATUS = ("unreviewed", "approved", "rejected", "edited")
TASK_STATUS = ("unreviewed", "approved", "rejected", "edited")
RESOLUTIONS = ("keep_both", "prefer_a", "prefer_b", "merge", "jurisdiction")
AUTHORITY = (1, 10)


TASK_STATUSES = ("approved", "rejected", "edited")


def latest(log: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """The last row of each key. The state is an aggregate of the log, so a hot key is combined before the shuffle."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(time, tie)).alias("_l"))
    return last.select(*keys, *[F.col(f"_l.{c}").alias(c) for c in rest])


def latest_known(log: DataFrame, key: str, fields: list[str], time: str, tie: str) -> DataFrame:
    """Field by field the last value that isn't missing: a bulk decision doesn't clear an earlier edit."""
    return log.groupBy(key).agg(*[F.max_by(F.col(f), F.when(F.col(f).isNotNull(), F.struct(time, tie))).alias(f) for f in fields])


def valid(column: Column, allowed) -> Column:
    return F.coalesce(column.isin(*allowed), F.lit(False))


def append(log: DataFrame, rows: DataFrame) -> DataFrame:
    return log.unionByName(rows, allowMissingColumns=True)


def with_review(units: DataFrame, decisions: DataFrame) -> DataFrame:
    """Units with ``review_status``, by default unreviewed. ``decisions(id, status, edited_text)``, one row a unit."""
    d = decisions.select(F.col("id").alias("_id"), F.col("status").alias("_s"), "edited_text") if "edited_text" in decisions.columns else decisions.select(F.col("id").alias("_id"), F.col("status").alias("_s"), F.lit(None).cast("string").alias("edited_text"))
    j = units.join(d, F.col("id") == F.col("_id"), "left")
    return j.withColumn("review_status", F.coalesce("_s", F.lit("unreviewed"))).withColumn("edited_text", F.coalesce("edited_text", F.lit(""))).drop("_id", "_s")


def list_units(units: DataFrame, concept: str = "__all__", confidence: str | None = None, high: float = fx.HIGH, medium: float = fx.MEDIUM, status: str | None = None, types: tuple[str, ...] = ()) -> DataFrame:
    """Units by concept, ``__all__`` and ``__untagged__`` included, by confidence band, and by review status and types if
    they are given."""
    if status:
        units = units.where(F.col("review_status") == status)
    if types:
        units = units.where(F.col("unit_type").isin(*types))
    if concept == "__untagged__":
        units = units.where(F.size("tags") == 0)
    elif concept != "__all__":
        units = units.where(F.exists("tags", lambda t: t["iri"] == concept))
    return units.where(fx.band(F.col("confidence"), high, medium) == confidence) if confidence else units


def bulk_approve(units: DataFrame, at: Column, ids: list[str] | None = None, least: float | None = None) -> DataFrame:
    """New log rows for the units named, or those at least as confident; unknown ids count too, as they are given."""
    if ids is None and least is None:
        raise ValueError("either ids or a least confidence")
    if ids is not None:
        spark = units.sparkSession
        rows = spark.createDataFrame([(x,) for x in ids], "id string")
    else:
        rows = units.where(F.col("confidence") >= least).select("id")
    return rows.select("id", F.lit("approved").alias("status"), F.lit(None).cast("string").alias("edited_text"), at.alias("reviewed_at"))


def review_tasks(tasks: DataFrame, reviews: DataFrame) -> DataFrame:
    """Log rows of ``reviews(task_id, status, edited_label, note, reviewed_at, seq)``: those of tasks that are there, with a status
    that a reviewer may give. A missing note is empty."""
    known = reviews.where(valid(F.col("status"), TASK_STATUSES)).join(tasks.select("task_id").distinct(), "task_id", "left_semi")
    return known.select("task_id", "status", "edited_label", F.coalesce("note", F.lit("")).alias("note"), "reviewed_at", "seq", F.lit("review").alias("action"))


def bulk_approve_tasks(tasks: DataFrame, at: Column, seq: Column, ids: DataFrame | None = None, least: float | None = None) -> DataFrame:
    """Log rows that approve the tasks of ``ids(task_id)``, or those at least as confident. They say nothing of labels and notes,
    and ids of no task leave none."""
    if ids is None and least is None:
        raise ValueError("either ids or a least confidence")
    some = tasks.join(ids.select("task_id").distinct(), "task_id", "left_semi") if ids is not None else tasks.where(F.col("confidence") >= least)
    none = F.lit(None).cast("string")
    return some.select("task_id", F.lit("approved").alias("status"), none.alias("edited_label"), none.alias("note"), at.alias("reviewed_at"), seq.cast("long").alias("seq"), F.lit("bulk").alias("action"))


def reviewed_tasks(tasks: DataFrame, log: DataFrame) -> DataFrame:
    """``tasks`` with ``status, edited_label, note, reviewed_at`` as the log leaves them: the last row's status, and the label and
    note of the last single review, which a bulk approval keeps and a later review without a label clears."""
    when = F.struct("reviewed_at", "seq")
    state = log.groupBy("task_id").agg(F.max_by("status", when).alias("status"), F.max_by(F.struct("edited_label", "note"), F.when(F.col("action") == "review", when)).alias("_said"), F.max("reviewed_at").alias("reviewed_at"))
    rows = tasks.drop("status", "edited_label", "note", "reviewed_at").join(state, "task_id", "left")
    return rows.withColumn("status", F.coalesce("status", F.lit("unreviewed"))).withColumn("edited_label", F.col("_said.edited_label")).withColumn("note", F.coalesce("_said.note", F.lit(""))).drop("_said")


def review_stats(units: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: total, a count for each status, and for each confidence band. Unreviewed is what total leaves over."""
    u = units.agg(F.count("*").alias("total"), *[F.count_if(fx.band(F.col("confidence")) == b).alias(f"{b}_confidence") for b in ("high", "medium", "low")])
    d = decisions.agg(*[F.count_if(F.col("status") == s).alias(s) for s in UNIT_STATUS[1:]], F.count_if(F.col("status") != "unreviewed").alias("reviewed"))
    return one_row(u, d).withColumn("unreviewed", F.col("total") - F.col("reviewed")).drop("reviewed")


def confidence_bands(units: DataFrame, high: float = fx.HIGH, medium: float = fx.MEDIUM) -> DataFrame:
    """``band, n``, zeros included."""
    bands = units.sparkSession.createDataFrame([("high",), ("medium",), ("low",)], "band string")
    n = units.groupBy(fx.band(F.col("confidence"), high, medium).alias("band")).agg(F.count("*").alias("n"))
    return bands.join(n, "band", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def concept_counts(tags: DataFrame) -> DataFrame:
    """``tags(ord, pos, iri, label, branch)`` -> a row a concept, counted by tags; label and branch as first seen."""
    first = F.struct("ord", "pos")
    return tags.groupBy("iri").agg(F.min_by("label", first).alias("label"), F.min_by("branch", first).alias("branch"), F.count("*").alias("n"))


def concept_tree(tags: DataFrame, units: DataFrame) -> DataFrame:
    """``kind, id, label, branch, n``: branches with the sums of their concepts, the concepts, and the rows for all units
    and, if some are tagged and some not, for those without a tag."""
    c = concept_counts(tags).withColumn("branch", F.coalesce(F.nullif("branch", F.lit("")), F.lit("Uncategorized")))
    g = c.groupingSets([[F.col("branch"), F.col("iri"), F.col("label")], [F.col("branch")]], "branch", "iri", "label").agg(F.sum("n").alias("n"), F.grouping_id().alias("g"))
    rows = g.select(F.when(F.col("g") == 0, "concept").otherwise("branch").alias("kind"), F.when(F.col("g") == 0, F.col("iri")).otherwise(F.col("branch")).alias("id"), F.when(F.col("g") == 0, F.col("label")).otherwise(F.col("branch")).alias("label"), "branch", "n")
    tagged = tags.select("ord").distinct().agg(F.count("*").alias("t"))
    totals = one_row(units.agg(F.count("*").alias("total")), tagged)
    everything = totals.select(F.lit("virtual").alias("kind"), F.lit("__all__").alias("id"), F.lit("All Units").alias("label"), F.lit("").alias("branch"), F.col("total").alias("n"))
    bare = totals.where("t > 0 and t < total").select(F.lit("virtual").alias("kind"), F.lit("__untagged__").alias("id"), F.lit("Untagged").alias("label"), F.lit("").alias("branch"), (F.col("total") - F.col("t")).alias("n"))
    return rows.unionByName(everything).unionByName(bare)


def task_list(tasks: DataFrame, links: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Tasks with their units and open contradictions counted, each before the join."""
    u = links.groupBy("task_id").agg(F.count("*").alias("unit_count"))
    c = contradictions.where("resolution is null").groupBy("task_id").agg(F.count("*").alias("contradiction_count"))
    zero = F.lit(0).cast("long")
    return tasks.join(u, "task_id", "left").join(c, "task_id", "left").withColumn("unit_count", F.coalesce("unit_count", zero)).withColumn("contradiction_count", F.coalesce("contradiction_count", zero))


def discovery_stats(tasks: DataFrame, links: DataFrame, units: DataFrame, contradictions: DataFrame) -> DataFrame:
    t = tasks.agg(F.count("*").alias("total_tasks"), F.count_if(F.col("parent_task_id").isNotNull()).alias("subtasks"), F.count_if(F.col("status") != "unreviewed").alias("reviewed"))
    a = links.agg(F.count_distinct("unit_id").alias("assigned_units"))
    c = contradictions.agg(F.count("*").alias("contradictions"), F.count_if(F.col("resolution").isNotNull()).alias("resolved"))
    o = units.join(links.select(F.col("unit_id").alias("_u")).distinct(), F.col("id") == F.col("_u"), "left_anti").agg(F.count("*").alias("orphan_units"))
    share = F.when(F.col("total_tasks") > 0, F.round(F.col("reviewed") / F.col("total_tasks") * 100, 1)).otherwise(0.0)
    return one_row(t, a, c, o).withColumn("review_progress", share)


def assigned_counts(units: DataFrame, links: DataFrame, by: str) -> DataFrame:
    return units.join(links.select(F.col("unit_id").alias("_u")).distinct(), F.col("id") == F.col("_u"), "left_semi").groupBy(by).agg(F.count("*").alias("n"))


def contradiction_list(contradictions: DataFrame, status: str | None = None) -> DataFrame:
    if status == "unresolved":
        return contradictions.where("resolution is null")
    return contradictions.where("resolution is not null") if status == "resolved" else contradictions


def upsert(old: DataFrame, new: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Rows of ``new`` are added; where the key is there, only the columns of ``update`` change."""
    n = new.select(*[F.col(c).alias(f"_n_{c}") for c in new.columns]).withColumn("_new", F.lit(True))
    o = old.withColumn("_old", F.lit(True))
    on = [F.col(k) == F.col(f"_n_{k}") for k in keys]
    cond = on[0]
    for x in on[1:]:
        cond = cond & x
    j = o.join(n, cond, "full")
    out = []
    for c in old.columns:
        if c not in new.columns:
            out.append(F.col(c))
        elif c in update:
            out.append(F.when(F.col("_new"), F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.when(F.col("_old"), F.col(c)).otherwise(F.col(f"_n_{c}")).alias(c))
    return j.select(*out)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti").select(*old.columns))


def delete_task(tasks: DataFrame, links: DataFrame, task_id: str) -> tuple[DataFrame, DataFrame]:
    """Without the task and its links; its children keep their parent's id."""
    return tasks.where(F.col("task_id") != task_id), links.where(F.col("task_id") != task_id)


def delete_tasks(tasks: DataFrame, links: DataFrame, log: DataFrame, ids: DataFrame, at: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Without the tasks of ``ids(task_id)`` and their links, whose units have no task then; children keep their parent's id.
    The log gets a row for each task that was there."""
    ids = ids.select("task_id").distinct()
    gone = tasks.join(ids, "task_id", "left_semi")
    label = F.concat(F.lit("Deleted task: "), F.coalesce("label", F.lit("")))
    return tasks.join(ids, "task_id", "left_anti"), links.join(gone.select("task_id"), "task_id", "left_anti"), append(log, audit(gone, "delete", at, label))


def move_task(tasks: DataFrame, task_id: str, parent: str | None) -> DataFrame:
    return tasks.withColumn("parent_task_id", F.when(F.col("task_id") == task_id, F.lit(parent)).otherwise(F.col("parent_task_id")))


def merge_task(tasks: DataFrame, links: DataFrame, source: str, target: str) -> tuple[DataFrame, DataFrame]:
    moved = links.withColumn("task_id", F.when(F.col("task_id") == source, target).otherwise(F.col("task_id"))).dropDuplicates(["task_id", "unit_id"])
    return tasks.where(F.col("task_id") != source), moved


def resolve_contradiction(contradictions: DataFrame, resolutions: DataFrame) -> DataFrame:
    """``resolutions(contradiction_id, resolution, at, event_id)``: the last valid one of each counts."""
    last = latest(resolutions.where(valid(F.col("resolution"), RESOLUTIONS)), ["contradiction_id"], "at", "event_id").select("contradiction_id", F.col("resolution").alias("_r"))
    return contradictions.join(last, "contradiction_id", "left").withColumn("resolution", F.coalesce("_r", "resolution")).drop("_r")


def iri_registry(registry: DataFrame, entities: DataFrame, namespace: str) -> DataFrame:
    """``registry(entity_id, iri, deprecated_at)`` with IRIs for the ``entities(entity_id)`` that have none yet."""
    fresh = entities.select("entity_id").distinct().join(registry.select("entity_id"), "entity_id", "left_anti")
    return registry.unionByName(fresh.select("entity_id", fx.mint_iri(F.col("entity_id"), namespace).alias("iri"), F.lit(None).cast("timestamp").alias("deprecated_at")))


def deprecate(registry: DataFrame, entity_id: str, at: Column, successor: str | None = None) -> DataFrame:
    """With the time, and the successor's IRI if one is given; an entity that was deprecated before keeps its time."""
    mine = F.col("entity_id") == entity_id
    out = registry.withColumn("deprecated_at", F.when(mine, F.coalesce("deprecated_at", at)).otherwise(F.col("deprecated_at")))
    return out if successor is None else out.withColumn("successor", F.when(mine, F.lit(successor)).otherwise(F.col("successor") if "successor" in registry.columns else F.lit(None).cast("string")))


def iri_collisions(registry: DataFrame) -> DataFrame:
    return registry.groupBy("iri").agg(F.count("*").alias("n")).where("n > 1")


def authorities(log: DataFrame) -> DataFrame:
    """``log(corpus_name, source_file, authority_level, at, event_id)`` -> the levels in force, highest first."""
    ok = log.where(F.col("authority_level").between(*AUTHORITY))
    return latest(ok, ["corpus_name", "source_file"], "at", "event_id").orderBy(F.desc("authority_level"), "source_file")


def lookup(rows: DataFrame, key: str, value: object) -> dict:
    """The row whose key has the value; a missing one is a KeyError."""
    found = rows.where(F.col(key) == F.lit(value)).head(1)
    if not found:
        raise KeyError(value)
    return found[0].asDict(recursive=True)


def in_canonical_order(tasks: DataFrame) -> DataFrame:
    """With the ``place`` of each task below its parent: by ``canonical_order``, those without one first, then by label."""
    w = Window.partitionBy("parent_task_id").orderBy(F.col("canonical_order").asc_nulls_first(), "label", "task_id")
    return tasks.withColumn("place", F.row_number().over(w))


def in_label_order(rows: DataFrame, group: str) -> DataFrame:
    """With the ``place`` of each row in its group by label, in code point order."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("label", "id")))


def task_units(links: DataFrame, units: DataFrame) -> DataFrame:
    """Units of tasks with what the link says: whether it is the canonical one of its unit, and how sure it is.

    A unit's canonical link is its surest, of equals that of the smallest task id; a missing confidence is 0.
    """
    sure = F.coalesce("assignment_confidence", F.lit(0.0))
    first = links.groupBy("unit_id").agg(F.min_by("task_id", F.struct(-sure, "task_id")).alias("_first"))
    linked = links.join(first, "unit_id").withColumn("is_canonical", F.col("task_id") == F.col("_first")).withColumn("assignment_confidence", sure).drop("_first")
    return linked.join(units.withColumnRenamed("id", "unit_id"), "unit_id")


def task_detail(tasks: DataFrame, links: DataFrame, units: DataFrame, contradictions: DataFrame) -> DataFrame:
    """``task_id, unit_type, n, has_unresolved``: the units of each task by type; types are null for a task without units."""
    n = links.join(units.select(F.col("id").alias("unit_id"), "unit_type"), "unit_id").groupBy("task_id", "unit_type").agg(F.count("*").alias("n"))
    open_ = contradictions.where("resolution is null").select("task_id").distinct().withColumn("_open", F.lit(True))
    t = tasks.select("task_id").join(n, "task_id", "left").join(open_, "task_id", "left")
    return t.select("task_id", "unit_type", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("_open", F.lit(False)).alias("has_unresolved"))


def filter_tasks(tasks: DataFrame, status: str | None = None, band: str | None = None, flags: tuple[str, ...] = (), high: float = fx.HIGH, medium: float = fx.MEDIUM) -> DataFrame:
    """Tasks by status, confidence band, and flags that must be set, such as ``has_contradictions``, ``has_orphans`` and
    ``jurisdiction_sensitive``."""
    if status:
        tasks = tasks.where(F.col("status") == status)
    if band:
        tasks = tasks.where(fx.band(F.col("confidence"), high, medium) == band)
    for f in flags:
        tasks = tasks.where(F.coalesce(F.col(f), F.lit(False)))
    return tasks


def dashboard(stats: DataFrame, bands: DataFrame) -> DataFrame:
    """``stats`` of ``discovery_stats`` with ``top_level``, ``pending`` and the band that most units are in; the highest of
    equals."""
    rank = F.array_position(F.array(F.lit("low"), F.lit("medium"), F.lit("high")), F.col("band"))
    most = bands.agg(F.max_by("band", F.struct("n", rank)).alias("majority_band"))
    return one_row(stats.withColumn("top_level", F.col("total_tasks") - F.col("subtasks")).withColumn("pending", F.col("contradictions") - F.col("resolved")), most)


def type_histogram(units: DataFrame, types: tuple[str, ...] = fx.UNIT_TYPES) -> DataFrame:
    """``unit_type, n`` of all types, zeros included."""
    known = units.sparkSession.createDataFrame([(t,) for t in types], "unit_type string")
    n = units.groupBy("unit_type").agg(F.count("*").alias("n"))
    return known.join(n, "unit_type", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def tagged_count(units: DataFrame) -> DataFrame:
    return units.agg(F.count("*").alias("total"), F.count_if(F.size("tags") > 0).alias("tagged"))


def export_totals(tasks: DataFrame, links: DataFrame, units: DataFrame) -> DataFrame:
    """Units as an export counts them: ``linked_units`` once for each task that they are in, and ``total_units``."""
    return one_row(tasks.agg(F.count("*").alias("total_tasks")), links.join(tasks.select("task_id"), "task_id", "left_semi").agg(F.count("*").alias("linked_units")), units.agg(F.count("*").alias("total_units")))


def create_task(tasks: DataFrame, log: DataFrame, task: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """``task``, a row made by hand, is added unless its id is taken; the log gets a row for each that was added."""
    fresh = task.join(tasks.select("task_id"), "task_id", "left_anti")
    return append(tasks, fresh), append(log, audit(fresh, "create", at))


def audit(tasks: DataFrame, action: str, at: Column, detail: Column | None = None) -> DataFrame:
    """A log row for each task: moves, merges, splits and deletions are told apart by ``action``."""
    return tasks.select("task_id", F.lit(action).alias("action"), (F.lit(None) if detail is None else detail).cast("string").alias("detail"), at.alias("at"))


def reset(log: DataFrame, units: DataFrame) -> DataFrame:
    """The log without the decisions on ``units(id)``, those of a corpus."""
    return log.join(units.select("id"), "id", "left_anti")


def locked_tasks(tasks: DataFrame) -> DataFrame:
    """Tasks that the next discovery must keep, with their edited labels."""
    return tasks.where(F.col("status").isin("approved", "edited")).withColumn("label", fx.edited_label(F.col("edited_label"), F.col("label")))


def valid_at(rows: DataFrame, at: Column) -> DataFrame:
    """``rows(valid_from, valid_to)`` in force at a time: the end is exclusive, and a missing one is open."""
    return rows.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (at < F.col("valid_to"))))


def supersession(versions: DataFrame, key: str, time: str) -> DataFrame:
    """Versions with the end of their validity: the start of the next."""
    return versions.withColumn("valid_to", F.lead(time).over(Window.partitionBy(key).orderBy(time)))


def dependents(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``edges(id, depends_on)``, ``roots(id)`` -> all that depends on a root, directly or not, with the least ``hops``."""
    seen = roots.select("id", F.lit(0).alias("hops"))
    front = seen
    for hop in itertools.count(1):
        near = edges.join(front.select(F.col("id").alias("depends_on")), "depends_on").select("id").distinct()
        front = near.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(hop))
        front = cut(front)
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen.where("hops > 0")
