"""Shapes: constraints on the entities of a graph, checked together.

Constraints are rows. However many there are, a check is one pass over the triples against all of them (they are broadcast),
one join for the classes of values, one aggregation by entity and constraint, and one join with the entities that a
constraint is about.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import astuple, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import RDF
from .lineage import cut

TYPE = f"{RDF}type"


@dataclass(frozen=True)
class Constraint:
    """What holds for the values of ``path`` of every entity of the class ``target``; for all entities that have the value
    ``when_value`` at ``when_path`` only, if that is given. ``inverse``: the values are the subjects that point to the entity."""

    shape: str
    target: str
    path: str
    inverse: bool = False
    least: int | None = None
    most: int | None = None
    datatype: str | None = None
    node_kind: str | None = None  # iri or literal
    value_class: str | None = None
    pattern: str | None = None
    one_of: tuple[str, ...] | None = None
    when_path: str | None = None
    when_value: str | None = None


_ROW = "shape string, target string, path string, inverse boolean, least long, most long, datatype string, node_kind string, value_class string, pattern string, one_of array<string>, when_path string, when_value string"
RULES = ("least", "most", "datatype", "node_kind", "value_class", "pattern", "one_of")


def violations(triples: DataFrame, constraints: Sequence[Constraint]) -> DataFrame:
    """``triples(s, p, o, kind, datatype)`` with kind iri or literal -> ``shape, path, rule, s, n``: for each entity that breaks a
    rule of a constraint, the number of its values (``least``, ``most``) or of those that break it.

    Repeated triples count once. An entity without a value breaks ``least`` alone. Without constraints nothing is broken.
    """
    spark = triples.sparkSession
    rows = [(i, *(list(v) if isinstance(v, tuple) else v for v in astuple(c))) for i, c in enumerate(constraints)]
    assert [f.name for f in fields(Constraint)] == [x.split()[0] for x in _ROW.split(", ")]
    table = F.broadcast(spark.createDataFrame(rows, f"no int, {_ROW}"))
    t = cut(triples.select("s", "p", "o", "kind", "datatype").distinct())  # read for each part below, made once
    classes = t.where(F.col("p") == TYPE).select(F.col("s").alias("_of"), F.col("o").alias("_class"))

    forward = t.join(table.where("not inverse"), F.col("p") == F.col("path")).select("s", F.col("o").alias("value"), "kind", t["datatype"].alias("_datatype"), *_needed(table))
    backward = t.where("kind = 'iri'").join(table.where("inverse"), F.col("p") == F.col("path")).select(F.col("o").alias("s"), F.col("s").alias("value"), F.lit("iri").alias("kind"), F.lit(None).cast("string").alias("_datatype"), *_needed(table))
    values = forward.unionByName(backward)
    # a value may be of several classes; those that a class is asked of are looked up
    asked = values.where("value_class is not null and kind = 'iri'").select("s", "no", "value", "value_class")
    fit = asked.join(classes, (F.col("value") == F.col("_of")) & (F.col("value_class") == F.col("_class")), "left_semi")
    broken = {
        "datatype": F.col("datatype").isNotNull() & ~F.col("_datatype").eqNullSafe(F.col("datatype")),
        "node_kind": F.col("node_kind").isNotNull() & (F.col("kind") != F.col("node_kind")),
        "pattern": F.col("pattern").isNotNull() & ~F.expr("value rlike pattern"),
        "one_of": F.col("one_of").isNotNull() & ~F.expr("array_contains(one_of, value)"),
    }
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")

    def counted(df: DataFrame, **n: Column) -> DataFrame:
        return df.select("s", "no", *[n.get(k, zero).cast("long").alias(f"n_{k}") for k in ("all", "fit", "when", "class", *broken)])

    facts = counted(values, all=one, **{"class": F.col("value_class").isNotNull()}, **broken).unionByName(counted(fit, fit=one))
    when = t.join(table.where("when_path is not null"), (F.col("p") == F.col("when_path")) & (F.col("o") == F.col("when_value")))
    facts = facts.unionByName(counted(when, when=one))
    facts = facts.groupBy("s", "no").agg(*[F.sum(c).alias(c) for c in facts.columns if c.startswith("n_")])

    about = t.where(F.col("p") == TYPE).select("s", F.col("o").alias("_target")).join(table, F.col("_target") == F.col("target")).drop("_target")
    n = lambda name: F.coalesce(f"n_{name}", zero)
    found = about.join(facts, ["s", "no"], "left").where(F.col("when_path").isNull() | (n("when") > 0))
    of_rule = {
        "least": F.when(n("all") < F.col("least"), n("all")), "most": F.when(n("all") > F.col("most"), n("all")),
        "value_class": F.when(n("class") > n("fit"), n("class") - n("fit")), **{k: F.when(n(k) > 0, n(k)) for k in broken},
    }
    each = F.filter(F.array(*[F.struct(F.lit(k).alias("rule"), of_rule[k].alias("n")) for k in RULES]), lambda r: r["n"].isNotNull())
    return found.select("shape", "path", F.explode(each).alias("r"), "s").select("shape", "path", "r.rule", "s", "r.n")


def _needed(table: DataFrame) -> list[Column]:
    return [F.col(c) if c != "datatype" else table["datatype"].alias("datatype") for c in ("no", "datatype", "node_kind", "value_class", "pattern", "one_of")]
