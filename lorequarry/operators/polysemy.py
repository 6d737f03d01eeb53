"""Concepts that mean different things in different frameworks (jurisdictions, schools): found, and forked into senses.

A shard says an ``axiom`` of the concept ``iri`` within a ``framework``. Two shards conflict if they are about one concept,
say different axioms, and their frameworks aren't compatible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def _counts(shards: DataFrame) -> DataFrame:
    said = shards.where("iri is not null and framework is not null and axiom is not null")
    return said.groupBy("iri", "axiom", "framework").agg(F.count("*").alias("n"))


def _fitting(compatible: DataFrame) -> DataFrame:
    """``framework, fits``: the frameworks each is compatible with, one row each."""
    both = compatible.select("a", "b").unionByName(compatible.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where("a is not null and b is not null").groupBy(F.col("a").alias("framework")).agg(F.collect_set("b").alias("fits"))


def _by_concept(shards: DataFrame, compatible: DataFrame) -> DataFrame:
    """``iri, all``: a row a concept, with a struct ``framework, n, by, fits`` for each of its frameworks; ``by`` counts its shards
    by axiom.

    Counts are made before anything goes to one place, and then dealt by concept once. The frameworks that fit come after
    that, so that no shuffle carries them.
    """
    counts = _counts(shards).repartition("iri")
    of_iri = counts.groupBy("iri", "framework").agg(F.sum("n").alias("n"), F.collect_list(F.struct("axiom", "n")).alias("by"))
    one = F.struct("framework", "n", "by", F.coalesce("fits", F.array().cast("array<string>")).alias("fits"))
    return of_iri.join(_fitting(compatible), "framework", "left").groupBy("iri").agg(F.collect_list(one).alias("all"))


def _clash(x: Column, y: Column) -> Column:
    """Whether two frameworks of a concept conflict: unless they fit, or all shards of both say the same."""
    agree = (F.size(x["by"]) == 1) & (F.size(y["by"]) == 1) & (x["by"][0]["axiom"] == y["by"][0]["axiom"])
    return ~agree & ~F.array_contains(x["fits"], y["framework"])


def conflicts(shards: DataFrame, compatible: DataFrame) -> DataFrame:
    """``shards(iri, framework, axiom)``, ``compatible(a, b)`` -> ``iri, a, b, n``: for each two frameworks a < b that conflict
    about a concept, the number of pairs of shards that do (a decimal, as a concept may have a third of all shards).

    No pair of shards is made: the pairs are those of all shards of both frameworks less those that agree, products of
    counts. What a row holds is at most a count a framework and axiom. ``compatible`` goes both ways, and a framework fits
    itself. Rows with a null take no part.
    """
    times = lambda x, y: (x["n"].cast("decimal(18,0)") * y["n"].cast("decimal(18,0)")).cast("decimal(38,0)")
    none = F.lit(0).cast("decimal(38,0)")

    def agreeing(x, y):
        same = lambda p: F.aggregate(F.filter(y["by"], lambda q: q["axiom"] == p["axiom"]), none, lambda s, q: (s + times(p, q)).cast("decimal(38,0)"))
        return F.aggregate(x["by"], none, lambda s, p: (s + same(p)).cast("decimal(38,0)"))

    def against(x):
        others = F.filter("all", lambda y: (x["framework"] < y["framework"]) & _clash(x, y))
        return F.transform(others, lambda y: F.struct(x["framework"].alias("a"), y["framework"].alias("b"), (times(x, y) - agreeing(x, y)).cast("decimal(38,0)").alias("n")))

    return _by_concept(shards, compatible).select("iri", F.explode(F.flatten(F.transform("all", against))).alias("p")).select("iri", "p.*")


def _placed(rows: DataFrame) -> DataFrame:
    """``rows(iri, all)`` of structs ``n`` (negative), ``framework, foes`` in the order in which they are taken -> the senses."""

    def place(acc, x):
        at = F.array_position(F.transform(acc, lambda s: ~F.exists(s, lambda m: F.array_contains(x["foes"], m["framework"]))), True)
        m = F.struct(x["n"].alias("n"), x["framework"].alias("framework"))
        joined = F.transform(acc, lambda s, i: F.when(i + 1 == at, F.concat(s, F.array(m))).otherwise(s))
        return F.when(at == 0, F.concat(acc, F.array(F.array(m)))).otherwise(joined)

    none = F.array().cast("array<array<struct<n:bigint,framework:string>>>")
    each = rows.select("iri", F.posexplode(F.aggregate("all", none, place)).alias("i", "s"))
    names = F.transform("s", lambda m: m["framework"])
    return each.select("iri", (F.col("i") + 1).alias("sense"), F.concat_ws("_", "iri", names[0]).alias("child"), names.alias("frameworks"), F.aggregate("s", F.lit(0).cast("long"), lambda t, m: t - m["n"]).alias("n"), (F.col("i") == 0).alias("prime"))


def senses(shards: DataFrame, found: DataFrame) -> DataFrame:
    """Proposed forks of the concepts in ``found``, the result of ``conflicts``: ``iri, sense, child, frameworks, n, prime``.

    Frameworks are taken by their number of shards, then name; each joins the first sense that it has no conflict with, else
    begins the next. A sense is named after its first framework, and the first sense is the prime one. A group holds the
    frameworks of a concept and their conflicts.
    """
    clash = cut(found.groupBy("iri").agg(F.collect_list(F.struct("a", "b")).alias("clash")))  # read twice, found once
    by_size = _counts(shards).groupBy("iri", "framework").agg(F.sum("n").alias("n")).join(clash.select("iri"), "iri", "left_semi")
    rows = by_size.groupBy("iri").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "framework"))).alias("all")).join(clash, "iri")
    foes = lambda x: F.transform(F.filter("clash", lambda p: (p["a"] == x["framework"]) | (p["b"] == x["framework"])), lambda p: F.when(p["a"] == x["framework"], p["b"]).otherwise(p["a"]))
    return _placed(rows.select("iri", F.transform("all", lambda x: F.struct(x["n"].alias("n"), x["framework"].alias("framework"), foes(x).alias("foes"))).alias("all")))


def forks(shards: DataFrame, compatible: DataFrame) -> DataFrame:
    """As ``senses(shards, conflicts(shards, compatible))``, from the frameworks of each concept alone: which of them conflict is
    told by their axioms, so that no conflict becomes a row."""
    foes = lambda x: F.transform(F.filter("all", lambda y: (y["framework"] != x["framework"]) & _clash(x, y)), lambda y: y["framework"])
    each = F.transform("all", lambda x: F.struct((-x["n"]).alias("n"), x["framework"].alias("framework"), foes(x).alias("foes")))
    rows = _by_concept(shards, compatible).select("iri", F.array_sort(each).alias("all"))
    return _placed(rows.where(F.exists("all", lambda x: F.size(x["foes"]) > 0)))
