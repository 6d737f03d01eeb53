"""Clusters of shards along four axes, what they lack, and where concepts meet in a hierarchy with several parents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

AXES = ("source", "subtree", "doctrine", "jurisdiction")


def closure(edges: DataFrame) -> DataFrame:
    """``edges(id, parent)`` -> ``id, ancestor``, each concept's ancestors at any distance, once.

    ``near`` holds the ancestors less than ``2 ** k`` steps away and ``far`` those exactly so many. A near path goes on behind a
    far one only, so in a tree no ancestor is found twice, and a hierarchy of depth d takes about log2(d) rounds, each
    written. Edges with a null or to themselves don't count.
    """
    far = cut(edges.where("id <> parent").select("id", F.col("parent").alias("ancestor")).distinct())
    near, n = far, far.count()
    # far paths are shuffled by their ends, which may be few; there are fewer of them than of near ones
    onward = lambda then: far.select("id", F.col("ancestor").alias("over")).join(then.select(F.col("id").alias("over"), "ancestor").hint("merge"), "over").select("id", "ancestor")
    while n:
        far = cut(onward(far).distinct())
        if not far.limit(1).count():
            break
        near = cut(near.unionByName(far).unionByName(onward(near)).distinct())
        n, before = near.count(), n
        if n == before:
            break
    return near


def lowest_shared(pairs: DataFrame, paths: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``pairs(a, b)`` of concepts, ``paths`` of ``closure`` -> ``a, b, ancestor``: the ancestors that both have (a concept counts
    as its own) and below which they share none. There may be several, or none.

    Ancestors aren't shuffled a row a pair each: a pair takes the array of b's and meets that of a's. What two concepts share
    holds all that is above it, so the lowest are those that no shared one has as a parent by ``edges(id, parent)``, those of
    the closure; without them paths serve, in longer arrays.
    """
    p = pairs.select("a", "b").where("a is not null and b is not null").distinct()
    edges = paths.toDF("id", "parent") if edges is None else edges.where("id <> parent").select("id", "parent").distinct()

    def up(c: str) -> DataFrame:
        own = p.select(F.col(c).alias("id")).distinct()
        return paths.join(own, "id", "left_semi").unionByName(own.withColumn("ancestor", F.col("id")))

    of_b = up("b").groupBy(F.col("id").alias("b")).agg(F.collect_list("ancestor").alias("ys"))
    steps = up("a").join(edges.select(F.col("id").alias("ancestor"), "parent"), "ancestor", "left")
    of_a = steps.groupBy(F.col("id").alias("a")).agg(F.collect_list(F.struct("ancestor", "parent")).alias("xs"))
    both = p.join(of_b.hint("merge"), "b").join(of_a.hint("merge"), "a").select("a", "b", F.filter("xs", lambda x: F.array_contains("ys", x["ancestor"])).alias("s"))
    lowest = F.array_except(F.transform("s", lambda x: x["ancestor"]), F.transform("s", lambda x: x["parent"]))
    return both.select("a", "b", F.explode(lowest).alias("ancestor"))


def coverage(shards: DataFrame, tasks: DataFrame, concepts: DataFrame) -> DataFrame:
    """``shards(source, task, concept, jurisdiction, authority)``, and the edges ``(id, parent)`` of the task tree and of the
    concepts -> ``axis, cluster, leaf, n, n_authorities, gap``.

    A shard is in the cluster of its source, its task and the tasks above, its concept and the concepts above, and its
    jurisdiction; a null is in none. Tasks and concepts without shards are clusters too. ``leaf``: nothing is below.
    ``gap``: a leaf without an authority, on the first and last axis any cluster without one.

    Shards are counted by their own value first, and only these counts go up the hierarchy.
    """
    counted = {c: shards.where(F.col(c).isNotNull()).groupBy(F.col(c).alias("cluster")).agg(F.count("*").alias("n"), F.count_if("authority").alias("n_authorities")) for c in ("source", "task", "concept", "jurisdiction")}
    flat = [counted[c].select(F.lit(c).alias("axis"), F.col("cluster").cast("string").alias("cluster"), F.lit(True).alias("leaf"), "n", "n_authorities") for c in ("source", "jurisdiction")]
    deep = [_upward(F.lit(axis), counted[c], edges) for axis, c, edges in (("subtree", "task", tasks), ("doctrine", "concept", concepts))]
    out = flat[0]
    for df in (*deep, flat[1]):
        out = out.unionByName(df)
    return out.withColumn("gap", F.col("leaf") & (F.col("n_authorities") == 0))


def _upward(axis, counts: DataFrame, edges: DataFrame) -> DataFrame:
    e = edges.select("id", "parent")
    above = counts.join(closure(e), F.col("cluster") == F.col("id")).select(F.col("ancestor").alias("cluster"), "n", "n_authorities")
    zero = F.lit(0).cast("long")
    nodes = e.select(F.col("id").alias("cluster"), F.lit(True).alias("leaf")).unionByName(e.where("id <> parent").select(F.col("parent").alias("cluster"), F.lit(False).alias("leaf")))
    nodes = nodes.where("cluster is not null").select("cluster", zero.alias("n"), zero.alias("n_authorities"), "leaf")
    rows = counts.withColumn("leaf", F.lit(True)).unionByName(above.withColumn("leaf", F.lit(False))).unionByName(nodes)
    sums = rows.groupBy("cluster").agg(F.min("leaf").alias("leaf"), F.sum("n").alias("n"), F.sum("n_authorities").alias("n_authorities"))
    return sums.select(axis.alias("axis"), F.col("cluster").cast("string").alias("cluster"), "leaf", "n", "n_authorities")
