"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets an exponential key ``-ln(u) / w``, with ``u`` from a hash of its id and ``w`` its quality weight.
Within a source, documents in key order are a weighted sample without replacement. A source whose target is ``e`` whole
epochs and a rest takes every document ``e`` times first; the rest is a prefix of the key order.

The prefix sum does not sort a source in one task. Keys are put into ranges of about ``RANGE_ROWS`` documents, the sums
of the ranges are added up in two levels, and only the one range in which the budget ends is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace, large, small

#: Documents that one key range holds on average.
RANGE_ROWS = 2000
#: Ranges of a source that are added up in one task.
GROUP_RANGES = 10_000
#: Values of a source or a range as a row, with the name of the source.
SOURCE_BYTES = 256
#: Most times that a source, and so a document, is taken.
MAX_EPOCHS = 3
#: Weights of the sources by their place in code point order, repeating; null comes last.
WEIGHTS = (1, 2, 3)
#: Sampling weight by the label ``quality``.
QUALITY_WEIGHT = {0: 0.5, 1: 2.0}
UNLABELLED_WEIGHT = 1.0

#: Java's \\s is not this set in every mode, so it is spelled out.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def uniform(name: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of a SHA-256 of the name, a text, and the seed."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), name), 256)
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def water_fill(sources: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sources(source, source_size)`` -> with ``target``.

    All sizes are shared by weight; a source over ``max_epochs`` times its size stops there and the excess goes to the
    others by weight until none is above. That ends at one level ``t`` with ``target = min(cap, t * weight)``; sources
    sorted by ``cap / weight`` are capped up to a point, so the level follows from running sums.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.element_at(table, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs))).withColumn("ratio", F.col("cap") / F.col("weight"))
    all_rows = Window.partitionBy()
    upto = Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("total", F.sum("source_size").over(all_rows).cast("double"))
    # as if this source and all before it were capped
    s = s.withColumn("level", (F.col("total") - F.sum("cap").over(upto) + F.col("cap")) / (F.sum("weight").over(all_rows) - F.sum("weight").over(upto) + F.col("weight")))
    # the first source that stays below its cap at the level of those from it onwards sets the level
    s = s.withColumn("t", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(all_rows)["level"])
    return s.select("source", "source_size", F.when(F.col("t").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("t") * F.col("weight"))).alias("target"))


def sizes(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, source, ...)`` -> ``doc_id, source, size, name``: all that mixing needs of the texts. ``name``
    is the id, or what tells rows without an id apart."""
    text = F.col("text").cast("string")
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.sha2(F.coalesce(text, F.lit("")), 256)))
    return docs.select("doc_id", "source", word_count(text).alias("size"), name.alias("name"))


def even(key: Column, rates: list[tuple[float, Column]]) -> Column:
    """From 0 to 1: the share of documents whose key is below, if ``rates`` has the weights and the documents of each."""
    n = sum((c for _, c in rates[1:]), rates[0][1])
    return sum((c * (1 - F.exp(-key * w)) for w, c in rates[1:]), rates[0][1] * (1 - F.exp(-key * rates[0][0]))) / n


def mix(docs: DataFrame, labels: DataFrame | None = None, seed: int = 7, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``docs(doc_id, text, source)`` -> ``doc_id, size, source, source_size, target, taken, epochs``, a row per input row.

    ``labels(doc_id, quality)`` sets the sampling weights; without it all are equal. ``taken`` is the words that the mix
    takes of the document: whole epochs, and the document once more if the rest of the target reaches it. Where the
    budget ends inside a document, it is taken if that brings the source nearer to its target.

    A null or empty text has size 0 and is never taken. A null source is a source. Rows that agree in ``doc_id`` are
    told apart by size; rows without one are by their text. Equal rows get results of which it is not told which belongs
    to which. Other columns are not looked at. An empty input gives an empty result. Reruns agree, as keys depend on ids, labels and the seed alone.
    """
    ws = Workspace(docs.sparkSession, "mix")
    rows = ws.save(sizes(docs), "sizes")
    if labels is not None:
        rows = quality_weight(rows, labels)
    else:
        rows = rows.withColumn("quality_weight", F.lit(UNLABELLED_WEIGHT))
    rows = ws.save(rows.select("doc_id", "source", "size", "quality_weight", (-F.log(uniform(F.col("name"), seed)) / F.col("quality_weight")).alias("key")), "keys")
    kinds = sorted({UNLABELLED_WEIGHT, *QUALITY_WEIGHT.values()})
    of_kind = [F.count_if(F.col("quality_weight") == w).alias(f"n{i}") for i, w in enumerate(kinds)]
    stats = ws.save(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"), *of_kind), "stats")
    targets = water_fill(stats.select("source", "source_size"), weights, max_epochs)
    plan = stats.drop("source_size").withColumnRenamed("source", "s2").join(targets, F.col("s2").eqNullSafe(F.col("source"))).drop("s2")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_epochs))).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    plan = plan.withColumn("ranges", F.greatest(F.lit(1), F.ceil(F.col("n") / RANGE_ROWS)).cast("long")).drop("n")
    by_source = ws.save(plan.withColumnRenamed("source", "s2"), "plan")
    r = rows.join(small(by_source, SOURCE_BYTES), F.col("source").eqNullSafe(F.col("s2"))).drop("s2")
    at = even(F.col("key"), [(w, F.col(f"n{i}")) for i, w in enumerate(kinds)])  # spreads the keys evenly over the ranges
    r = r.withColumn("range", F.least(F.floor(at * F.col("ranges")), F.col("ranges") - 1).cast("long")).drop("quality_weight", *[f"n{i}" for i in range(len(kinds))])
    sums = r.groupBy("source", "range").agg(F.sum("size").alias("s"), F.first("rest").alias("rest"))
    sums = ws.save(sums.withColumn("group", F.floor(F.col("range") / GROUP_RANGES)), "sums")
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("source", "group").agg(F.sum("s").alias("s")).withColumn("below", F.coalesce(F.sum("s").over(before("source", "group")), F.lit(0)))
    groups = groups.select(F.col("source").alias("s4"), F.col("group").alias("g4"), "below")
    sums = sums.withColumn("inside", F.coalesce(F.sum("s").over(before("source", "group", "range")), F.lit(0)))
    sums = sums.join(groups, F.col("source").eqNullSafe(F.col("s4")) & (F.col("group") == F.col("g4"))).withColumn("before", F.col("below") + F.col("inside"))
    sums = ws.save(sums.select(F.col("source").alias("s3"), F.col("range").alias("r3"), "before", (F.col("before") + F.col("s") <= F.col("rest")).alias("whole"), (F.col("before") < F.col("rest")).alias("reached")), "reach")
    r = r.join(small(sums, SOURCE_BYTES), F.col("source").eqNullSafe(F.col("s3")) & (F.col("range") == F.col("r3"))).drop("s3", "r3")
    # only the range in which the budget ends needs its order; every other row is a partition value of its own
    ends = F.col("reached") & ~F.col("whole")
    edge, plain = r.where(ends), r.where(~ends)
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("at", F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # the document that crosses the budget counts if at least half of it is below
    edge = edge.withColumn("once", F.col("at") + F.col("size") / 2 <= F.col("rest")).drop("at")
    out = edge.unionByName(plain.withColumn("once", F.col("whole")))
    return out.select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("epochs") + F.when(F.col("once"), F.col("size")).otherwise(0)).alias("taken"), (F.col("epochs") + F.when(F.col("once") & (F.col("size") > 0), 1).otherwise(0)).alias("epochs"))


def quality_weight(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` with ``quality_weight`` from ``labels(doc_id, quality)``; a document labelled twice takes the larger label."""
    q = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.max("quality").alias("_q"))
    w = F.coalesce(*[F.when(F.col("_q") == k, F.lit(v)) for k, v in QUALITY_WEIGHT.items()], F.lit(UNLABELLED_WEIGHT))
    return docs.join(large(q), F.col("doc_id") == F.col("_id"), "left").withColumn("quality_weight", w).drop("_id", "_q")
