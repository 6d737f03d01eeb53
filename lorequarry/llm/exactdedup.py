"""Exact deduplication by distributed radix partitioning from the first byte on.

All documents begin in one group. A round splits every group by the next bytes of its texts, a digit, and by whether the
text ends with them; digits grow sixteenfold from round to round, so that long copies take few rounds. A document is done when
its group holds nothing else or its text has ended: two texts that end in one group have had equal bytes all the way, so
equality needs no digest. Only documents that still share a group are carried to the next round, without the bytes that
were looked at.

A round is an aggregation by (group, digit), which folds copies before they are shuffled, and a join that tells every
document its new group. Small tables of digits are broadcast. Larger ones are joined by shuffle, and digits with very many
documents are salted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import workspace
from .workspace import Workspace, nonempty, small, unused

#: Bytes of the first digit, and by how much the next ones are longer.
FIRST, GROWTH = 64, 16
#: A digit is hot if it has more than this share of a round's documents (fewer than so many digits can be).
HOT_SHARE = 4096
#: Fewest documents of a hot digit.
HOT_ROWS = 1 << 17

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z alone in lower case; ``lower`` is the same, and faster, on text that is all ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def _split(ws: Workspace, digits: DataFrame) -> DataFrame:
    """``digits(grp, digit, ended, doc_id)``, a row per document -> a written row per digit that several documents share."""
    shared = digits.groupBy("grp", "digit", "ended").agg(F.count("*").alias("size"), F.max("doc_id").alias("largest")).where("size > 1")
    return ws.save(shared.withColumn("id", F.monotonically_increasing_id()), "digits")


def _told(docs: DataFrame, shared: DataFrame) -> DataFrame:
    """``docs(grp, digit, ended, ...)`` with ``id, size, largest`` of their digit, null where it is theirs alone."""
    on = ["grp", "digit", "ended"]
    n, most, room = shared.agg(F.sum("size"), F.max("size"), F.sum(F.octet_length("digit") + 64)).first()
    if (room or 0) <= workspace.BROADCAST_BYTES:
        return docs.join(F.broadcast(shared), on, "left")
    limit = max(HOT_ROWS, n // HOT_SHARE)
    if most <= limit:
        return docs.join(shared, on, "left")
    # a hash tells which documents may be of a hot digit and are salted; which digit they are of is told by its bytes
    code = F.xxhash64(*on)
    hot = shared.where(F.col("size") > limit).groupBy(code.alias("code")).agg(F.ceil(F.max("size") / limit).cast("long").alias("salts"))
    mark = lambda df: df.withColumn("code", code).join(F.broadcast(hot), "code", "left").drop("code").withColumn("salts", F.coalesce("salts", F.lit(1)))
    # numbers of rows of a scan are the same when a lost task is run again
    docs = mark(docs.withColumn("number", F.monotonically_increasing_id())).withColumn("salt", F.pmod("number", "salts")).drop("number", "salts")
    every = mark(shared).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return docs.join(every, [*on, "salt"], "left").drop("salt")


def exact_groups(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, keep_id, group_size, kept, text_sha256``, a row per input row.

    Texts are equal if they are the same bytes after A-Z became a-z; a null text is an empty one, and all empty texts are
    equal. Of a group the row with the largest doc_id stays, and ``keep_id`` is its id. A row without a doc_id stays only if
    no row of its group has one. Of rows that repeat both the id and the text that stay, one is kept, and no one can tell
    which. Other columns are not looked at. An empty table gives an empty result. Texts may be as long as a row may be:
    only a digit at a time is in a key, and no group is gathered in a task.
    """
    ws = Workspace(docs.sparkSession, "exactdedup")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    first = docs.select(F.lit(0).cast("long").alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    head = lower_ascii(F.substring("text", 1, FIRST)).cast("binary")  # as many characters have at least as many bytes
    first = first.select("grp", F.substring(head, 1, FIRST).alias("digit"), (F.octet_length("text") <= FIRST).alias("ended"), "doc_id", "text")
    told = _told(first, _split(ws, first)).withColumn("normal", lower_ascii(F.col("text")).cast("binary"))
    told = told.withColumn("text_sha256", F.sha2("normal", 256)).withColumn("rest", F.substr("normal", F.lit(FIRST + 1)))
    done, width = [], FIRST
    while True:
        # a document alone, or at its end, is done
        going = F.col("id").isNotNull() & ~F.col("ended")
        own = F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("largest"))
        state = told.select("doc_id", "text_sha256", "id", going.alias("going"), F.when(going, F.col("rest")).alias("rest"), F.coalesce("size", F.lit(1).cast("long")).alias("size"), own.alias("largest"))
        state = ws.save(state, "state")
        done.append(state.where("not going").select(F.lit(len(done)).alias("round"), "id", "doc_id", "text_sha256", "size", "largest"))
        left = state.where("going").select(F.col("id").alias("grp"), "doc_id", "text_sha256", "rest")
        if not nonempty(left):
            break
        width *= GROWTH
        cut = left.select("grp", F.substring("rest", 1, width).alias("digit"), (F.octet_length("rest") <= width).alias("ended"), "doc_id", "text_sha256", F.substr("rest", F.lit(width + 1)).alias("rest"))
        told = _told(cut, _split(ws, cut))
    out = reduce(DataFrame.unionByName, done)
    last = F.col("doc_id").eqNullSafe(F.col("largest"))
    alone = out.where("id is null").withColumn("kept", F.lit(True))
    others = out.where(F.col("id").isNotNull() & ~last).withColumn("kept", F.lit(False))
    # rows that repeat the id and text that stay are counted, one stays, and they are rows again
    stays = out.where(F.col("id").isNotNull() & last).groupBy("round", "id", "doc_id", "text_sha256", "size", "largest").agg(F.count("*").alias("times"))
    stays = stays.withColumn("kept", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), F.col("times")), lambda i: i == 1))).drop("times")
    result = alone.unionByName(others).unionByName(stays)
    return result.select("doc_id", F.col("largest").alias("keep_id"), F.col("size").alias("group_size"), "kept", "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that ``exact_groups`` keeps. Of rows that repeat the id and the text one stays."""
    ws = Workspace(docs.sparkSession, "exactdedup-keep")
    found = ws.save(exact_groups(docs), "found")
    # an id and a digest name a text, so that no text is joined with; that texts are equal was found from their bytes
    name, sha, other = unused("_id", docs), unused("_sha", docs), unused("_other", docs)
    named = docs.withColumn(sha, F.sha2(lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("binary"), 256))
    pairs = found.groupBy(F.col("doc_id").alias(name), F.col("text_sha256").alias(other)).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("times"))
    pairs = ws.save(pairs.where("not kept or times > 1"), "pairs")
    gone = small(pairs.where("not kept").select(name, other), 96)
    left = named.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(name)) & (F.col(sha) == F.col(other)), "left_anti")
    if nonempty(pairs.where("kept")):
        left = left.dropDuplicates(["doc_id", sha])
    return left.drop(sha)
