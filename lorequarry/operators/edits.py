"""An append-only log of edits to fields, replayed backwards and forwards, and checks of the log.

An edit has ``id, field, old_value, new_value, at, seq``; (at, seq) orders the edits of a field. The current state is
``id, field, value``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lineage import numbered

KEY = ["id", "field"]


def _when() -> Column:
    return F.struct("at", "seq")


def state_before(current: DataFrame, edits: DataFrame, at: Column) -> DataFrame:
    """The state as of ``at``, by undoing what came later: the old value of a field's first edit after it, else the current
    value. Edits at that very time have been made. A field that the current state lacks, but that was edited, is there."""
    undone = edits.where(F.col("at") > at).groupBy(*KEY).agg(F.min_by(F.struct("old_value"), _when()).alias("first"))
    both = current.select(*KEY, F.col("value"), F.lit(True).alias("there")).join(undone, KEY, "full")
    return both.select(*KEY, F.when(F.col("first").isNotNull(), F.col("first.old_value")).otherwise(F.col("value")).alias("value"))


def replayed(first: DataFrame, edits: DataFrame, at: Column) -> DataFrame:
    """The state as of ``at`` from the beginning: the new value of a field's last edit up to then, else the first value."""
    done = edits.groupBy(*KEY).agg(F.max_by(F.struct("new_value"), F.when(F.col("at") <= at, _when())).alias("last"), F.count_if(F.col("at") <= at).alias("n"))
    both = first.select(*KEY, "value").join(done, KEY, "full")
    return both.select(*KEY, F.when(F.col("n") > 0, F.col("last.new_value")).otherwise(F.col("value")).alias("value"))


def broken_links(current: DataFrame, edits: DataFrame, immutable: Sequence[str] = ()) -> DataFrame:
    """``id, field, at, seq, problem``: edits whose old value isn't what the edit before left (``gap``), edits to fields that must
    not be edited (``immutable``), and last edits that the current state contradicts (``lost``).

    Edits are numbered over all fields, and each is joined with the one before it, so a field that has most of the edits
    is no group of its own.
    """
    e = numbered(edits.select(*KEY, "old_value", "new_value", "at", "seq"), *KEY, "at", "seq", name="n")
    before = e.select((F.col("n") + 1).alias("n"), F.col("id").alias("_id"), F.col("field").alias("_field"), F.col("new_value").alias("_left"))
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("field").eqNullSafe(F.col("_field"))
    gap = e.join(before, "n").where(same & ~F.col("old_value").eqNullSafe(F.col("_left"))).withColumn("problem", F.lit("gap"))
    fixed = e.where(F.col("field").isin(list(immutable))).withColumn("problem", F.lit("immutable"))
    last = e.groupBy(*KEY).agg(F.max_by(F.struct("new_value", "at", "seq"), "n").alias("l"))
    lost = last.join(current, KEY, "left").where(~F.col("l.new_value").eqNullSafe(F.col("value"))).select(*KEY, "l.at", "l.seq", F.lit("lost").alias("problem"))
    cols = [*KEY, "at", "seq", "problem"]
    return gap.select(*cols).unionByName(fixed.select(*cols)).unionByName(lost)


def not_appended(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edits of an earlier version of the log that a later one lacks or has changed: an append-only log has none."""
    cols = [*KEY, "old_value", "new_value", "at", "seq"]
    return before.select(*cols).exceptAll(after.select(*cols))
