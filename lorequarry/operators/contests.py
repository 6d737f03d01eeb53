"""Contests of units: votes of reviewers, closed by arbiters, as an append-only log that is folded into a state.

An event has ``id, at, seq, actor, action, position``; (at, seq) orders the events of an id. ``contest`` takes a position,
``withdraw`` takes it back. ``resolve``, ``fork`` and ``accept_aporia`` close a contest if an arbiter does it, and are
ignored otherwise. Votes after a closing open the next contest, in which those before it don't count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOSING = ("resolve", "fork", "accept_aporia")
VOTES = ("contest", "withdraw")


def states(events: DataFrame, arbiters: Sequence[str], quorum: int = 3, at: Column | None = None) -> DataFrame:
    """``id, status, position, votes``, as of ``at`` if that is given.

    ``contested``: votes stand since the last closing, ``votes`` of them. Else the last closing says: ``distinguished`` after
    a fork; ``resolved`` if at least ``quorum`` reviewers' votes stood in that contest and the arbiter named a position, or one
    position had most votes; ``aporetic`` otherwise. ``uncontested``: no votes stand and nothing was closed.

    Only an id's last two closings matter, so there is no fold over an id's events in one task: a maximum finds the last one,
    another the one before, and votes count by aggregations, whatever the order in which events arrive. Events without id,
    actor, at or seq are ignored, repeated events count once, a vote without a position has the position ''. Of different
    events at the same (at, seq) the greater action and position is the later, and votes stand before closings.
    """
    e = events.select("id", "at", "seq", "actor", "action", "position").where("id is not null and at is not null and seq is not null and actor is not null")
    if at is not None:
        e = e.where(F.col("at") <= at)
    when = F.struct("at", "seq")
    closings = e.where(F.col("action").isin(*CLOSING) & F.col("actor").isin(list(arbiters))).select("id", when.alias("when"), F.struct("action", "position").alias("said"))
    last = closings.groupBy("id").agg(F.max("when").alias("last"), F.max_by("said", F.struct("when", "said")).alias("said"))
    before = closings.drop("said").join(last.select("id", "last"), "id").where(F.col("when") < F.col("last")).groupBy("id").agg(F.max("when").alias("before"))
    bounds = last.select("id", "last").join(before, "id", "left")

    votes = e.where(F.col("action").isin(*VOTES)).withColumn("when", when).join(bounds, "id", "left")
    votes = votes.withColumn("open", F.col("last").isNull() | (F.col("when") > F.col("last"))).where(F.col("open") | F.col("before").isNull() | (F.col("when") > F.col("before")))
    taken = F.when(F.col("action") == "contest", F.coalesce("position", F.lit("")))
    standing = votes.groupBy("id", "open", "actor").agg(F.max_by(F.struct(taken.alias("position")), F.struct("when", "action", "position")).alias("v")).where("v.position is not null")
    tally = standing.groupBy("id", "open", F.col("v.position").alias("position")).agg(F.count("*").alias("n"))
    judged = ~F.col("open")
    sums = tally.groupBy("id").agg(
        F.coalesce(F.sum(F.when(F.col("open"), F.col("n"))), F.lit(0)).alias("n_open"),
        F.coalesce(F.sum(F.when(judged, F.col("n"))), F.lit(0)).alias("n_judged"),
        # the positions with most votes, by both ends of the alphabet: they differ if there are several
        F.max_by("position", F.when(judged, F.struct("n", "position"))).alias("top"),
        F.min_by("position", F.when(judged, F.struct((-F.col("n")).alias("n"), F.col("position")))).alias("also"),
    )
    all_ = e.select("id").distinct().join(sums, "id", "left").join(last.select("id", "said"), "id", "left")
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    winner = F.coalesce("said.position", F.when(F.col("top") == F.col("also"), F.col("top")))
    status = (
        F.when(n("n_open") > 0, "contested")
        .when(F.col("said").isNull(), "uncontested")
        .when(F.col("said.action") == "fork", "distinguished")
        .when((F.col("said.action") == "resolve") & (n("n_judged") >= quorum) & winner.isNotNull(), "resolved")
        .otherwise("aporetic")
    )
    return all_.select("id", status.alias("status"), F.when(status == "resolved", winner).alias("position"), F.when(n("n_open") > 0, n("n_open")).otherwise(n("n_judged")).alias("votes"))
