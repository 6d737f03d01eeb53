"""Hypotheses that expire unless they are promoted: from a stream by event-time timers, or from a table.

An event has ``id, at, seq, action, role, citation, ttl_days``; (at, seq) orders the events of an id. ``propose`` makes a
hypothesis, for ``ttl_days`` (90 if null); ``promote`` makes it attested, ``demote`` makes an attested one a hypothesis again
with days of its own. Both need a citation and a role of ``REVIEWERS``. A hypothesis not promoted before its deadline expires
at it, and may be proposed again later. An action that doesn't fit the status is ignored, so repeated events change nothing;
so is an event without id, at or seq.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ACTIONS = ("propose", "promote", "demote")
REVIEWERS = ("reviewer", "arbiter", "corpus_admin")
DAYS = 90
_DAY_US = 86_400_000_000
_NEVER = 2**63 - 1

#: status, its deadline in microseconds (0 if it has none)
State = tuple[str | None, int]


def _fold(state: State, events: Iterable[tuple[int, int, int, int]]) -> tuple[State, list[tuple[int, str, int]]]:
    """The state after ordered events ``(us, seq, action, ttl)``, and the changes on the way: ``(us, status, deadline)``."""
    status, deadline = state
    out = []
    for us, _, action, ttl in events:
        (status, deadline), gone = _expire((status, deadline), us)
        out += gone
        if (action == 0 and status in (None, "expired")) or (action == 2 and status == "attested"):
            status, deadline = "hypothesis", us + ttl
        elif action == 1 and status == "hypothesis":
            status, deadline = "attested", 0
        else:
            continue
        out.append((us, status, deadline))
    return (status, deadline), out


def _expire(state: State, us: int) -> tuple[State, list[tuple[int, str, int]]]:
    status, deadline = state
    return (("expired", 0), [(deadline, "expired", 0)]) if status == "hypothesis" and deadline <= us else (state, [])


def _valid(events: DataFrame) -> DataFrame:
    """``id, at, us, seq, action, ttl`` of the events that count."""
    place = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action")).cast("int") - 1
    e = events.select("id", F.col("at").cast("timestamp").alias("at"), F.col("seq").cast("long").alias("seq"), place.alias("place"), "role", "citation", F.coalesce(F.col("ttl_days").cast("long"), F.lit(DAYS)).alias("days"))
    grounded = F.col("role").isin(*REVIEWERS) & (F.trim("citation") != "")
    e = e.where(F.col("id").isNotNull() & F.col("at").isNotNull() & F.col("seq").isNotNull() & ((F.col("place") == 0) | ((F.col("place") > 0) & grounded)))
    return e.select("id", "at", F.unix_micros("at").alias("us"), "seq", F.col("place").alias("action"), (F.col("days") * _DAY_US).alias("ttl"))


def _named(changes: DataFrame) -> DataFrame:
    return changes.select("id", F.timestamp_micros("us").alias("at"), "status", F.when(F.col("deadline") > 0, F.timestamp_micros("deadline")).alias("deadline"))


def changes(events: DataFrame, until: Column | None = None) -> DataFrame:
    """Every change of status, ``id, at, status, deadline``, of a table of events; without ``until`` all that isn't promoted
    expires, else what comes later than that isn't known yet.

    Rows are dealt by id and ordered within tasks, which pass over them with one state: an id with very many events takes
    time, not memory.
    """
    e = _valid(events)
    if until is not None:
        e = e.where(F.col("at") <= until)
    kind = e.schema["id"].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, (None, 0)
        for batch in batches:
            ids, rows = batch.column("id"), list(zip(*(batch.column(c).to_pylist() for c in ("us", "seq", "action", "ttl")), strict=True))
            out, at = [], 0
            for i, key in enumerate(ids.to_pylist()):
                if held is None or key != held[0]:
                    if held is not None:
                        state, more = _fold(state, rows[at:i])
                        # what is open after the last event ends at its deadline
                        out += [(held[0], *x) for x in more + _expire(state, _NEVER)[1]]
                    held, state, at = (key,), (None, 0), i
            if held is not None:
                state, more = _fold(state, rows[at:])
                out += [(held[0], *x) for x in more]
            yield _batch(out, ids.type)
        if held is not None:
            yield _batch([(held[0], *x) for x in _expire(state, _NEVER)[1]], ids.type)

    dealt = e.select("id", "us", "seq", "action", "ttl").repartition("id").sortWithinPartitions("id", "us", "seq", "action")
    found = _named(dealt.mapInArrow(walk, f"id {kind}, us long, status string, deadline long"))
    return found if until is None else found.where(F.col("at") <= until)


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, pa.int64(), pa.string(), pa.int64()), strict=True)], names=["id", "us", "status", "deadline"])


def stream_changes(events: DataFrame, delay: str = "2 days") -> DataFrame:
    """As ``changes``, of a stream: a change comes out when the watermark has passed it, so that rows which come in any order
    within ``delay`` give the same changes. Later ones are dropped.

    The state of an id is its status and the events that the watermark hasn't passed. A timer wakes it at the next of
    these or at its deadline. Ids keep a status when they are attested or expired, as actions may follow.
    """
    e = _valid(events).withWatermark("at", delay)
    kind = e.schema["id"].dataType.simpleString()

    def walk(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, deadline, pending = state.get if state.exists else (None, 0, "[]")
        waiting = [tuple(x) for x in json.loads(pending)]
        for f in frames:
            waiting += zip(*(f[c].tolist() for c in ("us", "seq", "action", "ttl")), strict=True)
        mark = state.getCurrentWatermarkMs()
        passed = sorted(x for x in waiting if x[0] <= mark * 1000)
        waiting = sorted(x for x in waiting if x[0] > mark * 1000)
        now, out = _fold((status, deadline), passed)
        now, gone = _expire(now, mark * 1000)
        state.update((*now, json.dumps(waiting)))
        wake = [x[0] for x in waiting[:1]] + ([now[1]] if now[0] == "hypothesis" else [])
        if wake:
            state.setTimeoutTimestamp(max(-(-min(wake) // 1000), mark + 1))
        out += gone
        if out:
            yield pd.DataFrame([(key[0], *x) for x in out], columns=["id", "us", "status", "deadline"])

    found = e.groupBy("id").applyInPandasWithState(walk, f"id {kind}, us long, status string, deadline long", "status string, deadline long, pending string", "append", GroupStateTimeout.EventTimeTimeout)
    return _named(found)
