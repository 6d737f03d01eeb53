from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lorequarry.streaming import hypotheses as hyp

SCHEMA = "id string, at timestamp, seq long, action string, role string, citation string, ttl_days int"
START = datetime(2024, 1, 1)


def day(n):
    return START + timedelta(days=n)



def key(x):
    return (x[0], x[1], x[2], x[3] or START)


def plain(events):
    """The same by steps of an hour's clock over all ids."""
    out, state = [], {}
    for e in sorted((e for e in events if e[0] is not None and e[1] is not None and e[2] is not None), key=lambda e: (e[1], e[2], hyp.ACTIONS.index(e[3]) if e[3] in hyp.ACTIONS else 9)):
        i, at, _, action, role, citation, ttl = e
        status, deadline = state.get(i, (None, None))
        if status == "hypothesis" and deadline <= at:
            out.append((i, deadline, "expired", None))
            status, deadline = state[i] = ("expired", None)
        grounded = role in hyp.REVIEWERS and (citation or "").strip() != ""
        end = at + timedelta(days=90 if ttl is None else ttl)
        if (action == "propose" and status in (None, "expired")) or (action == "demote" and grounded and status == "attested"):
            state[i] = ("hypothesis", end)
        elif action == "promote" and grounded and status == "hypothesis":
            state[i] = ("attested", None)
        else:
            continue
        out.append((i, at, *state[i]))
    out += [(i, d, "expired", None) for i, (s, d) in state.items() if s == "hypothesis"]
    return sorted(out, key=key)


def made(seed, n=150):
    r = random.Random(seed)
    e = [(r.choice("abcd"), START + timedelta(hours=r.randrange(2000)), k, r.choice([*hyp.ACTIONS, "propose", "note"]), r.choice([*hyp.REVIEWERS, "extractor", None]), r.choice(["x", "y", " ", None]), r.choice([None, 0, 1, 5])) for k in range(n)]
    return e + e[:10] + [(None, START, 0, "propose", None, None, 1), ("a", None, 0, "propose", None, None, 1), ("a", START, None, "propose", None, None, 1)]


def test_rules(spark):
    e = [
        ("kept", day(0), 0, "propose", "extractor", None, 10), ("kept", day(9), 1, "promote", "reviewer", "c", None),
        ("late", day(0), 0, "propose", "extractor", None, 10), ("late", day(10), 1, "promote", "reviewer", "c", None),
        ("bare", day(0), 0, "propose", "extractor", None, None), ("bare", day(1), 1, "promote", "reviewer", "", None), ("bare", day(2), 2, "promote", "extractor", "c", None),
        ("back", day(0), 0, "propose", None, None, 10), ("back", day(1), 1, "promote", "arbiter", "c", None), ("back", day(50), 2, "demote", "reviewer", "d", 5),
    ]
    h, a, x = "hypothesis", "attested", "expired"
    want = [
        ("back", day(0), h, day(10)), ("back", day(1), a, None), ("back", day(50), h, day(55)), ("back", day(55), x, None), ("bare", day(0), h, day(90)), ("bare", day(90), x, None),
        ("kept", day(0), h, day(10)), ("kept", day(9), a, None), ("late", day(0), h, day(10)), ("late", day(10), x, None),
    ]
    df = spark.createDataFrame(e, SCHEMA)
    assert sorted(map(tuple, hyp.changes(df).collect()), key=key) == want
    early = [w for w in want if w[1] <= day(9)]
    assert sorted(map(tuple, hyp.changes(df, F.lit(day(9))).collect()), key=key) == early
    assert hyp.changes(df.where("false")).count() == 0


def test_table_equals_a_plain_fold(spark):
    e = made(1, 400)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, hyp.changes(spark.createDataFrame(e, SCHEMA)).collect()), key=key) == plain(e)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("seed", [2, 3])
def test_stream_with_late_rows_and_a_restart_equals_the_table(spark, tmp_path, seed):
    e = [x for x in made(seed) if x[1] is not None]
    r = random.Random(seed)
    # rows come up to four days late
    come = sorted(e, key=lambda x: x[1] + timedelta(hours=r.randrange(96)))
    far = [[("tick", day(400 + k), 0, "propose", None, None, 1)] for k in range(2)]

    def run(parts, start):
        for k, part in enumerate(parts):
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/p={start + k}")
            s = spark.readStream.schema(SCHEMA + ", p int").parquet(f"{tmp_path}/in").drop("p")
            q = hyp.stream_changes(s, "5 days").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
            assert q.awaitTermination(120) and q.exception() is None

    size = -(-len(come) // 3)
    run([come[k : k + size] for k in range(0, len(come), size)] + far, 0)
    got = spark.read.parquet(f"{tmp_path}/out").where("id <> 'tick'").collect()
    assert sorted(map(tuple, got), key=key) == plain(e)
