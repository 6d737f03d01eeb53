"""Contests, polysemy and clusters against plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lorequarry.operators import clusters, contests, elements, polysemy, review

EVENT = "id string, at int, seq int, actor string, action string, position string"


def plain_states(events, arbiters, quorum):
    """One event after another."""
    out = {}
    for id_ in {e[0] for e in events}:
        votes, closed = {}, None
        for _, _, _, actor, action, position in sorted({e for e in events if e[0] == id_}, key=lambda e: e[1:3]):
            if action == "contest":
                votes[actor] = position or ""
            elif action == "withdraw":
                votes.pop(actor, None)
            elif actor in arbiters:
                most = Counter(votes.values()).most_common()
                winner = position if position is not None else most[0][0] if most and (len(most) == 1 or most[0][1] > most[1][1]) else None
                status = "distinguished" if action == "fork" else "resolved" if action == "resolve" and len(votes) >= quorum and winner is not None else "aporetic"
                closed, votes = (status, winner if status == "resolved" else None, len(votes)), {}
        out[id_] = ("contested", None, len(votes)) if votes else closed or ("uncontested", None, 0)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_contests_in_any_order_match_a_replay(spark, seed):
    r = random.Random(seed)
    actions = ["contest"] * 6 + ["withdraw", "resolve", "fork", "accept_aporia"]
    events = [(f"u{r.randrange(40)}", i // 3, i, f"r{r.randrange(6)}", r.choice(actions), r.choice(["x", "y", None])) for i in range(500)]
    events += [("big", i, i, f"r{i % 5}", "contest", "x") for i in range(200)] + [("big", 200, 0, "r0", "resolve", None), ("quiet", 1, 1, "r5", "resolve", "x"), ("back", 1, 1, "r5", "contest", "x"), ("back", 1, 2, "r5", "withdraw", None)]
    rows = events + events[::7]
    r.shuffle(rows)
    odd = [(None, 1, 1, "r0", "contest", "x"), ("u1", None, 1, "r0", "contest", "x"), ("u1", 1, None, "r0", "contest", "x"), ("u1", 1, 1, None, "fork", "x")]
    df = spark.createDataFrame(rows + odd, EVENT)
    got = {x["id"]: tuple(x)[1:] for x in contests.states(df, ["r0", "r1"], 2).collect()}
    assert got == plain_states(events, {"r0", "r1"}, 2)
    assert {v[0] for v in got.values()} == {"contested", "resolved", "distinguished", "aporetic", "uncontested"} and got["big"] == ("resolved", "x", 5)
    then = {x["id"]: tuple(x)[1:] for x in contests.states(df, ["r0", "r1"], 2, F.lit(80)).collect()}
    assert then == plain_states([e for e in events if e[1] <= 80], {"r0", "r1"}, 2)
    assert contests.states(df.limit(0), ["r0"], 2).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_polysemy_matches_all_pairs(spark, seed):
    r = random.Random(seed)
    shards = [(f"c{min(r.randrange(12), 6)}", f"f{r.randrange(6)}", f"a{r.randrange(3)}") for _ in range(400)]
    pairs = [("f0", "f1"), ("f2", "f1"), ("f3", "f4"), ("f5", "f5"), ("f9", None)]
    fits = {frozenset(p) for p in pairs}
    want = Counter()
    for i, (c, f, a) in enumerate(shards):
        for c2, g, b in shards[:i]:
            if c == c2 and f != g and a != b and frozenset((f, g)) not in fits:
                want[c, *sorted((f, g))] += 1
    df = spark.createDataFrame([*shards, (None, "f0", "a"), ("c0", None, "a"), ("c0", "f0", None)], "iri string, framework string, axiom string")
    found = polysemy.conflicts(df, spark.createDataFrame(pairs, "a string, b string")).cache()
    assert {(x["iri"], x["a"], x["b"]): int(x["n"]) for x in found.collect()} == want

    sizes = Counter((c, f) for c, f, _ in shards)
    forks = defaultdict(list)
    for c in {k[0] for k in want}:
        for f in sorted((f for k, f in sizes if k == c), key=lambda f: (-sizes[c, f], f)):
            home = next((s for s in forks[c] if not any((c, *sorted((f, g))) in want for g in s)), None)
            if home is None:
                forks[c].append([f])
            else:
                home.append(f)
    want_rows = {(c, i + 1, f"{c}_{s[0]}", tuple(s), sum(sizes[c, f] for f in s), i == 0) for c, all_ in forks.items() for i, s in enumerate(all_)}
    got = {(x["iri"], x["sense"], x["child"], tuple(x["frameworks"]), x["n"], x["prime"]) for x in polysemy.senses(df, found).collect()}
    assert got == want_rows
    found.unpersist()


def test_polysemy_counts_a_hot_concept_without_pairs(spark):
    hot = spark.range(400_000).select(F.lit("c").alias("iri"), F.concat(F.lit("f"), (F.col("id") % 2).cast("string")).alias("framework"), F.concat(F.lit("a"), (F.col("id") % 4).cast("string")).alias("axiom"))
    got = polysemy.conflicts(hot, spark.createDataFrame([], "a string, b string")).collect()
    # a framework says a0 or a2, the other a1 or a3: none agree
    assert [(x["iri"], int(x["n"])) for x in got] == [("c", 200_000**2)]


def test_polysemy_of_nothing(spark):
    none = spark.createDataFrame([], "iri string, framework string, axiom string")
    found = polysemy.conflicts(none, spark.createDataFrame([], "a string, b string"))
    assert found.count() == 0 and polysemy.senses(none, found).count() == 0


def _ancestors(edges):
    up = defaultdict(set)
    for c, p in edges:
        if c is not None and p is not None and c != p:
            up[c].add(p)
    out = {}

    def of(x):
        if x not in out:
            out[x] = set().union(*[{p} | of(p) for p in up[x]]) if up[x] else set()
        return out[x]

    for c in list(up):
        of(c)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_closure_and_lowest_shared(spark, seed):
    r = random.Random(seed)
    edges = [(i, r.randrange(i)) for i in range(1, 60) for _ in range(r.randrange(3))] + [(100 + i, 99 + i) for i in range(1, 40)] + [(5, 5), (None, 3), (7, None)]
    anc = _ancestors(edges)
    paths = clusters.closure(spark.createDataFrame(edges, "id int, parent int"))
    assert sorted(map(tuple, paths.collect())) == sorted((c, a) for c, s in anc.items() for a in s)
    pairs = [(r.randrange(60), r.randrange(60)) for _ in range(80)] + [(139, 120), (1, 120), (3, 3), (None, 3)]
    want = set()
    for a, b in pairs:
        if a is not None:
            both = (anc.get(a, set()) | {a}) & (anc.get(b, set()) | {b})
            want |= {(a, b, x) for x in both if not any(x in anc.get(y, set()) for y in both)}
    got = clusters.lowest_shared(spark.createDataFrame(pairs, "a int, b int"), paths)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert clusters.closure(spark.createDataFrame([], "id int, parent int")).count() == 0


def test_coverage(spark):
    shards = [("s1", "t2", "c1", "us", True), ("s1", "t3", "c1", "us", False), ("s2", "t3", "c9", None, False), (None, None, None, "uk", False)]
    tasks = [("t1", None), ("t2", "t1"), ("t3", "t1"), ("t4", "t3"), ("t5", "t5")]
    got = clusters.coverage(spark.createDataFrame(shards, "source string, task string, concept string, jurisdiction string, authority boolean"), spark.createDataFrame(tasks, "id string, parent string"), spark.createDataFrame([("c1", "c0"), ("c1", "c00")], "id string, parent string"))
    assert {tuple(x) for x in got.collect()} == {
        ("source", "s1", True, 2, 1, False), ("source", "s2", True, 1, 0, True), ("jurisdiction", "us", True, 2, 1, False), ("jurisdiction", "uk", True, 1, 0, True),
        ("subtree", "t1", False, 3, 1, False), ("subtree", "t2", True, 1, 1, False), ("subtree", "t3", False, 2, 0, False), ("subtree", "t4", True, 0, 0, True), ("subtree", "t5", True, 0, 0, True),
        ("doctrine", "c1", True, 2, 1, False), ("doctrine", "c0", False, 2, 1, False), ("doctrine", "c00", False, 2, 1, False), ("doctrine", "c9", True, 1, 0, True),
    }


def test_task_reviews_and_deletions(spark):
    tasks = spark.createDataFrame([("a", "A", 0.9), ("b", "B", 0.2), ("c", None, None)], "task_id string, label string, confidence double")
    rows = [("a", "edited", "A2", "n", 1, 1), ("a", "seen", "A3", None, 5, 5), ("b", "edited", "B2", "m", 1, 2), ("b", "rejected", None, None, 2, 3), ("x", "approved", None, None, 1, 4), ("c", None, None, None, 1, 6)]
    log = review.review_tasks(tasks, spark.createDataFrame(rows, "task_id string, status string, edited_label string, note string, reviewed_at int, seq long"))
    log = review.append(log, review.bulk_approve_tasks(tasks, F.lit(3), F.lit(9), least=0.5))
    got = {x["task_id"]: (x["status"], x["edited_label"], x["note"], x["reviewed_at"]) for x in review.reviewed_tasks(tasks, log).collect()}
    assert got == {"a": ("approved", "A2", "n", 3), "b": ("rejected", None, "", 2), "c": ("unreviewed", None, "", None)}
    ids = spark.createDataFrame([("b",), ("b",), ("x",)], "task_id string")
    assert [x["task_id"] for x in review.bulk_approve_tasks(tasks, F.lit(3), F.lit(9), ids).collect()] == ["b"]
    with pytest.raises(ValueError):
        review.bulk_approve_tasks(tasks, F.lit(3), F.lit(9))

    links = spark.createDataFrame([("b", "u1"), ("a", "u1"), ("x", "u2")], "task_id string, unit_id string")
    left, kept, edits = review.delete_tasks(tasks, links, review.audit(tasks.limit(0), "", F.lit(1)), ids, F.lit(7))
    assert {x["task_id"] for x in left.collect()} == {"a", "c"} and {tuple(x) for x in kept.collect()} == {("a", "u1"), ("x", "u2")}
    assert [tuple(x) for x in edits.collect()] == [("b", "delete", "Deleted task: B", 7)]


def test_model_segments_of_odd_replies(spark):
    text = "x" * 30 + " " * 10 + "y" * 30
    replies = {
        "near": '{"boundaries": [{"start": 19, "end": 25}, {"start": 20, "end": 30}]}',
        "blank": '{"boundaries": [{"start": 0, "end": 30}, {"start": 31, "end": 39}]}',
        "open": '{"boundaries": [{"end": 30}, {"start": 40}]}',
        "one": '{"boundaries": [{"start": 0, "end": 30}]}',
        "bad": "no json",
        "none": None,
    }
    df = spark.createDataFrame([(k, 0, 0, 100, text, [0], v) for k, v in replies.items()], "file_path string, seq int, part int, start long, text string, candidates array<long>, reply string")
    got = {(x["file_path"], x["start"], x["end"], x["confidence"]) for x in elements.model_segments(df).collect()}
    assert got == {("near", 119, 125, 0.85), ("near", 120, 130, 0.75), ("open", 100, 130, 0.85), ("open", 140, 170, 0.75)}


def test_closure_of_a_cycle_and_no_path_found_over_and_over(spark, monkeypatch):
    ring = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)] + [(9, 0)], "id int, parent int")
    assert sorted(map(tuple, clusters.closure(ring).collect())) == sorted([(i, j) for i in range(5) for j in range(5)] + [(9, j) for j in range(5)])
    chain, found, distinct = spark.range(1, 65).selectExpr("id", "id - 1 AS parent"), [], type(ring).distinct
    monkeypatch.setattr(type(ring), "distinct", lambda self: found.append(self.count()) or distinct(self))
    n = clusters.closure(chain).count()
    assert n == 64 * 65 // 2 and sum(found) < 4 * n  # rows before repeated ones go


def test_lowest_shared_by_edges(spark):
    edges = spark.createDataFrame([(3, 1), (3, 2), (4, 3), (5, 3), (5, 1), (6, 2)], "id int, parent int")
    paths = clusters.closure(edges)
    pairs = spark.createDataFrame([(4, 5), (4, 6), (6, 1), (5, 5), (3, 5)], "a int, b int")
    want = [(3, 5, 3), (4, 5, 3), (4, 6, 2), (5, 5, 5)]
    assert sorted(map(tuple, clusters.lowest_shared(pairs, paths, edges).collect())) == want
    assert sorted(map(tuple, clusters.lowest_shared(pairs, paths).collect())) == want
