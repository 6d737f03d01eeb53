"""Shapes and edit logs against plain versions."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lorequarry.operators import edits, shapes
from lorequarry.operators.shapes import TYPE, Constraint

TRIPLE = "s string, p string, o string, kind string, datatype string"


def plain_violations(triples, constraints):
    triples = set(triples)
    classes = {(s, o) for s, p, o, *_ in triples if p == TYPE}
    out = []
    for c in constraints:
        for s in {s for s, k in classes if k == c.target}:
            if c.when_path and not any(x[0] == s and x[1] == c.when_path and x[2] == c.when_value for x in triples):
                continue
            if c.inverse:
                values = [(x[0], "iri", None) for x in triples if x[1] == c.path and x[2] == s and x[3] == "iri"]
            else:
                values = [x[2:] for x in triples if x[0] == s and x[1] == c.path]
            bad = {
                "least": len(values) if c.least is not None and len(values) < c.least else None,
                "most": len(values) if c.most is not None and len(values) > c.most else None,
                "datatype": sum(c.datatype is not None and d != c.datatype for _, _, d in values) or None,
                "node_kind": sum(c.node_kind is not None and k != c.node_kind for _, k, _ in values) or None,
                "value_class": sum(c.value_class is not None and not (k == "iri" and (v, c.value_class) in classes) for v, k, _ in values) or None,
                "pattern": sum(c.pattern is not None and not v.startswith(c.pattern[1:]) for v, _, _ in values) or None,
                "one_of": sum(c.one_of is not None and v not in c.one_of for v, _, _ in values) or None,
            }
            out += [(c.shape, c.path, k, s, n) for k, n in bad.items() if n is not None]
    return sorted(out)


def test_shapes_match_brute_force(spark):
    r = random.Random(2)
    triples = []
    for i in range(300):
        s = f"e{r.randrange(40)}"
        p = r.choice([TYPE, TYPE, "p", "q", "r"])
        literal = p != TYPE and r.random() < 0.5
        o = r.choice(["A", "B", "C"]) if p == TYPE else r.choice(["x1", "x2", "y"]) if literal else f"e{r.randrange(40)}"
        triples.append((s, p, o, "literal" if literal else "iri", r.choice(["int", "text"]) if literal else None))
    triples += triples[:50]
    constraints = [
        Constraint("s1", "A", "p", least=1, most=2, node_kind="literal"), Constraint("s1", "A", "q", datatype="int", pattern="^x"), Constraint("s2", "B", "r", value_class="C", most=0),
        Constraint("s2", "B", "p", one_of=("x1", "e1")), Constraint("s3", "C", "q", inverse=True, least=1, value_class="A"), Constraint("s3", "C", "p", least=3, when_path="q", when_value="y"), Constraint("s4", "none", "p", least=1),
    ]
    df = spark.createDataFrame(triples, TRIPLE)
    got = sorted(map(tuple, shapes.violations(df, constraints).collect()))
    assert got == plain_violations(triples, constraints) and {g[2] for g in got} == set(shapes.RULES)
    assert shapes.violations(df, []).count() == 0 and shapes.violations(df.limit(0), constraints).count() == 0
    exchanges = shapes.violations(df, constraints * 20)._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges == shapes.violations(df, constraints[:1])._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


LOG = "id string, field string, old_value string, new_value string, at timestamp, seq long"


def history(n=400, seed=4):
    r, t0 = random.Random(seed), datetime(2024, 1, 1)
    first = {(f"s{i}", f): r.choice([None, "a", "b"]) for i in range(8) for f in ("sense", "layer", "source")}
    state, log, states = dict(first), [], []
    for i in range(n):
        key = ("s0", "sense") if r.random() < 0.3 else r.choice(list(first))
        at = t0 + timedelta(hours=i // 3)  # ties
        new = r.choice([None, "a", "b", "c"])
        log.append((*key, state[key], new, at, i))
        state[key] = new
        states.append((at, dict(state)))
    return first, log, state, states


def rows(state):
    return sorted(((i, f, v) for (i, f), v in state.items()), key=repr)


def test_replays_agree_at_any_time(spark):
    first, log, state, states = history()
    df = spark.createDataFrame(log, LOG).repartition(4)
    begin, end = (spark.createDataFrame(rows(x), "id string, field string, value string") for x in (first, state))
    for at in (datetime(2023, 1, 1), states[100][0], states[250][0], states[-1][0]):
        want = rows(next((s for t, s in reversed(states) if t <= at), first))
        got = [sorted(map(tuple, d.collect()), key=repr) for d in (edits.state_before(end, df, F.lit(at)), edits.replayed(begin, df, F.lit(at)))]
        assert got == [want, want]
    assert edits.broken_links(end, df).count() == 0


def test_broken_logs_are_found(spark):
    _, log, state, _ = history(60)
    i = next(k for k, e in enumerate(log) if any(x[:2] == e[:2] for x in log[:k]))
    bad = [(*e[:2], "zzz", *e[3:]) if k == i else e for k, e in enumerate(log)]
    now = dict(state)
    lost = log[-1][:2]
    now[lost] = "other"
    current = spark.createDataFrame(rows(now), "id string, field string, value string")
    df = spark.createDataFrame(bad, LOG)
    got = {(r["id"], r["field"], r["seq"], r["problem"]) for r in edits.broken_links(current, df, ["source"]).collect()}
    want = {(*log[i][:2], i, "gap"), (*lost, log[-1][5], "lost")} | {(*e[:2], e[5], "immutable") for e in log if e[1] == "source"}
    assert got == want
    assert edits.broken_links(current, df.limit(0)).count() == 0
    assert edits.not_appended(df.limit(30), df).count() == 0 and edits.not_appended(spark.createDataFrame(log, LOG), df).count() == 1
