"""Forks of concepts and nearest clusters, against slower ways to the same."""

from __future__ import annotations

import random

import numpy as np

from lorequarry.operators import polysemy, similarity


def test_forks_are_the_senses_of_conflicts(spark):
    r = random.Random(5)
    frameworks = [f"f{i}" for i in range(8)]
    rows = [(f"c{r.randrange(12)}", r.choice(frameworks), r.choice("xyz")) for _ in range(160)]
    # agreeing concepts, one shard against many, and rows with a null
    rows += [("same", f, "x") for f in frameworks] + [("one", "f0", "x")] + [("one", f, "y") for f in frameworks[1:]] + [(None, "f0", "x"), ("c0", None, "x"), ("c0", "f1", None)]
    shards = spark.createDataFrame(rows, "iri string, framework string, axiom string")
    compatible = spark.createDataFrame([("f0", "f1"), ("f3", "f2"), ("f4", "f4"), ("f5", None), ("f6", "f7")], "a string, b string")
    want = polysemy.senses(shards, polysemy.conflicts(shards, compatible))
    got = polysemy.forks(shards, compatible)
    assert got.schema.simpleString() == want.schema.simpleString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert {x["iri"] for x in got.select("iri").collect()} & {"same", "one"} == {"one"}
    # conflicts are no rows, and what fits is in no shuffle of shards
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "explode(" not in plan.replace("posexplode(", "")
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(iri" in x and "fits" in x]


def test_closest_rows_against_double_precision():
    r = np.random.default_rng(2)
    v = r.standard_normal((300, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    # differences that single precision can't tell, and exact ties
    v[100:200] = v[:100] + 1e-9 * r.standard_normal((100, 16))
    v[200:250] = v[:50] + 1e-9 * r.standard_normal((50, 16))
    v[250:260] = np.eye(16)[:10]
    ids, h = np.arange(300) * 3, r.integers(0, 2**63, 300, dtype=np.uint64)
    left = np.sort(r.permutation(300)[:170])
    for above in (0.2, 0.9999, -2.0):
        found = list(similarity.closest_rows(v[left], v, ids[left], ids, h[left], h, above))
        got = {int(i): (int(n), s, int(t)) for part in found for i, n, s, t in zip(*part, strict=True)}
        want = {}
        for k in left:
            s = np.round(np.einsum("j,ij->i", v[k], v), 12)
            s[k] = -np.inf
            tie = (((h[k] ^ h) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(2)).astype(np.int64)
            best = max(range(300), key=lambda y: (s[y], tie[y]))
            if s[best] > above:
                want[int(ids[k])] = (int(ids[best]), s[best], int(tie[best]))
        assert {i: (n, t) for i, (n, _, t) in got.items()} == {i: (n, t) for i, (n, _, t) in want.items()}
        assert all(abs(got[i][1] - want[i][1]) < 2e-12 for i in want)
    alone = list(similarity.closest_rows(v[:1], v[:1], ids[:1], ids[:1], h[:1], h[:1], -2.0))
    assert not alone
