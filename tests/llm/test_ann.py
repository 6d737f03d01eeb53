from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lorequarry.llm import ann


def run(spark, rows, every=20, settings=ann.Settings()):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % every == 0, settings).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    return out


def brute(ids, m, q, k=20):
    s = [sum(float(a) * float(b) for a, b in zip(m[i], m[q], strict=True)) for i in range(len(ids))]
    order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-s[i], ids[i]))[:k]
    return [(ids[i], s[i]) for i in order]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(1)
    m = rng.standard_normal((3000, 32)).astype(np.float32) * rng.uniform(0.5, 2, (3000, 1)).astype(np.float32)
    ids = list(range(3000))
    got = run(spark, [(i, m[i].tolist()) for i in ids], every=100)
    recall = []
    for q in range(0, 3000, 100):
        want = brute(ids, m, q)
        assert [r for _, _, r in got[q]] == list(range(1, 21))
        assert all(abs(s - float(m[q].astype(float) @ m[v].astype(float))) < 1e-9 for v, s, _ in got[q])
        assert [x[:2] for x in got[q]] == sorted([x[:2] for x in got[q]], key=lambda x: (-x[1], x[0]))
        recall.append(len({v for v, _ in want} & {v for v, _, _ in got[q]}) / 20)
    assert np.mean(recall) >= 0.9


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((60, 8)).astype(np.float32)
    got = run(spark, [(i, m[i].tolist()) for i in range(60)])
    for q in (0, 20, 40):
        assert [(v, round(s, 9)) for v, s, _ in got[q]] == [(v, round(s, 9)) for v, s in brute(list(range(60)), m, q)]
    few = run(spark, [(i, m[i].tolist()) for i in range(5)])
    assert len(few[0]) == 4
    assert run(spark, [(0, m[0].tolist())]) == {}
    assert run(spark, []) == {}


def test_common_vector_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((400, 16)).astype(np.float32)
    common = [1.0] * 16
    rows = [(i, m[i].tolist()) for i in range(400)] + [(i, common) for i in range(400, 1000)]
    got = run(spark, rows, every=500, settings=ann.Settings(cell_rows=64))
    assert [v for v, _, _ in got[500]] == list(range(400, 420))


def test_invalid_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0, None]), (6, [float("inf"), 0.0]), (20, [1.0]), (7, [0.9, 0.1]), (7, [0.9, 0.1]), (None, [1.0, 1.0])]
    got = run(spark, rows)
    assert {q: [v for v, _, _ in x] for q, x in got.items()} == {0: [7, 1]}


def test_each_length_is_searched_among_its_own(spark):
    rng = np.random.default_rng(5)
    m = rng.standard_normal((50, 8)).astype(np.float32)
    rows = [(i, m[i].tolist()) for i in range(50)] + [(100, [1.0] * 9), (200, [1.0] * 3), (201, [2.0] * 3)]
    got = run(spark, rows)
    assert set(got) == {0, 20, 40, 200}
    for q in (0, 20, 40):
        assert [v for v, _, _ in got[q]] == [v for v, _ in brute(list(range(50)), m, q)]
    assert got[200] == [(201, 6.0, 1)]


def test_candidates_grow_less_than_vectors(spark):
    """At two sizes the recall holds, and a query visits a smaller share of the larger table."""
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 24))
    share = []
    for n in (2000, 16_000):
        m = (centres[rng.integers(0, 40, n)] + 0.4 * rng.standard_normal((n, 24))).astype(np.float32)
        df = spark.createDataFrame([(i, m[i].tolist()) for i in range(n)], "vec_id long, embedding array<float>")
        ws = ann.Workspace(spark, "test-ann")
        share.append(ann.fit(ws, ws.save(ann.valid_vectors(df), "vectors"), ann.Settings()).share)
        got = {}
        for r in ann.search(df, F.col("vec_id") % (n // 50) == 0).collect():
            got.setdefault(r["query_id"], set()).add(r["vec_id"])
        d = m.astype(float)
        recall = []
        for q in range(0, n, n // 50):
            s = d @ d[q]
            s[q] = -np.inf
            recall.append(len(set(np.argsort(-s)[:20].tolist()) & got[q]) / 20)
        assert np.mean(recall) >= 0.9
    assert share[1] < share[0] < 0.5
    assert ann.Settings().for_rows(1 << 16).hashes == 6 and ann.Settings().for_rows(1 << 30).hashes > 8


def test_queries_are_split_and_names_clash(spark):
    rng = np.random.default_rng(6)
    m = rng.standard_normal((300, 8)).astype(np.float32)
    rows = [(i, m[i].tolist(), "x", 1, 2) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v string, score int, rank int")
    one, many = (sorted(map(tuple, ann.search(df, F.col("vec_id") % 3 == 0, s).collect())) for s in (ann.Settings(), ann.Settings(share_queries=16, cell_rows=64, held_rows=300)))
    assert one == many and len(one) == 2000
