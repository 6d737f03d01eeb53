from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from lorequarry.llm import mixing
from lorequarry.llm.queries import MIX_SQL


def targets_by_rounds(sizes, weights, most):
    """The excess of sources over their cap is shared out again and again."""
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in sizes if s not in fixed]
        if not free:
            return fixed
        rest = total - sum(fixed.values())
        w = sum(weights[s] for s in free)
        over = [s for s in free if rest * weights[s] / w > most * sizes[s]]
        if not over:
            return fixed | {s: rest * weights[s] / w for s in free}
        for s in over:
            fixed[s] = float(most * sizes[s])


@pytest.mark.parametrize("seed", range(4))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i:02d}": r.choice([0, 1, 10, 300, 10_000]) for i in range(r.randrange(1, 12))}
    got = {x["source"]: x["target"] for x in mixing.water_fill(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    weights = {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
    expected = targets_by_rounds(sizes, weights, 3)
    assert got.keys() == sizes.keys()
    for s in sizes:
        assert got[s] == pytest.approx(expected[s], rel=1e-9, abs=1e-6)


def corpus(spark, n=3000):
    r = random.Random(3)
    rows = []
    for i in range(n):
        source = r.choice(["hot"] * 5 + ["b", "c", "tiny", None])
        if source == "tiny" and i % 20:
            source = "hot"
        rows.append((i, " ".join("w" for _ in range(r.randrange(0, 40))), source))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def test_matches_sql(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 50)
    docs = corpus(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 3000, 3)] + [(0, 1)], "doc_id long, quality int")
    got = mixing.mix(docs, labels).toPandas()
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    con.register("labels", labels.toPandas())
    want = con.execute(MIX_SQL.format(documents="documents")).df()
    key = lambda d: sorted((r.doc_id, r.size, r.source or "", r.source_size, round(r.target, 6), r.taken, r.epochs) for r in d.itertuples(index=False))
    assert key(got) == key(want)


def test_budgets(spark):
    got = mixing.mix(corpus(spark)).toPandas()
    assert (got["taken"] <= 3 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 40
        low = g["epochs"].min() if (g["size"] > 0).all() else g[g["size"] > 0]["epochs"].min()
        assert set(g[g["size"] > 0]["epochs"]) <= {low, low + 1}  # whole epochs come before a fraction of one
    assert got["source"].isna().any()


def test_quality_raises_the_chance(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a" if i < 2000 else "b") for i in range(2100)], "doc_id long, text string, source string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    got = mixing.mix(docs, labels).where("source = 'a'").toPandas()
    share = (got["taken"] > 0).groupby(got["doc_id"] % 2).mean()  # 0.9 of the source is taken
    assert share[1] > 0.98 and share[0] < 0.85


def test_reruns_agree_and_edge_cases(spark):
    docs = corpus(spark, 400)
    a, b = (sorted(map(str, mixing.mix(d).collect())) for d in (docs, docs.repartition(7)))
    assert a == b
    assert mixing.mix(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, None, "a", 5), (2, "", None, 6), (3, "x y", "a", 7), (3, "x y", "a", 7), (None, "z", "b", 8)], "doc_id long, text string, source string, size int")
    got = mixing.mix(odd).collect()
    assert len(got) == 5 and sorted(r["size"] for r in got) == [0, 0, 1, 2, 2]
    assert mixing.mix(odd.where("doc_id < 3")).agg(F.sum("taken")).first()[0] == 0
