"""Runs that are killed go on where they ended."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lorequarry.plans import engine
from lorequarry.plans.stages import Run, Store
from tests.test_engine import ONE


class Killed(Exception):
    pass


def chain(store, n, factor=2, fail=None, log=None):
    run = Run(store, "chain", "last", progress=lambda *x: log is not None and log.append(x), of=3)
    run.given("n", n)

    def build(name, df):
        def go():
            if fail == name:
                raise Killed(name)
            return df()

        return go

    a = run.stage("a", build("a", lambda: store.spark.range(n)), ["n"])
    b = run.stage("b", build("b", lambda: a.select((F.col("id") * factor).alias("id"))), ["a"], factor)
    return run, run.stage("last", build("last", lambda: b.agg(F.sum("id").alias("s"))), ["b"])


def states(run):
    return {n: s for n, s, _ in run.took}


def test_only_what_lies_downstream_is_run_again(spark, tmp_path):
    store, log = Store(spark, f"file://{tmp_path}/s"), []
    for fail in ("a", "b", "last"):
        with pytest.raises(Killed):
            chain(store, 10, fail=fail)
    run, out = chain(store, 10, log=log)
    assert out.first()["s"] == 90 and states(run) == {"a": "skipped", "b": "skipped", "last": "finished"}
    assert log == [("a", "skipped", 1 / 3), ("b", "skipped", 2 / 3), ("last", "started", 2 / 3), ("last", "finished", 1.0)]
    run, out = chain(store, 10, factor=3)
    assert out.first()["s"] == 135 and states(run) == {"a": "skipped", "b": "finished", "last": "finished"}
    assert states(chain(store, 11)[0]) == dict.fromkeys(("a", "b", "last"), "finished")
    # a version that was written but not vouched for is written again
    store.write("b", spark.range(1))
    assert states(chain(store, 11)[0])["b"] == "finished"


def test_what_a_dead_run_wrote_is_no_base(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s")
    store.write("t", spark.range(1))

    def once(die):
        run = Run(store, "sum", "end")
        old = run.base("t")
        new = run.stage("t", lambda: old.union(spark.range(100, 101)), ["base:t"])
        if die:
            raise Killed
        run.stage("end", lambda: new, ["t"])
        return sorted(r["id"] for r in store.read("t").collect())

    for _ in range(2):
        with pytest.raises(Killed):
            once(True)
    assert once(False) == [0, 100]
    assert once(False) == [0, 100, 100]
    store.write("t", spark.range(5, 6))  # from elsewhere, as a reviewer's edits are
    assert once(False) == [5, 100]


def contents(store, names):
    def rows(df):
        return sorted(r["j"] for r in df.select(F.to_json(F.struct(*sorted(df.columns))).alias("j")).collect())

    return {n: rows(store.read(n)) for n in names}


def test_a_run_killed_in_any_stage_ends_like_one_that_was_not(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text(ONE)
    source = f"file://{tmp_path}/in"
    whole, broken = Store(spark, f"file://{tmp_path}/whole"), Store(spark, f"file://{tmp_path}/broken")
    engine.extract(spark, source, whole)
    wrote: Counter = Counter()
    write, left = Store.write, [1]

    def dying(self, name, df):
        if not left[0]:
            raise Killed(name)
        left[0] -= 1
        wrote[name] += 1
        return write(self, name, df)

    monkeypatch.setattr(Store, "write", dying)
    attempts = 0
    while True:
        left[0], attempts = 1, attempts + 1
        try:
            engine.extract(spark, source, broken)
            break
        except Killed:
            continue
    assert attempts >= 9 and set(wrote.values()) == {1}
    assert wrote.keys() == {"elements", "boundaries", "classified", "units_all", "unit_vectors", "units", "errors", "summary", "review", "registry"}
    names = ["elements", "units", "review", "summary", "registry"]
    assert contents(broken, names) == contents(whole, names)
    # other thresholds touch only what depends on them
    wrote.clear()
    left[0] = 99
    monkeypatch.setattr(engine.src, "needs_processing", lambda files, registry: files)
    states = []
    engine.extract(spark, source, broken, high=0.9, progress=lambda n, s, _: states.append((n, s)))
    assert {"summary", "review", "registry"} <= wrote.keys()
    assert "reason" in broken.read("review").columns
