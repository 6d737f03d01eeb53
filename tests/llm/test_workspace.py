"""What operators leave on disk, and what they send through the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.llm import linking, mixing, neardup, workspace
from lorequarry.llm.workspace import CLEANUP, Workspace, swept


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {f.getPath() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")}


def plans_since(spark, before):
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    rows = store.executionsList()
    return [rows.apply(i).physicalPlanDescription() for i in range(rows.size()) if rows.apply(i).executionId() > before]


def last_execution(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    rows = spark._jsparkSession.sharedState().statusStore().executionsList()
    return max([rows.apply(i).executionId() for i in range(rows.size())], default=-1)


def test_a_saved_table_leaves_no_shuffle_files(spark):
    ws = Workspace(spark, "swept")
    setting, before = spark.conf.get(CLEANUP, None), shuffle_files(spark)
    saved = ws.save(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s")), "sums")
    assert not shuffle_files(spark) - before
    assert spark.conf.get(CLEANUP, None) == setting
    assert saved.count() == 7
    with swept(spark):
        again = saved.groupBy("k").count()
        assert [again.count(), again.count()] == [7, 7]  # a query may be run again


@pytest.fixture
def eager(spark, monkeypatch):
    """Spark would broadcast any table whose size it takes to be below a gigabyte; none is counted as small."""
    monkeypatch.setattr(workspace, "BROADCAST_BYTES", -1)
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    given = spark.conf.get(threshold)
    spark.conf.set(threshold, "1g")
    yield last_execution(spark)
    spark.conf.set(threshold, given)


def test_exploded_blocks_are_not_broadcast(spark, monkeypatch, eager):
    monkeypatch.setattr(linking, "BLOCK", 4)
    ws = Workspace(spark, "linking")
    # 1 to 29 are alike, and all of them in the bucket of 0, which is like none
    items = {i: np.array([*range(100), 1000 + i], np.uint64) for i in range(1, 30)} | {0: np.arange(5000, 5100, dtype=np.uint64)}
    sets = ws.save(spark.createDataFrame([(i, bytearray(8), bytearray(x.tobytes())) for i, x in items.items()], "id long, sketch binary, payload binary"))
    star = ws.save(spark.createDataFrame([(7, 0, i) for i in range(1, 30)], "bucket long, hub long, id long"))
    found = linking.components(ws, star, sets, neardup.unpack, 85, 1 << 20)
    assert {tuple(r) for r in found.collect()} == {(i, 1) for i in range(1, 30)}
    plans = plans_since(spark, eager)
    assert any("explode" in p for p in plans)
    assert not [p for p in plans if "BroadcastExchange" in p]


def test_no_table_of_documents_is_broadcast(spark, eager):
    rows = [(i, " ".join(f"w{i // 2}x{k}" for k in range(30)) + (" end" if i % 2 else ""), f"s{i % 2}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ws = Workspace(spark, "documents")
    kept = ws.save(neardup.keep_one(docs))
    assert kept.count() == 20
    assert ws.save(mixing.mix(kept, spark.createDataFrame([(0, 1)], "doc_id long, quality int"))).count() == 20
    # the tables of sources are joined among each other as Spark likes
    assert not [p for p in plans_since(spark, eager) if "BroadcastExchange" in p and ("digest#" in p or "key#" in p or "text#" in p)]


def test_chained_buckets_are_compared_each_by_itself(spark, monkeypatch):
    """Items 3k, 3k+1 and 3k+2 share a bucket, and every last one the next bucket's first: a chain of 600 items."""
    monkeypatch.setattr(linking, "BLOCK", 4)
    blocks, sent = linking._blocks, []
    monkeypatch.setattr(linking, "_blocks", lambda rows: sent.append(blocks(rows).count()) or blocks(rows))
    ws = Workspace(spark, "chain")
    # the second and the third of a bucket are alike, its first is like none
    items = [(i, bytearray(8), bytearray((np.arange(100) + 10_000 * (i - i % 3 + i % 3 // 2)).astype(np.uint64).tobytes())) if i % 3 else (i, bytearray(8), bytearray((np.arange(100) + 10_000_000 + 10_000 * i).astype(np.uint64).tobytes())) for i in range(603)]
    same = {i: items[i - 1][2] for i in range(2, 603, 3)}
    items = [(i, s, same.get(i, x)) for i, s, x in items]
    sets = ws.save(spark.createDataFrame(items, "id long, sketch binary, payload binary"))
    stars = [(-1 - i, i, j) for i in range(0, 600, 3) for j in (i + 1, i + 2, i + 3)]
    star = ws.save(spark.createDataFrame(stars, "bucket long, hub long, id long"))
    found = linking.components(ws, star, sets, neardup.unpack, 85, 1 << 20)
    assert {tuple(r) for r in found.collect()} == {(x, i + 1) for i in range(0, 600, 3) for x in (i + 1, i + 2)}
    assert sent[0] <= 4 * 200
