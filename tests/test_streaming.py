from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lorequarry.operators.review import latest
from lorequarry.plans import fixtures as fix
from lorequarry.streaming import jobs


def test_streamed_latest_equals_batch(spark, sf, tmp_path):
    d = fix.decisions(spark, sf)
    d.repartition(4).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(d.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = jobs.run_latest(s, ["unit_ord"], "reviewed_at", "event_id", f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination(120)
    assert q.exception() is None
    last = q.lastProgress["batchId"]
    got = spark.read.parquet(f"{tmp_path}/out/v={last}")
    want = latest(d, ["unit_ord"], "reviewed_at", "event_id").select(*d.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_streamed_windows_equal_batch(spark, sf, tmp_path):
    d = fix.decisions(spark, sf).withColumn("reviewed_at", F.col("reviewed_at").cast("timestamp"))
    d.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(d.schema).parquet(f"{tmp_path}/in")
    q = jobs.activity(s).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("activity").collect())) == sorted(map(tuple, jobs.activity(d).collect()))
    assert jobs.activity(d, "2 days", "1 day").agg(F.sum("n")).first()[0] == 2 * d.count()


def test_new_files_are_streamed_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("a")

    def run():
        s = jobs.once_per_content(jobs.stream_files(spark, f"file://{tmp_path}/in"))
        q = s.select("file_path", "content_hash").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.read.parquet(f"{tmp_path}/out").count()

    assert run() == 1
    (tmp_path / "in/b.md").write_text("b")
    assert run() == 2 and run() == 2


def test_progress_events(spark):
    rows = [("j", 0, "pending", None, []), ("j", 1, "processing", "ingest", ["a"]), ("j", 2, "processing", "ingest", ["a", "b"]), ("j", 3, "completed", None, ["a", "b", "c"]), ("j", 4, "completed", None, ["a", "b", "c"])]
    df = spark.createDataFrame(rows, "job string, seq int, status string, stage string, activity array<string>")
    got = [(r["seq"], r["kind"], r["detail"]) for r in jobs.progress_events(df).orderBy("seq", "place").collect()]
    assert got == [(0, "status", "pending"), (1, "status", "processing:ingest"), (1, "activity", "a"), (2, "activity", "b"), (3, "status", "completed"), (3, "activity", "c"), (3, "complete", "completed")]


def test_jobs(spark):
    j = jobs.Jobs()

    def again():
        j.run(spark, "c", [])

    assert j.run(spark, "c", [("one", lambda: None), ("two", lambda: None)]) == "completed"
    assert [x["progress"] for x in j.log] == [0, 50, 100]
    assert j.run(spark, "c", [("again", again)]) == "failed" and "processed" in j.log[-1]["error"]
    with pytest.raises(RuntimeError):
        j.running.add("d")
        j.run(spark, "d", [])
