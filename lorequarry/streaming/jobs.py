"""Streams: new files, review decisions into the latest state, windows over them, and the progress of jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.review import latest

TERMINAL = ("completed", "failed")


def stream_files(spark: SparkSession, root: str) -> DataFrame:
    """A stream of new files below ``root``; run it with an available-now trigger and a checkpoint to ingest what is new."""
    f = spark.readStream.format("binaryFile").option("recursiveFileLookup", "true").schema("path string, modificationTime timestamp, length long, content binary").load(root)
    return f.select(F.col("path").alias("file_path"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("modified"), "content")


def once_per_content(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """One row for each path and hash, with state that the watermark bounds."""
    return files.withWatermark("modified", delay).dropDuplicatesWithinWatermark(["file_path", "content_hash"])


def run_latest(stream: DataFrame, keys: list[str], time: str, tie: str, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest row of each key in versions of a Parquet table, ``path/v=N`` for micro-batch N.

    A micro-batch that is run again after a failure writes the same version again, from the one before it.
    """

    def merge(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if n > 0:
            rows = spark.read.schema(batch.schema).parquet(f"{path}/v={n - 1}").unionByName(batch)
        latest(rows, keys, time, tie).select(*batch.columns).write.mode("overwrite").parquet(f"{path}/v={n}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def activity(events: DataFrame, width: str = "1 day", slide: str | None = None, delay: str = "2 days") -> DataFrame:
    """Decisions by tumbling or sliding window and status; batch or stream alike."""
    e = events.withWatermark("reviewed_at", delay)
    w = F.window("reviewed_at", width, slide) if slide else F.window("reviewed_at", width)
    return e.groupBy(w.alias("w"), "status").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "status", "n")


def sessions(events: DataFrame, gap: str = "1 hour", delay: str = "2 days") -> DataFrame:
    e = events.withWatermark("reviewed_at", delay)
    return e.groupBy(F.session_window("reviewed_at", gap).alias("w"), "unit_ord").agg(F.count("*").alias("n")).select("unit_ord", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def progress_events(snapshots: DataFrame) -> DataFrame:
    """``snapshots(job, seq, status, stage, activity array)`` as read one after the other -> the events that a follower is
    sent: ``job, seq, kind, detail``. A status is sent when it or the stage changes, an activity entry once, and an end once."""
    w = Window.partitionBy("job").orderBy("seq")
    s = snapshots.withColumn("_status", F.lag("status").over(w)).withColumn("_stage", F.lag("stage").over(w)).withColumn("_seen", F.coalesce(F.max(F.size("activity")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    changed = ~F.col("status").eqNullSafe(F.col("_status")) | ~F.col("stage").eqNullSafe(F.col("_stage"))
    ended = F.col("status").isin(*TERMINAL) & ~F.coalesce(F.col("_status").isin(*TERMINAL), F.lit(False))
    row = lambda kind, detail: F.struct(F.lit(kind).alias("kind"), detail.alias("detail"))
    some = F.array().cast("array<struct<kind:string,detail:string>>")
    news = F.transform(F.slice("activity", F.col("_seen") + 1, F.greatest(F.size("activity") - F.col("_seen"), F.lit(0))), lambda a: row("activity", a))
    out = F.concat(F.when(changed, F.array(row("status", F.concat_ws(":", "status", "stage")))).otherwise(some), news, F.when(ended, F.array(row("complete", F.col("status")))).otherwise(some))
    return s.select("job", "seq", F.posexplode(out).alias("place", "e")).select("job", "seq", "place", "e.kind", "e.detail")


class Jobs:
    """One run of a pipeline a corpus: stages in order, their progress as rows of a status list."""

    def __init__(self) -> None:
        self.log: list[dict] = []
        self.running: set[str] = set()

    def run(self, spark: SparkSession, corpus: str, stages: list[tuple[str, Callable[[], object]]]) -> str:
        """``completed`` or ``failed``. A corpus that has a run on already is refused."""
        if corpus in self.running:
            raise RuntimeError(f"{corpus} is being processed")
        self.running.add(corpus)
        try:
            for i, (name, stage) in enumerate(stages):
                self.log.append({"corpus": corpus, "status": "processing", "stage": name, "progress": int(i / len(stages) * 100)})
                spark.sparkContext.setJobDescription(f"{corpus}: {name}")
                stage()
            self.log.append({"corpus": corpus, "status": "completed", "stage": None, "progress": 100})
            return "completed"
        except Exception as e:  # the log tells the caller; the next corpus goes on
            self.log.append({"corpus": corpus, "status": "failed", "stage": None, "progress": None, "error": str(e)})
            return "failed"
        finally:
            self.running.discard(corpus)
            spark.sparkContext.setJobDescription(None)
