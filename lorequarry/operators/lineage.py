"""Cutting the lineage of iterative plans, by tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_left: list[tuple[SparkSession, str]] = []


@atexit.register
def _remove() -> None:
    for spark, path in _left:
        try:
            if spark.sparkContext._jsc is not None:
                p = spark._jvm.org.apache.hadoop.fs.Path(path)
                p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session may have ended before
            pass


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where that is unset, a temporary folder is taken if all runs on this machine, as in tests;
    on a cluster that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="lorequarry-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df``, written once below ``shared_dir`` and read from there; it goes when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    _left.append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of long values, texts or files, that a Python worker has open at a time.
OPEN_ROWS = 64


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` by ``OPEN_ROWS``: what Python makes of them doesn't grow with the batch."""
    for batch in batches:
        for i in range(0, batch.num_rows, OPEN_ROWS):
            yield batch.slice(i, OPEN_ROWS)


def one_row(*frames: DataFrame) -> DataFrame:
    """Frames of a row each, of different columns, as one row: a union and an aggregate instead of a product."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out.agg(*[F.max(c).alias(c) for c in out.columns])


def numbered(rows: DataFrame, *order: str, name: str = "ord") -> DataFrame:
    """``rows`` with ``name``, their places in the order, from 1: rows are dealt out by ranges of the order, and each range is
    numbered from the count of those before it. The counts, one a range, are joined by broadcast."""
    dealt = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("n")).orderBy("_part").collect()
    before, n = [], 0
    for r in counts:
        before.append((r["_part"], n))
        n += r["n"]
    base = dealt.sparkSession.createDataFrame(before, "_part long, _before long")
    joined = dealt.withColumn("_part", part).join(F.broadcast(base), "_part", "left")
    return joined.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_at", "_part", "_before")
