"""Written intermediate tables in the folder that driver and executors share.

A job that iterates, or reads an intermediate result more than once, writes it as Parquet below ``spark.checkpoint.dir``
and goes on from the file. That cuts the lineage, and a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only when its counted rows, of the given size and ``HASHED_BYTES`` each, stay below this.
BROADCAST_BYTES = 32 << 20
#: What a row takes in the hash table of a broadcast besides its values.
HASHED_BYTES = 64
#: With this Spark removes the shuffle files of a query when it ends, not when the driver's garbage is collected.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_left: list[tuple[SparkSession, str]] = []


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _remove_all() -> None:
    for spark, path in _left:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # the session may have ended before
            pass


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; where it is unset, a new local folder if all runs on this machine, as in
    tests, and an error otherwise."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lorequarry-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows and bytes of the Arrow batches between the JVM and Python, where the session has Spark's own values.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8388608b")}


def bound_batches(spark: SparkSession) -> None:
    """Texts are long rows: batches as large as Spark's own would take most of a small executor's memory."""
    for key, (default, ours) in BATCH.items():
        if spark.conf.get(key, None) == default:
            spark.conf.set(key, ours)


#: Larger allocations of a Python worker are mapped, and unmapped when freed.
MAPPED_BYTES = 1 << 20


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run``, for a function over Arrow batches, in a worker that gives memory back.

    Workers are used again by later tasks. The C library raises the size from which it maps memory as large arrays are
    freed, and from then on keeps theirs in its heap; Arrow's own pool keeps what it has had. An executor with few
    gigabytes would hold the largest need of every stage for good.
    """

    def go(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow

        libc = ctypes.CDLL(None)
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, MAPPED_BYTES)  # M_MMAP_THRESHOLD; setting it keeps it
            libc.mallopt(-8, 2)  # M_ARENA_MAX
        pyarrow.set_memory_pool(pyarrow.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            pyarrow.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return go


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Of queries that are run within, each removes its shuffle files when it ends. A stage runs dozens of queries, and a driver
    with memory to spare would keep the files of all of them on disk."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Workspace:
    """A folder of one operator call. The folder goes when the driver ends, since results are read from it lazily."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        bound_batches(spark)
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _left.append((spark, self.root))

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        with swept(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._path = path
        return out

    def forget(self, *saved: DataFrame) -> None:
        """Removes the files of tables that ``save`` returned and that nothing reads any more."""
        for df in saved:
            _remove(self.spark, df._path)


@contextmanager
def scratch() -> Iterator[None]:
    """Folders of operator calls that are begun within go at its end, when what is read from them has been saved."""
    mark = len(_left)
    yield
    while len(_left) > mark:
        _remove(*_left.pop())


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, marked for broadcast if its counted size is within ``BROADCAST_BYTES``; beyond it the join shuffles.

    ``df`` should be a written table, as it is counted here and read again in the join.
    """
    return F.broadcast(df) if df.count() * (row_bytes + HASHED_BYTES) <= BROADCAST_BYTES else large(df)


def large(df: DataFrame) -> DataFrame:
    """``df``, marked so that its join shuffles both sides.

    Spark sizes a table by its compressed files, and a row as if its texts and arrays had one length, so it would send
    tables through the driver that are many times as large as it takes them to be: after an explode above all.
    """
    return df.hint("merge")


def unused(name: str, *frames: DataFrame) -> str:
    """``name``, or ``name`` with underscores behind it, that none of the frames has as a column in any case."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def plain_names(df: DataFrame, *keep: str) -> DataFrame:
    """``df`` with numbers as the names of all columns but those to keep: Arrow functions take no dotted or odd names."""
    return df.toDF(*[c if c in keep else f"_{i}" for i, c in enumerate(df.columns)])


def nonempty(df: DataFrame) -> bool:
    return len(df.take(1)) > 0
