"""Versioned tables, and runs of stages that are resumed where they ended.

A stage is a written table. Its fingerprint covers its name, its parameters and the fingerprints of its inputs, so it
changes with everything that it depends on. A stage whose last version has the fingerprint is not run again: a run that was
killed goes on from its last finished stage, and after a change only what lies downstream of it is run.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Part of every fingerprint; raised when stages begin to compute something else.
FORMAT = 1
_MARK = "_stage.json"


class Store:
    """Versioned tables of one corpus, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, *parts: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _versions(self, name: str) -> list[int]:
        p, fs = self._path(name)
        if not fs.exists(p):
            return []
        out = []
        for s in fs.listStatus(p):
            n = s.getPath().getName()
            if n.startswith("v=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")):
                out.append(int(n[2:]))
        return sorted(out)

    def has(self, name: str) -> bool:
        return bool(self._versions(name))

    def read(self, name: str, schema: str | None = None, back: int = 0) -> DataFrame | None:
        """The last version, or the one ``back`` before it; an empty table if there is none and a schema is given."""
        v = self._versions(name)
        if len(v) > back:
            return self.version(name, v[-1 - back])
        return self.spark.createDataFrame([], schema) if schema else None

    def version(self, name: str, n: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/v={n}")

    def write(self, name: str, df: DataFrame) -> DataFrame:
        n = max(self._versions(name), default=-1) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={n}")
        return self.version(name, n)

    def last(self, name: str) -> int | None:
        return max(self._versions(name), default=None)

    def mark(self, name: str, n: int, what: dict) -> None:
        """Notes beside a version. They are written after it, so a version without them is one that nobody vouches for."""
        p, fs = self._path(name, f"v={n}", _MARK)
        out = fs.create(p, True)
        try:
            out.write(bytearray(json.dumps(what).encode()))
        finally:
            out.close()

    def marked(self, name: str, n: int | None) -> dict:
        if n is None:
            return {}
        p, fs = self._path(name, f"v={n}", _MARK)
        if not fs.exists(p):
            return {}
        stream = fs.open(p)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()


def name_of(model: Callable | None) -> str:
    """Models count by their names: what they compute can't be seen."""
    return "" if model is None else f"{getattr(model, '__module__', '')}.{getattr(model, '__qualname__', type(model).__name__)}"


class Run:
    """One run over a store. The stage ``last`` ends it and vouches for the tables that the next run builds upon.

    ``progress`` is told (stage, state, share of ``of`` stages) with state ``skipped``, ``started`` or ``finished``. The table ``stages``
    of the log has a row for each.
    """

    def __init__(self, store: Store, kind: str, last: str, progress: Callable[[str, str, float], None] | None = None, of: int = 1):
        self.store, self.kind, self.last, self.of = store, kind, last, of
        self.progress = progress or (lambda *_: None)
        self.prints: dict[str, str] = {}
        self.made: dict[str, int] = {}
        self.took: list[tuple[str, str, float]] = []
        self.committed: dict[str, int] = store.marked(last, store.last(last)).get("made", {})

    def given(self, name: str, what: object) -> str:
        """An input that is no stage, by anything that says whether it is the same."""
        self.prints[name] = hashlib.sha256(json.dumps([FORMAT, name, what], default=str).encode()).hexdigest()
        return name

    def table(self, name: str, df: DataFrame | None) -> str:
        """An input table by its rows, whatever their order; it should be small."""
        if df is None:
            return self.given(name, None)
        row = F.xxhash64(F.to_json(F.struct(*df.columns)))
        r = df.agg(F.count("*"), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1 << 40)))).first()
        return self.given(name, [df.schema.simpleString(), *r])

    def base(self, name: str, schema: str | None = None) -> DataFrame | None:
        """The table that a stage of the same name builds upon: its last version, but for what runs of this kind wrote and
        none of them has vouched for."""
        fit = None
        for n in reversed(self.store._versions(name)):
            mark = self.store.marked(name, n)
            if mark.get("kind") != self.kind or n <= self.committed.get(name, -1):
                fit = n
                break
        self.given(f"base:{name}", [fit, self.store.marked(name, fit).get("print")])
        if fit is not None:
            return self.store.version(name, fit)
        return self.store.spark.createDataFrame([], schema) if schema else None

    def stage(self, name: str, build: Callable[[], DataFrame], inputs: Sequence[str] = (), *parameters: object) -> DataFrame:
        """The written table ``name``: the last version if it has the stage's fingerprint, else what ``build`` gives."""
        text = json.dumps([FORMAT, self.kind, name, [self.prints[i] for i in inputs], parameters], default=str)
        self.prints[name] = print_ = hashlib.sha256(text.encode()).hexdigest()
        n = self.store.last(name)
        if self.store.marked(name, n).get("print") == print_:
            self._tell(name, "skipped", 0.0)
        else:
            begin = time.monotonic()
            self.progress(name, "started", len(self.made) / self.of)
            self.store.write(name, build())
            n = self.store.last(name)
            self.made[name] = n
            self.store.mark(name, n, {"print": print_, "kind": self.kind} | ({"made": self.made} if name == self.last else {}))
            self._tell(name, "finished", time.monotonic() - begin)
        self.made[name] = n
        return self.store.version(name, n)

    def _tell(self, name: str, state: str, seconds: float) -> None:
        self.took.append((name, state, seconds))
        self.progress(name, state, min(1.0, len(self.took) / self.of))
