"""The subpackage's queries with a SQL twin give its rows, and the guard of the entry point works without the subpackage."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

from lorequarry.llm.queries import ORACLES, QUERIES
from tests.test_queries import TABLES, rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got, want = QUERIES[name](spark, sf).toPandas(), con.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_all_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 14)} and "pipeline" in names


def test_entry_without_the_subpackage(tmp_path):
    import shutil

    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(f"{here}/lorequarry", tmp_path / "lorequarry", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{here}/__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), [q for q in e.queries() if q.startswith('op') or q == 'pipeline'])"], cwd=tmp_path, capture_output=True, text=True, timeout=120, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    n, names = out.stdout.split(" ", 1)
    assert int(n) > 50 and names.strip() == "[]"


def test_models_travel_with_their_functions():
    """Broadcast variables are pickled by reference, which needs the package on the executors; closures are not."""
    from pathlib import Path

    import lorequarry.llm

    for f in Path(lorequarry.llm.__file__).parent.glob("*.py"):
        assert "sparkContext.broadcast" not in f.read_text()
