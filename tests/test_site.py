"""The browsable site: every link leads to a page, long lists go on, and files appear all at once."""

from __future__ import annotations

import json
import os
import re

import pytest
from pyspark.sql import functions as F

from lorequarry.operators import lineage, site
from lorequarry.sources import named_files

TASK = "task_id string, label string, parent_task_id string, ord long, is_procedural boolean, has_contradictions boolean, jurisdiction_sensitive boolean"


def small(spark):
    tasks = [("a", "A & <b>", None, 1, False, True, False), ("b", "Second", None, 2, True, False, False), ("c", "Below", "a", 3, False, False, True), ("d", "Deep", "c", 4, None, None, None), ("x", "Lost", "nobody", 5, False, False, False)]
    tasks += [(f"k{i:03}", f"Child {i}", "b", 10 + i, False, False, False) for i in range(450)]
    units = [(f"u{i}", f" text <{i}> ", "advice" if i % 2 else "pitfall", 0.5, i) for i in range(10)]
    links = [("d", f"u{i}") for i in range(10)] + [("a", "u1"), ("a", "missing"), ("x", "u2")]
    return spark.createDataFrame(tasks, TASK), spark.createDataFrame(links, "task_id string, unit_id string"), spark.createDataFrame(units, "id string, text string, unit_type string, confidence double, ord long")


def test_pages_and_links(spark, tmp_path):
    made = site.pages(*small(spark), title="My tasks")
    root = f"{tmp_path}/out"
    named_files.write(spark, made, f"file://{root}")
    found = {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, fs in os.walk(root) for f in fs if not f.startswith(("_", "."))}
    assert int(open(f"{root}/_SUCCESS").read()) == len(found) == made.count()
    for path, text in found.items():
        for target in re.findall(r'href="([^"]*)"', text):
            assert os.path.normpath(os.path.join(os.path.dirname(path), target)) in found, (path, target)
    by_title = {}
    for path, text in found.items():
        if path.endswith(".html"):
            by_title.setdefault(re.search(r"<title>(.*?)</title>", text)[1], []).append(text)
    assert len(by_title["Second"]) == 3 and sum(t.count("<li>") for t in by_title["Second"]) == 450 and "<ol>" in by_title["Second"][0]
    assert "Lost" not in by_title and "A &amp; &lt;b&gt;" in by_title and "contradictions" in by_title["A &amp; &lt;b&gt;"][0]
    deep = by_title["Deep"][0]
    assert re.findall(r">([^<>]+)</a>", deep) == ["My tasks", "A &amp; &lt;b&gt;", "Below", "Below", "Second"]  # the way, then the neighbours
    assert deep.count("<li>") == 10 and "text &lt;3&gt; <small>" in deep
    entries = [e for i in range(int(found["search/count.json"])) for e in json.loads(found[f"search/{i}.json"])]
    assert len(entries) == 454 and all(e["path"] in found for e in entries)
    assert site.page_links(made).where("not found").count() == 0


def test_texts_are_neither_numbered_nor_written(spark, monkeypatch):
    """A text is listed by every task it is linked to; only keys are put in order and kept."""
    written = []
    monkeypatch.setattr(site, "cut", lambda df: written.append(set(df.columns)) or lineage.cut(df))
    monkeypatch.setattr(lineage, "cut", lambda df, real=lineage.cut: written.append(set(df.columns)) or real(df))
    made = site.pages(*small(spark))
    seen = site.scanned(made)
    assert len(written) >= 2 and not any(c & {"text", "note", "content", "li"} for c in written)
    assert {r["items"] for r in seen.where("path not like 'search/%'").collect()} >= {0, 10, 50, 200}
    assert sorted(map(tuple, site.page_links(seen).collect())) == sorted(map(tuple, site.page_links(made).collect()))


def test_an_empty_tree(spark):
    t, l, u = small(spark)
    assert {r["path"]: r["content"] for r in site.pages(t.limit(0), l, u).collect()}.keys() == {"index.html", "search/count.json"}


def test_files_appear_all_at_once_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}/out"
    rows = spark.range(50).select(F.concat(F.lit("a/"), F.col("id").cast("string"), F.lit(".txt")).alias("path"), F.col("id").cast("string").alias("content"))
    named_files.write(spark, rows.repartition(4), root)
    assert len(os.listdir(tmp_path / "out/a")) == 50
    with pytest.raises(Exception, match="outside"):
        named_files.write(spark, rows.unionByName(spark.createDataFrame([("../x", "y")], "path string, content string")), root)
    assert sorted(os.listdir(tmp_path)) == ["out"] and len(os.listdir(tmp_path / "out/a")) == 50
    named_files.write(spark, rows.limit(3), root)
    assert sorted(os.listdir(tmp_path)) == ["out"] and len(os.listdir(tmp_path / "out/a")) == 3
