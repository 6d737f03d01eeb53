from __future__ import annotations

import corpus_pipeline
from lorequarry.llm import mixing
from lorequarry.llm.workspace import Workspace
from tests.llm.test_linededup import plain as plain_lines
from tests.llm.test_neardup import plain_components


def test_stages_against_plain_versions(spark):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_duplicates", "decontamination", "mixing"]
    ws = Workspace(spark, "test-pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    steps = {"": docs}
    for name, f in corpus_pipeline.STAGES:
        docs = steps[name] = ws.save(f(spark, docs, sf), name)
    rows = {n: {r["doc_id"]: r.asDict() for r in d.collect()} for n, d in steps.items()}
    for n in list(steps)[:-1]:
        assert steps[n].columns == steps[""].columns
    # language: clean documents stay as they are
    assert len(rows["language"]) >= 0.97 * len(rows[""]) and all(rows[""][d] == r for d, r in rows["language"].items())
    # lines
    gone = plain_lines([(d, r["text"]) for d, r in rows["language"].items()])
    want = {}
    for d, r in rows["language"].items():
        lines = r["text"].split("\n")
        kept = "\n".join(x for i, x in enumerate(lines) if (d, i) not in gone)
        if kept.strip() or not any((d, i) in gone for i in range(len(lines))):
            want[d] = kept
    assert {d: r["text"] for d, r in rows["lines"].items()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows["lines"].values())
    # near-duplicates
    _, comp = plain_components([(d, r["text"]) for d, r in rows["lines"].items()], 5, 80)
    assert set(rows["near_duplicates"]) == {d for d, c in comp.items() if c == d}
    # decontamination: what holds an item as it is goes
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    left = {d for d, r in rows["near_duplicates"].items() if not any(t in r["text"] for t in items)}
    assert set(rows["decontamination"]) <= left and len(left) - len(rows["decontamination"]) <= 0.05 * len(left) + 2
    # mixing
    assert set(rows["mixing"]) == set(rows["decontamination"])
    assert all(r["size"] == len(rows["decontamination"][d]["text"].split()) for d, r in rows["mixing"].items())
    assert all(r["taken"] <= mixing.MAX_EPOCHS * r["size"] for r in rows["mixing"].values())


def test_stages_bear_any_table(spark):
    """Nulls in any column, empty and repeated rows, ties, an empty table, and columns whose names are used inside."""
    names = ["lines", "_lost", "_doc", "n_lines", "n_removed", "id", "view", "size", "name", "key", "component_id", "score", "x.y", "a b"]
    prose = "the quick brown fox jumps over the lazy dog and runs on to the other side of the hill"
    german = "der schnelle braune fuchs springt über den faulen hund und läuft weiter auf die andere seite"
    rows = [(i, f"{prose} number {i}\nthe same last line of all of them" if i % 2 else f"{german} nummer {i}", "en" if i % 2 else "de", "web", 80) for i in range(1, 41)]
    rows += [rows[0], rows[0], (None, prose, None, None, None), (51, None, "en", None, 1), (52, "", None, "web", None), (53, "12 34", "en", "web", 5), (54, prose, "en", None, None), (55, prose, None, "web", 3)]
    df = spark.createDataFrame([(*r, *["q"] * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names))
    sf = "/root/testdata/sf0.001"
    for name, f in corpus_pipeline.STAGES:
        got = f(spark, df, sf)
        if name != "mixing":
            assert got.columns == df.columns
        ids = sorted((r["doc_id"] or 0) for r in got.collect())
        if name == "language":  # without a letter, or without a text, no language can be told
            assert ids.count(1) == 3 and not {51, 52, 53} & set(ids)
        if name == "lines":  # 54 and 55 have only a line that is like one of document 1; empty texts had nothing to lose
            assert 1 in ids and not {54, 55} & set(ids) and {51, 52, 53} <= set(ids) and 0 in ids
        if name == "near_duplicates":  # a document is there once, rows without an id stay
            assert ids.count(1) == 1 and ids.count(0) == 1 and 54 in ids and 55 not in ids and {51, 52, 53} <= set(ids)
        if name == "decontamination":
            assert len(ids) == len(rows)
        if name == "mixing":
            assert len(ids) == len(rows)
        empty = f(spark, df.limit(0), sf)
        assert empty.columns == got.columns and empty.count() == 0


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 0 and "taken" in got.columns
