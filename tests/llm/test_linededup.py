from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from lorequarry.llm import linededup, linking, workspace


def plain(docs, width=7, percent=80):
    lines = [(d, i, x.strip().lower()) for d, t in docs if d is not None for i, x in enumerate((t or "").split("\n")) if x.strip()]
    keys = sorted({k for _, _, k in lines})
    sets = {k: {k[i : i + width] for i in range(max(1, len(k) - width + 1))} for k in keys}
    up = {k: k for k in keys}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(keys, 2):
        i = len(sets[a] & sets[b])
        if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            up[find(a)] = find(b)
    first = {}
    for d, i, k in sorted(lines):
        first.setdefault(find(k), (d, i))
    return {(d, i) for d, i, k in lines if first[find(k)] != (d, i)}


def corpus():
    r = random.Random(4)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta", "iota", "kappa", "Ärger", "ñandú"]
    base = [" ".join(r.choice(words) for _ in range(r.choice([1, 8, 20]))) for _ in range(25)]
    docs = []
    for d in range(40):
        lines = []
        for _ in range(r.randrange(1, 9)):
            x = r.choice(base)
            if r.random() < 0.5:
                at = r.randrange(len(x))
                x = x[:at] + r.choice("xyz") + x[at + 1 :]
            lines.append(r.choice(["", "  "]) + x.upper() if r.random() < 0.2 else x)
        docs.append((d, "\n".join(lines)))
    return docs


@pytest.mark.parametrize("broadcast", [True, False])
def test_matches_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:  # the plans for tables that are too large for that, and for lines that stand in most documents
        monkeypatch.setattr(workspace, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(linededup, "HOT_TIMES", 2)
    docs = corpus()
    _, removed = linededup.decide(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {(r["doc_id"], r["line_no"]) for r in removed.collect()} == plain(docs)


def test_texts_lose_exactly_those_lines(spark):
    docs = corpus()
    gone = plain(docs)
    df = spark.createDataFrame([(d, t, "src", len(t)) for d, t in docs], "doc_id long, text string, lines string, n_chars long")
    out = linededup.dedup(df).collect()
    assert len(out) == len(docs)
    for r in out:
        expected = "\n".join(x for i, x in enumerate(dict(docs)[r["doc_id"]].split("\n")) if (r["doc_id"], i) not in gone)
        assert r["text"] == (expected if expected.strip() else "")
        assert r["n_chars"] == len(r["text"]) and r["n_removed"] == sum(d == r["doc_id"] for d, _ in gone)


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert linededup.dedup(empty).count() == 0
    rows = [(1, "a line that is here twice\n\nother words altogether"), (2, "a line that is here twice"), (2, "a line that is here twice"), (None, "a line that is here twice"), (3, None), (4, ""), (5, "x" * 300_000 + "\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"] or 0, r["text"], r["n_removed"]) for r in linededup.dedup(df).collect()), key=repr)
    assert (1, rows[0][1], 0) in got and got.count((2, "", 1)) == 2
    assert (0, rows[3][1], 0) in got and (3, None, 0) in got and (4, "", 0) in got and (5, rows[6][1], 0) in got
    assert sorted((r["doc_id"] or 0) for r in linededup.dedup(df, drop_empty=True).collect()) == [0, 1, 3, 4, 5]


def test_clashing_column_names(spark):
    names = ["id", "bands", "lines", "_doc", "_doc_", "n_lines", "N_Removed", "sketch", "a b", "x.y"]
    rows = [(i, "first line of text", *[f"{n}{i}" for n in names]) for i in (1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = linededup.dedup(df)
    rest = [n for n in names if n.lower() not in ("n_lines", "n_removed")]
    assert out.columns == ["doc_id", "text", *rest, "n_lines", "n_removed"]
    assert {(r["doc_id"], r["id"], r["lines"], r["_doc"], r["x.y"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()} == {(1, "id1", "lines1", "_doc1", "x.y1", "first line of text", 1, 0), (2, "id2", "lines2", "_doc2", "x.y2", "", 1, 1)}
    bare = linededup.dedup(df, counts=False)
    assert bare.columns == df.columns and {(r["n_lines"], r["N_Removed"], r["text"]) for r in bare.collect()} == {("n_lines1", "N_Removed1", "first line of text"), ("n_lines2", "N_Removed2", "")}


def test_unlike_lines_of_one_id_are_not_removed(spark, monkeypatch):
    """Half of the hash is the id; lines that agree in it alone stay."""
    real = linededup.line_digest
    monkeypatch.setattr(linededup, "line_digest", lambda key: b"\1" * 8 + real(key)[8:])
    docs = [(1, "alpha beta gamma\nsomething else"), (2, "alpha beta gamma\nand a third one"), (3, "something else")]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1] == docs[0][1] and "and a third one" in got[2]


def test_sets_of_lines_match_python():
    r = random.Random(7)
    keys = ["".join(r.choice("abcdeéß日") for _ in range(r.randrange(1, 60))) for _ in range(300)] + ["a", "a\0", "ab" * 50]
    sets = [{k[i : i + 7] for i in range(max(1, len(k) - 6))} for k in keys]
    flat, counts = linededup.expand([k.encode() for k in keys], 7)
    pairs = ([(i, j) for i in range(0, 303, 3) for j in range(i, 303, 40)] + [(300, 301), (301, 301)])[-linking.STEP_PAIRS :]
    both, union = linking.common_elements(flat, counts, *np.array(pairs).T)
    assert both.tolist() == [len(sets[i] & sets[j]) for i, j in pairs] and union.tolist() == [len(sets[i] | sets[j]) for i, j in pairs]
    common, sizes = linking.intersections(flat, counts)
    assert sizes.tolist() == [len(x) for x in sets]
    assert all(common[i, j] == len(sets[i] & sets[j]) for i, j in pairs if i != j)


def test_hostile_text(spark):
    import time

    rows = [(1, "x" * 5_000_000), (2, "\n" * 2_500_000), (3, "ab\n" * 1_000_000), (4, "a b c d e f g h " * 300_000)]
    start = time.time()
    got = {r["doc_id"]: len(r["text"]) for r in linededup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == 5_000_000 and got[3] < 1_000_100 and time.time() - start < 120


def test_documents_without_listed_lines_are_not_shuffled(spark):
    docs = spark.range(-500, 3500).selectExpr("id AS doc_id", "concat('text ', id) AS text").unionByName(spark.sql("SELECT CAST(NULL AS bigint) AS doc_id, 'none' AS text"))
    listed = spark.range(-500, 3500, 100).selectExpr("id AS doc")
    marked = linededup._maybe(docs, listed, 40, "maybe")
    passed = [r.doc_id for r in marked.where("maybe").collect()]
    assert marked.columns == ["doc_id", "text", "maybe"] and marked.count() == 4001
    assert set(range(-500, 3500, 100)) <= set(passed) and len(passed) < 800 and None not in passed
