from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.functions import text as fx
from lorequarry.operators import discovery, elements, graph, providers, review, similarity, tagging


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column).first()[0]


# --- functions


def test_text_functions(spark):
    assert one(spark, fx.strip(F.col("t")), t=" \t x y\n　") == "x y"
    assert one(spark, fx.clean_heading(F.col("t")), t="Chapter 8: 1.2 Expert Witnesses") == "Expert Witnesses"
    assert one(spark, fx.slugify(F.col("t")), t="--My Corpus, No. 1!") == "my-corpus-no-1"
    assert one(spark, fx.escape_html(F.col("t")), t="<a & 'b\">") == "&lt;a &amp; &#x27;b&quot;&gt;"
    assert one(spark, fx.sentences(F.col("t")), t="One is here. Two? no split. Three!  Four") == ["One is here.", "Two? no split.", "Three!", "Four"]
    assert one(spark, fx.has_transition(F.col("t")), t="  however, this") and not one(spark, fx.has_transition(F.col("t")), t="But, this")
    assert one(spark, fx.is_jurisdictional(F.col("t")), t="It varies by state.") and not one(spark, fx.is_jurisdictional(F.col("t")), t="a state of mind")
    assert one(spark, fx.type_label(F.col("t")), t="procedural_rule") == "Procedural Rules" and one(spark, fx.type_label(F.col("t")), t="odd_kind") == "Odd Kind"
    assert one(spark, fx.unit_type(F.col("t")), t=" Pitfall ") == "pitfall" and one(spark, fx.unit_type(F.col("t")), t="poem") == "advice"
    assert one(spark, fx.first_words(F.col("t")), t="a bb ccc dd e ff") == "a bb ccc dd e" and len(one(spark, fx.first_words(F.col("t")), t="x" * 90)) == 60
    assert one(spark, fx.window_of(F.col("t"), F.lit(2), F.lit(4), 3), t="abcdefghij") == "abcdefg"
    assert one(spark, fx.edited_label(F.col("e"), F.col("l")), e="", l="x") == "x"
    assert one(spark, fx.heading_trail(F.col("t"), F.lit(30)), t="# A\n## B\n## C\ntext\n# D\n## E\nhere") == ["D", "E"]


@pytest.mark.parametrize(("score", "depth", "expected"), [(0.8, 0, 0.8), (0.8, 1, 0.56), (0.6, 0, 0.42), (0.35, 0, 0.175), (0.35, 1, None), (0.2, 0, None)])
def test_heading_confidence(spark, score, depth, expected):
    got = one(spark, fx.heading_confidence(F.col("s"), fx.proximity_weight(F.col("d")), F.col("d")), s=score, d=depth)
    assert got == (None if expected is None else pytest.approx(expected, abs=1e-9))


# --- elements


def test_markdown_elements(spark):
    text = "# Title\n\nFirst line\nsecond line\n- item\n  * other\n3. third\ncontinued\n\n## Sub\nlast"
    got = elements.markdown_elements(spark.createDataFrame([("f", text)], "file_path string, text string")).orderBy("seq").collect()
    assert [(r["element_type"], r["text"], r["level"]) for r in got] == [
        ("heading", "Title", 1), ("paragraph", "First line\nsecond line", 0), ("list_item", "item", 0), ("list_item", "other", 0),
        ("list_item", "third", 0), ("paragraph", "continued", 0), ("heading", "Sub", 2), ("paragraph", "last", 0),
    ]


def loop_paths(rows):
    stack, out = [], []
    for level, text in rows:
        if level:
            while stack and stack[-1][0] >= level:
                stack.pop()
            stack.append((level, text))
        out.append([t for _, t in stack])
    return out


@pytest.mark.parametrize("seed", range(3))
def test_section_paths_against_a_stack(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice([0, 0, 1, 2, 3, 4, 6]), f"t{i}") for i in range(60)]
    df = spark.createDataFrame([("f", i, t, lv) for i, (lv, t) in enumerate(rows)], "file_path string, seq int, text string, level int")
    got = [x["section_path"] for x in elements.section_paths(df).orderBy("seq").collect()]
    assert got == loop_paths(rows)


def test_boundaries_and_units(spark):
    rows = [("f", 0, "Heading", "heading", 1), ("f", 1, "A plain paragraph of text.", "paragraph", 0), ("f", 2, "However, this one turns.", "paragraph", 0), ("f", 3, "list entry one", "list_item", 0), ("f", 4, "part one is here\n\n  part two is here\n\nhowever, three", "paragraph", 0), ("f", 5, "short", "paragraph", 0)]
    e = spark.createDataFrame(rows, "file_path string, seq int, text string, element_type string, level int")
    b = elements.structural_boundaries(elements.char_offsets(elements.section_paths(e)))
    got = b.orderBy("seq", "part").collect()
    assert [(r["confidence"], r["method"]) for r in got] == [
        (1.0, "structural_heading"), (0.7, "structural_paragraph"), (0.8, "structural_transition"), (0.9, "structural_list"),
        (0.7, "structural_paragraph_break"), (0.7, "structural_paragraph_break"), (0.8, "structural_transition"), (0.7, "structural_paragraph"),
    ]
    whole = "\n".join(r[2] for r in rows)
    assert all(whole[r["start"] : r["end"]] == r["text"] for r in got)
    u = elements.knowledge_units(b).orderBy("ord").collect()
    assert [r["text"] for r in u] == [r["text"] for r in got if r["method"] != "structural_heading" and len(r["text"]) >= 10]
    assert len({r["id"] for r in u}) == len(u) and u[0]["lineage"][0]["action"] == "split"


def test_semantic_split(spark):
    v = [[1.0, 0.0, 0.0], [0.9, 0.1, 0.0], [0.0, 0.0, 1.0], [0.0, 0.1, 0.9]]
    df = spark.createDataFrame([(1, i, f"s{i}", x) for i, x in enumerate(v)] + [(2, 0, "a", v[0]), (2, 1, "b", v[1])], "paragraph int, no int, text string, embedding array<double>")
    assert [(r["paragraph"], r["text"]) for r in elements.semantic_splits(df).orderBy("segment").collect()] == [(1, "s0 s1"), (1, "s2 s3")]


def test_model_segments(spark):
    reply = '{"boundaries": [{"start": -3, "end": 10}, {"start": 10, "end": 99}, {"start": 5, "end": 5}]}'
    df = spark.createDataFrame([("f", 0, 0, 100, "0123456789abcdefghij", [12], reply), ("f", 1, 0, 0, "x", [], "nonsense")], "file_path string, seq int, part int, start long, text string, candidates array<long>, reply string")
    got = elements.model_segments(df).orderBy("start").collect()
    assert [(r["start"], r["end"], r["text"], r["confidence"]) for r in got] == [(100, 110, "0123456789", 0.85), (110, 120, "abcdefghij", 0.85)]


# --- similarity


def test_exact_dedup(spark):
    rows = [(1, "a", 0.5, "h1"), (2, "b", 0.9, "h1"), (3, "c", 0.9, "h1"), (4, "d", 0.1, "h2"), (5, "e", 0.1, None), (6, "f", 0.2, None)]
    got = similarity.exact_dedup(spark.createDataFrame(rows, "ord long, id string, confidence double, content_hash string")).orderBy("ord").collect()
    assert [(r["ord"], r["id"], r["cross_references"], r["merged"]) for r in got] == [(1, "b", ["c", "a"], 2), (4, "d", [], 0), (5, "e", [], 0), (6, "f", [], 0)]


def loop_near_dedup(conf, pairs):
    n, into = len(conf), {}
    for i in range(n):
        if i in into:
            continue
        for j in range(i + 1, n):
            if j in into or (i, j) not in pairs:
                continue
            stays, goes = (i, j) if conf[i] >= conf[j] else (j, i)
            into[goes] = stays
    return into


@pytest.mark.parametrize("seed", range(3))
def test_near_dedup_replays_the_loop(spark, seed):
    r = random.Random(seed)
    conf = [r.choice([0.2, 0.5, 0.9]) for _ in range(40)]
    pairs = {tuple(sorted(r.sample(range(40), 2))) for _ in range(45)}
    units = spark.createDataFrame([(i, c) for i, c in enumerate(conf)], "ord long, confidence double")
    got = {x["ord"]: x["canonical"] for x in similarity.replay_near_dedup(spark.createDataFrame(list(pairs), "a long, b long"), units).collect()}
    assert got == loop_near_dedup(conf, pairs)


def test_similar_pairs_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 16)
    rng = np.random.default_rng(1)
    m = rng.standard_normal((150, 6))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<double>")
    want = {(i, j) for i in range(150) for j in range(i + 1, 150) if m[i] @ m[j] > 0.85}
    assert {(r["a"], r["b"]) for r in similarity.similar_pairs(df, 0.85).collect()} == want
    found = {(r["a"], r["b"]) for r in similarity.bucketed_pairs(df, 0.85).collect()}
    assert found <= want and len(found) >= 0.95 * len(want)


def test_bucketed_pairs_query_finds_all_pairs_at_its_threshold(spark):
    from lorequarry.plans.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    i, j = np.nonzero(m @ m.T > 0.45)
    want = {(a, b) for a, b in zip(ids[i].tolist(), ids[j].tolist(), strict=True) if a < b}
    assert len(want) > 10
    assert {(r["a"], r["b"]) for r in QUERIES["bucketed_pairs"](spark, sf).collect()} == want


def test_buckets_follow_from_the_threshold(spark):
    for t, n in ((0.85, 10**6), (0.7, 10**8), (0.95, 10**5)):
        tables, bits = similarity.bucket_plan(t, n, 1e-6)
        assert (1 - (1 - np.arccos(t) / np.pi) ** bits) ** tables <= 1e-6
    assert similarity.bucket_plan(0.45, 10_000, 1e-6) is None
    rng = np.random.default_rng(2)
    m = np.repeat(rng.standard_normal((300, 16)), 2, axis=0) + 0.1 * rng.standard_normal((600, 16))
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<double>")
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if m[i] @ m[j] > 0.9}
    tables, bits = similarity.bucket_plan(0.9, 10**6, 1e-6)
    assert len(want) > 200 and {(r["a"], r["b"]) for r in similarity.bucketed_pairs(df, 0.9, tables, bits).collect()} == want


def test_pairs_of_many_string_keys(spark):
    df = spark.range(1300).selectExpr("format_string('k%05d', id) AS id", "array(cos(id / 100D), sin(id / 100D)) AS embedding")
    want = {(f"k{i:05d}", f"k{j:05d}") for i in range(1300) for j in range(i + 1, 1300) if np.cos((j - i) / 100) > 0.9999}
    assert {(r["a"], r["b"]) for r in similarity.similar_pairs(df, 0.9999).collect()} == want
    assert similarity.similar_pairs(df.where("id = 'k00000'"), 0.9999).count() == 0


@pytest.mark.parametrize("block", [3, 1024])
def test_nearest(spark, block):
    rng = np.random.default_rng(6)
    v, c = np.round(rng.standard_normal((700, 3)), 1), np.round(rng.standard_normal((20, 3)), 1)
    c[7] = c[3] = c[15]  # ties go to the lower ord
    rows = spark.createDataFrame([(f"r{i}", x.tolist()) for i, x in enumerate(v)] + [("none", None)], "id string, v array<double>")
    centres = spark.createDataFrame([(f"c{i}", 100 - i, x.tolist()) for i, x in enumerate(c)] + [("none", 0, None)], "centre string, ord long, cv array<double>")
    got = {(r["id"], r["rank"]): r["centre"] for r in similarity.nearest(rows, centres, 4, block).collect()}
    s = np.round(v @ c.T, 12)
    want = {(f"r{i}", n + 1): f"c{j}" for i in range(700) for n, j in enumerate(sorted(range(20), key=lambda j: (-s[i, j], 100 - j))[:4])}
    assert got == want
    far = spark.createDataFrame([(2**60 + 1, [1.0])], "id long, v array<double>")
    assert similarity.nearest(far, far.selectExpr("id + 1 AS centre", "id AS ord", "v AS cv")).first()[:2] == (2**60 + 1, 2**60 + 2)
    assert similarity.nearest(rows, centres.where("false")).count() == 0 == similarity.nearest(rows.where("false"), centres).count()


def global_linkage(m, t):
    d = 1 - m @ m.T
    groups = [[i] for i in range(len(m))]
    while len(groups) > 1:
        best = min(((np.mean([d[i, j] for i in a for j in b]), x, y) for x, a in enumerate(groups) for y, b in enumerate(groups) if x < y), key=lambda z: z[0])
        if not best[0] < t:
            break
        groups[best[1]] += groups.pop(best[2])
    return {frozenset(g) for g in groups}


def test_average_linkage(spark):
    rng = np.random.default_rng(4)
    m = np.vstack([rng.standard_normal(8) + 0.5 * rng.standard_normal((7, 8)) for _ in range(4)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<double>")
    groups = {}
    for r in similarity.cluster(df, 0.5).collect():
        groups.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(g) for g in groups.values()} == global_linkage(m, 0.5)


def clusters(df, *args, **kw):
    groups = {}
    for r in similarity.cluster(df, *args, **kw).collect():
        groups.setdefault(r["cluster"], set()).add(r["id"])
    assert all(c == min(g) for c, g in groups.items())
    return {frozenset(g) for g in groups.values()}


@pytest.mark.parametrize(("seed", "threshold"), [(0, 0.3), (2, 0.9)])
def test_linkage_in_rounds_is_that_of_one_task(spark, seed, threshold):
    rng = np.random.default_rng(seed)
    m = np.vstack([rng.standard_normal(6) + 0.7 * rng.standard_normal((k, 6)) for k in (20, 9, 5, 3, 1, 1)])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<double>")
    want = global_linkage(m, threshold)
    assert clusters(df, threshold, block=9) == want == clusters(df, threshold)


def test_linkage_of_copies_ties_and_rows_without_a_vector(spark):
    rows = [(f"c{i:02d}", [3.0, 4.0, 0.0]) for i in range(40)]  # one node
    rows += [("n", None), ("z", [0.0, 0.0, 0.0])]
    schema = "id string, embedding array<double>"
    same = {frozenset(f"c{i:02d}" for i in range(40)), frozenset(["n"]), frozenset(["z"])}
    assert clusters(spark.createDataFrame(rows, schema), 0.5, block=1) == clusters(spark.createDataFrame(rows, schema), 0.5) == same
    # every two of these are equally far apart: about half find each other in a round
    far = [(f"t{i}", [1.0] + [2.0 * (i == j) for j in range(9)]) for i in range(9)]
    assert clusters(spark.createDataFrame(far, schema), 0.85, block=2) == {frozenset(x[0] for x in far)}
    assert clusters(spark.createDataFrame(far, schema), 0.75, block=2) == {frozenset([x[0]]) for x in far}
    assert clusters(spark.createDataFrame([], schema)) == set()


# --- tagging


def loop_reconcile(paths):
    out = []

    def new(c, p):
        r = {"iri": c["iri"], "label": c["label"], "c": c["confidence"], "p": [p]}
        out.append(r)
        return r

    def boost(r, by, p):
        r["c"] = min(1.0, r["c"] + by)
        if p not in r["p"]:
            r["p"].append(p)

    for c in paths["ruler"]:
        new(c, "entity_ruler")
    for c in paths["llm"]:
        hit = next((r for r in out if c["iri"] and r["iri"] == c["iri"]), None)
        boost(hit, 0.05, "llm") if hit else new(c, "llm")
    for name, path, by in (("semantic", "semantic", 0.1), ("heading", "heading_context", 0.05)):
        for c in paths[name]:
            hit = None
            for r in out:
                if c["iri"] and r["iri"] == c["iri"]:
                    hit = r
            if hit is None:
                for r in out:
                    if c["label"] and r["label"].lower() == c["label"].lower():
                        hit = r
            boost(hit, by, path) if hit else new(c, path)
    return [(r["iri"], r["label"], round(r["c"], 9), r["p"]) for r in out]


@pytest.mark.parametrize("seed", range(3))
def test_reconcile_against_the_loop(spark, seed):
    r = random.Random(seed)
    rows, want = [], {}
    for i in range(12):
        paths = {p: [{"iri": r.choice(["", "a", "b", "c"]), "label": r.choice(["X", "x", "Y", "Z"]), "confidence": r.choice([0.3, 0.72, 0.97])} for _ in range(r.randrange(4))] for p in ("ruler", "llm", "semantic", "heading")}
        want[i] = loop_reconcile(paths)
        rows.append((i, *[[(k, c["iri"], c["label"], c["confidence"], "") for k, c in enumerate(paths[p])] or None for p in ("ruler", "llm", "semantic", "heading")]))
    kind = "array<struct<pos:int,iri:string,label:string,confidence:double,branch:string>>"
    df = spark.createDataFrame(rows, f"id int, ruler {kind}, llm {kind}, semantic {kind}, heading {kind}")
    for x in tagging.reconcile(df).collect():
        assert [(c["iri"], c["label"], round(c["confidence"], 9), c["contributing_paths"]) for c in x["concepts"]] == want[x["id"]]


def test_ruler_and_label_search(spark):
    concepts = spark.createDataFrame([("c1", "Expert Witness", "B"), ("c2", "witness", "B"), ("c3", "Cross-Examination", "B")], "iri string, label string, branch string")
    units = spark.createDataFrame([("u", "The expert  witness faced cross examination; Expert witness.")], "id string, text string")
    assert {r["iri"] for r in tagging.ruler(units, concepts).collect()} == {"c1", "c2", "c3"}
    heads = spark.createDataFrame([("u", ["Chapter 3: Trials", "Expert Witnesses"])], "id string, section_path array<string>")
    got = tagging.heading_concepts(heads, concepts).collect()
    assert [(r["iri"], r["pos"]) for r in got] == [("c1", 0)]


def test_label_resolution(spark):
    t = spark.createDataFrame([("u", 0, "", "known", 0.5, ["llm"], ""), ("u", 1, "", "weak", 0.5, ["llm"], ""), ("u", 2, "x", "own", 0.5, ["entity_ruler", "llm"], "")], "id string, pos int, iri string, label string, confidence double, contributing_paths array<string>, branch string")
    m = spark.createDataFrame([("known", "k", "Known", "B", 0.6), ("weak", "w", "Weak", "B", 0.59)], "label string, match_iri string, match_label string, match_branch string, score double")
    got = {r["pos"]: (r["iri"], r["label"], r["extraction_path"]) for r in tagging.resolve(t, m).collect()}
    assert got == {0: ("k", "Known", "llm"), 1: ("", "weak", "proposed_class"), 2: ("x", "own", "entity_ruler")}


# --- discovery


def test_cluster_candidates(spark):
    units = spark.createDataFrame([(i, f"u{i}", f"text number {i} " + "x" * i, "f") for i in range(10)], "ord long, id string, text string, source_file string")
    clusters = spark.createDataFrame([(f"u{i}", 0 if i < 4 else 1 if i < 8 else 2) for i in range(10)], "id string, cluster int")
    covered = spark.createDataFrame([(f"u{i}",) for i in (0, 1, 2)], "id string")
    got = discovery.cluster_candidates(units, clusters, covered).collect()
    assert [(r["unit_ids"], r["confidence"]) for r in got] == [(["u4", "u5", "u6", "u7"], 0.3)]


def test_depths_with_cycles_and_missing_parents(spark):
    t = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("x", "y"), ("y", "x"), ("z", "x")], "task_id string, parent_task_id string")
    assert {r["task_id"]: r["depth"] for r in discovery.depths(t).collect()} == {"a": 0, "b": 1, "c": 2, "d": 0, "x": None, "y": None, "z": None}


def test_settle_and_apply_merges(spark):
    m = spark.createDataFrame([(0, 1, 1, "a", "b"), (0, 1, 2, "a", "c"), (1, 1, 1, "c", "d"), (1, 2, 1, "e", "a"), (1, 3, 1, "e", "f")], "stage int, first long, ord long, canonical string, merged string")
    got = {(r["canonical"], r["merged"]) for r in discovery.settle_merges(m).collect()}
    assert got == {("a", "b"), ("a", "c"), ("e", "a"), ("e", "f")}
    tasks = spark.createDataFrame([("a", None), ("b", None), ("k", "b")], "task_id string, parent_task_id string")
    links = spark.createDataFrame([("a", "u1"), ("b", "u1"), ("b", "u2")], "task_id string, unit_id string")
    t, l = discovery.apply_merges(tasks, links, spark.createDataFrame([("a", "b")], "canonical string, merged string"))
    assert {tuple(r) for r in l.collect()} == {("a", "u1"), ("a", "u2")}
    assert {(r["task_id"], r["parent_task_id"]) for r in t.collect()} == {("a", None), ("k", "a")}


def test_concept_parents(spark):
    t = spark.createDataFrame([("t1", 1, "i1"), ("t2", 2, "i2"), ("t3", 3, "i3")], "task_id string, ord long, iri string")
    c = spark.createDataFrame([("i3", ["none", "i2", "i1"]), ("i2", ["i2", "i1"])], "iri string, parent_iris array<string>")
    assert {r["task_id"]: r["parent_task_id"] for r in discovery.concept_parents(t, c).collect()} == {"t3": "t2", "t2": "t1"}


def test_procedural_order(spark):
    t = spark.createDataFrame([("p", None, "P"), ("a", "p", "First step"), ("b", "p", "Second")], "task_id string, parent_task_id string, label string")
    o = spark.createDataFrame([("p", ["second", " FIRST STEP "])], "parent_task_id string, labels array<string>")
    got = {r["task_id"]: (r["is_procedural"], r["canonical_order"]) for r in discovery.procedural_order(t, o).collect()}
    assert got == {"p": (True, None), "a": (False, 1), "b": (False, 0)}


# --- review


def test_review_log(spark):
    log = spark.createDataFrame([("u", 1, "edited", "new text", 1), ("u", 2, "approved", None, 2), ("v", 1, "rejected", None, 3)], "id string, at int, status string, edited_text string, event_id int")
    assert {r["id"]: r["status"] for r in review.latest(log, ["id"], "at", "event_id").collect()} == {"u": "approved", "v": "rejected"}
    known = review.latest_known(log, "id", ["status", "edited_text"], "at", "event_id").where("id = 'u'").first()
    assert (known["status"], known["edited_text"]) == ("approved", "new text")
    with pytest.raises(ValueError):
        review.bulk_approve(log, F.lit(None))


def test_upserts(spark):
    old = spark.createDataFrame([("a", "L", "approved"), ("b", "M", "unreviewed")], "task_id string, label string, status string")
    new = spark.createDataFrame([("a", "L2", "unreviewed"), ("c", "N", "unreviewed")], "task_id string, label string, status string")
    got = {tuple(r) for r in review.upsert(old, new, ["task_id"], ["label"]).collect()}
    assert got == {("a", "L2", "approved"), ("b", "M", "unreviewed"), ("c", "N", "unreviewed")}
    assert {tuple(r) for r in review.insert_ignore(old, new, ["task_id"]).collect()} == {("a", "L", "approved"), ("b", "M", "unreviewed"), ("c", "N", "unreviewed")}
    reg = spark.createDataFrame([("e1", "x", None)], "entity_id string, iri string, deprecated_at timestamp")
    grown = review.iri_registry(reg, spark.createDataFrame([("e1",), ("e2",), ("e2",)], "entity_id string"), "https://n/")
    assert grown.count() == 2 and review.iri_collisions(grown).count() == 0
    t, l = review.merge_task(old, spark.createDataFrame([("a", "u"), ("b", "u"), ("a", "w")], "task_id string, unit_id string"), "a", "b")
    assert t.count() == 1 and {tuple(r) for r in l.collect()} == {("b", "u"), ("b", "w")}


# --- graph


def graph_of(spark):
    tasks = spark.createDataFrame([("t1", "Root & <b>", "https://example.org/modules/knowledge/t1", None, True, 1), ("t2", "Child", "https://example.org/modules/knowledge/t2", "t1", False, 2)], "task_id string, label string, iri string, parent_task_id string, is_procedural boolean, ord int")
    units = spark.createDataFrame([(1, "u1", "https://example.org/modules/knowledge/u1", "x" * 150, "principle", 0.9, 0.4, "f"), (2, "u2", None, "no iri", "pitfall", 0.5, None, "f"), (3, "u3", "https://example.org/modules/knowledge/u3", 'q"\n', "advice", None, None, None)], "ord int, id string, iri string, text string, unit_type string, confidence double, novelty double, source_file string")
    links = spark.createDataFrame([("t1", "u1"), ("t2", "u1"), ("t1", "u2"), ("t2", "u3"), ("t2", "gone")], "task_id string, unit_id string")
    return tasks, links, units


def test_triples(spark):
    t = graph.triples(*graph_of(spark), spark.createDataFrame([("t1", "u1", "u2", None, None)], "task_id string, unit_id_a string, unit_id_b string, contradiction_type string, resolution string"))
    rows = {(r["s"].rpartition("/")[2], r["p"].replace("#", "/").rpartition("/")[2], r["o"]) for r in t.collect()}
    m = graph.MODULE
    assert ("u1", "type", f"{m}/t1") in rows and ("u1", "type", f"{m}/t2") in rows and ("u1", "label", "x" * 100) in rows
    assert ("t1", "pitfall", "no iri") in rows and not any(s == "u2" for s, _, _ in rows)
    assert ("t2", "subClassOf", f"{m}/t1") in rows and ("t1", "isProcedural", "true") in rows
    assert ("t1", "contradictionNote", "Contradiction between u1 and u2 (type: unknown, resolution: unresolved)") in rows
    assert t.count() == t.distinct().count()
    assert any(r["value"] == f'<{m}/u3> <{graph.SKOS}note> "q\\"\\n" .' for r in graph.ntriples(t).collect())


def test_validation(spark):
    t = graph.triples(*graph_of(spark))
    assert graph.validate(t, graph.MODULE + "/").count() == 0
    extra = spark.createDataFrame([("https://example.org/modules/knowledge/c", graph.RDF + "type", graph.OWL + "Class", "iri", ""), ("https://example.org/modules/knowledge/c", graph.RDF + "type", graph.OWL + "NamedIndividual", "iri", ""), ("https://example.org/modules/knowledge/c", graph.RDFS + "seeAlso", "https://example.org/modules/knowledge/none", "iri", ""), ("https://example.org/modules/knowledge/c", graph.RDFS + "seeAlso", "https://example.org/modules/knowledge/", "iri", "")], t.schema)
    assert sorted(r["rule"] for r in graph.validate(t.union(extra), graph.MODULE + "/").collect()) == ["class_and_individual", "class_without_label", "dangling_reference", "individual_without_provenance"]


def test_diff_and_changelog(spark):
    tasks, links, units = graph_of(spark)
    before = graph.triples(tasks.where("task_id = 't1'").withColumn("label", F.lit("Old")), links, units)
    d = graph.graph_diff(before, graph.triples(tasks, links, units))
    got = {(r["s"].rpartition("/")[2], r["change"]) for r in d.where("kind = 'class'").collect()}
    assert got == {("t1", "changed"), ("t2", "added")}
    assert graph.changelog(d)[:4] == ["- 1 added", "- 0 removed", "- 1 changed", "- 0 unchanged"]


def test_outline_and_jsonld(spark):
    import json

    tasks, links, units = graph_of(spark)
    lines = [r["value"] for r in graph.outline_lines(tasks, links, units).orderBy("sort").collect()]
    assert lines == [
        "- **Root & <b>** (procedural -- ordered steps)", "  - *Principles*:", f"    - {'x' * 150} (confidence: 0.90)", "  - *Pitfalls*:", "    - no iri (confidence: 0.50)",
        "  - **Child**", "    - *Principles*:", f"      - {'x' * 150} (confidence: 0.90)", "    - *Advice*:", '      - q" (confidence: 0.00)',
    ]
    chunk = [json.loads(r["value"]) for r in graph.jsonld_chunks(tasks, links, units).collect()]
    assert len(chunk) == 1 and chunk[0]["rdfs:label"] == "Root & <b>" and [u["fi:unitType"] for u in chunk[0]["fi:units"]] == ["principle", "pitfall"]
    assert chunk[0]["fi:subtasks"] == [{"@id": "https://example.org/modules/knowledge/t2", "rdfs:label": "Child"}]
    assert graph.nested([{"task_id": "a", "parent_task_id": None}, {"task_id": "b", "parent_task_id": "a"}, {"task_id": "c", "parent_task_id": "?"}], False)[0]["children"][0]["task_id"] == "b"


# --- providers


def test_providers_fail_softly(spark):
    units = spark.createDataFrame([("a", "You must file within 10 days."), ("b", "See Smith, 410 U.S. 113 (1973)."), ("c", "Avoid this mistake.")], "id string, text string")
    got = {r["id"]: r["unit_type"] for r in providers.classify(units).collect()}
    assert got == {"a": "procedural_rule", "b": "citation", "c": "pitfall"}

    def broken(rows):
        raise RuntimeError("no model")

    assert {(r["id"], r["text"]) for r in providers.distill(units, broken).collect()} == {(r["id"], r["text"]) for r in units.collect()}
    assert {r["unit_type"] for r in providers.classify(units, broken).collect()} == {"advice", "citation"}
    assert {r["surprise_score"] for r in providers.novelty(units, lambda rows: [{"score": 7.0} for _ in rows]).collect()} == {1.0}
    assert providers.route("distill", {"LLM_DISTILL_MODEL": "m"}, ("p", "d")) == ("p", "m")


def test_deep_trees_and_long_labels(spark):
    n = 67
    t = spark.createDataFrame([(f"t{i}", f"t{i - 1}" if i else None) for i in range(n)], "task_id string, parent_task_id string")
    assert {r["task_id"]: r["depth"] for r in discovery.depths(t).collect()} == {f"t{i}": i for i in range(n)}
    e = spark.createDataFrame([(f"t{i}", f"t{i - 1}") for i in range(1, n)] + [("t0", f"t{n - 1}")], "id string, depends_on string")
    got = {r["id"]: r["hops"] for r in review.dependents(e, spark.createDataFrame([("t0",)], "id string")).collect()}
    assert got == {f"t{i}": i for i in range(1, n)}
    concepts = spark.createDataFrame([("c", "Duty to preserve all of the relevant evidence", "b")], "iri string, label string, branch string")
    units = spark.createDataFrame([("u", "the duty to preserve all of the relevant evidence holds")], "id string, text string")
    assert [r["iri"] for r in tagging.ruler(units, concepts).collect()] == ["c"]


def test_nested_tree_and_serializations(spark):
    import json
    import re
    from xml.etree import ElementTree

    from lorequarry.operators import graph

    rows = [("a", "A", "i/a", None, 2), ("b", "B", "i/b", "a", 4), ("c", "C", "i/c", "a", 3), ("d", 'D "q"', "i/d", "c", 1), ("e", "E", "i/e", None, 1), ("x", "X", "i/x", "missing", 5)] + [(f"k{i}", "K", "i/k", f"k{i - 1}" if i else "e", 9) for i in range(70)]
    tasks = spark.createDataFrame(rows, "task_id string, label string, iri string, parent_task_id string, ord long")
    got = [json.loads(r["value"]) for r in graph.tree_json(tasks).orderBy("ord").collect()]
    assert [g["task_id"] for g in got] == ["e", "a"]
    assert [c["task_id"] for c in got[1]["children"]] == ["c", "b"] and got[1]["children"][0]["children"][0]["label"] == 'D "q"'
    depth, node = 0, got[0]
    while node["children"]:
        depth, node = depth + 1, node["children"][0]
    assert depth == 70
    assert graph.tree_json(tasks.limit(0)).count() == 0
    t = spark.createDataFrame([("https://x.org/a b", graph.RDFS + "label", 'a "quoted" <text> & more\n', "literal", ""), ("https://x.org/a b", graph.RDF + "type", graph.OWL + "Class", "iri", ""), (graph.MODULE + "/T1", graph.MODULE + "/confidence", "0.5", "literal", graph.XSD + "float"), (graph.MODULE + "/T1", graph.SKOS + "related", graph.MODULE + "/T2", "iri", "")], "s string, p string, o string, kind string, datatype string")
    ttl = {r["s"]: r["value"] for r in graph.turtle(t).collect()}
    assert ttl["https://x.org/a b"] == '<https://x.org/a b> a owl:Class ;\n    rdfs:label "a \\"quoted\\" <text> & more\\n" .'
    assert ttl[graph.MODULE + "/T1"] == f'fi:T1 fi:confidence "0.5"^^<{graph.XSD}float> ;\n    skos:related fi:T2 .'
    xml = graph.rdfxml_head() + "\n".join(r["value"] for r in graph.rdfxml(t).collect()) + "</rdf:RDF>"
    root = ElementTree.fromstring(xml)
    assert {x.text for d in root for x in d if x.text} == {'a "quoted" <text> & more\n', "0.5"} and sum(len(d) for d in root) == 4
    assert not re.search(r"ns\d+:", xml)
    imported = graph.triples(tasks.withColumn("is_procedural", F.lit(None).cast("boolean")), spark.createDataFrame([], "task_id string, unit_id string"), spark.createDataFrame([], "id string, iri string, text string, unit_type string, confidence double, novelty double, source_file string"), imports=("https://y.org/o",))
    assert imported.where(F.col("p") == graph.OWL + "imports").first()["o"] == "https://y.org/o"


def test_tasks_made_by_hand_and_lookups(spark):
    from lorequarry.operators import review

    tasks = spark.createDataFrame([("a", "A", None, 2), ("b", "B", "a", None)], "task_id string, label string, parent_task_id string, canonical_order int")
    log = spark.createDataFrame([], "task_id string, action string, detail string, at timestamp")
    new = spark.createDataFrame([("b", "B2", None, None), ("c", "C", "a", 1)], tasks.schema)
    after, seen = review.create_task(tasks, log, new, F.lit("2024-01-01").cast("timestamp"))
    assert {r["task_id"]: r["label"] for r in after.collect()} == {"a": "A", "b": "B", "c": "C"}
    assert [(r["task_id"], r["action"]) for r in seen.collect()] == [("c", "create")]
    assert [r["task_id"] for r in review.in_canonical_order(after).where("parent_task_id = 'a'").orderBy("place").collect()] == ["b", "c"]
    assert review.lookup(after, "task_id", "c")["label"] == "C"
    with pytest.raises(KeyError):
        review.lookup(after, "task_id", "z")


def test_dictionary_finds_long_labels(spark):
    from lorequarry.operators import tagging

    label = "one two three four five six seven eight nine ten"
    units = spark.createDataFrame([(1, f"x {label.upper()}, and one two"), (2, "one two three"), (3, None)], "id int, text string")
    concepts = spark.createDataFrame([("c1", label, ""), ("c2", "One Two", ""), ("c3", "and", "")], "iri string, label string, branch string")
    got = {(r["id"], r["iri"], r["pos"]) for r in tagging.ruler(units, concepts).collect()}
    assert got == {(1, "c1", 1), (1, "c2", 1), (1, "c3", 11), (2, "c2", 0)}
    assert {(r["id"], r["iri"]) for r in tagging.ruler(units, concepts, 2).collect()} == {(1, "c2"), (1, "c3"), (2, "c2")}


def test_pairs_of_a_large_task_are_listed_once(spark, monkeypatch):
    monkeypatch.setattr(discovery, "PAIR_BLOCK", 7)
    links = spark.createDataFrame([("big", f"u{i:02d}") for i in range(40)] + [("small", "u01"), ("small", "u02"), ("one", "u03"), ("none", "missing")], "task_id string, unit_id string")
    units = spark.createDataFrame([(f"u{i:02d}", i) for i in range(40)], "id string, ord int")
    got = [(r["task_id"], r["a"], r["b"]) for r in discovery.unit_pairs(links, units).collect()]
    want = {("big", f"u{i:02d}", f"u{j:02d}") for i in range(40) for j in range(i + 1, 40)} | {("small", "u01", "u02")}
    assert len(got) == len(want) and set(got) == want


def _linked(spark):
    tasks = spark.createDataFrame([(f"t{i}", f"T{i}", f"x/t{i}", None, False, i) for i in range(40)], "task_id string, label string, iri string, parent_task_id string, is_procedural boolean, ord long")
    units = spark.createDataFrame([("u1", "x/u1", "long text", "principle", 0.5, None, "f", 1), ("u2", None, "long text", "principle", 0.5, None, "f", 2), ("u3", None, None, "pitfall", 0.5, None, "f", 3)], "id string, iri string, text string, unit_type string, confidence double, novelty double, source_file string, ord long")
    return tasks, tasks.crossJoin(units.select(F.col("id").alias("unit_id"))).select("task_id", "unit_id"), units


def test_what_a_unit_says_is_said_once_however_many_tasks_it_has(spark, monkeypatch):
    tasks, links, units = _linked(spark)
    rows, real = [], graph._said
    monkeypatch.setattr(graph, "_said", lambda r, *x: rows.append(r) or real(r, *x))
    t = graph.triples(tasks, links, units).collect()
    assert max(r.count() for r in rows if "text" in r.columns) <= 3
    assert len(t) == len(set(t)) and sum(r["p"].endswith("/principle") for r in t) == 40  # two units, one text
    assert sum(r["p"].endswith("/pitfall") and r["o"] is None for r in t) == 40
    assert sum(r["s"] == "x/u1" for r in t) == 1 + 40 + 6


def test_a_graph_is_made_once_for_all_rules(spark, monkeypatch):
    tasks, links, units = _linked(spark)
    kept, real = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: kept.append(df) or real(df))
    t = graph.triples(tasks, links, units)
    assert graph.validate(t.where("s <> 'x/t1'"), "x/").collect() == [("dangling_reference", "x/u1")]
    assert len(kept) == 1 and not kept[0].where("kind <> 'iri' and o is not null").count()


@pytest.mark.parametrize("made", [lambda t, l, u: graph.outline_lines(t, l, u), lambda t, l, u: discovery.centroid_texts(l, u, 2)])
def test_no_window_has_texts(spark, made):
    df = made(*_linked(spark))
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = [i for i, x in enumerate(plan) if "Window [" in x]
    assert at and not any("text#" in plan[i] or "text#" in plan[i + 1] for i in at)
    assert df.where("value like '%long text (conf%'" if "value" in df.columns else "text = 'long text long text'").count() == (80 if "value" in df.columns else 40)


def test_equal_headings_are_compared_once(spark):
    heads = spark.createDataFrame([(i, 0, "1.2 Duty of care") for i in range(50)] + [(1, 0, "Duty")], "id int, depth int, text string")
    concepts = spark.createDataFrame([("b", "Duty of Care", "x"), ("a", "duty of care", "y"), ("c", "of", "z")], "iri string, label string, branch string")
    found = tagging.label_search(heads, concepts)
    assert {tuple(r) for r in found.collect()} == {(i, 0, "a", "duty of care", "y", 1.0) for i in range(50)}
    assert "levenshtein" not in found._jdf.queryExecution().optimizedPlan().toString()  # what was found is joined, not made again


@pytest.mark.parametrize("n, dims, blocks", [(10, 64, 1), (10_000, 64, 5), (51_282, 64, 8), (615_384, 64, 19), (615_384, 768, 226)])
def test_blocks_grow_with_the_vectors_up_to_what_a_task_holds(n, dims, blocks):
    assert -(-n // similarity.block_rows(n, dims)) == blocks


def test_pairs_are_found_once(spark, monkeypatch):
    """Merges and near-duplicates are read by components and by what follows."""
    for module, run, rows in (
        (discovery, discovery.settle_merges, [(0, 1, 2, "a", "b"), (0, 1, 3, "b", "c")]),
        (similarity, lambda p: similarity.replay_near_dedup(p, spark.range(4).selectExpr("id as ord", "0.5 as confidence")), [(1, 2), (2, 3)]),
    ):
        seen, real = spark.sparkContext.accumulator(0), module.cut
        kind = "stage int, first int, ord int, canonical string, merged string" if len(rows[0]) == 5 else "a long, b long"

        def counted(batches, seen=seen):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        run(spark.createDataFrame(rows, kind).mapInArrow(counted, kind)).collect()
        assert seen.value == len(rows)
