from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest

from lorequarry.llm import linking, neardup, sketching
from lorequarry.llm.components import connected_components
from lorequarry.llm.workspace import Workspace


def plain_sets(docs, width):
    out = {}
    for d, t in docs:
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in (t or "").encode()).split()
        if len(w) >= width:
            out[d] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
        else:
            out[d] = {tuple(w)} if w else set()
    return out


def plain_components(docs, width, percent):
    sets = plain_sets(docs, width)
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sets, 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return sets, {d: find(d) for d in sets}


def corpus(seed=1):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for g in range(30):
        base = [r.choice(words) for _ in range(r.choice([5, 40, 120]))]
        for _ in range(r.choice([1, 2, 6])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(words)
            docs.append(" ".join(w))
    # a group whose members are alike by degrees, so that no single member is near all others
    chain = [r.choice(words) for _ in range(150)]
    for i in range(60):
        chain[r.randrange(150)] = f"x{i}"
        docs.append(" ".join(chain))
    docs += ["", None, "   \n", "One", "one", "one two", "A b C", "a B c", "a b c", docs[0]]
    return list(enumerate(docs, 1))


@pytest.mark.parametrize("settings", [neardup.CONTRACT, neardup.Settings()])
def test_matches_brute_force(spark, settings):
    docs = corpus()
    got = {r["doc_id"]: r for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), settings).collect()}
    sets, comp = plain_components(docs, settings.width, settings.percent)
    assert len(got) == len(docs)
    for d, _ in docs:
        assert got[d]["n_shingles"] == len(sets[d])
        assert got[d]["component_id"] == comp[d]
        assert got[d]["kept"] == (comp[d] == d)


def test_large_group_of_near_copies(spark):
    """More items than a block, alike by degrees: the components are those of all pairs."""
    r = random.Random(5)
    base = [f"b{i}" for i in range(60)]
    docs = []
    for i in range(linking.BLOCK + 150):
        w = list(base)
        for _ in range(r.choice([1, 2, 3, 5])):
            w[r.randrange(60)] = f"n{i}_{r.randrange(3)}"
        docs.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), neardup.CONTRACT).collect()}
    _, comp = plain_components(docs, 3, 85)
    assert got == comp


def test_edge_cases(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_one(empty).count() == 0
    rows = [(1, "same text for all of these rows here", "x"), (1, "same text for all of these rows here", "x"), (None, "same text for all of these rows here", "x"), (2, "same text for all of these rows here", "y"), (3, None, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string")
    got = neardup.near_duplicates(docs).collect()
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in got) == [(0, True), (1, True), (1, True), (2, False), (3, True)]
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3]


def test_very_long_text(spark):
    text = " ".join(f"w{i}" for i in range(200_000))
    got = neardup.near_duplicates(spark.createDataFrame([(1, text), (2, text + " end")], "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {1} and {r["n_shingles"] for r in got} == {199_996, 199_997}


def test_odd_sketch_estimates_high_similarity():
    rng = np.random.default_rng(1)
    for share in (0.8, 0.9, 0.97):
        n = 2000
        a = rng.integers(0, 1 << 32, n, dtype=np.uint32)
        b = a.copy()
        change = int(n * (1 - share) / (1 + share))
        b[:change] = rng.integers(0, 1 << 32, change, dtype=np.uint32)
        sig = sketching.minhash(np.concatenate([a, b]), np.array([0, n]), 192)
        s = sketching.odd_sketch(sig, 512)
        bits = int(sketching.xor_counts(s[:1], s[1:])[0, 0])
        assert abs(sketching.estimate(bits, 192, 512) - share) < 0.08
        assert bits <= sketching.most_bits(share, 192, 512)


def test_word_hashes_follow_ascii_white_space():
    words, bounds = sketching.word_hashes([b"A b\tc\x0bd", "a b".encode(), b"", b"  ", b"a"])
    assert np.diff(bounds).tolist() == [4, 1, 0, 0, 1]
    assert words[0] == words[-1] and len(set(words.tolist())) == 5


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 200)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(150)] + [(5, 5)]
    got = {x["node"]: x["component"] for x in connected_components(Workspace(spark, "t"), spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    assert got == {n: find(n) for n in up if find(n) != n or any(find(m) == n and m != n for m in up)}


def test_clashing_column_names_and_no_broadcast(spark, monkeypatch):
    from lorequarry.llm import workspace

    monkeypatch.setattr(workspace, "BROADCAST_BYTES", 0)
    text = "one two three four five six seven eight nine ten eleven twelve"
    names = ["_lost", "_lost_", "id", "digest", "component_id", "kept", "bands"]
    df = spark.createDataFrame([(i, text if i < 3 else "something wholly different from that one", *["q"] * len(names)) for i in range(1, 4)] + [(None, text, *["q"] * len(names))], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = neardup.keep_one(df)
    assert out.columns == df.columns and sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 3]
    assert neardup.near_duplicates(df).columns == ["doc_id", "n_shingles", "component_id", "kept"]


def test_hostile_text(spark):
    rows = [(1, "a " * 2_500_000), (2, "a" * 5_000_000), (3, " " * 5_000_000), (4, " ".join(map(str, range(700_000)))), (5, " ".join(map(str, range(699_990))))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (0, 3), 4: (699_996, 4), 5: (699_986, 4)}
