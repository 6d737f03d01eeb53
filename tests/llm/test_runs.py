from __future__ import annotations

import hashlib
import time
import zlib
from fractions import Fraction

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from lorequarry.llm import runs


def plain_runs(w, least=24, periods=3):
    """Every period from the smallest, every stretch; a stretch that a smaller period has is not a run of this one."""
    found = {}
    for p in range(1, len(w) // periods + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, periods * p):
                found.setdefault((i, j + p), p)
            i = j
    return sorted((a, b - a, p) for (a, b), p in found.items())


def plain(doc_id, text, planted=10):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if planted and h % planted == 0 and n:
        g = h // planted
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    drop = {i for s, length, p in found for i in range(s + p, s + length)}
    best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
    sha = lambda b: hashlib.sha256(b).hexdigest()
    milli = best[0] if best[0] is None else 1000 * best[1] // best[2]
    return (doc_id, len(found), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()), sha(b" ".join(x for i, x in enumerate(w) if i not in drop)))


@st.composite
def sequences(draw):
    out = []
    for _ in range(draw(st.integers(1, 4))):
        unit = draw(st.lists(st.integers(0, 2), min_size=1, max_size=9))
        out += unit * draw(st.integers(1, 14)) + unit[: draw(st.integers(0, len(unit)))]
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(sequences(), min_size=1, max_size=4))
def test_runs_match_brute_force(docs):
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    s = runs.Settings()
    assert runs.runs(np.array(sum(docs, []), np.int64), bounds, s) == [plain_runs(d) for d in docs]


@settings(max_examples=100, deadline=None)
@given(st.lists(sequences(), min_size=1, max_size=3))
def test_words_decide_where_hashes_lie(docs):
    """With a hash of a few values nearly every answer is wrong, and the runs are the same."""
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    before = runs._PRIME
    runs._PRIME = np.uint64(3)
    try:
        assert runs.runs(np.array(sum(docs, []), np.int64), bounds, runs.Settings()) == [plain_runs(d) for d in docs]
    finally:
        runs._PRIME = before


def test_small_steps_and_slices_give_the_same(monkeypatch):
    monkeypatch.setattr(runs, "STEP", 7)
    monkeypatch.setattr(runs, "SLICE", 5)
    vocabulary = {}
    ids = runs.words(b"  a b\tc\n" * 20 + b"x" * 30 + "é ü ".encode() * 30, vocabulary)
    assert [list(vocabulary)[i] for i in ids] == (b"a b c " * 20 + b"x" * 30 + "é ü ".encode() * 30).split()
    assert runs.runs(ids, np.array([0, len(ids)]), runs.Settings()) == [plain_runs(ids.tolist())]


def test_long_and_hostile_texts():
    begin = time.process_time()
    bits = [bin(i).count("1") & 1 for i in range(1 << 16)]
    for ids in ([0] * 300_000, [0, 1] * 100_000, bits, list(range(300_000))):
        got = runs.runs(np.array(ids, np.int64), np.array([0, len(ids)]), runs.Settings())[0]
        assert len(got) == (1 if len(set(ids)) <= 2 and ids is not bits else 0)
    assert time.process_time() - begin < 60


def test_query_matches_brute_force(spark):
    r = np.random.default_rng(5)
    rows = [(1, None, "x"), (2, "", "y"), (3, " \n", "z"), (4, "a " * 24, "z"), (5, "a " * 23, "z"), (6, "a b " * 12 + "a", "z")]
    for i in range(7, 200):
        w = [f"w{x}" for x in r.integers(0, r.integers(1, 40) + 1, r.integers(0, 120))]
        rows.append((i, " ".join(w + w[-r.integers(1, 20) :] * int(r.integers(0, 6))), "q"))
    rows += [rows[50], rows[50], (None, "b " * 30, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").repartition(3)
    got = sorted(map(tuple, runs.digest(runs.find(df, runs.CONTRACT)).collect()), key=repr)
    want = [plain(d, t) for d, t, _ in rows[:-1]]
    none = list(plain("", "b " * 30))
    none[0] = None
    assert got == sorted([*want, tuple(none)], key=repr)
    assert runs.find(df.limit(0)).count() == 0
    assert all(x.runs == [] or x.strongest in x.runs for x in runs.find(df).collect())
