from __future__ import annotations

import hashlib
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from lorequarry.llm import fim

texts = st.lists(st.sampled_from(["a", "<", "P", ">", "<P", "S>", "<M>", "é", "漢", "😀", "\n", "\\", "$1", "x" * 300, "é" * 200]), max_size=12).map("".join)


def plain(doc_id, text, seed=1):
    t = text or ""
    n, h = len(t), hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, t
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
    return n, "psm", a, b - a, f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}"


@settings(max_examples=300, deadline=None)
@given(st.lists(texts, min_size=1, max_size=6), st.integers(0, 1000))
def test_transform_matches_plain_python(docs, first):
    ids = [first + i for i in range(len(docs))]
    got = fim.transform_texts([t.encode() for t in docs], ids, fim.Settings())
    assert [(*g[:4], g[4].decode()) for g in got] == [plain(i, t) for i, t in zip(ids, docs, strict=True)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=700), min_size=1, max_size=4))
def test_blocks_agree_with_one_state_after_the_other(docs):
    """Also for bytes that are no UTF-8, which begin a unit each where none is due."""
    seen = fim.scan(docs)
    for i, text in enumerate(docs):
        state, begins, sentinel = 0, [], False
        for at, byte in enumerate(text):
            got = int(fim.TABLE[state * 256 + byte])
            state = got & 7
            sentinel |= bool(got & 16)
            if got & 8:
                begins.append(at)
        assert seen.count(i) == len(begins) and seen.has_sentinel[i] == sentinel == any(s in text for s in (b"<P>", b"<S>", b"<M>"))
        units = seen.units[seen.starts[i] : seen.starts[i + 1]]
        assert [fim.locate(text, units, k) for k in range(0, len(begins) + 1, 17)] == [*begins, len(text)][::17]


def test_long_texts_are_scanned_in_linear_time():
    begin = time.process_time()
    for text in ("é" * 4_000_000, "<" * 5_000_000, "<P" * 2_000_000, "😀" * 2_000_000):
        assert fim.transform_texts([text.encode()], [3], fim.Settings())[0][0] == len(text)
    assert time.process_time() - begin < 20


def test_query_round_trip_and_edge_cases(spark):
    rows = [(i, t, "x") for i, t in enumerate([None, "", "one", "é" * 999, "a<P>b", "<", "<S", "line\nbreak $1 \\   x" * 50, "<M" * 400_000, "z" * 3_000_000])]
    rows += [(100 + i, f"word {i} é漢😀 " * 9, "y") for i in range(200)] + [(7, "same id", "z"), (7, "same id", "z"), (None, "no id", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, restored string").repartition(3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = []
    for d, t, _ in rows:
        p = plain(d, t)
        want.append((d, *p[:4], sha(p[4]), sha(t or "")))
    assert sorted(map(tuple, fim.digest(fim.transform(df)).collect()), key=repr) == sorted(want, key=repr)
    back = fim.restore(fim.transform(df)).collect()
    assert sorted(r.restored for r in back) == sorted(t or "" for _, t, _ in rows)
    assert {r.form for r in back} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0
    assert {r.form for r in fim.transform(df, fim.Settings(percent=0)).collect()} == {"plain"}
