from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest

from lorequarry.llm import exactdedup, workspace

SCHEMA = "doc_id long, text string, size string, digit int"


def lower(text):
    return bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())


def plain(docs):
    groups = defaultdict(list)
    for d, t in docs:
        groups[lower(t)].append(d)
    out = []
    for t, ids in groups.items():
        best = max((d for d in ids if d is not None), default=None)
        first = True
        for d in sorted(ids, key=lambda d: d != best):
            out.append((d, best, len(ids), first, hashlib.sha256(t).hexdigest()))
            first = False
    return sorted(out, key=repr)


def found(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exactdedup.exact_groups(df).collect()), key=repr)


def corpus(n=300, seed=3):
    r = random.Random(seed)
    letters = "abCD éßİK "
    stems = ["".join(r.choice(letters) for _ in range(k)) for k in (0, 1, 63, 64, 65, 127, 500, 1087, 1088, 1089, 20_000)]
    docs = []
    for _ in range(n):
        t = r.choice(stems)
        t += r.choice(["", "", "", "x", "X", "é", "É", "y" * 40])
        docs.append(t.swapcase() if r.random() < 0.3 and t.isascii() else t)
    docs += ["", None, "K", "k", "K", "İ", "i̇", "A" * 300_000, "a" * 300_000, "a" * 299_999 + "b", "a" * 300_001]
    ids = list(range(1, len(docs) + 1))
    r.shuffle(ids)
    rows = list(zip(ids, docs, strict=True))
    return rows + rows[:5] + rows[:2] + [(None, docs[0]), (None, "nobody"), (None, "nobody"), (7, "same id, other text")]


@pytest.mark.parametrize("room", [None, 0])
def test_matches_brute_force(spark, monkeypatch, room):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA).repartition(5)
    if room is not None:  # all joins by shuffle, with salts
        monkeypatch.setattr(workspace, "BROADCAST_BYTES", room)
        monkeypatch.setattr(exactdedup, "HOT_ROWS", 4)
        monkeypatch.setattr(exactdedup, "HOT_SHARE", 10)
    assert found(df) == plain(rows)


def test_short_digits_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(exactdedup, "FIRST", 1)
    monkeypatch.setattr(exactdedup, "GROWTH", 2)
    rows = [(i, t) for i, t in enumerate(["é", "è", "e", "ab", "abc", "abd", "ABC", "abcdefgh" * 9, "abcdefgh" * 9 + "i", "ABCDEFGH" * 9, "", None])]
    assert found(spark.createDataFrame(rows, "doc_id int, text string")) == plain(rows)


def test_no_row_and_one_group(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert found(df) == [] and exactdedup.drop_copies(df).count() == 0
    rows = [(i, "The Same text " * 100) for i in range(1000)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_rows_that_stay(spark):
    rows = corpus(80)
    df = spark.createDataFrame([(d, t, f"s{i}", i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, _id string, sha int")
    got = exactdedup.drop_copies(df)
    assert got.columns == df.columns
    want = sorted(((d, s) for d, _, _, kept, s in plain(rows) if kept), key=repr)
    assert sorted(((r.doc_id, hashlib.sha256(lower(r.text)).hexdigest()) for r in got.collect()), key=repr) == want
