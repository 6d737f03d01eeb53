from __future__ import annotations

import math
import re
from collections import Counter

from lorequarry.llm import licenses as lc


def plain(files):
    """TF-IDF cosine of every unit with every template, with no filter beforehand."""
    words = lambda s: Counter(re.findall(r"[^\W_]+", s.lower()))
    table = [(name, words(t)) for name, ts in lc.TEMPLATES.items() for t in ts]
    n, df = len(files), Counter(t for _, x in files for t in set(words(x)))
    vector = lambda tf: {t: c * (math.log((1 + n) / (1 + df[t])) + 1) for t, c in tf.items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    out = {}
    for i, text in files:
        best = None
        for kind, parts in enumerate(([text], re.split(r"\n[ \t\r]*\n", text), text.split("\n"))):
            for no, part in enumerate(parts):
                v = vector(words(part))
                for k, (name, tf) in enumerate(table):
                    w = vector(tf)
                    cos = sum(x * w.get(t, 0) for t, x in v.items()) / (length(v) * length(w)) if v else 0
                    if cos >= lc.MIN_COSINE and (best is None or (round(cos, 9), -kind, -k, -no) > best[0]):
                        best = ((round(cos, 9), -kind, -k, -no), name)
        if best:
            out[i] = best[1], round(best[0][0], 6)
    return out


FILES = [
    (1, "Released under the MIT License."),
    (2, "some header words\nLicensed under the Apache License, Version 2.0.\nmore words follow here"),
    (3, "nothing to see in this text about apples and a license to fish"),
    (4, "intro\n\nThis program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nthe rest"),
    (5, "Copyright (c) 2020 Someone. All rights reserved."),
    (6, "x = 1  # SPDX-License-Identifier: MPL-2.0"),
    (7, "Licensed under CC BY-NC 4.0."),
    (8, ""),
]


def test_matches_brute_force(spark):
    files = [*FILES, (9, "the the the MIT the the license the the"), (10, "Licensed, licensed, licensed under the licensed MIT MIT MIT license\nsee the project"), (11, "Released under the MIT License. Released under the MIT License.")]
    found = {r["id"]: (r["license"], r["cosine"]) for r in lc.own_licenses(spark.createDataFrame(files, "id long, text string")).collect()}
    want = plain(files)
    assert found.keys() == want.keys() and all(found[i][0] == want[i][0] and abs(found[i][1] - want[i][1]) < 2e-6 for i in want)
    got = {i: name for i, (name, _) in found.items()}
    assert got[1] == "MIT" and got[2] == "Apache-2.0" and got[4] == "GPL-3.0" and got[7] == "CC-BY-NC-4.0" and 3 not in got


def test_inheritance_takes_the_nearest_directory(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    rows = [
        (1, "LICENSE", mit),
        (2, "a/b/COPYING.txt", apache + "\nwith some words of the authors that are not a part of the notice at all, and more of them"),
        (3, "a/x.c", "int main"),
        (4, "a/b/y.c", "int main"),
        (5, "a/b/c/d/z.c", "int main"),
        (6, "a/b/own.c", "Licensed under CC BY 4.0."),
        (7, None, "int main"),
        (8, "top.c", None),
        (8, "top.c", None),
        (9, "ab/q.c", ""),
    ]
    got = lc.scan(spark.createDataFrame([(*r, "clash") for r in rows], "id long, path string, text string, license string")).collect()
    by = {r["id"]: (r["license"], r["inherited"], r["inherited_from"]) for r in got}
    assert len(got) == len(rows)
    assert by[3] == (None, "MIT", "") and by[4] == (None, "Apache-2.0", "a/b") and by[5] == (None, "Apache-2.0", "a/b")
    assert by[6][0] == "CC-BY-4.0" and by[6][1] is None
    assert by[7] == (None, None, None) and by[8] == (None, "MIT", "") and by[9] == (None, "MIT", "")
    assert lc.scan(spark.createDataFrame([], "id long, path string, text string")).count() == 0


def test_very_long_text(spark):
    got = lc.own_licenses(spark.createDataFrame([(1, "word\n" * 100_000 + "Released under the MIT License.")], "id long, text string")).collect()
    assert [r["license"] for r in got] == ["MIT"]
