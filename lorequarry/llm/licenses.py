"""Licence scans by sparse TF-IDF cosine to templates, with inheritance from the nearest ancestor directory.

DataFrame functions only. Lines, paragraphs and whole texts are compared with licence notices. A unit whose cosine with a
template reaches the threshold must share one of the template's heaviest terms, so units without any such term are left
out beforehand without loss. Terms weigh their number in the unit times their inverse document frequency.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .workspace import Workspace, small

#: Least cosine of a match.
MIN_COSINE = 0.6
#: Names of files that license their directory.
LICENSE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|copyright|unlicense)(?:[.-][^/]*)?$"

# Notices by SPDX identifier. A template stands for the terms of a notice, not for its order.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license. See LICENSE file in the project root for full license information.",
        "SPDX-License-Identifier: MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "SPDX-License-Identifier: Apache-2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "GPL-2.0": (
        "This work is licensed under the GNU General Public License, version 2.",
        "SPDX-License-Identifier: GPL-2.0-only",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": ("Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    "AGPL-3.0": ("Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"),
    "BSD-3-Clause": (
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "SPDX-License-Identifier: BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"),
    "Unlicense": ("This is free and unencumbered software released into the public domain.", "SPDX-License-Identifier: Unlicense"),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal public domain dedication.", "SPDX-License-Identifier: CC0-1.0"),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    "LicenseRef-all-rights-reserved": ("All rights reserved.", "Copyright. All rights reserved."),
}

_SPLIT = r"[^\p{L}\p{N}]+"


#: Terms that are joined by broadcast: those in most files, which are few but would each be a hot key.
FREQUENT = 1000


def words(text: Column) -> Column:
    """Words in lower case, in order; letters and digits count."""
    return F.array_remove(F.split(F.lower(text), _SPLIT), "")


def _terms(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _idf(n: int, k: Column) -> Column:
    return F.log((1.0 + n) / (1.0 + k)) + 1.0


def own_licenses(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``files(id, text)`` -> ``id, license, cosine, unit`` of the files with a match, the best one each.

    ``unit`` is ``file`` if the text as a whole matches, else ``paragraph`` or ``line``. Document frequencies of all words
    are counted over all files. Ties go to the larger unit, then to the first template. Rows that share an id are one file.
    """
    spark = files.sparkSession
    ws = Workspace(spark, "licenses")
    table = [(k, name, Counter(_terms(text))) for k, (name, text) in enumerate((name, t) for name, ts in TEMPLATES.items() for t in ts)]
    vocab = sorted({t for _, _, tf in table for t in tf})
    lit_vocab = F.array(*map(F.lit, vocab))
    files = files.where("id is not null and text is not null")
    counts = files.select(F.explode(F.concat(F.array_distinct(words(F.col("text"))), F.array(F.lit("")))).alias("term")).groupBy("term").agg(F.count("*").alias("k"))
    counts = ws.save(counts, "counts")  # the empty term counts the files
    known = {r["term"]: r["k"] for r in counts.where(F.col("term").isin("", *vocab)).collect()}  # as many rows as template terms
    n = known.get("", 0)
    idf = {t: math.log((1 + n) / (1 + known.get(t, 0))) + 1 for t in vocab}
    anchors, rows = set(), []
    for k, name, tf in table:
        w = {t: c * idf[t] for t, c in tf.items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        rows += [(k, name, t, x / norm) for t, x in w.items()]
        # what remains without the anchors is too little for the threshold
        mass = 0.0
        for t in sorted(w, key=lambda t: (-w[t], t)):
            if 1 - mass < (min_cosine - 1e-9) ** 2:
                break
            anchors.add(t)
            mass += (w[t] / norm) ** 2
    lit_anchors = F.array(*map(F.lit, sorted(anchors)))
    weights = spark.createDataFrame(rows, "template int, license string, term string, w double")
    units = F.array(
        F.struct(F.lit(0).alias("kind"), F.array(F.col("text")).alias("parts")),
        F.struct(F.lit(1).alias("kind"), F.split("text", r"\n[ \t\r]*\n").alias("parts")),
        F.struct(F.lit(2).alias("kind"), F.split("text", r"\n").alias("parts")),
    )
    some = files.where(F.arrays_overlap(words(F.col("text")), lit_anchors)).select("id", F.explode(units).alias("u"))
    parts = some.select("id", F.col("u.kind").alias("kind"), F.posexplode("u.parts").alias("no", "part")).select("id", "kind", "no", words(F.col("part")).alias("terms"))
    parts = parts.where(F.arrays_overlap("terms", lit_anchors))
    seen = ws.save(parts.select("id", "kind", "no", F.explode("terms").alias("term")).groupBy("id", "kind", "no", "term").agg(F.count("*").alias("tf")), "terms")
    counts = counts.where("term <> ''")
    frequent = F.broadcast(ws.save(counts.orderBy(F.desc("k"), "term").limit(FREQUENT), "frequent"))
    rare = small(ws.save(counts.join(frequent.select("term"), "term", "left_anti").join(seen.select("term").distinct(), "term", "left_semi"), "rare"), 64)
    seen = seen.join(frequent, "term").unionByName(seen.join(frequent.select("term"), "term", "left_anti").join(rare, "term"))
    x = F.col("tf") * _idf(n, F.col("k"))
    # of a unit at most as many terms as the templates have go on
    unit = seen.groupBy("id", "kind", "no").agg(F.sqrt(F.sum(x * x)).alias("norm"), F.collect_list(F.when(F.array_contains(lit_vocab, F.col("term")), F.struct("term", x.alias("x")))).alias("held"))
    shared = unit.select("id", "kind", "no", "norm", F.explode("held").alias("h")).select("id", "kind", "no", "norm", "h.term", "h.x").join(F.broadcast(weights), "term")
    cosines = shared.groupBy("id", "kind", "no", "template", "license").agg((F.sum(F.col("x") * F.col("w")) / F.first("norm")).alias("cosine"))
    best = cosines.where(F.col("cosine") >= min_cosine).groupBy("id").agg(F.max_by(F.struct("license", "cosine", "kind"), F.struct(F.round("cosine", 9), -F.col("kind"), -F.col("template"), -F.col("no"))).alias("b"))
    unit = F.element_at(F.array(F.lit("file"), F.lit("paragraph"), F.lit("line")), F.col("b.kind") + 1)
    return ws.save(best.select("id", F.col("b.license").alias("license"), F.round("b.cosine", 6).alias("cosine"), unit.alias("unit")), "own")


def directory(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column) -> Column:
    """The folder itself, its parents, and the root as an empty name."""
    parts = F.split(folder, "/")
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))))


def scan(files: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``files(id, path, text)`` -> ``id, path, license, cosine, unit, inherited, inherited_from``, a row per input row.

    A file that matches a template has its own ``license``. A directory is licensed by the files in it that are named as
    licence files, or whose whole text is a notice; of several the best cosine, then the first path, counts. A file
    without a licence of its own takes that of the nearest ancestor directory, if one is licensed. A null path is in no
    directory; a null or empty text has no licence of its own. Rows sharing an id are one file. Other columns are not
    looked at. An empty table gives an empty result.
    """
    ws = Workspace(files.sparkSession, "license-scan")
    own = own_licenses(files.select("id", F.col("text").cast("string")), min_cosine)
    named = ws.save(files.select("id", "path").join(own, "id", "left"), "named")
    names = named.withColumn("folder", directory(F.col("path")))
    licensed = names.where("license is not null and folder is not null").where((F.col("unit") == "file") | F.col("path").rlike(LICENSE_FILE))
    licensed = licensed.groupBy("folder").agg(F.min_by("license", F.struct(-F.col("cosine"), F.col("path"))).alias("inherited")).withColumnRenamed("folder", "up")
    # each folder is resolved once, however many files it has
    folders = names.where("folder is not null").select("folder").distinct().select("folder", F.explode(ancestors(F.col("folder"))).alias("up"))
    nearest = folders.join(licensed, "up").groupBy("folder").agg(F.max_by(F.struct("inherited", "up"), F.length("up")).alias("n"))
    nearest = nearest.select("folder", F.col("n.inherited").alias("inherited"), F.col("n.up").alias("inherited_from"))
    out = names.join(nearest, "folder", "left")
    mine = F.col("license").isNull()
    return out.select("id", "path", "license", "cosine", "unit", F.when(mine, F.col("inherited")).alias("inherited"), F.when(mine, F.col("inherited_from")).alias("inherited_from"))
