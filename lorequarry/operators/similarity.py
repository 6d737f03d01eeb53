"""Exact and near duplicates of units, similarity joins, nearest neighbours and clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as fx
from .lineage import cut

#: Vectors that are linked in one task.
BLOCK = 2048
#: Blocks of a blockwise similarity join: numbers of one of them, and how few of them are still made smaller for more tasks.
BLOCK_NUMBERS, FEW_BLOCKS = 1 << 21, 8
#: Centres of a block in a nearest-centre join.
CENTRES = 1024
#: Buckets pay if they compare fewer than this share of all pairs: a joined pair costs about 100 times one of a matrix product.
BUCKETS_PAY = 0.01


def exact_dedup(units: DataFrame) -> DataFrame:
    """``units(ord, id, confidence, content_hash, ...)``: of equal hashes the most confident stays, the first of equals.

    The others' ids become its ``cross_references``, best first, and ``merged`` counts them. ``ord`` is that of the first
    of the group. A null hash is no hash: its unit stays alone.
    """
    key = F.coalesce("content_hash", "id")
    best = Window.partitionBy("_key").orderBy(F.desc("confidence"), "ord")
    every = Window.partitionBy("_key")
    u = units.withColumn("_key", key).withColumn("_n", F.row_number().over(best)).withColumn("_first", F.min("ord").over(every))
    # only groups of copies need their members gathered
    copies = u.where("_n > 1").groupBy("_key").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "id"))), lambda x: x["id"]).alias("cross_references"), F.count("*").alias("merged"))
    kept = u.where("_n = 1").drop("cross_references").join(copies, "_key", "left")
    none = F.array().cast("array<string>")
    return kept.withColumn("ord", F.col("_first")).withColumn("cross_references", F.coalesce("cross_references", none)).withColumn("merged", F.coalesce("merged", F.lit(0).cast("long"))).drop("_key", "_n", "_first")


def _frame(names: list[str], parts: list[tuple]) -> pd.DataFrame:
    """Parts of columns as one frame; without parts it has no columns, since Spark takes no empty column of numbers for strings."""
    return pd.DataFrame({c: np.concatenate([p[i] for p in parts]) for i, c in enumerate(names)} if parts else {})


def block_rows(n: int, dims: int) -> int:
    """Vectors of a block. A vector is sent once for each block that its own meets, so blocks are as large as a task can well
    hold, but no fewer than ``FEW_BLOCKS`` of at least ``BLOCK`` vectors."""
    return max(BLOCK, min(BLOCK_NUMBERS // max(1, dims), -(-n // FEW_BLOCKS)))


def matrix(column: pd.Series) -> np.ndarray:
    """Vectors as the rows of a matrix of double precision."""
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "id", vector: str = "embedding") -> DataFrame:
    """All pairs ``a < b`` whose inner product is above ``threshold``, with ``similarity``: exact, by blocks.

    The rows are dealt into blocks of ``block_rows``, so that a task holds about two blocks whatever n is; every pair of blocks
    meets in one, which multiplies matrices. For vectors that aren't few, use ``bucketed_pairs``.
    """
    n, dims = vectors.agg(F.count("*"), F.max(F.size(vector))).first()
    classes = max(1, -(-n // block_rows(n, dims or 1)))
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).alias("v")).withColumn("own", F.pmod(F.xxhash64("id"), F.lit(classes)).cast("int"))
    cells = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(classes - 1)))).select(F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "v")
    kind = vectors.schema[key].dataType.simpleString()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        i, j = int(pdf["i"].iloc[0]), int(pdf["j"].iloc[0])
        left = pdf[pdf["own"] == i]
        right = left if i == j else pdf[pdf["own"] == j]
        out = []
        lm, rm = (matrix(x["v"]) for x in (left, right))
        li, ri = left["id"].to_numpy(), right["id"].to_numpy()
        for s in range(0, len(lm), 256):
            sims = lm[s : s + 256] @ rm.T if len(rm) else np.zeros((0, 0))
            x, y = np.nonzero(sims > threshold)
            a, b = li[s + x], ri[y]
            if i == j:
                ok = a < b
                a, b, x, y = a[ok], b[ok], x[ok], y[ok]
            out.append((np.where(a < b, a, b), np.where(a < b, b, a), sims[x, y]))
        return _frame(["a", "b", "similarity"], out)

    return cells.groupBy("i", "j").applyInPandas(meet, f"a {kind}, b {kind}, similarity double")


def bucket_plan(threshold: float, n: int, miss: float) -> tuple[int, int] | None:
    """``(tables, bits)`` that miss a pair at ``threshold`` with probability ``miss`` at most, at the least cost for ``n``
    vectors; None if comparing all pairs by blocks costs less."""
    same = 1 - float(np.arccos(np.clip(threshold, -1, 1))) / np.pi
    if same in (0.0, 1.0):
        return (1, 16) if same else None
    plans = [(int(np.ceil(np.log(miss) / np.log1p(-(same**bits)))), bits) for bits in range(1, 33)]
    share = lambda p: p[0] / 2 ** p[1] + 2 * p[0] / max(n, 1)
    best = min(plans, key=share)
    return best if share(best) < BUCKETS_PAY else None


def bucketed_pairs(vectors: DataFrame, threshold: float, tables: int | None = None, bits: int | None = None, key: str = "id", vector: str = "embedding", seed: int = 3, miss: float = 1e-6) -> DataFrame:
    """As ``similar_pairs`` of unit vectors, from random-projection buckets: candidates share one, and are then verified.

    A pair of cosine c is missed with probability (1 - (1 - acos(c) / pi) ** bits) ** tables. Tables and bits follow from
    the threshold, so that this is ``miss`` at most. Where so many buckets would cost more than all pairs (low thresholds,
    few vectors), the pairs are those of ``similar_pairs``, and none is missed. Given ``tables`` and ``bits`` are taken as
    they are.
    """
    if tables is None or bits is None:
        plan = bucket_plan(threshold, vectors.count(), miss)
        if plan is None:
            return similar_pairs(vectors, threshold, key, vector)
        tables, bits = plan
    first = vectors.select(F.max(F.size(vector))).first()[0] or 1
    planes = np.random.default_rng(seed).standard_normal((tables * bits, first))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x.slice(i, 512) for x in batches for i in range(0, x.num_rows, 512)):
            if batch.num_rows:
                v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                side = (v @ planes.T > 0).reshape(batch.num_rows, tables, bits)
                code = side @ (1 << np.arange(bits)) + (np.arange(tables) << bits)[None, :]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(list(code), pa.list_(pa.int64()))], names=["id", "codes"])

    kind = vectors.schema[key].dataType.simpleString()
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    codes = rows.mapInArrow(sign, f"id {kind}, codes array<long>").select("id", F.explode("codes").alias("code"))
    a, b = codes.select(F.col("id").alias("a"), "code"), codes.select(F.col("id").alias("b"), "code")
    pairs = a.join(b, "code").where("a < b").select("a", "b").distinct()
    side = lambda c: rows.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"))
    scored = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", fx.dot(F.col("va"), F.col("vb")).alias("similarity"))
    return scored.where(F.col("similarity") > threshold)


def components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``node, component``: the smallest node that can be reached.

    Nodes are hung below their smallest neighbour, those above and those below by turns, until all hang below the root of
    their component: aggregations and joins on nodes, with no component in one task.
    """
    e = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        above = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = above.groupBy("u").agg(F.min("v").alias("m"))
        hung = cut(above.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct())
        # done if no node hangs below two, or below one that hangs itself
        ends = hung.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(hung.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        n = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        open_ = n.agg(F.max((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))).first()[0]
        e = hung
        if not open_:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def replay_near_dedup(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Greedy near-dedup in order: ``pairs(a, b)`` of similar ords, ``units(ord, id, confidence)`` -> ``ord, canonical``,
    the ords that go and the one each went into.

    For every unit not yet removed, in order, each later similar unit that is still there is joined with it; the more
    confident of the two stays, the earlier of equals. A unit that loses goes on to absorb later ones all the same.
    Interactions follow pairs, so components are replayed by themselves, in parallel and to the same end.
    """
    pairs = cut(pairs)  # read twice, found once
    comp = components(pairs)
    rows = units.select("ord", "confidence").join(comp, F.col("ord") == F.col("node")).select("component", "ord", "confidence")
    near = pairs.join(comp, F.col("a") == F.col("node")).groupBy("component", "a").agg(F.array_sort(F.collect_list("b")).alias("later"))
    rows = rows.join(near.select("component", F.col("a").alias("ord"), "later"), ["component", "ord"], "left")

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        conf = dict(zip(pdf["ord"], pdf["confidence"], strict=True))
        later = {o: x for o, x in zip(pdf["ord"], pdf["later"], strict=True) if x is not None}
        into: dict[int, int] = {}
        for i in sorted(conf):
            if i in into:
                continue
            for j in later.get(i, ()):
                if j in into:
                    continue
                stays, goes = (i, j) if conf[i] >= conf[j] else (j, i)
                into[goes] = stays
        return pd.DataFrame({"ord": list(into), "canonical": list(into.values())}, dtype="int64")

    return rows.groupBy("component").applyInPandas(replay, "ord long, canonical long")


def near_dedup(units: DataFrame, threshold: float = 0.85) -> DataFrame:
    """``units(ord, id, confidence, embedding, ...)`` without near-duplicates; ids of those that went into a unit in
    ``cross_references``."""
    gone = replay_near_dedup(bucketed_pairs(units, threshold, key="ord").select("a", "b"), units)
    refs = gone.join(units.select(F.col("ord"), F.col("id")), "ord").groupBy("canonical").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("cross_references"))
    kept = units.drop("cross_references").join(gone.select("ord"), "ord", "left_anti").join(refs, F.col("ord") == F.col("canonical"), "left").drop("canonical")
    return kept.withColumn("cross_references", F.coalesce("cross_references", F.array().cast("array<string>")))


def average_linkage(matrix: np.ndarray, threshold: float, sizes: np.ndarray | None = None) -> np.ndarray:
    """Cluster numbers by average linkage on cosine distances, with no merge at or above ``threshold``. A row is the mean of
    ``sizes`` vectors of unit length, one if not given.

    Chains of nearest neighbours lead to pairs that are nearest to each other, which can be merged in any order, as average
    linkage is reducible: quadratic time instead of a search for the closest pair each time.
    """
    n = len(matrix)
    d = 1 - matrix @ matrix.T
    np.fill_diagonal(d, np.inf)
    size, owner, left = np.ones(n) if sizes is None else sizes.astype(np.float64), np.arange(n), set(range(n))
    chain: list[int] = []
    while len(left) > 1:
        if not chain:
            chain = [min(left)]
        x = chain[-1]
        y = int(np.argmin(d[x]))
        if len(chain) > 1 and d[x, chain[-2]] <= d[x, y]:
            y = chain[-2]
        if len(chain) < 2 or y != chain[-2]:
            chain.append(y)
            continue
        del chain[-2:]
        if d[x, y] < threshold:
            i, j = min(x, y), max(x, y)
            row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
            d[i], d[:, i] = row, row
            d[i, i] = np.inf
            size[i] += size[j]
            owner[owner == owner[j]] = owner[i]
            gone = [j]
        else:  # nothing is closer to either, now or later
            gone = [x, y]
        for j in gone:
            d[j] = d[:, j] = np.inf
            left.discard(j)
    return owner


#: Pairs whose exact inner products are computed at once.
EXACT_PAIRS = 1 << 15


def closest_rows(lm: np.ndarray, rm: np.ndarray, li: np.ndarray, ri: np.ndarray, lr: np.ndarray, rr: np.ndarray, above: float) -> Iterator[tuple[np.ndarray, ...]]:
    """``li, ri, s, tie`` of each row of ``lm`` that has a row of ``rm``, of another id, with an inner product above ``above``: the
    largest to twelve digits, of equal ones that of the largest hash of the pair's ``lr`` and ``rr``. Ids are sorted.

    Products in single precision leave few pairs that can be the largest, by the bound of their error; those are computed in
    double precision, in an order that is the same from both ends of a pair.
    """
    low, high = lm.astype(np.float32), np.ascontiguousarray(rm.astype(np.float32).T)
    slack = 2 * ((lm.shape[1] + 4) * 2.0**-23 * np.sqrt((lm * lm).sum(1)) * np.sqrt((rm * rm).sum(1).max()) + 2e-12)
    place = np.minimum(np.searchsorted(ri, li), len(ri) - 1)
    own = ri[place] == li
    for at in range(0, len(lm), 128):
        s = low[at : at + 128] @ high
        rows = np.flatnonzero(own[at : at + 128])
        s[rows, place[at + rows]] = -np.inf
        top = s.max(axis=1).astype(np.float64)
        # rounded down, as comparing in double precision would copy the products
        least = np.nextafter((top - slack[at : at + 128]).astype(np.float32), np.float32(-np.inf))
        least[~(top + slack[at : at + 128] > above)] = np.inf
        x, y = np.divmod(np.flatnonzero(s >= least[:, None]), len(rm))
        if not len(x):
            continue
        exact = np.concatenate([np.round(np.einsum("ij,ij->i", lm[at + x[k : k + EXACT_PAIRS]], rm[y[k : k + EXACT_PAIRS]]), 12) for k in range(0, len(x), EXACT_PAIRS)])
        tie = (((lr[at + x] ^ rr[y]) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(2)).astype(np.int64)
        order = np.lexsort((tie, exact, x))
        best = order[np.append(x[order][1:] != x[order][:-1], True)]
        best = best[exact[best] > above]
        yield li[at + x[best]], ri[y[best]], exact[best], tie[best]


def _closest(asking: DataFrame, nodes: DataFrame, above: float, n: int, dims: int, block: int | None = None) -> DataFrame:
    """``id, nn, s``: of each node that asks the other node with the largest inner product above ``above``, if any.

    Blocks of those that ask meet blocks of all nodes in a task each, and return one row a node. Ties go by a hash of the pair,
    so that of nodes all equally far from each other about half choose each other.
    """
    kind = nodes.schema["id"].dataType.simpleString()
    block = block or block_rows(n, dims)
    here, there = max(1, -(-asking.count() // block)), max(1, -(-n // block))
    deal = lambda df, own, k, other, m, side: df.select(F.pmod(F.xxhash64("id"), F.lit(k)).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias(other), F.lit(side).alias("asks"), "id", F.xxhash64("id").alias("r"), "v").select("i", "j", "asks", "id", "r", "v")
    cells = deal(asking, "i", here, "j", there, True).unionByName(deal(nodes, "j", there, "i", here, False))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        left, right = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        out = []
        if len(left) and len(right):
            lm, rm = (matrix(x["v"]) for x in (left, right))
            li, ri, lr, rr = left["id"].to_numpy(), right["id"].to_numpy(), left["r"].to_numpy(np.uint64), right["r"].to_numpy(np.uint64)
            out.extend(closest_rows(lm, rm, li, ri, lr, rr, above))
        return _frame(["id", "nn", "s", "tie"], out)

    met = cells.groupBy("i", "j").applyInPandas(meet, f"id {kind}, nn {kind}, s double, tie long")
    best = met.groupBy("id").agg(F.max_by(F.struct("nn", "s"), F.struct("s", "tie", "nn")).alias("x"))
    return best.select("id", "x.nn", "x.s")


def cluster(vectors: DataFrame, threshold: float = 0.5, key: str = "id", vector: str = "embedding", block: int = BLOCK) -> DataFrame:
    """``id, cluster``: average linkage on cosine distance, with no merge at or above the threshold. ``cluster`` is the smallest
    key in it; a row without a vector is alone.

    The average distance of two clusters is one less the inner product of their means, so a cluster is a mean and a size,
    whatever its members. In rounds every cluster finds the nearest, and those that are nearest to each other merge; as
    average linkage is reducible, this gives what merging the closest pair each time gives. A cluster asks again only when
    it or its nearest has merged, and leaves when nothing is near enough. Copies are one node from the start. What remains
    when it fits a block is linked in one task.
    """
    kind = vectors.schema[key].dataType.simpleString()
    every = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = cut(every.where("v is not null").withColumn("_n", norm).select("id", F.when(F.col("_n") > 0, F.transform("v", lambda x: x / F.col("_n"))).otherwise(F.col("v")).alias("v")))
    nodes = cut(rows.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("size")).select("id", "v", "size", F.lit(None).cast(kind).alias("nn"), F.lit(None).cast("double").alias("s")))
    first = nodes.select(F.col("id").alias("a"), F.col("v").alias("w"))
    edges = rows.join(first, (F.xxhash64("v") == F.xxhash64("w")) & (F.col("v") == F.col("w"))).where("a <> id").select("a", F.col("id").alias("b"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        ids = pdf["id"].to_numpy()
        owner = ids[average_linkage(np.array(pdf["v"].tolist(), dtype=np.float64).reshape(len(pdf), -1), threshold, pdf["size"].to_numpy())]
        return _frame(["a", "b"], [(owner[owner != ids], ids[owner != ids])])

    dims = nodes.select(F.max(F.size("v"))).first()[0] or 1
    while (n := nodes.count()) > block:
        # a block that is smaller than usual, as in tests, is one of the join too
        asked = _closest(nodes.where("nn is null"), nodes, 1 - threshold, n, dims, block if block < BLOCK else None)
        picks = cut(nodes.where("nn is not null").select("id", "nn", "s").unionByName(asked))
        ends = [F.least("id", "nn").alias("a"), F.greatest("id", "nn").alias("b")]
        pairs = cut(picks.groupBy(*ends).agg(F.count("*").alias("n")).where("n = 2").select("a", "b"))
        if pairs.isEmpty():  # only where rounding hides one end of the closest pair
            pairs = cut(picks.select("s", *ends).orderBy(F.desc("s"), "a", "b").limit(1).select("a", "b"))
        edges = edges.unionByName(pairs)
        merged = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
        near = picks.select("id").unionByName(picks.select(F.col("nn").alias("id"))).distinct()
        alive = cut(nodes.select("id", "v", "size").join(near, "id", "left_semi").join(picks, "id", "left"))
        kept = alive.join(merged, "id", "left_anti").join(merged.select(F.col("id").alias("nn"), F.lit(True).alias("_m")), "nn", "left")
        kept = kept.select("id", "v", "size", F.expr("if(_m, null, nn)").alias("nn"), F.expr("if(_m, null, s)").alias("s"))
        side = lambda c: alive.select(F.col("id").alias(c), F.col("v").alias(f"v{c}"), F.col("size").alias(f"n{c}"))
        total = F.col("na") + F.col("nb")
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        mean = F.zip_with("va", "vb", lambda x, y: (x * F.col("na") + y * F.col("nb")) / total)
        nodes = cut(kept.unionByName(both.select(F.col("a").alias("id"), mean.alias("v"), total.alias("size"), F.lit(None).cast(kind).alias("nn"), F.lit(None).cast("double").alias("s"))))
    edges = edges.unionByName(nodes.select("id", "v", "size", F.lit("all").alias("task")).groupBy("task").applyInPandas(link, f"a {kind}, b {kind}"))
    return every.select("id").join(components(edges).withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))


def nearest(rows: DataFrame, centres: DataFrame, k: int = 1, block: int = CENTRES) -> DataFrame:
    """``rows(id, v)``, ``centres(centre, ord, cv)`` -> ``id, centre, similarity, rank`` of the ``k`` with the largest inner
    product, rounded to twelve digits, ties to the lower ``ord``. Rows and centres without a vector take no part.

    Blocks of rows meet blocks of centres, a pair of blocks a task, as a product of matrices that keeps the best ``k`` of a
    row; these are merged. Any number of centres will do, and no key has more than two blocks of rows.
    """
    r = rows.where("v is not null").select("id", F.col("v").cast("array<double>").alias("v"))
    c = centres.where("cv is not null").select("centre", "ord", F.col("cv").cast("array<double>").alias("v"))
    here, there = max(1, -(-r.count() // BLOCK)), max(1, -(-c.count() // block))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    kinds = {x: df.schema[x].dataType.simpleString() for df, x in ((r, "id"), (c, "centre"), (c, "ord"))}
    # not null where a side has no such column, as pandas has no integers that may be
    none = {x: F.lit("0").cast(t).alias(x) for x, t in kinds.items()}
    asked = r.select(part("id", here).alias("i"), each(there).alias("j"), F.lit(False).alias("held"), "id", none["centre"], none["ord"], "v")
    cells = asked.unionByName(c.select(each(here).alias("i"), part("centre", there).alias("j"), F.lit(True).alias("held"), none["id"], "centre", "ord", "v"))

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[~pdf["held"]], pdf[pdf["held"]].sort_values("ord", kind="stable")
        out = []
        if len(left) and len(right):
            lm, rm = (np.array(x["v"].tolist(), dtype=np.float64).reshape(len(x), -1) for x in (left, right))
            ids, names, order = left["id"].to_numpy(), right["centre"].to_numpy(), right["ord"].to_numpy()
            for at in range(0, len(lm), 512):
                s = np.round(lm[at : at + 512] @ rm.T, 12)
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                which = best.ravel()
                out.append((np.repeat(ids[at : at + 512], best.shape[1]), names[which], order[which], np.take_along_axis(s, best, 1).ravel()))
        return _frame(["id", "centre", "ord", "similarity"], out)

    found = cells.groupBy("i", "j").applyInPandas(meet, f"id {kinds['id']}, centre {kinds['centre']}, ord {kinds['ord']}, similarity double")
    w = Window.partitionBy("id").orderBy(F.desc("similarity"), "ord")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("id", "centre", "similarity", "rank")


def top_k(rows: DataFrame, group: str, score: Column, k: int, ties: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(score.desc(), ties)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hash_embedding(text: Column, dims: int = 64) -> Column:
    """A repeatable vector of unit length from hashed words; a stand-in for a sentence model, in column functions."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    places = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.size(F.filter(places, lambda p: p == i)).cast("double"))
    norm = F.sqrt(F.aggregate(counts, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(counts, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))
