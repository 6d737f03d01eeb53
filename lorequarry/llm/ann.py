"""Approximate nearest neighbours by largest inner product, with multiprobe p-stable hashing.

Vectors are lifted so that the largest inner product is the smallest Euclidean distance, and hashed by several tables of
Gaussian projections, each cut into cells of one width from a random offset. The number of projections grows with that of
vectors, so that buckets are about as many as the square root of the vectors asks for. A query visits the occupied buckets of all tables in the order of the estimated
chance that they hold a near vector, the squared distances from its projections to the buckets' cells added up, until
it has passed a share of all vectors. That share is fitted: it is the one at which a bounded set of sample queries,
compared with every vector, finds ``target_recall`` of its true neighbours. Candidates of all tables are scored exactly.

A bucket's rows are dealt out in cells of at most ``cell_rows`` vectors; queries stream past a cell in batches. Where queries
are many, each meets its cells in one of several shares, which all hold the cells' vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import Workspace


@dataclass(frozen=True)
class Settings:
    k: int = 20
    tables: int = 2
    #: projections of a table for up to ``many`` vectors, and cells of a projection: at most ``cells ** hashes`` buckets a
    #: table. Beyond, a projection is added each time that vectors are ``cells ** 2`` times as many.
    hashes: int = 6
    cells: int = 4
    many: int = 1 << 16
    cell_rows: int = 2048
    #: queries of a share, and numbers that the visiting order of a batch of queries may take
    share_queries: int = 1 << 16
    order_numbers: int = 1 << 22
    #: found rows that a task holds, to merge what its cells have found for a query
    held_rows: int = 1 << 20
    #: vectors that place the cells, and queries that fit the share of vectors to visit
    sample_vectors: int = 4096
    sample_queries: int = 128
    target_recall: float = 0.95
    #: A query passes at least this many times ``k`` vectors.
    least_visits: int = 20
    seed: int = 9

    def for_rows(self, n: int) -> Settings:
        return replace(self, hashes=self.hashes + max(0, int(np.log(max(n, 1) / self.many) / np.log(self.cells) / 2)))


@dataclass
class Index:
    settings: Settings
    dims: int
    radius2: float
    a: np.ndarray  # [tables, hashes, dims + 1]
    edges: np.ndarray  # inner cell borders [tables, hashes, cells - 1]
    #: occupied buckets of each table, ascending, and their rows
    buckets: list[np.ndarray] = field(default_factory=list)
    counts: list[np.ndarray] = field(default_factory=list)
    #: number of the first cell of each bucket and the cells that share its rows
    first_cell: list[np.ndarray] = field(default_factory=list)
    parts: list[np.ndarray] = field(default_factory=list)
    n: int = 0
    share: float = 0.0

    def project(self, v: np.ndarray, query: bool) -> np.ndarray:
        """``[rows, tables, hashes]``; queries are scaled to the radius and lie on the plane that vectors are lifted from."""
        norm2 = (v * v).sum(1)
        if query:
            v = v * np.sqrt(self.radius2 / np.maximum(norm2, 1e-300))[:, None]
            lift = np.zeros(len(v))
        else:
            lift = np.sqrt(np.maximum(self.radius2 - norm2, 0))
        return np.einsum("nd,thd->nth", np.hstack([v, lift[:, None]]), self.a)

    def bucket_of(self, v: np.ndarray) -> np.ndarray:
        """``[rows, tables]``"""
        p, s = self.project(v, False), self.settings
        out = np.zeros((len(v), s.tables), np.int64)
        for t in range(s.tables):
            for h in range(s.hashes):
                out[:, t] = out[:, t] * s.cells + np.searchsorted(self.edges[t, h], p[:, t, h], side="right")
        return out

    def visits(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per query all buckets in visiting order, as places in the tables' lists set end to end; the rows passed before
        each; and the order's inverse."""
        p, s = self.project(q, True), self.settings
        cost = []
        for t in range(s.tables):
            total = np.zeros((len(q), len(self.buckets[t])))
            rest = self.buckets[t].copy()
            for h in reversed(range(s.hashes)):
                cell, rest = rest % s.cells, rest // s.cells
                low = np.concatenate([[-np.inf], self.edges[t, h]])
                high = np.concatenate([self.edges[t, h], [np.inf]])
                x = p[:, t, h, None]
                d = np.maximum(0, np.maximum(low[None] - x, x - high[None]))
                total += (d * d)[:, cell]
            cost.append(total)
        order = np.argsort(np.hstack(cost), axis=1, kind="stable")
        rows = np.concatenate(self.counts)[order]
        return order, np.cumsum(rows, axis=1) - rows, rows


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, v array<double>``: one row an id, without vectors that are null, zero or hold null or non-finite numbers."""
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select("vec_id", v.alias("v")).where("vec_id is not null and v is not null and size(v) > 0")
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad & F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def exact_scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, added up in the order of the components, so that equal vectors score alike."""
    out = np.zeros(len(q))
    for j in range(q.shape[1]):
        out += q[:, j] * v[:, j]
    return out


def top(scores: np.ndarray, q: np.ndarray, v: np.ndarray, q_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a matrix of near-exact scores, -inf where a vector is no candidate, each query's ``k`` best by exact score and
    smaller id: query ids, vector ids, scores."""
    scores[q_ids[:, None] == ids[None, :]] = -np.inf
    k = min(k, scores.shape[1])
    kth = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    floor = np.where(np.isfinite(kth), kth - 1e-9 * np.maximum(1, np.abs(kth)), -np.inf)
    x, y = np.nonzero((scores >= floor[:, None]) & (scores > -np.inf))
    s = np.empty(len(x))
    for i in range(0, len(x), 1 << 16):
        s[i : i + (1 << 16)] = exact_scores(q[x[i : i + (1 << 16)]], v[y[i : i + (1 << 16)]])
    order = np.lexsort((ids[y], -s, x))
    x, y, s = x[order], y[order], s[order]
    first = np.searchsorted(x, x)
    keep = np.arange(len(x)) - first < k
    return q_ids[x[keep]], ids[y[keep]], s[keep]


def best_of(q: np.ndarray, v: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of found rows each query's ``k`` best, each vector once."""
    order = np.lexsort((v, -s, q))
    q, v, s = q[order], v[order], s[order]
    once = np.ones(len(q), bool)
    once[1:] = (q[1:] != q[:-1]) | (v[1:] != v[:-1])  # a vector that was found twice has one score
    q, v, s = q[once], v[once], s[once]
    keep = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[keep], v[keep], s[keep]


_FOUND = "query_id long, vec_id long, score double"


def _record(q: np.ndarray, v: np.ndarray, s: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.float64())], names=["query_id", "vec_id", "score"])


def fit(ws: Workspace, vectors: DataFrame, s: Settings) -> Index | None:
    """The index' directory from written ``vectors(vec_id, v)``; the driver holds the samples and one row a bucket."""
    stats = vectors.agg(F.max(F.aggregate("v", F.lit(0.0), lambda x, y: x + y * y)).alias("r2"), F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if not stats["n"]:
        return None
    s = s.for_rows(stats["n"])
    rng = np.random.default_rng(s.seed)
    index = Index(s, stats["d"], stats["r2"] * (1 + 1e-12), rng.standard_normal((s.tables, s.hashes, stats["d"] + 1)), np.zeros(0), n=stats["n"])
    by_hash = vectors.orderBy(F.xxhash64(F.lit(s.seed), "vec_id"), "vec_id")
    sample = by_hash.limit(s.sample_vectors).toArrow()
    sample_v = _matrix(sample["v"].combine_chunks(), index.dims)
    p = index.project(sample_v, False)
    # cells of equal width from a random offset, about between the outer tenths; the outer ones are open
    low, high = np.quantile(p, [0.1, 0.9], axis=0)
    width = (high - low) / (s.cells - 1)
    index.edges = low[..., None] + width[..., None] * (rng.random(low.shape)[..., None] + np.arange(s.cells - 1))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b = index.bucket_of(_matrix(batch.column("v"), index.dims))
                for t in range(s.tables):
                    found, n = np.unique(b[:, t], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), t), pa.int32()), pa.array(found), pa.array(n.astype(np.int64))], names=["t", "bucket", "n"])

    directory = vectors.select("v").mapInArrow(hashed, "t int, bucket long, n long").groupBy("t", "bucket").agg(F.sum("n").alias("n")).collect()
    cell = 0
    for t in range(s.tables):
        rows = sorted((r["bucket"], r["n"]) for r in directory if r["t"] == t)
        index.buckets.append(np.array([b for b, _ in rows], np.int64))
        index.counts.append(np.array([n for _, n in rows], np.int64))
        first, parts, held = [], [], 0
        for _, n in rows:
            k = -(-n // s.cell_rows)
            if k > 1 or held + n > s.cell_rows:
                cell, held = cell + (held > 0), 0
            first.append(cell)
            parts.append(k)
            held += n
            if k > 1:
                cell, held = cell + k, 0
        cell += held > 0
        index.first_cell.append(np.array(first, np.int64))
        index.parts.append(np.array(parts, np.int64))
    # the sample queries' true neighbours among all vectors
    sample_ids = sample["vec_id"].to_numpy()[: s.sample_queries]
    queries = sample_v[: s.sample_queries]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column("v"), index.dims)
                yield _record(*top(queries @ v.T, queries, v, sample_ids, batch.column("vec_id").to_numpy(), s.k))

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    truth = vectors.mapInArrow(compare, _FOUND).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= s.k)
    truth = truth.join(vectors, "vec_id").select("query_id", "v").toArrow()
    if truth.num_rows:
        place = {int(x): i for i, x in enumerate(sample_ids)}
        whose = np.array([place[x] for x in truth["query_id"].to_pylist()])
        home = index.bucket_of(_matrix(truth["v"].combine_chunks(), index.dims))
        order, before, _ = index.visits(queries)
        at = np.empty_like(order)
        np.put_along_axis(at, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        start, seen = 0, np.full(len(whose), np.inf)
        for t in range(s.tables):
            where = start + np.searchsorted(index.buckets[t], home[:, t])
            seen = np.minimum(seen, before[whose, at[whose, where]])
            start += len(index.buckets[t])
        index.share = float(np.quantile(seen, s.target_recall, method="higher")) / index.n
    return index


def search(vectors: DataFrame, queries: Column, s: Settings = Settings()) -> DataFrame:
    """``vectors(vec_id, embedding)`` -> ``query_id, rank, vec_id, score``, for each valid row that ``queries`` selects
    its ``k`` nearest found among all others of its length, nearest first, ties to the smaller vec_id.

    ``score`` is the inner product of the vectors as they are, in double precision. Vectors that are null, zero or hold
    null or non-finite components take no part, nor do rows without an id; rows that share an id are one, the smallest
    vector. With fewer than ``k`` other vectors all are returned. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    ws = Workspace(spark, "ann")
    rows = ws.save(valid_vectors(vectors), "vectors")
    found = None
    for r in rows.select(F.size("v").alias("d")).distinct().orderBy("d").collect():
        part = _search(ws, rows.where(F.size("v") == r["d"]), queries, s)
        found = part if found is None else found.unionByName(part)
    return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def _search(ws: Workspace, rows: DataFrame, queries: Column, s: Settings) -> DataFrame:
    """The same for valid vectors of one length, one at least."""
    spark = ws.spark
    index = fit(ws, rows, s)
    s, dims = index.settings, index.dims
    dealt = "cell long, share int, kind int, id long, v array<double>, bucket array<int>"
    names = ["cell", "share", "kind", "id", "v", "bucket"]
    asked = rows.where(queries)
    shares = max(1, -(-asked.count() // s.share_queries))
    scrambled = lambda ids, k: (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % k

    def deal_vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("vec_id").to_numpy()
                home = ix.bucket_of(_matrix(batch.column("v"), ix.dims))
                for t in range(s.tables):
                    at = np.searchsorted(ix.buckets[t], home[:, t])
                    spread = scrambled(ids, ix.parts[t][at])
                    code = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1), pa.int32()), pa.array(at, pa.int32()))
                    for share in range(shares):
                        yield pa.RecordBatch.from_arrays([pa.array(ix.first_cell[t][at] + spread), pa.array(np.full(len(at), share), pa.int32()), pa.array(np.zeros(len(at)), pa.int32()), batch.column("vec_id"), batch.column("v"), code], names=names)

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = index
        least = max(ix.share * ix.n, s.least_visits * s.k)
        start = np.cumsum([0] + [len(b) for b in ix.buckets])
        step = max(1, min(256, s.order_numbers // max(1, int(start[-1]))))
        for whole in batches:
            for batch in (whole.slice(i, step) for i in range(0, whole.num_rows, step)):
                order, before, _ = ix.visits(_matrix(batch.column("v"), ix.dims))
                cells, which, lists = [], [], []
                for i in range(batch.num_rows):
                    go = order[i, before[i] <= least]
                    for t in range(s.tables):
                        at = np.sort(go[(go >= start[t]) & (go < start[t + 1])] - start[t])
                        first, parts = ix.first_cell[t][at], ix.parts[t][at]
                        reps = np.repeat(np.arange(len(at)), parts)
                        cell = first[reps] + (np.arange(len(reps)) - np.repeat(np.cumsum(parts) - parts, parts))
                        cut = np.flatnonzero(np.diff(cell, prepend=-1))
                        for c, b in zip(cell[cut], np.split(at[reps], cut[1:]), strict=True):
                            cells.append(c)
                            which.append(i)
                            lists.append(b.astype(np.int32))
                take = pa.array(which, pa.int32())
                share = scrambled(batch.column("vec_id").take(take).to_numpy(zero_copy_only=False), shares)
                yield pa.RecordBatch.from_arrays([pa.array(cells, pa.int64()), pa.array(share, pa.int32()), pa.array(np.ones(len(cells)), pa.int32()), batch.column("vec_id").take(take), batch.column("v").take(take), pa.array(lists, pa.list_(pa.int32()))], names=names)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by share and cell, vectors before queries; the vectors of one cell are held, and the best found so far."""
        cell, held, ready = None, [], None
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        n_found = 0
        for whole in batches:
            cells, kinds = whole.column("cell").to_numpy() * shares + whole.column("share").to_numpy(), whole.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1).tolist(), len(cells)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if cells[a] != cell:
                    cell, held, ready = cells[a], [], None
                part = whole.slice(a, b - a)
                if kinds[a] == 0:
                    held.append(part)
                    continue
                if not held:
                    continue
                if ready is None:
                    t = pa.Table.from_batches(held).combine_chunks()
                    home = t["bucket"].combine_chunks().flatten().to_numpy()
                    by = np.argsort(home, kind="stable")
                    v = _matrix(t["v"].combine_chunks(), dims)[by]
                    names_, starts = np.unique(home[by], return_index=True)
                    ready = (v, t["id"].to_numpy()[by], names_, np.append(starts, len(by)))
                v, ids, names_, starts = ready
                for i in range(0, part.num_rows, 256):
                    q = part.slice(i, 256)
                    qv, q_ids, lists = _matrix(q.column("v"), dims), q.column("id").to_numpy(), q.column("bucket")
                    owner = np.repeat(np.arange(len(q_ids)), lists.value_lengths().to_numpy())
                    asked = np.zeros((len(q_ids), len(names_)), bool)
                    code = lists.flatten().to_numpy()
                    at = np.searchsorted(names_, code)
                    ok = (at < len(names_)) & (names_[np.minimum(at, len(names_) - 1)] == code)
                    asked[owner[ok], at[ok]] = True
                    scores = np.full((len(q_ids), len(ids)), -np.inf)
                    for j in np.flatnonzero(asked.any(0)):
                        who = np.flatnonzero(asked[:, j])
                        scores[who, starts[j] : starts[j + 1]] = qv[who] @ v[starts[j] : starts[j + 1]].T
                    found.append(top(scores, qv, v, q_ids, ids, s.k))
                    n_found += len(found[-1][0])
                    if n_found > s.held_rows:
                        found = [best_of(*map(np.concatenate, zip(*found, strict=True)), s.k)]
                        n_found = len(found[0][0])
                        if n_found > s.held_rows // 2:
                            yield _record(*found.pop())
                            n_found = 0
        if found:
            yield _record(*best_of(*map(np.concatenate, zip(*found, strict=True)), s.k))

    both = rows.mapInArrow(deal_vectors, dealt).unionByName(asked.mapInArrow(deal_queries, dealt))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scored = both.repartition(parts, "cell", "share").sortWithinPartitions("share", "cell", "kind").mapInArrow(visit, _FOUND)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    merged = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(best))
    return merged.where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
