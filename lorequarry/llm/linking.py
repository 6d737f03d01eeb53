"""From banded signatures to components of verified links, without emitting all pairs of a group.

1. ``stars``: inside a task's buffer the items of a bucket are tied to the first; only those firsts meet in a shuffle, packed by
   part of the buckets, where they are tied to the smallest. A bucket of n items gives fewer than n pairs, and a hot one
   an entry a buffer to shuffle.
2. The pairs are verified, by sketch and then on the full sets, and components are formed from the links found.
3. A bucket whose items still lie in several components may hide links between them. Items of such buckets are put into
   groups, of all buckets that they chain together or, where less is sent so, of a bucket each, and blocks of a group are compared with each other: sketches first, then exact intersections as products of
   incidence matrices. A block pair returns a spanning forest of the links between components, never all its links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .ngrams import pieces
from .sketching import xor_counts
from .workspace import Workspace, large, lean, nonempty, small

#: Items of a group that are compared with as many others in one step.
BLOCK = 512
#: Set elements that one matrix product takes.
COLUMNS = 2048
#: Payloads, in bytes, that one step of the exact comparison takes, besides a longer single pair.
STEP_BYTES = 1 << 18

#: Bucket entries that a task ties at once, and those that it holds of one part after the shuffle, on average.
BUFFER, PART = 1 << 18, 1 << 19

#: From the payloads of items to the elements of their sets, set after set, and how many each has; an element may come
#: more than once.
Expand = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]

STAR_SCHEMA = "bucket long, hub long, id long"


def _tied(buckets: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """The distinct buckets and the smallest id of each, and rows ``bucket, smallest id, other id``."""
    order = np.argsort(buckets)
    buckets, ids = buckets[order], ids[order]
    new = np.ones(len(buckets), bool)
    new[1:] = buckets[1:] != buckets[:-1]
    start = np.flatnonzero(new)
    least = np.minimum.reduceat(ids, start) if len(start) else ids

    def ties() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        hub = np.repeat(least, np.diff(np.append(start, len(ids))))
        at = np.flatnonzero(hub != ids)
        for i in range(0, len(at), 100_000):
            k = at[i : i + 100_000]
            yield buckets[k], hub[k], ids[k]

    return buckets[start], least, ties()


_PACKED = "part int, firsts binary, bucket long, hub long, id long"


def _pack(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """From ``id, bands``: ties within a buffer as rows with ``bucket, hub, id``, dealt over all parts, and of each bucket the
    first entry, packed by part."""
    names = ["part", "firsts", "bucket", "hub", "id"]
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        buckets, least, ties = _tied(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        for b, h, i in ties:
            part = (np.arange(len(b)) % parts).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(b), pa.binary()), *(pa.array(x, pa.int64()) for x in (b, h, i))], names=names)
        entry = np.stack([buckets, least], axis=1)
        part = (buckets.view(np.uint64) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        found, cut = np.unique(part[order], return_index=True)
        blobs = [x.tobytes() for x in np.split(entry[order], cut[1:])]
        none = pa.nulls(len(found), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blobs, pa.binary()), none, none, none], names=names)

    size = 0
    for batch in batches:
        if batch.num_rows:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            buckets = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
            held.append((buckets, np.repeat(ids, len(buckets) // len(ids))))
            size += len(buckets)
            if size >= BUFFER:
                yield from flush()
                size = 0
    if held:
        yield from flush()


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ties as they come, and those of the packed firsts of each part; the firsts of one part at a time are in memory."""

    def firsts() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tie = batch.column("firsts").is_null()
            if tie.true_count < batch.num_rows:
                yield batch.filter(pc.invert(tie)).select(["part", "firsts"])
            if tie.true_count:
                ready.append(batch.filter(tie).select(["bucket", "hub", "id"]))

    ready: list[pa.RecordBatch] = []
    for part in grouped(firsts(), ["part"]):
        yield from ready
        ready.clear()
        entry = np.frombuffer(b"".join(part["firsts"].to_pylist()), np.int64).reshape(-1, 2)
        for cols in _tied(entry[:, 0], entry[:, 1])[2]:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["bucket", "hub", "id"])
    yield from ready


def stars(ws: Workspace, items: DataFrame, bands: int) -> DataFrame:
    """Written ``items(id long, bands binary)``, the ``bands`` keys of each packed as 64-bit numbers -> written ``bucket,
    hub, id``. An id may come more than once."""
    shuffles = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(shuffles, -(-items.count() * bands // PART))
    packed = items.select("id", "bands").mapInArrow(lean(lambda it: _pack(it, parts)), _PACKED)
    return ws.save(packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lean(_unpack), STAR_SCHEMA), "stars")


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of equal keys in sorted batches; one run at a time is in memory."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        head = tuple(c[0] for c in cols)
        if held and head != last:
            yield pa.Table.from_batches(held)
            held = []
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


#: Pairs of one step of the exact comparison: their numbers and sides take the low bits of the elements' hashes, whose
#: other 55 bits tell the elements of two sets apart.
STEP_PAIRS = 256


def common_elements(flat: np.ndarray, counts: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the intersections and of the unions of at most ``STEP_PAIRS`` pairs of sets, given by their numbers."""
    starts = np.cumsum(counts) - counts
    who, n = np.stack([left, right], axis=1).ravel(), counts[np.stack([left, right], axis=1).ravel()]
    at = np.arange(int(n.sum())) + np.repeat(starts[who] - (np.cumsum(n) - n), n)
    tag = np.repeat(np.arange(2 * len(left), dtype=np.uint64), n)  # the pair, and the side in the lowest bit
    key = flat[at] & ~np.uint64(2 * STEP_PAIRS - 1) | tag
    key.sort()
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    key = key[first]  # each element of a side once
    pair = key >> np.uint64(1)
    new = np.ones(len(pair), bool)
    new[1:] = pair[1:] != pair[:-1]
    number = (pair & np.uint64(STEP_PAIRS - 1)).astype(np.int64)
    union = np.bincount(number[new], minlength=len(left))
    return np.bincount(number, minlength=len(left)) - union, union


def confirm(pairs: DataFrame, expand: Expand, percent: int, most_bits: int) -> DataFrame:
    """``pairs(a, b, sa, sb, xa, xb)`` of sketches and payloads -> the ``a, b`` whose sketches differ in at most
    ``most_bits`` bits and whose sets have ``100 * intersection >= percent * union``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, STEP_PAIRS):
                sa, sb = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint64).reshape(part.num_rows, -1) for c in ("sa", "sb"))
                part = part.filter(pa.array(np.bitwise_count(sa ^ sb).sum(1) <= most_bits))
                xa, xb = part.column("xa").to_pylist(), part.column("xb").to_pylist()
                keep = np.zeros(part.num_rows, bool)
                first = 0
                while first < part.num_rows:
                    last, size = first, 0
                    while last < part.num_rows and (last == first or size < STEP_BYTES):
                        size += len(xa[last]) + len(xb[last])
                        last += 1
                    number: dict[bytes, int] = {}
                    left, right = (np.array([number.setdefault(x, len(number)) for x in xs[first:last]]) for xs in (xa, xb))
                    both, union = common_elements(*expand(list(number)), left, right)
                    keep[first:last] = 100 * both >= percent * union
                    first = last
                got = part.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays([got.column("a"), got.column("b")], names=["a", "b"])

    return pairs.mapInArrow(lean(run), "a long, b long")


def intersections(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact sizes of the intersections of all pairs of sets, and of the sets."""
    values, col = np.unique(flat, return_inverse=True)
    place = np.unique(np.repeat(np.arange(len(counts)), counts) * np.int64(len(values)) + col)
    row, col = np.divmod(place, max(1, len(values)))
    sizes = np.bincount(row, minlength=len(counts))
    # an element of one set alone is in no intersection
    often = np.bincount(col, minlength=len(values)) > 1
    shared = np.cumsum(often) - 1
    at = often[col]
    row, col = row[at], shared[col[at]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    out = np.zeros((len(sizes), len(sizes)), np.float64)
    for c in range(0, int(shared[-1]) + 1 if len(shared) else 0, COLUMNS):
        a, b = np.searchsorted(col, [c, c + COLUMNS])
        m = np.zeros((len(sizes), COLUMNS), np.float32)
        m[row[a:b], col[a:b] - c] = 1
        out += m @ m.T
    return out.astype(np.int64), sizes


def forest(link: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    """Links that join what the symmetric matrix ``link`` joins, given that items of equal label are joined already."""
    _, label = np.unique(label, return_inverse=True)
    members: dict[int, list[int]] = {}
    for i, x in enumerate(label.tolist()):
        members.setdefault(x, []).append(i)
    seen, out = np.zeros(len(members), bool), []
    for start in range(len(members)):
        if seen[start]:
            continue
        seen[start] = True
        queue = list(members[start])
        while queue:
            i = queue.pop()
            for j in np.flatnonzero(link[i] & ~seen[label]).tolist():
                if not seen[label[j]]:
                    seen[label[j]] = True
                    out.append((i, j))
                    queue += members[int(label[j])]
    return out


def _compare(batches: Iterator[pa.RecordBatch], expand: Expand, percent: int, most_bits: int) -> Iterator[pa.RecordBatch]:
    """Of each block pair a forest of the verified links between different labels. Small ones are compared in one step."""

    def compare(pairs: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        block = pa.concat_tables(pairs)
        ids, label, side = (block[c].to_numpy() for c in ("id", "label", "side"))
        rows = [p.num_rows for p in pairs]
        pair = np.repeat(np.arange(len(pairs)), rows)
        within = np.repeat([p["i"][0].as_py() == p["j"][0].as_py() for p in pairs], rows)
        sketch = np.frombuffer(b"".join(block["sketch"].to_pylist()), np.uint8).reshape(len(ids), -1)
        near = (pair[:, None] == pair[None, :]) & (label[:, None] != label[None, :]) & (within[:, None] | (side[:, None] != side[None, :]))
        near &= xor_counts(sketch, sketch) <= most_bits
        use = np.flatnonzero(near.any(0))
        if not len(use):
            return
        payload = block["payload"].take(pa.array(use)).to_pylist()
        common, sizes = intersections(*expand(payload))
        link = near[np.ix_(use, use)] & (100 * common >= percent * (sizes[:, None] + sizes[None, :] - common))
        found = forest(link, label[use])
        if found:
            a, b = (ids[use[list(c)]] for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), pa.int64()), pa.array(np.maximum(a, b), pa.int64())], names=["a", "b"])

    held: list[pa.Table] = []
    for pair in grouped(batches, ["grp", "i", "j"]):
        if held and sum(p.num_rows for p in held) + pair.num_rows > BLOCK // 2:
            yield from compare(held)
            held = []
        held.append(pair)
    if held:
        yield from compare(held)


def _blocks(rows: DataFrame) -> DataFrame:
    """``rows(grp, n, id, ...)``, each once for every block of its group; block pairs have i <= j."""
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "label")


def _sent(n: str) -> Column:
    """How many times the items of a group of ``n`` are sent: each once for every block."""
    return F.col(n) * F.ceil(F.col(n) / BLOCK)


def _by_bucket(ws: Workspace, items: DataFrame, ties: DataFrame, sizes: DataFrame) -> DataFrame:
    """``items(grp, n, id, label)``; those of a group of several blocks by bucket instead, where less is sent so.

    Only items of one bucket need to be compared. Of small groups that is done at once for all their buckets, but the more
    items there are, the longer chains of buckets become, and blocks of a chain would mostly compare what shares none.
    """
    chained = ws.save(sizes.where(F.col("n") > BLOCK), "chained")
    if not nonempty(chained):
        return items
    label = items.select("id", "grp").join(small(chained, 16), "grp").select("id", "grp", "n")
    of_bucket = ties.select("bucket", "id", F.col("lid").alias("label")).unionByName(ties.select("bucket", F.col("hub").alias("id"), F.col("lhub").alias("label"))).distinct()
    of_bucket = ws.save(of_bucket.join(large(label), "id").select("bucket", "id", "label", "grp"), "of_bucket")
    buckets = ws.save(of_bucket.groupBy("bucket", "grp").agg(F.count("*").alias("m")), "buckets")
    cheaper = buckets.groupBy("grp").agg(F.sum(_sent("m")).alias("sent")).join(large(chained), "grp").where(F.col("sent") < _sent("n")).select("grp")
    cheaper = ws.save(cheaper, "cheaper")
    split = of_bucket.join(small(cheaper, 8), "grp", "left_semi").join(large(buckets.select("bucket", F.col("m").alias("n"))), "bucket")
    return items.join(small(cheaper, 8), "grp", "left_anti").select("grp", "n", "id", "label").unionByName(split.select(F.col("bucket").alias("grp"), "n", "id", "label"))


def components(ws: Workspace, star: DataFrame, sets: DataFrame, expand: Expand, percent: int, most_bits: int) -> DataFrame:
    """``star(bucket, hub, id)``, written ``sets(id, sketch, payload)`` of all its items -> written ``node, component``
    of the verified links. An item of several sets, by rows that share an id, is linked if one of them is."""
    pairs = ws.save(star.select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct(), "pairs")
    side = lambda c: sets.select(F.col("id").alias(c), F.col("sketch").alias(f"s{c}"), F.col("payload").alias(f"x{c}"))
    full = pairs.join(large(side("b")), "b").join(large(side("a")), "a").select("a", "b", "sa", "sb", "xa", "xb")
    comp = ws.save(connected_components(ws, confirm(full, expand, percent, most_bits)), "components")
    ws.forget(pairs)
    label = lambda c: comp.select(F.col("node").alias(c), F.col("component").alias(f"l{c}"))
    ties = star.join(small(label("hub"), 24), "hub", "left").join(small(label("id"), 24), "id", "left").withColumn("lhub", F.coalesce("lhub", "hub")).withColumn("lid", F.coalesce("lid", "id"))
    ties = ws.save(ties.select("bucket", "hub", "id", "lhub", "lid"), "ties")
    # a bucket of one pair has been tested, and one within a component needs no test
    b = ties.groupBy("bucket").agg(F.min(F.least("lhub", "lid")).alias("lo"), F.max(F.greatest("lhub", "lid")).alias("hi"), *[f(c).alias(f"{f.__name__}_{c}") for c in ("hub", "id") for f in (F.min, F.max)])
    apart = b.where("lo < hi and (min_hub <> max_hub or min_id <> max_id)").select("bucket")
    ties = ws.save(ties.join(large(apart), "bucket"), "apart")
    if not nonempty(ties):
        return comp
    groups = connected_components(ws, ties.select(F.col("lhub").alias("a"), F.col("lid").alias("b")).distinct()).select(F.col("node").alias("label"), F.col("component").alias("grp"))
    items = ties.select(F.col("hub").alias("id"), F.col("lhub").alias("label")).unionByName(ties.select("id", F.col("lid").alias("label"))).distinct()
    items = ws.save(items.join(large(groups), "label"), "items")
    sizes = ws.save(items.groupBy("grp").agg(F.count("*").alias("n")), "sizes")
    items = _by_bucket(ws, items.join(small(sizes, 16), "grp"), ties, sizes)
    parts = int(ws.spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = _blocks(items).join(large(sets), "id").repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    fresh = ws.save(blocks.mapInArrow(lean(lambda it: _compare(it, expand, percent, most_bits)), "a long, b long"), "links")
    if not nonempty(fresh):
        return comp
    return ws.save(connected_components(ws, comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(fresh)), "components")
