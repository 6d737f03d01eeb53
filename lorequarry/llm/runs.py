"""Periodic runs of words: a harmonic grid of starting points, longest common extensions by prefix hashes.

A run of period p and at least three periods holds a multiple of p in its first period, and the p words from there on equal
the p after them. So the multiples of every period, a grid of n ln n points, meet every run. At all pairs (period, grid
point) of many documents at once, the longest common extensions of the point and of the point one period on are binary
searched to the right and to the left by prefix hashes. What is found is verified word by word; runs that are found from
several points or at a multiple of their period are one.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngrams import pieces
from .workspace import bound_batches

#: Words of texts that are searched together; a longer text is alone.
TOGETHER = 1 << 18
#: Pairs (period, grid point) that one numpy step works on.
STEP = 1 << 18
#: Bytes of text that are cut into words at a time.
SLICE = 1 << 20

#: A prime below 2 ** 31, so that products fit 64 bits, and the base of the hash.
_PRIME, _BASE = np.uint64(2147483629), 1_000_003_271 % 2147483629


@dataclass(frozen=True)
class Settings:
    #: A run has so many words at least, and so many periods.
    least: int = 24
    periods: int = 3
    #: Of so many documents one gets a run planted, by the crc32 of its id; 0: none.
    planted: int = 0


#: What the contract of the query asks for.
CONTRACT = Settings(planted=10)


def words(text: bytes, vocabulary: dict[bytes, int]) -> np.ndarray:
    """Numbers of the text's words, equal for equal words; new words enter the vocabulary. The text is cut in slices, so
    that not all of its words are objects at once."""
    found, at = [], 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        found.append(np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for w in text[at:end].split()), np.int64))
        at = end
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def plant(ids: np.ndarray, doc_id: int | None, one_of: int) -> np.ndarray:
    """One of ``one_of`` documents has its words from some place on replaced by repetitions of the first of them."""
    n, h = len(ids), zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if not one_of or h % one_of or not n:
        return ids
    g = h // one_of
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return ids[np.where(i < a, i, a + (i - a) % p)]


class Prefixes:
    """Hashes of the prefixes of all words: sums of words times powers of the base, modulo a prime."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        self.power = np.ones(n + 1, np.uint64)
        have = 1
        step = np.uint64(_BASE)
        while have <= n:  # doubling: base ** (have + i) = base ** i * base ** have
            more = min(have, n + 1 - have)
            self.power[have : have + more] = self.power[:more] * step % _PRIME
            step = step * step % _PRIME
            have += more
        terms = (ids.astype(np.uint64) + np.uint64(1)) * self.power[:n] % _PRIME
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64) % _PRIME])

    def equal(self, at: np.ndarray, shift: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether the words from ``at`` on and those ``shift`` later have the same hash."""
        a = (self.sums[at + length] + _PRIME - self.sums[at]) * self.power[shift] % _PRIME
        return a == (self.sums[at + shift + length] + _PRIME - self.sums[at + shift]) % _PRIME


def _longest(holds, most: np.ndarray) -> np.ndarray:
    """The largest numbers up to ``most`` for which ``holds`` is true, for all places at once; it is true up to there."""
    low, high = np.zeros_like(most), most.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_] + 1) // 2
        good = holds(open_, mid)
        low[open_[good]] = mid[good]
        high[open_[~good]] = mid[~good] - 1
    return low


def _candidates(ids: np.ndarray, bounds: np.ndarray, s: Settings) -> Iterator[np.ndarray]:
    """Stretches ``[place, (start, end, period)]`` by hash, of at least the least length; numbers count through all documents."""
    hashes = Prefixes(ids)
    size = np.diff(bounds)
    periods = np.where(size >= s.least, size // s.periods, 0)
    # a row for each document and period, with so many grid points that have a word one period on
    doc = np.repeat(np.arange(len(size)), periods)
    period = np.arange(len(doc)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    points = (size[doc] - 1) // period
    before = np.concatenate([[0], np.cumsum(points)])
    for lo in range(0, int(before[-1]), STEP):
        hi = min(lo + STEP, int(before[-1]))
        first, last = np.searchsorted(before, (lo, hi - 1), "right") - 1
        rows = np.arange(first, last + 1)
        row = np.repeat(rows, np.minimum(before[rows + 1], hi) - np.maximum(before[rows], lo))
        p = period[row]
        begin, end = bounds[doc[row]], bounds[doc[row] + 1]
        at = begin + (np.arange(lo, hi) - before[row]) * p
        # in its first period a run has a point whose p words equal the next p
        ok = ids[at] == ids[at + p]
        at, p, begin, end = at[ok], p[ok], begin[ok], end[ok]
        ok = at + 2 * p <= end
        at, p, begin, end = at[ok], p[ok], begin[ok], end[ok]
        ok = hashes.equal(at, p, p)
        at, p, begin, end = at[ok], p[ok], begin[ok], end[ok]
        right = _longest(lambda i, k: hashes.equal(at[i], p[i], k), end - at - p)
        left = _longest(lambda i, k: hashes.equal(at[i] - k, p[i], k), at - begin)
        found = np.stack([at - left, at + p + right, p], 1)
        length = found[:, 1] - found[:, 0]
        found = found[(length >= s.least) & (length >= s.periods * p)]
        # the points of a run follow one another
        yield found[np.concatenate([[True], (found[1:] != found[:-1]).any(1)])] if len(found) else found


def _stretches(ids: np.ndarray, begin: int, end: int, p: int, s: Settings) -> Iterator[tuple[int, int, int]]:
    """All stretches of period ``p`` of one document by comparing words: the way out when a hash has lied."""
    same = np.concatenate([[False], ids[begin : end - p] == ids[begin + p : end], [False]])
    edge = np.flatnonzero(same[1:] != same[:-1])
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        if b - a + p >= max(s.least, s.periods * p):
            yield int(begin + a), int(begin + b + p), p


def runs(ids: np.ndarray, bounds: np.ndarray, s: Settings) -> list[list[tuple[int, int, int]]]:
    """For each document ``ids[bounds[i]:bounds[i + 1]]`` its runs ``(start, length, period)`` by start, then period."""
    found = list(_candidates(ids, bounds, s))
    all_ = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    good: dict[tuple[int, int], int] = {}
    again: set[tuple[int, int]] = set()
    for start, end, p in all_.tolist():  # by start, end, and period
        q = good.get((start, end))
        if q and p % q == 0:
            continue
        if np.array_equal(ids[start : end - p], ids[start + p : end]):
            good.setdefault((start, end), p)
        else:
            again.add((int(np.searchsorted(bounds, start, "right")) - 1, p))
    for d, p in again:
        for start, end, _ in _stretches(ids, int(bounds[d]), int(bounds[d + 1]), p, s):
            good[start, end] = min(p, good.get((start, end), p))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(bounds) - 1)]
    for (start, end), p in sorted(good.items(), key=lambda x: (x[0][0], x[1])):
        d = int(np.searchsorted(bounds, start, "right")) - 1
        out[d].append((start - int(bounds[d]), end - start, p))
    return out


def strongest(found: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with most periods, exactly; of equals the one that starts first, then the one of the smallest period."""
    return max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)


def keep(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Of each word whether no run has it after its first period."""
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        depth[start + period] += 1
        depth[start + length] -= 1
    return np.cumsum(depth)[:n] == 0


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, strongest struct<start: long, length: long, period: long>, collapsed string"


def _batch(part: pa.RecordBatch, s: Settings) -> pa.RecordBatch:
    vocabulary: dict[bytes, int] = {}
    ids = [plant(words(t.as_py() or b"", vocabulary), d.as_py(), s.planted) for d, t in zip(part.column("doc_id"), part.column("text").cast(pa.binary()), strict=True)]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    found = runs(np.concatenate(ids), bounds, s)
    names = list(vocabulary)
    text = [b" ".join(map(names.__getitem__, (x[keep(len(x), f)] if f else x).tolist())) for x, f in zip(ids, found, strict=True)]
    as_dict = lambda r: r and dict(zip(("start", "length", "period"), r, strict=True))
    columns = [part.column("doc_id"), pa.array([len(x) for x in ids], pa.int64()), pa.array([list(map(as_dict, f)) for f in found], pa.list_(_RUN)), pa.array([as_dict(strongest(f)) for f in found], _RUN), pa.array(text, pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "runs", "strongest", "collapsed"])


def find(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_words, runs, strongest, collapsed``, a row per input row.

    Words are runs of anything but ASCII white space, as they are written. ``runs`` are ``(start, length, period)`` in words,
    by start and then period: all stretches that keep a smallest period, are at least ``least`` words and ``periods`` periods
    long, and can't be extended. ``strongest`` is the run of most periods. ``collapsed`` is the text without the words
    that repeat a run's first period, with single spaces. A null text is an empty one, which has no runs; repeated rows are
    searched each; a row without an id is told apart from none. Other columns are not looked at. An empty table gives an empty
    result. A text's memory is about a hundred bytes a word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1024):
                # an average word has six bytes; what counts is that a chunk is bounded
                size = np.array([0 if t is None else len(t) // 6 + 1 for t in part.column("text").cast(pa.binary()).to_pylist()])
                a = 0
                while a < len(size):
                    b = a + max(1, int(np.searchsorted(np.cumsum(size[a:]), TOGETHER, "right")))
                    yield _batch(part.slice(a, b - a), s)
                    a = b

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)


def lines(found: Column) -> Column:
    """Every run as ``start,length,period`` and a line feed."""
    return F.array_join(F.transform(found, lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")


def digest(found: DataFrame) -> DataFrame:
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"), best["length"].alias("length"), best["period"].alias("period"),
        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"), F.sha2(lines(F.col("runs")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
