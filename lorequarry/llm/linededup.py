"""Fuzzy line deduplication over all documents.

Every line gets a MinHash signature of its character shingles. Bands of it give candidates, exact Jaccard similarity on
the shingles of both lines confirms them, and distributed union-find forms components, of which one line stays. Equal
lines are one item from the start, so copies cost a count and not a pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from . import workspace
from .linking import components, stars
from .ngrams import pieces
from .sketching import bands, minhash, mix64, most_bits, odd_sketch
from .workspace import Workspace, large, lean, plain_names, unused


@dataclass(frozen=True)
class Settings:
    #: characters of a shingle, and the least similarity of two lines in hundredths
    width: int = 7
    percent: int = 80
    #: A pair at 0.8 shares no band with probability 0.002, at 0.85 with 1e-4, at 0.9 with 2e-6.
    rows: int = 4
    bands: int = 12
    sketch_bits: int = 256

    @property
    def samples(self) -> int:
        return self.rows * self.bands


#: Characters that one numpy step works on, besides a longer single line.
CHUNK_CHARS = 1 << 16
#: Lines of a task that are remembered so as not to be signed twice.
REMEMBERED = 200_000


def key_of(line: str) -> str:
    """What two lines are compared by: lower case, without white space at either end. A line with an empty key is blank."""
    return line.strip().lower()


def line_digest(key: str) -> bytes:
    """128 bits: what makes lines equal."""
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))


def _halves(digests: list[bytes]) -> np.ndarray:
    """``[line, 2]`` as signed numbers: the id of a line, and what tells lines of one id apart."""
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def expand(payloads: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of lines in UTF-8 as 64-bit hashes, line after line, and how many each has; a line that is shorter than a
    shingle is one."""
    keys = [p.decode("utf-8", "surrogatepass") for p in payloads]
    chars, lengths, inside = _joined(keys, width)
    n = len(chars) - width + 1
    wide = chars.astype(np.uint64)
    h = wide[:n].copy()
    for j in range(1, width):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += wide[j : j + n]
    h = mix64(h[inside[:n]])
    counts = lengths - width + 1
    size = np.fromiter(map(len, keys), np.int64, len(keys))
    short = np.flatnonzero(size < width)  # what they are padded with is no character of theirs
    h[(np.cumsum(counts) - counts)[short]] ^= mix64(size[short].astype(np.uint64) + np.uint64(1))
    return h, counts


def _joined(keys: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all keys, padded to a shingle at least; their lengths; and where shingles begin."""
    part = [k if len(k) >= width else k + "\0" * (width - len(k)) for k in keys]
    chars = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, part), np.int64, len(part))
    inside = np.ones(len(chars), bool)
    inside[(np.cumsum(lengths)[:, None] - np.arange(1, width)).ravel()] = False
    return chars, lengths, inside


def signatures(keys: list[str], s: Settings) -> np.ndarray:
    """``[line, sample]``; keys aren't empty. A key shorter than a shingle is padded and so is one shingle."""
    w = s.width
    out = np.empty((len(keys), s.samples), np.uint32)
    first = 0
    while first < len(keys):
        last, size = first, 0
        while last < len(keys) and (last == first or size + len(keys[last]) <= CHUNK_CHARS):
            size += max(w, len(keys[last]))
            last += 1
        chars, lengths, inside = _joined(keys[first:last], w)
        n = len(chars) - w + 1
        h = chars[:n].copy()
        for j in range(1, w):
            h *= np.uint32(0x01000193)
            h += chars[j : j + n]
        h = h[inside[:n]]
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        counts = lengths - w + 1
        out[first:last] = minhash(h, np.cumsum(counts) - counts, s.samples)
        first = last
    return out


_LINES = "doc_id long, line_no int, id long, other long, bands binary"


def sign(docs: DataFrame, s: Settings) -> DataFrame:
    """The lines of ``docs(doc_id, text)`` that aren't blank; ``bands`` is null where the task has signed an equal line."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in pieces(batch, 256):
                doc, no, ids, at, keys = [], [], [], [], []
                for d, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for i, line in enumerate((text or "").split("\n")):
                        if key := key_of(line):
                            x = line_digest(key)
                            if x not in seen:
                                if len(seen) >= REMEMBERED:
                                    seen.clear()
                                seen.add(x)
                                at.append(len(ids))
                                keys.append(key)
                            doc.append(d)
                            no.append(i)
                            ids.append(x)
                if not ids:
                    continue
                fresh = np.zeros(len(ids), bool)
                fresh[at] = True
                ends, band = np.cumsum(np.append(0, fresh * (8 * s.bands))), b""
                if keys:
                    band = bands(signatures(keys, s), s.rows).tobytes()
                half = _halves(ids)
                band = pa.Array.from_buffers(pa.binary(), len(ids), [pa.py_buffer(np.packbits(fresh, bitorder="little")), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(band)])
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(no, pa.int32()), pa.array(half[:, 0]), pa.array(half[:, 1]), band], names=["doc_id", "line_no", "id", "other", "bands"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("doc_id is not null and text is not null").mapInArrow(lean(run), _LINES)


def _fetch(rows: DataFrame, s: Settings) -> DataFrame:
    """``rows(text, lines)`` of ``_with_lines`` -> ``id, sketch, payload`` of the lines asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 256):
                found = {}
                for text, lines in zip(part.column("text").to_pylist(), part.column("lines").to_pylist(), strict=True):
                    for _, x, key in _listed(lines, text.split("\n")):
                        found[x] = key
                keys = list(found.values())
                sketch = [x.tobytes() for x in odd_sketch(signatures(keys, s), s.sketch_bits)] if keys else []
                yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.int64()), pa.array(sketch, pa.binary()), pa.array([k.encode("utf-8", "surrogatepass") for k in keys], pa.binary())], names=["id", "sketch", "payload"])

    return rows.select("text", "lines").mapInArrow(lean(run), "id long, sketch binary, payload binary")


#: Heap of a broadcast row besides the numbers of its array, and bits of the filter a listed document, and in all at most.
ROW_BYTES, FILTER_BITS, MOST_BITS = 128, 16, 1 << 27


def _maybe(docs: DataFrame, doc_ids: DataFrame, n: int, name: str) -> DataFrame:
    """``docs`` with a boolean ``name``: true for those in ``doc_ids(doc)``, of which there are ``n``, and for few others.

    The filter has a bit a hash value, in maps of 4 KB that are broadcast: two bytes a listed document, and never more than
    16 MB in all.
    """
    space = min(FILTER_BITS * n, MOST_BITS)
    bit = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(space))
    bucket, bits = unused("_bucket", docs), unused("_bits", docs)
    maps = doc_ids.select(bit(F.col("doc")).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias(bits))
    at = F.bitmap_bit_position(bit(F.col("doc_id")))
    byte = F.conv(F.hex(F.substring(F.col(bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.col("doc_id").cast("long").isNotNull() & (F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1)
    joined = docs.join(F.broadcast(maps), F.bitmap_bucket_number(bit(F.col("doc_id"))) == F.col(bucket), "left")
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], F.coalesce(hit, F.lit(False)).alias(name))


def _with_lines(ws: Workspace, docs: DataFrame, lines: DataFrame, how: str, name: str) -> DataFrame:
    """``docs`` joined with ``lines(doc_id, line_no, id)`` as an array ``name`` by document, of numbers that hold the line's
    place and half of its id. The arrays are broadcast if their counted size is small; else both sides are shuffled, but
    of the documents only those that a filter lets pass, so that texts without such lines stay where they are."""
    packed = F.shiftleft(F.col("line_no").cast("long"), 32).bitwiseOR(F.col("id").bitwiseAND(F.lit(0xFFFFFFFF)))
    doc = unused("_doc", docs)
    by_doc = ws.save(lines.groupBy(F.col("doc_id").alias(doc)).agg(F.collect_set(packed).alias(name)), "by_doc")
    n, size = by_doc.agg(F.count("*"), F.coalesce(F.sum(F.size(name) * 8 + ROW_BYTES), F.lit(0))).first()
    same = F.col("doc_id").cast("long") == F.col(doc)
    if size <= workspace.BROADCAST_BYTES:
        return docs.join(F.broadcast(by_doc), same, how).drop(doc)
    maybe = unused("_maybe", docs)
    marked = _maybe(docs, by_doc.select(F.col(doc).alias("doc")), n, maybe)
    out = marked.where(F.col(maybe)).drop(maybe).join(large(by_doc), same, how).drop(doc)
    if how == "inner":
        return out
    return out.unionByName(marked.where(~F.col(maybe)).drop(maybe).withColumn(name, F.lit(None).cast(by_doc.schema[name].dataType)))


def _listed(lines: list[int] | None, split: list[str]) -> Iterator[tuple[int, int, str]]:
    """Place, id and key of the listed lines that are there."""
    for x in lines or ():
        no = x >> 32
        if no < len(split) and (key := key_of(split[no])):
            found = int(_halves([line_digest(key)])[0, 0])
            if found & 0xFFFFFFFF == x & 0xFFFFFFFF:
                yield no, found, key


#: A line that makes up more than this share of all, and stands more than this many times, is joined by broadcast: there
#: are fewer than 1 / share such lines.
HOT_SHARE, HOT_TIMES = 1e-3, 1000


def decide(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """``docs(doc_id, text)`` -> written ``lines(doc_id, line_no, id)`` of all lines that aren't blank, and written
    ``removed(doc_id, line_no, id)``.

    Of each component of similar lines the occurrence with the smallest (doc_id, line_no) stays. Rows without a doc_id
    or text take no part. Lines of equal number in rows that share a doc_id are one occurrence if they are equal. Lines are
    equal if 128 bits of hash are; of lines that share an id, its first half, all but those of one stay as they are.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "lines")
    signed = ws.save(sign(docs, s), "signed")
    star = stars(ws, signed.where("bands is not null"), s.bands)
    signed, banded = ws.save(signed.drop("bands"), "lines"), signed
    ws.forget(banded)
    first = signed.groupBy("id").agg(F.min(F.struct("other", "doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    near = ws.save(star.select(F.col("hub").alias("id")).unionByName(star.select("id")).distinct(), "near")
    items = ws.save(first.join(large(near.withColumn("near", F.lit(True))), "id", "left").where("near or n > 1"), "items")
    wanted = ws.save(items.where("near").select("first.doc_id", "first.line_no", "id"), "wanted")
    texts = ws.save(_fetch(_with_lines(ws, docs.select("doc_id", F.col("text").cast("string")), wanted, "inner", "lines"), s).dropDuplicates(["id"]), "texts")
    bits = most_bits(s.percent / 100, s.samples, s.sketch_bits)

    comp = components(ws, star, texts, partial(expand, width=s.width), s.percent, bits)
    ws.forget(star, near, wanted, texts)
    items = items.join(large(comp), F.col("id") == F.col("node"), "left").select("id", "first", "n", F.coalesce("component", "id").alias("component"))
    place = F.struct("first.doc_id", "first.line_no")
    stays = items.groupBy("component").agg(F.min(place).alias("stays"), F.sum("n").alias("all")).where(F.col("all") > 1)
    items = ws.save(items.join(large(stays), "component").select("id", F.col("first.other").alias("same"), "n", "stays"), "repeated")
    lines = signed.select("doc_id", "line_no", "id", "other")
    hot = F.broadcast(items.where(F.col("n") > max(HOT_TIMES, int(lines.count() * HOT_SHARE))))
    joined = lines.join(hot, "id").unionByName(lines.join(hot.select("id"), "id", "left_anti").join(large(items), "id"))
    removed = joined.where((F.col("other") == F.col("same")) & (F.struct("doc_id", "line_no") != F.col("stays"))).select("doc_id", "line_no", "id")
    return lines.drop("other"), ws.save(removed.distinct(), "removed")


def dedup(docs: DataFrame, s: Settings = Settings(), drop_empty: bool = False, counts: bool = True) -> DataFrame:
    """``docs`` with all its columns, without the lines that ``decide`` removes, and with ``n_lines`` and ``n_removed``.

    ``n_lines`` counts the lines that weren't blank. Columns of these names are replaced; without ``counts`` they stay, and
    none is added. ``n_chars``, if it is there as a number, is set anew where the text changed. A document that loses its
    last line has the text ``''``; with ``drop_empty`` it goes. A null text stays null. Other rows pass through as they
    are. An empty table gives an empty result.
    """
    _, removed = decide(docs, s)
    if counts:
        docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("n_lines", "n_removed")])
    names_out = [*docs.columns, *(("n_lines", "n_removed") if counts else ())]
    docs = plain_names(docs, "doc_id", "text", "n_chars")
    out = docs.columns
    number = "n_chars" in out and docs.schema["n_chars"].dataType.typeName() in ("integer", "long")
    listed = unused("lines", docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 512):
                texts, found, gone, sizes, keep = [], [], [], [], []
                given = part.column("n_chars").to_pylist() if number else [None] * part.num_rows
                for text, lines, n in zip(part.column("text").to_pylist(), part.column(listed).to_pylist(), given, strict=True):
                    split = (text or "").split("\n")
                    drop = {no for no, _, _ in _listed(lines, split)}
                    found.append(sum(1 for x in split if x.strip()) if counts else 0)
                    if drop:
                        text = "\n".join(x for i, x in enumerate(split) if i not in drop)
                        if not text.strip():
                            text = ""
                        n = len(text)
                    texts.append(text)
                    gone.append(len(drop))
                    sizes.append(n)
                    keep.append(not (drop_empty and drop and not text))
                cols = dict(zip(part.schema.names, part.columns, strict=True))
                cols["text"] = pa.array(texts, pa.string())
                if number:
                    cols["n_chars"] = pa.array(sizes, cols["n_chars"].type)
                arrays, names = [cols[c] for c in out], list(out)
                if counts:
                    arrays, names = arrays + [pa.array(found, pa.int64()), pa.array(gone, pa.int64())], [*names, "n_lines", "n_removed"]
                yield pa.RecordBatch.from_arrays(arrays, names=names).filter(pa.array(keep, pa.bool_()))

    schema = StructType([*docs.schema.fields, *([StructField("n_lines", LongType()), StructField("n_removed", LongType())] if counts else [])])
    return _with_lines(Workspace(docs.sparkSession, "lines-out"), docs, removed, "left", listed).mapInArrow(lean(run), schema).toDF(*names_out)
