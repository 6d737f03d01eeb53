"""MinHash near-duplicate detection with odd sketches.

The signature of a document's shingle set is banded for candidates and folded into a parity bitmap, an odd sketch. The
population count of the XOR of two bitmaps estimates how many samples differ, most exactly where similarity is high;
candidates that it lets pass are confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linking import components, stars
from .ngrams import chunks, pieces
from .sketching import bands, minhash, most_bits, odd_sketch, word_shingles
from .workspace import Workspace, large, lean, nonempty, small, unused


@dataclass(frozen=True)
class Settings:
    #: words of a shingle, and the least similarity of a link in hundredths
    width: int = 5
    percent: int = 80
    #: A pair at the least similarity shares no band with probability (1 - s ** rows) ** bands: 1e-4 at 0.8, 3e-7 at 0.85.
    rows: int = 6
    bands: int = 32
    sketch_bits: int = 512

    @property
    def samples(self) -> int:
        return self.rows * self.bands


#: What the contract of the query asks for.
CONTRACT = Settings(width=3, percent=85)

_SIGNED = "doc_id long, n_shingles long, digest binary, bands binary, sketch binary"


def sign(docs: DataFrame, s: Settings) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1024):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                for a, b in chunks(texts):
                    sets = list(word_shingles(texts[a:b], s.width))
                    full = [i for i, x in enumerate(sets) if len(x)]
                    band: list[bytes | None] = [None] * len(sets)
                    sketch: list[bytes | None] = [None] * len(sets)
                    if full:
                        elements = np.concatenate([sets[i] for i in full])
                        starts = np.cumsum([0] + [len(sets[i]) for i in full[:-1]])
                        sig = minhash((elements >> np.uint64(32)).astype(np.uint32), starts, s.samples)
                        for i, x, y in zip(full, bands(sig, s.rows), odd_sketch(sig, s.sketch_bits), strict=True):
                            band[i], sketch[i] = x.tobytes(), y.tobytes()
                    digest = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets]
                    cols = [part.column("doc_id").slice(a, b - a), pa.array([len(x) for x in sets], pa.int64()), *[pa.array(c, pa.binary()) for c in (digest, band, sketch)]]
                    yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_shingles", "digest", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), _SIGNED)


def _sets(docs: DataFrame, s: Settings) -> DataFrame:
    """``docs(id, sketch, text)`` -> ``id, sketch, payload``, the packed hashes of the full set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1024):
                texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
                for a, b in chunks(texts):
                    items = [x.tobytes() for x in word_shingles(texts[a:b], s.width)]
                    yield pa.RecordBatch.from_arrays([part.column("id").slice(a, b - a), part.column("sketch").slice(a, b - a), pa.array(items, pa.binary())], names=["id", "sketch", "payload"])

    return docs.mapInArrow(lean(run), "id long, sketch binary, payload binary")


def unpack(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(payloads), np.uint64), np.fromiter(map(len, payloads), np.int64, len(payloads)) // 8


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n_shingles, component_id, kept``, a row per input row.

    Words are runs of anything but ASCII white space, with A-Z lowered; the set of a document holds its distinct
    ``width``-word shingles, or its whole sequence if it has fewer words. A null text or one without words has an empty
    set and is linked with nothing. Equal sets form one class, of which one member is banded and compared, so copies are
    never paired. ``component_id`` is the smallest doc_id that can be reached over links. Rows that share a doc_id are one
    document: it is linked if one of its rows is. A row without a doc_id has no component and is kept. Other columns are
    not looked at. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    ws = Workspace(spark, "neardup")
    signed = ws.save(sign(docs, s), "signed")
    classes = signed.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    classes = ws.save(classes, "classes")
    star = stars(ws, classes, s.bands)
    bits = most_bits(s.percent / 100, s.samples, s.sketch_bits)
    candidates = ws.save(star.select(F.col("hub").alias("id")).unionByName(star.select("id")).distinct(), "candidates")
    wanted = ws.save(classes.select("id", "sketch").join(large(candidates), "id"), "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string")).join(small(wanted, 24 + s.sketch_bits // 8), "id")
    sets = ws.save(_sets(texts.select("id", "sketch", "text"), s), "sets")

    comp = components(ws, star, sets, unpack, s.percent, bits)
    ws.forget(star, candidates, wanted, sets)
    # rows of a class share its digest; its smallest id is the node
    node = classes.select("digest", F.col("id").alias("own"))
    moved = comp.where("node <> component")
    node = node.join(large(moved), F.col("own") == F.col("node"), "left").select("digest", F.coalesce("component", "own").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", "digest").join(large(node), "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs``, with all their columns, of one document of each component: that of the smallest doc_id.

    Rows that repeat a doc_id and its text become one; rows without a doc_id stay.
    """
    ws = Workspace(docs.sparkSession, "neardup-keep")
    found = ws.save(near_duplicates(docs, s), "found")
    gone = unused("_lost", docs)
    lost = ws.save(found.where("not kept").select(F.col("doc_id").alias(gone)).distinct(), "lost")
    kept = docs.join(small(lost, 16), F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    if nonempty(found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")):
        kept = kept.where("doc_id is null").unionByName(kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]))
    return kept
