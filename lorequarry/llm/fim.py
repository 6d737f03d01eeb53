"""Fill-in-middle transformation of documents by a byte automaton.

A table-driven automaton reads the bytes of a text once. Its states tell how many UTF-8 continuation bytes are due and how
much of a sentinel has been seen; its transitions carry marks, "a unit begins" and "a sentinel ends", which are counted
for each block of a text. Units are code points. Where to cut follows from the count, and a second pass reads only the two
blocks in which the cuts lie.

The automaton forgets: its state after any byte follows from that byte and the three before, so blocks begin three bytes
early instead of one after the other, and all blocks of a batch advance together, a byte at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ngrams import pieces
from .workspace import bound_batches, unused

#: The sentinels before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"

#: Bytes of a block.
BLOCK = 256
#: Bytes of texts that advance together; a longer text is alone.
TOGETHER = 8 << 20

# States: between units, 1 to 3 continuation bytes due, "<" seen, "<" and a sentinel's letter seen.
_GROUND, _OPEN, _LETTER, _STATES = 0, 4, 5, 6
_NEXT, _UNIT, _SENTINEL = 7, 8, 16


def automaton() -> np.ndarray:
    """``[state * 256 + byte]`` -> the next state, with the marks. A continuation byte that isn't due is a unit of its own;
    a unit that lacks some ends where the next begins."""
    t = np.zeros((_STATES, 256), np.uint8)
    for state in range(_STATES):
        for byte in range(256):
            if 0x80 <= byte < 0xC0 and 1 <= state <= 3:
                t[state, byte] = state - 1
                continue
            following = 3 if 0xF0 <= byte < 0xF8 else 2 if 0xE0 <= byte < 0xF0 else 1 if 0xC0 <= byte < 0xE0 else _GROUND
            mark = 0
            if byte == PREFIX[0]:
                following = _OPEN
            elif state == _OPEN and byte in (PREFIX[1], SUFFIX[1], MIDDLE[1]):
                following = _LETTER
            elif state == _LETTER and byte == PREFIX[2]:
                mark = _SENTINEL
            t[state, byte] = following | mark | _UNIT
    return t.ravel()


TABLE = automaton()


@dataclass(frozen=True)
class Scan:
    """What one pass counted: the first block of each text, and the units that begin in each block."""

    starts: np.ndarray  # [text + 1], in blocks
    units: np.ndarray  # [block]
    has_sentinel: np.ndarray  # [text]

    def count(self, i: int) -> int:
        return int(self.units[self.starts[i] : self.starts[i + 1]].sum())


def scan(texts: list[bytes]) -> Scan:
    raw = np.frombuffer(b"".join(texts), np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    blocks = -(-size // BLOCK)
    starts = np.concatenate([[0], np.cumsum(blocks)])
    of = np.repeat(np.arange(len(texts)), blocks)
    inside = (np.arange(starts[-1]) - starts[of]) * BLOCK
    length = np.minimum(BLOCK, size[of] - inside)
    order = np.argsort(-length, kind="stable")  # those that are still read are the first ones
    at, still = (np.cumsum(size) - size)[of][order] + inside[order], np.searchsorted(-length[order], -np.arange(BLOCK), "left")
    state = np.zeros(len(order), np.int16)
    for back in (3, 2, 1):
        early = inside[order] >= back
        state[early] = TABLE[state[early] * 256 + raw[at[early] - back]] & _NEXT
    units, ends = np.zeros(len(order), np.int32), np.zeros(len(order), bool)
    for step in range(BLOCK):
        k = still[step]
        if not k:
            break
        got = TABLE[state[:k] * 256 + raw[at[:k] + step]]
        state[:k] = got & _NEXT
        units[:k] += (got & _UNIT) != 0
        ends[:k] |= (got & _SENTINEL) != 0
    back_in_order = np.empty_like(order)
    back_in_order[order] = np.arange(len(order))
    return Scan(starts, units[back_in_order], np.bincount(of[order][ends], minlength=len(texts)) > 0)


def locate(text: bytes, units: np.ndarray, k: int) -> int:
    """The byte at which unit ``k`` begins; the text's end if it has no more than ``k``. Reads one block."""
    upto = np.cumsum(units)
    block = int(np.searchsorted(upto, k, "right"))
    if block == len(units):
        return len(text)
    seen, state = int(upto[block]) - int(units[block]), _GROUND
    for i in range(max(0, block * BLOCK - 3), len(text)):
        got = int(TABLE[state * 256 + text[i]])
        state = got & _NEXT
        if got & _UNIT and i >= block * BLOCK:
            if seen == k:
                return i
            seen += 1
    return len(text)


@dataclass(frozen=True)
class Settings:
    seed: int = 1
    #: Of a hundred documents as many are transformed, and of a hundred of these as many have the suffix first.
    percent: int = 90
    suffix_first: int = 20


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits from a SHA-256 of seed and id; an absent id is an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def transform_texts(texts: list[bytes], ids: list[int | None], s: Settings) -> list[tuple[int, str, int | None, int | None, bytes]]:
    """For each text its units, form, units of prefix and middle, and the output."""
    out, seen = [], scan(texts)
    for i, (text, doc_id) in enumerate(zip(texts, ids, strict=True)):
        n, (h1, h2, h3, h4) = seen.count(i), draws(s.seed, doc_id)
        if not text or seen.has_sentinel[i] or h3 % 100 >= s.percent:
            out.append((n, "plain", None, None, text))
            continue
        a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
        units = seen.units[seen.starts[i] : seen.starts[i + 1]]
        x, y = locate(text, units, a), locate(text, units, b)
        prefix, middle, suffix = text[:x], text[x:y], text[y:]
        if h4 % 100 < s.suffix_first:
            out.append((n, "spm", a, b - a, b"".join((SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle))))
        else:
            out.append((n, "psm", a, b - a, b"".join((PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle))))
    return out


_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def transform(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``docs(doc_id, text)`` -> ``doc_id, n, form, prefix_chars, middle_chars, output``, a row per input row.

    ``form`` is psm (prefix, suffix, middle), spm (suffix, prefix, middle) or plain, which is the text as it is: that is so for an
    empty text, for one that contains a sentinel, and for the share of documents that isn't to be transformed. What is
    drawn depends on seed and doc_id alone, so reruns agree and repeated rows fare alike; rows without an id all draw the
    same. A null text is an empty one. Counts are code points, null if plain. Other columns are not looked at. An empty table
    gives an empty result. One text at a time is in memory, a few times, besides its batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        for batch in batches:
            for part in pieces(batch, 1024):
                texts, ids = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()], part.column("doc_id").to_pylist()
                a = 0
                while a < len(texts):
                    b, size = a + 1, len(texts[a])
                    while b < len(texts) and size + len(texts[b]) <= TOGETHER:
                        size += len(texts[b])
                        b += 1
                    cols = list(zip(*transform_texts(texts[a:b], ids[a:b], s), strict=True))
                    arrays = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").slice(a, b - a), *arrays[:4], arrays[4].cast(pa.string())], names=names)
                    a = b

    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that was transformed, from output and form alone. No part holds a sentinel, so the first of each is ours."""
    p, s, m = (x.decode() for x in (PREFIX, SUFFIX, MIDDLE))
    psm = F.regexp_replace(output, f"(?s)^{p}(.*?){s}(.*?){m}(.*)$", "$1$3$2")
    spm = F.regexp_replace(output, f"(?s)^{s}(.*?){p}(.*?){m}(.*)$", "$2$3$1")
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def restore(transformed: DataFrame) -> DataFrame:
    """``transformed`` with the rebuilt text as a further column ``restored``, under another name if that is taken."""
    return transformed.withColumn(unused("restored", transformed), restored(F.col("output"), F.col("form")))


def digest(transformed: DataFrame) -> DataFrame:
    back = restored(F.col("output"), F.col("form"))
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
