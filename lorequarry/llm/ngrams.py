"""Hashed character n-grams of letters, counted for many texts at once with numpy."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa

#: Characters that one numpy step works on, besides a longer single text.
CHUNK_CHARS = 1 << 17

# Odd multipliers, one for each n-gram length, and one between the characters of an n-gram.
_MULTIPLIER = {n: np.uint32((0x9E3779B1 + 0x61C88646 * n | 1) & 0xFFFFFFFF) for n in range(1, 9)}
_BETWEEN = np.uint32(0x85EBCA6B)
_SPACE = np.uint32(32)
#: From here on there are no letters or marks but the variation selectors, which are left out.
_LETTERS_END = 0x32000


@cache
def _letters() -> np.ndarray:
    """Of each code point whether it is a letter or a mark; all others part words."""
    found = np.zeros(_LETTERS_END + 1, bool)
    for i in range(_LETTERS_END):
        found[i] = unicodedata.category(chr(i))[0] in "LM"
    return found


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text or "")


def chunks(texts: Sequence[str | bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK_CHARS``."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t) + 8
        if size >= CHUNK_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def pieces(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


class Grams:
    """The texts of one chunk in lower case, with runs of anything but letters as one space, each text between spaces so
    that n-grams see where words begin and end."""

    def __init__(self, texts: Sequence[str], longest: int):
        low = [t.lower() for t in texts]
        lengths = np.fromiter(map(len, low), np.int64, len(low)) + 1
        raw = np.frombuffer(("\0".join(low) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[np.minimum(raw, _LETTERS_END)]
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        whose = np.repeat(np.arange(len(low)), lengths)[kept]
        self.lengths = np.bincount(whose, minlength=len(low)) + 1 + longest
        self.offsets = np.append(0, np.cumsum(self.lengths))
        self.starts, self.total = self.offsets[:-1], int(self.offsets[-1])
        self.chars = np.full(self.total + longest, _SPACE)
        self.chars[np.arange(len(whose)) + 1 + (1 + longest) * whose] = np.where(letter, raw, _SPACE)[kept]

    def codes(self, n: int) -> np.ndarray:
        """A 32-bit number of each n-gram."""
        code = self.chars[: self.total].copy()
        for k in range(1, n):
            code *= _BETWEEN
            code ^= self.chars[k : self.total + k]
        return code

    def hashed(self, n: int, bits: int) -> np.ndarray:
        code = self.codes(n) * _MULTIPLIER[n]
        code ^= code >> np.uint32(15)
        code *= np.uint32(0x2C1B3C6D)
        return (code >> np.uint32(32 - bits)).astype(np.int64)

    def real(self) -> np.ndarray:
        """Whether the n-gram has a letter in its first place or begins a word: else it lies in the padding."""
        return (self.chars[: self.total] != 32) | (self.chars[1 : self.total + 1] != 32)
