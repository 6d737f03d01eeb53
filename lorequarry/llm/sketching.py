"""MinHash signatures and odd sketches with numpy, for many sets at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np

_SEED = 20240517


def mix64(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x7FB5D329728EA185)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def permutations(k: int) -> np.ndarray:
    """Odd multipliers: ``k`` maps of 32-bit numbers onto themselves."""
    return np.random.default_rng(_SEED).integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minhash(elements: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Signatures ``[set, k]`` of the sets ``elements[starts[i]:starts[i + 1]]``, none of them empty; the elements are mixed
    32-bit numbers."""
    out, hashed = np.empty((k, len(starts)), np.uint32), np.empty_like(elements)
    for j, a in enumerate(permutations(k)):
        np.multiply(elements, a, out=hashed)
        np.minimum.reduceat(hashed, starts, out=out[j])
    return np.ascontiguousarray(out.T)


def bands(signatures: np.ndarray, rows: int) -> np.ndarray:
    """64-bit keys ``[set, band]``; bands differ in their seed, so keys of different bands don't meet."""
    n, k = signatures.shape
    out = np.empty((n, k // rows), np.uint64)
    for j in range(k // rows):
        acc = np.full(n, (j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF, np.uint64)
        for r in range(rows):
            acc = mix64(acc ^ signatures[:, j * rows + r].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        out[:, j] = acc
    return out


def odd_sketch(signatures: np.ndarray, bits: int) -> np.ndarray:
    """Parity bitmaps ``[set, bits / 8]``: each (place, sample) flips one bit."""
    n, k = signatures.shape
    salt = mix64(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    at = (mix64(signatures.astype(np.uint64) + salt) % np.uint64(bits)).astype(np.int64)
    at += np.arange(n, dtype=np.int64)[:, None] * bits
    parity = (np.bincount(at.ravel(), minlength=n * bits) & 1).astype(np.uint8)
    return np.packbits(parity.reshape(n, bits), axis=1)


def most_bits(similarity: float, k: int, bits: int, sigmas: float = 4.5) -> int:
    """Largest symmetric difference of two odd sketches that a pair of at least ``similarity`` may show.

    The number of unequal samples is binomial; ``sigmas`` standard deviations above its mean still pass, as do some bits
    more for flips that meet less often than they do on average. A pair that fails is below the similarity but for a
    chance of about one in a hundred thousand.
    """
    unequal = k * (1 - similarity) + sigmas * math.sqrt(k * similarity * (1 - similarity))
    flips = 2 * unequal
    expected = bits / 2 * (1 - (1 - 2 / bits) ** flips)
    return math.ceil(expected + 2 * flips / math.sqrt(bits))


def estimate(difference: int, k: int, bits: int) -> float:
    """Jaccard similarity from the population count of the XOR of two odd sketches."""
    share = min(2 * difference / bits, 1 - 1e-9)
    return max(0.0, 1 + bits / (4 * k) * math.log(1 - share))


def xor_counts(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Population counts ``[len(a), len(b)]`` of the XOR of packed bitmaps."""
    a, b = np.ascontiguousarray(a).view(np.uint64), np.ascontiguousarray(b).view(np.uint64)
    out = np.zeros((len(a), len(b)), np.uint16)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, w, None] ^ b[None, :, w])
    return out


# Words, hashed by position-free polynomials over the bytes of a chunk.

_POWER = 0x5851F42D4C957F2D
_INVERSE = pow(_POWER, -1, 1 << 64)
_tables: dict[str, np.ndarray] = {}
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_tables.get("p", ())):
        size = 1 << max(19, n.bit_length())
        for name, base in (("p", _POWER), ("q", _INVERSE)):
            t = np.full(size, base, np.uint64)
            t[0] = 1
            _tables[name] = np.cumprod(t, dtype=np.uint64)
    return _tables["p"][:n], _tables["q"][:n]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, with A-Z lowered, and the words' bounds of each text, ``[len + 1]``.

    Words are maximal runs of bytes other than space and the five control characters from tab to carriage return.
    """
    joined = b" ".join(texts).translate(_LOWER) + b" "
    raw = np.frombuffer(joined, np.uint8)
    gap = _SPACE[raw]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(raw) and not gap[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    p, q = _powers(len(raw))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * p, dtype=np.uint64)])
    words = mix64((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return words, np.searchsorted(starts, offsets)


def word_shingles(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The distinct ``width``-word shingles of each text as sorted 64-bit hashes; of a shorter text its whole sequence."""
    words, bounds = word_hashes(texts)
    n = len(words)
    seeds = [np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) for i in range(width)]
    whole = np.zeros(max(0, n - width + 1), np.uint64)
    for i in range(width):
        whole = mix64(whole ^ (words[i : n - width + 1 + i] * seeds[i])) if n >= width else whole
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= width:
            yield np.unique(whole[a : b - width + 1])
        elif b > a:
            acc = np.array([b - a], np.uint64)
            for i in range(b - a):
                acc = mix64(acc ^ (words[a + i : a + i + 1] * seeds[i]))
            yield acc
        else:
            yield np.zeros(0, np.uint64)
