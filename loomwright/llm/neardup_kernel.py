"""Array kernel of the near-duplicate operator: words, shingle sets, MinHash, odd sketches.

Everything here is plain numpy over one document or one small batch, so that it can be
tested without a cluster. Words are ``[^\\x20\\x09-\\x0D]+`` of the text after lower-casing
A-Z only; a shingle is ``width`` words in a row; a text of fewer words is one shingle.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_BYTE_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_SEP = _U(0xC2B2AE3D27D4EB4F)
_WS = np.zeros(256, dtype=bool)
_WS[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit reaches every output bit."""
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    x = x ^ (x >> _U(27))
    x = x * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


class _Powers:
    """Powers of the byte base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = np.ones(1, dtype=np.uint64)
        self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            base, inverse = _U(_BYTE_BASE), _U(pow(_BYTE_BASE, -1, 1 << 64))
            self.up = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, base, np.uint64)]))
            self.down = np.cumprod(np.concatenate([[_U(1)], np.full(size - 1, inverse, np.uint64)]))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hash of each word of ``data`` (UTF-8, A-Z already lower-cased), in order."""
    if not data:
        return np.empty(0, dtype=np.uint64)
    raw = np.frombuffer(data, dtype=np.uint8)
    gap = _WS[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    return span_hashes(raw.astype(np.uint64), starts, ends)


def span_hashes(symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of an array of symbols (below 2**64 - 1)."""
    up, down = _POWERS.upto(len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, dtype=np.uint64)
    np.cumsum((symbols + _U(1)) * up[: len(symbols)], out=total[1:])
    value = (total[ends] - total[starts]) * down[starts]
    return mix(value + (ends - starts).astype(np.uint64) * _MULT)


def shingle_set(data: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of one text; empty without words."""
    h = word_hashes(data)
    n = len(h)
    if not n:
        return h
    if n < width:
        acc = np.zeros(1, dtype=np.uint64)
        for x in h:
            acc = mix(acc * _SEP + x)
        return mix(acc + _U(n))
    span = n - width + 1
    acc = h[:span].copy()
    for k in range(1, width):
        acc = acc * _SEP + h[k : k + span]
    return np.unique(mix(acc))


class Sketcher:
    """MinHash samples, band keys and the odd sketch of a shingle set."""

    def __init__(self, bands: int, rows: int, samples: int, bits: int, seed: int = 20240607) -> None:
        if bands * rows > samples:
            raise ValueError("bands * rows may not exceed samples")
        if bits % 64:
            raise ValueError("bits must be a multiple of 64")
        self.bands, self.rows, self.samples, self.bits = bands, rows, samples, bits
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1 << 8, 1 << 32, samples, dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, samples, dtype=np.uint32)
        self.salt = mix(np.arange(1, samples + 1, dtype=np.uint64) * _MULT)

    def minhash(self, sets: np.ndarray, chunk: int = 1024) -> np.ndarray:
        x = (sets >> _U(32)).astype(np.uint32)
        low = np.full(self.samples, 0xFFFFFFFF, dtype=np.uint32)
        for i in range(0, len(x), chunk):
            part = x[i : i + chunk, None] * self.a[None, :]
            part += self.b
            np.minimum(low, part.min(axis=0), out=low)
        return low

    def band_keys(self, low: np.ndarray) -> np.ndarray:
        """One signed 64-bit key a band; the band's number is part of the key."""
        part = low[: self.bands * self.rows].reshape(self.bands, self.rows).astype(np.uint64)
        acc = np.arange(1, self.bands + 1, dtype=np.uint64) * _MULT
        for k in range(self.rows):
            acc = mix(acc * _SEP + part[:, k])
        return acc.view(np.int64)

    def odd_sketch(self, low: np.ndarray) -> np.ndarray:
        """Parity bitmap: each (sample number, value) toggles one bit; as signed 64-bit words."""
        at = (mix(low.astype(np.uint64) + self.salt) >> _U(33)) % _U(self.bits)
        odd = (np.bincount(at.astype(np.int64), minlength=self.bits) & 1).astype(np.uint8)
        return np.packbits(odd).view(np.int64)


def set_key(sets: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums that name a set; equal sets have equal keys."""
    if not len(sets):
        return 0, 0
    k1 = mix(sets + _SEP).sum(dtype=np.uint64)
    k2 = mix(sets ^ _MULT).sum(dtype=np.uint64)
    return int(k1.astype(np.int64)), int(k2.astype(np.int64))


def estimate(differing_bits: int, samples: int, bits: int) -> float:
    """Similarity that the XOR population count of two odd sketches stands for."""
    left = 1.0 - 2.0 * differing_bits / bits
    if left <= 0.0:
        return 0.0
    # each differing sample toggles two bits
    return max(0.0, 1.0 + bits * float(np.log(left)) / (4.0 * samples))


def most_differing_bits(similarity: float, samples: int, tail: float = 1e-9) -> int:
    """Largest XOR population count that a pair of at least ``similarity`` shows, but for ``tail``.

    The samples that differ are binomial with chance ``1 - similarity``; each toggles at most
    two bits, so twice the upper quantile bounds the count whatever the collisions are.
    """
    p, n = 1.0 - similarity, samples
    if p <= 0.0:
        return 0
    if p >= 1.0:
        return 2 * n
    logs = np.cumsum(np.log(np.arange(1, n + 1)))
    fact = np.concatenate([[0.0], logs])
    k = np.arange(n + 1)
    pmf = np.exp(fact[n] - fact[k] - fact[n - k] + k * np.log(p) + (n - k) * np.log(1 - p))
    upper = np.cumsum(pmf[::-1])[::-1]
    return 2 * int(np.flatnonzero(upper >= tail)[-1])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = len(b) - 1
    return int(np.count_nonzero(b[at] == a))
