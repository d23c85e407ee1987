"""Vectorised text kernels: bytes of many texts at once, words, word and window hashes.

Hashes are 64 bits wide and depend on nothing but the bytes hashed. Texts are handled
in slices of a few MB, so that memory stays bounded whatever a batch or a text holds.
"""

from __future__ import annotations

import contextlib
import ctypes
import sys
from collections.abc import Iterator, Sequence

import numpy as np

_RNG = np.random.default_rng(20240229)
TABLE = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) << np.uint64(1) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15 | 5
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SLICE = 1 << 20

#: glibc raises the size from which it maps blocks by themselves as such blocks are freed, and then keeps
#: what workers free; fixed sizes (M_MMAP_THRESHOLD, M_TRIM_THRESHOLD) give memory back between groups.
if sys.platform == "linux":
    with contextlib.suppress(OSError, AttributeError):
        for option, size in ((-3, 4 << 20), (-1, 16 << 20)):
            ctypes.CDLL(None).mallopt(option, size)

_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, np.ndarray] = {}


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. n (modulo 2 ** 64), kept for later calls."""
    have = _POWERS.get(base)
    if have is None or len(have) <= n:
        steps = np.full(max(n + 1, SLICE + SLICE // 4), base, np.uint64)
        steps[0] = 1
        have = _POWERS[base] = np.cumprod(steps, dtype=np.uint64)
    return have[: n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others (a bijection)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """h with h[i] = sum of TABLE[data[j]] * BASE ** j over j < i; see span_hash."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(TABLE[data] * powers(BASE, len(data))[: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end] for arrays of places."""
    inverse = powers(BASE_INVERSE, len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


def slices(texts: Sequence[bytes], size: int = SLICE) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts of about size bytes in all; a longer text is a run by itself."""
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t) > size:
            yield begin, i
            begin, held = i, 0
        held += len(t) + 1
    if begin < len(texts):
        yield begin, len(texts)


def words(texts: Sequence[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, offsets): the words of text i are hash[offsets[i]:offsets[i + 1]]."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    if lower:
        data = _LOWER[data]
    space = _SPACE[data]
    edge = np.empty(len(data), bool)
    if len(data):
        edge[0] = not space[0]
        np.not_equal(space[1:], space[:-1], out=edge[1:])
    at = np.flatnonzero(edge)
    start, end = at[0::2], at[1::2]
    hashes = span_hash(prefix_hash(data), start, end) if len(start) else np.zeros(0, np.uint64)
    ends = np.cumsum([len(t) + 1 for t in texts]) if len(texts) else np.zeros(0, np.int64)
    return hashes, np.concatenate([[0], np.searchsorted(start, ends)]).astype(np.int64)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of hashes[i : i + n] for every i with n hashes from it on."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total += hashes[j : j + m] * np.uint64((0xC2B2AE3D27D4EB4F * (2 * j + 1) + (j << 33)) % (1 << 64) | 1)
    return mix(total)


def word_sets(texts: Sequence[bytes], n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text; of fewer words, one of them all."""
    out: list[np.ndarray] = []
    for a, b in slices(texts):
        hashes, offsets = words(texts[a:b])
        shingles = windows(hashes, n)
        for i in range(b - a):
            lo, hi = offsets[i], offsets[i + 1]
            if hi - lo >= n:
                out.append(np.unique(shingles[lo : hi - n + 1]))
            elif hi > lo:
                out.append(mix(windows(hashes[lo:hi], hi - lo) + np.uint64(hi - lo)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out
