"""Hashes of words and of word sequences of whole texts, for many texts at once in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Bytes of UTF-8 that separate words: space and 0x09 to 0x0D.
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
#: Bytes hashed together, about.
PART_BYTES = 1 << 19


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads all bits."""
    x = x + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: A second base, for hashes that are independent of the first one's.
_BASES = (_BASE, 0x2545F4914F6CDD1D)
_POWERS = [[np.ones(1, np.uint64), np.ones(1, np.uint64)] for _ in _BASES]


def powers(n: int, base: int = 0) -> list[np.ndarray]:
    """The first n powers of a base and of its inverse; kept for the next call."""
    own = _POWERS[base]
    if len(own[0]) < n:
        for i, b in enumerate((_BASES[base], pow(_BASES[base], -1, 1 << 64))):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            own[i] = np.cumprod(p)
    return own


@dataclass
class Words:
    """Words of several texts: 64-bit hash, first byte and the byte after the last in the text; text i has words cut[i] to cut[i + 1]."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    cut: np.ndarray


def words(raw: list[bytes], lower: bool) -> Words:
    flat = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    if lower:
        flat = _LOWER[flat]
    space = _SPACE[flat]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(flat) and not space[0]:
        edge = np.r_[0, edge]
    begin, end = edge[::2], edge[1::2]
    up, down = powers(len(flat) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(_BYTE[flat] * up[: len(flat)])]
    hashes = mix((sums[end] - sums[begin]) * down[begin])
    starts = np.cumsum([0, *(len(x) + 1 for x in raw)])
    cut = np.searchsorted(begin, starts)
    base = np.repeat(starts[:-1], np.diff(cut))
    return Words(hashes, begin - base, end - base, cut)


def combined(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` neighbours; shorter by width - 1."""
    n = len(hashes) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        out = mix(out ^ hashes[k : k + len(out)], width + k)
    return out


def shingle_sets(raw: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Per text the ascending distinct hashes of its lower-cased ``width``-word shingles; all words as one if there are fewer."""
    w = words(raw, True)
    grams = combined(w.hashes, width)
    for a, b in zip(w.cut[:-1].tolist(), w.cut[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(grams[a : b - width + 1].view(np.int64))
        elif b > a:
            yield combined(w.hashes[a:b], b - a).view(np.int64)
        else:
            yield np.empty(0, np.int64)


def byte_parts(texts) -> Iterator[list[bytes]]:
    """Texts as UTF-8 (null: empty) in lists of about PART_BYTES."""
    part, size = [], 0
    for t in texts:
        part.append(t.encode() if isinstance(t, str) else b"")
        size += len(part[-1])
        if size > PART_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part
