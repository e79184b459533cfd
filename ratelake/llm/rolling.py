"""Rolling hashes over bytes as whole-array arithmetic modulo 2**64."""

from __future__ import annotations

import functools

import numpy as np

#: Bytes handled at once; longer texts go through in pieces, so that memory has a bound.
PIECE = 1 << 20
_U = np.uint64


@functools.cache
def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd multiplier and of its inverse."""
    base = int(np.random.default_rng(seed).integers(1 << 62, 1 << 63)) | 1
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, _U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads every bit over the word."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Digests:
    """Digests of substrings of ``data`` (at most 2 * PIECE bytes), from two cumulative sums."""

    def __init__(self, data: np.ndarray, seed: int = 1) -> None:
        self.up, self.down = _powers(seed, 2 * PIECE)
        sums = np.cumsum((data.astype(_U) + _U(1)) * self.up[: len(data)], dtype=_U)
        self.sums = np.concatenate((np.zeros(1, _U), sums))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(_U) * _U(0x9E3779B97F4A7C15))

    def windows(self, size: int) -> np.ndarray:
        """Digest of the ``size`` bytes from each position."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n]) if n > 0 else np.zeros(0, _U)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each ``width`` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[: len(x) - have], x[have:])
        have *= 2
    more = width - have
    return np.minimum(x[: len(x) - more], x[more:]) if more else x


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")
