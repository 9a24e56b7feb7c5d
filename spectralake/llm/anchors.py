"""Content-defined phrases of a sequence of 64-bit symbols (bytes or word hashes).

Rolling hashes of ``seed`` symbols trigger: the least hash among the seeds of a window is the window's anchor, so equal
windows have equal anchors at equal places, and every anchor owns one run of window starts. The stretch of text that the
windows of one anchor cover is a phrase.
"""

from __future__ import annotations

import numpy as np

from spectralake.llm.common import _A, U64, mix

_INV = U64(pow(int(_A), -1, 2**64))


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, U64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of any stretch of a sequence in constant time each (polynomials over 2**64, symbols mixed before)."""

    def __init__(self, symbols: np.ndarray):
        s = mix(symbols + _A)
        self.n = len(s)
        self.inverse = _powers(self.n + 1, _INV)
        self.sums = np.zeros(self.n + 1, U64)
        np.cumsum(s * _powers(self.n, _A), out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64))

    def windows(self, k: int) -> np.ndarray:
        if self.n < k:
            return np.empty(0, U64)
        return mix((self.sums[k:] - self.sums[: self.n - k + 1]) * self.inverse[: self.n - k + 1] + U64(k))


def sliding_argmin(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the least upper half in each run of ``width`` hashes, the leftmost of equals: the lower half holds the place."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.int64)
    keyed = np.full(len(h) + -len(h) % width, np.iinfo(U64).max, U64)
    keyed[: len(h)] = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
    blocks = keyed.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(right[:n], left[width - 1 : width - 1 + n]) & U64(0xFFFFFFFF)).astype(np.int64)


def phrases(rolling: Rolling, window: int, seed: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, hash of the seed, hash of the whole phrase with the seed's place) of each anchor of a document."""
    h = rolling.windows(seed)
    place = sliding_argmin(h, window - seed + 1)
    if not len(place):
        e = np.empty(0, np.int64)
        return e, e, np.empty(0, U64), np.empty(0, U64)
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
    last = np.concatenate((first[1:], [len(place)])) - 1
    at = place[first]
    # the least of many hashes is small: mixed anew, seeds spread evenly over buckets
    return first, last, mix(h[at] + _A), mix(rolling.hashes(first, last + window) ^ (at - first).astype(U64))
