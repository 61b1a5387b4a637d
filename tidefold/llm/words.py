"""64-bit hashes of all pieces of a byte buffer at once."""

from __future__ import annotations

import numpy as np

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULTIPLIER, -1, 1 << 64)
_LETTER = np.random.default_rng(17).integers(1, 1 << 63, 256, dtype=np.uint64)
_powers = {_MULTIPLIER: np.ones(1, np.uint64), _INVERSE: np.ones(1, np.uint64)}
#: Positions for which powers are kept; longer buffers are hashed part by part.
_KEPT = 1 << 18


def _power(base: int, n: int) -> np.ndarray:
    """The powers 0 .. n - 1 of an odd number, modulo 2**64."""
    if len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 14), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base]


def piece_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of ``data[starts[i]:ends[i]]`` for each i, the same wherever the bytes stand.

    A polynomial in an odd multiplier: differences of its running sums are
    divided by the power of the start, so no piece is looped over.  ``starts``
    ascend and pieces don't overlap.
    """
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        base = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, base + _KEPT, side="right")))
        a, b = starts[lo:hi] - base, ends[lo:hi] - base
        n = int(b[-1])
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_LETTER[data[base : base + n]] * _power(_MULTIPLIER, n)[:n], out=sums[1:])
        out[lo:hi] = (sums[b] - sums[a]) * _power(_INVERSE, n)[a]
        lo = hi
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out
