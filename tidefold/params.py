"""Search configuration and the small driver-side plans derived from it."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace
from fractions import Fraction

#: Widest boxcar kept on all rungs of a decimation ladder but the last.
LADDER_WMAX = 6
#: Profile bins that a block noise estimate samples at most.
SIGMA_SAMPLES = 8192


@dataclass(frozen=True)
class SearchParams:
    """Parameters of a search; defaults are those of the library, ``production()`` those of the command line."""

    nharms: int = 32
    m: int = 16
    numbetween: int = 16
    hidr: float = 0.5
    threshold: float = 8.0
    boxcar_fsp: float = 1.5
    boxcar_maxfrac: float = 0.3
    boxcar_medmargin: float = 2.0
    decimations: tuple[int, ...] = field(default=(1,))
    blocksize: int = 2048

    def __post_init__(self):
        if self.m <= 0 or self.m % 2:
            raise ValueError("m must be even and positive")
        if self.nharms < 1 or self.blocksize < 1:
            raise ValueError("nharms and blocksize must be at least 1")

    @property
    def lodr(self) -> float:
        """Trial step in bins."""
        return self.hidr / self.nharms

    @staticmethod
    def production(**changes) -> SearchParams:
        return replace(SearchParams(nharms=60, decimations=tuple(decimation_set(60, 6))), **changes)

    def folded(self, k: int) -> int:
        """Harmonics of the fold at decimation ``k``."""
        return self.nharms // k

    def widths(self, k: int) -> list[int]:
        return ladder_boxcar_widths(2 * self.folded(k), k, self)


def decimation_set(nharms: int, kmax: int) -> list[int]:
    """Decimations that leave two harmonics at least."""
    return [k for k in range(1, max(1, kmax) + 1) if nharms // k >= 2]


def boxcar_widths(nbins: int, fsp: float = 1.5, maxfrac: float = 0.3) -> list[int]:
    """Geometric bank from width 1 up to ``maxfrac`` of the profile."""
    last, bank, w = max(1, math.floor(maxfrac * nbins)), [], 1
    while w <= last:
        bank.append(w)
        w = max(math.floor(fsp * w), w + 1)
    return bank


def ladder_boxcar_widths(nbins: int, k: int, params: SearchParams) -> list[int]:
    """The bank without the widths that another rung of the ladder covers."""
    bank, rungs = boxcar_widths(nbins, params.boxcar_fsp, params.boxcar_maxfrac), sorted(params.decimations)
    if len(rungs) < 2 or any(2 * b > LADDER_WMAX * a for a, b in zip(rungs, rungs[1:])):
        return bank
    low = 1 if k == rungs[0] else 2
    high = nbins if k == rungs[-1] else LADDER_WMAX
    return [w for w in bank if low <= w <= high] or bank


def trial_count(r_lo: float, r_hi: float, lodr: float) -> int:
    return max(0, math.floor((r_hi - r_lo) / lodr) + 1)


def trial_grid_rational(step: float, max_den: int = 1 << 16, max_ulp: int = 8) -> Fraction | None:
    """``step`` as an exact fraction if one with a small denominator is within a few ulp."""
    if not math.isfinite(step) or step <= 0:
        return None
    near = Fraction(step).limit_denominator(max_den)
    return near if abs(float(near) - step) <= max_ulp * math.ulp(step) else None


def next_pow_of_2(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


def is_smooth(n: int) -> bool:
    """No prime factor above 7."""
    if n < 1:
        return False
    for p in (2, 3, 5, 7):
        while n % p == 0:
            n //= p
    return n == 1


def next_smooth(n: int) -> int:
    n = max(1, n)
    while not is_smooth(n):
        n += 1
    return n


def log_edges(a: float, b: float, windows: int) -> list[float]:
    """Log-spaced edges; non-positive or coincident ends are widened."""
    a = max(float(a), 2.2250738585072014e-308)
    b = max(float(b), a * (1 + 1e-9))
    la, lb = math.log10(a), math.log10(b)
    return [10 ** (la + (lb - la) * i / windows) for i in range(windows + 1)]
