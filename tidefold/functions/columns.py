"""Column functions shared by the relational operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sinc(x: Column) -> Column:
    """sin(pi x) / (pi x), 1 at zero."""
    return F.when(x == 0, F.lit(1.0)).otherwise(F.sin(F.pi() * x) / (F.pi() * F.when(x == 0, F.lit(1.0)).otherwise(x)))


def floor_bin(r: Column) -> Column:
    """The Fourier bin that holds ``r``; values a hair below an integer belong to it."""
    return F.floor(r + F.lit(1e-15))


def array_median(v: Column) -> Column:
    """Exact median of an array: the mean of the two central values for an even length."""
    s, n = F.array_sort(v), F.size(v)
    lo, hi = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return F.when(n > 0, (lo + hi) / 2)


def rotated_to_peak(v: Column) -> Column:
    """Circular shift that brings the first maximum to element n/2 + 1 (from 1)."""
    n = F.size(v)
    at = F.array_position(v, F.array_max(v)).cast("int")
    shift = F.pmod(F.floor(n / 2).cast("int") + 1 - at, n).cast("int")
    return F.when(n < 1, v).otherwise(F.concat(F.slice(v, n - shift + 1, F.greatest(shift, F.lit(0))), F.slice(v, F.lit(1), n - shift)))


def related(a: Column, b: Column, numharm: int, tol: float) -> Column:
    """True if multiples up to ``numharm`` of two frequencies (in bins) meet within ``tol``."""
    lo, hi = F.least(a, b), F.greatest(a, b)

    def meets(m: Column) -> Column:
        n = F.rint(m * hi / F.when(lo > 0, lo).otherwise(F.lit(1.0)))
        return (n >= 1) & (n <= numharm) & (F.abs(m * hi - n * lo) <= F.lit(tol) * m)

    return (lo > 0) & F.exists(F.sequence(F.lit(1), F.lit(numharm)), lambda m: meets(m.cast("double")))
