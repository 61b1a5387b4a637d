"""The fine interpolation grid by FFT convolutions of overlapping pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.operators.spectrum import PAGE_BINS
from tidefold.params import next_smooth


def kernel_spectrum(m: int, numbetween: int, length: int) -> np.ndarray:
    """FFT of the conjugate kernel sinc(o) e^{-i pi o}, sampled ``numbetween`` times a bin for -m/2 <= o < m/2.

    Negative offsets wrap to the end, so that a product of spectra is a convolution in place.
    """
    if m <= 0 or m % 2 or length < m * numbetween:
        raise ValueError("m must be even and the length hold m bins")
    o = np.arange(-m * numbetween // 2, m * numbetween // 2) / numbetween
    taps = np.zeros(length, np.complex128)
    taps[np.arange(-m * numbetween // 2, m * numbetween // 2) % length] = np.sinc(o) * np.exp(-1j * np.pi * o)
    return np.fft.fft(taps)


def fine_amplitudes(bins: np.ndarray, numbins: int, numbetween: int, m: int, length: int | None = None) -> np.ndarray:
    """Amplitudes at ``numbins * numbetween`` points; ``bins`` are those of the range and m/2 more on either side.

    Any transform length from ``(numbins + m) * numbetween`` on gives the same values.
    """
    length = length or next_smooth((numbins + m) * numbetween)
    if len(bins) != numbins + m or length < len(bins) * numbetween:
        raise ValueError("the range needs m/2 bins more on either side, and a transform that holds it")
    spread = np.zeros(length, np.complex128)
    spread[: len(bins) * numbetween : numbetween] = bins
    out = np.fft.ifft(np.fft.fft(spread) * kernel_spectrum(m, numbetween, length))
    return out[m // 2 * numbetween : (m // 2 + numbins) * numbetween]


def fine_grid_fft(spec: DataFrame, lobin: int, numbins: int, numbetween: int, m: int, page_bins: int = PAGE_BINS) -> DataFrame:
    """``(obs, g, re, im)`` like ``interp.fine_grid``, of any range up to the whole spectrum; bins missing from it are zero.

    Overlap-save: a bin also goes to the neighbouring pages within m/2 of it, and
    each page is convolved by itself with that margin, as a task of its own.  The
    values do not depend on ``page_bins``.
    """
    if m > 2 * page_bins:
        raise ValueError("a page has to hold half of the kernel")
    half, last = m // 2, lobin + numbins - 1
    page = lambda d: F.floor((F.col("bin") - lobin + d) / page_bins)
    near = spec.where(F.col("bin").between(lobin - half, last + half))
    near = near.withColumn("page", F.explode(F.array_distinct(F.array(page(-half), page(0), page(half))))).where(F.col("page").between(0, (numbins - 1) // page_bins))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at = int(pdf["page"].iloc[0])
        first, count = lobin + at * page_bins, min(page_bins, numbins - at * page_bins)
        x = np.zeros(count + m, np.complex128)
        place = pdf["bin"].to_numpy() - (first - half)
        inside = place < count + m
        x[place[inside]] = (pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy())[inside]
        a = fine_amplitudes(x, count, numbetween, m)
        return pd.DataFrame({"obs": pdf["obs"].iloc[0], "g": (first - lobin) * numbetween + np.arange(len(a)), "re": a.real, "im": a.imag})

    return near.groupBy("obs", "page").applyInPandas(run, "obs string, g bigint, re double, im double")
