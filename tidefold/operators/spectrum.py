"""Time series and their Fourier spectra, long and in pages."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.schema import SPECTRUM

PAGE_BINS = 4096


def series_from_events(events: DataFrame, start: float, dt: float, n: int, obs: Column, ts: str = "ts", value: str = "value") -> DataFrame:
    """``(obs, b, v)``: sums of ``value`` in ``n`` bins of ``dt`` seconds from ``start`` (epoch seconds)."""
    b = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) / F.lit(1e6) - F.lit(start)) / F.lit(dt))
    return events.select(obs.alias("obs"), b.alias("b"), F.col(value).cast("double").alias("v")).where((F.col("b") >= 0) & (F.col("b") < n)).groupBy("obs", "b").agg(F.sum("v").alias("v"))


def spectrum(series: DataFrame, n: int) -> DataFrame:
    """``(obs, bin, re, im)`` for bins 0 .. n/2 - 1 by one FFT per observation.

    Bin 0 packs the zero-frequency amplitude (re) and the Nyquist amplitude (im).
    An observation is one transform, so it is the unit of work.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.zeros(n)
        np.add.at(x, pdf["b"].to_numpy(), pdf["v"].to_numpy())
        f = np.fft.rfft(x)
        out = f[: n // 2].copy()
        out[0] = complex(f[0].real, f[n // 2].real if n % 2 == 0 else 0.0)
        return pd.DataFrame({"obs": pdf["obs"].iloc[0], "bin": np.arange(n // 2), "re": out.real, "im": out.imag})

    return series.groupBy("obs").applyInPandas(run, SPECTRUM)


def normalized(spec: DataFrame) -> DataFrame:
    """Amplitudes over their root mean square above bin 0, so that the mean power is 1."""
    power = spec.where("bin > 0").groupBy("obs").agg(F.sqrt(F.avg(F.col("re") * F.col("re") + F.col("im") * F.col("im"))).alias("_rms"))
    return spec.join(power, "obs").select("obs", "bin", (F.col("re") / F.col("_rms")).alias("re"), (F.col("im") / F.col("_rms")).alias("im"))


def paged(spec: DataFrame, page_bins: int = PAGE_BINS) -> DataFrame:
    """``(obs, page, lo_bin, re, im)``: arrays of up to ``page_bins`` consecutive bins, zero where a bin is missing."""
    page = F.floor(F.col("bin") / page_bins)
    at = lambda c: F.transform(F.col("_bins"), lambda s: s[c])
    packed = spec.groupBy("obs", page.alias("page")).agg(F.sort_array(F.collect_list(F.struct("bin", "re", "im"))).alias("_bins"))
    return packed.select("obs", "page", (F.col("page") * page_bins).alias("lo_bin"), at("re").alias("re"), at("im").alias("im"), at("bin").alias("bins"))


def with_frequency(spec: DataFrame, t_span: float) -> DataFrame:
    return spec.withColumn("freq", F.col("bin") / F.lit(t_span))
