"""Sinks for the metric statistics, and the rules for output paths."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def output_path(inputs: list[str], index: int, out: str | None, outdir: str | None) -> str | None:
    """Where the candidates of one input go; None is standard output.

    One input without a folder: ``out`` or standard output.  Otherwise
    ``<stem>.cohout`` in ``outdir`` or beside the input; ``out`` is then an error.
    """
    if out and (len(inputs) > 1 or outdir):
        raise ValueError("an output file needs a single input and no output folder")
    if len(inputs) == 1 and not outdir:
        return out
    stem = os.path.splitext(os.path.basename(inputs[index]))[0]
    return os.path.join(outdir if outdir else os.path.dirname(inputs[index]), stem + ".cohout")


# The files' layout.
BLOCK_HEADER = "#block     k   Hk nbins  ngoodbins       f_lo(Hz)       f_hi(Hz)        n       min    median      mean       std       max"
BLOCK_LINE = "%-8d %3d %4d %5d %10.3f %14.8f %14.8f %8d %9.3f %9.3f %9.3f %9.3f %9.3f"
FAP_HEADER = "#k     Hk nbins  win      f_lo(Hz)      f_hi(Hz)    ntrials     mean      std   median | fap1e-1 fap1e-2 fap1e-3 fap1e-4 fap1e-5"
FAP_LINE = "%-4d %4d %5d %4d %13.7f %13.7f %10d %8.3f %8.3f %8.3f |"
HIST_HEADER = "#k     Hk  win      f_lo(Hz)      f_hi(Hz)          bin          count"
HIST_LINE = "%-4d %4d %4d %13.7f %13.7f %12.5f %14d"
FILE_FAPS = (0.1, 0.01, 1e-3, 1e-4, 1e-5)


def block_table(stats: DataFrame, nharms: int, good: DataFrame) -> DataFrame:
    """``(obs, k, block, line)`` of the block statistics; ``good(obs, block, ngoodbins)`` as from ``good_harmonics``."""
    folded = F.floor(F.lit(nharms) / F.col("k")).cast("int")
    line = F.format_string(BLOCK_LINE, "block", "k", folded, 2 * folded, "ngoodbins", "flo", "fhi", "n", "vmin", "vmedian", "vmean", "vstd", "vmax")
    return stats.join(good, ["obs", "block"]).select("obs", "k", "block", line.alias("line"))


def fap_table(summary: DataFrame, nharms: int, t_span: float) -> DataFrame:
    """``(obs, k, win, line)`` of the false-alarm thresholds of each fold and window; ``summary`` by obs, k, win with ``FILE_FAPS``."""
    folded = F.floor(F.lit(nharms) / F.col("k")).cast("int")
    head = F.format_string(FAP_LINE, "k", folded, 2 * folded, "win", F.col("rmin") / F.lit(t_span), F.col("rmax") / F.lit(t_span), "ntrials", "vmean", "vstd", "vmedian")
    values = F.concat(*[F.format_string(" %7.3f", f"fap{i + 1}") for i in range(len(FILE_FAPS))])
    over = F.when(F.col("overflow") > min(FILE_FAPS), F.format_string("  # overflow %.1e", "overflow")).otherwise("")
    return summary.select("obs", "k", "win", F.concat(head, values, over).alias("line"))


def histogram_table(hist: DataFrame, nharms: int, t_span: float, lo: float = 0.0, hi: float = 64.0, nb: int = 3200) -> DataFrame:
    """``(obs, k, win, bin, line)`` of all bins between the populated ends; ``hist`` by obs, k, win with rmin and rmax of the window."""
    folded = F.floor(F.lit(nharms) / F.col("k")).cast("int")
    edges = hist.groupBy("obs", "k", "win").agg(F.min("rmin").alias("rmin"), F.max("rmax").alias("rmax"))
    width = (hi - lo) / nb
    dump = histogram_dump(hist, ["obs", "k", "win"], lo, hi, nb).join(edges, ["obs", "k", "win"]).withColumn("bin", F.round((F.col("x") - lo) / width - 0.5).cast("bigint"))
    line = F.format_string(HIST_LINE, "k", folded, "win", F.col("rmin") / F.lit(t_span), F.col("rmax") / F.lit(t_span), F.lit(lo) + F.col("bin") * width, "n")
    return dump.select("obs", "k", "win", "bin", line.alias("line"))


def histogram_dump(hist: DataFrame, keys: list[str], lo: float = 0.0, hi: float = 64.0, nb: int = 3200) -> DataFrame:
    """``(keys, x, n)``: all bins between the first and last populated ones within the range, empty ones included."""
    inside = hist.where((F.col("bin") >= 0) & (F.col("bin") < nb))
    span = inside.groupBy(*keys).agg(F.sequence(F.min("bin"), F.max("bin")).alias("bins")).select(*keys, F.explode("bins").alias("bin"))
    width = (hi - lo) / nb
    return span.join(inside, [*keys, "bin"], "left").select(*keys, (F.lit(lo) + (F.col("bin") + 0.5) * width).alias("x"), F.coalesce("n", F.lit(0)).alias("n"))


def drift(summary: DataFrame) -> DataFrame:
    """Per observation and fold the range of each false-alarm threshold over the windows."""
    faps = [c for c in summary.columns if c.startswith("fap")]
    keys = [c for c in ("obs", "k") if c in summary.columns]
    return summary.groupBy(*keys).agg(*[f(c).alias(f"{c}_{n}") for c in faps for n, f in (("min", F.min), ("max", F.max))])
