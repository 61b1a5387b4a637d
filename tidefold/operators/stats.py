"""Empirical statistics of the detection metric and the normalisation built from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.params import SearchParams, log_edges

FAPS = (0.1, 0.01, 1e-3, 1e-4)
MIN_WINDOW_TRIALS = 200
#: Range and bins of the metric's histogram.
HIST_LO, HIST_HI, HIST_BINS = 0.0, 64.0, 3200
#: One row per (observation, block, decimation); ``m2`` is the sum of squares about the mean, ``bins`` and ``counts`` the populated histogram bins.
ACCUMULATOR = "obs string, block bigint, k int, rmin double, rmax double, n bigint, vmin double, vmedian double, vmean double, m2 double, vmax double, over bigint, bins array<int>, counts array<bigint>"
ACCUMULATOR_TYPES = [pa.string(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), *[pa.float64()] * 5, pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]


def accumulated(metric: np.ndarray, lo: float = HIST_LO, hi: float = HIST_HI, nb: int = HIST_BINS) -> tuple:
    """``(n, vmin, vmedian, vmean, m2, vmax, over, bins, counts)`` of the trials of a block; one at least."""
    at = np.where(metric < lo, -1, np.where(metric >= hi, nb, np.floor((np.clip(metric, lo, hi) - lo) * (nb / (hi - lo))))).astype(np.int64)
    bins, counts = np.unique(at, return_counts=True)
    mean = float(metric.mean())
    return len(metric), float(metric.min()), float(np.median(metric)), mean, float(((metric - mean) ** 2).sum()), float(metric.max()), int((metric >= hi).sum()), bins.tolist(), counts.tolist()


def block_stats(acc: DataFrame, t_span: float) -> DataFrame:
    """``block_metric_stats`` from accumulators."""
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(0.0)
    return acc.select("obs", "block", "k", "n", (F.col("rmin") / F.lit(t_span)).alias("flo"), (F.col("rmax") / F.lit(t_span)).alias("fhi"), "vmin", "vmedian", "vmean", std.alias("vstd"), "vmax")


def good_harmonics_of(acc: DataFrame, nharms: int, n_half: int) -> DataFrame:
    """``good_harmonics`` from accumulators: the mean of a progression is that of its ends."""
    return acc.where("k = 1").select("obs", "block", F.least(F.lit(float(n_half)) / ((F.col("rmin") + F.col("rmax")) / 2), F.lit(float(nharms))).alias("ngoodbins"))


def merged_histogram(acc: DataFrame, keys: list[str], ranged: bool = False) -> DataFrame:
    """``histogram`` from accumulators: ``(keys, bin, n)``; with ``ranged`` also ``rmin`` and ``rmax`` of the trials of all ``keys``."""
    each = acc.select(*keys, "rmin", "rmax", F.explode(F.arrays_zip("bins", "counts")).alias("_b"))
    more = [F.min("rmin").alias("rmin"), F.max("rmax").alias("rmax")] if ranged else []
    out = each.groupBy(*keys, F.col("_b.bins").cast("bigint").alias("bin")).agg(F.sum("_b.counts").alias("n"), *more)
    if not ranged:
        return out
    whole = Window.partitionBy(*keys)
    return out.withColumns({"rmin": F.min("rmin").over(whole), "rmax": F.max("rmax").over(whole)})


def merged_summary(acc: DataFrame, keys: list[str], faps: tuple[float, ...] = FAPS, lo: float = HIST_LO, hi: float = HIST_HI, nb: int = HIST_BINS) -> DataFrame:
    """``summary`` from accumulators, with the range ``rmin`` to ``rmax`` of the trials.

    Moments and histogram go through one aggregation (the moments as the row of a
    null bin), so the accumulators are made once.
    """
    moments = ("blocks", "trials", "vmin", "vmax", "total", "square", "over", "rmin", "rmax")
    first = F.struct(
        F.lit(None).cast("int").alias("bin"), F.lit(0).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("blocks"), F.col("n").alias("trials"), "vmin", "vmax",
        (F.col("n") * F.col("vmean")).alias("total"), (F.col("m2") + F.col("n") * F.col("vmean") * F.col("vmean")).alias("square"), "over", "rmin", "rmax",
    )
    nothing = [F.lit(None).cast("bigint" if c in ("blocks", "trials", "over") else "double").alias(c) for c in moments]
    rest = F.transform(F.arrays_zip("bins", "counts"), lambda b: F.struct(b["bins"].alias("bin"), b["counts"].alias("n"), *nothing))
    each = acc.select(*keys, F.inline(F.concat(F.array(first), rest)))
    sums = {c: (F.min if c in ("vmin", "rmin") else F.max if c in ("vmax", "rmax") else F.sum)(c).alias(c) for c in moments}
    merged = each.groupBy(*keys, F.col("bin").cast("bigint").alias("bin")).agg(F.sum("n").alias("n"), *sums.values())
    qs = {"vmedian": 0.5} | {f"fap{i + 1}": 1 - p for i, p in enumerate(faps)}
    out = quantiles(merged, keys, qs, lo, hi, nb, carry=list(moments))
    mean = F.col("total") / F.col("trials")
    std = F.when(F.col("trials") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("square") - F.col("total") * mean) / (F.col("trials") - 1))).otherwise(0.0)
    return out.select(
        *keys, F.col("trials").alias("ntrials"), F.col("blocks").alias("nblocks"), "vmin", "vmax", mean.alias("vmean"), std.alias("vstd"), (F.col("over") / F.col("trials")).alias("overflow"), "rmin", "rmax", *qs
    )


def norm_model(acc: DataFrame, min_trials: int = MIN_WINDOW_TRIALS) -> DataFrame:
    """``(obs, k, win, loc, scale)``: ``metric_norm`` per observation, from accumulators with ``win``.

    The histogram of a fold is the sum of those of its windows, so both levels
    come from one aggregation over the accumulators.
    """
    hist = merged_histogram(acc, ["obs", "k", "win"]).withColumn("level", F.explode(F.array(F.col("win"), F.lit(None).cast("int"))))
    both = hist.groupBy("obs", "k", "level", "bin").agg(F.sum("n").alias("n"))
    fits = quantiles(both, ["obs", "k", "level"], {"loc": 0.5, "up": 0.8413}, count="n")
    fold = Window.partitionBy("obs", "k")
    whole = F.col("level").isNull()
    fits = fits.withColumn("gloc", F.max(F.when(whole, F.col("loc"))).over(fold)).withColumn("gup", F.max(F.when(whole, F.col("up"))).over(fold)).where("level is not null")
    own = (F.col("n") >= min_trials) & (F.col("up") > F.col("loc"))
    common = F.when(F.col("gup") > F.col("gloc"), F.col("gup") - F.col("gloc")).otherwise(1.0)
    return fits.select(
        "obs", "k", F.col("level").alias("win"), F.when(own, F.col("loc")).otherwise(F.col("gloc")).alias("loc"), F.when(own, F.col("up") - F.col("loc")).otherwise(common).alias("scale")
    )


def block_metric_stats(metrics: DataFrame, t_span: float) -> DataFrame:
    """Per (obs, block, k), from the trials: frequency range, count, extremes, median, mean and standard deviation (0 for one trial)."""
    return metrics.groupBy("obs", "block", "k").agg(
        F.count(F.lit(1)).alias("n"),
        (F.min("r") / F.lit(t_span)).alias("flo"),
        (F.max("r") / F.lit(t_span)).alias("fhi"),
        F.min("metric").alias("vmin"),
        F.median("metric").alias("vmedian"),
        F.avg("metric").alias("vmean"),
        F.coalesce(F.stddev_samp("metric"), F.lit(0.0)).alias("vstd"),
        F.max("metric").alias("vmax"),
    )


def window_index(f: Column, edges: list[float]) -> Column:
    """Index (from 1) of the last edge at or below ``f``, clamped to the windows."""
    at = F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e <= f))
    return F.greatest(F.lit(1), F.least(at, F.lit(len(edges) - 1)))


def with_window(metrics: DataFrame, params: SearchParams, t_span: float, r_lo: float, r_hi: float, windows: int) -> DataFrame:
    """Adds ``win``: whole blocks go to the window of their centre frequency, log-spaced per decimation."""
    edges = {k: log_edges(k * r_lo / t_span, k * r_hi / t_span, windows) for k in params.decimations}
    first = F.lit(float(r_lo)) + F.col("block") * params.blocksize * F.lit(params.lodr)
    last = F.least(first + (params.blocksize - 1) * F.lit(params.lodr), F.lit(float(r_hi)))
    centre = F.col("k") * (first + last) / 2 / F.lit(t_span)
    win = None
    for k, e in edges.items():
        win = F.when(F.col("k") == k, window_index(centre, e)) if win is None else win.when(F.col("k") == k, window_index(centre, e))
    return metrics.withColumn("win", win)


def histogram(metrics: DataFrame, keys: list[str], lo: float = 0.0, hi: float = 64.0, nb: int = 3200) -> DataFrame:
    """``(keys, bin, n)``; bin -1 is below the range and ``nb`` at or above its end."""
    x = F.col("metric")
    b = F.when(x < lo, F.lit(-1)).when(x >= hi, F.lit(nb)).otherwise(F.floor((x - lo) * F.lit(nb / (hi - lo))))
    return metrics.groupBy(*keys, b.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def quantiles(
    hist: DataFrame, keys: list[str], qs: dict[str, float], lo: float = HIST_LO, hi: float = HIST_HI, nb: int = HIST_BINS, carry: list[str] | None = None, count: str | None = None
) -> DataFrame:
    """One column per quantile, linear within its bin; ``lo`` or ``hi`` where it lies outside the range.

    ``carry`` names columns of the row of a null bin to keep, ``count`` one for the number of all trials.
    """
    w = Window.partitionBy(*keys)
    cum = hist.withColumn("_cum", F.sum("n").over(w.orderBy("bin"))).withColumn("_all", F.sum("n").over(w))
    width = (hi - lo) / nb
    outs = []
    for name, q in qs.items():
        target = F.lit(q) * F.col("_all")
        reached = (F.col("_cum") >= target) & F.col("bin").isNotNull()
        inside = F.lit(lo) + F.col("bin") * F.lit(width) + (target - (F.col("_cum") - F.col("n"))) / F.col("n") * F.lit(width)
        value = F.when(F.col("bin") < 0, F.lit(lo)).when(F.col("bin") >= nb, F.lit(hi)).otherwise(inside)
        outs.append(F.min_by(F.when(reached, value), F.when(reached, F.col("bin"))).alias(name))
    outs += [F.max(c).alias(c) for c in carry or ()]
    if count:
        outs.append(F.sum("n").alias(count))
    return cum.groupBy(*keys).agg(*outs)


def summary(metrics: DataFrame, keys: list[str], faps: tuple[float, ...] = FAPS, hi: float = 64.0) -> DataFrame:
    """Exact moments, binned median and false-alarm thresholds, and the share above the range."""
    moments = metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("ntrials"),
        F.countDistinct("block").alias("nblocks"),
        F.min("metric").alias("vmin"),
        F.max("metric").alias("vmax"),
        F.avg("metric").alias("vmean"),
        F.coalesce(F.stddev_samp("metric"), F.lit(0.0)).alias("vstd"),
        F.avg((F.col("metric") >= hi).cast("double")).alias("overflow"),
    )
    qs = {"vmedian": 0.5} | {f"fap{i + 1}": 1 - p for i, p in enumerate(faps)}
    return moments.join(quantiles(histogram(metrics, keys), keys, qs), keys)


def metric_norm(metrics: DataFrame, min_trials: int = MIN_WINDOW_TRIALS) -> DataFrame:
    """``(obs, k, win, loc, scale)``: median and upper one-sigma spread per window, the fold's own where a window is sparse or degenerate.

    From trials; ``norm_model`` makes the same of accumulators, without keeping trials.
    """
    qs = {"loc": 0.5, "up": 0.8413}
    keys = ["obs", "k", "win"]
    per_win = quantiles(histogram(metrics, keys), keys, qs, count="n")
    per_k = quantiles(histogram(metrics, ["obs", "k"]), ["obs", "k"], qs).select(
        "obs", "k", F.col("loc").alias("gloc"), F.when(F.col("up") > F.col("loc"), F.col("up") - F.col("loc")).otherwise(1.0).alias("gscale")
    )
    own = (F.col("n") >= min_trials) & (F.col("up") > F.col("loc"))
    return per_win.join(per_k, ["obs", "k"]).select(
        *keys, F.when(own, F.col("loc")).otherwise(F.col("gloc")).alias("loc"), F.when(own, F.col("up") - F.col("loc")).otherwise(F.col("gscale")).alias("scale")
    )


def normalized_metrics(metrics: DataFrame, norm: DataFrame) -> DataFrame:
    """Adds ``z``; a trial without a model keeps its raw metric."""
    z = F.coalesce((F.col("metric") - F.col("loc")) / F.col("scale"), F.col("metric"))
    return metrics.join(norm, ["obs", "k", "win"], "left").withColumn("z", z).drop("loc", "scale")


def good_harmonics(metrics: DataFrame, nharms: int, n_half: int) -> DataFrame:
    """``(obs, block, ngoodbins)``: harmonics of a block's mean frequency that lie within the spectrum, ``nharms`` at most.

    Trials of the first decimation are taken: the others fold multiples of the same frequencies.
    """
    mean = metrics.where("k = 1").groupBy("obs", "block").agg(F.avg("r").alias("r"))
    return mean.select("obs", "block", F.least(F.lit(float(n_half)) / F.col("r"), F.lit(float(nharms))).alias("ngoodbins"))


def serial_fraction(runs: DataFrame, workers: str = "n", speedup: str = "speedup") -> DataFrame:
    """One row ``(serial, ceiling)``: the least-squares s of ``1 / speedup = s + (1 - s) / n``, and ``1 / s``.

    With u = 1 / n it is the slope through the origin of ``1 / speedup - u`` over ``1 - u``;
    null without a run on two workers or more.
    """
    u = 1.0 / F.col(workers)
    x, y = 1.0 - u, 1.0 / F.col(speedup) - u
    both = runs.agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"))
    s = F.when(F.col("xx") > 0, F.greatest(F.lit(1e-9), F.least(F.lit(1.0), F.col("xy") / F.col("xx"))))
    return both.select(s.alias("serial"), (1.0 / s).alias("ceiling"))
