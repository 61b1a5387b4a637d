"""Fourier interpolation as gather joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.functions.columns import floor_bin, sinc
from tidefold.params import trial_count


def trial_grid(spark: SparkSession, r_lo: float, r_hi: float, lodr: float, blocksize: int) -> DataFrame:
    """``(t, block, r)``: the arithmetic progression of trial frequencies; ``t`` stays an integer."""
    return spark.range(trial_count(r_lo, r_hi, lodr)).select(
        F.col("id").alias("t"), F.floor(F.col("id") / blocksize).alias("block"), (F.lit(float(r_lo)) + F.col("id") * F.lit(float(lodr))).alias("r")
    )


def trial_grids(grids: DataFrame, blocksize: int) -> DataFrame:
    """``grids`` with a row per trial ``(t, block, r)``: a progression for each row's own ``r_lo, r_hi, step``.

    Rows with a null, or a step that is not positive, have no trials.
    """
    count = F.floor((F.col("r_hi") - F.col("r_lo")) / F.when(F.col("step") > 0, F.col("step"))) + 1
    each = grids.where(count > 0).withColumn("t", F.explode(F.sequence(F.lit(0).cast("bigint"), count - 1)))
    return each.withColumn("block", F.floor(F.col("t") / blocksize)).withColumn("r", F.col("r_lo") + F.col("t") * F.col("step"))


def harmonic_guards(trials: DataFrame, nharms: int, m: int, keys: list[str]) -> DataFrame:
    """``(keys, block, h, ok)`` as ``harmonic_guard``, for trials of many spectra with ``n_half`` bins each."""
    blocks = trials.groupBy(*keys, "block").agg(F.min("r").alias("r_first"), F.max("r").alias("r_last"), F.max("n_half").alias("n_half"))
    lo, hi = F.floor(F.col("h") * F.col("r_first")), F.floor(F.col("h") * F.col("r_last"))
    ok = (lo + 2 - m // 2 >= 1) & (hi < F.col("n_half")) & (hi + m // 2 < F.col("n_half"))
    return blocks.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(nharms)))).select(*keys, "block", "h", ok.alias("ok"))


def finterp_multi(points: DataFrame, spec: DataFrame, keys: list[str], each: list[str], m: int, r: str = "rh") -> DataFrame:
    """``(keys, each, re, im)``: many points of one ``keys`` group, all between the same two bins.

    A group whose points lie in different bins raises when it is read.
    """
    at = F.floor(F.col(r) + F.lit(1e-15))
    group = Window.partitionBy("obs", *keys)
    same = F.min(at).over(group) == F.max(at).over(group)
    ok = F.when(same, F.col(r)).otherwise(F.raise_error(F.lit("points of a group must lie between the same two bins")).cast("double"))
    return interp_direct(points.withColumn(r, ok), spec, [*keys, *each], m, r)


def trial_blocks(grid: DataFrame) -> DataFrame:
    """``(block, n, t_first, r_first, r_last)``."""
    return grid.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t_first"), F.min("r").alias("r_first"), F.max("r").alias("r_last"))


def harmonics(grid: DataFrame, nharms: int) -> DataFrame:
    """``(.., h, rh)``: every harmonic of every trial."""
    return grid.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(nharms)))).withColumn("rh", F.col("r") * F.col("h"))


def harmonic_guard(grid: DataFrame, nharms: int, m: int, n_half: int) -> DataFrame:
    """``(block, h, ok)``: a harmonic is usable in a block if no trial of it leaves the file or passes Nyquist."""
    lo, hi = F.floor(F.col("h") * F.col("r_first")), F.floor(F.col("h") * F.col("r_last"))
    ok = (lo + 2 - m // 2 >= 1) & (hi < n_half) & (hi + m // 2 < n_half)
    return trial_blocks(grid).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(nharms)))).select("block", "h", ok.alias("ok"))


def interp_coeffs(dr: Column, m: int) -> Column:
    """Array of ``(j, re, im)``: the kernel sinc(o) e^{i pi o}, o = dr - j, for the ``m`` bins around."""

    def one(j: Column) -> Column:
        o = dr - j
        return F.struct(j.cast("bigint").alias("j"), (sinc(o) * F.cos(F.pi() * o)).alias("re"), (sinc(o) * F.sin(F.pi() * o)).alias("im"))

    return F.transform(F.sequence(F.lit(-m // 2 + 1), F.lit(m // 2)), one)


def gathered(points: DataFrame, spec: DataFrame, m: int, r: str = "rh") -> DataFrame:
    """``points`` with one row per spectrum bin of the window around ``r``: ``bin, fl, dr, re, im``.

    The band is exploded so that the join is an equi-join on (obs, bin).
    """
    near = points.withColumn("fl", floor_bin(F.col(r))).withColumn("dr", F.col(r) - F.col("fl"))
    near = near.withColumn("bin", F.explode(F.sequence(F.col("fl") - (m // 2 - 1), F.col("fl") + m // 2)))
    return near.join(spec, ["obs", "bin"])


def fourier_interp(points: DataFrame, spec: DataFrame, keys: list[str], m: int, r: str = "rh") -> DataFrame:
    """Amplitude at real-valued ``r`` as the sum of conj(coefficient) * bin."""
    o = F.col("dr") - (F.col("bin") - F.col("fl"))
    c, s = sinc(o) * F.cos(F.pi() * o), sinc(o) * F.sin(F.pi() * o)
    re, im = c * F.col("re") + s * F.col("im"), c * F.col("im") - s * F.col("re")
    return gathered(points, spec, m, r).groupBy(*keys).agg(F.sum(re).alias("re"), F.sum(im).alias("im"))


def interp_direct(points: DataFrame, spec: DataFrame, keys: list[str], m: int, r: str = "rh") -> DataFrame:
    """The same by the factored kernel: trigonometry once per point, a division per bin."""
    j = F.col("bin") - F.col("fl")
    at_bin = F.col("dr") == 0
    safe = F.when(at_bin, F.lit(1.0)).otherwise(F.col("dr") - j)
    part = lambda c: F.when(at_bin, F.when(j == 0, F.col(c)).otherwise(F.lit(0.0))).otherwise(F.col(c) / safe)
    sums = gathered(points, spec, m, r).groupBy(*keys, "dr").agg(F.sum(part("re")).alias("sr"), F.sum(part("im")).alias("si"))
    a, c, s = F.sin(F.pi() * F.col("dr")) / F.pi(), F.cos(F.pi() * F.col("dr")), F.sin(F.pi() * F.col("dr"))
    exact = F.col("dr") == 0
    return sums.select(
        *keys,
        F.when(exact, F.col("sr")).otherwise(a * (c * F.col("sr") + s * F.col("si"))).alias("re"),
        F.when(exact, F.col("si")).otherwise(a * (c * F.col("si") - s * F.col("sr"))).alias("im"),
    )


def fine_grid(spec: DataFrame, lobin: int, numbins: int, numbetween: int, m: int) -> DataFrame:
    """Amplitudes at ``numbetween`` points per bin from ``lobin`` on: ``(obs, g, re, im)``."""
    points = spec.select("obs").distinct().withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(numbins * numbetween - 1))))
    points = points.withColumn("rh", F.lit(float(lobin)) + F.col("g") / F.lit(float(numbetween)))
    return interp_direct(points, spec, ["obs", "g"], m)


def linear_interp(points: DataFrame, grid: DataFrame, lobin: int, numbins: int, numbetween: int, keys: list[str], r: str = "rh") -> DataFrame:
    """Amplitudes on the fine grid interpolated linearly at ``r``; beyond its ends the end value holds."""
    last = numbins * numbetween - 1
    pos = F.greatest(F.lit(0.0), F.least(F.lit(float(last)), (F.col(r) - lobin) * numbetween))
    near = points.withColumn("_p", pos).withColumn("_g", F.least(F.floor("_p"), F.lit(max(last - 1, 0))))
    near = near.withColumn("g", F.explode(F.array(F.col("_g"), F.col("_g") + 1)))
    w = F.when(F.col("g") == F.col("_g"), 1 - (F.col("_p") - F.col("_g"))).otherwise(F.col("_p") - F.col("_g"))
    return near.join(grid, ["obs", "g"]).groupBy(*keys).agg(F.sum(w * F.col("re")).alias("re"), F.sum(w * F.col("im")).alias("im"))
