"""Harmonic amplitudes to pulse profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decimated(amps: DataFrame, nharms: int, k: int) -> DataFrame:
    """Every k-th harmonic, renumbered: the fold of the k-fold frequency."""
    return amps.where((F.col("h") % k == 0) & (F.col("h") <= k * (nharms // k))).withColumn("h", F.floor(F.col("h") / k).cast("int"))


def coherent_profiles(amps: DataFrame, keys: list[str], nharms: int) -> DataFrame:
    """``(keys, i, v)``: inverse real DFT of ``nharms`` amplitudes with a zero DC term to 2 * nharms bins.

    The imaginary part of the top harmonic (the profile's Nyquist term) is ignored.
    """
    n = 2 * nharms
    each = amps.where(F.col("h").between(1, nharms)).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    angle = F.lit(2.0) * F.pi() * ((F.col("h") * F.col("i")) % n) / F.lit(float(n))
    wave = F.when(F.col("h") < nharms, 2 * (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle))).otherwise(F.col("re") * F.cos(angle))
    return each.groupBy(*keys, "i").agg((F.sum(wave) / F.lit(float(n))).alias("v"))


def as_arrays(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, profile array<double>)`` in phase order."""
    packed = profiles.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("_p"))
    return packed.select(*keys, F.transform("_p", lambda s: s["v"]).alias("profile"))


def usable_harmonics(points: DataFrame, keys: list[str], m: int, n_half: int, n_amps: int, r: str = "rh") -> DataFrame:
    """The leading harmonics up to the first whose window leaves the file or whose frequency passes Nyquist."""
    at = F.floor(F.col(r) + F.lit(1e-15)) + 1
    ok = (at - m // 2 >= 0) & (at + m // 2 <= n_amps) & (F.col(r) < n_half)
    first_bad = F.min(F.when(~ok, F.col("h"))).over(Window.partitionBy(*keys))
    return points.withColumn("_bad", first_bad).where(F.col("_bad").isNull() | (F.col("h") < F.col("_bad"))).drop("_bad")
