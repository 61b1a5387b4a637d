"""Exact phases of a trial grid with a rational step, and interpolation weights tabulated by residue.

The trial ``r = r_lo + t * p / q`` has its harmonic h at ``h * r_lo + (t * h * p) / q``.
The integer ``t * h * p`` splits into whole bins (``div q``) and a residue
(``mod q``), and only the residue decides the weights.  Both are exact for any
``t``, so a result can't depend on how trials are cut into blocks or tasks.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.params import trial_grid_rational

#: Tables beyond this size are not built; the weights are computed for each trial instead.
MAX_TABLE_BYTES = 64 << 20


def weights_at(dr: np.ndarray, m: int) -> np.ndarray:
    """Complex (points, m) weights of the bins around points ``dr`` above their lower bin; a point on a bin takes that bin."""
    j = np.arange(-m // 2 + 1, m // 2 + 1)
    on = dr == 0
    gap = dr[:, None] - j
    gap[on] = 1.0
    out = (np.exp(-1j * np.pi * dr) * np.sin(np.pi * dr) / np.pi)[:, None] / gap
    out[on] = j == 0
    return out


@dataclass(frozen=True)
class HarmonicTable:
    """Weights of one harmonic by residue class: ``base + div + carry[row]`` is the lower bin, ``weights[row]`` belong to it."""

    base: int
    common: int
    carry: np.ndarray
    dr: np.ndarray
    weights: np.ndarray | None


@dataclass(frozen=True)
class Phase:
    """Harmonics 1 .. ``nharms`` of the grid ``r_lo + t * step``."""

    r_lo: float
    step: Fraction
    nharms: int
    m: int

    def classes(self, h: int) -> int:
        """Residues that harmonic ``h`` can have."""
        return self.step.denominator // math.gcd(h * self.step.numerator, self.step.denominator)

    @property
    def table_bytes(self) -> int:
        return sum(self.classes(h) for h in range(1, self.nharms + 1)) * (16 * self.m + 16)

    def frequencies(self, t: np.ndarray) -> np.ndarray:
        return self.r_lo + t * self.step.numerator / self.step.denominator

    def harmonic(self, h: int) -> HarmonicTable:
        return _harmonic(self, h)

    def places(self, h: int, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Lower bin and distance above it of harmonic ``h`` at the trials ``t``, and the weights if they are tabulated."""
        table, p, q = self.harmonic(h), h * self.step.numerator, self.step.denominator
        if len(t) and int(t.max()) * p >= 1 << 62:
            exact = [int(x) * p for x in t]
            whole, rest = np.array([x // q for x in exact]), np.array([x % q for x in exact])
        else:
            whole, rest = np.divmod(t.astype(np.int64) * p, q)
        row = rest // table.common
        return table.base + whole + table.carry[row], table.dr[row], None if table.weights is None else table.weights[row]


@lru_cache(maxsize=256)
def _harmonic(phase: Phase, h: int) -> HarmonicTable:
    """Built once in a Python worker."""
    start = Fraction(phase.r_lo) * h
    base, q = math.floor(start), phase.step.denominator
    common = math.gcd(h * phase.step.numerator, q)
    at = float(start - base) + np.arange(q // common) * common / q
    carry = np.floor(at).astype(np.int64)
    dr = at - carry
    return HarmonicTable(base, common, carry, dr, weights_at(dr, phase.m) if phase.table_bytes <= MAX_TABLE_BYTES else None)


def phase_of(r_lo: float, step: float, nharms: int, m: int) -> Phase | None:
    """The exact grid, or None if ``step`` is no fraction with a small denominator (its trials are then floating-point numbers)."""
    exact = trial_grid_rational(step)
    return None if exact is None else Phase(float(r_lo), exact, nharms, m)


def phase_table(spark: SparkSession, phase: Phase) -> DataFrame:
    """``(h, residue, base, carry, dr, weights array<struct<re, im>>)``: what a trial's harmonic needs, by its residue.

    The table has at most ``MAX_TABLE_BYTES`` and does not grow with the trials.
    """
    if phase.table_bytes > MAX_TABLE_BYTES:
        raise ValueError(f"{phase.table_bytes} bytes of weights: use interp_direct for such a grid")
    p, q = phase.step.numerator, phase.step.denominator
    start = [Fraction(phase.r_lo) * h for h in range(1, phase.nharms + 1)]
    heads = spark.createDataFrame([(h, math.gcd(h * p, q), math.floor(s), float(s - math.floor(s))) for h, s in enumerate(start, 1)], "h int, common bigint, base bigint, start double")
    rows = heads.withColumn("residue", F.explode(F.sequence(F.lit(0), F.lit(q) - F.col("common"), F.col("common"))))
    at = F.col("start") + F.col("residue") / F.lit(float(q))
    rows = rows.withColumn("carry", F.floor(at)).withColumn("dr", at - F.floor(at))
    return rows.select("h", "residue", "base", "carry", "dr", _weights(F.col("dr"), phase.m).alias("weights"))


def _weights(dr: Column, m: int) -> Column:
    s, c = F.sin(F.pi() * dr), F.cos(F.pi() * dr)

    def one(j: Column) -> Column:
        gap = F.when(dr == 0, F.lit(1.0)).otherwise(dr - j)
        at_bin = F.when(j == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        return F.struct(
            F.when(dr == 0, at_bin).otherwise(s * c / F.pi() / gap).alias("re"),
            F.when(dr == 0, F.lit(0.0)).otherwise(-s * s / F.pi() / gap).alias("im"),
        )

    return F.transform(F.sequence(F.lit(-m // 2 + 1), F.lit(m // 2)), one)


def interp_tabulated(grid: DataFrame, spec: DataFrame, phase: Phase, keys: list[str]) -> DataFrame:
    """``(keys, h, re, im)`` of all harmonics of the trials ``t`` of ``grid``, by weights looked up for each residue.

    The table is broadcast (its size is bounded), so only the band of bins around
    each point is joined: an equi-join on (obs, bin), as in ``interp_direct``.
    """
    p, q, m = phase.step.numerator, phase.step.denominator, phase.m
    product = F.col("t") * F.col("h") * F.lit(p)
    points = grid.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(phase.nharms)))).withColumn("residue", product % q).withColumn("_whole", F.expr(f"(t * h * {p}L) div {q}L"))
    near = points.join(F.broadcast(phase_table(grid.sparkSession, phase)), ["h", "residue"]).withColumn("_first", F.col("base") + F.col("_whole") + F.col("carry") - (m // 2 - 1))
    near = near.select(*grid.columns, "h", "_first", F.posexplode("weights").alias("_j", "_w")).withColumn("bin", F.col("_first") + F.col("_j"))
    re = F.col("_w.re") * F.col("re") - F.col("_w.im") * F.col("im")
    im = F.col("_w.re") * F.col("im") + F.col("_w.im") * F.col("re")
    return near.join(spec, ["obs", "bin"]).groupBy(*keys, "h").agg(F.sum(re).alias("re"), F.sum(im).alias("im"))
