"""Collapsing, ranking and measuring candidates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions.columns import related
from tidefold.operators.fold import as_arrays, coherent_profiles, usable_harmonics
from tidefold.operators.interp import fourier_interp, harmonics
from tidefold.operators.islands import islands
from tidefold.operators.metric import best_width
from tidefold.shared import settled

#: Undecided candidates of an observation that one task settles.
SMALL = 4096


def remove_duplicates(cands: DataFrame, dr_tol: float = 1.0) -> DataFrame:
    """The strongest of each run of candidates whose neighbours in ``r`` are at most ``dr_tol`` apart.

    Of equal metrics the smaller ``r`` (then fewer harmonics) stays.
    """
    band = F.floor(F.col("r") / F.lit(max(dr_tol, 1e-12) * 4096))
    runs = islands(cands, "r", ["obs"], lambda before, r: r - before > F.lit(dr_tol), band, ["metric", "nharm"])
    rank = F.row_number().over(Window.partitionBy("obs", "_island").orderBy(F.desc("metric"), "r", "nharm"))
    return runs.withColumn("_rank", rank).where("_rank = 1").select(*cands.columns)


def _greedy(pdf: pd.DataFrame, numharm: int, tol: float) -> pd.DataFrame:
    """Strongest first, the rows not related to one taken before."""
    pdf = pdf.sort_values(["metric", "r", "nharm"], ascending=[False, True, True], kind="stable")
    r = pdf["r"].to_numpy()
    m = np.arange(1, numharm + 1)[:, None]
    left, taken = np.arange(len(r)), []
    while len(left):
        taken.append(left[0])
        rest = left[1:]
        lo, hi = np.minimum(r[rest], r[left[0]]), np.maximum(r[rest], r[left[0]])
        ok = lo > 0
        n = np.rint(m * hi / np.where(ok, lo, 1.0))
        related_to = ((n >= 1) & (n <= numharm) & ok & (np.abs(m * hi - n * lo) <= tol * m)).any(axis=0)
        left = rest[~related_to]
    return pdf.iloc[taken]


def remove_harmonics(cands: DataFrame, numharm: int = 16, tol: float = 1.0, small: int = SMALL) -> DataFrame:
    """Strongest first, a candidate stays unless it is harmonically related to one that stayed.

    That is the first maximal independent set of the related candidates in the
    order of metric (falling), ``r``, ``nharm``.  While an observation has more
    than ``small`` undecided candidates it is found in rounds of joins: the
    strongest of each cell of ``tol`` in ``r`` (whose members are all related) is
    taken if no stronger undecided candidate is related to it, and those related
    to a taken one go.  Each round takes the strongest of every observation at
    least.  What is left then does not depend on what was taken, and is settled
    a group at a time.  Equal rows: one stays.
    """
    keys = ["obs", "r", "nharm", "metric"]
    rows = cands.where("r is not null and metric is not null").dropDuplicates(keys)
    undecided, taken = rows.select(*keys), None
    while _most(undecided, "obs") > small:
        undecided = settled(undecided, "undecided") if taken is None else undecided
        rank = F.struct((-F.col("metric")).alias("m"), "r", "nharm")
        cells = F.floor(F.col("r") / F.lit(max(tol, 1e-9)))
        tops = undecided.groupBy("obs", cells.alias("cell")).agg(F.min(rank).alias("a")).select("obs", F.col("a.r").alias("r"), "a")
        near = _meetings(tops, undecided.select("obs", "r", rank.alias("b")), numharm, tol, ("a", "b")).where("a <> b")
        near = settled(near, "near")
        blocked = near.where("b < a").select("obs", "a").distinct()
        won = settled(tops.select("obs", "a").join(blocked, ["obs", "a"], "left_anti"), "won")
        gone = near.join(won, ["obs", "a"], "left_semi").select("obs", F.col("b").alias("x")).unionByName(won.select("obs", F.col("a").alias("x"))).distinct()
        taken = won if taken is None else taken.unionByName(won)
        undecided = settled(undecided.withColumn("x", rank).join(gone, ["obs", "x"], "left_anti").drop("x"), "undecided")
    rest = undecided.groupBy("obs").applyInPandas(lambda pdf: _greedy(pdf, numharm, tol), undecided.schema)
    if taken is not None:
        rest = rest.unionByName(taken.select("obs", F.col("a.r").alias("r"), F.col("a.nharm").alias("nharm"), (-F.col("a.m")).alias("metric")))
    return rows.join(rest, keys, "left_semi").select(*cands.columns)


def _most(df: DataFrame, key: str) -> int:
    """Rows of the largest group."""
    return df.groupBy(key).count().agg(F.max("count")).first()[0] or 0


def _meetings(a: DataFrame, b: DataFrame, numharm: int, tol: float, keep: tuple[str, str]) -> DataFrame:
    """``(obs, keep)`` of all related pairs of ``a(obs, r, ..)`` and ``b(obs, r, ..)``.

    A related frequency lies within ``tol`` of a ratio ``n / m`` above or below, so rows meet in an equi-join
    on bins of ``2 * tol`` around each ratio instead of each with every other.
    """
    width = 2.0 * max(tol, 1e-9)
    ratios = sorted({n / m for m in range(1, numharm + 1) for n in range(1, numharm + 1)})
    at, reach = F.col("r") * F.col("q"), F.lit(tol + 1e-6)
    spread = a.where("r > 0").select("obs", "r", keep[0], F.explode(F.array(*[F.lit(q) for q in ratios])).alias("q"))
    spread = spread.select("obs", F.col("r").alias("_ra"), keep[0], F.explode(F.sequence(F.floor((at - reach) / width), F.floor((at + reach) / width))).alias("_bin")).distinct()
    other = b.where("r > 0").select("obs", F.col("r").alias("_rb"), keep[1], F.floor(F.col("r") / width).alias("_bin"))
    met = spread.join(other, ["obs", "_bin"])
    return met.where(related(F.least("_ra", "_rb"), F.greatest("_ra", "_rb"), numharm, tol)).select("obs", *keep).distinct()


def harmonic_pairs(cands: DataFrame, numharm: int = 16, tol: float = 1.0) -> DataFrame:
    """``(obs, ra, rb)``, ``ra < rb``: all pairs of one observation that are harmonically related.

    A related ``rb`` lies within ``tol`` of a ratio ``n / m`` of ``ra``, so candidates meet in an equi-join
    on bins of ``2 * tol`` around each of the ratios instead of each with every other.
    """
    width = 2.0 * max(tol, 1e-9)
    ratios = sorted({n / m for m in range(1, numharm + 1) for n in range(m, numharm + 1)})
    low = cands.where("r > 0").select("obs", F.col("r").alias("ra"), F.explode(F.array(*[F.lit(q) for q in ratios])).alias("q"))
    at, reach = F.col("ra") * F.col("q"), F.lit(tol + 1e-6)
    bins = F.sequence(F.floor((at - reach) / width), F.floor((at + reach) / width))
    low = low.select("obs", "ra", F.explode(bins).alias("bin")).distinct()
    high = cands.select("obs", F.col("r").alias("rb"), F.floor(F.col("r") / width).alias("bin"))
    pairs = low.join(high, ["obs", "bin"]).where("ra < rb")
    return pairs.where(related(F.col("ra"), F.col("rb"), numharm, tol)).select("obs", "ra", "rb").distinct()


def top_candidates(cands: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` strongest per observation, ranked from 1."""
    rank = F.row_number().over(Window.partitionBy("obs").orderBy(F.desc("metric"), "r", "nharm"))
    return cands.withColumn("rank", rank).where(F.col("rank") <= n)


def candidate_profiles(cands: DataFrame, spec: DataFrame, n_half: int, m: int = 64) -> DataFrame:
    """``(obs, r, nharm, profile)``: each candidate refolded at its own ``r`` with the wide kernel.

    Harmonics end at the first that passes Nyquist or the file; without any the profile is two zeros.
    """
    keys = ["obs", "r", "nharm"]
    base = cands.select(*keys).distinct()
    points = harmonics_of(base)
    usable = usable_harmonics(points, keys, m, n_half, n_half)
    amps = fourier_interp(usable, spec, [*keys, "h"], m)
    held = amps.groupBy(*keys).agg(F.max("h").alias("_H"))
    # profiles of one length share an inverse transform: the length is a column of the sum
    n = 2 * F.col("_H")
    each = amps.join(held, keys).withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
    angle = F.lit(2.0) * F.pi() * ((F.col("h") * F.col("i")) % n) / n
    wave = F.when(F.col("h") < F.col("_H"), 2 * (F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle))).otherwise(F.col("re") * F.cos(angle))
    long = each.groupBy(*keys, "i", "_H").agg((F.sum(wave) / (2.0 * F.first("_H"))).alias("v"))
    packed = as_arrays(long, keys)
    return base.join(packed, keys, "left").withColumn("profile", F.coalesce("profile", F.array(F.lit(0.0), F.lit(0.0))))


def harmonics_of(cands: DataFrame) -> DataFrame:
    return cands.withColumn("h", F.explode(F.sequence(F.lit(1), F.col("nharm")))).withColumn("rh", F.col("r") * F.col("h"))


def measure_ducy(cands: DataFrame, spec: DataFrame, n_half: int, fsp: float = 1.5, maxfrac: float = 0.3, m: int = 64) -> DataFrame:
    """``cands`` with ``ducy``: width of the best boxcar over the bins of the refolded profile; null without a usable harmonic."""
    profiles = candidate_profiles(cands.where((F.col("nharm") >= 1) & (F.col("r") > 0)), spec, n_half, m)
    found = best_width(profiles, fsp=fsp, maxfrac=maxfrac).select("obs", "r", "nharm", "ducy")
    return cands.drop("ducy").join(found, ["obs", "r", "nharm"], "left").select(*[c for c in cands.columns if c != "ducy"], "ducy")


__all__ = ["candidate_profiles", "coherent_profiles", "harmonic_pairs", "harmonics", "measure_ducy", "remove_duplicates", "remove_harmonics", "top_candidates"]
