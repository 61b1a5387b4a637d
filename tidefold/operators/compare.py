"""Comparing two candidate lists, and counting a search's work."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.operators import bank
from tidefold.shared import settled

#: Pairs of an observation that one task settles.
SMALL = 20_000


def crossmatch(a: DataFrame, b: DataFrame, t_span: float, tol_bins: float, small: int = SMALL) -> DataFrame:
    """``(obs, id_a, id_b, dist_bins)``: one-to-one matches of nearest candidates, the strongest of ``a`` first.

    Inputs: obs, id, freq, snr.  Unmatched rows of either side have a null on the
    other.  Candidate pairs come from a join on frequency cells as wide as the
    tolerance.  Pairs are accepted in the order of strength (falling), id of
    ``a``, distance, id of ``b``; a pair that comes first for both of its
    members is accepted whatever happens elsewhere, so while an observation has
    more than ``small`` pairs they are accepted in rounds of such pairs, and the
    rest, which no accepted pair touches, a group at a time.
    """
    left = a.select("obs", F.col("id").alias("id_a"), F.col("freq").alias("fa"), F.col("snr").alias("sa")).withColumn("cell", cell_of("fa", t_span, tol_bins))
    right = b.select("obs", F.col("id").alias("id_b"), F.col("freq").alias("fb"), F.col("snr").alias("sb"))
    right = right.withColumn("cell", F.explode(F.array(*[cell_of("fb", t_span, tol_bins) + d for d in (-1, 0, 1)])))
    dist = F.abs(F.col("fa") - F.col("fb")) * F.lit(t_span)
    pairs = left.join(right, ["obs", "cell"]).withColumn("d", dist).where(F.col("d") <= F.lit(tol_bins)).select("obs", "id_a", "sa", "id_b", "d")
    pairs, matched = settled(pairs, "pairs"), None
    while (pairs.groupBy("obs").count().agg(F.max("count")).first()[0] or 0) > small:
        order = F.struct(F.col("sa").isNull().alias("none"), (-F.col("sa")).alias("s"), "id_a", "d", "id_b")
        first = [pairs.groupBy("obs", side).agg(F.min(order).alias("o")).select("obs", F.col("o.id_a").alias("id_a"), F.col("o.id_b").alias("id_b"), F.col("o.d").alias("d")) for side in ("id_a", "id_b")]
        agreed = settled(first[0].join(first[1].drop("d"), ["obs", "id_a", "id_b"]), "agreed")
        matched = agreed if matched is None else matched.unionByName(agreed)
        pairs = settled(pairs.join(agreed.select("obs", "id_a"), ["obs", "id_a"], "left_anti").join(agreed.select("obs", "id_b"), ["obs", "id_b"], "left_anti"), "pairs")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sa", "id_a", "d", "id_b"], ascending=[False, True, True, True], kind="stable")
        used_a, used_b, taken = set(), set(), []
        for i, (x, y) in enumerate(zip(pdf["id_a"], pdf["id_b"])):
            if x not in used_a and y not in used_b:
                used_a.add(x), used_b.add(y)
                taken.append(i)
        return pdf.iloc[taken][["obs", "id_a", "id_b", "d"]]

    kinds = f"obs {a.schema['obs'].dataType.simpleString()}, id_a {a.schema['id'].dataType.simpleString()}, id_b {b.schema['id'].dataType.simpleString()}, d double"
    rest = pairs.groupBy("obs").applyInPandas(choose, kinds)
    matched = settled((rest if matched is None else rest.unionByName(matched.select("obs", "id_a", "id_b", "d"))).withColumnRenamed("d", "dist_bins"), "matched")
    only_a = left.join(matched, ["obs", "id_a"], "left_anti").select("obs", "id_a", F.lit(None).cast(b.schema["id"].dataType).alias("id_b"), F.lit(None).cast("double").alias("dist_bins"))
    only_b = b.select("obs", F.col("id").alias("id_b")).join(matched, ["obs", "id_b"], "left_anti")
    only_b = only_b.select("obs", F.lit(None).cast(a.schema["id"].dataType).alias("id_a"), "id_b", F.lit(None).cast("double").alias("dist_bins"))
    return matched.unionByName(only_a).unionByName(only_b)


def cell_of(freq: str, t_span: float, tol_bins: float):
    return F.floor(F.col(freq) * F.lit(t_span) / F.lit(tol_bins))


def harmonic_of(cands: DataFrame, bases: DataFrame, t_span: float, tol_bins: float, numharm: int = 8) -> DataFrame:
    """``cands`` that lie at a ratio n/m of some base (but n = m = 1): a semi join on cells of the predicted frequencies.

    Frequencies that an observation has more than once are compared once.  The joins
    are merged by hint: Spark's estimate doesn't count the rows that ``explode`` adds,
    and would send all predictions to the driver for a broadcast.
    """
    nm = F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n in range(1, numharm + 1) for m in range(1, numharm + 1) if n != 1 or m != 1]))
    pred = bases.select("obs", F.col("freq").alias("fb")).distinct().select("obs", "fb", nm.alias("nm")).select("obs", (F.col("fb") * F.col("nm.n") / F.col("nm.m")).alias("pred"))
    pred = pred.withColumn("cell", cell_of("pred", t_span, tol_bins)).hint("merge")
    near = cands.select("obs", "freq").distinct().withColumn("cell", F.explode(F.array(*[cell_of("freq", t_span, tol_bins) + d for d in (-1, 0, 1)])))
    cond = (F.col("c.obs") == F.col("p.obs")) & (F.col("c.cell") == F.col("p.cell")) & (F.abs(F.col("c.freq") - F.col("p.pred")) * F.lit(t_span) <= F.lit(tol_bins))
    found = near.alias("c").join(pred.alias("p"), cond, "left_semi").select("obs", "freq").distinct()
    return cands.join(found.hint("merge"), ["obs", "freq"], "left_semi").select(cands.columns)


def work_of(searches: DataFrame, kmax: int, fsp: float = 1.5, maxfrac: float = 0.3) -> DataFrame:
    """``(obs, k, nbins, nwidths, profiles, bins, bin_widths)``: the work of each search ``(obs, r_lo, r_hi, nharms, hidr)`` by fold.

    Trials come from each row's own grid, folds and banks from its number of
    harmonics; rows with a null or an empty range, or fewer than two harmonics, do no work.
    """
    step = F.col("hidr") / F.col("nharms")
    trials = F.floor((F.col("r_hi") - F.col("r_lo")) / F.when(step > 0, step)) + 1
    each = searches.withColumn("profiles", trials).where("profiles > 0").withColumn("nharms", F.col("nharms").cast("bigint"))
    rungs = bank.decimation_rungs(searches.select("nharms"), kmax)
    widths = bank.width_banks(rungs, fsp, maxfrac).groupBy("nbins").agg(F.count(F.lit(1)).alias("nwidths"))
    stages = rungs.join(widths, "nbins")
    return each.join(stages, "nharms").select(
        "obs", "k", "nbins", "nwidths", "profiles", (F.col("profiles") * F.col("nbins")).alias("bins"), (F.col("profiles") * F.col("nbins") * F.col("nwidths")).alias("bin_widths")
    )
