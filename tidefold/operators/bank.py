"""Boxcar banks as relations: one bank for every profile length in the data, by recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefold.params import LADDER_WMAX


def width_banks(lengths: DataFrame, fsp: float = 1.5, maxfrac: float = 0.3) -> DataFrame:
    """``(nbins, w)``: for each distinct ``nbins`` the widths from 1 up, ``fsp`` times wider each, to ``maxfrac`` of the profile.

    Null lengths are left out; a length below 1 has the width 1.  All banks grow
    together, a width a step, so the steps are those of the longest bank.
    """
    heads = lengths.where(F.col("nbins").isNotNull()).select(F.col("nbins").cast("bigint").alias("nbins")).distinct()
    return heads.sparkSession.sql(
        """WITH RECURSIVE bank AS (
            SELECT nbins, 1L AS w, greatest(1L, CAST(floor(:maxfrac * nbins) AS BIGINT)) AS last FROM {heads}
            UNION ALL
            SELECT nbins, greatest(CAST(floor(:fsp * w) AS BIGINT), w + 1), last FROM bank WHERE greatest(CAST(floor(:fsp * w) AS BIGINT), w + 1) <= last)
        SELECT nbins, w FROM bank""",
        args={"fsp": float(fsp), "maxfrac": float(maxfrac)},
        heads=heads,
    )


def decimation_rungs(harmonics: DataFrame, kmax: int) -> DataFrame:
    """``(nharms, k, nbins)``: for each distinct ``nharms`` the decimations that leave two harmonics at least, 1 to ``kmax``."""
    heads = harmonics.where(F.col("nharms") >= 2).select(F.col("nharms").cast("bigint").alias("nharms")).distinct()
    rungs = heads.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), F.least(F.lit(max(1, kmax)).cast("bigint"), F.expr("nharms div 2")))))
    return rungs.withColumn("nbins", 2 * F.expr("nharms div k"))


def ladder_banks(rungs: DataFrame, fsp: float = 1.5, maxfrac: float = 0.3) -> DataFrame:
    """``(nharms, k, nbins, w)`` for ``rungs(nharms, k, nbins)``: the bank of each rung without what another rung covers.

    Width 1 stays on the lowest rung only, widths above ``LADDER_WMAX`` on the
    highest only.  A single rung, or one whose neighbours are further apart than
    the kept widths reach, keeps its bank, and so does one that would keep none.
    """
    ladder = Window.partitionBy("nharms")
    steps = F.lead("k").over(ladder.orderBy("k"))
    marked = rungs.withColumn("_wide", 2 * steps > LADDER_WMAX * F.col("k"))
    whole = (F.min("k").over(ladder) == F.max("k").over(ladder)) | F.coalesce(F.max(F.col("_wide")).over(ladder), F.lit(False))
    marked = marked.withColumns({"_whole": whole, "_low": F.min("k").over(ladder), "_high": F.max("k").over(ladder)}).drop("_wide")
    banks = marked.join(width_banks(rungs, fsp, maxfrac), "nbins")
    fits = ((F.col("w") >= 2) | (F.col("k") == F.col("_low"))) & ((F.col("w") <= LADDER_WMAX) | (F.col("k") == F.col("_high")))
    banks = banks.withColumn("_fits", F.col("_whole") | fits)
    any_fits = F.max("_fits").over(Window.partitionBy("nharms", "k"))
    return banks.withColumn("_any", any_fits).where(F.col("_fits") | ~F.col("_any")).select("nharms", "k", "nbins", "w")
