"""Runs of neighbouring values (gaps and islands) without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, value: str, keys: list[str], breaks, band: Column, ties: list[str]) -> DataFrame:
    """``df`` with ``_island``: a new one begins where ``breaks(previous, value)`` holds along ``value`` per ``keys``.

    ``band`` (a non-decreasing function of ``value``) cuts each key's range into
    pieces that are sorted apart; only one row per band (its ends and its number
    of breaks) is ordered across bands.  Null values are left out.
    """
    given = df.where(F.col(value).isNotNull()).withColumn("_band", band)
    inner = Window.partitionBy(*keys, "_band").orderBy(value, *ties)
    prev = given.withColumn("_prev", F.lag(value).over(inner))
    step = F.when(F.col("_prev").isNull(), F.lit(0)).otherwise(breaks(F.col("_prev"), F.col(value)).cast("int"))
    marked = prev.withColumn("_step", step)
    across = Window.partitionBy(*keys).orderBy("_band") if keys else Window.partitionBy(F.lit(0)).orderBy("_band")
    bands = marked.groupBy(*keys, "_band").agg(F.max(value).alias("_hi"), F.min(value).alias("_lo"), F.sum("_step").alias("_n"))
    opened = F.coalesce(breaks(F.lag("_hi").over(across), F.col("_lo")), F.lit(True)).cast("int")
    offsets = (
        bands.withColumn("_open", opened)
        .withColumn("_base", F.sum("_open").over(across) + F.coalesce(F.sum("_n").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .select(*keys, "_band", "_base")
    )
    within = inner.rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumn("_in", F.sum("_step").over(within))
    return _join(numbered, offsets, [*keys, "_band"]).withColumn("_island", F.col("_in") + F.col("_base")).drop("_band", "_prev", "_step", "_in", "_base")


def _join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join on keys, where null keys are equal."""
    b = b.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = None
    for k in keys:
        same = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = same if on is None else on & same
    return a.join(b, on).drop(*[f"_r_{k}" for k in keys])
