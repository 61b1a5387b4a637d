"""Detection metric of folded profiles: robust noise, median baseline, boxcar bank.

Profiles are ``(keys, profile array<double>)``; per-profile work is one vectorised
pass over Arrow batches of equal-length profiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidefold.functions.columns import array_median
from tidefold.params import SIGMA_SAMPLES, boxcar_widths


def boxcar_scan(profiles: np.ndarray, widths: list[int], baseline: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Best ``box sum / sqrt(width)`` of each row over all widths and phases, and its (narrowest) width."""
    n, nbins = profiles.shape
    x = profiles - np.median(profiles, axis=1, keepdims=True) if baseline else profiles
    wide = np.concatenate([x, x[:, : max(widths)]], axis=1)
    sums = np.concatenate([np.zeros((n, 1)), np.cumsum(wide, axis=1)], axis=1)
    best, width = np.full(n, -np.inf), np.full(n, widths[0])
    for w in widths:
        score = (sums[:, w : w + nbins] - sums[:, :nbins]).max(axis=1) / np.sqrt(w)
        better = score > best
        best[better], width[better] = score[better], w
    return best, width


def sampled_columns(n: int, nbins: int, cap: int = SIGMA_SAMPLES) -> np.ndarray:
    """Profiles of a block that the noise estimate reads: all, or as many whole ones as ``cap`` bins hold, evenly spread."""
    if n * nbins <= cap:
        return np.arange(n)
    take = min(n, max(1, cap // nbins))
    return (np.arange(take) * n) // take


def block_sigma_of(profiles: np.ndarray, cap: int = SIGMA_SAMPLES, center: str = "zero") -> float:
    n, nbins = profiles.shape
    if not n:
        return 0.0
    x = profiles[sampled_columns(n, nbins, cap)].ravel()[:cap] if n * nbins > cap else profiles.ravel()
    return 1.4826 * float(np.median(np.abs(x - np.median(x) if center == "median" else x)))


def _map_profiles(df: DataFrame, column: str, kind: str, fn: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """Append the columns that ``fn`` makes of each batch's profiles, rows of one length at a time; null or empty profiles give nulls."""
    outs = [x.split()[0] for x in kind.split(", ")]
    types = {"double": pa.float64(), "int": pa.int32()}
    arrow = [types[x.split()[1]] for x in kind.split(", ")]
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(at)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            order, made = [np.flatnonzero(sizes == 0)], []
            for size in sorted(set(sizes.tolist()) - {0}):
                rows = np.flatnonzero(sizes == size)
                flat = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
                order.append(rows)
                made.append(list(fn(flat.reshape(len(rows), size)).values()))
            back = pa.array(np.argsort(np.concatenate(order), kind="stable"))
            cols = [pa.concat_arrays([pa.nulls(len(order[0]), t), *(pa.array(part[o], t) for part in made)]).take(back) for o, t in enumerate(arrow)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *outs])

    added = StructType.fromDDL(kind)
    return df.mapInArrow(run, StructType([*df.schema.fields, *added.fields]))


def prefix_sums(df: DataFrame, keys: list[str], widest: int, column: str = "profile") -> DataFrame:
    """``(keys, i, psum)``: running sums of a profile about its median, tiled by its first ``widest`` bins; ``psum`` at 0 is 0.

    A box of ``w`` bins from phase p is the difference of the sums at p + w and p.
    """
    n = F.size(column)
    tiled = F.concat(F.col(column), F.slice(F.col(column), F.lit(1), F.least(n, F.lit(widest))))
    each = df.where(n > 0).select(*keys, array_median(F.col(column)).alias("_md"), F.posexplode(tiled).alias("i", "_v"))
    upto = Window.partitionBy(*keys).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sums = each.select(*keys, (F.col("i") + 1).alias("i"), F.sum(F.col("_v") - F.col("_md")).over(upto).alias("psum"))
    return sums.unionByName(df.where(n > 0).select(*keys, F.lit(0).alias("i"), F.lit(0.0).alias("psum")))


def boxcar_best(df: DataFrame, keys: list[str], banks: DataFrame, column: str = "profile") -> DataFrame:
    """``(keys, score, width)`` by relations alone: prefix sums joined at ``i + w`` for the widths ``banks(nbins, w)`` of each length.

    Equals ``boxcar_scan``; linear in bins times widths, with profiles of any lengths together.
    """
    widest = banks.agg(F.max("w")).first()[0] or 1  # one number
    sums = prefix_sums(df, keys, int(widest), column)
    sizes = df.select(*keys, F.size(column).alias("nbins"))
    starts = sums.join(sizes, keys).where(F.col("i") < F.col("nbins")).join(F.broadcast(banks), "nbins")
    starts = starts.select(*keys, "w", (F.col("i") + F.col("w")).cast("int").alias("i"), F.col("psum").alias("_from"))
    each = starts.join(sums, [*keys, "i"]).groupBy(*keys, "w").agg((F.max(F.col("psum") - F.col("_from")) / F.sqrt("w")).alias("s"))
    best = F.max(F.struct(F.round("s", 12), (-F.col("w")).alias("w"), "s")).alias("b")
    return each.groupBy(*keys).agg(best).select(*keys, F.col("b.s").alias("score"), (-F.col("b.w")).alias("width"))


def best_width(df: DataFrame, column: str = "profile", fsp: float = 1.5, maxfrac: float = 0.3) -> DataFrame:
    """Adds ``width`` and ``ducy``: the boxcar that matches best, narrowest on ties, and its share of the profile."""

    def fn(p: np.ndarray) -> dict[str, np.ndarray]:
        _, w = boxcar_scan(p, boxcar_widths(p.shape[1], fsp, maxfrac))
        return {"width": w.astype(np.int32), "ducy": w / p.shape[1]}

    return _map_profiles(df, column, "width int, ducy double", fn)


def boxcar_scores(df: DataFrame, column: str = "profile", widths: list[int] | None = None, baseline: bool = True) -> DataFrame:
    """Adds ``score``: the best box sum over sqrt(width) in units of the data; without a baseline it bounds the gate."""

    def fn(p: np.ndarray) -> dict[str, np.ndarray]:
        return {"score": boxcar_scan(p, widths or boxcar_widths(p.shape[1]), baseline)[0]}

    return _map_profiles(df, column, "score double", fn)


def block_sigma(df: DataFrame, block: str, order: str, column: str = "profile", cap: int | None = SIGMA_SAMPLES, center: str = "zero") -> DataFrame:
    """``(block, sigma)``: 1.4826 times the median absolute value of a block's bins (about their median for ``center="median"``).

    With ``cap`` whole profiles at evenly spread places are read, which bounds
    the exact median's state; the places depend on ``order`` in the block alone.
    """
    rows = df.select(F.col(block).alias("_b"), F.col(order).alias("_o"), F.col(column).alias("_p"))
    if cap is not None:
        w = Window.partitionBy("_b")
        rows = rows.withColumn("_j", F.row_number().over(w.orderBy("_o")) - 1).withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_k", F.size("_p"))
        take = F.least(F.col("_n"), F.greatest(F.lit(1), F.floor(F.lit(cap) / F.col("_k"))))
        # profile j is read if some c < take has floor(c n / take) = j
        c = F.floor((F.col("_j") * take + F.col("_n") - 1) / F.col("_n"))
        chosen = (c < take) & (F.floor(c * F.col("_n") / take) == F.col("_j"))
        rows = rows.where((F.col("_n") * F.col("_k") <= cap) | chosen).withColumn("_p", F.slice("_p", 1, cap))
    bins = rows.select("_b", F.explode("_p").alias("v"))
    if center == "median":
        mid = bins.groupBy("_b").agg(F.median("v").alias("m"))
        bins = bins.join(mid, "_b").select("_b", (F.col("v") - F.col("m")).alias("v"))
    return bins.groupBy("_b").agg((F.lit(1.4826) * F.median(F.abs("v"))).alias("sigma")).withColumnRenamed("_b", block)


def snr_metrics(df: DataFrame, block: str, order: str, column: str = "profile", widths: list[int] | None = None, cap: int | None = None, center: str = "zero") -> DataFrame:
    """Adds ``metric``: score over the block's noise; 0 for a flat block."""
    sigma = block_sigma(df, block, order, column, cap, center)
    value = F.when(F.col("sigma") > 0, F.col("score") / F.when(F.col("sigma") > 0, F.col("sigma"))).otherwise(0.0)
    return boxcar_scores(df, column, widths).join(sigma, block).withColumn("metric", value).drop("score", "sigma")
