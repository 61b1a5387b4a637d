"""Sifting candidates across dispersion measures and observations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefold.functions.columns import array_median
from tidefold.operators.islands import islands

# Scoring weights: fixed values that the ranking is defined by.
W_PERSIST, W_STRENGTH = 3.0, 3.0
W_DMEXTENT, DMEXTENT_CAP = 2.0, 6.0
W_DMPEAK, W_FREQ = 6.0, 5.0
P_EDGE, P_BROADBAND, P_SINGLEDM = 4.0, 2.0, 5.0
FREQ_COH_SCALE = 1e-4
HARMONIC_TOPK = 500
#: (numerator, denominator) in the order in which they are tried.
HARMONIC_RATIOS = [(n, 1) for n in range(2, 17)] + [(1, 2), (3, 2), (5, 2), (2, 3), (4, 3), (5, 3), (3, 4), (5, 4)]


def dm_grid(rows: DataFrame) -> DataFrame:
    """``(dm, dm_idx)``: the distinct measures, numbered from 0."""
    return rows.select("dm").distinct().withColumn("dm_idx", F.row_number().over(Window.orderBy("dm")) - 1)


def dm_step(grid: DataFrame) -> DataFrame:
    """One row ``(step)``: the median difference of neighbours, 1 for a single measure."""
    gaps = grid.select((F.lead("dm").over(Window.orderBy("dm")) - F.col("dm")).alias("g"))
    return gaps.agg(F.coalesce(F.median("g"), F.lit(1.0)).alias("step"))


def cluster_freq(rows: DataFrame, keys: list[str], tol: float, ties: list[str]) -> DataFrame:
    """Adds ``cluster``: along rising frequency a new one begins where the distance to the
    running mean of the open cluster is above ``tol`` times that mean.

    A gap above ``tol`` of the lower neighbour always begins a cluster, so the
    sequential step runs within such islands, which are independent.
    """
    band = F.floor(F.log2("freq") * 64)
    parts = islands(rows.where("freq > 0"), "freq", keys, lambda a, b: b - a > F.lit(tol) * a, band, ties)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["freq", *ties], kind="stable")
        out, n, total, k = [], 0, 0.0, -1
        for f in pdf["freq"].to_numpy():
            if n == 0 or abs(f - total / n) > tol * (total / n):
                n, total, k = 0, 0.0, k + 1
            n, total = n + 1, total + f
            out.append(k)
        return pdf.assign(_k=out)

    folded = parts.groupBy(*keys, "_island").applyInPandas(fold, parts.withColumn("_k", F.lit(0).cast("long")).schema)
    # numbered by first frequency, which rises with (island, place in island)
    return folded.withColumn("cluster", F.struct("_island", "_k")).withColumn("cluster", F.xxhash64("cluster")).drop("_island", "_k")


def detections(rows: DataFrame, within_tol: float, grid: DataFrame) -> DataFrame:
    """One row per (obs, cluster): the strongest row's values, the strongest hit per measure, and flags.

    ``rows``: obs, dm, snr, freq, period_ms, numharm, ducy, id.  Ties go to the
    lower frequency, then measure, then id.
    """
    near = cluster_freq(rows, ["obs"], within_tol, ["dm", "id"])
    order = F.struct(F.col("snr"), -F.col("freq"), -F.col("dm"), -F.col("id"))
    hits = near.groupBy("obs", "cluster", "dm").agg(
        F.max("snr").alias("hit_snr"),
        F.max_by(F.struct("freq", "period_ms", "numharm", "ducy", "snr", "dm", "id"), order).alias("top"),
    )
    last = grid.agg(F.max("dm_idx").alias("last_idx"))
    placed = hits.join(grid, "dm").crossJoin(F.broadcast(last))  # one row
    gap = F.col("dm_idx") - F.lag("dm_idx").over(Window.partitionBy("obs", "cluster").orderBy("dm_idx"))
    top_order = F.struct(F.col("top.snr"), -F.col("top.freq"), -F.col("top.dm"), -F.col("top.id"))
    return (
        placed.withColumn("gap", gap)
        .groupBy("obs", "cluster")
        .agg(
            F.max_by("top", top_order).alias("best"),
            F.max_by("dm_idx", top_order).alias("best_idx"),
            F.count(F.lit(1)).alias("ndms"),
            F.min("dm").alias("dm_min"),
            F.max("dm").alias("dm_max"),
            F.first("last_idx").alias("last_idx"),
            F.coalesce(F.bool_or(F.col("gap") == 1), F.lit(False)).alias("has_neighbour"),
            F.coalesce(F.bool_or(F.col("gap") > 1), F.lit(False)).alias("has_gaps"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("dm", F.struct("hit_snr", "top.freq"))))).alias("hits"),
        )
        .select(
            "obs",
            F.col("best.freq").alias("freq"),
            F.col("best.period_ms").alias("period_ms"),
            F.col("best.numharm").alias("numharm"),
            F.col("best.ducy").alias("ducy"),
            F.col("best.snr").alias("best_snr"),
            F.col("best.dm").alias("best_dm"),
            "ndms", "dm_min", "dm_max",
            ((F.col("best_idx") == 0) | (F.col("best_idx") == F.col("last_idx"))).alias("peak_at_edge"),
            (F.col("ndms") == F.col("last_idx") + 1).alias("full_span"),
            "has_neighbour", "has_gaps", "hits",
        )
    )


def _share(c: Column) -> Column:
    return F.avg(c.cast("double"))


def signals(dets: DataFrame, cross_tol: float, step: DataFrame, long_period_ms: float = 100.0) -> DataFrame:
    """Detections linked across observations; of one observation the strongest (then lowest frequency) counts."""
    near = cluster_freq(dets.drop("hits"), [], cross_tol, ["obs", "best_dm"])
    rank = F.row_number().over(Window.partitionBy("cluster", "obs").orderBy(F.desc("best_snr"), "freq"))
    best = near.withColumn("_rank", rank).where("_rank = 1")
    broad = F.col("full_span") & F.col("peak_at_edge") & (F.col("period_ms") < long_period_ms)
    dms = F.array_sort(F.collect_list("best_dm"))  # one entry per observation
    grouped = best.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.sum("best_snr").alias("sum_snr"),
        F.max("best_snr").alias("max_snr"),
        F.max_by(F.struct("freq", "period_ms"), F.struct(F.col("best_snr"), -F.col("freq"))).alias("top"),
        ((F.max("freq") - F.min("freq")) / F.avg("freq")).alias("freq_frac_spread"),
        dms.alias("_dms"),
        F.median("ndms").alias("median_ndms"),
        F.median("numharm").alias("numharm_med"),
        F.median("ducy").alias("ducy_med"),
        _share(F.col("peak_at_edge")).alias("frac_edge"),
        _share(~F.col("has_neighbour")).alias("frac_single"),
        _share(broad).alias("frac_broadband"),
        F.bool_and("full_span").alias("all_full_span"),
        F.sort_array(F.collect_list(F.struct("obs", "best_dm", "best_snr", "ndms", "dm_min", "dm_max", "peak_at_edge"))).alias("dets"),  # one an observation
    )
    spread = F.transform("_dms", lambda x: F.abs(x - F.col("dm_med")))
    outs = [c for c in grouped.columns if c not in ("cluster", "top", "_dms")]
    return (
        grouped.withColumn("dm_med", F.get("_dms", F.floor(F.size("_dms") / 2).cast("int")))  # the upper median
        .withColumn("mad", array_median(spread))
        .crossJoin(F.broadcast(step))  # one row
        .withColumn("dm_mad_steps", F.when(F.col("step") != 0, F.col("mad") / F.when(F.col("step") != 0, F.col("step"))).otherwise(0.0))
        .select("cluster", F.col("top.freq").alias("freq"), F.col("top.period_ms").alias("period_ms"), *outs, "dm_med", "dm_mad_steps")
    )


def mark_harmonics(sigs: DataFrame, tol: float = 1e-3) -> DataFrame:
    """Adds ``harmonic_of`` (frequency of the first matching stronger fundamental) and ``harm_str``.

    Only the ``HARMONIC_TOPK`` strongest by summed S/N times observations are
    compared, one after another: a bounded list, as its definition says.
    """
    top = sigs.orderBy(F.desc(F.col("sum_snr") * F.col("n_obs")), "freq").limit(HARMONIC_TOPK).select("cluster", "freq", (F.col("sum_snr") * F.col("n_obs")).alias("_w"), F.lit(0).alias("_one"))

    ratios = np.array([n / d for n, d in HARMONIC_RATIOS])
    names = [f"x{n}" if d == 1 else f"{n}/{d}" for n, d in HARMONIC_RATIOS]

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_w", "freq"], ascending=[False, True], kind="stable")
        f, clusters = pdf["freq"].to_numpy(), pdf["cluster"].to_numpy()
        left, parts = np.arange(len(f)), []
        while len(left):  # the strongest that is left is a fundamental, and takes its harmonics
            base, rest = f[left[0]], left[1:]
            near = np.abs(f[rest][:, None] - base * ratios) < tol * base * ratios
            hit = near.any(axis=1)
            parts += [(c, base, names[i]) for c, i in zip(clusters[rest[hit]].tolist(), near[hit].argmax(axis=1).tolist())]
            left = rest[~hit]
        return pd.DataFrame(parts, columns=["cluster", "harmonic_of", "harm_str"]).astype({"harm_str": object})

    found = top.groupBy("_one").applyInPandas(walk, "cluster bigint, harmonic_of double, harm_str string")
    return sigs.join(found, "cluster", "left")


def score_signals(sigs: DataFrame, min_dms: int = 2) -> DataFrame:
    """Adds ``components`` (map), ``score``, ``flags`` (array) and ``klass``."""
    coh = F.exp(-F.pow(F.col("freq_frac_spread") / FREQ_COH_SCALE, 2))
    parts = {
        "persist": W_PERSIST * F.col("n_obs") * (0.2 + 0.8 * coh),
        "strength": W_STRENGTH * F.log2(F.greatest("sum_snr", F.lit(1.0))) * (0.3 + 0.7 * coh),
        "dm_extent": W_DMEXTENT * F.least("median_ndms", F.lit(DMEXTENT_CAP)),
        "dm_consist": F.when(F.col("n_obs") >= 2, W_DMPEAK * F.exp(-F.pow(F.col("dm_mad_steps") / 3.0, 2))).otherwise(0.0),
        "freq_consist": W_FREQ * coh,
        "edge": -P_EDGE * F.col("frac_edge"),
        "broadband": -P_BROADBAND * F.col("frac_broadband"),
        "single_dm": -P_SINGLEDM * F.col("frac_single"),
    }
    harmonic = F.col("harmonic_of").isNotNull()
    total = None
    for p in parts.values():
        total = p if total is None else total + p
    total = total - F.when(harmonic, 100.0).otherwise(0.0)
    flag = lambda cond, name: F.when(cond, F.lit(name) if isinstance(name, str) else name)
    flags = F.array_compact(
        F.array(
            flag(F.col("n_obs") == 1, "single-obs"),
            flag(F.col("frac_edge") > 0.5, "edge-peaked"),
            flag(F.col("frac_broadband") > 0.0, "broadband"),
            flag(F.col("frac_single") > 0.5, "no-DM-neighbour"),
            flag((F.col("dm_mad_steps") > 3.0) & (F.col("n_obs") >= 2), "DM-inconsistent"),
            flag(F.col("all_full_span"), "full-DM-span"),
            flag(harmonic, F.format_string("harm(%s of %.6fHz)", "harm_str", "harmonic_of")),
        )
    )
    wide = F.col("median_ndms") >= min_dms
    klass = (
        F.when(harmonic, "harmonic")
        .when((F.col("frac_edge") > 0.5) | (F.col("frac_broadband") > 0.5), "RFI-like")
        .when((F.col("n_obs") >= 3) & (F.col("dm_mad_steps") <= 3.0) & (F.col("frac_edge") == 0.0) & wide, "PULSAR?")
        .when((F.col("n_obs") >= 2) & (F.col("frac_edge") < 0.5) & wide, "candidate")
        .otherwise("weak")
    )
    return sigs.withColumns({"components": F.create_map(*[x for n, p in parts.items() for x in (F.lit(n), p)]), "score": total, "flags": flags, "klass": klass})


def report(scored: DataFrame, min_obs: int = 1, min_score: float | None = None, top: int = 60) -> DataFrame:
    """The ``top`` signals by score, ranked from 1."""
    kept = scored.where(F.col("n_obs") >= min_obs)
    if min_score is not None:
        kept = kept.where(F.col("score") >= min_score)
    first = kept.orderBy(F.desc("score"), "freq").limit(top)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "freq")))


def report_lines(ranked: DataFrame, dm_decimals: int = 2) -> DataFrame:
    """``(rank, line)`` of the text report."""
    fmt = f"%-7d %-9s %14.9f %12.4f %5d %5d %7s %8.1f %8.1f %8.{dm_decimals}f %9.2f %7.1e  %s"
    ducy = F.when(F.col("ducy_med").isNull(), F.lit("-")).otherwise(F.format_string("%.2f", 100.0 * F.col("ducy_med")))
    line = F.format_string(
        fmt, "rank", "klass", "freq", "period_ms", "n_obs", F.rint("numharm_med").cast("int"), ducy,
        "sum_snr", "max_snr", "dm_med", "dm_mad_steps", "freq_frac_spread", F.concat_ws(";", "flags"),
    )
    return ranked.select("rank", line.alias("line"))


#: The header of the report's columns.
REPORT_HEADER = "# rank  class           freq(Hz)        P(ms)  #obs  #har   ducy%   sumS/N   maxS/N   peakDM  dMAD(st)  dffrac  flags"


def report_details(ranked: DataFrame, dm_decimals: int = 2) -> DataFrame:
    """``(rank, part, line)``: below a signal's line its score with all components, and a line per observation."""
    terms = F.transform(F.map_entries("components"), lambda e: F.concat(e["key"], F.lit("="), F.format_string("%+.1f", e["value"])))
    score = F.concat(F.format_string("        score=%.1f  [", "score"), F.array_join(terms, "  "), F.lit("]"))
    fmt = f"        %-14s peakDM=%.{dm_decimals}f  S/N=%.1f  #DM=%d  DMrange=[%.{dm_decimals}f,%.{dm_decimals}f]%s"
    each = F.transform("dets", lambda d: F.format_string(fmt, d["obs"], d["best_dm"], d["best_snr"], d["ndms"], d["dm_min"], d["dm_max"], F.when(d["peak_at_edge"], "  EDGE").otherwise("")))
    return ranked.select("rank", F.posexplode(F.concat(F.array(score), each)).alias("part", "line")).withColumn("part", F.col("part") + 1)


def report_header(rows: DataFrame, ranked: DataFrame, n_files: int, options: dict) -> list[str]:
    """The lines above the report: inputs, measures, tolerances, and the observations of the signals shown."""
    grid = rows.agg(F.count_distinct("dm").alias("n"), F.min("dm").alias("lo"), F.max("dm").alias("hi")).first()
    shown = [r[0] for r in ranked.select(F.explode("dets.obs").alias("obs")).distinct().orderBy("obs").collect()]  # observations of the report's signals
    d = options["dm_decimals"]
    return [
        "# candidate sift",
        "# %d input files, %d observations, %d DMs (%.*f - %.*f)" % (n_files, len(shown), grid["n"], d, grid["lo"] or 0.0, d, grid["hi"] or 0.0),
        "# within_tol=%.1e  cross_tol=%.1e  min_snr=%.1f  min_dms=%d  min_obs=%d" % tuple(options[k] for k in ("within_tol", "cross_tol", "min_snr", "min_dms", "min_obs")),
        "# observations: " + ", ".join(shown),
        "#",
        REPORT_HEADER,
    ]
