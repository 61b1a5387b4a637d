"""Registered queries: metric statistics, normalisation, and candidate post-processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefold.operators import candidates, search, stats
from tidefold.params import log_edges
from tidefold.plans import sqlparts as q
from tidefold.plans.registry import register
from tidefold.plans.signal import event_spectrum, metrics, rd, table
from tidefold.plans.sqlparts import LADDER, NH, R_HI, R_LO, T, r6
from tidefold.sources import writers

WINDOWS = 3
LO, HI, NB = 0.0, 64.0, 3200
MET = q.all_metrics(LADDER)


def ladder(spark, sf):
    return metrics(spark, sf, LADDER)


def windowed(spark, sf):
    return stats.with_window(ladder(spark, sf), LADDER, T, R_LO, R_HI, WINDOWS)


def accumulators(spark, sf):
    """Counts, moments and histograms of each block: the trials are scored once and don't leave their task."""
    return search.block_accumulators(event_spectrum(spark, sf), LADDER, R_LO, R_HI, NH, 512)


def windowed_accumulators(spark, sf):
    return stats.with_window(accumulators(spark, sf), LADDER, T, R_LO, R_HI, WINDOWS)


def _edges() -> str:
    return ", ".join(f"({k}, {i + 1}, {e!r}::DOUBLE)" for k in LADDER.decimations for i, e in enumerate(log_edges(k * R_LO / T, k * R_HI / T, WINDOWS)))


WIN = f"""
edge(k, i, f) AS (VALUES {_edges()}),
centre AS (SELECT DISTINCT k, block, k * (({R_LO} + block * {LADDER.blocksize} * {LADDER.lodr}::DOUBLE) + least({R_LO} + block * {LADDER.blocksize} * {LADDER.lodr}::DOUBLE + {(LADDER.blocksize - 1) * LADDER.lodr}::DOUBLE, {R_HI})) / 2 / {T} AS f FROM met),
win AS (SELECT c.k, c.block, greatest(1, least(count(*) FILTER (e.f <= c.f), {WINDOWS}))::INTEGER AS win FROM centre c JOIN edge e ON e.k = c.k GROUP BY c.k, c.block, c.f),
wmet AS (SELECT m.*, w.win FROM met m JOIN win w ON w.k = m.k AND w.block = m.block)"""


def hist_sql(source: str, keys: str, out: str) -> str:
    return f"""
{out} AS (SELECT {keys}, (CASE WHEN metric < {LO} THEN -1 WHEN metric >= {HI} THEN {NB} ELSE floor((metric - {LO}) * {NB / (HI - LO)}) END)::BIGINT AS bin, count(*) AS n FROM {source} GROUP BY ALL)"""


def quant_sql(hist: str, keys: str, qs: dict[str, float], out: str) -> str:
    w = (HI - LO) / NB
    value = lambda p: f"CASE WHEN bin < 0 THEN {LO} WHEN bin >= {NB} THEN {HI} ELSE {LO} + bin * {w}::DOUBLE + ({p}::DOUBLE * total - (cum - n)) / n * {w}::DOUBLE END"
    outs = ", ".join(f"min_by({value(p)}, bin) FILTER (cum >= {p}::DOUBLE * total) AS {name}" for name, p in qs.items())
    return f"""
c_{out} AS (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY bin) AS cum, sum(n) OVER (PARTITION BY {keys}) AS total FROM {hist}),
{out} AS (SELECT {keys}, {outs} FROM c_{out} GROUP BY {keys})"""


@register(
    "block_metric_stats",
    f"""{MET} SELECT obs, k, block, count(*) AS n, {r6(f"min(r) / {T} * 1e3")} AS flo, {r6(f"max(r) / {T} * 1e3")} AS fhi, {r6("min(metric)")} AS vmin, {r6("median(metric)")} AS vmedian,
{r6("avg(metric)")} AS vmean, {r6("coalesce(stddev_samp(metric), 0)")} AS vstd, {r6("max(metric)")} AS vmax FROM met GROUP BY obs, k, block""",
)
def _(spark, sf):
    out = stats.block_stats(accumulators(spark, sf), T)
    return out.select("obs", "k", "block", "n", rd(F.col("flo") * 1e3, "flo"), rd(F.col("fhi") * 1e3, "fhi"), *(rd(c) for c in ("vmin", "vmedian", "vmean", "vstd", "vmax")))


@register("metric_histogram", f"{MET},{hist_sql('met', 'obs, k', 'h')} SELECT obs, k, bin, n FROM h")
def _(spark, sf):
    return stats.merged_histogram(accumulators(spark, sf), ["obs", "k"])


@register("log_windows", f"{MET},{WIN} SELECT obs, k, block, win, count(*) AS n FROM wmet GROUP BY obs, k, block, win")
def _(spark, sf):
    return windowed(spark, sf).groupBy("obs", "k", "block", "win").agg(F.count(F.lit(1)).alias("n"))


@register("metric_histogram_rollup", f"{MET},{WIN} SELECT obs, k, win, count(*) AS total, {r6('sum(metric)')} AS total_metric FROM wmet GROUP BY ROLLUP (obs, k, win)")
def _(spark, sf):
    return windowed_accumulators(spark, sf).rollup("obs", "k", "win").agg(F.sum("n").alias("total"), rd(F.sum(F.col("n") * F.col("vmean")), "total_metric"))


QS = {"q50": 0.5, "q90": 0.9, "q99": 0.99}


@register("hist_quantiles", f"{MET},{hist_sql('met', 'obs, k', 'h')},{quant_sql('h', 'obs, k', QS, 'qq')} SELECT obs, k, {', '.join(f'{r6(x)} AS {x}' for x in QS)} FROM qq")
def _(spark, sf):
    return stats.quantiles(stats.merged_histogram(accumulators(spark, sf), ["obs", "k"]), ["obs", "k"], QS).select("obs", "k", *(rd(x) for x in QS))


FAP = {"vmedian": 0.5} | {f"fap{i + 1}": 1 - p for i, p in enumerate(stats.FAPS)}


@register(
    "fap_windows",
    f"""{MET},{WIN},{hist_sql("wmet", "obs, k, win", "h")},{quant_sql("h", "obs, k, win", FAP, "qq")},
mo AS (SELECT obs, k, win, count(*) AS ntrials, count(DISTINCT block) AS nblocks, min(metric) AS vmin, max(metric) AS vmax, avg(metric) AS vmean, coalesce(stddev_samp(metric), 0) AS vstd, avg((metric >= {HI})::INTEGER) AS overflow FROM wmet GROUP BY obs, k, win)
SELECT mo.obs, mo.k, mo.win, ntrials, nblocks, {", ".join(f"{r6(x)} AS {x}" for x in ("vmin", "vmax", "vmean", "vstd", "overflow", *FAP))} FROM mo JOIN qq ON qq.obs = mo.obs AND qq.k = mo.k AND qq.win = mo.win""",
)
def _(spark, sf):
    out = stats.merged_summary(windowed_accumulators(spark, sf), ["obs", "k", "win"])
    return out.select("obs", "k", "win", "ntrials", "nblocks", *(rd(c) for c in ("vmin", "vmax", "vmean", "vstd", "overflow", *FAP)))


@register(
    "histogram_dump",
    f"""{MET},{hist_sql("met", "obs, k", "h")}, i AS (SELECT * FROM h WHERE bin BETWEEN 0 AND {NB - 1}), e AS (SELECT obs, k, min(bin) AS lo, max(bin) AS hi FROM i GROUP BY obs, k),
s AS (SELECT obs, k, unnest(range(lo, hi + 1)) AS bin FROM e) SELECT s.obs, s.k, {r6(f"{LO} + (s.bin + 0.5::DOUBLE) * {(HI - LO) / NB}::DOUBLE")} AS x, coalesce(n, 0)::BIGINT AS n FROM s LEFT JOIN i ON i.obs = s.obs AND i.k = s.k AND i.bin = s.bin""",
)
def _(spark, sf):
    return writers.histogram_dump(stats.merged_histogram(accumulators(spark, sf), ["obs", "k"]), ["obs", "k"]).select("obs", "k", rd("x"), "n")


@register(
    "fap_drift",
    f"""{MET},{WIN},{hist_sql("wmet", "obs, k, win", "h")},{quant_sql("h", "obs, k, win", {"fap1": 0.9, "fap2": 0.99}, "qq")}
SELECT obs, k, {r6("min(fap1)")} AS fap1_min, {r6("max(fap1)")} AS fap1_max, {r6("min(fap2)")} AS fap2_min, {r6("max(fap2)")} AS fap2_max FROM qq GROUP BY obs, k""",
)
def _(spark, sf):
    out = writers.drift(stats.merged_summary(windowed_accumulators(spark, sf), ["obs", "k", "win"], (0.1, 0.01)))
    return out.select("obs", "k", *(rd(c) for c in ("fap1_min", "fap1_max", "fap2_min", "fap2_max")))


GOOD = f"SELECT obs, block, least({NH} / avg(r), {LADDER.nharms}) AS ngoodbins FROM met WHERE k = 1 GROUP BY obs, block"


@register("good_harmonics", f"{MET} SELECT obs, block, {r6('ngoodbins')} AS ngoodbins FROM ({GOOD})")
def _(spark, sf):
    return stats.good_harmonics_of(accumulators(spark, sf), LADDER.nharms, NH).select("obs", "block", rd("ngoodbins"))


@register(
    "block_table_lines",
    f"""{MET}, st AS (SELECT obs, k, block, count(*) AS n, min(r) / {T} AS flo, max(r) / {T} AS fhi, min(metric) AS vmin, median(metric) AS vmedian, avg(metric) AS vmean, coalesce(stddev_samp(metric), 0) AS vstd, max(metric) AS vmax FROM met GROUP BY obs, k, block)
SELECT st.obs, k, st.block, printf('%-8d %3d %4d %5d %10.3f %14.8f %14.8f %8d %9.3f %9.3f %9.3f %9.3f %9.3f', st.block, k, {LADDER.nharms} // k, 2 * ({LADDER.nharms} // k), ngoodbins, flo, fhi, n, vmin, vmedian, vmean, vstd, vmax) AS line
FROM st JOIN ({GOOD}) g ON g.obs = st.obs AND g.block = st.block""",
)
def _(spark, sf):
    acc = accumulators(spark, sf)
    return writers.block_table(stats.block_stats(acc, T), LADDER.nharms, stats.good_harmonics_of(acc, LADDER.nharms, NH))


FILE_QS = {"vmedian": 0.5} | {f"fap{i + 1}": 1 - p for i, p in enumerate((0.1, 0.01, 1e-3, 1e-4, 1e-5))}


@register(
    "fap_table_lines",
    f"""{MET},{WIN},{hist_sql("wmet", "obs, k, win", "h")},{quant_sql("h", "obs, k, win", FILE_QS, "qq")},
mo AS (SELECT obs, k, win, count(*) AS n, min(r) / {T} AS flo, max(r) / {T} AS fhi, avg(metric) AS vmean, coalesce(stddev_samp(metric), 0) AS vstd FROM wmet GROUP BY obs, k, win)
SELECT mo.obs, mo.k, mo.win, printf('%-4d %4d %5d %4d %13.7f %13.7f %10d %8.3f %8.3f %8.3f | %7.3f %7.3f %7.3f %7.3f %7.3f', mo.k, {LADDER.nharms} // mo.k, 2 * ({LADDER.nharms} // mo.k), mo.win, flo, fhi, n, vmean, vstd, vmedian, fap1, fap2, fap3, fap4, fap5) AS line
FROM mo JOIN qq ON qq.obs = mo.obs AND qq.k = mo.k AND qq.win = mo.win""",
)
def _(spark, sf):
    return writers.fap_table(stats.merged_summary(windowed_accumulators(spark, sf), ["obs", "k", "win"], writers.FILE_FAPS), LADDER.nharms, T)


@register(
    "histogram_table_lines",
    f"""{MET},{WIN},{hist_sql("wmet", "obs, k, win", "h")}, i AS (SELECT * FROM h WHERE bin BETWEEN 0 AND {NB - 1}), e AS (SELECT obs, k, win, min(bin) AS lo, max(bin) AS hi FROM i GROUP BY obs, k, win),
w AS (SELECT obs, k, win, min(r) / {T} AS flo, max(r) / {T} AS fhi FROM wmet GROUP BY obs, k, win),
s AS (SELECT obs, k, win, unnest(range(lo, hi + 1)) AS bin FROM e)
SELECT s.obs, s.k, s.win, s.bin, printf('%-4d %4d %4d %13.7f %13.7f %12.5f %14d', s.k, {LADDER.nharms} // s.k, s.win, flo, fhi, {LO} + s.bin * {(HI - LO) / NB}::DOUBLE, coalesce(n, 0)) AS line
FROM s JOIN w ON w.obs = s.obs AND w.k = s.k AND w.win = s.win LEFT JOIN i ON i.obs = s.obs AND i.k = s.k AND i.win = s.win AND i.bin = s.bin""",
)
def _(spark, sf):
    return writers.histogram_table(stats.merged_histogram(windowed_accumulators(spark, sf), ["obs", "k", "win"], ranged=True), LADDER.nharms, T)


def norm_sql(min_trials: int) -> str:
    levels = {"loc": 0.5, "up": 0.8413}
    return f"""{MET},{WIN},{hist_sql("wmet", "obs, k, win", "hw")},{hist_sql("met", "obs, k", "hk")},{quant_sql("hw", "obs, k, win", levels, "qw")},{quant_sql("hk", "obs, k", levels, "qk")},
nw AS (SELECT obs, k, win, count(*) AS n FROM wmet GROUP BY obs, k, win),
norm AS (SELECT w.obs, w.k, w.win, CASE WHEN n >= {min_trials} AND w.up > w.loc THEN w.loc ELSE g.loc END AS loc,
  CASE WHEN n >= {min_trials} AND w.up > w.loc THEN w.up - w.loc WHEN g.up > g.loc THEN g.up - g.loc ELSE 1 END AS scale
  FROM qw w JOIN nw ON nw.obs = w.obs AND nw.k = w.k AND nw.win = w.win JOIN qk g ON g.obs = w.obs AND g.k = w.k)"""


@register("metric_norm", f"{norm_sql(200)} SELECT obs, k, win, {r6('loc')} AS loc, {r6('scale')} AS scale FROM norm")
def _(spark, sf):
    return stats.norm_model(windowed_accumulators(spark, sf)).select("obs", "k", "win", rd("loc"), rd("scale"))


@register("metric_norm_fallback", f"{norm_sql(1000)} SELECT obs, k, win, {r6('loc')} AS loc, {r6('scale')} AS scale FROM norm")
def _(spark, sf):
    """Windows of fewer than 1,000 trials take the model of their fold."""
    return stats.norm_model(windowed_accumulators(spark, sf), 1000).select("obs", "k", "win", rd("loc"), rd("scale"))


NORMALIZED = f"{norm_sql(1000)}, nz AS (SELECT m.obs, m.k, m.t, m.r, m.nharm, (metric - loc) / scale AS z FROM wmet m JOIN norm n ON n.obs = m.obs AND n.k = m.k AND n.win = m.win WHERE (metric - loc) / scale > 2)"


@register("normalized_candidates", f"{NORMALIZED} SELECT obs, k, t, {r6('r')} AS r, {r6('z')} AS z FROM nz")
def _(spark, sf):
    """Two passes: accumulators for the model, then only the trials above the limit leave their task."""
    norm = stats.norm_model(windowed_accumulators(spark, sf), 1000)
    out = search.normalized_trials(event_spectrum(spark, sf), LADDER, R_LO, R_HI, NH, T, norm, 2.0, WINDOWS, 512)
    return out.select("obs", "k", "t", rd("r"), rd("z"))


@register("search_normalized", f"{NORMALIZED} SELECT obs, {r6(f'r / {T} * 1e6')} AS freq_uhz, {r6('z')} AS metric, {r6('r')} AS r, nharm FROM nz")
def _(spark, sf):
    out = search.search_normalized(event_spectrum(spark, sf), LADDER, R_LO, R_HI, NH, T, 2.0, WINDOWS, 512, 1000)
    return out.select("obs", rd(F.col("freq") * 1e6, "freq_uhz"), rd("metric"), rd("r"), "nharm")


THRESHOLD = 2.5
CANDS = f"cands AS (SELECT obs, r, nharm, metric FROM met WHERE metric > {THRESHOLD})"
DEDUP = f"""{MET},{CANDS},
gaps AS (SELECT *, CASE WHEN r - lag(r) OVER (PARTITION BY obs ORDER BY r, metric, nharm) <= 1 THEN 0 ELSE 1 END AS brk FROM cands),
runs AS (SELECT *, sum(brk) OVER (PARTITION BY obs ORDER BY r, metric, nharm) AS run FROM gaps),
dd AS (SELECT obs, r, nharm, metric FROM (SELECT *, row_number() OVER (PARTITION BY obs, run ORDER BY metric DESC, r, nharm) AS rk FROM runs) WHERE rk = 1)"""


def found(spark, sf):
    return search.search(event_spectrum(spark, sf), LADDER, R_LO, R_HI, NH, T, THRESHOLD, 512)


def deduped(spark, sf):
    return candidates.remove_duplicates(found(spark, sf))


@register("remove_duplicates", f"{DEDUP} SELECT obs, {r6('r')} AS r, nharm, {r6('metric')} AS metric FROM dd")
def _(spark, sf):
    return deduped(spark, sf).select("obs", rd("r"), "nharm", rd("metric"))


#: Relation of two frequencies in bins, for n and m up to 16 within 1 bin per multiple.
RELATED = "len(list_filter(range(1, 17), lambda m: least({a}, {b}) > 0 AND round_even(m * greatest({a}, {b}) / least({a}, {b}), 0) BETWEEN 1 AND 16 AND abs(m * greatest({a}, {b}) - round_even(m * greatest({a}, {b}) / least({a}, {b}), 0) * least({a}, {b})) <= 1.0 * m)) > 0"


@register("harmonic_related_pairs", f"{DEDUP} SELECT x.obs, {r6('x.r')} AS ra, {r6('y.r')} AS rb FROM dd x JOIN dd y ON x.obs = y.obs AND x.r < y.r WHERE {RELATED.format(a='x.r', b='y.r')}")
def _(spark, sf):
    return candidates.harmonic_pairs(deduped(spark, sf), 16, 1.0).select("obs", rd("ra"), rd("rb"))


HARM = f"""{DEDUP.replace("WITH ", "WITH RECURSIVE ", 1)},
ranked AS (SELECT obs, r, nharm, metric, row_number() OVER (PARTITION BY obs ORDER BY metric DESC, r, nharm) AS rk FROM dd),
greedy(obs, rk, kept) AS (SELECT DISTINCT obs, 0::BIGINT, []::DOUBLE[] FROM dd UNION ALL
  SELECT c.obs, c.rk, CASE WHEN len(list_filter(g.kept, lambda y: {RELATED.format(a="y", b="c.r")})) > 0 THEN g.kept ELSE list_append(g.kept, c.r) END
  FROM greedy g JOIN ranked c ON c.obs = g.obs AND c.rk = g.rk + 1),
hh AS (SELECT c.obs, c.r, c.nharm, c.metric FROM ranked c JOIN (SELECT obs, unnest(arg_max(kept, rk)) AS r FROM greedy GROUP BY obs) k ON k.obs = c.obs AND k.r = c.r)"""


@register("remove_harmonics", f"{HARM} SELECT obs, {r6('r')} AS r, nharm, {r6('metric')} AS metric FROM hh")
def _(spark, sf):
    return candidates.remove_harmonics(deduped(spark, sf)).select("obs", rd("r"), "nharm", rd("metric"))


@register("remove_harmonics_rounds", f"{HARM} SELECT obs, {r6('r')} AS r, nharm, {r6('metric')} AS metric FROM hh")
def _(spark, sf):
    """The same by rounds of joins alone, as where an observation has more candidates than a task should settle."""
    return candidates.remove_harmonics(deduped(spark, sf), small=0).select("obs", rd("r"), "nharm", rd("metric"))


@register(
    "top_candidates",
    f"{HARM} SELECT obs, row_number() OVER (PARTITION BY obs ORDER BY metric DESC, r, nharm)::INTEGER AS rank, {r6('r')} AS r, nharm, {r6('metric')} AS metric FROM hh QUALIFY rank <= 10",
)
def _(spark, sf):
    out = candidates.top_candidates(candidates.remove_harmonics(deduped(spark, sf)), 10)
    return out.select("obs", "rank", rd("r"), "nharm", rd("metric"))


def _ducy_sql(m: int = 16) -> str:
    n_half = NH
    points = f"""
pts AS (SELECT d.obs, d.r AS cr, d.nharm AS nh, h.range AS h, d.r * h.range AS rh FROM dd d, range(1, 9) h WHERE h.range <= d.nharm),
okp AS (SELECT *, floor(rh + 1e-15) + 1 - {m // 2} >= 0 AND floor(rh + 1e-15) + 1 + {m // 2} <= {n_half} AND rh < {n_half} AS ok FROM pts),
use AS (SELECT obs, cr, nh, h, rh FROM (SELECT *, min(h) FILTER (NOT ok) OVER (PARTITION BY obs, cr, nh) AS bad FROM okp) WHERE bad IS NULL OR h < bad),{q.amplitudes("use", m, "obs, cr, nh, h", "ca")},
cn AS (SELECT obs, cr, nh, max(h) AS hh FROM ca GROUP BY obs, cr, nh),
cp AS (SELECT a.obs, a.cr, a.nh, n.hh, i.range AS i, sum(CASE WHEN h < hh THEN 2 * (re * cos(pi() * ((h * i.range) % (2 * hh)) / hh) - im * sin(pi() * ((h * i.range) % (2 * hh)) / hh)) ELSE re * cos(pi() * ((h * i.range) % (2 * hh)) / hh) END) / (2 * hh) AS v
  FROM ca a JOIN cn n ON n.obs = a.obs AND n.cr = a.cr AND n.nh = a.nh, range(16) i WHERE i.range < 2 * hh GROUP BY a.obs, a.cr, a.nh, n.hh, i.range)"""
    return points


@register("candidate_profile", f"{DEDUP},{_ducy_sql()} SELECT obs, {r6('cr')} AS r, nh AS nharm, i, {r6('v')} AS v FROM cp")
def _(spark, sf):
    out = candidates.candidate_profiles(deduped(spark, sf), event_spectrum(spark, sf), NH, 16)
    return out.select("obs", "r", "nharm", F.posexplode("profile").alias("i", "v")).select("obs", rd("r"), "nharm", F.col("i").cast("bigint").alias("i"), rd("v"))


def _ducy_scores() -> str:
    from tidefold.params import boxcar_widths

    parts, unions = [], []
    for hh in range(1, 9):
        bank = boxcar_widths(2 * hh)
        parts.append(f"cp{hh} AS (SELECT obs, cr, nh, i, v FROM cp WHERE hh = {hh}),{q.score(f'cp{hh}', 2 * hh, bank, f'cs{hh}', 'obs, cr, nh')}")
        unions.append(f"SELECT obs, cr, nh, width / {2 * hh}::DOUBLE AS ducy FROM cs{hh}")
    return ",\n".join(parts) + f",\ncd AS ({' UNION ALL '.join(unions)})"


@register(
    "measure_ducy",
    f"{DEDUP},{_ducy_sql()},{_ducy_scores()} SELECT d.obs, {r6('r')} AS r, d.nharm, {r6('metric')} AS metric, {r6('ducy')} AS ducy FROM dd d LEFT JOIN cd ON cd.obs = d.obs AND cd.cr = d.r AND cd.nh = d.nharm",
)
def _(spark, sf):
    out = candidates.measure_ducy(deduped(spark, sf), event_spectrum(spark, sf), NH, m=16)
    return out.select("obs", rd("r"), "nharm", rd("metric"), rd("ducy"))


__all__ = ["table"]
