"""Registered queries: spectra, interpolation, folding, metric and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions.columns import array_median, rotated_to_peak
from tidefold.operators import bank, fftgrid, fold, interp, metric, phase, search, spectrum
from tidefold.params import boxcar_widths
from tidefold.plans import sqlparts as q
from tidefold.plans.registry import register
from tidefold.plans.sqlparts import LADDER, NH, PARAMS, R_HI, R_LO, T, r6



def rd(c: str | Column, name: str | None = None) -> Column:
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).alias(name or c)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def event_spectrum(spark: SparkSession, sf: str, normal: bool = True) -> DataFrame:
    """The spectrum of every event type, an observation each."""
    series = spectrum.series_from_events(table(spark, sf, "events"), q.START, q.DT, q.N, F.col("event_type"))
    spec = spectrum.spectrum(series, q.N)
    return spectrum.normalized(spec) if normal else spec


def grid(spark: SparkSession, params=PARAMS, r_lo: float = R_LO, r_hi: float = R_HI) -> DataFrame:
    return interp.trial_grid(spark, r_lo, r_hi, params.lodr, params.blocksize)


def trials(spark: SparkSession, sf: str, params=PARAMS) -> DataFrame:
    """``(obs, t, block, r)``: the grid for every observation of the events."""
    kinds = table(spark, sf, "events").select(F.col("event_type").alias("obs")).distinct()
    own = kinds.select("obs", F.lit(R_LO).alias("r_lo"), F.lit(R_HI).alias("r_hi"), F.lit(params.lodr).alias("step"))
    return interp.trial_grids(own, params.blocksize).select("obs", "t", "block", "r")


def embedded(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as 64-bin profiles ``(vec_id, label, profile)``."""
    return table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("profile"))


EMB = "prof AS (SELECT vec_id, label, i.range AS i, embedding[i.range + 1]::DOUBLE AS v FROM embeddings, range(64) i)"


@register("spectrum_from_events", f"WITH {q.SPEC0} SELECT obs, bin, (round(re, 4) + 0.0) AS re, (round(im, 4) + 0.0) AS im FROM spec0")
def _(spark, sf):
    return event_spectrum(spark, sf, False).select("obs", "bin", (F.round("re", 4) + 0.0).alias("re"), (F.round("im", 4) + 0.0).alias("im"))


@register("spectrum_power_norm", f"WITH {q.SPEC} SELECT obs, bin, bin / {T} AS freq, {r6('re')} AS re, {r6('im')} AS im FROM spec")
def _(spark, sf):
    return spectrum.with_frequency(event_spectrum(spark, sf), T).select("obs", "bin", "freq", rd("re"), rd("im"))


# a grid of its own for each user: from the slowest frequency that the user's events span to as many bins as there are events
SPAN = """sp AS (SELECT user_id, count(*) AS n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6::DOUBLE AS span FROM events GROUP BY user_id),
gr AS (SELECT user_id, n, 1.0::DOUBLE AS r_lo, n::DOUBLE AS r_hi, 0.5::DOUBLE / (1 + user_id % 8) AS step FROM sp WHERE span > 0)"""


@register(
    "trial_grid",
    f"WITH {SPAN} SELECT user_id, t.range AS t, t.range // 64 AS block, {r6('r_lo + t.range * step')} AS r FROM gr, LATERAL (SELECT unnest(range(greatest(0, floor((r_hi - r_lo) / step) + 1)::BIGINT)) AS range) t",
)
def _(spark, sf):
    out = interp.trial_grids(user_grids(spark, sf), 64)
    return out.select("user_id", "t", "block", rd("r"))


def user_grids(spark, sf):
    span = (F.unix_micros(F.max(F.col("ts").cast("timestamp"))) - F.unix_micros(F.min(F.col("ts").cast("timestamp")))) / F.lit(1e6)
    per = table(spark, sf, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), span.alias("span")).where("span > 0")
    return per.select("user_id", F.lit(1.0).alias("r_lo"), F.col("n").cast("double").alias("r_hi"), (F.lit(0.5) / (1 + F.pmod("user_id", F.lit(8)))).alias("step"))


@register(
    "trial_blocks",
    f"WITH {q.SPEC},{q.trials()} SELECT obs, block, count(*) AS n, min(t) AS t_first, {r6('sum(re * re + im * im)')} AS power FROM tr JOIN spec ON bin = floor(r)::BIGINT GROUP BY obs, block",
)
def _(spark, sf):
    power = F.col("re") * F.col("re") + F.col("im") * F.col("im")
    near = grid(spark).withColumn("bin", F.floor("r")).join(event_spectrum(spark, sf), "bin")
    return near.groupBy("obs", "block").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t_first"), rd(F.sum(power), "power"))


@register(
    "interp_coeffs",
    f"""WITH v AS (SELECT vec_id, abs(embedding[1]::DOUBLE) - floor(abs(embedding[1]::DOUBLE)) AS dr FROM embeddings),
e AS (SELECT vec_id, j.range - {4} AS j, dr - (j.range - {4}) AS o FROM v, range(10) j),
s AS (SELECT vec_id, j, o, CASE WHEN o = 0 THEN 1 ELSE sin(pi() * o) / (pi() * o) END AS c FROM e)
SELECT vec_id, j, {r6("c * cos(pi() * o)")} AS re, {r6("c * sin(pi() * o)")} AS im FROM s""",
)
def _(spark, sf):
    x = F.abs(F.get("profile", F.lit(0)))
    return embedded(spark, sf).select("vec_id", F.inline(interp.interp_coeffs(x - F.floor(x), 10))).select("vec_id", "j", rd("re"), rd("im"))


KINDS = ("click", "error", "purchase", "signup", "view")
POINTS = f"pt AS (SELECT vec_id, ([{', '.join(repr(k) for k in KINDS)}])[vec_id % 5 + 1] AS obs, 100 + (vec_id % 1000) + abs(embedding[1]::DOUBLE) - floor(abs(embedding[1]::DOUBLE)) AS rh FROM embeddings)"


def kind_of(key: str) -> Column:
    return F.element_at(F.array(*[F.lit(k) for k in KINDS]), (F.pmod(key, F.lit(5)) + 1).cast("int")).alias("obs")


def points(spark, sf):
    x = F.abs(F.get("profile", F.lit(0)))
    return embedded(spark, sf).select("vec_id", kind_of("vec_id"), (F.lit(100) + F.pmod("vec_id", F.lit(1000)) + x - F.floor(x)).alias("rh"))


AT_POINTS = f"WITH {q.SPEC},{POINTS},{q.amplitudes('pt', 16, 'obs, vec_id')} SELECT vec_id, {r6('re')} AS re, {r6('im')} AS im FROM amp"


@register("interp_point", AT_POINTS)
def _(spark, sf):
    return interp.fourier_interp(points(spark, sf), event_spectrum(spark, sf), ["vec_id"], 16).select("vec_id", rd("re"), rd("im"))


@register("interp_direct", AT_POINTS)
def _(spark, sf):
    return interp.interp_direct(points(spark, sf), event_spectrum(spark, sf), ["vec_id"], 16).select("vec_id", rd("re"), rd("im"))


@register(
    "interp_multi",
    f"""WITH {q.SPEC},{POINTS},b AS (SELECT obs, floor(rh)::BIGINT AS fl, rh - floor(rh) AS d, vec_id FROM pt),
p AS (SELECT obs, vec_id, fl + (d + s.range / 4.0::DOUBLE) / 2 AS rh, s.range AS s FROM b, range(4) s),{q.amplitudes("p", 16, "obs, vec_id, s")}
SELECT vec_id, s, {r6("re")} AS re, {r6("im")} AS im FROM amp""",
)
def _(spark, sf):
    fl = F.floor("rh")
    near = points(spark, sf).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(3)).cast("array<bigint>")))
    near = near.withColumn("rh", fl + ((F.col("rh") - fl) + F.col("s") / 4.0) / 2)
    return interp.finterp_multi(near, event_spectrum(spark, sf), ["vec_id"], ["s"], 16).select("vec_id", "s", rd("re"), rd("im"))


BETWEEN = 4
GRID = f"g0 AS (SELECT obs, g.range AS g, g.range / {float(BETWEEN)}::DOUBLE AS rh FROM (SELECT DISTINCT obs FROM spec), range({NH * BETWEEN}) g)"


@register(
    "interp_grid_linear",
    f"""WITH {q.SPEC},{GRID},{q.amplitudes("g0", 16, "obs, g")},
p AS (SELECT vec_id, ([{', '.join(repr(k) for k in KINDS)}])[vec_id % 5 + 1] AS obs, least({NH * BETWEEN - 1}::DOUBLE, greatest(0::DOUBLE, (vec_id * 7.77::DOUBLE % 2200 - 10) * {BETWEEN})) AS x FROM embeddings),
c AS (SELECT vec_id, obs, x, least(floor(x), {NH * BETWEEN - 2})::BIGINT AS g FROM p)
SELECT c.vec_id, {r6("a.re * (1 - (x - c.g)) + b.re * (x - c.g)")} AS re, {r6("a.im * (1 - (x - c.g)) + b.im * (x - c.g)")} AS im
FROM c JOIN amp a ON a.obs = c.obs AND a.g = c.g JOIN amp b ON b.obs = c.obs AND b.g = c.g + 1""",
)
def _(spark, sf):
    at = embedded(spark, sf).select("vec_id", kind_of("vec_id"), ((F.col("vec_id") * F.lit(7.77)) % 2200 - 10).alias("rh"))
    fine = fftgrid.fine_grid_fft(event_spectrum(spark, sf), 0, NH, BETWEEN, 16, 512)
    return interp.linear_interp(at, fine, 0, NH, BETWEEN, ["vec_id"]).select("vec_id", rd("re"), rd("im"))


@register("interp_grid_fft", f"WITH {q.SPEC},{GRID},{q.amplitudes('g0', 16, 'obs, g')} SELECT obs, g, {r6('re')} AS re, {r6('im')} AS im FROM amp")
def _(spark, sf):
    """Every bin of every spectrum."""
    return fftgrid.fine_grid_fft(event_spectrum(spark, sf), 0, NH, BETWEEN, 16, 512).select("obs", "g", rd("re"), rd("im"))


@register(
    "harmonic_guard",
    f"""WITH {SPAN},
tr AS (SELECT user_id, n, t.range // 64 AS block, r_lo + t.range * step AS r FROM gr, LATERAL (SELECT unnest(range(greatest(0, floor((r_hi - r_lo) / step) + 1)::BIGINT)) AS range) t),
b AS (SELECT user_id, block, any_value(n) AS n, min(r) AS lo, max(r) AS hi FROM tr GROUP BY user_id, block)
SELECT user_id, block, h.range::INTEGER AS h, (floor(h.range * lo) + 2 - 8 >= 1 AND floor(h.range * hi) < 2 * n AND floor(h.range * hi) + 8 < 2 * n) AS ok FROM b, range(1, 9) h""",
)
def _(spark, sf):
    """A user's spectrum has two bins for each event; the guard differs from user to user."""
    trials_of = interp.trial_grids(user_grids(spark, sf), 64).withColumn("n_half", 2 * F.col("r_hi"))
    return interp.harmonic_guards(trials_of, 8, 16, ["user_id"])


@register("interp_tabulated", f"WITH {q.SPEC},{q.trials()},{q.trial_amps()} SELECT obs, t, h, {r6('re')} AS re, {r6('im')} AS im FROM amp")
def _(spark, sf):
    """All harmonics of all trials by weights looked up for exact residues."""
    exact = phase.phase_of(R_LO, PARAMS.lodr, PARAMS.nharms, PARAMS.m)
    out = phase.interp_tabulated(trials(spark, sf), event_spectrum(spark, sf), exact, ["obs", "t"])
    return out.select("obs", "t", F.col("h").cast("bigint").alias("h"), rd("re"), rd("im"))


EMB_AMP = "amp AS (SELECT vec_id, h.range AS h, embedding[2 * h.range - 1]::DOUBLE AS re, embedding[2 * h.range]::DOUBLE AS im FROM embeddings, range(1, 33) h)"
P32 = q.SearchParams(nharms=32, decimations=(1, 2, 3, 4, 5, 6))


def emb_amps(spark, sf):
    each = embedded(spark, sf).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(32))))
    return each.select("vec_id", "h", F.get("profile", 2 * F.col("h") - 2).alias("re"), F.get("profile", 2 * F.col("h") - 1).alias("im"))


@register("irfft_profiles", f"WITH {EMB_AMP},{q.profile(1, P32, 'vec_id')} SELECT vec_id, i, {r6('v')} AS v FROM prof1")
def _(spark, sf):
    return fold.coherent_profiles(emb_amps(spark, sf), ["vec_id"], 32).select("vec_id", F.col("i").cast("bigint").alias("i"), rd("v"))


@register("decim_profiles_k2", f"WITH {EMB_AMP},{q.profile(2, P32, 'vec_id')} SELECT vec_id, i, {r6('v')} AS v FROM prof2")
def _(spark, sf):
    return fold.coherent_profiles(fold.decimated(emb_amps(spark, sf), 32, 2), ["vec_id"], 16).select("vec_id", F.col("i").cast("bigint").alias("i"), rd("v"))


@register(
    "decim_profiles_all",
    f"WITH {EMB_AMP},{','.join(q.profile(k, P32, 'vec_id') for k in P32.decimations)} " + " UNION ALL ".join(f"SELECT {k} AS k, vec_id, {r6('sum(v * v)')} AS power, {r6('max(v)')} AS peak FROM prof{k} GROUP BY vec_id" for k in P32.decimations),
)
def _(spark, sf):
    amps, out = emb_amps(spark, sf), None
    for k in P32.decimations:
        part = fold.coherent_profiles(fold.decimated(amps, 32, k), ["vec_id"], 32 // k)
        part = part.groupBy("vec_id").agg(rd(F.sum(F.col("v") * F.col("v")), "power"), rd(F.max("v"), "peak")).withColumn("k", F.lit(k))
        out = part if out is None else out.unionByName(part)
    return out.select("k", "vec_id", "power", "peak")


TRIALS = f"WITH {q.SPEC},{q.trials()},{q.trial_amps()}"


@register("reference_profiles", f"{TRIALS},{q.profile(1)} SELECT obs, t, i, {r6('v')} AS v FROM prof1")
def _(spark, sf):
    amps = interp.interp_direct(interp.harmonics(trials(spark, sf), 8), event_spectrum(spark, sf), ["obs", "t", "h"], 16)
    return fold.coherent_profiles(amps, ["obs", "t"], 8).select("obs", "t", F.col("i").cast("bigint").alias("i"), rd("v"))


@register(
    "rotate_to_peak",
    f"WITH a AS (SELECT vec_id, embedding AS e, list_position(embedding, list_max(embedding)) - 1 AS peak FROM embeddings) SELECT vec_id, (i.range - peak + 32 + 64) % 64 AS i, {r6('e[i.range + 1]::DOUBLE')} AS v FROM a, range(64) i",
)
def _(spark, sf):
    turned = embedded(spark, sf).select("vec_id", F.posexplode(rotated_to_peak(F.col("profile"))).alias("i", "v"))
    return turned.select("vec_id", F.col("i").cast("bigint").alias("i"), rd("v"))


@register("profile_median", f"WITH {EMB} SELECT vec_id, {r6('median(v)')} AS med FROM prof GROUP BY vec_id")
def _(spark, sf):
    return embedded(spark, sf).select("vec_id", rd(array_median(F.col("profile")), "med"))


@register("block_sigma_zero", f"WITH {EMB} SELECT label, {r6('1.4826 * median(abs(v))')} AS sigma FROM prof GROUP BY label")
def _(spark, sf):
    return metric.block_sigma(embedded(spark, sf), "label", "vec_id", cap=None).select("label", rd("sigma"))


@register("block_sigma_median", f"WITH {EMB} SELECT label, {r6('1.4826 * mad(v)')} AS sigma FROM prof GROUP BY label")
def _(spark, sf):
    return metric.block_sigma(embedded(spark, sf), "label", "vec_id", cap=None, center="median").select("label", rd("sigma"))


@register("block_sigma_sampled", f"WITH {EMB}, q AS (SELECT vec_id % 3 AS block, vec_id AS t, i, v FROM prof),{q.sigma('q', 64, 'sg', 2048, 'block')} SELECT block, {r6('sg')} AS sigma FROM sg")
def _(spark, sf):
    df = embedded(spark, sf).withColumn("block", F.pmod("vec_id", F.lit(3)))
    return metric.block_sigma(df, "block", "vec_id", cap=2048).select("block", rd("sigma"))


BANK64 = boxcar_widths(64)


#: A profile length for every number of harmonics that the users' ids give.
HARMS = "hm AS (SELECT DISTINCT 2 + user_id % 90 AS nharms FROM events)"


def user_harmonics(spark, sf):
    return table(spark, sf, "events").select((2 + F.pmod("user_id", F.lit(90))).alias("nharms")).distinct()


def bank_sql(source: str) -> str:
    return f"""b AS (SELECT nbins, 1::BIGINT AS w, greatest(1, floor(0.3::DOUBLE * nbins))::BIGINT AS last FROM (SELECT DISTINCT nbins FROM {source})
  UNION ALL SELECT nbins, greatest(floor(1.5::DOUBLE * w), w + 1)::BIGINT, last FROM b WHERE greatest(floor(1.5::DOUBLE * w), w + 1) <= last)"""


@register("boxcar_widths", f"WITH RECURSIVE {HARMS}, n AS (SELECT 2 * nharms AS nbins FROM hm), {bank_sql('n')} SELECT nbins, w FROM b")
def _(spark, sf):
    return bank.width_banks(user_harmonics(spark, sf).select((2 * F.col("nharms")).alias("nbins")))


@register(
    "ladder_widths",
    f"""WITH RECURSIVE {HARMS}, rg AS (SELECT nharms, k.range AS k, 2 * (nharms // k.range) AS nbins FROM hm, range(1, 7) k WHERE nharms // k.range >= 2), {bank_sql('rg')},
e AS (SELECT nharms, min(k) AS lo, max(k) AS hi FROM rg GROUP BY nharms),
f AS (SELECT rg.nharms, rg.k, rg.nbins, w, lo = hi OR ((w >= 2 OR k = lo) AND (w <= 6 OR k = hi)) AS fits FROM rg JOIN b ON b.nbins = rg.nbins JOIN e ON e.nharms = rg.nharms)
SELECT nharms, k, nbins, w FROM f QUALIFY fits OR NOT bool_or(fits) OVER (PARTITION BY nharms, k)""",
)
def _(spark, sf):
    return bank.ladder_banks(bank.decimation_rungs(user_harmonics(spark, sf), 6))


@register(
    "boxcar_psum",
    f"WITH {EMB}, m AS (SELECT *, median(v) OVER (PARTITION BY vec_id) AS md FROM prof), w AS (SELECT vec_id, i, v - md AS x FROM m UNION ALL SELECT vec_id, i + 64, v - md FROM m WHERE i < {max(BANK64)}) SELECT vec_id, i + 1 AS i, {r6('sum(x) OVER (PARTITION BY vec_id ORDER BY i)')} AS psum FROM w UNION ALL SELECT vec_id, 0, 0.0::DOUBLE FROM embeddings",
)
def _(spark, sf):
    out = metric.prefix_sums(embedded(spark, sf), ["vec_id"], max(BANK64))
    return out.select("vec_id", F.col("i").cast("bigint").alias("i"), rd("psum"))


@register("boxcar_best_relational", f"WITH {EMB},{q.score('prof', 64, BANK64, 'sc', 'vec_id')} SELECT vec_id, {r6('best')} AS score, width FROM sc")
def _(spark, sf):
    """Best box sum and width by a join of prefix sums, with the bank of the profiles' own length."""
    rows = embedded(spark, sf)
    banks = bank.width_banks(rows.select(F.size("profile").alias("nbins")))
    return metric.boxcar_best(rows, ["vec_id"], banks).select("vec_id", rd("score"), F.col("width").cast("int").alias("width"))


@register("boxcar_gate", f"WITH {EMB},{q.score('prof', 64, BANK64, 'sc', 'vec_id', False)} SELECT vec_id, {r6('best')} AS score FROM sc")
def _(spark, sf):
    return metric.boxcar_scores(embedded(spark, sf), baseline=False).select("vec_id", rd("score"))


@register(
    "boxcar_metric",
    f"WITH {EMB},{q.score('prof', 64, BANK64, 'sc', 'vec_id, label')}, sg AS (SELECT label, 1.4826 * median(abs(v)) AS sg FROM prof GROUP BY label) SELECT vec_id, s.label, {r6('best / sg')} AS metric FROM sc s JOIN sg ON sg.label = s.label",
)
def _(spark, sf):
    return metric.snr_metrics(embedded(spark, sf), "label", "vec_id").select("vec_id", "label", rd("metric"))


@register("boxcar_best_width", f"WITH {EMB},{q.score('prof', 64, BANK64, 'sc', 'vec_id')} SELECT vec_id, width, {r6('width / 64.0')} AS ducy FROM sc")
def _(spark, sf):
    return metric.best_width(embedded(spark, sf)).select("vec_id", "width", rd("ducy"))


def metrics(spark, sf, params=PARAMS, threshold=None):
    return search.trial_metrics(event_spectrum(spark, sf), params, R_LO, R_HI, NH, threshold, page_bins=512)


FLAGSHIP = f"{q.all_metrics(PARAMS)} SELECT obs, t, block, {r6('r')} AS r, {r6('metric')} AS metric FROM met"


@register("harmonic_search_events", FLAGSHIP)
def harmonic_search_events(spark, sf):
    """Metric of every trial of every event type's spectrum."""
    return metrics(spark, sf).select("obs", "t", "block", rd("r"), rd("metric"))


@register("block_metrics", FLAGSHIP)
def _(spark, sf):
    """The same by the relational operators alone."""
    amps = interp.interp_direct(interp.harmonics(trials(spark, sf), 8), event_spectrum(spark, sf), ["obs", "t", "block", "h"], 16)
    profiles = fold.as_arrays(fold.coherent_profiles(amps, ["obs", "t", "block"], 8), ["obs", "t", "block"])
    profiles = profiles.withColumn("ob", F.struct("obs", "block"))
    out = metric.snr_metrics(profiles, "ob", "t", widths=PARAMS.widths(1), cap=8192)
    return out.join(grid(spark).select("t", "r"), "t").select("obs", "t", "block", rd("r"), rd("metric"))


# any list of frequencies: those of the vectors, ten blocks of them, in the spectrum of one event type each
LISTED = f"""WITH {q.SPEC}, tr AS (SELECT ([{', '.join(repr(k) for k in KINDS)}])[vec_id % 5 + 1] AS obs, vec_id AS t, vec_id % 10 AS block, 20 + (vec_id * 37 % 1800) / 10.0::DOUBLE + abs(embedding[1]::DOUBLE) AS r FROM embeddings),
th AS (SELECT obs, t, block, h.range AS h, r * h.range AS rh FROM tr, range(1, 9) h),
{q.amplitudes("th", 16, "obs, t, block, h")},{q.metric(1)}"""


@register("search_block", f"{LISTED} SELECT obs, block, {r6(f'r / {T} * 1e6')} AS freq_uhz, {r6('metric')} AS metric, {r6('r')} AS r FROM met1 WHERE metric > 2.5")
def _(spark, sf):
    """Search of an explicit list of frequencies."""
    at = embedded(spark, sf).select(kind_of("vec_id"), F.pmod("vec_id", F.lit(10)).alias("block"), F.col("vec_id").alias("j"), (20 + F.pmod(F.col("vec_id") * 37, F.lit(1800)) / F.lit(10.0) + F.abs(F.get("profile", F.lit(0)))).alias("r"))
    near = search.listed_metrics(at, event_spectrum(spark, sf), PARAMS, NH, 2.5, 512)
    return near.select("obs", "block", rd(F.col("r") / T * 1e6, "freq_uhz"), rd("metric"), rd("r"))


CANDS = f"cands AS (SELECT obs, k, r, nharm, metric FROM met WHERE metric > 2.5)"


@register("search_full", f"{q.all_metrics(PARAMS)},{CANDS} SELECT obs, {r6('r')} AS r, nharm, {r6('metric')} AS metric FROM cands")
def _(spark, sf):
    return search.search(event_spectrum(spark, sf), PARAMS, R_LO, R_HI, NH, T, 2.5, 512).select("obs", rd("r"), "nharm", rd("metric"))


@register("search_decimated", f"{q.all_metrics(LADDER)},{CANDS} SELECT obs, {r6('r')} AS r, nharm, {r6('metric')} AS metric FROM cands")
def _(spark, sf):
    return search.search(event_spectrum(spark, sf), LADDER, R_LO, R_HI, NH, T, 2.5, 512).select("obs", rd("r"), "nharm", rd("metric"))


@register("gate_report", f"{q.all_metrics(LADDER)} SELECT obs, block, k, count(*) AS n, count(*) FILTER (metric > 6) AS found FROM met GROUP BY obs, block, k")
def _(spark, sf):
    """Trials of each block and those above the threshold, found behind the gate of rough scores."""
    return search.gate_report(event_spectrum(spark, sf), LADDER, R_LO, R_HI, NH, 6.0, 512).select("obs", "block", "k", "n", "found")
