"""Registered queries: sifting, list comparison, text sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidefold.operators import compare, sift
from tidefold.plans.registry import register
from tidefold.plans.signal import bank_sql, rd, table
from tidefold.plans.sqlparts import r6
from tidefold.sources import text

TOL, CROSS = 1e-5, 1e-5
HARMS = (60, 30, 20, 15, 12, 10)

ROWS = f"""
rows AS (SELECT event_id AS id, event_type AS obs, 10 + 0.5::DOUBLE * (user_id % 8) AS dm, 5 + value / 50.3::DOUBLE AS snr,
  (1 + user_id % 40) * (1 + (event_id % 7) * 4e-6::DOUBLE) AS freq,
  1000 / ((1 + user_id % 40) * (1 + (event_id % 7) * 4e-6::DOUBLE)) AS period_ms,
  ([{", ".join(map(str, HARMS))}])[event_id % 6 + 1]::BIGINT AS numharm,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE (event_id % 9 + 1) / 63::DOUBLE END AS ducy FROM events)"""


def cand_rows(spark, sf):
    freq = (1 + F.pmod("user_id", F.lit(40))) * (1 + F.pmod("event_id", F.lit(7)) * F.lit(4e-6))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.col("event_type").alias("obs"),
        (10 + 0.5 * F.pmod("user_id", F.lit(8))).alias("dm"),
        (5 + F.col("value") / F.lit(50.3)).alias("snr"),
        freq.alias("freq"),
        (1000 / freq).alias("period_ms"),
        F.element_at(F.array(*[F.lit(h) for h in HARMS]), (F.pmod("event_id", F.lit(6)) + 1).cast("int")).cast("bigint").alias("numharm"),
        F.when(F.pmod("event_id", F.lit(5)) != 0, (F.pmod("event_id", F.lit(9)) + 1) / F.lit(63.0)).alias("ducy"),
    )


def cluster_sql(source: str, keys: str, tol: float, ties: str, out: str) -> str:
    """``out`` = ``source`` with ``isl`` and ``k``: the running-mean clusters, by recursion along each island."""
    part = f"PARTITION BY {keys} " if keys else ""
    kk = f"{keys}, " if keys else ""
    on = f"n.{keys} = c.{keys} AND " if keys else ""
    ck, nk = (f"c.{keys}, ", f"n.{keys}, ") if keys else ("", "")
    return f"""
g_{out} AS (SELECT *, CASE WHEN freq - lag(freq) OVER ({part}ORDER BY freq, {ties}) <= {tol}::DOUBLE * lag(freq) OVER ({part}ORDER BY freq, {ties}) THEN 0 ELSE 1 END AS brk FROM {source}),
i_{out} AS (SELECT *, sum(brk) OVER ({part}ORDER BY freq, {ties}) AS isl FROM g_{out}),
p_{out} AS (SELECT *, row_number() OVER (PARTITION BY {kk}isl ORDER BY freq, {ties}) AS pos FROM i_{out}),
r_{out} AS (SELECT {kk}isl, pos, 1::BIGINT AS n, freq AS total, 0 AS k FROM p_{out} WHERE pos = 1
  UNION ALL SELECT {nk}n.isl, n.pos, CASE WHEN abs(n.freq - total / c.n) > {tol}::DOUBLE * (total / c.n) THEN 1 ELSE c.n + 1 END,
    CASE WHEN abs(n.freq - total / c.n) > {tol}::DOUBLE * (total / c.n) THEN n.freq ELSE total + n.freq END,
    CASE WHEN abs(n.freq - total / c.n) > {tol}::DOUBLE * (total / c.n) THEN c.k + 1 ELSE c.k END
  FROM r_{out} c JOIN p_{out} n ON {on}n.isl = c.isl AND n.pos = c.pos + 1),
{out} AS (SELECT n.*, c.k FROM p_{out} n JOIN r_{out} c ON {on}n.isl = c.isl AND n.pos = c.pos)"""


GRID = """
grid AS (SELECT dm, row_number() OVER (ORDER BY dm) - 1 AS dm_idx FROM (SELECT DISTINCT dm FROM rows)),
step AS (SELECT coalesce(median(g), 1) AS step FROM (SELECT lead(dm) OVER (ORDER BY dm) - dm AS g FROM grid))"""
BASE = f"WITH RECURSIVE {ROWS},{GRID},{cluster_sql('rows', 'obs', TOL, 'dm, id', 'cl')}"


@register("dm_grid", f"WITH {ROWS},{GRID} SELECT dm, dm_idx, {r6('step')} AS step FROM grid, step")
def _(spark, sf):
    grid = sift.dm_grid(cand_rows(spark, sf))
    return grid.crossJoin(sift.dm_step(grid)).select("dm", F.col("dm_idx").cast("bigint").alias("dm_idx"), rd("step"))


@register("cluster_freq", f"{BASE} SELECT id, {r6('min(freq) OVER (PARTITION BY obs, isl, k)')} AS lowest, count(*) OVER (PARTITION BY obs, isl, k) AS members FROM cl")
def _(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("obs", "cluster")
    out = sift.cluster_freq(cand_rows(spark, sf), ["obs"], TOL, ["dm", "id"])
    return out.select("id", rd(F.min("freq").over(w), "lowest"), F.count(F.lit(1)).over(w).alias("members"))


DETS = f"""{BASE},
h0 AS (SELECT *, row_number() OVER (PARTITION BY obs, isl, k ORDER BY snr DESC, freq, dm, id) AS rk FROM cl),
hd AS (SELECT DISTINCT obs, isl, k, c.dm, dm_idx FROM cl c JOIN grid g ON g.dm = c.dm),
hg AS (SELECT *, dm_idx - lag(dm_idx) OVER (PARTITION BY obs, isl, k ORDER BY dm_idx) AS gap FROM hd),
ha AS (SELECT obs, isl, k, count(*) AS ndms, min(dm) AS dm_min, max(dm) AS dm_max, coalesce(bool_or(gap = 1), false) AS has_neighbour, coalesce(bool_or(gap > 1), false) AS has_gaps FROM hg GROUP BY obs, isl, k),
last AS (SELECT max(dm_idx) AS last_idx FROM grid),
det AS (SELECT h.obs, h.freq, h.period_ms, h.numharm, h.ducy, h.snr AS best_snr, h.dm AS best_dm, ndms, dm_min, dm_max,
  (g.dm_idx = 0 OR g.dm_idx = last_idx) AS peak_at_edge, ndms = last_idx + 1 AS full_span, has_neighbour, has_gaps
  FROM h0 h JOIN ha a ON a.obs = h.obs AND a.isl = h.isl AND a.k = h.k JOIN grid g ON g.dm = h.dm, last WHERE rk = 1)"""


def dets(spark, sf):
    rows = cand_rows(spark, sf)
    return sift.detections(rows, TOL, sift.dm_grid(rows))


@register("detections", f"{DETS} SELECT obs, {r6('freq')} AS freq, {r6('period_ms')} AS period_ms, numharm, {r6('ducy')} AS ducy, {r6('best_snr')} AS best_snr, best_dm, ndms FROM det")
def _(spark, sf):
    return dets(spark, sf).select("obs", rd("freq"), rd("period_ms"), "numharm", rd("ducy"), rd("best_snr"), "best_dm", "ndms")


@register("detection_flags", f"{DETS} SELECT obs, {r6('freq')} AS freq, dm_min, dm_max, peak_at_edge, full_span, has_neighbour, has_gaps FROM det")
def _(spark, sf):
    return dets(spark, sf).select("obs", rd("freq"), "dm_min", "dm_max", "peak_at_edge", "full_span", "has_neighbour", "has_gaps")


SIGS = f"""{DETS},{cluster_sql("det", "", CROSS, "obs, best_dm", "xc")},
xb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY isl, k, obs ORDER BY best_snr DESC, freq) AS rk FROM xc) WHERE rk = 1),
xg AS (SELECT isl, k, count(*) AS n_obs, sum(best_snr) AS sum_snr, max(best_snr) AS max_snr, arg_max(freq, best_snr) AS freq, arg_max(period_ms, best_snr) AS period_ms,
  (max(freq) - min(freq)) / avg(freq) AS freq_frac_spread, list_sort(list(best_dm))[count(*) // 2 + 1] AS dm_med, median(ndms) AS median_ndms, median(numharm) AS numharm_med,
  median(ducy) AS ducy_med, avg(peak_at_edge::INTEGER) AS frac_edge, avg((NOT has_neighbour)::INTEGER) AS frac_single,
  avg((full_span AND peak_at_edge AND period_ms < 100)::INTEGER) AS frac_broadband, bool_and(full_span) AS all_full_span FROM xb GROUP BY isl, k),
xm AS (SELECT b.isl, b.k, median(abs(best_dm - dm_med)) AS mad FROM xb b JOIN xg g ON g.isl = b.isl AND g.k = b.k GROUP BY b.isl, b.k),
sig AS (SELECT g.*, CASE WHEN step <> 0 THEN mad / step ELSE 0 END AS dm_mad_steps FROM xg g JOIN xm m ON m.isl = g.isl AND m.k = g.k, step)"""


def sigs(spark, sf):
    rows = cand_rows(spark, sf)
    grid = sift.dm_grid(rows)
    return sift.signals(sift.detections(rows, TOL, grid), CROSS, sift.dm_step(grid))


SIG_COLS = ("sum_snr", "max_snr", "freq", "period_ms", "dm_med", "median_ndms", "numharm_med", "ducy_med", "frac_edge", "frac_single", "frac_broadband", "dm_mad_steps")


@register("signals", f"{SIGS} SELECT n_obs, all_full_span, {r6('freq_frac_spread * 1e6')} AS spread_ppm, {', '.join(f'{r6(c)} AS {c}' for c in SIG_COLS)} FROM sig")
def _(spark, sf):
    return sigs(spark, sf).select("n_obs", "all_full_span", rd(F.col("freq_frac_spread") * 1e6, "spread_ppm"), *(rd(c) for c in SIG_COLS))


HTOL, TOPK = 1e-3, 500
#: The ratios that are compared, in the order of the search.
RATIOS = [*((n, 1) for n in range(2, 17)), (1, 2), (3, 2), (5, 2), (2, 3), (4, 3), (5, 3), (3, 4), (5, 4)]
_RATIOS = ", ".join(f"({i}, {n}, {d})" for i, (n, d) in enumerate(RATIOS))
MARKED = f"""{SIGS},
hr AS (SELECT *, row_number() OVER (ORDER BY sum_snr * n_obs DESC, freq) AS rk FROM sig),
ratio(i, nu, de) AS (VALUES {_RATIOS}),
rel AS (SELECT a.rk AS rk, b.rk AS fk, min(i) AS i FROM hr a JOIN hr b ON b.rk < a.rk JOIN ratio ON abs(a.freq - b.freq * (nu / de::DOUBLE)) < {HTOL}::DOUBLE * b.freq * (nu / de::DOUBLE) WHERE a.rk <= {TOPK} GROUP BY a.rk, b.rk),
rels AS (SELECT rk, list(fk ORDER BY fk) AS fks FROM rel GROUP BY rk),
walk(rk, funds, hit) AS (SELECT 0::BIGINT, []::BIGINT[], NULL::BIGINT UNION ALL
  SELECT h.rk, CASE WHEN list_min(list_intersect(coalesce(r.fks, []), w.funds)) IS NULL THEN list_append(w.funds, h.rk) ELSE w.funds END, list_min(list_intersect(coalesce(r.fks, []), w.funds))
  FROM walk w JOIN hr h ON h.rk = w.rk + 1 LEFT JOIN rels r ON r.rk = h.rk WHERE h.rk <= {TOPK}),
mk AS (SELECT h.*, f.freq AS harmonic_of, CASE WHEN t.nu IS NULL THEN NULL WHEN t.de = 1 THEN 'x' || t.nu ELSE t.nu || '/' || t.de END AS harm_str
  FROM hr h LEFT JOIN walk w ON w.rk = h.rk LEFT JOIN hr f ON f.rk = w.hit LEFT JOIN rel l ON l.rk = h.rk AND l.fk = w.hit LEFT JOIN ratio t ON t.i = l.i)"""


def marked(spark, sf):
    return sift.mark_harmonics(sigs(spark, sf), HTOL)


@register("signal_harmonics", f"{MARKED} SELECT {r6('freq')} AS freq, {r6('harmonic_of')} AS harmonic_of, harm_str FROM mk")
def _(spark, sf):
    return marked(spark, sf).select(rd("freq"), rd("harmonic_of"), "harm_str")


COH = "exp(-pow(freq_frac_spread / 1e-4::DOUBLE, 2))"
PARTS = {
    "persist": f"3.0::DOUBLE * n_obs * (0.2::DOUBLE + 0.8::DOUBLE * {COH})",
    "strength": f"3.0::DOUBLE * log2(greatest(sum_snr, 1)) * (0.3::DOUBLE + 0.7::DOUBLE * {COH})",
    "dm_extent": "2.0::DOUBLE * least(median_ndms, 6)",
    "dm_consist": "CASE WHEN n_obs >= 2 THEN 6.0::DOUBLE * exp(-pow(dm_mad_steps / 3, 2)) ELSE 0 END",
    "freq_consist": f"5.0::DOUBLE * {COH}",
    "edge": "-4.0::DOUBLE * frac_edge",
    "broadband": "-2.0::DOUBLE * frac_broadband",
    "single_dm": "-5.0::DOUBLE * frac_single",
}
SCORED = f"""{MARKED},
sc AS (SELECT *, {", ".join(f"{e} AS {n}" for n, e in PARTS.items())} FROM mk),
scored AS (SELECT *, {" + ".join(PARTS)} - CASE WHEN harmonic_of IS NOT NULL THEN 100 ELSE 0 END AS score,
  CASE WHEN harmonic_of IS NOT NULL THEN 'harmonic' WHEN frac_edge > 0.5 OR frac_broadband > 0.5 THEN 'RFI-like'
    WHEN n_obs >= 3 AND dm_mad_steps <= 3 AND frac_edge = 0 AND median_ndms >= 2 THEN 'PULSAR?'
    WHEN n_obs >= 2 AND frac_edge < 0.5 AND median_ndms >= 2 THEN 'candidate' ELSE 'weak' END AS klass,
  concat_ws(';', CASE WHEN n_obs = 1 THEN 'single-obs' END, CASE WHEN frac_edge > 0.5 THEN 'edge-peaked' END, CASE WHEN frac_broadband > 0 THEN 'broadband' END,
    CASE WHEN frac_single > 0.5 THEN 'no-DM-neighbour' END, CASE WHEN dm_mad_steps > 3 AND n_obs >= 2 THEN 'DM-inconsistent' END, CASE WHEN all_full_span THEN 'full-DM-span' END,
    CASE WHEN harmonic_of IS NOT NULL THEN printf('harm(%s of %.6fHz)', harm_str, harmonic_of) END) AS flags FROM sc)"""


def scored(spark, sf):
    return sift.score_signals(marked(spark, sf))


@register("signal_score", f"{SCORED} SELECT {r6('freq')} AS freq, {r6('score')} AS score, {', '.join(f'{r6(c)} AS {c}' for c in PARTS)} FROM scored")
def _(spark, sf):
    return scored(spark, sf).select(rd("freq"), rd("score"), *(rd(F.col("components")[c], c) for c in PARTS))


@register("signal_class", f"{SCORED} SELECT {r6('freq')} AS freq, klass, flags FROM scored")
def _(spark, sf):
    return scored(spark, sf).select(rd("freq"), "klass", F.concat_ws(";", "flags").alias("flags"))


@register(
    "sift_report",
    f"""{SCORED}, rp AS (SELECT *, row_number() OVER (ORDER BY score DESC, freq) AS rank FROM scored WHERE n_obs >= 2)
SELECT rank::INTEGER AS rank, printf('%-7d %-9s %14.9f %12.4f %5d %5d %7s %8.1f %8.1f %8.2f %9.2f %7.1e  %s', rank, klass, freq, period_ms, n_obs, round_even(numharm_med, 0)::INTEGER,
  CASE WHEN ducy_med IS NULL THEN '-' ELSE printf('%.2f', 100 * ducy_med) END, sum_snr, max_snr, dm_med, dm_mad_steps, freq_frac_spread, flags) AS line, flags FROM rp WHERE rank <= 60""",
)
def _(spark, sf):
    ranked = sift.report(scored(spark, sf), min_obs=2)
    lines = sift.report_lines(ranked).join(ranked.select("rank", F.concat_ws(";", "flags").alias("flags")), "rank")
    return lines.select("rank", "line", "flags")


# candidate lists of two event types as two programs' results
T_SPAN, TOL_BINS = 1000.0, 2.0
XA = "a AS (SELECT user_id % 50 AS obs, event_id AS id, 10 + (event_id * 37 % 9973) / 100.0::DOUBLE AS freq, value AS snr FROM events WHERE event_type = (SELECT min(event_type) FROM events))"
XB = "b AS (SELECT user_id % 50 AS obs, event_id AS id, 10 + (event_id * 53 % 9973) / 100.0::DOUBLE + 0.0007::DOUBLE AS freq, value AS snr FROM events WHERE event_type = (SELECT max(event_type) FROM events))"


def two_lists(spark, sf):
    ev = table(spark, sf, "events")
    ends = ev.agg(F.min("event_type").alias("lo"), F.max("event_type").alias("hi"))

    def one(end, factor, shift):
        rows = ev.join(F.broadcast(ends), F.col("event_type") == F.col(end))
        freq = 10 + F.pmod(F.col("event_id") * factor, F.lit(9973)) / 100.0 + F.lit(shift)
        return rows.select(F.pmod("user_id", F.lit(50)).alias("obs"), F.col("event_id").alias("id"), freq.alias("freq"), F.col("value").alias("snr"))

    return one("lo", 37, 0.0), one("hi", 53, 0.0007)


@register(
    "crossmatch",
    f"""WITH RECURSIVE {XA},{XB},
pr AS (SELECT a.obs, a.id AS ida, a.snr, b.id AS idb, abs(a.freq - b.freq) * {T_SPAN} AS d, row_number() OVER (PARTITION BY a.obs ORDER BY a.snr DESC, a.id, abs(a.freq - b.freq) * {T_SPAN}, b.id) AS rk
  FROM a JOIN b ON a.obs = b.obs AND abs(a.freq - b.freq) * {T_SPAN} <= {TOL_BINS}),
w(obs, rk, ua, ub, ida, idb, d) AS (SELECT DISTINCT obs, 0::BIGINT, []::BIGINT[], []::BIGINT[], NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE FROM pr UNION ALL
  SELECT p.obs, p.rk, CASE WHEN ok THEN list_append(w.ua, p.ida) ELSE w.ua END, CASE WHEN ok THEN list_append(w.ub, p.idb) ELSE w.ub END, CASE WHEN ok THEN p.ida END, CASE WHEN ok THEN p.idb END, CASE WHEN ok THEN p.d END
  FROM w JOIN pr p ON p.obs = w.obs AND p.rk = w.rk + 1, LATERAL (SELECT NOT list_contains(w.ua, p.ida) AND NOT list_contains(w.ub, p.idb) AS ok) o),
mt AS (SELECT obs, ida, idb, d FROM w WHERE ida IS NOT NULL)
SELECT obs, ida AS id_a, idb AS id_b, {r6("d")} AS dist_bins FROM mt
UNION ALL SELECT obs, id, NULL, NULL FROM a WHERE id NOT IN (SELECT ida FROM mt)
UNION ALL SELECT obs, NULL, id, NULL FROM b WHERE id NOT IN (SELECT idb FROM mt)""",
)
def _(spark, sf):
    return compare.crossmatch(*two_lists(spark, sf), T_SPAN, TOL_BINS).select("obs", "id_a", "id_b", rd("dist_bins"))


@register(
    "harmonic_of",
    f"""WITH {XA},{XB} SELECT DISTINCT b.obs, b.id, {r6("b.freq")} AS freq FROM b JOIN a ON a.obs = b.obs, range(1, 9) n, range(1, 9) m
WHERE (n.range <> 1 OR m.range <> 1) AND abs(b.freq - a.freq * n.range / m.range) * {T_SPAN} <= {TOL_BINS}""",
)
def _(spark, sf):
    a, b = two_lists(spark, sf)
    return compare.harmonic_of(b, a, T_SPAN, TOL_BINS).select("obs", "id", rd("freq")).distinct()


WORK = f"""WITH RECURSIVE se AS (SELECT user_id AS obs, 1.0::DOUBLE AS r_lo, count(*)::DOUBLE AS r_hi, 2 + user_id % 90 AS nharms, 0.5::DOUBLE AS hidr FROM events GROUP BY user_id),
rg AS (SELECT DISTINCT nharms, k.range AS k, 2 * (nharms // k.range) AS nbins FROM se, range(1, 7) k WHERE nharms // k.range >= 2), {bank_sql('rg')},
nw AS (SELECT nbins, count(*) AS nwidths FROM b GROUP BY nbins),
tr AS (SELECT obs, nharms, (floor((r_hi - r_lo) / (hidr / nharms)) + 1)::BIGINT AS profiles FROM se)
SELECT tr.obs, rg.k, rg.nbins, nwidths, profiles, profiles * rg.nbins AS bins, profiles * rg.nbins * nwidths AS bin_widths FROM tr JOIN rg ON rg.nharms = tr.nharms JOIN nw ON nw.nbins = rg.nbins WHERE profiles > 0"""


@register("work_accounting", WORK)
def _(spark, sf):
    """Profiles, bins and bins times widths of a search for every user, by fold."""
    per = table(spark, sf, "events").groupBy(F.col("user_id").alias("obs")).agg(F.count(F.lit(1)).cast("double").alias("r_hi"))
    searches = per.select("obs", F.lit(1.0).alias("r_lo"), "r_hi", (2 + F.pmod("obs", F.lit(90))).alias("nharms"), F.lit(0.5).alias("hidr"))
    return compare.work_of(searches, 6)


NAME = "event_type || CASE WHEN event_id % 11 = 0 THEN '_noDM' ELSE '_DM' END || (10 + 0.5::DOUBLE * (user_id % 8)) || '.cohout'"


@register("parse_candidate_name", f"WITH n AS (SELECT event_id, {NAME} AS name FROM events) SELECT event_id, regexp_extract(name, '{text.NAME_PATTERN}', 1) AS obs, regexp_extract(name, '{text.NAME_PATTERN}', 2)::DOUBLE AS dm FROM n WHERE regexp_matches(name, '{text.NAME_PATTERN}')")
def _(spark, sf):
    name = F.concat("event_type", F.when(F.pmod("event_id", F.lit(11)) == 0, "_noDM").otherwise("_DM"), (10 + 0.5 * F.pmod("user_id", F.lit(8))).cast("string"), F.lit(".cohout"))
    rows = table(spark, sf, "events").withColumn("name", name)
    ok, obs, dm = text.name_keys(F.col("name"))
    return rows.where(ok).select("event_id", obs.alias("obs"), dm.cast("double").alias("dm"))


LINE = "printf('%-4d  %8.2f  %18.12f  %18.12f   %3d   %6s', id, snr, freq, period_ms, numharm, CASE WHEN ducy IS NULL THEN '-' ELSE printf('%.2f', 100 * ducy) END)"


def lines(spark, sf):
    rows = cand_rows(spark, sf).withColumnsRenamed({"id": "rank", "snr": "metric", "numharm": "nharm"})
    return rows.select("rank", text.candidate_line(rows).alias("line"))


@register("candidate_text", f"WITH {ROWS} SELECT id AS rank, {LINE} AS line FROM rows")
def _(spark, sf):
    return lines(spark, sf)


@register(
    "parse_candidate_text",
    f"""WITH {ROWS}, l AS (SELECT {LINE} AS line FROM rows UNION ALL SELECT '# ' || {LINE} FROM rows WHERE id % 3 = 0 UNION ALL SELECT 'short ' || id FROM rows), s AS (SELECT regexp_split_to_array(trim(line), '\\s+') AS p FROM l)
SELECT p[1]::BIGINT AS rank, p[2]::DOUBLE AS snr, p[3]::DOUBLE AS freq, p[5]::BIGINT AS numharm, {r6("try_cast(p[6] AS DOUBLE) / 100")} AS ducy FROM s WHERE len(p) >= 5 AND p[1] <> '#' AND try_cast(p[2] AS DOUBLE) >= 6""",
)
def _(spark, sf):
    made = lines(spark, sf)
    noise = made.where(F.pmod("rank", F.lit(3)) == 0).select(F.concat(F.lit("# "), "line").alias("line"))
    short = made.select(F.concat(F.lit("short "), F.col("rank").cast("string")).alias("line"))
    every = made.select("line").unionByName(noise).unionByName(short)
    return text.parse_candidates(every, "line", 6.0).select("rank", "snr", "freq", "numharm", rd("ducy"))


@register(
    "stage_times",
    "WITH l AS (SELECT unnest(regexp_extract_all('x ''' || event_type || ''' runtime: ' || event_id || '.5 ms; ''scan'' runtime: 2.25 ms', '''(\\w+)'' runtime: ([\\d.]+) ms', 0)) AS m FROM events) SELECT regexp_extract(m, '''(\\w+)'' runtime', 1) AS stage, count(*) AS n, sum(regexp_extract(m, 'runtime: ([\\d.]+) ms', 1)::DOUBLE) AS ms FROM l GROUP BY 1",
)
def _(spark, sf):
    line = F.concat(F.lit("x '"), "event_type", F.lit("' runtime: "), F.col("event_id").cast("string"), F.lit(".5 ms; 'scan' runtime: 2.25 ms"))
    out = text.stage_times(table(spark, sf, "events").select(line.alias("value")))
    return out.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.sum("ms").alias("ms"))
