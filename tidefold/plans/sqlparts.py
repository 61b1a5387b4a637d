"""Common table expressions of the DuckDB oracles for the signal queries."""

from __future__ import annotations

from tidefold.params import SIGMA_SAMPLES, SearchParams, trial_count

START, DT, N = 1704067200, 600, 4320
NH = N // 2
T = float(N * DT)
R_LO, R_HI = 20.0, 200.0
PARAMS = SearchParams(nharms=8, m=16, decimations=(1,), blocksize=1024)
LADDER = SearchParams(nharms=8, m=16, decimations=(1, 2, 3), blocksize=1024)

EVENTS = f"""
ev AS (SELECT event_type AS obs, floor((epoch(ts) - {START}) / {DT})::BIGINT AS b, sum(value) AS v FROM events
  WHERE epoch(ts) >= {START} AND epoch(ts) < {START + N * DT} GROUP BY 1, 2)"""

SPEC0 = (
    EVENTS
    + f""",
raw AS (SELECT obs, k.range AS bin, sum(v * cos(2 * pi() * ((k.range * b) % {N}) / {N})) AS re, -sum(v * sin(2 * pi() * ((k.range * b) % {N}) / {N})) AS im
  FROM ev, range({NH}) k GROUP BY 1, 2),
nyq AS (SELECT obs, sum(CASE WHEN b % 2 = 0 THEN v ELSE -v END) AS x FROM ev GROUP BY obs),
spec0 AS (SELECT obs, bin, re, CASE WHEN bin = 0 THEN x ELSE im END AS im FROM raw JOIN nyq USING (obs))"""
)

SPEC = (
    SPEC0
    + """,
rms AS (SELECT obs, sqrt(avg(re * re + im * im)) AS s FROM spec0 WHERE bin > 0 GROUP BY obs),
spec AS (SELECT obs, bin, re / s AS re, im / s AS im FROM spec0 JOIN rms USING (obs))"""
)


def trials(r_lo: float = R_LO, r_hi: float = R_HI, params: SearchParams = PARAMS) -> str:
    return f"""
tr AS (SELECT range AS t, range // {params.blocksize} AS block, {r_lo}::DOUBLE + range * {params.lodr}::DOUBLE AS r FROM range({trial_count(r_lo, r_hi, params.lodr)}))"""


def amplitudes(points: str, m: int, keys: str, out: str = "amp") -> str:
    """CTEs from ``points(keys, rh)`` to ``out(keys, re, im)`` by the factored kernel; ``obs`` is one of the keys."""
    return f"""
p_{out} AS (SELECT {keys}, rh, floor(rh + 1e-15)::BIGINT AS fl, rh - floor(rh + 1e-15) AS dr FROM {points}),
j_{out} AS (SELECT {keys}, fl, dr, fl + o.range - {m // 2 - 1} AS bin FROM p_{out}, range({m}) o),
k_{out} AS (SELECT {', '.join('j.' + k.strip() for k in keys.split(','))}, dr,
    sum(CASE WHEN dr = 0 THEN CASE WHEN s.bin = fl THEN re ELSE 0 END ELSE re / (dr - (s.bin - fl)) END) AS sr,
    sum(CASE WHEN dr = 0 THEN CASE WHEN s.bin = fl THEN im ELSE 0 END ELSE im / (dr - (s.bin - fl)) END) AS si
  FROM (SELECT *, j.bin AS jbin FROM j_{out} j) j JOIN spec s ON s.obs = j.obs AND s.bin = jbin GROUP BY {', '.join('j.' + k.strip() for k in keys.split(','))}, dr),
{out} AS (SELECT {keys},
    CASE WHEN dr = 0 THEN sr ELSE sin(pi() * dr) / pi() * (cos(pi() * dr) * sr + sin(pi() * dr) * si) END AS re,
    CASE WHEN dr = 0 THEN si ELSE sin(pi() * dr) / pi() * (cos(pi() * dr) * si - sin(pi() * dr) * sr) END AS im FROM k_{out})"""


def trial_amps(params: SearchParams = PARAMS) -> str:
    return f"""
th AS (SELECT obs, t, block, h.range AS h, r * h.range AS rh FROM tr, range(1, {params.nharms + 1}) h, (SELECT DISTINCT obs FROM spec)),
{amplitudes("th", params.m, "obs, t, block, h")}"""


def profile(k: int, params: SearchParams = PARAMS, keys: str = "obs, t, block", source: str = "amp", out: str | None = None) -> str:
    """``prof{k}(keys, i, v)``: the fold of every k-th harmonic."""
    hk = params.nharms // k
    n = 2 * hk
    return f"""
{out or f"prof{k}"} AS (SELECT {keys}, i.range AS i, sum(CASE WHEN h // {k} < {hk}
      THEN 2 * (re * cos(2 * pi() * (((h // {k}) * i.range) % {n}) / {n}) - im * sin(2 * pi() * (((h // {k}) * i.range) % {n}) / {n}))
      ELSE re * cos(2 * pi() * (((h // {k}) * i.range) % {n}) / {n}) END) / {n} AS v
  FROM {source}, range({n}) i WHERE h % {k} = 0 AND h <= {k * hk} GROUP BY {keys}, i.range)"""


def sigma(prof: str, nbins: int, out: str, cap: int = SIGMA_SAMPLES, block: str = "obs, block", trial: str = "t") -> str:
    """``out(block, sg)`` from ``prof(block, trial, i, v)`` with the whole-profile sampling rule."""
    on = " AND ".join(f"p.{k.strip()} = s.{k.strip()}" for k in block.split(","))
    own = ", ".join(f"s.{k.strip()}" for k in block.split(","))
    return f"""
n_{out} AS (SELECT {block}, {trial} AS t, row_number() OVER (PARTITION BY {block} ORDER BY {trial}) - 1 AS j, count(*) OVER (PARTITION BY {block}) AS n
  FROM (SELECT DISTINCT {block}, {trial} FROM {prof})),
c_{out} AS (SELECT *, least(n, greatest(1, {cap} // {nbins})) AS nc FROM n_{out}),
s_{out} AS (SELECT {block}, t FROM c_{out} WHERE n * {nbins} <= {cap}
  OR (((j * nc + n - 1) // n) < nc AND (((j * nc + n - 1) // n) * n) // nc = j)),
{out} AS (SELECT {own}, 1.4826 * median(abs(p.v)) AS sg FROM s_{out} s JOIN {prof} p ON {on} AND p.{trial} = s.t GROUP BY {own})"""


def score(prof: str, nbins: int, widths: list[int], out: str, keys: str, baseline: bool = True) -> str:
    """``out(keys, best, width)``: best box sum over sqrt(width), narrowest on ties."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    base = f"(SELECT *, median(v) OVER (PARTITION BY {keys}) AS md FROM {prof})" if baseline else f"(SELECT *, 0 AS md FROM {prof})"
    picks = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""
b_{out} AS (SELECT {keys}, i, v - md AS x FROM {base}),
w_{out} AS (SELECT {keys}, i, x FROM b_{out} UNION ALL SELECT {keys}, i + {nbins}, x FROM b_{out} WHERE i < {max(widths)}),
q_{out} AS (SELECT {keys}, i, coalesce(sum(x) OVER (PARTITION BY {keys} ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c, x FROM w_{out}),
e_{out} AS (SELECT {keys}, i, c FROM q_{out} UNION ALL SELECT {keys}, {nbins + max(widths)}, c + x FROM q_{out} WHERE i = {nbins + max(widths) - 1}),
m_{out} AS (SELECT {picks}, w.w, max(b.c - a.c) / sqrt(w.w) AS s
  FROM e_{out} a JOIN (VALUES {", ".join(f"({w})" for w in widths)}) w(w) ON a.i < {nbins} JOIN e_{out} b ON {on} AND b.i = a.i + w.w GROUP BY {picks}, w.w),
{out} AS (SELECT {keys}, max(s) AS best, min(w) FILTER (s >= top - 1e-12) AS width FROM (SELECT *, max(s) OVER (PARTITION BY {keys}) AS top FROM m_{out}) GROUP BY {keys})"""


def metric(k: int, params: SearchParams = PARAMS) -> str:
    """``met{k}(obs, t, block, k, r, nharm, metric)``."""
    n = 2 * params.folded(k)
    return f"""{profile(k, params)},{sigma(f"prof{k}", n, f"sg{k}")},{score(f"prof{k}", n, params.widths(k), f"sc{k}", "obs, t, block")},
met{k} AS (SELECT s.obs, s.t, s.block, {k} AS k, {k} * tr.r AS r, {params.folded(k)} AS nharm, CASE WHEN sg > 0 THEN best / sg ELSE 0 END AS metric
  FROM sc{k} s JOIN sg{k} g ON g.obs = s.obs AND g.block = s.block JOIN tr ON tr.t = s.t WHERE {k} * tr.r < {NH})"""


def all_metrics(params: SearchParams) -> str:
    """All CTEs up to ``met(obs, t, block, k, r, nharm, metric)``."""
    parts = ",".join(metric(k, params) for k in params.decimations)
    union = " UNION ALL ".join(f"SELECT * FROM met{k}" for k in params.decimations)
    return f"WITH {SPEC},{trials(params=params)},{trial_amps(params)},{parts},\nmet AS ({union})"


def r6(x: str) -> str:
    """Six decimals, without negative zero."""
    return f"(round({x}, 6) + 0.0)"
