"""The search: blocks of trials meet their spectrum pages and are folded and scored in one vectorised step."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefold.operators import stats
from tidefold.operators.metric import block_sigma_of, boxcar_scan
from tidefold.operators.phase import Phase, phase_of, weights_at
from tidefold.operators.spectrum import PAGE_BINS, paged
from tidefold.params import SearchParams, trial_count

#: Bytes of spectrum pages that one task holds for a block of trials.
PAGE_BUDGET = 64 << 20
#: Bytes of a bin in a page: its number and both parts of its amplitude.
BIN_BYTES = 24

Places = Callable[[int], tuple[np.ndarray, np.ndarray, "np.ndarray | None"]]


class Pages:
    """The spectrum pages of one group; bins that no page has are zero."""

    def __init__(self, group: pa.Table, page_bins: int):
        self.page_bins = page_bins
        lists = {c: group.column(c).combine_chunks() for c in ("bins", "re", "im")}
        ends = np.cumsum(np.asarray(pc.list_value_length(lists["bins"])))
        bins, re, im = (np.asarray(lists[c].flatten()) for c in lists)
        ids = group.column("page").to_numpy()
        self.ids = np.unique(ids)
        self.values = np.zeros((len(self.ids) + 1, page_bins), np.complex128)  # the last row is blank
        for page, lo, hi in zip(ids.tolist(), [0, *ends[:-1].tolist()], ends.tolist()):
            self.values[np.searchsorted(self.ids, page), bins[lo:hi] - page * page_bins] = re[lo:hi] + 1j * im[lo:hi]

    def window(self, lo: int, hi: int) -> np.ndarray:
        p0, p1 = lo // self.page_bins, hi // self.page_bins
        return self.values[self._rows(np.arange(p0, p1 + 1))].ravel()[lo - p0 * self.page_bins : hi - p0 * self.page_bins + 1]

    def around(self, fl: np.ndarray, m: int) -> np.ndarray:
        """(points, m) bins around points with the lower bins ``fl``, wherever they lie."""
        at = fl[:, None] + np.arange(-m // 2 + 1, m // 2 + 1)
        return self.values[self._rows(at // self.page_bins), at % self.page_bins]

    def _rows(self, page: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.ids, page), max(len(self.ids) - 1, 0))
        return np.where((self.ids[at] == page) if len(self.ids) else False, at, len(self.ids))


def float_places(r: np.ndarray) -> Places:
    """Places of the harmonics of arbitrary frequencies."""

    def places(h: int) -> tuple[np.ndarray, np.ndarray, None]:
        rh = r * h
        fl = np.floor(rh + 1e-15).astype(np.int64)
        return fl, rh - fl, None

    return places


def harmonic_amplitudes(places: Places, harmonics: range, n: int, m: int, n_half: int, around: Callable[[np.ndarray, int], np.ndarray]) -> np.ndarray:
    """Complex (trials, harmonics) amplitudes; a harmonic that any trial of the block can't have is zero for all of them."""
    out = np.zeros((n, len(harmonics)), np.complex128)
    for c, h in enumerate(harmonics):
        fl, dr, weights = places(h)
        lo, hi = int(fl.min()), int(fl.max())
        if lo + 2 - m // 2 >= 1 and hi < n_half and hi + m // 2 < n_half:
            out[:, c] = np.einsum("ij,ij->i", around(fl, m), weights_at(dr, m) if weights is None else weights)
    return out


def block_amplitudes(r: np.ndarray, nharms: int, m: int, n_half: int, window) -> np.ndarray:
    """Complex (trials, nharms + 1) amplitudes of ascending frequencies; column 0 (DC) is zero.  ``window(lo, hi)`` returns the complex bins lo .. hi."""
    amps = harmonic_amplitudes(float_places(r), range(1, nharms + 1), len(r), m, n_half, contiguous(window))
    return np.concatenate([np.zeros((len(r), 1)), amps], axis=1)


def contiguous(window) -> Callable[[np.ndarray, int], np.ndarray]:
    """``around`` for points close together: one slice of the spectrum holds them all."""

    def around(fl: np.ndarray, m: int) -> np.ndarray:
        first = int(fl.min()) - m // 2 + 1
        return window(first, int(fl.max()) + m // 2)[(fl - fl.min())[:, None] + np.arange(m)]

    return around


def fold(amps: np.ndarray, k: int) -> np.ndarray:
    """Profiles of decimation ``k``: every k-th harmonic, imaginary part of the top one ignored."""
    nharms = amps.shape[1] - 1
    part = amps[:, 0 : k * (nharms // k) + 1 : k].copy()
    part[:, -1] = part[:, -1].real
    return np.fft.irfft(part, 2 * (nharms // k), axis=1)


def gated_scores(profiles: np.ndarray, widths: list[int], bar: float) -> tuple[np.ndarray, int]:
    """Scores, exact for every profile whose score about a zero baseline reaches ``bar``; and how many those are.

    Without a baseline no median is needed.  The others keep the rough score.
    """
    score, _ = boxcar_scan(profiles, widths, baseline=False)
    near = np.flatnonzero(score >= bar)
    if len(near):
        score[near] = boxcar_scan(profiles[near], widths)[0]
    return score, len(near)


def fold_metrics(amps: np.ndarray, r: np.ndarray, params: SearchParams, n_half: int, threshold: float | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """``(k, trial places, metrics, exactly scored)`` of one block for each decimation; trials of a fold past Nyquist are left out.

    With a ``threshold`` only profiles within ``boxcar_medmargin`` of it by the
    rough score are scored exactly; metrics below it may then be rough.
    """
    for k in params.decimations:
        at = np.arange(len(r)) if k == 1 else np.flatnonzero(k * r < n_half)
        if not len(at):
            continue
        profiles = fold(amps[at], k)
        sigma = block_sigma_of(profiles)
        if not sigma > 0:
            yield k, at, np.zeros(len(at)), 0
        elif threshold is None:
            yield k, at, boxcar_scan(profiles, params.widths(k))[0] / sigma, len(at)
        else:
            score, exact = gated_scores(profiles, params.widths(k), (threshold - params.boxcar_medmargin) * sigma)
            yield k, at, score / sigma, exact


def harmonic_bands(params: SearchParams, page_bins: int, budget: int = PAGE_BUDGET) -> list[tuple[int, int]]:
    """Ranges ``(first, last)`` of harmonics whose pages for one block of trials stay within ``budget`` bytes.

    Harmonic h of a block spans ``blocksize * lodr * h`` bins and the kernel on
    either side, hence a page more than these fill at most.
    """
    bands: list[tuple[int, int]] = []
    first, held = 1, 0
    for h in range(1, params.nharms + 1):
        pages = int(params.blocksize * params.lodr * h + 2 * params.m) // page_bins + 2
        size = pages * page_bins * BIN_BYTES
        if held and held + size > budget:
            bands.append((first, h - 1))
            first, held = h, 0
        held += size
    return [*bands, (first, params.nharms)]


class _Grid:
    """The trials of a search: a progression with an exact phase where its step is rational."""

    def __init__(self, params: SearchParams, r_lo: float, r_hi: float, n_half: int):
        self.params, self.r_lo, self.n_half = params, float(r_lo), n_half
        self.total = trial_count(r_lo, r_hi, params.lodr)
        self.phase: Phase | None = phase_of(r_lo, params.lodr, params.nharms, params.m)

    def trials(self, block: int) -> tuple[np.ndarray, np.ndarray]:
        t = np.arange(block * self.params.blocksize, min((block + 1) * self.params.blocksize, self.total))
        return t, self.r_lo + t * self.params.lodr if self.phase is None else self.phase.frequencies(t)

    def places(self, t: np.ndarray, r: np.ndarray) -> Places:
        return float_places(r) if self.phase is None else lambda h: self.phase.places(h, t)

    def amplitudes(self, block: int, pages: Pages, harmonics: range) -> np.ndarray:
        t, r = self.trials(block)
        return harmonic_amplitudes(self.places(t, r), harmonics, len(t), self.params.m, self.n_half, contiguous(pages.window))

    def needs(self, page_bins: int, bands: list[tuple[int, int]], spark) -> DataFrame:
        """``(block, band, page)``: the pages that the harmonics of each block touch."""
        size, m = self.params.blocksize, self.params.m
        first = F.lit(self.r_lo) + F.col("block") * size * F.lit(self.params.lodr)
        last = F.lit(self.r_lo) + (F.least((F.col("block") + 1) * size, F.lit(self.total)) - 1) * F.lit(self.params.lodr)
        band = reduce(lambda c, b: c.when(F.col("h") <= b[1][1], F.lit(b[0])), enumerate(bands[1:], 1), F.when(F.col("h") <= bands[0][1], F.lit(0)))
        return (
            spark.range(-(-self.total // size))
            .select(F.col("id").alias("block"))
            .withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(self.params.nharms))))
            .withColumn("lo", F.greatest(F.floor(F.floor(first * F.col("h") - m) / page_bins), F.lit(0)))
            .withColumn("hi", F.least(F.floor(F.ceil(last * F.col("h") + m) / page_bins), F.lit((self.n_half - 1) // page_bins)))
            .where("lo <= hi")
            .select("block", band.alias("band"), F.explode(F.sequence("lo", "hi")).alias("page"))
            .distinct()
        )


Emit = Callable[[str, int, np.ndarray, np.ndarray, np.ndarray, pa.Table], pa.Table]


def _blocks(spec: DataFrame, grid: _Grid, page_bins: int, pages: DataFrame | None, emit: Emit, schema: str, extra: DataFrame | None = None, budget: int = PAGE_BUDGET) -> DataFrame:
    """``emit(obs, block, t, r, amplitudes, group)`` of every (observation, block); ``extra`` has columns by (obs, block) for it.

    Each block is joined with just the pages that its harmonics touch.  Where
    these would exceed ``budget``, bands of harmonics are gathered by tasks of
    their own and a block's amplitudes (trials times harmonics) meet afterwards.
    """
    pages = paged(spec, page_bins) if pages is None else pages
    nharms = grid.params.nharms
    bands = harmonic_bands(grid.params, page_bins, budget)
    met = pages.join(grid.needs(page_bins, bands, spec.sparkSession), "page").select("obs", "block", "band", "page", "bins", "re", "im")
    more = [] if extra is None else [c for c in extra.columns if c not in ("obs", "block")]

    def whole(group: pa.Table) -> pa.Table:
        obs, block = group.column("obs")[0].as_py(), group.column("block")[0].as_py()
        t, r = grid.trials(block)
        amps = grid.amplitudes(block, Pages(group, page_bins), range(1, nharms + 1))
        return emit(obs, block, t, r, np.concatenate([np.zeros((len(t), 1)), amps], axis=1), group)

    def part(group: pa.Table) -> pa.Table:
        obs, block, band = (group.column(c)[0].as_py() for c in ("obs", "block", "band"))
        amps = grid.amplitudes(block, Pages(group, page_bins), range(bands[band][0], bands[band][1] + 1)).ravel()
        lists = [pa.ListArray.from_arrays(pa.array([0, len(amps)], pa.int32()), pa.array(x)) for x in (amps.real.copy(), amps.imag.copy())]
        return pa.Table.from_arrays([pa.array([obs], pa.string()), pa.array([block], pa.int64()), pa.array([band], pa.int32()), *lists], ["obs", "block", "band", "re", "im"])

    def together(group: pa.Table) -> pa.Table:
        obs, block = group.column("obs")[0].as_py(), group.column("block")[0].as_py()
        t, r = grid.trials(block)
        amps = np.zeros((len(t), nharms + 1), np.complex128)
        for i, band in enumerate(group.column("band").to_pylist()):
            re, im = (group.column(c).chunk(0) if group.column(c).num_chunks == 1 else group.column(c).combine_chunks() for c in ("re", "im"))
            amps[:, bands[band][0] : bands[band][1] + 1] = (re[i].values.to_numpy() + 1j * im[i].values.to_numpy()).reshape(len(t), -1)
        return emit(obs, block, t, r, amps, group)

    if len(bands) > 1:
        met = met.groupBy("obs", "block", "band").applyInArrow(part, "obs string, block bigint, band int, re array<double>, im array<double>")
    if more:
        met = met.join(extra, ["obs", "block"], "left")
    return met.groupBy("obs", "block").applyInArrow(whole if len(bands) == 1 else together, schema)


_OUT = "obs string, block bigint, k int, t bigint, r double, nharm int, metric double"


def _table(schema: str, obs: str, block: int, columns: list) -> pa.Table:
    n = len(columns[0])
    return pa.Table.from_arrays([pa.array([obs] * n, pa.string()), pa.array([block] * n, pa.int64()), *(pa.array(c) for c in columns)], [x.split()[0] for x in schema.split(", ")])


def _joined(parts: list[tuple], kinds: list) -> list[np.ndarray]:
    return [np.concatenate(c) if parts else np.zeros(0, k) for c, k in zip(zip(*parts) if parts else [()] * len(kinds), kinds)]


def trial_metrics(
    spec: DataFrame,
    params: SearchParams,
    r_lo: float,
    r_hi: float,
    n_half: int,
    threshold: float | None = None,
    page_bins: int = PAGE_BINS,
    pages: DataFrame | None = None,
    gate: bool = True,
    budget: int = PAGE_BUDGET,
) -> DataFrame:
    """``(obs, block, k, t, r, nharm, metric)`` of all trials (only those above ``threshold`` if given).

    ``block`` is a function of the trial number alone and phases are exact, so
    results do not depend on partitions.  With a threshold, ``gate`` saves the
    exact score of profiles far below it (see ``fold_metrics``).
    """
    grid = _Grid(params, r_lo, r_hi, n_half)

    def emit(obs, block, t, r, amps, _):
        parts = []
        for k, at, metric, _ in fold_metrics(amps, r, params, n_half, threshold if gate else None):
            keep = np.flatnonzero(metric > threshold) if threshold is not None else np.arange(len(at))
            parts.append((np.full(len(keep), k, np.int32), t[at[keep]], k * r[at[keep]], np.full(len(keep), params.folded(k), np.int32), metric[keep]))
        return _table(_OUT, obs, block, _joined(parts, [np.int32, np.int64, np.float64, np.int32, np.float64]))

    return _blocks(spec, grid, page_bins, pages, emit, _OUT, budget=budget)


_GATE = "obs string, block bigint, k int, n bigint, rescored bigint, found bigint"


def gate_report(spec: DataFrame, params: SearchParams, r_lo: float, r_hi: float, n_half: int, threshold: float | None = None, page_bins: int = PAGE_BINS) -> DataFrame:
    """``(obs, block, k, n, rescored, found)``: trials, those scored exactly behind the gate, and those above the threshold."""
    limit = params.threshold if threshold is None else threshold

    def emit(obs, block, t, r, amps, _):
        rows = [(np.array([k], np.int32), *(np.array([x], np.int64) for x in (len(at), exact, (metric > limit).sum()))) for k, at, metric, exact in fold_metrics(amps, r, params, n_half, limit)]
        return _table(_GATE, obs, block, _joined(rows, [np.int32, np.int64, np.int64, np.int64]))

    return _blocks(spec, _Grid(params, r_lo, r_hi, n_half), page_bins, None, emit, _GATE)


def block_accumulators(
    spec: DataFrame,
    params: SearchParams,
    r_lo: float,
    r_hi: float,
    n_half: int,
    page_bins: int = PAGE_BINS,
    pages: DataFrame | None = None,
    lo: float = stats.HIST_LO,
    hi: float = stats.HIST_HI,
    nb: int = stats.HIST_BINS,
) -> DataFrame:
    """One row per (observation, block, decimation): counts, moments, median and histogram of the metric (``stats.ACCUMULATOR``).

    Trials are scored once and leave the task as these sums, which merge by
    addition; every statistic of any set of blocks follows from them.
    """

    def emit(obs, block, t, r, amps, _):
        rows = []
        for k, at, metric, _ in fold_metrics(amps, r, params, n_half):
            rows.append((k, k * r[at].min(), k * r[at].max(), *stats.accumulated(metric, lo, hi, nb)))
        names = [x.split()[0] for x in stats.ACCUMULATOR.split(", ")]
        made = [{"obs": obs, "block": block} | dict(zip(names[2:], row)) for row in rows]
        return pa.Table.from_pylist(made, pa.schema(list(zip(names, stats.ACCUMULATOR_TYPES))))

    return _blocks(spec, _Grid(params, r_lo, r_hi, n_half), page_bins, pages, emit, stats.ACCUMULATOR)


_NORMALIZED = "obs string, block bigint, k int, t bigint, r double, nharm int, metric double, z double"


def normalized_trials(
    spec: DataFrame, params: SearchParams, r_lo: float, r_hi: float, n_half: int, t_span: float, norm: DataFrame, limit: float, windows: int = 16, page_bins: int = PAGE_BINS, pages: DataFrame | None = None
) -> DataFrame:
    """Trials whose metric in units of ``norm(obs, k, win, loc, scale)`` is above ``limit``, with ``z``.

    A block has one window per decimation, so its models go along with it and
    only the trials above the limit leave the task.  A trial without a model
    keeps its metric.
    """
    grid = _Grid(params, r_lo, r_hi, n_half)
    blocks = spec.sparkSession.range(-(-grid.total // params.blocksize)).select(F.col("id").alias("block"), F.explode(F.array(*[F.lit(k) for k in params.decimations])).alias("k"))
    models = stats.with_window(blocks, params, t_span, r_lo, r_hi, windows).join(norm, ["k", "win"])
    held = models.groupBy("obs", "block").agg(F.map_from_entries(F.collect_list(F.struct("k", F.array("loc", "scale")))).alias("model"))  # one entry a decimation

    def emit(obs, block, t, r, amps, group):
        model = dict(group.column("model")[0].as_py() or [])
        parts = []
        for k, at, metric, _ in fold_metrics(amps, r, params, n_half):
            loc, scale = model.get(k, (0.0, 1.0))
            z = (metric - loc) / scale
            keep = np.flatnonzero(z > limit)
            parts.append((np.full(len(keep), k, np.int32), t[at[keep]], k * r[at[keep]], np.full(len(keep), params.folded(k), np.int32), metric[keep], z[keep]))
        return _table(_NORMALIZED, obs, block, _joined(parts, [np.int32, np.int64, np.float64, np.int32, np.float64, np.float64]))

    return _blocks(spec, grid, page_bins, pages, emit, _NORMALIZED, held)


def search_normalized(
    spec: DataFrame,
    params: SearchParams,
    r_lo: float,
    r_hi: float,
    n_half: int,
    t_span: float,
    threshold: float | None = None,
    windows: int = 16,
    page_bins: int = PAGE_BINS,
    min_trials: int = stats.MIN_WINDOW_TRIALS,
    pages: DataFrame | None = None,
) -> DataFrame:
    """Two passes: the metric's location and spread per observation, fold and frequency window, then candidates by the normalised metric.

    The first pass leaves accumulators only, the second the candidates only.
    """
    acc = stats.with_window(block_accumulators(spec, params, r_lo, r_hi, n_half, page_bins, pages), params, t_span, r_lo, r_hi, windows)
    limit = params.threshold if threshold is None else threshold
    found = normalized_trials(spec, params, r_lo, r_hi, n_half, t_span, stats.norm_model(acc, min_trials), limit, windows, page_bins, pages)
    return found.select("obs", (F.col("r") / F.lit(t_span)).alias("freq"), F.col("z").alias("metric"), "r", "nharm")


def search(spec: DataFrame, params: SearchParams, r_lo: float, r_hi: float, n_half: int, t_span: float, threshold: float | None = None, page_bins: int = PAGE_BINS) -> DataFrame:
    """Candidates ``(obs, freq, metric, r, nharm)`` of all decimations above the threshold, before any collapse."""
    limit = params.threshold if threshold is None else threshold
    return trial_metrics(spec, params, r_lo, r_hi, n_half, limit, page_bins).select("obs", (F.col("r") / F.lit(t_span)).alias("freq"), "metric", "r", "nharm")


_LISTED = "obs string, block bigint, k int, j bigint, r double, nharm int, metric double"


def listed_metrics(points: DataFrame, spec: DataFrame, params: SearchParams, n_half: int, threshold: float | None = None, page_bins: int = PAGE_BINS, pages: DataFrame | None = None) -> DataFrame:
    """``(obs, block, k, j, r, nharm, metric)`` of the frequencies ``points(obs, block, j, r)``, any list of them.

    A block shares one noise estimate and guard; ``j`` orders its rows.  The
    pages are planned from the rows: each asks for those around its harmonics.
    Nulls in ``r``, and blocks whose observation has no spectrum, give no rows.
    """
    pages = paged(spec, page_bins) if pages is None else pages
    points = points.where(F.col("r").isNotNull()).select("obs", F.col("block").cast("bigint").alias("block"), F.col("j").cast("bigint").alias("j"), F.col("r").cast("double").alias("r"))
    at: Callable[[int], Column] = lambda d: F.floor((F.floor(F.col("r") * F.col("h")) + d) / page_bins)
    asked = points.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(params.nharms))))
    asked = asked.select(F.col("obs").alias("obs"), F.col("block").alias("block"), F.explode(F.sequence(at(-params.m), at(params.m))).alias("page")).distinct()
    met = pages.join(asked, ["obs", "page"]).select("obs", "block", "page", "bins", "re", "im")

    def run(key, rows: pa.Table, group: pa.Table) -> pa.Table:
        obs, block = key[0].as_py(), key[1].as_py()
        if not rows.num_rows or not group.num_rows:
            return _table(_LISTED, obs, block, _joined([], [np.int32, np.int64, np.float64, np.int32, np.float64]))
        order = np.lexsort((rows.column("r").to_numpy(), rows.column("j").to_numpy()))
        j, r = rows.column("j").to_numpy()[order], rows.column("r").to_numpy()[order]
        amps = harmonic_amplitudes(float_places(r), range(1, params.nharms + 1), len(r), params.m, n_half, Pages(group, page_bins).around)
        parts = []
        for k, places, metric, _ in fold_metrics(np.concatenate([np.zeros((len(r), 1)), amps], axis=1), r, params, n_half, threshold):
            keep = np.flatnonzero(metric > threshold) if threshold is not None else np.arange(len(places))
            parts.append((np.full(len(keep), k, np.int32), j[places[keep]], k * r[places[keep]], np.full(len(keep), params.folded(k), np.int32), metric[keep]))
        return _table(_LISTED, obs, block, _joined(parts, [np.int32, np.int64, np.float64, np.int32, np.float64]))

    return points.groupBy("obs", "block").cogroup(met.groupBy("obs", "block")).applyInArrow(run, _LISTED)


def search_block(points: DataFrame, spec: DataFrame, params: SearchParams, n_half: int, t_span: float, threshold: float | None = None, page_bins: int = PAGE_BINS) -> DataFrame:
    """Candidates ``(obs, freq, metric, r, nharm)`` among a list of frequencies ``points(obs, block, j, r)``."""
    limit = params.threshold if threshold is None else threshold
    return listed_metrics(points, spec, params, n_half, limit, page_bins).select("obs", (F.col("r") / F.lit(t_span)).alias("freq"), "metric", "r", "nharm")
