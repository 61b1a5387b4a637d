"""Exact phases, accumulators, the gate, byte budgets, lists of frequencies, and relations for sequential choices."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_signal import naive_width, synthetic
from tidefold.operators import bank, candidates, compare, fftgrid, interp, metric, phase, search, stats
from tidefold.params import SearchParams, boxcar_widths, decimation_set, ladder_boxcar_widths, trial_count


def test_tabulated_places_and_weights():
    for r_lo, step, nharms in ((1234.375, 0.5 / 60, 60), (10.1, 0.5 / 7, 7), (3.0, 0.25, 4)):
        p = phase.phase_of(r_lo, step, nharms, 16)
        t = np.array([0, 1, 2, 119, 120, 121, 999_999, 123_456_789])
        for h in (1, 2, 3, nharms):
            fl, dr, weights = p.places(h, t)
            exact = [(Fraction(r_lo) + int(x) * p.step) * h for x in t]
            assert fl.tolist() == [math.floor(e) for e in exact]
            assert np.allclose(dr, [float(e - math.floor(e)) for e in exact], atol=1e-12)
            assert np.allclose(weights, phase.weights_at(dr, 16), atol=1e-12)
    assert phase.phase_of(1.0, math.pi / 100, 8, 16) is None


def test_products_beyond_64_bits():
    p = phase.phase_of(0.5, 0.5 / 60, 60, 8)
    t = np.array([(1 << 60) + 7])
    fl, dr, _ = p.places(60, t)
    exact = (Fraction(1, 2) + int(t[0]) * p.step) * 60
    assert fl[0] == math.floor(exact) and dr[0] == pytest.approx(float(exact - math.floor(exact)))


def test_too_large_a_table_is_computed_instead(monkeypatch, spark):
    t = np.arange(0, 5000, 7)
    want = [phase.phase_of(7.3, 0.5 / 12, 12, 16).places(5, t)[i] for i in (0, 1)]
    monkeypatch.setattr(phase, "MAX_TABLE_BYTES", 0)
    phase._harmonic.cache_clear()
    fl, dr, weights = phase.phase_of(7.3, 0.5 / 12, 12, 16).places(5, t)
    assert weights is None and np.array_equal(fl, want[0]) and np.array_equal(dr, want[1])
    with pytest.raises(ValueError):
        phase.phase_table(spark, phase.phase_of(7.3, 0.5 / 12, 12, 16))
    phase._harmonic.cache_clear()


def test_metrics_do_not_depend_on_pages_or_partitions_and_equal_the_float_path(spark, monkeypatch):
    n = 1 << 13
    spec = synthetic(spark, n, base=50).cache()
    params = SearchParams(nharms=12, blocksize=256, decimations=(1, 2, 3))
    run = lambda page, df=spec: {(r.t, r.k): (r.metric, r.r) for r in search.trial_metrics(df, params, 30.1, 90.0, n // 2, page_bins=page).collect()}
    one = run(512)
    assert one == run(100) == run(4096, spec.repartition(5, "im"))  # to the bit
    monkeypatch.setattr(search, "phase_of", lambda *a: None)
    slow = run(512)
    assert slow.keys() == one.keys() and max(abs(slow[k][0] - one[k][0]) for k in one) < 1e-8
    spec.unpersist()


def test_pages_stay_within_the_budget_and_metrics_unchanged(spark):
    params = SearchParams(nharms=60, blocksize=2048)
    bands = search.harmonic_bands(params, 1 << 16, 64 << 20)
    assert len(bands) > 1 and bands[0][0] == 1 and bands[-1][1] == 60 and all(a[1] + 1 == b[0] for a, b in zip(bands, bands[1:]))
    for lo, hi in bands:
        pages = sum(int(params.blocksize * params.lodr * h + 32) // (1 << 16) + 2 for h in range(lo, hi + 1))
        assert pages * (1 << 16) * search.BIN_BYTES <= 64 << 20
    n = 1 << 13
    spec = synthetic(spark, n, base=50)
    params = SearchParams(nharms=12, blocksize=300, decimations=(1, 2))
    runs = []
    for budget in (1 << 30, 50_000, 1):
        assert (len(search.harmonic_bands(params, 256, budget)) > 1) == (budget < 1 << 30)
        runs.append({(r.t, r.k): r.metric for r in search.trial_metrics(spec, params, 30.0, 80.0, n // 2, page_bins=256, budget=budget).collect()})
    assert runs[0] == runs[1] == runs[2]


def test_pages_of_a_million_bins(spark):
    """60 harmonics up to bin 10**6 with large pages: several bands, the same metrics as with small pages."""
    rows = spark.range(1 << 20).select(F.lit("o").alias("obs"), F.col("id").alias("bin"), F.randn(1).alias("re"), F.randn(2).alias("im"))
    params = SearchParams(nharms=60, blocksize=256)
    args = (params, 17_000.0, 17_000.0 + 511 * params.lodr, 1 << 20)
    assert len(search.harmonic_bands(params, 1 << 16)) > 1 and len(search.harmonic_bands(params, 1 << 12)) == 1
    big = {r.t: r.metric for r in search.trial_metrics(rows, *args, page_bins=1 << 16).collect()}
    assert len(big) == 512 and big == {r.t: r.metric for r in search.trial_metrics(rows, *args, page_bins=1 << 12).collect()}


def test_the_gate_keeps_all_candidates_and_saves_scores(spark):
    n = 1 << 13
    spec = synthetic(spark, n, base=50, amp=20.0).cache()
    params = SearchParams(nharms=8, blocksize=512, decimations=(1, 2))
    args = (spec, params, 20.0, 120.0, n // 2)
    exact = sorted(map(tuple, search.trial_metrics(*args, threshold=6.0, gate=False).collect()))
    assert sorted(map(tuple, search.trial_metrics(*args, threshold=6.0).collect())) == exact and exact
    report = search.gate_report(*args, threshold=6.0).agg(F.sum("n"), F.sum("rescored"), F.sum("found")).first()
    assert report[2] == len(exact) and len(exact) <= report[1] < 0.5 * report[0]
    spec.unpersist()


def test_accumulators_give_the_statistics_of_the_trials(spark):
    n = 1 << 12
    spec = synthetic(spark, n, base=50).unionByName(synthetic(spark, n, base=70, obs="p")).cache()
    params = SearchParams(nharms=8, blocksize=300, decimations=(1, 2))
    args = (spec, params, 30.0, 120.0, n // 2)
    trials = stats.with_window(search.trial_metrics(*args), params, 100.0, 30.0, 120.0, 4).cache()
    acc = stats.with_window(search.block_accumulators(*args), params, 100.0, 30.0, 120.0, 4).cache()
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())
    keys = ["obs", "k", "win"]
    assert rows(stats.block_stats(acc, 100.0)) == rows(stats.block_metric_stats(trials, 100.0).select(*stats.block_stats(acc, 100.0).columns))
    assert rows(stats.merged_histogram(acc, keys)) == rows(stats.histogram(trials, keys))
    want = stats.summary(trials, keys)
    assert rows(stats.merged_summary(acc, keys).select(want.columns)) == rows(want)
    for least in (0, 200, 300, 10**6):
        assert rows(stats.norm_model(acc, least)) == rows(stats.metric_norm(trials, least))
    assert rows(stats.good_harmonics_of(acc, 8, n // 2)) == rows(stats.good_harmonics(trials, 8, n // 2))
    z = stats.normalized_metrics(trials, stats.metric_norm(trials)).where("z > 2")
    got = search.normalized_trials(*args, 100.0, stats.norm_model(acc), 2.0, 4)
    assert rows(got.select("obs", "k", "t", "metric", "z")) == rows(z.select("obs", "k", "t", "metric", "z"))
    for df in (spec, trials, acc):
        df.unpersist()


def test_a_list_of_frequencies(spark):
    n = 1 << 12
    spec = synthetic(spark, n, base=50)
    params = SearchParams(nharms=8, blocksize=300, decimations=(1, 2))
    every = search.trial_metrics(spec, params, 30.0, 30.0 + 299 * params.lodr, n // 2)
    want = {(r.k, r.t): r.metric for r in every.collect()}
    points = spark.range(300).select(F.lit("o").alias("obs"), F.lit(5).alias("block"), F.col("id").alias("j"), (30.0 + F.col("id") * params.lodr).alias("r")).repartition(4)
    got = {(r.k, r.j): r.metric for r in search.listed_metrics(points, spec, params, n // 2, page_bins=77).collect()}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-8
    odd = spark.createDataFrame([("o", 0, 1, 700.5), ("o", 0, 2, 31.0), ("o", 1, 3, None), ("q", 0, 4, 40.0)], "obs string, block int, j int, r double")
    out = search.listed_metrics(odd, spec, params, n // 2).collect()
    assert {(r.obs, r.block, r.k, r.j) for r in out} == {("o", 0, k, j) for k in (1, 2) for j in (1, 2)}
    assert search.search_block(odd, spec, params, n // 2, 100.0, threshold=1e9).collect() == []


def test_overlapping_pages_cover_the_whole_spectrum(spark):
    n = 500
    rnd = np.random.default_rng(3)
    rows = [(o, b, float(x), float(y)) for o in "ab" for b, (x, y) in enumerate(rnd.standard_normal((n, 2))) if b != 77]
    spec = spark.createDataFrame(rows, "obs string, bin long, re double, im double")
    point = {(r.obs, r.g): complex(r.re, r.im) for r in interp.fine_grid(spec, 0, n, 4, 16).collect()}
    for page in (8, 64, 100, 4096):
        got = {(r.obs, r.g): complex(r.re, r.im) for r in fftgrid.fine_grid_fft(spec, 0, n, 4, 16, page).collect()}
        assert got.keys() == point.keys() and len(got) == 2 * n * 4 and max(abs(got[k] - point[k]) for k in got) < 1e-9
    part = {(r.obs, r.g): complex(r.re, r.im) for r in fftgrid.fine_grid_fft(spec, 90, 33, 4, 16, 10).collect()}
    assert len(part) == 2 * 33 * 4 and all(abs(part[o, g] - point[o, g + 360]) < 1e-9 for o, g in part)
    with pytest.raises(ValueError):
        fftgrid.fine_grid_fft(spec, 0, n, 4, 64, 8)


def test_points_of_a_group_share_their_bins(spark):
    rows = [("a", b, 1.0, float(b)) for b in range(40)]
    spec = spark.createDataFrame(rows, "obs string, bin long, re double, im double")
    at = spark.createDataFrame([("a", 1, 0, 20.25), ("a", 1, 1, 20.75), ("a", 2, 0, 21.0)], "obs string, g int, s int, rh double")
    got = {(r.g, r.s): (r.re, r.im) for r in interp.finterp_multi(at, spec, ["g"], ["s"], 8).collect()}
    want = {(r.g, r.s): (r.re, r.im) for r in interp.interp_direct(at, spec, ["g", "s"], 8).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    apart = at.unionByName(spark.createDataFrame([("a", 2, 1, 22.5)], at.schema))
    with pytest.raises(Exception, match="between the same two bins"):
        interp.finterp_multi(apart, spec, ["g"], ["s"], 8).collect()


def test_banks_equal_the_planned_ones(spark):
    lengths = spark.createDataFrame([(n,) for n in (*range(1, 200), 64, 64)] + [(None,)], "nbins int")
    got = {}
    for r in bank.width_banks(lengths).collect():
        got.setdefault(r.nbins, []).append(r.w)
    assert {n: sorted(w) for n, w in got.items()} == {n: boxcar_widths(n) for n in range(1, 200)}
    for kmax in (1, 2, 6, 9):
        rungs = bank.decimation_rungs(spark.range(2, 100).select(F.col("id").alias("nharms")), kmax)
        found = {}
        for r in bank.ladder_banks(rungs).collect():
            found.setdefault((r.nharms, r.k), []).append(r.w)
        want = {}
        for h in range(2, 100):
            params = SearchParams(nharms=h, decimations=tuple(decimation_set(h, kmax)))
            want |= {(h, k): ladder_boxcar_widths(2 * (h // k), k, params) for k in params.decimations}
        assert {k: sorted(w) for k, w in found.items()} == want
    apart = spark.createDataFrame([(60, 1, 120), (60, 7, 16)], "nharms long, k long, nbins long")
    assert sorted(r.w for r in bank.ladder_banks(apart).where("k = 1").collect()) == boxcar_widths(120)


def test_boxes_by_joined_prefix_sums(spark):
    rnd = np.random.default_rng(5)
    p = [rnd.standard_normal(n).tolist() for n in (64, 17, 4, 1, 40, 40)] + [None, []]
    df = spark.createDataFrame(list(enumerate(p)), "id int, profile array<double>")
    banks = bank.width_banks(df.select(F.size("profile").alias("nbins")).where("nbins > 0"))
    got = {r.id: (r.score, r.width) for r in metric.boxcar_best(df, ["id"], banks).collect()}
    assert got.keys() == {i for i, x in enumerate(p) if x}
    for i, (score, width) in got.items():
        x = np.array([p[i]])
        want, w = metric.boxcar_scan(x, boxcar_widths(x.shape[1]))
        assert score == pytest.approx(want[0], abs=1e-9) and width == w[0] == naive_width(x[0], boxcar_widths(x.shape[1]))[1]


def random_candidates(spark, n, obs=1, span=None):
    return spark.range(n).select(
        (F.col("id") % obs).cast("string").alias("obs"),
        (F.col("id") * 0.001).alias("freq"),
        (5 + F.pmod(F.xxhash64("id"), F.lit(500)) / 10.0).alias("metric"),
        (F.lit(50.0) + F.pmod(F.xxhash64("id", F.lit(1)), F.lit(10**9)) / 1e9 * (span or 40.0 * n)).alias("r"),
        (4 + F.col("id") % 3).cast("int").alias("nharm"),
    )


def kept_by_loop(rows, numharm=16, tol=1.0):
    """One candidate after another, strongest first, against the kept ones."""
    kept, m = [], np.arange(1, numharm + 1)[:, None]
    for row in sorted(rows, key=lambda r: (-r.metric, r.r, r.nharm)):
        if kept:
            k = np.array([x.r for x in kept])[None, :]
            lo, hi = np.minimum(k, row.r), np.maximum(k, row.r)
            n = np.rint(m * hi / lo)
            if ((n >= 1) & (n <= numharm) & (np.abs(m * hi - n * lo) <= tol * m)).any():
                continue
        kept.append(row)
    return sorted(tuple(r) for r in kept)


@pytest.mark.parametrize("span", [300.0, 20_000.0])
def test_harmonics_by_rounds_equal_the_loop(spark, span):
    cands = spark.createDataFrame(random_candidates(spark, 400, 2, span).collect(), "obs string, freq double, metric double, r double, nharm int")
    rows = cands.collect()
    want = sorted(x for o in "01" for x in kept_by_loop([r for r in rows if r.obs == o]))
    for small in (0, 50, 10**9):
        assert sorted(map(tuple, candidates.remove_harmonics(cands, small=small).collect())) == want
    assert len(want) < len(rows)


def test_a_hundred_thousand_candidates_of_one_observation(spark):
    """Rounds leave no group of more than ``SMALL`` to a task; nothing kept is related, all that went are related to something stronger that stayed."""
    cands = random_candidates(spark, 100_000, span=4e6)
    rows = {(r.r, r.metric) for r in cands.collect()}
    kept = sorted((r.r, r.metric) for r in candidates.remove_harmonics(cands).collect())
    r, m = np.array(kept).T
    ratios = np.array(sorted({a / b for a in range(1, 17) for b in range(1, 17)}))

    def partners(x):
        for q in ratios:
            a, b = np.searchsorted(r, [x * q - 1.01, x * q + 1.01])
            for i in range(a, b):
                lo, hi = min(x, r[i]), max(x, r[i])
                if any(1 <= round(k * hi / lo) <= 16 and abs(k * hi - round(k * hi / lo) * lo) <= k for k in range(1, 17)):
                    yield i

    some = np.random.default_rng(1).permutation(sorted(rows - set(kept)))[:500]
    assert all(any((m[i], -r[i]) > (y, -x) for i in partners(x)) for x, y in some)
    for i in np.random.default_rng(2).permutation(len(r))[:500]:
        assert list(partners(r[i])) in ([i], [int(i)])


def test_matching_by_rounds_equals_the_loop(spark):
    rnd = np.random.default_rng(6)
    side = lambda n, s: [(str(i % 2), i, float(np.round(10 + rnd.random() * 3, 4)), None if i % 50 == 49 else float(rnd.integers(0, 40))) for i in range(s, s + n)]
    a, b = side(500, 0), side(450, 1000)
    da, db = (spark.createDataFrame(x, "obs string, id long, freq double, snr double") for x in (a, b))
    runs = [sorted(map(tuple, compare.crossmatch(da, db, 1000.0, 12.0, small=s).collect()), key=str) for s in (0, 60, 10**9)]
    assert runs[0] == runs[1] == runs[2]
    used, want = set(), set()
    pairs = sorted((x[3] is None, -(x[3] or 0), x[1], abs(x[2] - y[2]) * 1000.0, y[1]) for x in a for y in b if x[0] == y[0] and abs(x[2] - y[2]) * 1000.0 <= 12.0)
    for _, _, x, _, y in pairs:
        if x not in used and y not in used:
            used |= {x, y}
            want.add((x, y))
    assert {(r[1], r[2]) for r in runs[0] if r[1] is not None and r[2] is not None} == want
    assert {r[1] for r in runs[0]} - {None} == {x[1] for x in a} and {r[2] for r in runs[0]} - {None} == {y[1] for y in b}


def test_grids_of_rows(spark):
    rows = [("a", 1.0, 3.0, 0.25), ("b", 5.0, 5.0, 0.5), ("c", 5.0, 4.0, 0.5), ("d", 1.0, 2.0, 0.0), ("e", None, 2.0, 1.0)]
    out = interp.trial_grids(spark.createDataFrame(rows, "obs string, r_lo double, r_hi double, step double"), 4).collect()
    assert {o: sum(r.obs == o for r in out) for o in "abcde"} == {"a": trial_count(1.0, 3.0, 0.25), "b": 1, "c": 0, "d": 0, "e": 0}
    assert [(r.t, r.block, r.r) for r in sorted(out, key=lambda r: (r.obs, r.t))][:9] == [(t, t // 4, 1 + t / 4) for t in range(9)]


def test_harmonic_of_broadcasts_no_predictions(spark, tmp_path):
    """Bases whose table is small enough to be broadcast, but not with 63 ratios each; the rows are those of a plain scan."""
    rnd = random.Random(11)
    freq = lambda: rnd.choice([rnd.randrange(20, 90) / 4, rnd.uniform(5, 22)])
    a, b = [(rnd.randrange(3), i, freq()) for i in range(25)], [(rnd.randrange(3), i, freq()) for i in range(120)]
    a, b = a + a[:5] + [(None, 90, 5.0), (0, 91, None)], b + b[:9] + [(None, 90, 5.0), (1, 91, None)]
    for name, rows in (("a", a), ("b", b)):
        spark.createDataFrame(rows, "obs long, id long, freq double").write.parquet(str(tmp_path / name))
    got = compare.harmonic_of(*(spark.read.parquet(str(tmp_path / x)) for x in "ba"), 1000.0, 2.0)
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    ratios = [(n, m) for n in range(1, 9) for m in range(1, 9) if (n, m) != (1, 1)]
    hit = lambda o, f: f is not None and any(o == p and g is not None and abs(f - g * n / m) * 1000.0 <= 2.0 for p, _, g in a for n, m in ratios)
    want = [r for r in b if r[0] is not None and hit(r[0], r[2])]
    assert got.columns == ["obs", "id", "freq"] and sorted(map(tuple, got.collect())) == sorted(want) and 10 < len(want) < len(b)
