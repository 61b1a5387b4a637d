import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold.operators import candidates, fold, interp, metric, search, sift, spectrum, stats
from tidefold.params import SearchParams, boxcar_widths, decimation_set, is_smooth, ladder_boxcar_widths, log_edges, next_pow_of_2, next_smooth, trial_grid_rational


def test_plans():
    assert boxcar_widths(64) == [1, 2, 3, 4, 6, 9, 13, 19] and boxcar_widths(4) == [1]
    ladder = SearchParams(nharms=60, decimations=tuple(decimation_set(60, 6)))
    assert ladder_boxcar_widths(120, 1, ladder) == [1, 2, 3, 4, 6]
    assert ladder_boxcar_widths(20, 6, ladder) == [2, 3, 4, 6]
    sparse = SearchParams(nharms=60, decimations=(1, 7))
    assert ladder_boxcar_widths(120, 1, sparse) == boxcar_widths(120)
    assert ladder_boxcar_widths(4, 3, ladder) == [1]
    assert [decimation_set(4, 6), decimation_set(60, 0)] == [[1, 2], [1]]
    assert (next_smooth(1001), next_smooth(16928), next_pow_of_2(1000), is_smooth(22)) == (1008, 17010, 1024, False)
    assert str(trial_grid_rational(0.5 / 60)) == "1/120" and trial_grid_rational(math.pi) is None
    assert len(log_edges(0, 0, 4)) == 5
    with pytest.raises(ValueError):
        SearchParams(m=7)


def cosine(spark, r, n=1 << 15):
    t = np.arange(n)
    f = np.fft.rfft(np.cos(2 * np.pi * r * t / n + np.pi / 4))[: n // 2]
    lo = int(r) - 60
    rows = [("o", k, float(f[k].real), float(f[k].imag)) for k in range(lo, lo + 120)]
    return spark.createDataFrame(rows, "obs string, bin long, re double, im double")


@pytest.mark.parametrize("r", [12400.55, 12400.0])
def test_interpolation_of_a_cosine(spark, r):
    spec = cosine(spark, r)
    at = spark.createDataFrame([("o", r)], "obs string, rh double")
    want = (1 << 15) / 2 / math.sqrt(2)
    for fn in (interp.fourier_interp, interp.interp_direct):
        row = fn(at, spec, ["obs"], 60).first()
        assert row.re == pytest.approx(want, rel=1e-2) and row.im == pytest.approx(want, rel=1e-2)


def test_fold_ignores_imaginary_parts_of_the_ends(spark):
    rnd = np.random.default_rng(1)
    a = rnd.standard_normal(8) + 1j * rnd.standard_normal(8)
    df = spark.createDataFrame([("x", h + 1, float(a[h].real), float(a[h].imag)) for h in range(8)], "key string, h int, re double, im double")
    got = [r.v for r in fold.coherent_profiles(df, ["key"], 8).orderBy("i").collect()]
    assert np.allclose(got, np.fft.irfft(np.concatenate([[0], a[:7], [a[7].real]]), 16))
    assert np.allclose(search.fold(np.concatenate([[0], a])[None, :], 1)[0], got)
    two = search.fold(np.concatenate([[0], a])[None, :], 3)[0]
    assert np.allclose(two, np.fft.irfft([0, a[2], a[5].real], 4))


def test_metric_properties():
    rnd = np.random.default_rng(2)
    flat, noise = np.full((4, 64), 3.0), rnd.standard_normal((200, 64))
    assert metric.block_sigma_of(flat - flat.mean()) == 0
    pulse = noise.copy()
    pulse[:, 30] += 20
    s, _ = metric.boxcar_scan(noise, boxcar_widths(64))
    p, w = metric.boxcar_scan(pulse, boxcar_widths(64))
    assert p.min() > s.max() and (w == 1).mean() > 0.7
    assert np.allclose(metric.boxcar_scan(noise * 7, [1, 2, 3])[0] / metric.block_sigma_of(noise * 7), metric.boxcar_scan(noise, [1, 2, 3])[0] / metric.block_sigma_of(noise))
    for width in boxcar_widths(64):
        hat = np.zeros((1, 64))
        hat[0, np.arange(60, 60 + width) % 64] = 1.0
        assert metric.boxcar_scan(hat, boxcar_widths(64))[1][0] == width


def naive_width(p, widths):
    x, n = p - np.median(p), len(p)
    best = (-np.inf, None)
    for w in widths:
        s = max(sum(x[(i + j) % n] for j in range(w)) for i in range(n)) / math.sqrt(w)
        if s > best[0] + 1e-12:
            best = (s, w)
    return best


def test_best_width_against_a_plain_scan(spark):
    rnd = np.random.default_rng(3)
    p = [rnd.standard_normal(n).tolist() for n in (64, 64, 17, 4, 40)] + [None, []]
    df = spark.createDataFrame(list(enumerate(p)), "id int, profile array<double>")
    got = {r.id: r.width for r in metric.best_width(df).collect()}
    assert got == {i: naive_width(np.array(x), boxcar_widths(len(x)))[1] if x else None for i, x in enumerate(p)}


def test_sampling_rule_is_the_same_in_both_layers(spark):
    rnd = np.random.default_rng(4)
    for n, nbins, cap in ((100, 8, 200), (33, 10, 100), (5, 7, 1000), (7, 50, 20)):
        p = rnd.standard_normal((n, nbins))
        df = spark.createDataFrame([(0, i, p[i].tolist()) for i in range(n)], "b int, t int, profile array<double>")
        got = metric.block_sigma(df, "b", "t", cap=cap).first().sigma
        assert got == pytest.approx(metric.block_sigma_of(p, cap), rel=1e-12)


def synthetic(spark, n=1 << 15, base=210, amp=60.0, obs="o"):
    """A flat spectrum with eight harmonics of one bin."""
    re, im = np.full(n // 2, 0.5), np.full(n // 2, 0.5)
    rnd = np.random.default_rng(5)
    re, im = re + 0.3 * rnd.standard_normal(n // 2), im + 0.3 * rnd.standard_normal(n // 2)
    for h in range(1, 9):
        re[base * h] = amp / h
    rows = [(obs, k, float(re[k]), float(im[k])) for k in range(n // 2)]
    return spark.createDataFrame(rows, "obs string, bin long, re double, im double")


def test_detection_and_invariance(spark):
    n = 1 << 15
    spec = synthetic(spark, n).cache()
    best = {}
    for size, page in ((512, 4096), (2048, 1000), (4096, 333)):
        params = SearchParams(nharms=8, blocksize=size, decimations=(1, 2))
        out = search.trial_metrics(spec, params, 100.0, 400.0, n // 2, page_bins=page).where("k = 1").toPandas()
        top = out.loc[out.metric.idxmax()]
        best[size] = (top.r, top.metric, out.sort_values("t").metric.to_numpy())
        assert len(out) == 300 * 16 + 1
    assert len({b[0] for b in best.values()}) == 1 and abs(best[512][0] - 210) < 0.5
    assert np.ptp([b[1] for b in best.values()]) < 0.4 * best[2048][1]  # the signal itself is in each noise estimate
    params = SearchParams(nharms=8, blocksize=2048, decimations=(1, 2))
    found = search.search(spec, params, 100.0, 400.0, n // 2, 1000.0, threshold=8.0)
    kept = candidates.remove_harmonics(candidates.remove_duplicates(found)).toPandas()
    top = kept.loc[kept.metric.idxmax()]
    assert len(kept) < found.count() and min(abs(top.r - x) for x in (105, 210, 420)) < 1.1
    spec.unpersist()


def test_kernel_equals_relational_layer(spark):
    n = 1 << 12
    spec = synthetic(spark, n, base=50)
    params = SearchParams(nharms=8, blocksize=300)
    fast = {r.t: r.metric for r in search.trial_metrics(spec, params, 30.0, 120.0, n // 2, page_bins=256).collect()}
    grid = interp.trial_grid(spark, 30.0, 120.0, params.lodr, 300).withColumn("obs", F.lit("o"))
    amps = interp.fourier_interp(interp.harmonics(grid, 8), spec, ["t", "block", "h"], 16)
    profiles = fold.as_arrays(fold.coherent_profiles(amps, ["t", "block"], 8), ["t", "block"])
    slow = {r.t: r.metric for r in metric.snr_metrics(profiles, "block", "t", cap=8192).collect()}
    assert fast.keys() == slow.keys() and all(abs(fast[t] - slow[t]) <= 1e-8 * max(1, abs(slow[t])) for t in fast)


def test_guards_zero_missing_harmonics():
    bins = np.arange(100) + 1j
    amps = search.block_amplitudes(np.array([20.0, 20.5]), 6, 8, 100, lambda lo, hi: bins[lo : hi + 1])
    assert (amps[:, 1:5] != 0).all() and (amps[:, 5:] == 0).all() and (amps[:, 0] == 0).all()


def cands(spark, rows):
    return spark.createDataFrame([("o", r / 1000.0, float(m), float(r), 8) for r, m in rows], "obs string, freq double, metric double, r double, nharm int")


def test_collapse(spark):
    a = cands(spark, [(10000, 8.5), (10000.02, 12), (10000.05, 9), (20000, 7), (30000.1, 15), (30000.2, 11)])
    assert sorted(r.metric for r in candidates.remove_duplicates(a).collect()) == [7, 12, 15]
    b = cands(spark, [(5000, 9), (10000, 20), (15000, 8.5), (20000, 12)])
    assert [r.r for r in candidates.remove_harmonics(b).collect()] == [10000]
    assert sorted(r.r for r in candidates.remove_harmonics(b.union(cands(spark, [(13337, 11)]))).collect()) == [10000, 13337]
    assert candidates.remove_harmonics(b, numharm=1).count() == 4
    assert candidates.remove_duplicates(a.limit(0)).count() == 0


def test_islands_match_a_plain_scan(spark):
    rnd = random.Random(6)
    rows = [(rnd.uniform(1, 60_000), float(rnd.randrange(50))) for _ in range(3000)]
    got = sorted((r.r, r.metric) for r in candidates.remove_duplicates(cands(spark, rows), 5.0).collect())
    want, best, last = [], None, None
    for r, m in sorted(rows):
        if last is None or r - last > 5.0:
            if best:
                want.append(best)
            best = (r, m)
        elif m > best[1]:
            best = (r, m)
        last = r
    assert got == [*want, best]


def test_running_mean_clusters_match_a_plain_loop(spark):
    rnd = random.Random(7)
    f, rows = 1.0, []
    for i in range(3000):
        f *= 1 + rnd.expovariate(1 / 4e-6)
        rows.append(("o", f, 1.0, i))
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "obs string, freq double, dm double, id long")
    got = {}
    for r in sift.cluster_freq(df, ["obs"], 1e-5, ["dm", "id"]).collect():
        got.setdefault(r.cluster, set()).add(r.freq)
    want, n, total = [], 0, 0.0
    for x in sorted(r[1] for r in rows):
        if n == 0 or abs(x - total / n) > 1e-5 * (total / n):
            want.append(set())
            n, total = 0, 0.0
        want[-1].add(x)
        n, total = n + 1, total + x
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want))


def test_windows_sum_to_the_band_and_quantiles_rise(spark):
    rnd = np.random.default_rng(8)
    rows = [("o", int(i // 500), 1, i, 20 + i / 10, 8, float(x)) for i, x in enumerate(rnd.gamma(9, 0.5, 4000))]
    df = spark.createDataFrame(rows, "obs string, block long, k int, t long, r double, nharm int, metric double")
    params = SearchParams(nharms=5, hidr=0.5, blocksize=500)
    win = stats.with_window(df, params, 100.0, 20.0, 420.0, 4)
    per, band = stats.summary(win, ["k", "win"]).toPandas(), stats.summary(df, ["k"]).toPandas()
    assert per.ntrials.sum() == band.ntrials[0] == 4000
    row = band.iloc[0]
    assert row.vmedian < row.fap1 < row.fap2 < row.fap3 <= row.fap4 and abs(row.fap1 - np.quantile([r[-1] for r in rows], 0.9)) < 0.03
    norm = stats.metric_norm(win).toPandas()
    assert (norm.scale > 0).all()


def test_spectrum_pages_round_trip(spark):
    rnd = np.random.default_rng(9)
    x = rnd.standard_normal(64)
    series = spark.createDataFrame([("o", i, float(v)) for i, v in enumerate(x)], "obs string, b long, v double")
    spec = spectrum.spectrum(series, 64).orderBy("bin").toPandas()
    want = np.fft.rfft(x)
    assert np.allclose(spec.re[1:] + 1j * spec.im[1:], want[1:32]) and np.allclose([spec.re[0], spec.im[0]], [want[0].real, want[32].real])
    pages = spectrum.paged(spectrum.spectrum(series, 64), 10).orderBy("page").toPandas()
    assert np.allclose(np.concatenate(pages.re.tolist()), spec.re)


def test_fft_grid_equals_the_point_kernel(spark):
    from tidefold.operators import fftgrid

    rnd = np.random.default_rng(10)
    x = rnd.standard_normal(40) + 1j * rnd.standard_normal(40)
    got = fftgrid.fine_amplitudes(x, 24, 4, 16)
    for length in (160, 200, 331):
        assert np.allclose(fftgrid.fine_amplitudes(x, 24, 4, 16, length), got, atol=1e-12)
    j = np.arange(-7, 9)
    for g in (0, 1, 50, 95):
        fl, dr = 8 + g // 4, (g % 4) / 4
        want = (x[fl + j] * np.conj(np.sinc(dr - j) * np.exp(1j * np.pi * (dr - j)))).sum()
        assert abs(got[g] - want) < 1e-10


def test_normalized_search_still_detects(spark):
    n = 1 << 12
    spec = synthetic(spark, n, base=50, amp=20.0)
    params = SearchParams(nharms=8, blocksize=300, decimations=(1, 2))
    out = search.search_normalized(spec, params, 30.0, 120.0, n // 2, 1000.0, threshold=8.0, windows=3).toPandas()
    assert len(out) and min(abs(out.loc[out.metric.idxmax()].r - x) for x in (25, 50, 100)) < 1.1
