import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefold import cli
from tidefold.operators import sift
from tidefold.operators.spectrum import PAGE_BINS
from tidefold.params import SearchParams
from tidefold.sources import fft, text, writers
from tidefold.streaming import watch


def write_observation(folder, name, base=210, n=1 << 15, dt=1e-4):
    rnd = np.random.default_rng(base)
    x = 0.5 + 0.5j + 0.3 * (rnd.standard_normal(n // 2) + 1j * rnd.standard_normal(n // 2))
    for h in range(1, 9):
        x[base * h] = 60 / h
    x.astype("<c8").tofile(folder / f"{name}.fft")
    (folder / f"{name}.inf").write_text(
        f" Object being observed                  =  FAKE\n Epoch of observation (MJD)             =  55000.5\n"
        f" Number of bins in the time series      =  {n}\n Width of each time series bin (sec)    =  {dt}\n"
        f" Dispersion measure (cm-3 pc)           =  12.5\n Any notes:\n"
    )
    return str(folder / f"{name}.fft")


def test_readers(spark, tmp_path):
    path = write_observation(tmp_path, "a_red")
    head = fft.observations(text.read_inf(spark, str(tmp_path / "a_red.inf"))).first()
    assert (head.object, head.epoch_mjd, head.n_samples, head.dt, head.dm) == ("FAKE", 55000.5, 1 << 15, 1e-4, 12.5)
    assert head.dereddened and head.df == pytest.approx(1 / (2**15 * 1e-4))
    pages = fft.read_fft(spark, path, 1000)
    assert pages.count() == 17 and pages.agg(F.sum(F.size("re"))).first()[0] == 1 << 14
    (tmp_path / "broken.inf").write_text("nothing = 1\n")
    with pytest.raises(Exception, match="no n_samples"):
        fft.observations(text.read_inf(spark, str(tmp_path / "broken.inf"))).collect()


def test_byte_ranges_equal_whole_files(spark, tmp_path):
    (tmp_path / "more").mkdir()
    rnd = np.random.default_rng(4)
    for name, n in (("a b.fft", 10_000), ("c.fft", 999), ("d.fft", 0), ("e.fft", 4096)):
        (rnd.standard_normal(n) + 1j * rnd.standard_normal(n)).astype("<c8").tofile(tmp_path / "more" / name)
    with open(tmp_path / "more" / "e.fft", "ab") as f:
        f.write(b"odd")
    where = str(tmp_path / "more")
    whole = sorted(map(tuple, fft.read_whole(spark, where, 500).collect()))
    assert sum(len(r[3]) for r in whole) == 10_000 + 999 + 4096
    for part in (1, 8_000, 1 << 20):
        pages = fft.read_fft(spark, where, 500, part)
        assert sorted(map(tuple, pages.collect())) == whole
    assert fft.read_fft(spark, where, 500, 1).rdd.getNumPartitions() == 20 + 2 + 9
    some = fft.read_fft(spark, where + "/*.fft", 500, 8_000, bins=(1200, 2600))
    got = some.collect()
    assert {r.page for r in got} == {2, 3, 4, 5} and {r.path.rsplit("/", 1)[1] for r in got} == {"a b.fft", "e.fft"}


def test_a_file_above_two_gibibytes_is_read_by_many_tasks(spark, tmp_path):
    size = (2 << 30) + (64 << 20)
    with open(tmp_path / "big.fft", "wb") as f:  # sparse
        f.truncate(size)
        f.seek(size - 8)
        f.write(np.array([3 - 4j], "<c8").tobytes())
    bins = size // 8
    pages = fft.read_fft(spark, str(tmp_path / "big.fft"), 1 << 16, bins=(bins - 100, bins))
    assert [(r.page, len(r.re), r.re[-1], r.im[-1]) for r in pages.collect()] == [((bins - 1) >> 16, 1 << 16, 3.0, -4.0)]
    assert fft.read_fft(spark, str(tmp_path / "big.fft"), 1 << 16).rdd.getNumPartitions() == 33


def test_search_command(spark, tmp_path, capsys):
    one, two = write_observation(tmp_path, "x_DM1.0"), write_observation(tmp_path, "x_DM2.0", 214)
    args = ["--nharms", "8", "--maxdecim", "2", "--lofreq", "30", "--hifreq", "120"]
    assert cli.main(["search", one, *args]) == 0
    lines = capsys.readouterr().out.strip().splitlines()
    t = (1 << 15) * 1e-4
    assert lines[0] == text.HEADER and any(abs(float(x.split()[2]) * t - 210) < 1 for x in lines[1:3])
    assert all(x.split()[5] != "-" for x in lines[1:])
    assert cli.main(["search", one, two, "--outdir", str(tmp_path), *args]) == 0
    back = text.read_candidates(spark, str(tmp_path / "*.cohout"))
    assert {(r.obs, r.dm) for r in back.collect()} == {("x", 1.0), ("x", 2.0)}
    assert cli.main(["sift", str(tmp_path / "*.cohout"), "--within-tol", "0.03"]) == 0
    assert len(capsys.readouterr().out.strip().splitlines()) >= 1


def test_files_of_different_length_and_options(spark, tmp_path, capsys):
    """Each file gets its own candidates, whatever its length and however alike the names are."""
    (tmp_path / "in").mkdir()
    short = write_observation(tmp_path / "in", "a_DM1.0", n=1 << 14)
    long_, same = write_observation(tmp_path / "in", "ba_DM1.0", 230), write_observation(tmp_path / "in", "a_DM1.00", 250)
    args = ["--nharms", "8", "--maxdecim", "2", "--lofreq", "30", "--hifreq", "120", "--outdir", str(tmp_path / "out")]
    assert cli.main(["search", short, long_, same, *args, "--metricstats", "--noharmremove", "--lobin", "1"]) == 0
    tops = {}
    for name, t in (("a_DM1.0", (1 << 14) * 1e-4), ("ba_DM1.0", (1 << 15) * 1e-4), ("a_DM1.00", (1 << 15) * 1e-4)):
        lines = (tmp_path / "out" / f"{name}.cohout").read_text().splitlines()
        tops[name] = {round(float(x.split()[2]) * t) for x in lines[1:]}
        table, faps, hist = ((tmp_path / "out" / f"{name}_{kind}.txt").read_text().splitlines() for kind in ("metricstats", "metricfap", "metrichist"))
        assert table[1] == writers.BLOCK_HEADER and len(table) > 3 and {tuple(x.split()[1:4]) for x in table[2:]} == {("1", "8", "16"), ("2", "4", "8")}
        trials = {k: sum(int(x.split()[7]) for x in table[2:] if x.split()[1] == k) for k in "12"}
        assert faps[1] == writers.FAP_HEADER and {k: sum(int(x.split()[6]) for x in faps[2:] if x.split()[0] == k) for k in "12"} == trials
        assert all(len(x.split("|")[1].split("#")[0].split()) == 5 for x in faps[2:])
        shown = {k: sum(int(x.split()[6]) for x in hist[2:] if x.split()[0] == k) for k in "12"}  # without those above the range
        assert hist[1] == writers.HIST_HEADER and all(0.98 * trials[k] < shown[k] <= trials[k] for k in "12")
    assert 210 in tops["a_DM1.0"] and 230 in tops["ba_DM1.0"] and 250 in tops["a_DM1.00"]
    assert cli.main(["search", long_, *args, "--normalize", "--threshold", "20", "--noremove", "--ncands", "7"]) == 0
    report = tmp_path / "report.txt"
    assert cli.main(["sift", str(tmp_path / "out"), "--regex", r"^(?P<obs>\w+)_DM(?P<dm>[0-9.]+)[.]cohout", "-o", str(report), "--within-tol", "0.03", "--min-score=-1e9"]) == 0
    plain = report.read_text().splitlines()
    assert plain[0] == "# candidate sift" and plain[5] == sift.REPORT_HEADER and "signals shown" in plain[-1] and capsys.readouterr().out == ""
    shown = [x for x in plain if not x.startswith("#")]
    assert cli.main(["sift", str(tmp_path / "out"), "--regex", r"^(?P<obs>\w+)_DM(?P<dm>[0-9.]+)[.]cohout", "-o", str(report), "--within-tol", "0.03", "--min-score=-1e9", "-v"]) == 0
    wordy = [x for x in report.read_text().splitlines() if not x.startswith("#")]
    assert [x for x in wordy if not x.startswith("        ")] == shown and sum("score=" in x for x in wordy) == len(shown)
    assert sum("DMrange" in x for x in wordy) >= len(shown) and all("persist=" in x for x in wordy if "score=" in x)


def test_path_expansion_and_patterns(spark, tmp_path):
    for name in ("b.txt", "a.txt", "c.cohout", "d.log"):
        (tmp_path / name).write_text("")
    d = str(tmp_path)
    assert text.candidate_paths([f"{d}/a.txt", d, f"{d}/*.txt", "none*"]) == [f"{d}/a.txt", f"{d}/c.cohout", f"{d}/b.txt", "none*"]
    df = spark.createDataFrame([("DM3_of_x",), ("y",)], "name string")
    ok, obs, dm = text.name_keys(F.col("name"), r"DM(?P<dm>[0-9]+)_of_(?P<obs>\w+)")
    assert [tuple(r) for r in df.select(ok, obs, dm).collect()] == [(True, "x", "3"), (False, "", "")]
    with pytest.raises(ValueError):
        text.name_keys(F.col("name"), r"(?P<obs>.)(?P<other>.)")


def test_period_tables_and_serial_fraction(spark):
    from tidefold.operators import stats

    lines = ["period freq width ducy dm snr", "0.5 2.0 3 12.50% 0.0 9.5", "0.5 2.0 x 12.50% 0.0 9.5", "1 2 3", ""]
    got = text.parse_periods(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [tuple(r) for r in got] == [(2.0, 3, 0.125, 9.5)]
    runs = spark.createDataFrame([(n, 1 / (0.06 + 0.94 / n)) for n in (1, 2, 4, 8, 20)], "n int, speedup double")
    fit = stats.serial_fraction(runs).first()
    assert fit.serial == pytest.approx(0.06) and fit.ceiling == pytest.approx(1 / 0.06)
    assert stats.serial_fraction(runs.where("n = 1")).first().serial is None
    metrics = spark.createDataFrame([("o", 0, 1, 10.0), ("o", 0, 1, 30.0), ("o", 0, 2, 60.0), ("o", 1, 1, 500.0)], "obs string, block long, k int, r double")
    assert {(r.block, r.ngoodbins) for r in stats.good_harmonics(metrics, 60, 2000).collect()} == {(0, 60.0), (1, 4.0)}


def test_output_paths():
    assert writers.output_path(["a/b.fft"], 0, None, None) is None
    assert writers.output_path(["a/b.fft"], 0, "c", None) == "c"
    assert writers.output_path(["a/b.fft", "d.fft"], 0, None, None) == "a/b.cohout"
    assert writers.output_path(["a/b.fft"], 0, None, "z") == "z/b.cohout"
    with pytest.raises(ValueError):
        writers.output_path(["a", "b"], 0, "c", None)


def test_candidate_lines(spark):
    df = spark.createDataFrame([("# c",), ("",), ("1 2 3",), ("1 9.5 2.0 500 8 12.5%",), ("2 9.5 2.0 500 8.0 -",), ("3 x 2.0 500 8",), ("4 9 -1 5 8",)], "value string")
    got = [(r["rank"], r.snr, r.numharm, r.ducy) for r in text.parse_candidates(df).orderBy("rank").collect()]
    assert got == [(1, 9.5, 8, 0.125), (2, 9.5, 8, None)]
    logs = spark.createDataFrame([("a 'fold' runtime: 1.5 ms b 'scan' runtime: 2 ms",), ("none",)], "value string")
    assert {(r.stage, r.ms) for r in text.stage_times(logs).collect()} == {("fold", 1.5), ("scan", 2.0)}


def test_watched_folder(spark, tmp_path):
    rnd = np.random.default_rng(0)
    n = 1 << 12
    x = rnd.standard_normal(n // 2) + 1j * rnd.standard_normal(n // 2)
    for h in range(1, 9):
        x[60 * h] += 50
    rows = [("o", k, float(v.real), float(v.imag)) for k, v in enumerate(x)]
    spark.createDataFrame(rows, "obs string, bin long, re double, im double").coalesce(1).write.parquet(str(tmp_path / "in"))
    query = watch.watch_spectra(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"), SearchParams(nharms=8), 30.0, 120.0, n // 2, 100.0, available_now=True)
    query.awaitTermination(120)
    found = spark.read.parquet(str(tmp_path / "out")).orderBy(F.desc("metric")).first()
    assert found.obs == "o" and (abs(found.r - 60) < 1.1 or abs(found.r - 30) < 1.1 or abs(found.r - 120) < 1.1)


def test_page_size_is_positive():
    assert PAGE_BINS > 0
