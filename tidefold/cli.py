"""Command line: ``python -m tidefold.cli search|sift ...``."""

from __future__ import annotations

import argparse
import os
import sys
from dataclasses import replace
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.operators import candidates, sift, stats
from tidefold.operators.search import block_accumulators, search_normalized, trial_metrics
from tidefold.params import SearchParams, decimation_set
from tidefold.shared import settled
from tidefold.sources import fft, text, writers

_RANKED = ("obs", "freq", "metric", "r", "nharm", "rank", "ducy")


def _local(path: str) -> str:
    """A path or ``file:`` URI as one absolute path, to compare them by."""
    return os.path.abspath(unquote(urlparse(path).path) if "://" in path or path.startswith("file:") else path)


def kinds_of(spark: SparkSession, paths: list[str]) -> list[tuple[int, float, list[str]]]:
    """``(length, sample time, paths)`` of each kind of observation, by the headers beside the files."""
    heads = fft.observations(text.read_inf(spark, [p[: -len(".fft")] + ".inf" for p in paths])).select("path", "n_samples", "dt").collect()  # one row per input file
    kind_of = {_local(r["path"])[: -len(".inf")]: (r["n_samples"], r["dt"]) for r in heads}
    kinds: dict[tuple[int, float], list[str]] = {}
    for p in paths:
        kinds.setdefault(kind_of[_local(p)[: -len(".fft")]], []).append(p)
    return [(n, dt, of) for (n, dt), of in kinds.items()]


def search_files(
    spark: SparkSession,
    paths: list[str],
    params: SearchParams,
    lofreq: float,
    hifreq: float,
    ncands: int = 100,
    duplicates: bool = False,
    related: bool = False,
    dr_tol: float = 1.0,
    numharm: int = 16,
    lobin: int = 1,
    normalize: bool = False,
) -> DataFrame:
    """Ranked candidates of ``.fft`` files (header ``.inf`` beside each): obs, rank, freq, metric, r, nharm, ducy.

    Files that share length and sample time are searched together.
    """
    found = None
    for n, dt, of in kinds_of(spark, paths):
        t_span = n * dt
        lo, hi = max(lofreq * t_span, float(lobin)), hifreq * t_span
        pages = fft.read_fft(spark, of).withColumnRenamed("path", "obs")
        spec = pages.select("obs", F.explode(F.arrays_zip("bins", "re", "im")).alias("s")).select("obs", F.col("s.bins").alias("bin"), "s.re", "s.im")
        if normalize:
            cands = search_normalized(pages, params, lo, hi, n // 2, t_span, pages=pages)
        else:
            hits = trial_metrics(pages, params, lo, hi, n // 2, params.threshold, pages=pages)
            cands = hits.select("obs", (F.col("r") / F.lit(t_span)).alias("freq"), "metric", "r", "nharm")
        if not duplicates:
            cands = candidates.remove_duplicates(cands, dr_tol)
        if not related:
            cands = candidates.remove_harmonics(cands, numharm, dr_tol)
        ranked = candidates.measure_ducy(candidates.top_candidates(cands, ncands), spec, n // 2, params.boxcar_fsp, params.boxcar_maxfrac).select(*_RANKED)
        found = ranked if found is None else found.unionByName(ranked)
    return found


def metric_tables(spark: SparkSession, paths: list[str], params: SearchParams, lofreq: float, hifreq: float, lobin: int = 1, windows: int = 16) -> dict[str, DataFrame]:
    """Lines ``(obs, .., line)`` of three tables: ``metricstats`` a block, ``metricfap`` a window, ``metrichist`` a histogram bin.

    All three come from the blocks' accumulators, which are made once and stored.
    """
    out: dict[str, DataFrame] = {}
    for n, dt, of in kinds_of(spark, paths):
        t_span, lo = n * dt, max(lofreq * n * dt, float(lobin))
        hi = hifreq * t_span
        pages = fft.read_fft(spark, of).withColumnRenamed("path", "obs")
        acc = settled(stats.with_window(block_accumulators(pages, params, lo, hi, n // 2, pages=pages), params, t_span, lo, hi, windows), "accumulators")
        hist = stats.merged_histogram(acc, ["obs", "k", "win"], ranged=True)
        made = {
            "metricstats": writers.block_table(stats.block_stats(acc, t_span), params.nharms, stats.good_harmonics_of(acc, params.nharms, n // 2)),
            "metricfap": writers.fap_table(stats.merged_summary(acc, ["obs", "k", "win"], writers.FILE_FAPS), params.nharms, t_span),
            "metrichist": writers.histogram_table(hist, params.nharms, t_span),
        }
        out = {k: v if k not in out else out[k].unionByName(v) for k, v in made.items()}
    return out


#: The headers and the order of the statistics files' lines.
_TABLES = {"metricstats": (writers.BLOCK_HEADER, ["block", "k"]), "metricfap": (writers.FAP_HEADER, ["k", "win"]), "metrichist": (writers.HIST_HEADER, ["k", "win", "bin"])}


def _write(lines: list[str], goal: str | None) -> None:
    if goal is None:
        sys.stdout.write("\n".join(lines) + "\n")
    else:
        os.makedirs(os.path.dirname(goal) or ".", exist_ok=True)
        with open(goal, "w") as out:
            out.write("\n".join(lines) + "\n")


def run_search(spark: SparkSession, args: argparse.Namespace) -> None:
    params = replace(
        SearchParams.production(), nharms=args.nharms, m=args.m, hidr=args.hidr, threshold=args.threshold, blocksize=args.blocksize, decimations=tuple(decimation_set(args.nharms, args.maxdecim))
    )
    goals = [writers.output_path(args.files, i, args.outputfilenm, args.outdir) for i in range(len(args.files))]
    ranked = search_files(spark, args.files, params, args.lofreq, args.hifreq, args.ncands, args.noremove, args.noharmremove, args.drtol, args.numharm, args.lobin, args.normalize)
    rows = ranked.withColumn("line", text.candidate_line(ranked)).select("obs", "rank", "line").orderBy("obs", "rank").collect()  # at most ncands per file
    for name, goal in zip(args.files, goals):
        _write([text.HEADER, *(r["line"] for r in rows if _local(r["obs"]) == _local(name))], goal)
    if args.metricstats:
        tables = metric_tables(spark, args.files, params, args.lofreq, args.hifreq, args.lobin)
        for name, goal in zip(args.files, goals):
            stem = os.path.splitext(goal or os.path.basename(name))[0]
            for kind, (header, order) in _TABLES.items():
                own = tables[kind].where(F.element_at(F.split("obs", "/"), -1) == os.path.basename(name)).orderBy(*order)
                # a line a row, streamed to the file
                lines = (r["line"] for r in own.toLocalIterator() if _local(r["obs"]) == _local(name))
                with open(f"{stem}_{kind}.txt", "w") as out:
                    out.write(f"# metric=boxcar nharms={params.nharms} threshold={params.threshold}\n{header}\n")
                    out.writelines(x + "\n" for x in lines)


def run_sift(spark: SparkSession, args: argparse.Namespace) -> None:
    paths = text.candidate_paths(args.files)
    rows = text.read_candidates(spark, paths, args.regex, args.min_snr).withColumn("id", F.col("rank"))
    grid = sift.dm_grid(rows)
    sigs = sift.signals(sift.detections(rows, args.within_tol, grid), args.cross_tol, sift.dm_step(grid), args.long_period_ms)
    scored = settled(sift.score_signals(sift.mark_harmonics(sigs), args.min_dms), "signals")
    ranked = settled(sift.report(scored, args.min_obs, args.min_score, args.top), "ranked")
    lines = sift.report_lines(ranked, args.dm_decimals).select("rank", F.lit(0).alias("part"), "line")
    if args.verbose:
        lines = lines.unionByName(sift.report_details(ranked, args.dm_decimals))
    body = [r["line"] for r in lines.orderBy("rank", "part").collect()]  # at most --top signals
    head = sift.report_header(rows, ranked, len(paths), vars(args))
    tail = ["#", f"# {ranked.count()} signals shown (of {scored.count()} total; use --min-score / --top to adjust)."]
    _write([*head, *body, *tail], args.output)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tidefold")
    sub = out.add_subparsers(dest="command", required=True)
    s = sub.add_parser("search", help="search .fft files", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    s.add_argument("files", nargs="+")
    s.add_argument("-o", "--outputfilenm", help="candidate file of a single input")
    s.add_argument("--outdir", help="folder of the candidate files")
    for name, kind, default in (
        ("threshold", float, 8.0), ("nharms", int, 60), ("maxdecim", int, 6), ("ncands", int, 100), ("lobin", int, 100), ("lofreq", float, 0.1),
        ("hifreq", float, 125.0), ("hidr", float, 0.5), ("m", int, 16), ("blocksize", int, 2048), ("drtol", float, 1.0), ("numharm", int, 16),
    ):
        s.add_argument(f"--{name}", type=kind, default=default)
    s.add_argument("--noremove", action="store_true", help="keep near-identical candidates")
    s.add_argument("--noharmremove", action="store_true", help="keep harmonically related candidates")
    s.add_argument("--normalize", action="store_true", help="threshold in units of the noise of each fold and window")
    s.add_argument("--metricstats", action="store_true", help="write a table of the metric's statistics")
    f = sub.add_parser("sift", help="sift candidate files", formatter_class=argparse.ArgumentDefaultsHelpFormatter)
    f.add_argument("files", nargs="+", help="candidate files, globs or folders")
    f.add_argument("--regex", default=text.NAME_PATTERN, help="pattern of file names with the groups obs and dm")
    f.add_argument("-o", "--output", help="report file")
    f.add_argument("-v", "--verbose", action="store_true", help="the components of each score, and a line per observation")
    for name, kind, default in (
        ("within-tol", float, 1e-5), ("cross-tol", float, 1e-5), ("min-snr", float, 0.0), ("min-dms", int, 2), ("min-obs", int, 1),
        ("long-period-ms", float, 100.0), ("min-score", float, None), ("top", int, 60), ("dm-decimals", int, 2),
    ):
        f.add_argument(f"--{name}", type=kind, default=default)
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("tidefold").getOrCreate()
    (run_search if args.command == "search" else run_sift)(spark, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
