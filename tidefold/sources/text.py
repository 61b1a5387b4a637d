"""Text files: observation headers, candidate tables, and the values in file names."""

from __future__ import annotations

import glob
import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Observation and dispersion measure in the name of a candidate file.
NAME_PATTERN = r"(?P<obs>.+?)_DM(?P<dm>[0-9]+(?:\.[0-9]+)?)"
#: Files that a folder is searched for.
CANDIDATE_FILES = ("*.cohout", "*.txt")

#: Prefixes of the header lines that are read, by column; fixed by the file format.
INF_LINES = {
    "object": ("Object being observed", "string"),
    "epoch_mjd": ("Epoch of observation", "double"),
    "n_samples": ("Number of bins in the time series", "bigint"),
    "dt": ("Width of each time series bin", "double"),
    "dm": ("Dispersion measure", "double"),
}


def read_inf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(path, object, epoch_mjd, n_samples, dt, dm)`` per header file; unknown lines are ignored, values may be missing."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("line"))
    value = F.trim(F.substring_index("line", "=", -1))
    outs = [F.expr(f"try_cast(first(v_{c}, true) AS {kind})").alias(c) for c, (_, kind) in INF_LINES.items()]
    tagged = lines.withColumns({f"v_{c}": F.when(F.col("line").startswith(prefix), value) for c, (prefix, _) in INF_LINES.items()})
    return tagged.groupBy("path").agg(*outs)


def name_keys(name: Column, pattern: str = NAME_PATTERN) -> tuple[Column, Column, Column]:
    """Whether ``pattern`` occurs in a name, and its groups ``obs`` and ``dm`` (the first two, if it names none)."""
    at = re.compile(pattern).groupindex
    if at and not {"obs", "dm"} <= at.keys():
        raise ValueError("the pattern has to name the groups obs and dm")
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    return name.rlike(plain), F.regexp_extract(name, plain, at.get("obs", 1)), F.regexp_extract(name, plain, at.get("dm", 2))


def candidate_paths(paths: list[str]) -> list[str]:
    """Folders as their candidate files, globs as what they match, each path once, in the given order; nothing is read."""
    found: list[str] = []
    for p in paths:
        if os.path.isdir(p):
            found += [f for kind in CANDIDATE_FILES for f in sorted(glob.glob(os.path.join(p, kind)))]
        else:
            found += sorted(glob.glob(p)) or [p]
    return list(dict.fromkeys(found))


def parse_candidates(lines: DataFrame, line: str = "value", min_snr: float = float("-inf")) -> DataFrame:
    """Adds ``rank, snr, freq, period_ms, numharm, ducy``; comments, blank, short and malformed lines are dropped.

    ``ducy`` is a fraction, null where it is absent or not a percentage.
    """
    parts = F.split(F.trim(F.col(line)), r"\s+")
    num = lambda i: F.get("_p", F.lit(i)).try_cast("double")
    rows = lines.withColumn("_p", parts).where(~F.trim(F.col(line)).startswith("#") & (F.size("_p") >= 5))
    out = rows.withColumns(
        {
            "rank": num(0).cast("bigint"),
            "snr": num(1),
            "freq": num(2),
            "period_ms": num(3),
            "numharm": num(4).cast("bigint"),
            "ducy": F.rtrim(F.get("_p", F.lit(5)), F.lit("%")).try_cast("double") / 100.0,
        }
    ).drop("_p")
    return out.where(F.col("snr").isNotNull() & F.col("freq").isNotNull() & F.col("period_ms").isNotNull() & F.col("numharm").isNotNull() & (F.col("freq") > 0) & (F.col("snr") >= min_snr))


def read_candidates(spark: SparkSession, path: str | list[str], pattern: str = NAME_PATTERN, min_snr: float = float("-inf")) -> DataFrame:
    """Candidate rows of all files whose name has the keys: ``obs, dm`` and the columns of :func:`parse_candidates`."""
    ok, obs, dm = name_keys(F.col("_metadata.file_name"), pattern)
    lines = spark.read.text(path).select(ok.alias("_ok"), obs.alias("obs"), dm.try_cast("double").alias("dm"), "value").where("_ok AND dm IS NOT NULL")
    return parse_candidates(lines.drop("_ok"), "value", min_snr).drop("value")


def candidate_line(ranked: DataFrame) -> Column:
    """One line of the candidate table from ``rank, metric, freq, nharm, ducy``; the duty cycle in percent or ``-``."""
    ducy = F.when(F.col("ducy").isNull(), F.lit("-")).otherwise(F.format_string("%.2f", 100.0 * F.col("ducy")))
    return F.format_string("%-4d  %8.2f  %18.12f  %18.12f   %3d   %6s", "rank", "metric", "freq", 1000.0 / F.col("freq"), "nharm", ducy)


#: The fixed first line of the table.
HEADER = "#       'S/N'      Frequency (Hz)        Period (ms)    #Harm  Ducy(%)"


def write_candidates(ranked: DataFrame, path: str) -> None:
    """The table of a top-n report as text, one file per observation folder, in rank order."""
    out = ranked.select("obs", "rank", candidate_line(ranked).alias("value"))
    head = ranked.select("obs").distinct().select("obs", F.lit(0).alias("rank"), F.lit(HEADER).alias("value"))
    both = head.unionByName(out).repartition("obs").sortWithinPartitions("obs", "rank")
    both.select("obs", "value").write.partitionBy("obs").text(path)


def parse_periods(lines: DataFrame, line: str = "value") -> DataFrame:
    """``(freq, width, ducy, snr)`` of lines ``period freq width ducy% dm snr`` of another program; the title and malformed lines are dropped."""
    num = lambda i, kind: F.get("_p", F.lit(i)).try_cast(kind)
    rows = lines.select(F.split(F.trim(F.col(line)), r"\s+").alias("_p")).where((F.size("_p") == 6) & ~F.get("_p", F.lit(0)).startswith("period"))
    out = rows.select(num(1, "double").alias("freq"), num(2, "int").alias("width"), (F.rtrim(F.get("_p", F.lit(3)), F.lit("%")).try_cast("double") / 100.0).alias("ducy"), num(5, "double").alias("snr"))
    return out.dropna()


def stage_times(lines: DataFrame, line: str = "value") -> DataFrame:
    """``(stage, ms)`` of every ``'name' runtime: x ms`` in log lines."""
    pattern = r"'(\w+)' runtime: ([\d.]+) ms"
    hit = lines.select(F.explode(F.regexp_extract_all(line, F.lit(pattern), F.lit(0))).alias("_m"))
    return hit.select(F.regexp_extract("_m", pattern, 1).alias("stage"), F.regexp_extract("_m", pattern, 2).try_cast("double").alias("ms"))
