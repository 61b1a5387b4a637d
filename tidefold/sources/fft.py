"""Binary spectra: little-endian complex64 values, read in pages by byte ranges."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidefold.operators.spectrum import PAGE_BINS

_PAGE = "path string, page bigint, lo_bin bigint, re array<double>, im array<double>, bins array<bigint>"
#: Bytes of an amplitude in a file, and of the range of a file that one task reads.
AMPLITUDE_BYTES, PART_BYTES = 8, 64 << 20
#: Kinds of paths that tasks open by themselves; files of other stores go through Spark's own reader.
OPENED = ("", "file", "hdfs", "s3", "s3a", "gs")


def _pages(name: str, data: np.ndarray, first: int, page_bins: int) -> pa.RecordBatch:
    """The pages of consecutive amplitudes from bin ``first`` on, which begins a page."""
    starts = np.arange(0, len(data), page_bins)
    ends = pa.array(np.append(starts, len(data)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (data.real.astype(np.float64), data.imag.astype(np.float64), np.arange(first, first + len(data)))]
    lo = first + starts
    return pa.RecordBatch.from_arrays([pa.array([name] * len(lo), pa.string()), pa.array(lo // page_bins), pa.array(lo), *lists], [x.split()[0] for x in _PAGE.split(", ")])


class _Range(InputPartition):
    """Bins ``first`` to ``last`` (exclusive) of a file."""

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last = path, first, last


class _RangeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.files = json.loads(options["files"])
        self.page_bins = int(options["page_bins"])
        step = max(1, int(options["part_bytes"]) // (AMPLITUDE_BYTES * self.page_bins)) * self.page_bins
        lo, hi = int(options.get("lo_bin", 0)), int(options.get("hi_bin", 1 << 62))
        self.lo = lo // self.page_bins * self.page_bins
        self.step, self.hi = step, hi

    def partitions(self) -> list[_Range]:
        out = []
        for path, length in self.files:
            end = min(length // AMPLITUDE_BYTES, self.hi + 1)
            out += [_Range(path, a, min(a + self.step, end)) for a in range(self.lo, end, self.step)]
        return out

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if urlparse(partition.path).scheme in ("", "file"):  # Spark's names of files are not escaped
            store, path = fs.LocalFileSystem(), re.sub("^file:(//)?(?=/)", "", partition.path)
        else:
            store, path = fs.FileSystem.from_uri(partition.path)
        batch = max(1, (1 << 20) // self.page_bins) * self.page_bins  # bins held at once
        with store.open_input_file(path) as source:
            for at in range(partition.first, partition.last, batch):
                count = min(batch, partition.last - at)
                data = np.frombuffer(source.read_at(count * AMPLITUDE_BYTES, at * AMPLITUDE_BYTES), "<c8")
                yield _pages(partition.path, data, at, self.page_bins)


class FftPages(DataSource):
    """Spectrum files as pages; a partition is a range of bytes of one file that begins at a page.

    Options: ``files`` (JSON list of path and length), ``page_bins``, ``part_bytes``,
    and optionally ``lo_bin`` and ``hi_bin``, which leave out the pages beyond.
    """

    @classmethod
    def name(cls) -> str:
        return "fft_pages"

    def schema(self) -> str:
        return _PAGE

    def reader(self, schema) -> DataSourceReader:
        return _RangeReader(self.options)


def read_fft(spark: SparkSession, path: str | list[str], page_bins: int = PAGE_BINS, part_bytes: int = PART_BYTES, bins: tuple[int, int] | None = None) -> DataFrame:
    """``(path, page, lo_bin, re, im, bins)`` of each file; bin 0 holds the zero-frequency and Nyquist amplitudes as stored.

    Spark lists the files (folders and patterns work) without reading them; then
    every task reads a range of at most ``part_bytes``, so a file of any size is
    read by many.  ``bins`` keeps the pages that hold those bins, first and last.
    An incomplete value at the end of a file is left out; empty files give no rows.
    Files in stores that only Spark's readers open are read whole (``read_whole``).
    """
    files = [(r["path"], r["length"]) for r in spark.read.format("binaryFile").load(path).select("path", "length").collect()]  # one row a file
    if any(urlparse(p).scheme not in OPENED for p, _ in files):
        out = read_whole(spark, path, page_bins)
        return out if bins is None else out.where(F.col("page").between(bins[0] // page_bins, bins[1] // page_bins))
    spark.dataSource.register(FftPages)
    reader = spark.read.format("fft_pages").options(files=json.dumps(sorted(files)), page_bins=str(page_bins), part_bytes=str(part_bytes))
    if bins is not None:
        reader = reader.options(lo_bin=str(max(0, bins[0])), hi_bin=str(bins[1]))
    return reader.load()


def read_whole(spark: SparkSession, path: str | list[str], page_bins: int = PAGE_BINS) -> DataFrame:
    """``read_fft`` by Spark's reader of binary files: a file goes through one task, 2 GiB at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                whole = len(content.as_buffer()) // AMPLITUDE_BYTES
                yield _pages(name, np.frombuffer(content.as_buffer(), "<c8", whole), 0, page_bins)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, _PAGE)


def observations(inf: DataFrame) -> DataFrame:
    """Headers with ``t_span``, ``df`` and ``dereddened``; a header without samples or sample time raises when it is read."""
    need = lambda c: F.when(F.col(c).isNotNull(), F.col(c)).otherwise(F.raise_error(F.concat(F.lit(f"no {c} in "), F.col("path"))))
    return inf.withColumn("n_samples", need("n_samples")).withColumn("dt", need("dt")).withColumns(
        {"t_span": F.col("n_samples") * F.col("dt"), "df": 1.0 / (F.col("n_samples") * F.col("dt")), "dereddened": F.col("path").contains("_red.inf") | F.col("path").contains("_red.fft")}
    )
