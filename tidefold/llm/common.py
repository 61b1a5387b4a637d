"""Shared helpers: scratch tables in the cluster's shared folder, and table loading."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``).

    Only where that setting is absent and all runs on one machine (tests, a
    laptop) is a folder below the warehouse used instead.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/tidefold-{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage: a lost executor costs no more than re-reading the files.
    """
    path = scratch_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the decimal text of ``doc_id``, modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def hash_unit(c: Column, salt: str) -> Column:
    """A deterministic pseudo-random order for bounded training samples."""
    return F.xxhash64(F.lit(salt), c)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` is called so (case is ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def wide_hash(*cols: str) -> Column:
    """A 128-bit hash of the columns, as a struct of two longs."""
    return F.struct(F.xxhash64(*cols).alias("a"), F.xxhash64(F.lit(1), *cols).alias("b"))


def parts(column: pa.Array, size: int = 1 << 18) -> Iterator[pa.Array]:
    """A column of texts or bytes in slices of about ``size`` bytes, one value at least, in order.

    A batch of Spark has up to 10,000 rows; turned into Python objects at once, it would stay in the worker's memory.
    """
    ends = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False).astype("int64").cumsum()
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(ends.searchsorted((ends[lo - 1] if lo else 0) + size, side="right")))
        yield column.slice(lo, hi - lo)
        lo = hi


def values(column: pa.Array) -> Iterator:
    """The values of a column of texts or bytes as Python objects, few of them at a time."""
    for part in parts(column):
        yield from part.to_pylist()


def row_key(id_col: str, text_col: str) -> Column:
    """A 128-bit key of a row's id and text; equal rows have the same."""
    return wide_hash(id_col, text_col)
