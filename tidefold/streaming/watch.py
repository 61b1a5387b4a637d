"""Searching spectra as they arrive: an addition for continuous operation.

New rows of a paged-spectrum folder are read as a stream; every micro-batch is
searched and its candidates appended.  The other relative of a stream here is
the metric histogram, a mergeable count that a streaming aggregation keeps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidefold.operators.search import search
from tidefold.params import SearchParams
from tidefold.schema import SPECTRUM


def watch_spectra(
    spark: SparkSession,
    incoming: str,
    results: str,
    checkpoint: str,
    params: SearchParams,
    r_lo: float,
    r_hi: float,
    n_half: int,
    t_span: float,
    available_now: bool = False,
) -> StreamingQuery:
    """Search every observation that lands in ``incoming`` (Parquet, one whole observation per file).

    A batch that is run again after a failure overwrites its own folder, so
    each observation's candidates appear once.
    """

    def each(batch: DataFrame, number: int) -> None:
        search(batch, params, r_lo, r_hi, n_half, t_span).write.mode("overwrite").parquet(f"{results}/batch={number}")

    writer = spark.readStream.schema(SPECTRUM).parquet(incoming).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def streaming_histogram(metrics: DataFrame, lo: float = 0.0, hi: float = 64.0, nb: int = 3200) -> DataFrame:
    """Counts per (k, bin) of a stream of trial metrics, in complete or update mode."""
    x = F.col("metric")
    b = F.when(x < lo, -1).when(x >= hi, nb).otherwise(F.floor((x - lo) * F.lit(nb / (hi - lo))))
    return metrics.groupBy("k", b.cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
