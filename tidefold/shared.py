"""Tables in the folder that all executors share, to cut the lineage of iterations."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` below ``spark.checkpoint.dir`` and read it back: a lost executor costs no more than reading files again.

    Where that setting is absent and all runs on one machine (tests, a laptop), a
    folder below the warehouse is used.
    """
    spark = df.sparkSession
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    path = f"{named.rstrip('/')}/tidefold-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
