"""Connected components of an edge table, as alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefold.llm.common import stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first())


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node long, root long)``, root = smallest node reachable.

    Alternates the "large star" and "small star" steps until the edges no longer
    change: a logarithmic number of rounds, each a few joins and aggregations on
    the node, every round written to the shared folder.  The smallest neighbours
    are a table of their own, so that the rows of a node with very many can be
    split in the join.  Nothing is collected but a count and a checksum.  Loops (``a = b``) and repeated edges are
    allowed; rows with a null end are ignored; no edges give no rows.  Only
    nodes that have an edge to another node are returned.  Raises if
    ``max_rounds`` is reached, rather than returning unfinished groups.
    """
    cur = stored(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    before = _mark(cur)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(low, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        large = stored(large, "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = (
            large.join(least, "u")
            .where(F.col("v") != F.col("m"))
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        cur = stored(small, "small")
        now = _mark(cur)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled after {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
