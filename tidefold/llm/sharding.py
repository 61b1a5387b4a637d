"""Shards of nearly equal size: sampled splitters, ranges, and overfull ranges divided again."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm.common import fresh, stored, table

SHARDS = 16
#: Ranges: so many a shard at least, one for each so many bytes beyond, and so many in all at most.
RANGES_A_SHARD, RANGE_BYTES, MAX_RANGES = 256, 64 << 20, 1 << 16
#: Sampled keys for each range that is to come out.
OVERSAMPLING = 8
#: A shard ends at the edge of a group of equal keys if one lies within this share of a shard.
EDGE_SHARE = 0.01
MAX_ROUNDS = 12

Key = tuple[int, int, int]
_LEAST = -(1 << 63)


def position(splitters: Sequence[np.ndarray], keys: Sequence[np.ndarray]) -> np.ndarray:
    """How many of the sorted ``splitters`` are at or below each key; both are given column by column."""
    low, high = np.searchsorted(splitters[0], keys[0], "left"), np.searchsorted(splitters[0], keys[0], "right")
    if len(splitters) == 1:
        return high
    out = high.copy()
    tied = np.flatnonzero(low < high)
    for lo in np.unique(low[tied]).tolist():
        rows = tied[low[tied] == lo]
        hi = int(high[rows[0]])
        out[rows] = lo + position([s[lo:hi] for s in splitters[1:]], [k[rows] for k in keys[1:]])
    return out


def splitters_of(sample: list[tuple[Key, float]], weight: float) -> list[Key]:
    """Keys that cut a sorted weighted sample about every ``weight``.

    A cut moves to the beginning of its group of equal first parts; only where
    that is no cut any more (the group alone is overfull) it stays inside.
    """
    cuts: list[Key] = []
    filled, last = 0.0, sample[0][0] if sample else (0, 0, 0)
    for key, w in sample:
        if filled >= weight:
            edge = (key[0], _LEAST, _LEAST)
            cut = edge if edge > last else key
            if cut > last:
                cuts.append(cut)
                filled, last = 0.0, cut
        filled += w
    return cuts


@dataclass(frozen=True)
class Ranges:
    """Sorted splitters, and for each of the ranges between them its shard and the slot of its first row."""

    splitters: list[Key]
    shard: list[int]
    offset: list[int]


def shards_of(splitters: list[Key], sizes: list[int], rows: list[int], shards: int) -> Ranges:
    """Deal consecutive ranges to shards so that sizes are as equal as the edges between ranges allow.

    The edge nearest to each equal share is taken, and of those within
    ``EDGE_SHARE`` of a shard preferably one between two groups of equal keys.
    """
    ends = np.concatenate([[0], np.cumsum(sizes)]).tolist()  # edge i lies before range i
    share = ends[-1] / shards
    whole = [i for i in range(len(ends)) if i in (0, len(ends) - 1) or splitters[i - 1][1:] == (_LEAST, _LEAST)]
    whole_ends = [ends[i] for i in whole]

    def nearest(values: list[int], goal: float) -> int:
        i = bisect_left(values, goal)
        return min((j for j in (i - 1, i) if 0 <= j < len(values)), key=lambda j: abs(values[j] - goal))

    edges = [0]
    for s in range(1, shards):
        near = whole[nearest(whole_ends, s * share)]
        if abs(ends[near] - s * share) > EDGE_SHARE * share:
            near = nearest(ends, s * share)
        edges.append(max(near, edges[-1]))
    shard = (np.searchsorted(edges, np.arange(len(sizes)), "right") - 1).tolist()
    offset, filled = [], [0] * shards
    for s, n in zip(shard, rows):
        offset.append(filled[s])
        filled[s] += n
    return Ranges(splitters, shard, offset)


def _located(df: DataFrame, splitters: list[Key], names: tuple[str, str, str], out: str) -> DataFrame:
    """``df`` with the number of the range that each row's key is in."""
    cols = [np.array(c, np.int64) for c in zip(*splitters)] if splitters else [np.zeros(0, np.int64)] * 3

    @F.pandas_udf("bigint")
    def at(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(position(cols, [x.to_numpy(np.int64) for x in (a, b, c)]))

    return df.withColumn(out, at(*names))


def plan_ranges(rows: DataFrame, key: tuple[str, str, str], size: str, shards: int) -> Ranges:
    """Splitters and shards for ``rows`` with three long key columns and a size of 1 or more.

    A row weighs its size plus the mean size, so that a range is bounded in bytes
    and in rows.  Keys are drawn with a probability that grows with the weight
    (a hash decides, so a repeated task draws the same), at most about
    ``MAX_RANGES * OVERSAMPLING`` of them; the weighted quantiles are splitters.
    All rows are then counted by range, and a range of more than twice the
    intended weight is sampled and split again, until none is left or each holds
    one row.  What the driver holds is bounded by ``MAX_RANGES``, not by the rows.
    """
    n, total = rows.agg(F.count(F.lit(1)), F.sum(size)).first()
    if not n:
        return Ranges([], [0], [0])
    mean = total / n
    want = int(min(MAX_RANGES, max(RANGES_A_SHARD * shards, total // RANGE_BYTES)))
    goal = 2.0 * total / want
    weight = F.col(size) + F.lit(mean)
    splitters: list[Key] = []
    overfull: list[int] | None = None  # all rows at first
    sizes, counts = [int(total)], [int(n)]
    for turn in range(MAX_ROUNDS):
        if overfull is not None and not overfull:
            break
        unit = (F.xxhash64(F.lit(turn), *key).cast("double") / F.lit(2.0**64)) + 0.5
        least = goal / OVERSAMPLING
        pool = rows if overfull is None else _located(rows, splitters, key, "_range").where(F.col("_range").isin(overfull))
        drawn = pool.where(unit * least < weight).select(*key, F.greatest(weight, F.lit(least)).alias("w")).collect()  # bounded by OVERSAMPLING a range
        sample = sorted(((r[0], r[1], r[2]), r[3]) for r in drawn)
        if overfull is None:
            fresh_cuts = splitters_of(sample, goal)
        else:
            fresh_cuts, edges = [], [(_LEAST,) * 3, *splitters]
            place = np.array([bisect_left(edges, (k[0], k[1], k[2] + 1)) for k, _ in sample])
            for at in np.unique(place).tolist():
                fresh_cuts += splitters_of([s for s, p in zip(sample, place.tolist()) if p == at], goal)
        merged = sorted({*splitters, *fresh_cuts})
        if len(merged) == len(splitters) and turn:
            break
        splitters = merged
        found = {r[0]: (int(r[1]), int(r[2])) for r in _located(rows, splitters, key, "_range").groupBy("_range").agg(F.sum(size), F.count(F.lit(1))).collect()}
        sizes, counts = ([found.get(i, (0, 0))[j] for i in range(len(splitters) + 1)] for j in (0, 1))
        overfull = [i for i, (s, c) in enumerate(zip(sizes, counts)) if c > 1 and s + c * mean > 2 * goal]
    return shards_of(splitters, sizes, counts, shards)


def range_shards(rows: DataFrame, group: str, order: Sequence[str], size: str, shards: int = SHARDS) -> DataFrame:
    """``rows`` with ``shard`` (0 .. ``shards`` - 1) and ``slot`` (gapless from 0 in each shard), sizes nearly equal.

    Rows are ordered by a hash of ``group``, a hash of ``order`` and their place
    in the input, and shards are ranges of that order: equal values of ``group``
    are neighbours and share a shard, but for groups at an edge where none
    between groups is near, i.e. groups of over ``EDGE_SHARE`` of a shard, which
    are divided.  Sizes are equal but for half a range (``1 / RANGES_A_SHARD`` of
    a shard on average) or one row at either edge.

    Nulls in ``group`` or ``order`` are values of their own; ``size`` is 1 or
    more; repeated rows are told apart by their place; no rows give no rows.
    Columns called ``shard`` or ``slot`` of the input are replaced.

    The rows with their keys are stored once and so keep their places when a
    task is repeated; only rows of one range, bounded in bytes and rows, are
    sorted together.
    """
    rows = rows.drop("shard", "slot")
    names = tuple(fresh(rows, f"_k{i}") for i in range(3))
    keyed = stored(rows.withColumns({names[0]: F.xxhash64(group), names[1]: F.xxhash64(*order), names[2]: F.monotonically_increasing_id()}), "keys")
    ranges = plan_ranges(keyed.select(*names, F.col(size).alias("size")), names, "size", shards)
    return _dealt(keyed, ranges, names).select(*rows.columns, "shard", "slot")


def _dealt(keyed: DataFrame, ranges: Ranges, names: tuple[str, str, str]) -> DataFrame:
    """``shard`` and ``slot`` of every row by its range."""
    shard, offset = np.array(ranges.shard, np.int32), np.array(ranges.offset, np.int64)

    @F.pandas_udf("shard int, first bigint")
    def goal(at: pd.Series) -> pd.DataFrame:
        i = at.to_numpy(np.int64)
        return pd.DataFrame({"shard": shard[i], "first": offset[i]})

    at, to = fresh(keyed, "_range"), fresh(keyed, "_to")
    rank = F.row_number().over(Window.partitionBy(at).orderBy(*names))
    ordered = _located(keyed, ranges.splitters, names, at).withColumn(to, rank - 1)
    return ordered.withColumn(at, goal(at)).withColumns({"shard": F.col(f"{at}.shard"), "slot": F.col(f"{at}.first") + F.col(to)})


def sized(docs: DataFrame, text_col: str = "text", out: str = "size") -> DataFrame:
    """Adds the UTF-8 bytes of the text (null: none) plus 1."""
    return docs.withColumn(out, F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint") + 1)


def write_shards(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """Write whole documents as Parquet below ``path``, a folder ``shard=..`` each, and return them as read back.

    Rows stay in the order of ``slot`` within a file; the files of a shard are
    as many as tasks had rows of it.
    """
    size = fresh(docs, "_size")
    out = range_shards(sized(docs, text_col, size), text_col, [id_col], size, shards).drop(size)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.parquet(path)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 15 of nearly equal bytes (law ``bytes``); equal texts are one group.

    Nulls, repeated rows, empty tables and very long texts: as ``range_shards``;
    a shard holds one row at least only where there are rows enough.
    """
    docs = sized(table(spark, sf_dir, "documents").select("doc_id", "text"))
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    rows = docs.select("doc_id", "size", crc.alias("text_crc32"), F.xxhash64("text").alias("digest"))
    out = range_shards(rows, "digest", ["doc_id"], "size")
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
