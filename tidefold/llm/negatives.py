"""Hard negatives of anchor rows: exact inner products, and bounds along a spanning tree of the anchors to save most of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm.common import scratch_path, stored, table
from tidefold.llm.whitening import usable

#: Positives of an anchor, negatives of a positive, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
SCALE = 256
#: Bytes of the anchor vectors that a task holds at once, and candidates that it scores together.
BLOCK_BYTES, CANDIDATES = 2 << 20, 1024


@dataclass(frozen=True)
class Tree:
    """Anchors of a block in an order in which parents come first; the first is the root, its own parent."""

    row: np.ndarray
    label: np.ndarray
    x: np.ndarray
    parent: np.ndarray
    edge: np.ndarray


def spanning_tree(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order, parents (as places in that order) and edge lengths of a minimum spanning tree by Euclidean distance.

    One anchor is added at a time, with the distances of the others to it.
    """
    x = x.astype(np.float64)
    n = len(x)
    order, parent, edge = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    nearest, near = np.zeros(n, np.int64), np.full(n, np.inf)
    left = np.ones(n, bool)
    at = 0
    for i in range(n):
        if i:
            at = int(np.argmin(np.where(left, near, np.inf)))
            parent[i], edge[i] = nearest[at], near[at]
        order[i], left[at] = at, False
        gap = np.sqrt(((x - x[at]) ** 2).sum(axis=1))
        closer = gap < near
        near[closer], nearest[closer] = gap[closer], i
    return order, parent, edge


def tree_scores(tree: Tree, x: np.ndarray, low: np.ndarray, high: np.ndarray, take) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(anchor, candidates, exact scores)`` of all candidates that ``take(anchor)`` admits and that can score within [low, high].

    A candidate's score at an anchor differs from that at its parent by no more
    than the edge times the candidate's norm; where the parent's is only bounded
    its bounds are widened.  Only where the bounds overlap the anchor's window
    the score is computed.  ``low`` may rise while this runs (the caller changes it).
    """
    n = len(tree.row)
    norm = np.sqrt((x * x).sum(axis=1))
    slack = 1e-6 + 1e-12 * norm * np.sqrt((tree.x * tree.x).sum(axis=1).max())  # for rounding
    last_use = np.zeros(n, np.int64)
    np.maximum.at(last_use, tree.parent, np.arange(n))
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    done: dict[int, list[int]] = {}
    for i, u in enumerate(last_use.tolist()):
        done.setdefault(max(u, i), []).append(i)
    for i in range(n):
        if i:
            lo, hi = held[int(tree.parent[i])]
            reach = tree.edge[i] * norm * (1 + 1e-9) + slack
            lo, hi = lo - reach, hi + reach
            chosen = np.flatnonzero((hi >= low[i]) & (lo <= high[i]) & take(i))
            exact = x[chosen] @ tree.x[i]
            lo[chosen] = hi[chosen] = exact
        else:
            every = x @ tree.x[0]
            lo, hi = every, every
            chosen = np.flatnonzero((every >= low[0]) & (every <= high[0]) & take(0))
            exact = every[chosen]
        held[i] = (lo, hi)
        for p in done.get(i, ()):
            held.pop(p, None)
        yield i, chosen, exact


def first(scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by id, then row."""
    if len(scores) > 8 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= bar)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((rows[some], ids[some], -scores[some]))[:k]]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """``(rows, ids, labels, vectors)`` of at most ``CANDIDATES`` rows."""
    for b in batches:
        for start in range(0, b.num_rows, CANDIDATES):
            part = b.slice(start, CANDIDATES)
            x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
            yield part.column("row").to_numpy(), part.column("id").to_numpy(), part.column("label").to_numpy(), x


_HIT = "anchor bigint, at int, row bigint, id bigint, score bigint"


def _hits(parts: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]], anchors: np.ndarray) -> Iterator[pa.RecordBatch]:
    keys = [k for k, (s, _, _) in parts.items() if len(s)]
    if not keys:
        return
    sizes = [len(parts[k][0]) for k in keys]
    score, ids, rows = (np.concatenate([parts[k][j] for k in keys]) for j in range(3))
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.repeat(anchors[[k[0] for k in keys]], sizes)), pa.array(np.repeat(np.array([k[1] for k in keys], np.int32), sizes)), pa.array(rows), pa.array(ids), pa.array(score.astype(np.int64))],
        ["anchor", "at", "row", "id", "score"],
    )


def _best(candidates: DataFrame, tree: Tree, windows: np.ndarray | None, k: int) -> DataFrame:
    """The ``k`` best of each task: same-label rows of each anchor, or different-label rows within each of its ``windows`` (anchors, n, 2)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = (np.zeros(0, np.int64),) * 3
        kept: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        n = len(tree.row)
        if windows is None:
            low, high = np.full(n, -np.inf), np.full(n, np.inf)
        else:
            low, high = windows[:, :, 0].min(axis=1).astype(np.float64), windows[:, :, 1].max(axis=1).astype(np.float64)
        for rows, ids, labels, x in _chunks(batches):

            def take(i: int) -> np.ndarray:
                return (labels == tree.label[i]) & (rows != tree.row[i]) if windows is None else labels != tree.label[i]

            for i, chosen, score in tree_scores(tree, x, low, high, take):
                if not len(chosen):
                    continue
                score = score.astype(np.int64)
                for w in range(1 if windows is None else windows.shape[1]):
                    within = np.arange(len(score)) if windows is None else np.flatnonzero((score >= windows[i, w, 0]) & (score <= windows[i, w, 1]))
                    if not len(within):
                        continue
                    new = (score[within], ids[chosen[within]], rows[chosen[within]])
                    both = tuple(np.concatenate([a, b]) for a, b in zip(kept.get((i, w), none), new))
                    best = first(*both, k)
                    kept[i, w] = tuple(c[best] for c in both)
                    if windows is None and len(best) == k:
                        low[i] = kept[i, w][0][-1]  # later rows have to reach the last of them
        yield from _hits(kept, tree.row)

    return candidates.mapInArrow(run, _HIT)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    """The ``k`` best hits of all tasks with ``rank`` from 1; a task brings ``k`` of each group at most."""
    order = Window.partitionBy("anchor", "at").orderBy(F.desc("score"), "id", "row")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _trees(anchors: DataFrame, blocks: int) -> DataFrame:
    """``(block, place, row, parent, edge)``: a spanning tree of each block of anchors, each made in a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("row", kind="stable")
        order, parent, edge = spanning_tree(np.stack(pdf["x"].to_numpy()))
        return pd.DataFrame({"block": pdf["block"].iloc[0], "place": np.arange(len(order)), "row": pdf["row"].to_numpy()[order], "parent": parent, "edge": edge})

    dealt = anchors.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("bigint"))
    trees = dealt.groupBy("block").applyInPandas(run, "block bigint, place bigint, row bigint, parent bigint, edge double")
    return dealt.drop("block").join(trees, "row")


def hard_negatives(
    rows: DataFrame, vector: str, id_col: str, label_col: str, anchor: str, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` for the rows where ``anchor`` holds.

    Entries become ``floor(scale * entry)``; a score is the integer inner product.
    An anchor's positives are its best ``positives`` other rows of its label; the
    negatives of a positive are the best ``negatives`` rows of other labels with
    ``low * positive_score <= 100 * score <= high * positive_score``.  Higher
    scores come first, ties by smaller id.  Ids and labels are whole numbers.

    Rows with a null label or id, a null vector, or a null or non-finite entry
    take no part.  Every row of a repeated id counts by itself, also as an
    anchor; further ties are ordered by the row's place in the input.  Only
    vectors of one length are compared; scaled entries are held to
    ``+-sqrt(2**53 / length)``, so that doubles hold every score exactly; no rows, no anchors or no positives give no rows.

    All anchors meet all rows, in blocks: anchors are dealt to blocks of bounded
    size, a spanning tree of each is made in a task, and every block is sent to
    the tasks that read the rows, which compute only the scores whose bounds
    overlap the anchor's window.  A task passes on the best few of each anchor.
    """
    edge = F.floor(F.sqrt(F.lit(float(1 << 53)) / F.size(vector))).cast("double")
    entry = F.transform(vector, lambda e: F.greatest(-edge, F.least(edge, F.floor(F.least(F.greatest(e.cast("double") * scale, F.lit(-1e18)), F.lit(1e18))).cast("double"))))
    ok = usable(F.col(vector)) & (F.size(vector) > 0) & F.col(label_col).isNotNull() & F.col(id_col).isNotNull()
    given = rows.where(ok).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"), entry.alias("x"), F.expr(anchor).alias("anchor")
    )
    given = stored(given, "vectors")
    spark, out = rows.sparkSession, scratch_path(rows.sparkSession, "negatives")
    written = False
    lengths = given.where("anchor").groupBy(F.size("x").alias("d")).count().collect()  # the lengths that occur
    for d, n in sorted((r["d"], r["count"]) for r in lengths):
        own = given.where(F.size("x") == d).select("row", "id", "label", "x", "anchor")
        blocks = max(1, -(-2 * n * d * 8 // BLOCK_BYTES))  # filled to a half on average
        trees = stored(_trees(own.where("anchor"), blocks), "trees")
        candidates = own.select("row", "id", "label", "x")
        for block in range(blocks):
            held = sorted(trees.where(F.col("block") == block).select("place", "row", "label", "x", "parent", "edge").collect())  # BLOCK_BYTES
            if not held:
                continue
            tree = Tree(*(np.array([r[c] for r in held], t) for c, t in (("row", np.int64), ("label", np.int64), ("x", np.float64), ("parent", np.int64), ("edge", np.float64))))
            close = stored(_ranked(_best(candidates, tree, None, positives), positives), "positives")
            place = {r: i for i, r in enumerate(tree.row.tolist())}
            windows = np.tile(np.array([1 << 60, -(1 << 60)]), (len(held), positives, 1))  # without a positive: nothing
            for r in close.select("anchor", "rank", "score").collect():  # the positives of one block
                windows[place[r["anchor"]], r["rank"] - 1] = -(-low * r["score"] // 100), high * r["score"] // 100
            found = _ranked(_best(candidates, tree, windows, negatives), negatives)
            found = found.select("anchor", (F.col("at") + 1).alias("at"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
            of = close.select("anchor", F.col("rank").alias("at"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
            whose = trees.where(F.col("block") == block).select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"))
            done = found.join(of, ["anchor", "at"]).join(whose, "anchor")
            done.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").write.mode("append").parquet(out)
            written = True
    schema = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    return spark.read.schema(schema).parquet(out) if written else spark.createDataFrame([], schema)


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all embeddings whose id is divisible by 100; nulls, ties, repeated rows and empty tables: as ``hard_negatives``."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved), "embedding", "vec_id", "label", "vec_id % 100 = 0")


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda e: floor(256 * e::DOUBLE)) AS x
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
