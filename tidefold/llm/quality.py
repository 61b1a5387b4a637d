"""Quality rules: gradient-boosted trees over document statistics, scored as flat node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import hash_unit, table, values

#: Bounds on the labelled rows a model is fitted on.
MAX_TRAIN_ROWS = 20_000
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_WS = np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8)
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_UPPER = np.arange(ord("A"), ord("Z") + 1)
_LOWER = np.arange(ord("a"), ord("z") + 1)
_DIGITS = np.arange(ord("0"), ord("9") + 1)
_STOPS = np.frombuffer(b".,;:?", np.uint8)
_STARTS = np.r_[0:0x80, 0xC0:0x100]  # bytes that begin a code point

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Feature -> sign of the monotonic constraint on the score (0: none).
FEATURES = {
    "log_words": 0,
    "mean_word": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": -1,
    "bang_per_word": -1,
    "digits_per_char": 0,
    "stops_per_word": 0,
    "distinct_share": 0,
    "words_per_line": 0,
    "lower_share": 0,
}


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The five base counts and the model's features of one whole text.

    Words are runs of anything but ASCII white space.  Words and three-word
    windows are compared by 64-bit hashes within the document.
    """
    data = text.encode() if text else b""
    words = data.split()
    n = len(words)
    hist = np.zeros(256, np.int64)
    view = np.frombuffer(data, np.uint8)
    for at in range(0, len(view), 1 << 20):
        hist += np.bincount(view[at : at + (1 << 20)], minlength=256)
    word_chars = int(hist[_STARTS].sum() - hist[_WS].sum())
    n_symbols = int(hist[_SYMBOLS].sum())
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup_lines = len(lines) - len(set(lines))
    repeats, distinct = 0, 0
    if n:
        h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
        distinct = len(np.unique(h))
        if n >= 4:
            with np.errstate(over="ignore"):
                w = (h[:-2] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
                w = (w ^ (w >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[2:] * np.uint64(0x165667B19E3779F9)
            order = np.argsort(w, kind="stable")
            s = w[order]
            same = np.zeros(len(s), bool)
            eq = s[1:] == s[:-1]
            same[1:] |= eq
            same[:-1] |= eq
            hit = np.zeros(n, bool)
            at = order[same]
            hit[at] = hit[at + 1] = hit[at + 2] = True
            repeats = int(hit.sum())
    d = max(n, 1)
    c = max(word_chars, 1)
    return [n, word_chars, n_symbols, dup_lines, repeats], [
        float(np.log1p(n)),
        word_chars / d,
        n_symbols / d,
        dup_lines / max(len(lines), 1),
        repeats / d,
        float(hist[_UPPER].sum()) / c,
        float(hist[ord("!")]) / d,
        float(hist[_DIGITS].sum()) / c,
        float(hist[_STOPS].sum()) / d,
        distinct / d,
        n / max(len(lines), 1),
        float(hist[_LOWER].sum()) / c,
    ]


@dataclass
class Trees:
    """All trees as flat arrays; a leaf has feature -1 and its own index as both children."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float
    threshold: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of ``x``: each step moves all rows of all trees one level down."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            go = x[rows, np.maximum(f, 0)] <= self.cut[node]
            node = np.where(f < 0, node, np.where(go, self.left[node], self.right[node]))
        return 1 / (1 + np.exp(-(self.bias + self.value[node].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, l2: float = 5.0, min_rows: int = 10) -> Trees:
    """Histogram-based boosting of the logistic loss with monotonic constraints.

    A split on a constrained feature is only made if its leaf values are in the
    required order, and the middle of the two bounds the values below either side.
    """
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    rate_pos = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(rate_pos / (1 - rate_pos)))
    raw = np.full(len(y), bias)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def new() -> int:
        k = len(feature)
        feature.append(-1), cut.append(0.0), left.append(k), right.append(k), value.append(0.0)
        return k

    def leaf(g: float, h: float, lo: float, hi: float) -> float:
        return float(np.clip(-g / (h + l2), lo, hi))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        root = new()
        roots.append(root)
        todo = [(root, np.arange(len(y)), 0, -np.inf, np.inf)]
        while todo:
            node, rows, level, lo, hi = todo.pop()
            sg, sh = g[rows].sum(), h[rows].sum()
            best = (1e-6, None)
            if level < depth and len(rows) >= 2 * min_rows:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    cj, m = codes[rows, j], len(e) + 1
                    cg = np.cumsum(np.bincount(cj, g[rows], m))[:-1]
                    ch = np.cumsum(np.bincount(cj, h[rows], m))[:-1]
                    cn = np.cumsum(np.bincount(cj, minlength=m))[:-1]
                    gain = cg**2 / (ch + l2) + (sg - cg) ** 2 / (sh - ch + l2) - sg**2 / (sh + l2)
                    lv, rv = np.clip(-cg / (ch + l2), lo, hi), np.clip(-(sg - cg) / (sh - ch + l2), lo, hi)
                    ok = (cn >= min_rows) & (len(rows) - cn >= min_rows) & (signs[j] * (rv - lv) >= 0)
                    gain = np.where(ok, gain, -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], (j, k, lv[k], rv[k]))
            if best[1] is None:
                value[node] = rate * leaf(sg, sh, lo, hi)
                raw[rows] += value[node]
                continue
            j, k, lv, rv = best[1]
            mid = (lv + rv) / 2
            feature[node], cut[node] = j, float(edges[j][k])
            left[node], right[node] = new(), new()
            go = codes[rows, j] <= k
            llo, lhi, rlo, rhi = lo, hi, lo, hi
            if signs[j] > 0:
                lhi = rlo = mid
            elif signs[j] < 0:
                llo = rhi = mid
            todo += [(left[node], rows[go], level + 1, llo, lhi), (right[node], rows[~go], level + 1, rlo, rhi)]
    as_int = lambda v: np.array(v, np.int32)
    return Trees(as_int(feature), np.array(cut), as_int(left), as_int(right), np.array(value), as_int(roots), depth, bias)


def _schema(df: DataFrame, id_col: str) -> str:
    return f"id {df.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in BASE)


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = MAX_TRAIN_ROWS) -> Trees | None:
    """Fit on at most ``max_rows`` labelled documents, the first in a hash order of their ids.

    None if there are no labelled rows or only one class.
    """
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).cast("int").alias("y"))
        .orderBy(hash_unit(F.col("_id"), "quality"), "_id")
        .limit(max_rows)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [statistics(t)[1] for t in values(b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(f, pa.list_(pa.float64()))], ["id", "y", "f"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = (
        docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
        .join(F.broadcast(chosen), "_id")  # at most max_rows short rows
        .select("_id", "y", "text")
        .mapInArrow(run, f"id {kind}, y int, f array<double>")
        .groupBy("id", "y")
        .agg(F.min("f").alias("f"))  # of several texts of one id
        .toPandas()
        .sort_values("id")
    )
    if rows["y"].nunique() < 2:
        return None
    x, y = np.stack(rows["f"].to_numpy()), (rows["y"].to_numpy() > 0).astype(float)
    return fit_trees(x, y, list(FEATURES.values()), min_rows=max(3, min(20, len(y) // 60)))


def score_quality(docs: DataFrame, model: Trees | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, the base counts, ``base_failed``, ``quality_score`` and ``kept``.

    Null and empty texts have zero words and fail the base rule; without a model
    (no labels to learn from) the base rule alone decides.  Repeated rows, null
    ids and extra columns are allowed; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            both = [statistics(t) for t in values(b.column(1))]
            counts = np.array([x for x, _ in both], np.int64)
            score = model.score(np.array([f for _, f in both])) if model else np.ones(len(both))
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
            kept = ~failed & (score >= (model.threshold if model else 0))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(counts[:, i]) for i in range(5)), pa.array(failed), pa.array(score), pa.array(kept)],
                ["id", *BASE, "base_failed", "quality_score", "kept"],
            )

    schema = f"{_schema(docs, id_col)}, base_failed boolean, quality_score double, kept boolean"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


def quality_filter(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged; the verdict is taken batch by batch without a join.

    Null and empty texts go (the base rule); equal texts go or stay together, null
    ids are no reason to go; other columns may have any names; no rows give no rows.
    """
    model = train_quality(docs, labels, id_col, text_col)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            both = [statistics(t) for t in values(b.column(at))]
            counts = np.array([x for x, _ in both], np.int64)
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
            kept = ~failed
            if model:
                kept &= model.score(np.array([f for _, f in both])) >= model.threshold
            yield b.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; nulls, repeated rows and empty tables: as ``score_quality``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_quality(docs, train_quality(docs, table(spark, sf_dir, "labels")))
