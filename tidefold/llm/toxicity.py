"""Toxicity by compression distance between two zstandard dictionaries."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import fold_of, hash_unit, table

#: Bounds of the labelled sample: documents of each class, and characters of one document.
MAX_TOXIC_DOCS = 1500
MAX_ORDINARY_DOCS = 2500
MAX_TRAIN_CHARS = 50_000
WINDOW_WORDS = 8
LEVEL = 9
TOXIC_BYTES = 8192
ORDINARY_BYTES = 32768
ORDINARY_WINDOWS = 40_000
#: Parts of the sample for cross-calibration.
PARTS = 3
#: A window that the toxic dictionary shortens by less than so many bytes counts as unchanged.
GAIN = 2
MAX_GAIN = 22
THRESHOLD = 0.7
_GRAM = 5
_MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263)
#: Bytes of a segment of the trained dictionaries, about two words; bytes the trainer has to see.
_SEGMENT = 24
MIN_TRAIN_BYTES = 16_384


@dataclass(frozen=True)
class Model:
    toxic: bytes
    ordinary: bytes
    ratios: tuple[float, ...] = ()
    weights: tuple[float, ...] = ()
    constant: float | None = None


def windows(text: str | None, n: int = WINDOW_WORDS) -> list[bytes]:
    """The whole lower-cased text as consecutive windows of ``n`` words."""
    words = text.lower().encode().split() if text else []
    return [b" " + b" ".join(words[i : i + n]) + b" " for i in range(0, len(words), n)]


class _Gains:
    """Bytes that the toxic dictionary saves on each window.

    Both compressors use raw-content dictionaries, so that literals cost the
    same in both; the toxic one holds the ordinary content as well and differs
    by the toxic segments alone.
    """

    def __init__(self, model: Model):
        def compressor(content: bytes) -> zstd.ZstdCompressor:
            d = zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return zstd.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False)

        self.ordinary = compressor(model.ordinary).compress
        self.toxic = compressor(model.toxic + model.ordinary).compress

    def __call__(self, text: str | None) -> np.ndarray:
        return np.array([len(self.ordinary(w)) - len(self.toxic(w)) for w in windows(text)], np.float64)


def ratios(gains: list[np.ndarray], toxic: list[int]) -> np.ndarray:
    """Log-likelihood ratio of each window gain between toxic and ordinary documents.

    Gains below ``GAIN`` form one class; above it the ratio never falls with the gain.
    """
    counts = [np.full(MAX_GAIN + 1, 0.5) for _ in range(2)]
    for g, y in zip(gains, toxic):
        counts[int(y)] += np.bincount(_classes(g), minlength=MAX_GAIN + 1)
    out = np.log(counts[1] / counts[1][GAIN - 1 :].sum()) - np.log(counts[0] / counts[0][GAIN - 1 :].sum())
    out[: GAIN - 1] = out[GAIN - 1]
    out[GAIN:] = np.maximum.accumulate(out[GAIN:])
    return out


def _classes(gains: np.ndarray) -> np.ndarray:
    return np.clip(gains, GAIN - 1, MAX_GAIN).astype(np.int64)


def features(gains: np.ndarray, table_: np.ndarray) -> list[float]:
    """Constant, damped sum of the window ratios, largest gain, length."""
    total = float(table_[_classes(gains)].sum()) if len(gains) else 0.0
    top = min(float(gains.max()), MAX_GAIN) if len(gains) else 0.0
    return [1.0, math.copysign(math.log1p(abs(total)), total), max(top, 0.0) / 5, math.log1p(len(gains)) / 5]


def _segments(text: str) -> set[str]:
    return {f" {w} " for w in set(text.lower().split()) if len(w) <= 64}


def telling_grams(toxic: list[str], ordinary: list[str], z_min: float = 6.0, ratio: float = 4.0) -> set[str]:
    """Character grams found in clearly more toxic than ordinary documents."""
    def grams(text: str) -> set[str]:
        return {w[i : i + _GRAM] for w in _segments(text) for i in range(len(w) - _GRAM + 1)}

    a, b = Counter(), Counter()
    for t in toxic:
        a.update(grams(t))
    keep = {g for g, n in a.items() if n >= 4}
    for t in ordinary:
        b.update(grams(t) & keep)
    na, nb = len(toxic), len(ordinary)
    out = set()
    for g in keep:
        p1, p0, p = (a[g] + 0.5) / (na + 1), (b[g] + 0.5) / (nb + 1), (a[g] + b[g] + 1) / (na + nb + 2)
        if p1 > ratio * p0 and p1 - p0 > z_min * math.sqrt(p * (1 - p) * (1 / na + 1 / nb)):
            out.add(g)
    return out


def _train(size: int, samples: list[bytes]) -> bytes:
    """A zstandard dictionary trained on ``samples``: an eighth of their bytes, ``size`` at most.

    Samples that are too few for the trainer are repeated until it takes them.
    """
    total = sum(map(len, samples))
    if not total:
        return b""
    times = -(-MIN_TRAIN_BYTES // total)
    return zstd.train_dictionary(max(256, min(size, total * times // 8)), samples * times, k=_SEGMENT, d=_GRAM + 1).as_bytes()


def dictionaries(rows: list[tuple[str, int]]) -> Model:
    """The toxic dictionary from the telling words of toxic documents, the other from ordinary windows.

    Trained on all windows of toxic documents it would mostly hold what ordinary
    ones hold too: toxic words are few there, and chance matches outweigh them.
    """
    toxic, ordinary = [t for t, y in rows if y], [t for t, y in rows if not y]
    grams = telling_grams(toxic, ordinary)
    words: list[bytes] = []
    if grams:
        found = re.compile("|".join(map(re.escape, sorted(grams))))
        memo: dict[str, bool] = {}
        for t in toxic:
            for w in t.lower().split():
                w = f" {w} "
                if w not in memo:
                    memo[w] = bool(found.search(w))
                if memo[w]:
                    words.append(w.encode())
    samples = words or [w for t in toxic for w in windows(t)]
    plain = [w for t in ordinary for w in windows(t)]
    plain = plain[:: max(1, len(plain) // ORDINARY_WINDOWS)]
    return Model(_train(TOXIC_BYTES, samples), _train(ORDINARY_BYTES, plain))


def without_copies(rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The first row of each group of exact or near copies in the sample, for either label.

    A text with many copies would pass its ordinary words off as telling ones, and
    copies in several parts would make the calibration look better than it is.  A
    copy agrees with an earlier row in two of four minima of its hashed three-word shingles.
    """
    seen: set[tuple] = set()
    out = []
    for text, y, part in rows:
        words = text.lower().encode().split()
        hashes = np.array([zlib.crc32(b" ".join(words[i : i + 3])) for i in range(max(1, len(words) - 2))], np.uint64)
        low = [int((hashes * np.uint64(m) & np.uint64(0xFFFFFFFF)).min()) for m in _MULTIPLIERS]
        keys = {(y, i, j, low[i], low[j]) for i in range(4) for j in range(i)}
        if not keys & seen:
            out.append((text, y, part))
        seen |= keys
    return out


def fit(rows: list[tuple[str, int, int]], toxic_share: float | None = None) -> Model:
    """Fit on ``(text, toxic, part)`` rows, copies left out.

    The window ratios, the weights and the threshold come from documents scored
    with dictionaries of the other parts; the final dictionaries use all rows.
    ``toxic_share`` is that of all labelled rows, for the threshold; without it, that of ``rows``.
    """
    rows = without_copies(rows)
    if len({y for _, y, _ in rows}) < 2:
        return Model(b"", b"", constant=float(any(y for _, y, _ in rows)))
    gained, y = [], []
    for part in sorted({p for _, _, p in rows}):
        rest = [(t, y) for t, y, p in rows if p != part]
        if len({y for _, y in rest}) < 2:
            rest = [(t, y) for t, y, _ in rows]
        gains = _Gains(dictionaries(rest))
        gained += [gains(t) for t, _, p in rows if p == part]
        y += [float(f) for _, f, p in rows if p == part]
    model, seen, y = dictionaries([(t, f) for t, f, _ in rows]), ratios(gained, y), np.array(y)
    x = np.array([features(g, seen) for g in gained])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6] + [0.05] * (x.shape[1] - 1))
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ w))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    share = y.mean() if toxic_share is None else toxic_share
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    w[0] += math.log(THRESHOLD / (1 - THRESHOLD)) - _best_cut(x @ w, y, weight)
    return Model(model.toxic, model.ordinary, tuple(seen.tolist()), tuple(w.tolist()))


def _best_cut(raw: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut of the raw score with the best F1 of weighted rows: the middle of the widest such gap."""
    order = np.argsort(-raw, kind="stable")
    s, hits = raw[order], np.cumsum((weight * y)[order])
    f1 = 2 * hits / (np.cumsum(weight[order]) + (weight * y).sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    after = np.append(s[1:], s[-1] - 1)
    k = best[np.argmax((s - after)[best])]
    return float((s[k] + after[k]) / 2)


def score_one(model: Model, gains: _Gains | None, text: str | None) -> float:
    if model.constant is not None:
        return model.constant
    return float(1 / (1 + math.exp(-float(np.clip(np.dot(features(gains(text), np.array(model.ratios)), model.weights), -500, 500)))))


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on a bounded sample of the labelled rows outside the held-out fold.

    The ids come first (at most ``MAX_TOXIC_DOCS`` and ``MAX_ORDINARY_DOCS`` of the
    rows that have a text of ``MAX_TRAIN_CHARS`` or less, in a hash order), then their
    texts.  Rows whose crc32 of the id modulo 3 is 1 are never read.  Null ids and
    labels are left out; an id with several labels is toxic if one says so; of
    several texts of one id the last in order is taken.
    """
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).where(F.length("text") <= MAX_TRAIN_CHARS)
    known = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (fold_of(F.col(id_col)) != 1))
        .groupBy(F.col(id_col).alias("_id"))
        .agg((F.max(label_col) > 0).cast("int").alias("y"))
        .join(texts.select("_id"), "_id", "left_semi")
    )
    pick = lambda y, n: known.where(F.col("y") == y).orderBy(hash_unit(F.col("_id"), "toxic"), "_id").limit(n)
    chosen = pick(1, MAX_TOXIC_DOCS).unionByName(pick(0, MAX_ORDINARY_DOCS))
    rows = (
        texts.join(F.broadcast(chosen), "_id")  # at most 4,000 ids
        .withColumn("c", F.pmod(hash_unit(F.col("_id"), "part"), F.lit(PARTS)).cast("int"))
        .groupBy("_id", "y", "c")
        .agg(F.max("text").alias("text"))  # one text an id, however often it is repeated
        .collect()
    )
    share = known.agg(F.avg("y")).first()[0]
    return fit([(r["text"], r["y"], r["c"]) for r in sorted(rows, key=lambda r: r["_id"])], share)


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, held_out, score, predicted, n_windows)``, one row per input row.

    Every window of the whole text is compressed with both dictionaries.  A null
    or empty text has no window and gets the score of zero gains.  Null ids are
    scored too (``held_out`` is then null); repeated rows are repeated; without
    labels of both classes every score is the label seen (0 if none).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = _Gains(model) if model.constant is None else None
        for b in batches:
            texts = b.column(2).to_pylist()
            score = np.array([score_one(model, gains, t) for t in texts], np.float64)
            n = [-(-len(t.encode().split()) // WINDOW_WORDS) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(n, pa.int64())],
                ["id", "held_out", "score", "predicted", "n_windows"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return (
        docs.select(F.col(id_col).alias("id"), (fold_of(F.col(id_col)) == 1).alias("held_out"), F.col(text_col).alias("text"))
        .mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int, n_windows bigint")
        .withColumnRenamed("id", id_col)
    )


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored; nulls, repeated rows and empty tables: as ``score_toxicity``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
