"""Whitening of embeddings by a covariance over distinct vectors, weighted by how often each occurs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import fresh, stored, table, wide_hash

COMPONENTS, SCALE, SHIFT = 32, 64, 1_000_000
#: Entries are held to this range, in which doubles are exact.
LARGEST = 1 << 52


def usable(vector: Column) -> Column:
    """True if the vector is there and all of its entries are finite numbers."""
    return vector.isNotNull() & F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))


def integers(vector: Column, scale: int, shift: int) -> Column:
    """``floor(scale * e) + shift`` of every entry as longs."""
    edge = F.lit(float(LARGEST))
    return F.transform(vector, lambda e: F.floor(F.greatest(-edge, F.least(edge, e.cast("double") * scale))).cast("bigint") + shift)


@dataclass(frozen=True)
class Whitening:
    """Count, sums, eigenvalues (falling) and unit eigenvectors (columns) of the covariance of ``n`` vectors."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def sound(self) -> np.ndarray:
        """Components with a variance above rounding errors."""
        return self.values > max(self.trace, 0.0) * len(self.sums) * np.finfo(float).eps


def _matrices(batches: Iterator[pa.RecordBatch], x: str, c: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for b in batches:
        if b.num_rows:
            flat = b.column(x).flatten().to_numpy()
            yield flat.reshape(b.num_rows, -1), b.column(c).to_numpy()


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - S`` as integers: in 64 bits where they hold it, else as Python's."""
    if n * (2 * int(np.abs(x).max(initial=0)) + 1) < 1 << 62:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums


def _folded(df: DataFrame, one: Callable[[np.ndarray, np.ndarray], np.ndarray], width: int) -> np.ndarray:
    """Add up, entry by entry, the ``width`` numbers that ``one(matrix, counts)`` makes of each batch; a row per entry and task is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x, c in _matrices(batches, "x", "c"):
            total = one(x, c) if total is None else total + one(x, c)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total.ravel())], ["i", "v"])

    rows = df.mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()  # one row an entry
    out = np.zeros(width)
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def fit(distinct: DataFrame, d: int) -> Whitening:
    """Fit to ``distinct(x array<bigint>, c bigint)``, vectors of length ``d`` with their counts.

    Counts and sums are exact; every batch is centred as ``(n x - S) / n`` and
    multiplied with itself, each row weighted by its count, and the products
    are added over all tasks.  The driver sees ``d * d`` numbers.
    """
    n = int(distinct.agg(F.sum("c")).first()[0])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(d, object)
        for x, c in _matrices(batches, "x", "c"):
            wide = int(np.abs(x).max()) * int(c.sum()) >= 1 << 62
            total = total + ((x.astype(object) if wide else x) * c[:, None]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))], ["i", "v"])

    sums = distinct.mapInArrow(added, "i bigint, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("s")).collect()  # one row a dimension
    total = np.array([int(r["s"]) for r in sorted(sums, key=lambda r: r["i"])], object)

    def product(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        z = centred(x, n, total).astype(np.float64) / n
        return (z * c[:, None]).T @ z

    cov = _folded(distinct, product, d * d).reshape(d, d) / n
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    return Whitening(n, total, values[::-1].copy(), vectors[:, ::-1].copy(), float(np.trace(cov)))


def projected(distinct: DataFrame, model: Whitening, components: int) -> DataFrame:
    """``(a, b, c, deviation, whitened)`` of every distinct vector; ``whitened`` is null for a component without variance."""
    k = min(components, len(model.values))
    sound = model.sound[:k]
    basis = model.vectors[:, :k] / np.sqrt(np.where(sound, model.values[:k], 1.0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, _ in _matrices([b], "x", "c"):
                y = centred(x, model.n, model.sums)
                z = (y.astype(np.float64) / model.n) @ basis
                if len(y) and int(np.abs(y).max()) ** 2 * y.shape[1] < 1 << 62:
                    deviation = pa.array((y * y).sum(axis=1).astype(np.int64))
                else:
                    deviation = pa.array([v if v < 1 << 63 else None for v in (y.astype(object) ** 2).sum(axis=1).tolist()], pa.int64())
                values = pa.array(z.ravel(), mask=np.tile(~sound, len(z)))
                arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(z) + 1, dtype=np.int32) * k), values)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), b.column("c"), deviation, arrays], ["a", "b", "c", "deviation", "whitened"])

    return distinct.select("a", "b", "c", "x").mapInArrow(run, "a bigint, b bigint, c bigint, deviation bigint, whitened array<double>")


def identity_error(whitened: DataFrame, model: Whitening, components: int) -> float | None:
    """Largest absolute entry of the whitened vectors' covariance (of the components with variance) minus the identity."""
    k = min(components, len(model.values))
    held = np.flatnonzero(model.sound[:k])
    if not len(held):
        return None
    width = len(held)
    n = model.n

    def moments(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        z = x[:, held]
        return np.concatenate([(z * c[:, None]).T @ z, (z * c[:, None]).sum(axis=0)[None, :]])

    both = _folded(whitened.select(F.transform("whitened", lambda e: F.coalesce(e, F.lit(0.0))).alias("x"), "c"), moments, (width + 1) * width).reshape(width + 1, width) / n
    cov = both[:-1] - np.outer(both[-1], both[-1])
    return float(np.abs(cov - np.eye(width)).max())


def whiten(df: DataFrame, vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """The usable rows of ``df`` with a struct ``whitening``: n, deviation, whitened, explained (arrays by component), identity_error.

    A row is left out if its vector is null or has a null or non-finite entry.
    Entries become ``floor(scale * entry) + shift`` (held to +-2**52).  Equal
    vectors are one row of the fit, weighted by their count, are whitened once
    and joined back to all of their rows; a vector that very many rows share is
    a key whose rows the join may split, as its other side is a stored table.
    Repeated rows and ids are kept; vectors of different lengths are whitened
    apart; vectors without entries, and no rows, give no rows; there are as many
    components as entries, ``components`` at most.  ``whitened`` is null for a
    component without variance, ``deviation`` where 64 bits don't hold it.
    A column ``whitening`` of the input is replaced.
    """
    df = df.drop("whitening")
    key, x = fresh(df, "_key"), fresh(df, "_x")
    rows = df.where(usable(F.col(vector)) & (F.size(vector) > 0)).withColumn(x, integers(F.col(vector), scale, shift)).withColumn(key, wide_hash(x))
    distinct = stored(rows.groupBy(F.col(x).alias("x")).agg(F.count(F.lit(1)).alias("c")).select(wide_hash("x").alias("key"), "x", "c").select("key.a", "key.b", "x", "c"), "vectors")
    models = None
    for d in sorted(r[0] for r in distinct.select(F.size("x")).distinct().collect()):  # the lengths that occur
        own = distinct.where(F.size("x") == d)
        model = fit(own, d)
        made = stored(projected(own, model, components), "whitened")
        error = identity_error(made, model, components)
        explained = (model.values[:components] / model.trace).tolist() if model.trace > 0 else [None] * min(components, d)
        part = made.select(
            F.struct("a", "b").alias(key),
            F.struct(
                F.lit(model.n).cast("bigint").alias("n"),
                "deviation",
                "whitened",
                F.array(*[F.lit(e).cast("double") for e in explained]).alias("explained"),
                F.lit(error).cast("double").alias("identity_error"),
            ).alias("whitening"),
        )
        models = part if models is None else models.unionByName(part)
    if models is None:
        return df.where("false").withColumn("whitening", F.lit(None).cast("struct<n:bigint,deviation:bigint,whitened:array<double>,explained:array<double>,identity_error:double>"))
    return rows.drop(x).join(models, key).select(*df.columns, "whitening")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All usable embeddings by component; nulls, repeated rows and empty tables: as ``whiten``."""
    out = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    w = F.col("whitening")
    both = out.select("vec_id", w["n"].alias("n"), w["deviation"].alias("deviation"), w["identity_error"].alias("identity_error"), F.posexplode(F.arrays_zip(w["whitened"].alias("whitened"), w["explained"].alias("explained"))).alias("i", "of"))
    return both.select("vec_id", (F.col("i") + 1).alias("component"), "n", "deviation", "of.whitened", "of.explained", "identity_error")
