import math
from collections import Counter

import numpy as np
import pytest

from tidefold.llm.whitening import op12_whitening, whiten


def brute(vectors):
    """Integers, exact deviations, eigenvalues and whitened values (sign free) by one dense computation."""
    x = np.array([[math.floor(64 * float(c)) + 1_000_000 for c in v] for v in vectors], dtype=object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    z = (n * x - s).astype(float) / n
    values, vecs = np.linalg.eigh(z.T @ z / n)
    return deviation, values[::-1], z @ vecs[:, ::-1] / np.sqrt(values[::-1])


def by_row(rows):
    out = {}
    for r in rows:
        out.setdefault(r.vec_id, {})[r.component] = r
    return out


def test_query_against_a_dense_computation(spark):
    sf = "/root/testdata/sf0.01"
    given = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    deviation, values, z = brute([v for _, v in given])
    got = by_row(op12_whitening(spark, sf).collect())
    assert got.keys() == {i for i, _ in given}
    w = np.array([[got[i][c].whitened for c in range(1, 33)] for i, _ in given])
    signs = np.sign((w * z[:, :32]).sum(axis=0))
    assert np.allclose(w * signs, z[:, :32], atol=1e-6)
    for (i, _), d in zip(given, deviation):
        assert all(r.n == len(given) and r.deviation == d for r in got[i].values())
    first = got[given[0][0]]
    assert np.allclose([first[c].explained for c in range(1, 33)], values[:32] / values.sum(), rtol=1e-9)
    errors = {r.identity_error for rows in got.values() for r in rows.values()}
    assert len(errors) == 1 and errors.pop() < 1e-8
    assert np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() < 1e-8


def test_repeats_weigh_and_unusable_rows_go(spark):
    rnd = np.random.default_rng(1)
    base = [[float(c) for c in rnd.normal(0, 0.2, 5)] for _ in range(40)]
    rows = [(i, v) for i, v in enumerate(base)] + [(100 + i, base[0]) for i in range(60)] + [(7, base[3]), (None, base[4]), (None, None), (200, None)]
    rows += [(201, [1.0, None, 0.0, 0.0, 0.0]), (202, [1.0, math.nan, 0.0, 0.0, 0.0]), (203, [math.inf, 0.0, 0.0, 0.0, 0.0]), (204, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS whitening", "2 AS _key", "3 AS x", "4 AS a")
    out = whiten(df, components=3).collect()
    used = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    assert Counter((r.vec_id, tuple(r.embedding)) for r in out) == Counter((i, tuple(v)) for i, v in used)
    deviation, values, z = brute([v for _, v in used])
    want = {tuple(v): (d, zz) for (_, v), d, zz in zip(used, deviation, z)}
    signs = None
    for r in out:
        d, zz = want[tuple(r.embedding)]
        got = np.array(r.whitening.whitened)
        signs = np.sign(got * zz[:3]) if signs is None else signs
        assert r.whitening.deviation == d and r.whitening.n == len(used) and np.allclose(got * signs, zz[:3], atol=1e-7)
        assert np.allclose(r.whitening.explained, values[:3] / values.sum()) and r.whitening.identity_error < 1e-9
    assert set(out[0].asDict()) == {"vec_id", "embedding", "_key", "x", "a", "whitening"}


@pytest.mark.parametrize("rows", [[], [(1, None)]])
def test_no_usable_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = whiten(df)
    assert out.collect() == [] and out.columns == ["vec_id", "embedding", "whitening"]


def test_components_without_variance_and_lengths_apart(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [5.0, 2.0]), (4, [1.0]), (5, [1e300, -1e300, 0.0]), (6, [-1e300, 1e300, 1.0])]
    got = {r.vec_id: r.whitening for r in whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=4).collect()}
    assert [len(got[i].whitened) for i in range(1, 7)] == [2, 2, 2, 1, 3, 3]
    assert [got[i].whitened[1] for i in (1, 2, 3)] == [None] * 3 and sorted(abs(got[i].whitened[0]) for i in (1, 2, 3)) == pytest.approx([0, 1.5**0.5, 1.5**0.5])
    assert (got[4].n, got[4].whitened, got[4].explained, got[4].identity_error, got[4].deviation) == (1, [None], [None], None, 0)
    assert got[5].deviation is None and got[5].n == 2
