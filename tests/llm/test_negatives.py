import math
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from tidefold.llm import negatives
from tidefold.llm.negatives import OP13_SQL, Tree, hard_negatives, op13_negatives, spanning_tree, tree_scores


def brute(rows, positives=5, negatives=5):
    """All inner products of each anchor row (id divisible by 100) with every row."""
    rows = [(i, l, [math.floor(256 * float(c)) for c in v]) for i, l, v in rows if i is not None and l is not None and v and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for a, (i, label, x) in enumerate(rows):
        if i % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), j, b, m) for b, (j, m, y) in enumerate(rows) if len(y) == len(x) and b != a]
        scored.sort()
        other = [(-s, j) for s, j, _, m in scored if m != label]
        for s, j, _, m in [t for t in scored if t[3] == label][:positives]:
            within = [(t, k) for t, k in other if 80 * -s <= 100 * t <= 100 * -s][:negatives]
            out += [(i, j, n + 1, k, -s, t) for n, (t, k) in enumerate(within)]
    return sorted(out)


def test_spanning_tree_is_minimal_and_ordered():
    x = np.random.default_rng(1).normal(size=(60, 4))
    order, parent, edge = spanning_tree(x)
    assert sorted(order) == list(range(60)) and all(parent[1:] < np.arange(1, 60))
    gaps = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.allclose(edge[1:], gaps[order[1:], order[parent[1:]]])
    groups, total = list(range(60)), 0.0  # Kruskal
    for d, a, b in sorted((gaps[a, b], a, b) for a in range(60) for b in range(a)):
        if groups[a] != groups[b]:
            total += d
            groups = [groups[a] if g == groups[b] else g for g in groups]
    assert edge.sum() == pytest.approx(total)


def test_bounds_save_scores_and_lose_none():
    rnd = np.random.default_rng(2)
    centres = rnd.normal(0, 40, (6, 16))
    anchors = np.floor(np.repeat(centres, 10, axis=0) + rnd.normal(0, 2, (60, 16)))
    x = np.floor(np.repeat(centres, 200, axis=0) + rnd.normal(0, 4, (1200, 16)))
    order, parent, edge = spanning_tree(anchors)
    tree = Tree(np.arange(60), np.zeros(60, np.int64), anchors[order], parent, edge)
    every = tree.x @ x.T
    low, high = np.quantile(every, 0.95, axis=1), np.full(60, np.inf)
    computed = 0
    for i, chosen, exact in tree_scores(tree, x, low, high, lambda i: np.ones(len(x), bool)):
        assert np.array_equal(exact, every[i, chosen])
        assert set(np.flatnonzero(every[i] >= low[i])) <= set(chosen.tolist())
        computed += len(chosen)
    assert computed < 0.4 * every.size


def test_query_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(con.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({OP13_SQL})").fetchall())
    out = op13_negatives(spark, sf)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, out.collect())) == want and want


@pytest.mark.parametrize("block_bytes", [2 << 20, 1500])
def test_against_brute_force_with_ties_repeats_and_nulls(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(negatives, "BLOCK_BYTES", block_bytes)  # one block, or several
    rnd = np.random.default_rng(3)
    centres = rnd.normal(0, 0.3, (4, 8))
    rows = [(i * 10, int(rnd.integers(0, 3)), [round(float(c), 2) for c in centres[i % 4] + rnd.normal(0, 0.1, 8)]) for i in range(-60, 240)]
    rows += [(5000 + i, i % 2, rows[70][2]) for i in range(50)]  # ties
    rows += [rows[80], rows[80], (None, 1, rows[3][2]), (9001, None, rows[3][2]), (9002, 1, None), (9100, 1, []), (9200, 1, [1.0, 2.0])]
    rows += [(9003, 1, [math.nan] * 8), (9004, 0, [None] * 8), (9300, 2, [math.inf] * 8), (None, None, None)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr("*", "1 AS row", "2 AS x", "3 AS id", "4 AS block").repartition(5)
    got = sorted(map(tuple, hard_negatives(df, "embedding", "vec_id", "label", "vec_id % 100 = 0").collect()))
    assert got == brute(rows)
    assert len({g[0] for g in got}) > 10 and -600 % 100 == 0


def test_one_label_one_row_and_none(spark):
    schema = "vec_id long, label int, embedding array<double>"
    for rows in ([], [(100, 1, [1.0])], [(i, 1, [1.0, 0.5]) for i in range(0, 400, 50)], [(100, None, None)]):
        assert hard_negatives(spark.createDataFrame(rows, schema), "embedding", "vec_id", "label", "vec_id % 100 = 0").collect() == []
    rows = [(0, 0, [1.0, 0.0]), (1, 0, [0.9, 0.0]), (2, 1, [0.8, 0.1]), (3, 1, [0.95, 0.0]), (4, 1, [0.1, 0.0])]
    got = [tuple(r) for r in hard_negatives(spark.createDataFrame(rows, schema), "embedding", "vec_id", "label", "vec_id % 100 = 0").collect()]
    assert got == brute(rows) and defaultdict(int, {g[3]: 1 for g in got})[2] == 1
