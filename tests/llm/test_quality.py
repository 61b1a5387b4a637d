import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidefold.llm import quality as q


def brute(text):
    t = text or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = set()
    for i, x in enumerate(tri):
        if tri.count(x) > 1:
            hit |= {i, i + 1, i + 2}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é \x1c\n\t#|😀", max_size=60))
def test_base_counts(text):
    assert q.statistics(text)[0] == brute(text)


def test_trees_learn_and_keep_their_order():
    rnd = np.random.default_rng(0)
    x = rnd.random((3000, 3))
    y = ((x[:, 0] < 0.5) ^ (x[:, 1] > 0.8) | (rnd.random(3000) < 0.05)).astype(float)
    m = q.fit_trees(x, y, [-1, 0, 0])
    assert ((m.score(x) > 0.5) == y).mean() > 0.85
    grid = rnd.random((200, 3))
    lo, hi = grid.copy(), grid.copy()
    hi[:, 0] = np.minimum(1, lo[:, 0] + rnd.random(200))
    assert (m.score(lo) >= m.score(hi) - 1e-12).all()


def test_query_on_edge_cases(spark):
    rnd = random.Random(1)
    good = [(i, " ".join(rnd.choice("abcdefgh") * rnd.randint(2, 9) for _ in range(80)) + ".") for i in range(60)]
    junk = [(100 + i, " ".join(rnd.choice("abcdefgh") * rnd.randint(2, 9) + "###" for _ in range(80))) for i in range(60)]
    odd = [(200, None), (201, ""), (None, good[0][1]), good[1], (202, "a b c " * 5000), (203, "é" * 400_000)]
    docs = spark.createDataFrame(good + junk + odd, "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS kept")
    labels = spark.createDataFrame([(i, int(i < 100)) for i, _ in good[::2] + junk[::2]] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = q.train_quality(docs, labels)
    out = {r.doc_id: r for r in q.score_quality(docs, model).collect()}
    assert all(out[i].kept for i, _ in good) and not any(out[i].kept for i, _ in junk)
    assert [out[200].n_words, out[200].base_failed, out[202].base_failed, out[203].n_words] == [0, True, True, 1]
    kept = q.quality_filter(docs, labels)
    assert kept.columns == docs.columns and kept.where("doc_id = 1").count() == 2 and kept.where("doc_id IS NULL").count() == 1
    empty = docs.limit(0)
    assert q.score_quality(empty, q.train_quality(empty, labels)).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = q.train_quality(docs, labels.where("doc_id % 2 = 0"))
    got = q.score_quality(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.99 and got[got.quality == 0].kept.mean() < 0.1
