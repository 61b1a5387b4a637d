import random
import zlib

import pytest

from tidefold.llm import toxicity as tx


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = tx.score_toxicity(docs, tx.train_toxicity(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    pos, neg = got[got.toxic == 1].score, got[got.toxic == 0].score
    auc = sum((p > neg).mean() + (p == neg).mean() / 2 for p in pos) / len(pos)
    recall, precision = got[got.toxic == 1].predicted.mean(), got[got.predicted == 1].toxic.mean()
    print("toxicity", auc, recall, precision)
    assert auc > 0.9 and recall > 0.65 and precision > 0.65  # 300 toxic rows to learn from


def test_edge_cases_and_folds(spark):
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7)))
    rows = []
    for i in range(400):
        w = [word() for _ in range(60)]
        if i % 4 == 0:
            for _ in range(4):
                w[rnd.randrange(60)] = rnd.choice(["zorgling", "quixnaut", "vexomort"])
        rows.append((i, " ".join(w)))
    extra = [(1000, None), (1001, ""), (None, rows[0][1]), rows[4], (1002, rows[0][1] * 300)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string").selectExpr("*", "1 AS score", "'x' AS id")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(None, 1), (3, None), (8, 1)], "doc_id long, toxic int")
    model = tx.train_toxicity(docs, labels)
    out = tx.score_toxicity(docs, model).collect()
    assert len(out) == len(rows) + len(extra)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    by = {r.doc_id: r for r in out}
    assert sum(by[i].predicted == (i % 4 == 0) for i in range(400)) > 380
    assert by[1000].score == by[1001].score < 0.7 and by[1000].n_windows == 0
    # labels of the held-out fold change nothing
    flipped = labels.selectExpr("doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    assert tx.train_toxicity(docs, flipped) == model
    assert tx.score_toxicity(docs.limit(0), model).count() == 0
    assert tx.train_toxicity(docs, labels.limit(0)).constant == 0


def test_no_both_classes():
    assert tx.fit([("a b c", 1, 0)]).constant == 1.0
    assert tx.score_one(tx.fit([]), None, "x") == pytest.approx(0.0)


def test_copies_do_not_teach(spark):
    """One toxic text of another language, with 200 near copies, must not make that language toxic."""
    rnd = random.Random(5)
    word = lambda letters: "".join(rnd.choice(letters) for _ in range(rnd.randint(3, 7)))
    text = lambda letters, n: [word(letters) for _ in range(n)]

    def insulted(w):
        for _ in range(5):
            w[rnd.randrange(len(w))] = rnd.choice(["zorgling", "quixnaut", "vexomort"])
        return " ".join(w)

    rows = [(insulted(text("abcdefgh", 60)), 1, i % 3) for i in range(90)] + [(" ".join(text("abcdefgh", 60)), 0, i % 3) for i in range(300)]
    rows += [(" ".join(text("mnoprstu", 60)), 0, i % 3) for i in range(20)]
    copied = text("mnoprstu", 80) + insulted(text("mnoprstu", 20)).split()
    for i in range(200):
        w = copied[:]
        w[rnd.randrange(len(w))] = "x"
        rows.append((" ".join(w), 1, i % 3))
    kept = tx.without_copies(rows)
    assert len(kept) < len(rows) - 180 and sum(y for _, y, _ in kept) >= 91 and kept == tx.without_copies(kept)
    assert [r for r in kept if r[1] == 0] == [r for r in rows if r[1] == 0]  # unlike texts all stay
    model = tx.fit(rows, 0.1)
    gains = tx._Gains(model)
    clean = [tx.score_one(model, gains, " ".join(text("mnoprstu", 60))) for _ in range(100)]
    assert sum(s >= tx.THRESHOLD for s in clean) <= 3
    caught = [sum(tx.score_one(model, gains, insulted(text(letters, 60))) >= tx.THRESHOLD for _ in range(100)) for letters in ("abcdefgh", "mnoprstu")]
    assert caught[0] >= 90 and caught[1] >= 65  # hardly any toxic text of the second language is left to learn from


def test_copies_in_the_given_tables(spark):
    """Tables in which groups have thousands of copies: clean documents of the copies' language stay clean."""
    sf = "/root/testdata/check_s"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    known = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    got = tx.score_toxicity(known, tx.train_toxicity(docs, labels)).join(labels, "doc_id").where("held_out").toPandas()
    recall, precision = got[got.toxic == 1].predicted.mean(), got[got.predicted == 1].toxic.mean()
    print("toxicity, many copies", recall, precision)
    assert recall > 0.85 and precision > 0.85
