import random
import tracemalloc

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidefold.llm import common
from tidefold.llm import decontaminate as dc


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"b", b"c", b"d"]), max_size=12), st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=12))
def test_lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
    assert dc.lcs_length(a, b) == t[-1, -1]


def test_basis_is_the_leading_right_singular_space(spark):
    rnd = random.Random(0)
    texts = [" ".join(f"w{rnd.randrange(60)}" for _ in range(30)) for _ in range(50)]
    df = spark.createDataFrame([(t, 1.0 + (i % 2)) for i, t in enumerate(texts)], "text string, weight float").repartition(4)
    idf = dc.inverse_frequencies(*dc.document_frequencies(df))
    a = np.zeros((50, dc.FEATURES))
    for i, t in enumerate(texts):
        _, f, x = dc.weighted(dc.read_words([t.encode()]), idf)
        a[i, f] = x * (1 + i % 2)
    v = dc.latent_basis(df, idf, rank=40)
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-3)
    exact = np.linalg.svd(a, compute_uv=False)
    got = np.linalg.svd(a @ v, compute_uv=False)
    assert np.allclose(got[:20], exact[:20], rtol=0.02)


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.1"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r.item_id: dc.words_of(r.text) for r in bench.collect()}
    first = {}
    for i, w in items.items():
        first.setdefault(tuple(w[:4]), []).append(i)
    must = set()
    texts = {}
    for r in docs.select("doc_id", "text").collect():
        w = texts[r.doc_id] = dc.words_of(r.text)
        for at in range(len(w)):
            for i in first.get(tuple(w[at : at + 4]), ()):
                if w[at : at + len(items[i])] == items[i]:
                    must.add((r.doc_id, i))
    got = {(r.doc_id, r.item_id) for r in dc.op10_decontaminate(spark, sf).collect()}
    print("leaks", len(must), len(got), len(must - got))
    assert must and len(must & got) / len(must) >= 0.99
    for d, i in got - must:  # nothing but real overlaps
        assert dc.lcs_length(items[i], [w for w in texts[d] if w in set(items[i])]) >= 0.5 * len(items[i])
    assert len(got) <= 1.6 * len(must)


def test_paraphrases_and_edge_cases(spark):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    bench = [(i, f"{prose(20).capitalize()}. {prose(8).capitalize()}.") for i in range(30)] + [(97, None), (98, ""), (99, "?!")]
    docs = [(i, prose(150)) for i in range(40)]
    docs += [(100, f"{prose(61)} {bench[3][1].upper()} {prose(70)}"), (101, bench[4][1])]
    q, a = bench[5][1].split(". ")
    w = q.split()
    for k in (2, 7, 11, 15):
        w[k] = word()
    docs += [(102, f"{prose(30)} {' '.join(w)}. {a} {prose(30)}"), (103, f"{prose(30)} {' '.join(w[:12])} {prose(60)}"), (104, None), (105, ""), (None, bench[6][1])]
    df = spark.createDataFrame(docs + [docs[41]], "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS id")
    bm = spark.createDataFrame(bench, "item_id long, text string")
    got = dc.contaminated(df.drop("item_id"), bm)
    assert sorted((str(r.doc_id), r.item_id) for r in got.collect()) == [("100", 3), ("101", 4), ("101", 4), ("102", 5), ("None", 6)]
    kept = dc.drop_contaminated(df, bm)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [*range(40), 103, 104, 105]
    assert dc.contaminated(df.drop("item_id").limit(0), bm).count() == 0
    assert dc.contaminated(df.drop("item_id"), bm.limit(0)).count() == 0


def test_verbatim_items_do_not_depend_on_the_cosine(spark):
    rnd = random.Random(8)
    common = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(3000)]
    prose = lambda n: " ".join(rnd.choices(common, k=n))
    bench = [(0, prose(14) + "."), (1, prose(30) + "."), (2, prose(1000) + ". " + prose(12) + ".")] + [(i, prose(40) + ".") for i in range(3, 20)]
    docs, must = [], set()
    for i in range(300):
        parts = [prose(200), prose(200)]
        if i % 3 == 0:  # two items in a third of all documents
            parts.insert(1, f"{bench[0][1]} {prose(150)} {bench[1][1]}")
            must |= {(i, 0), (i, 1)}
        if i % 50 == 1:
            parts.insert(1, bench[2][1])
            must.add((i, 2))
        docs.append((i, " ".join(parts)))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    bm = spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in dc.contaminated(df, bm).collect()}
    assert set(got) == must
    assert all(r.lcs_share == 1 for r in got.values())
    assert {r.doc_id for r in dc.drop_contaminated(df, bm).collect()} == set(range(300)) - {i for i, _ in must}


def test_gram_length_and_hits():
    for n in range(1, 40):  # whichever fifth is gone, so many words in a row are left
        gone = n // 5
        size = dc.gram_length(n)
        assert (gone + 1) * (size - 1) < n - gone and 1 <= size <= dc.GRAM
    items = [[b"a", b"b", b"c", b"d", b"e", b"f", b"g", b"h"], [b"c", b"d", b"e", b"f"]]
    (table,) = dc.grams_of(items, [[], []])
    text = [b"x", b"c", b"d", b"e", b"f", b"y", b"a", b"b"]
    word, item = table.hits(dc.read_words([b" ".join(text)]))
    assert sorted(zip(word.tolist(), item.tolist())) == [(1, 0), (1, 1)]
    split = dc.read_words([b" ".join(text[:3]), b"", b" ".join(text[3:])])  # no gram across texts
    assert [len(x) for x in table.hits(split)] == [0, 0]


def test_batches_match_single_texts():
    """Words, features and candidates of a text do not depend on its neighbours in a batch."""
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["the", "of", "zebra", "quart", "ünder", "12"]) for _ in range(rnd.choice([0, 1, 23, 24, 25, 48, 49, 200]))) for _ in range(40)]
    items = [(i, " ".join(rnd.choice(["zebra", "quart", "12", "lamp"]) for _ in range(n))) for i, n in enumerate((3, 12, 60))]
    basis = np.linalg.qr(np.random.default_rng(0).standard_normal((dc.FEATURES, 8)))[0].astype(np.float32)
    index = dc.build_index(items, basis, np.ones(dc.FEATURES, np.float32))
    w = dc.read_words([dc._blanked(t) for t in texts])
    got = [(t, k, at, round(c, 4)) for t, k, at, c in dc.candidates(index, w)]
    want = []
    for i, t in enumerate(texts):
        one = dc.read_words([dc._blanked(t)])
        assert one.of(0) == dc.words_of(t) and (one.features == w.features[w.bounds[i] : w.bounds[i + 1]]).all()
        want += [(i, k, at, round(c, 4)) for _, k, at, c in dc.candidates(index, one)]
    assert got == want and got


def test_items_of_15_to_2000_words_and_ids_of_any_type(spark):
    rnd = random.Random(9)
    common = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(2000)]
    prose = lambda n: " ".join(rnd.choices(common, k=n))
    bench = [(f"b{n}-{i}", prose(n - 8) + ". " + prose(8) + ".") for n in (15, 60, 200, 400, 600, 1000, 2000) for i in range(6)]
    docs = [(i, f"{prose(rnd.randint(0, 300))} {t} {prose(rnd.randint(0, 300))}") for i, (_, t) in enumerate(bench)] + [(1000 + i, prose(500)) for i in range(60)]
    docs.append((5000, prose(100_000) + " " + bench[-1][1]))  # a very long text
    df = spark.createDataFrame(docs, "doc_id int, text string").repartition(3)
    bm = spark.createDataFrame(bench, "item_id string, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(df, bm).collect()}
    assert got == {(i, b) for i, (b, _) in enumerate(bench)} | {(5000, bench[-1][0])}
    ints = bm.selectExpr("cast(hash(item_id) AS int) AS item_id", "text").unionAll(spark.createDataFrame([(None, "null id, item of some seven words here")], "item_id int, text string"))
    out = dc.contaminated(df, ints)
    assert out.schema["item_id"].dataType.simpleString() == "int" and out.count() == len(got)


def test_scripts_without_blanks(spark):
    rnd = random.Random(6)
    scripts = {"ja": [*map(chr, range(0x3042, 0x3090)), *map(chr, range(0x4E00, 0x5200))], "zh": list(map(chr, range(0x5200, 0x5C00))), "th": list(map(chr, range(0x0E01, 0x0E2F)))}
    run = lambda s, n: "".join(rnd.choices(scripts[s], k=n))
    bench, docs = [], []
    for k, (s, n) in enumerate((s, n) for s in scripts for n in (20, 60, 300)):
        item = f"{run(s, n - 8)}。{run(s, 8)}。" if s != "th" else run(s, n)
        bench.append((k, item))
        docs += [(10 * k, run(s, 200) + item + run(s, 200)), (10 * k + 1, f"{run(s, 90)} {item} {run(s, 90)}"), (10 * k + 2, run(s, 500)), (10 * k + 3, f"some English words, then {item} and more")]
    bench += [bench[0]] * 50  # equal items count once
    got = dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == sorted((10 * k + j, k) for k in range(9) for j in (0, 1, 3))
    assert dc.words_of("東京でSpark 4を使う。（終わり）") == [w.encode() for w in "東京 京で spark 4 を使 使う 終わ わり".split()]
    assert dc.answer_of("東京。使う。") == ["使う".encode()] and dc.words_of("京 a") == ["京".encode(), b"a"]


def test_recall_of_paraphrases(spark):
    """A tenth of the words changed and words put in between: found by cosine, or by what is left of the grams."""
    rnd = random.Random(5)
    common = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7))) for _ in range(3000)]
    prose = lambda n: " ".join(rnd.choices(common, k=n))
    bench, docs = [], []
    for i in range(100):
        bench.append((i, prose(24) + ". " + prose(8) + "."))
        words = bench[i][1].split()
        for k in rnd.sample(range(24), 3):
            words[k] = rnd.choice(common)
        out = []
        for j, w in enumerate(words):
            out += [w, rnd.choice(common)] if j % 3 == 2 else [w]  # no four words of the item in a row
        docs.append((i, f"{prose(150)} {' '.join(out)} {prose(150)}"))
    df, bm = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.contaminated(df, bm).collect()}
    recall = sum((i, i) in got for i in range(100)) / 100
    print("paraphrase recall", recall)
    assert recall >= 0.9 and len(got) <= 110


def test_basis_is_fitted_on_the_whole_benchmark(spark):
    """No sample: beside thousands of other documents, all items and their passages still lie in the basis whole."""
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 8))) for _ in range(2000)]
    prose = lambda n: " ".join(rnd.choices(words, k=n))
    bench = [(i, prose(rnd.choice([9, 30, 110])) + ".") for i in range(40)]
    docs = spark.createDataFrame([(i, prose(80)) for i in range(3000)], "doc_id long, text string").repartition(6)
    (index,) = dc._indexes(docs, spark.createDataFrame(bench, "item_id long, text string"), text_col="text", item_col="item_id", item_text="text")
    sizes = [min(1.0, len(p) / dc.PASSAGE_WORDS) for w in index.words for p in dc.indexed_passages(w)]
    assert 40 < len(sizes) <= dc.RANK
    assert np.allclose(index.floor, dc.CANDIDATE * np.sqrt(sizes), rtol=0.01)  # each has the length 1 within the basis


def test_a_worker_holds_few_texts_of_a_batch_at_once():
    """10,000 rows are one batch of Spark: 20 MB of text there were over 60 MB of Python objects and arrays."""
    column = pa.array([f"w{i} some words {i % 7} " * 100 for i in range(10_000)])
    tracemalloc.start()
    try:
        n = sum(len(w.texts) for _, w in dc.read_batches(column))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 10_000 and column.nbytes > 18e6 and peak < 30e6


def test_slices_of_a_column_keep_all_values_in_order():
    rows = [None, "", "é" * 50, "x", None, "y" * 1000, "", "z", None]
    for column in (pa.array(rows), pa.array(["a", *rows, "b"]).slice(1, len(rows)), pa.array([r and r.encode() for r in rows], pa.binary())):
        for size in (1, 3, 101, 1 << 20):
            slices = list(common.parts(column, size))
            assert [v for p in slices for v in p.to_pylist()] == column.to_pylist() == list(common.values(column))
            assert all(len(p) == 1 or sum(len(v.encode() if isinstance(v, str) else v) for v in p.to_pylist() if v) <= size for p in slices)
    assert list(common.values(pa.array([], pa.string()))) == []


def test_the_fit_has_one_python_step_in_a_stage(spark, monkeypatch):
    """Passages are dealt out anew before they are summed: two steps in one stage take two workers for each task."""
    seen = []
    monkeypatch.setattr(dc, "latent_basis", lambda passages, idf: seen.append(passages) or np.zeros((dc.FEATURES, 0), np.float32))
    docs = spark.createDataFrame([(1, "some words of a text")], "doc_id long, text string")
    dc.contaminated(docs, docs.selectExpr("doc_id AS item_id", "text"))
    plan = seen[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Repartition ") and ", true" in plan.split("\n")[0]
