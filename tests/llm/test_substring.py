import random
from collections import defaultdict

import numpy as np

from tidefold.llm import substring as ss


def words(rnd, n):
    return [f"w{rnd.randrange(10**6):x}é"[: rnd.randint(2, 8)] for _ in range(n)]


def test_cuts_follow_their_definition(monkeypatch):
    rnd = random.Random(0)
    for n in (0, 5, 40, 41, 42, 1000, 5000):
        data = np.frombuffer(bytes(rnd.choice(b"abcdef gh") for _ in range(n)), np.uint8)
        h = [sum(int(ss._GEAR[data[i - j]]) << j for j in range(min(i + 1, ss.HASH_BYTES))) % 2**32 for i in range(n)]
        r = ss.RADIUS
        want = [i + 1 for i in range(r, n - r) if h[i] < min(h[i - r : i]) and h[i] <= min(h[i + 1 : i + r + 1])]
        if n and n not in want:
            want.append(n)
        assert ss.cuts(data).tolist() == want
        monkeypatch.setattr(ss, "_STEP", 700)
        assert ss.cuts(data).tolist() == want
        monkeypatch.undo()


def test_insertions_only_change_chunks_nearby():
    rnd = random.Random(1)
    text = " ".join(words(rnd, 2000))
    other = text[:3000] + " inserted words here " + text[3000:]
    a, b = set(ss.chunk_rows(text)[0]), set(ss.chunk_rows(other)[0])
    assert len(a - b) <= 4


def shingles(text, n):
    w = text.split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def test_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    long_, any_ = defaultdict(set), defaultdict(set)
    for r in docs.collect():
        for s in shingles(r.text, 51):
            long_[hash(s)].add(r.doc_id)
        for s in shingles(r.text, 28):
            any_[hash(s)].add(r.doc_id)
    must = {d for x in long_.values() if len(x) > 1 for d in x}
    may = {d for x in any_.values() if len(x) > 1 for d in x}
    got = ss.op5_substring(spark, sf).collect()
    found = {r.doc_id for r in got}
    print("repeats", len(must), len(may), len(found))
    assert must <= found <= may


def test_edge_cases_and_cutting(spark):
    rnd = random.Random(2)
    passage = " ".join(words(rnd, 55))
    rows = [(i, " ".join(words(rnd, 80) + ([passage] if i % 2 else []) + words(rnd, 80))) for i in range(20)]
    odd = [(100, None), (101, ""), (None, rows[1][1]), rows[4], (102, "x" * 300_000), (103, "x" * 300_000)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "1 AS digest", "2 AS id").repartition(6)
    got = ss.repeated_passages(df)
    by = {r.doc_id: r for r in got.collect()}
    assert set(by) == {i for i in range(20) if i % 2} | {None}
    assert by.pop(None).start == 0  # the whole text is in document 1
    assert all(r.first_doc_id == 1 for r in by.values())
    out = ss.cut_passages(df, got)
    assert out.columns == df.columns and out.count() == df.count()
    texts = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    before = dict(rows)
    assert texts[1] == before[1] and texts[0] == before[0] and len(texts[3]) < len(before[3]) - 150
    assert texts[3].split()[:60] == before[3].split()[:60]
    nameless = out.where("doc_id IS NULL").first().text
    assert len(nameless) < 250 and rows[1][1].endswith(nameless[-20:])
    assert ss.repeated_passages(df.limit(0)).count() == 0


def test_neighbouring_passages_of_different_documents(spark):
    rnd = random.Random(3)
    a, b, c = (words(rnd, 60) for _ in range(3))
    own = lambda: words(rnd, 80)
    rows = [(1, own() + a + own()), (5, own() + a + b + own()), (9, own() + b + own()), (12, own() + a + b + c + own()), (20, own() + c + own())]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string").repartition(3)
    got = ss.repeated_passages(df)
    assert {(r.doc_id, r.first_doc_id) for r in got.collect()} >= {(1, 1), (5, 1), (5, 5), (9, 5), (12, 1), (12, 5), (12, 12), (20, 12)}
    texts = {r.doc_id: r.text for r in ss.cut_passages(df, got).collect()}
    for part, keeper in ((a, 1), (b, 5), (c, 12)):  # the middle of each passage stays once, where it came first
        middle = " ".join(part[25:35])
        assert [i for i, t in sorted(texts.items()) if middle in t] == [keeper]


def test_every_passage_of_51_words_shows_the_minimum():
    rnd = random.Random(5)
    makers = [
        lambda n: words(rnd, n),
        lambda n: ["".join(rnd.choices("abcde", k=rnd.randint(1, 5))) for _ in range(n)],
        lambda n: [rnd.choice("abc") for _ in range(n)],
        lambda n: (["on", "and"] * n)[:n],
        lambda n: ["same"] * n,
    ]
    pairs = []
    for make in makers:
        for _ in range(200):
            passage = make(51)
            texts = [" ".join(words(rnd, 40) + passage + words(rnd, 40)) for _ in range(2)]
            (d, s, e, n), (other, *_) = map(ss.chunk_rows, texts)
            assert s[0] == 0 and e[-1] == len(texts[0].encode()) and (s[1:] == e[:-1]).all() and n.sum() == 131
            shared, run, best = set(other), 0, 0
            for x, k in zip(d, n.tolist()):
                run = run + k if x in shared else 0
                best = max(best, run)
            assert best >= ss.MIN_WORDS
            pairs.append(texts)
    for one, two in pairs:
        assert set(ss.seed_rows(one)[0]) & set(ss.seed_rows(two)[0])


def test_word_cuts_follow_their_definition():
    rnd = random.Random(6)
    for n in (0, 1, 9, 10, 11, 200):
        h = np.array([rnd.randrange(12) for _ in range(n)], np.uint32)
        w = ss.WORD_WINDOW
        want = {max(j for j in range(i, i + w) if h[j] == min(h[i : i + w])) for i in range(n - w + 1)}
        assert ss.word_cuts(h).tolist() == sorted(want)


def test_every_border_is_a_minimum_of_the_gear_hash():
    rnd = random.Random(12)
    text = " ".join([*words(rnd, 300), "x" * 40 + "".join(rnd.choices("abcdef", k=900)), *words(rnd, 300)])
    raw, edges, _ = ss.chunk_edges(text)
    h = [sum(int(ss._GEAR[raw[i - j]]) << j for j in range(min(i + 1, ss.HASH_BYTES))) % 2**32 for i in range(len(raw))]
    firsts = [i for i in range(len(raw)) if raw[i] != 32 and (i == 0 or raw[i - 1] == 32)]
    inner, w, n_word, n_long = edges[1:-1].tolist(), ss.WORD_WINDOW, 0, 0
    for e in inner:
        if e in firsts:
            k = firsts.index(e)
            spans = [range(i, i + w) for i in range(max(0, k - w + 1), min(k, len(firsts) - w) + 1)]
            n_word += any(all(h[firsts[j]] >= h[e] for j in span) for span in spans)
        else:
            n_long += all(h[e - 1] <= h[j] for j in range(e - 1, min(len(raw), e - 1 + ss.RADIUS)))
    assert n_word > 80 and n_long > 10 and n_word + n_long == len(inner)


def test_ids_may_be_strings(spark):
    rnd = random.Random(13)
    passage = " ".join(words(rnd, 60))
    rows = [(f"doc-{i}", " ".join([*words(rnd, 50), passage if i % 2 else "", *words(rnd, 50)])) for i in range(6)]
    got = ss.repeated_passages(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id, r.first_doc_id) for r in got) == [(f"doc-{i}", "doc-1") for i in (1, 3, 5)]


def test_null_ids_and_several_texts_of_one_id(spark):
    rnd = random.Random(7)
    a, b = (" ".join(words(rnd, 70)) for _ in range(2))
    own = lambda: " ".join(words(rnd, 60))
    rows = [(None, f"{own()} {a} {own()}"), (None, f"{own()} {a}"), (3, f"{own()} {b} {own()}"), (3, f"{b} {own()}"), (3, own()), (8, f"{own()} {b}"), (None, own())]
    df = spark.createDataFrame(rows + [rows[0], rows[2]], "doc_id long, text string").repartition(3)
    got = ss.repeated_passages(df)
    assert sorted((str(r.doc_id), str(r.first_doc_id)) for r in got.collect()) == [("3", "3"), ("3", "3"), ("8", "3"), ("None", "None"), ("None", "None")]
    out = [r.text for r in ss.cut_passages(df, got).collect()]
    assert len(out) == 9 and sum(a[100:200] in t for t in out) == 3 and sum(b[100:200] in t for t in out) == 3
    alone = spark.createDataFrame([rows[0]] * 5, "doc_id long, text string")
    assert ss.repeated_passages(alone).count() == 0


def test_no_shared_passage_vanishes(spark):
    """Every 40-word span that stood in some document stands in one after the cut, wherever passages meet or nest."""
    rnd = random.Random(11)
    parts = [" ".join(words(rnd, n)) for n in (60, 60, 60, 90, 120, 75)]
    a, b, c = parts[:3]
    texts = [f"{a} {b} {c}", f"{a} {b} {c}", b]
    for _ in range(40):
        texts.append(" ".join(x for _ in range(rnd.randint(1, 4)) for x in (rnd.choice(parts), " ".join(words(rnd, rnd.randint(0, 60)))) if x))
    ids = rnd.sample(range(1000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(4)
    out = {r.doc_id: r.text for r in ss.cut_passages(df, ss.repeated_passages(df)).collect()}
    assert sum(map(len, out.values())) < 0.7 * sum(map(len, texts))
    for p in parts:  # the middle of each passage, which chunk borders don't touch
        w = p.split()
        middle = " ".join(w[12:-12])
        assert any(middle in t for t in out.values())
