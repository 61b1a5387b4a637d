import random

import xxhash
from pyspark.sql import functions as F

from tidefold.llm import simhash
from tidefold.llm.components import connected_components


def brute(rows):
    fps = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        g = [b" ".join(w[i : i + 3]) for i in range(max(len(w) - 2, min(1, len(w))))]
        h = [xxhash.xxh64_intdigest(x, 42) for x in g]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    comp = list(range(len(rows)))

    def find(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                comp[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            low[r] = min(low.get(r, d), d)
    return sorted(((d, f"{f:016x}", low.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=str)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w))))}


def groups(texts):
    """Smallest id of each document's group: all pairs at two bits, or at the wide radius."""
    prints = {d: simhash.wide_print(t)[:2] for d, t in texts.items()}
    low = {d: d for d in prints}

    def find(d):
        while low[d] != d:
            d = low[d]
        return d

    for a in sorted(prints):
        for b in sorted(prints):
            (fa, wa), (fb, wb) = prints[a], prints[b]
            wide = sum((x ^ y).bit_count() for x, y in zip(wa, wb)) <= simhash.SIMILAR_BITS and texts[a] and texts[b]
            if a < b and ((fa ^ fb).bit_count() <= 2 or wide):
                x, y = sorted((find(a), find(b)))
                low[y] = x
    return {d: find(d) for d in prints}


def changed(rnd, words, n):
    words = list(words)
    for _ in range(n):
        at = rnd.randrange(len(words))
        words[at : at + 1] = rnd.choice([[], ["new%d" % rnd.randrange(9999)], [words[at], "more%d" % rnd.randrange(9999)]])
    return words


def test_wide_print_measures_the_similarity_of_five_words():
    rnd = random.Random(8)
    for _ in range(150):
        t = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([60, 200, 700]))]
        u = changed(rnd, t, rnd.randrange(len(t) // 12))
        a, b = simhash.wide_print(" ".join(t)), simhash.wide_print(" ".join(u))
        assert a[0] == simhash.fingerprint(" ".join(t))
        x, y = shingles(" ".join(t)), shingles(" ".join(u))
        bits = sum((p ^ q).bit_count() for p, q in zip(a[1], b[1]))
        j = len(x & y) / len(x | y)
        assert (j < 0.85 or bits <= simhash.SIMILAR_BITS) and (j > 0.6 or bits > simhash.SIMILAR_BITS), (j, bits)
    assert simhash.wide_print(None) == simhash.wide_print(" \n") == (0, [0] * 4, [])
    assert simhash.wide_print("One  TWO") == simhash.wide_print("one two")


def test_similar_texts_are_dropped(spark, monkeypatch):
    rnd = random.Random(4)
    shared = [f"s{i}" for i in range(60)]
    texts, d = {}, 0
    for g in range(40):
        t = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([50, 120, 500]))]
        size = 60 if g == 0 else rnd.choice([1, 1, 2, 4])
        for k in range(size):  # one group is larger than FEW; a passage is shared by documents that are not similar
            body = changed(rnd, t, rnd.randrange(1 + len(t) // 45)) if k else t
            texts[d] = " ".join(body + (shared if len(t) == 500 and g else []))
            d += 1
    texts |= {d: None, d + 1: "", d + 2: "two words", d + 3: "two  Words"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("w0", F.lit(1)).withColumn("parts", F.lit("x"))
    want = groups(texts)
    got = simhash.drop_near_duplicates(df, similar=True)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want.values()))
    assert len(set(want.values())) < 50
    low = simhash.drop_near_duplicates(df.limit(0), similar=True)
    assert low.collect() == []


def test_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWDED", 6)
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    rows = [(None, "lonely text of no id"), (900, None), (901, ""), (902, "  \n"), (903, "One two"), (904, "one TWO"), (905, "x y z")]
    for d in range(60):
        t = [rnd.choice(words) for _ in range(rnd.choice([4, 60, 300]))]
        rows.append((d, " ".join(t)))
        for k in range(rnd.choice([0, 0, 1, 12])):
            u = list(t)
            for _ in range(rnd.choice([0, 1, 2])):
                u[rnd.randrange(len(u))] = rnd.choice(words)
            rows.append((1000 + d * 20 + k, " ".join(u)))
    rows += [rows[9], rows[9]]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit(1)).withColumn("id", F.lit("x")).repartition(5)
    got = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_components(df).collect()), key=str)
    assert got == brute(rows)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted({c for _, _, c in got if c is not None})


def test_crowded_way_gives_the_same_groups(spark):
    rnd = random.Random(5)
    base = rnd.getrandbits(63)
    fps = {base}
    for _ in range(400):
        x = rnd.choice(sorted(fps))
        for _ in range(rnd.choice([1, 2, 3])):
            x ^= 1 << rnd.randrange(63)
        fps.add(x)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    out = []
    for crowd in (1, 10_000):
        simhash.CROWDED, old = crowd, simhash.CROWDED
        try:
            out.append(sorted(map(tuple, connected_components(simhash.links(df)).collect())))
        finally:
            simhash.CROWDED = old
    assert out[0] == out[1] and out[0]


def test_rows_without_an_id_are_kept_apart(spark):
    text = [" ".join(f"{c}{i}" for i in range(90)) for c in "abc"]
    df = spark.createDataFrame([(None, text[0]), (None, text[1]), (None, text[1]), (4, text[2]), (None, text[2]), (9, text[2])], "doc_id long, text string")
    got = sorted(map(tuple, simhash.drop_near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, text[0]), (None, text[1]), (4, text[2])], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_components(df).collect() == []


def test_components_of_a_long_chain(spark):
    n = 300
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(5, 5), (None, 3), (1000, 1001)], "a long, b long")
    got = dict(map(tuple, connected_components(df).collect()))
    assert got == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


def test_a_passage_of_very_many_texts_links_only_similar_ones(spark):
    rnd = random.Random(8)
    passage = " ".join(f"common{i}" for i in range(70))
    rows = [(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(150)) + " " + passage) for i in range(400)]
    near = [(1000 + i, t.replace(t.split()[40], "changed", 1)) for i, t in rows[:60]]
    got = {r.doc_id for r in simhash.drop_near_duplicates(spark.createDataFrame(rows + near, "doc_id long, text string").repartition(6), similar=True).collect()}
    assert got == {i for i, _ in rows}
