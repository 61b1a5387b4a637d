import functools
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidefold.llm import packing
from tidefold.llm.tokens import encoder


@functools.cache
def reference():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda x: t.encode(x, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=" ab'é1\n\t.#s<|>endoftxt\x1c\x85\u3000\xa0 😀", max_size=40), max_size=4), st.booleans())
def test_same_ids_as_the_tokenizer(texts, special):
    if special:
        texts = [t.replace("e", "<|endoftext|>") for t in texts]
    encode = reference()
    for _ in range(2):  # the second time from the table of pieces
        assert [x.tolist() for x in encoder().encode_all(texts)] == [encode(t) for t in texts]


def test_special_strings_and_long_pieces():
    encode, e = reference(), encoder()
    texts = ["a<|endoftext|>b", " <|endoftext|> ", None, "", "x " + "ab1é" * 3000 + " y", "y " * 5000, " leading", "<|endoftext", "\ud7ff \uffff"]
    assert [x.tolist() for x in e.encode_all(texts)] == [encode(t) if t else [] for t in texts]


def test_whole_texts_of_the_table():
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet")["text"].to_pylist()
    encode = reference()
    for lo in range(0, len(texts), 64):
        part = texts[lo : lo + 64]
        assert [x.tolist() for x in encoder().encode_all(part)] == [encode(t) if t else [] for t in part]


def check(rows, pieces, window=1024):
    encode = reference()
    want = {d: (encode(t) if t else []) + [0] for d, t in rows}
    got, seqs = {}, {}
    for p in pieces:
        got.setdefault(p.doc_id, []).append((p.start, p.length, p.ids_crc32, p.doc_tokens))
        seqs.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert got.keys() == want.keys()
    for d, ids in want.items():
        at = 0
        for s, n, crc, total in sorted(got[d]):
            assert s == at and n > 0 and total == len(ids)
            assert crc == zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())
            at += n
        assert at == len(ids)
    total = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= window
        total += window if at & (at - 1) else at
    return sum(map(len, want.values())) / total


def test_query_is_exact_and_dense(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert check(rows, packing.op3_packing(spark, sf).collect()) > 0.995


def test_edge_cases(spark):
    rows = [(1, None), (2, ""), (3, "x"), (4, "long word " * 40_000), (None, "no id"), (5, "  two  blanks \n"), (6, "<|endoftext|> is text")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "'a' AS id")
    out = packing.with_digest(packing.pack_documents(df, shard_docs=3)).collect()
    check(rows, out)
    twice = packing.with_digest(packing.pack_documents(df.union(df))).collect()
    assert sum(p.length for p in twice) == 2 * sum(p.length for p in out)
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_ids_of_any_type_and_large_groups_of_equal_rows(spark):
    rows = [("", "an empty id"), ("b", "same words here"), (None, None), ("a", "<|endoftext|>")]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("doc_id", "text", "'x' AS route", "1 AS ids", "2 AS row")
    check(rows, packing.with_digest(packing.pack_documents(df)).collect())
    ints = spark.createDataFrame([(1, "x y"), (None, "z")], "doc_id int, text string")
    out = packing.pack_documents(ints)
    assert out.schema["doc_id"].dataType.simpleString() == "int" and out.count() == 2
    same = spark.range(3000).selectExpr("7L AS doc_id", "'equal rows of one id, again and again' AS text")
    pieces = packing.pack_documents(same.repartition(4)).selectExpr("*", "sequence_id >> 40 AS task").collect()
    assert sum(p.start == 0 for p in pieces) == 3000
    per_task = np.unique([p.task for p in pieces], return_counts=True)[1]
    assert len(per_task) > 4 and per_task.max() < 1500


def test_shards_are_bounded(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "SHARD_TOKENS", 100)
    sizes = [1, 30, 80, 500, 2, 2, 2, 90, 5]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)), pa.array([bytes(2 * n) for n in sizes])], ["id", "ids"])
    shards = [t.column("id").to_pylist() for t in packing._shards(iter([batch.slice(0, 4), batch.slice(4), batch.slice(0, 0)]), 2, 3)]
    assert shards == [[0, 1], [2], [3], [4, 5, 6], [7, 8]]


def test_near_copies_share_a_shard(spark):
    """The route keeps texts with a common vocabulary together; unrelated ones are dealt anywhere."""
    rnd = np.random.default_rng(4)
    words = ["".join(rnd.choice(list("abcdefghij"), 6)) for _ in range(4000)]
    rows = []
    for i in range(600):
        text = rnd.choice(words, 120)
        rows.append((2 * i, " ".join(text)))
        text[rnd.integers(0, 120, 5)] = rnd.choice(words, 5)
        rows.append((2 * i + 1, " ".join(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tokens = packing.stored(packing.tokenized(df), "tokens")
    counts, n, _ = packing.token_frequencies(tokens)
    order = [r.id // 2 for r in packing.routed(tokens, packing.inverse_frequencies(counts, n)).orderBy("route", "row").collect()]
    at = {}
    for i, d in enumerate(order):
        at.setdefault(d, []).append(i)
    assert n == 1200 and np.mean([b - a < 20 for a, b in at.values()]) > 0.85


def test_index_matches_plain_bm25_and_prefers_neighbours():
    rnd = np.random.default_rng(0)
    docs = [rnd.integers(100 * (i % 3), 100 * (i % 3) + 120, 200) for i in range(30)]
    mean = np.mean([len(d) for d in docs])
    df = np.array([sum(t in d for d in docs) for t in range(400)])
    idf = packing.inverse_frequencies(df, 30)
    index = packing.BM25(docs, idf, mean)
    for q in (0, 7):
        want = np.zeros(30)
        for t in set(docs[q].tolist()):
            for i, d in enumerate(docs):
                tf = (d == t).sum()
                want[i] += np.log1p((30 - df[t] + 0.5) / (df[t] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        assert np.allclose(index.scores(q), want)
    by = {}
    for d, _, _, s, _ in packing.pack(docs, idf, mean):
        by.setdefault(s, set()).add(d % 3)
    assert sum(len(x) == 1 for x in by.values()) >= len(by) / 2
