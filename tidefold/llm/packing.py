"""Lexical retrieval packing: a sharded BM25 index fills each window with unused neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import parts, stored, table, values
from tidefold.llm.tokens import encoder

WINDOW = 1024
#: Bounds of one index shard: documents, and token ids (a longer document is a shard of its own).
SHARD_DOCS = 512
SHARD_TOKENS = 4_000_000
K1, B = 1.2, 0.75
#: Bytes of ids in a sorted partition, about, where the session's shuffle partitions would be larger.
PARTITION_BYTES = 128 << 20


class BM25:
    """Inverted index of one shard over the token ids of its whole documents.

    ``idf`` (by token id) and ``mean`` (ids a document) are those of all documents.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float):
        self.terms, counts = [], []
        for ids in docs:
            t, c = np.unique(ids, return_counts=True)
            self.terms.append(t)
            counts.append(c)
        n = len(docs)
        sizes = np.array([len(t) for t in self.terms])
        owner = np.repeat(np.arange(n), sizes)
        term, tf = np.concatenate(self.terms), np.concatenate(counts).astype(np.float64)
        length = np.array([len(d) for d in docs], np.float64)
        order = np.argsort(term, kind="stable")
        self.vocabulary, start, df = np.unique(term[order], return_index=True, return_counts=True)
        self.start, self.df = start, df
        norm = K1 * (1 - B + B * length / max(mean, 1.0))
        self.owner = owner[order]
        self.weight = tf[order] * (K1 + 1) / (tf[order] + norm[self.owner]) * idf[term[order]]
        self.n = n
        # long posting lists are kept as rows of a matrix, which a product adds up faster
        frequent = np.flatnonzero(df > n // 8)
        self.row = np.full(len(df), -1)
        self.row[frequent] = np.arange(len(frequent))
        long = self.row[np.repeat(np.arange(len(df)), df)]
        self.rows = np.zeros((len(frequent), n))
        self.rows[long[long >= 0], self.owner[long >= 0]] = self.weight[long >= 0]

    def scores(self, doc: int) -> np.ndarray:
        """BM25 of every document of the shard for the terms of ``doc``."""
        at = np.searchsorted(self.vocabulary, self.terms[doc])
        row = self.row[at]
        present = np.zeros(len(self.rows))
        present[row[row >= 0]] = 1
        at = at[row < 0]
        size = self.df[at]
        ends = np.cumsum(size)
        postings = np.arange(size.sum()) + np.repeat(self.start[at] - (ends - size), size)
        return present @ self.rows + np.bincount(self.owner[postings], self.weight[postings], self.n)


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def pack(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of one shard.

    Full windows of a document are sequences of their own.  The rest of each
    document is packed: the longest unused rest is the seed, its unused
    neighbours in the order of their BM25 score (then position) are placed
    whole while they fit, and the best one left is cut to fill the window.  So
    only the last sequence of a shard is shorter than the window.
    """
    pieces, sequence = [], 0
    start = np.zeros(len(docs), np.int64)
    left = np.array([len(d) for d in docs], np.int64)
    for i in range(len(docs)):
        for _ in range(left[i] // window):
            pieces.append((i, int(start[i]), window, sequence, 0))
            start[i] += window
            sequence += 1
        left[i] %= window
    index = BM25(docs, idf, mean)
    while (left > 0).any():
        seed = int(left.argmax())
        offset = 0

        def put(i: int, size: int) -> None:
            nonlocal offset
            pieces.append((i, int(start[i]), size, sequence, offset))
            start[i] += size
            left[i] -= size
            offset += size

        put(seed, int(left[seed]))
        if offset < window:
            unused = np.flatnonzero(left > 0)
            if len(unused):
                ranked = unused[np.argsort(-index.scores(seed)[unused], kind="stable")]
                for i, size in zip(ranked.tolist(), left[ranked].tolist()):
                    if size <= window - offset:
                        put(i, size)
                        if offset == window:
                            break
                if offset < window:
                    rest = ranked[left[ranked] > 0]
                    if len(rest):
                        put(int(rest[0]), window - offset)
        sequence += 1
    return pieces


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``(id, row, ids binary)``: little-endian ids of every text, id 0 at the end, in 16 bits if the vocabulary allows.

    ``row`` tells equal rows apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        end = np.zeros(1, encode.dtype).tobytes()
        row = TaskContext.get().partitionId() << 33
        for b in batches:
            lo = 0
            for part in parts(b.column(1)):
                ids = [x.tobytes() + end for x in encode.encode_all(part.to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, len(ids)), pa.array(np.arange(row, row + len(ids))), pa.array(ids, pa.binary())], ["id", "row", "ids"])
                lo, row = lo + len(ids), row + len(ids)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, row bigint, ids binary")


def _arrays(column: pa.Array, dtype: np.dtype) -> Iterator[np.ndarray]:
    return (np.frombuffer(x, dtype) for x in values(column))


def token_frequencies(tokens: DataFrame, vocabulary: str | None = None) -> tuple[np.ndarray, int, int]:
    """Documents with each id, documents, and ids in all, over all rows of ``tokenized``; bounded by the vocabulary."""
    size, dtype = encoder(vocabulary).size, encoder(vocabulary).dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 2, np.int64)
        for b in batches:
            for ids in _arrays(b.column(0), dtype):
                df[np.unique(ids)] += 1
                df[size:] += 1, len(ids)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["t", "n"])

    rows = tokens.select("ids").mapInArrow(run, "t bigint, n bigint").groupBy("t").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(size + 2, np.int64)
    df[rows["t"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return df[:size], int(df[size]), int(df[size + 1])


def routed(tokens: DataFrame, idf: np.ndarray, vocabulary: str | None = None) -> DataFrame:
    """``tokens`` with the long ``route``: the three distinct ids that come first in an order in
    which an id comes early by chance in proportion to its idf (a weighted minhash).

    Texts that share much rare vocabulary begin with the same ids, so that
    neighbours are near each other when sorted by it, at any number of rows.
    """
    dtype = encoder(vocabulary).dtype
    rank = np.random.default_rng(5).exponential(size=len(idf)) / np.maximum(idf, 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            route = np.zeros(b.num_rows, np.int64)
            for i, ids in enumerate(_arrays(b.column(2), dtype)):
                distinct = np.unique(ids)
                if len(distinct) > 3:
                    distinct = distinct[np.argpartition(rank[distinct], 2)[:3]]
                for t in distinct[np.argsort(rank[distinct])].tolist():
                    route[i] = route[i] << 20 | t
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(route)], [*b.schema.names, "route"])

    kind = tokens.schema["id"].dataType.simpleString()
    return tokens.select("id", "row", "ids").mapInArrow(run, f"id {kind}, row bigint, ids binary, route bigint")


def _shards(batches: Iterator[pa.RecordBatch], width: int, shard_docs: int) -> Iterator[pa.Table]:
    """The rows in their order as tables of bounded size."""
    held: list[pa.RecordBatch] = []
    docs = size = 0
    for b in batches:
        bytes_of = pa.compute.binary_length(b.column(1)).to_pylist()
        lo = 0
        for i, n in enumerate(bytes_of):
            if docs and (docs == shard_docs or size + n > SHARD_TOKENS * width):
                yield pa.Table.from_batches([*held, b.slice(lo, i - lo)])
                held, docs, size, lo = [], 0, 0, i
            docs, size = docs + 1, size + n
        held.append(b.slice(lo))
    if docs:
        yield pa.Table.from_batches(held)


def pack_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    vocabulary: str | None = None,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """``(<id_col>, start, length, ids binary, doc_tokens, sequence_id, offset)``, one row per piece.

    ``ids`` are little-endian unsigned 32-bit.  Every document ends with id 0, so
    a null or empty text is that id alone.  Documents are sorted by ``routed``
    and cut into shards of bounded documents and ids, each with a BM25 index of
    its own (corpus-wide idf); sequences don't cross shards.  Equal documents are
    adjacent, but no shard or partition holds all of a large group: range
    partitions are cut within it by ``row``.  Repeated rows are documents of their
    own; a null id is allowed; ids may have any type; no rows give no rows.
    """
    tokens = stored(tokenized(docs, id_col, text_col, vocabulary), "tokens")
    df, n, total = token_frequencies(tokens, vocabulary)
    idf, mean = inverse_frequencies(df, n), total / max(n, 1)
    kind = docs.schema[id_col].dataType.simpleString()
    dtype = encoder(vocabulary).dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 40
        for shard in _shards(batches, dtype.itemsize, shard_docs):
            data = [x for c in shard.column(1).chunks for x in _arrays(c, dtype)]
            pieces = np.array(pack(data, idf, mean, window), np.int64).T
            which, start, length, number, offset = pieces
            ids = [data[i][a : a + n].astype("<u4").tobytes() for i, a, n in zip(*pieces[:3].tolist())]
            sizes = np.array([len(d) for d in data], np.int64)
            out = pa.table(
                {
                    "id": shard.column(0).take(pa.array(which)),
                    **{"start": start, "length": length, "ids": pa.array(ids, pa.binary()), "doc_tokens": sizes[which]},
                    **{"sequence_id": sequence + number, "offset": offset},
                }
            )
            sequence += int(number.max()) + 1
            yield from out.combine_chunks().to_batches()

    schema = f"id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total * dtype.itemsize // PARTITION_BYTES))
    return (
        routed(tokens, idf, vocabulary)
        .repartitionByRange(partitions, "route", "row")
        .sortWithinPartitions("route", "row")
        .select("id", "ids")
        .mapInArrow(run, schema)
        .withColumnRenamed("id", id_col)
    )


def with_digest(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The ids of each piece replaced by their crc32."""
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op3_of(docs: DataFrame) -> DataFrame:
    return with_digest(pack_documents(docs.select("doc_id", "text")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed; nulls, repeated rows and empty tables: as ``pack_documents``."""
    return op3_of(table(spark, sf_dir, "documents"))
