"""Substring dedup by content-defined chunks: borders by a gear rolling hash, digests, and runs of shared seeds of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm.common import fresh, stored, table

#: Bytes the rolling hash depends on (a power of two).
HASH_BYTES = 8
#: A chunk begins at a word whose rolling hash, at its first byte, is the smallest of any so
#: many neighbouring words, so none has more words than this.
WORD_WINDOW = 9
#: Chunks of more bytes (texts with few blanks) are cut further, at any byte.
LONG_CHUNK = 160
#: Such a cut is the first smallest hash within so many bytes on either side: these
#: chunks are longer than this, and 2 * RADIUS + 1 bytes on average.
RADIUS = 20
#: A seed is so many words or more in neighbouring chunks, and a seed that two documents have
#: is a repeated passage.  In a passage the hashes of all words but the first HASH_BYTES / 2 are
#: those of every copy, as a word and its blank have two bytes or more.  The first and the last
#: window of such words have their minima in every copy, so of n words at least
#: n + 1 - HASH_BYTES / 2 - 2 * WORD_WINDOW are in chunks that all copies have: 30 of 51, a seed.
MIN_WORDS = 30

_GEAR = np.array([xxhash.xxh32_intdigest(bytes([i]), 7) for i in range(256)], np.uint32)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STEP = 1 << 22


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum of gear[data[i - j]] << j over the last ``HASH_BYTES`` bytes, by doubling."""
    h = _GEAR[data]
    k = 1
    while k < HASH_BYTES:
        h[k:] = h[k:] + (h[:-k] << np.uint32(k))
        k *= 2
    return h


def _lowest(h: np.ndarray, n: int) -> np.ndarray:
    """Smallest of ``h[i : i + n]`` for each i."""
    m, width = h, 1
    while 2 * width <= n:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(m) - (n - width)], m[n - width :]) if width < n else m


def cuts(data: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Ends of all chunks, the last one being the length; the same bytes give the same cuts anywhere."""
    n = len(data)
    if n <= 2 * radius:
        return np.array([n] if n else [], np.int64)
    found = []
    for at in range(0, n, _STEP):
        lo, hi = max(0, at - radius - HASH_BYTES), min(n, at + _STEP + radius)
        h = gear_hashes(data[lo:hi])[at - lo - min(at, radius) :]
        base = at - min(at, radius)
        if len(h) > 2 * radius:
            m = _lowest(h, radius)
            centre = h[radius : len(h) - radius]
            k = len(centre)
            found.append(np.flatnonzero((centre < m[:k]) & (centre <= m[radius + 1 : radius + 1 + k])) + base + radius + 1)
    ends = np.unique(np.concatenate(found)) if found else np.array([], np.int64)
    return np.append(ends[ends < n], n)


def word_cuts(h: np.ndarray, window: int = WORD_WINDOW) -> np.ndarray:
    """Indices of the last smallest hash of each ``window`` neighbouring ones."""
    if len(h) < window:
        return np.array([], np.int64)
    # the index in the low bits, reversed, makes hashes unique and the last of equal ones the smallest
    n = len(h)
    keyed = h.astype(np.uint64) << np.uint64(32) | np.arange(n - 1, -1, -1, dtype=np.uint64)
    return np.unique(n - 1 - (_lowest(keyed, window) & np.uint64(0xFFFFFFFF)).astype(np.int64))


def chunk_edges(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The bytes, the borders of all chunks, and the words (counted at their first byte) of each."""
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    space = _SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    at = np.flatnonzero(first)
    edges = np.unique(np.concatenate(([0], at[word_cuts(gear_hashes(data)[at])], [len(data)])))
    long = np.flatnonzero(np.diff(edges) > LONG_CHUNK).tolist()
    edges = np.unique(np.concatenate([edges, *(edges[i] + cuts(data[edges[i] : edges[i + 1]]) for i in long)]))
    words = np.add.reduceat(first, edges[:-1], dtype=np.int64) if len(edges) > 1 else edges[:-1]
    return raw, edges, words


def _digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[int]:
    digest, view = xxhash.xxh3_128_intdigest, memoryview(raw)
    return [digest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]


def chunk_rows(text: str) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """128-bit digests, byte starts, byte ends and words of all chunks."""
    raw, edges, words = chunk_edges(text)
    return _digests(raw, edges[:-1], edges[1:]), edges[:-1], edges[1:], words


def seed_rows(text: str, min_words: int = MIN_WORDS) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """128-bit digests, byte starts and lengths, chunks, words before the start, and words of all seeds.

    The seed of a chunk is the chunk and those after it up to ``min_words`` words;
    the last chunks of a text have too few left and no seed.
    """
    raw, edges, words = chunk_edges(text)
    before = np.concatenate(([0], np.cumsum(words)))
    last = np.searchsorted(before, before[:-1] + min_words)
    at = np.flatnonzero(last < len(before))[: len(words)]
    last = last[at]
    return _digests(raw, edges[at], edges[last]), edges[at], edges[last] - edges[at], last - at, before[at], before[last] - before[at]


def text_key(text_col: str = "text"):
    """31 bits of a hash of the text, which tell texts with one id, or without any, apart."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF))


def seeds(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(id, idx, digest, more, start, bytes, chunks, w0, words)``, one row per seed of the whole texts.

    ``idx`` is the text's key, then the number of the chunk in 32 bits.  ``digest`` and ``more``
    are 96 bits of the digest: among 10^12 seeds the chance of any false pair is below 10^-4.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "idx", "digest", "more", "start", "bytes", "chunks", "w0", "words"]
        for batch in batches:
            keys = batch.column(2).to_numpy()
            for lo in range(0, batch.num_rows, 256):
                parts = [seed_rows(t or "", min_words) for t in batch.column(1).slice(lo, 256).to_pylist()]
                n = [len(p[0]) for p in parts]
                which = np.repeat(np.arange(lo, lo + len(parts)), n)
                both = np.frombuffer(b"".join(d.to_bytes(16, "little") for p in parts for d in p[0]), np.int64).reshape(-1, 2)
                digests = [pa.array(both[:, 0].copy()), pa.array(both[:, 1].astype(np.int32))]
                join = lambda i: pa.array(np.concatenate([p[i] for p in parts]).astype(np.int32))
                idx = (keys[which] << 32) + np.concatenate([np.arange(k) for k in n])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array(idx), *digests, *map(join, range(1, 6))], names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), text_key(text_col).alias("tk")).mapInArrow(
        run, f"id {kind}, idx bigint, digest bigint, more int, start int, bytes int, chunks int, w0 int, words int"
    )


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """``(<id_col>, text_key, start, end, n_chunks, n_words, first_doc_id)``: passages found in two or more documents.

    One row per longest run of seeds that other documents have too and that have
    the same smallest owner; rows of different owners may overlap.  (A single seed
    of another owner at an end of a longer run adds the border of the passage only
    and has no row.)  ``start`` and ``end`` are byte positions in the UTF-8 text;
    ``first_doc_id`` has all seeds of the run and is the smallest id that has any
    (its own row is the occurrence to keep).  Different texts without an id are
    documents of their own; ``first_doc_id`` is null if only such have the passage.
    Different texts of one id are one document with more than one text
    (``text_key`` tells them apart); repeated rows count once; null and empty
    texts have no seeds; no rows give no rows.

    Seeds are read from the texts twice rather than kept, which halves the disk.
    Their digests are aggregated before they are joined back, and the
    aggregate is a table, so that a passage that very many documents share costs one row per task
    in the aggregation and its rows are split over tasks in the join.
    """
    rows = seeds(docs, id_col, text_col, min_words)
    nameless = F.when(F.col("id").isNull(), F.shiftright("idx", 32))
    shared = stored(
        rows.groupBy("digest", "more")
        .agg(F.min("id").alias("low"), F.max("id").alias("high"), F.min(nameless).alias("n_low"), F.max(nameless).alias("n_high"))
        .where("low < high OR n_low < n_high OR (low IS NOT NULL AND n_low IS NOT NULL)")
        .select("digest", "more", "low"),
        "shared",
    )
    hits = rows.join(shared, ["digest", "more"]).dropDuplicates(["id", "idx"]).withColumn("tk", F.shiftright("idx", 32))
    by_doc = Window.partitionBy("id", "tk").orderBy("idx")
    same = F.col("low").eqNullSafe(F.lag("low").over(by_doc)) & (F.col("idx") == F.lag("idx").over(by_doc) + 1)
    parts = (
        hits.withColumn("run", F.col("idx") - F.row_number().over(by_doc))
        .withColumn("apart", F.when(same, 0).otherwise(1))
        .withColumn("part", F.sum("apart").over(by_doc))
        .groupBy("id", "tk", "run", "part")
        .agg(
            F.min("start").alias("start"),
            F.max(F.col("start") + F.col("bytes")).alias("end"),
            F.count(F.lit(1)).alias("n"),
            (F.max(F.col("idx") + F.col("chunks")) - F.min("idx")).alias("n_chunks"),
            (F.max(F.col("w0") + F.col("words")) - F.min("w0")).cast("bigint").alias("n_words"),
            F.min("low").alias("first_doc_id"),
        )
    )
    by_run = Window.partitionBy("id", "tk", "run")
    at_end = F.col("part").isin(F.min("part").over(by_run), F.max("part").over(by_run))
    border = (F.col("n") == 1) & at_end & (F.max("n").over(by_run) > 1)
    runs = parts.withColumn("border", border).where(~F.col("border"))
    return runs.select(F.col("id").alias(id_col), F.col("tk").alias("text_key"), "start", "end", "n_chunks", "n_words", "first_doc_id")


def cut_passages(docs: DataFrame, passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the passages whose first occurrence is in another document.

    A seed stays in the document of its smallest id, unless an even smaller one has
    that place too, so no text is cut everywhere; what only texts without an id
    share stays in all of them.  Cuts are byte ranges at chunk borders moved
    inwards to code point borders.  All rows, their order of columns and other
    columns stay; null and empty texts are unchanged; repeated rows are cut alike.
    """
    cut_id, cut_key, cuts_of = fresh(docs, "_cut_id"), fresh(docs, "_cut_key"), fresh(docs, "_cuts")
    ranges = (
        passages.where(F.col("first_doc_id").isNotNull() & ~F.col(id_col).eqNullSafe(F.col("first_doc_id")))
        .groupBy(F.col(id_col).alias(cut_id), F.col("text_key").alias(cut_key))
        .agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(cuts_of))
    )
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, gone in zip(b.column(at).to_pylist(), b.column(len(names)).to_pylist()):
                if text and gone:
                    raw, kept, pos = text.encode(), [], 0
                    for g in gone:
                        kept.append(raw[pos : g["start"]])
                        pos = max(pos, g["end"])
                    text = b"".join([*kept, raw[pos:]]).decode(errors="ignore")
                out.append(text)
            cols = [b.column(i) for i in range(len(names))]
            cols[at] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    same = docs[id_col].eqNullSafe(ranges[cut_id]) & (text_key(text_col) == ranges[cut_key])
    return docs.join(ranges, same, "left").drop(cut_id, cut_key).mapInArrow(run, docs.schema)


def op5_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated passages of all documents; nulls, repeated rows and empty tables: as ``repeated_passages``."""
    return repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
