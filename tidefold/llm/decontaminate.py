"""Benchmark decontamination: shared word n-grams and latent semantic retrieval, then subsequence and answer checks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidefold.llm.common import table, values
from tidefold.llm.words import piece_hashes

#: Hashed TF-IDF features, and the rank and oversampling of the decomposition.
FEATURES = 1 << 15
RANK = 128
OVERSAMPLE = 8
#: Documents are read as overlapping passages of two blocks of words.
BLOCK_WORDS = 24
PASSAGE_WORDS = 2 * BLOCK_WORDS
#: A passage is a candidate if it shares a word n-gram with an item (see ``gram_length``), or if
#: its cosine with the latent vector of an item or of an item's passage is at least this share of
#: the cosine expected of a passage that contains it.
CANDIDATE = 0.3
#: Shares of an item's words found in order: enough alone, or enough with the answer.
COPIED = 0.8
PARAPHRASED = 0.5
ANSWERED = 0.8
#: Words of a gram, at most: features of 15 bits, so that the key is exact for them.
GRAM = 4
#: Latent vectors held by a task at once, about; a larger benchmark is searched block by block.
ITEM_BLOCK = 20_000
#: Bytes of texts that are read at once, and entries and blocks that are projected at once.
STEP_BYTES = 1 << 20
_STEP_ENTRIES = 1 << 13
_STEP_BLOCKS = 1 << 9
#: Tasks that sum the decomposition for each block of items, each up to one matrix of the items' features.
SVD_TASKS = 4

#: All but digits, lower-case letters and non-ASCII bytes becomes a blank.
_BLANKED = bytes(c if c >= 0x80 or chr(c).isdigit() or "a" <= chr(c) <= "z" else 32 for c in range(256))
#: The full stops, exclamation and question marks of East Asian texts need no blank after them.
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+|(?<=[\u3002\uff01\uff1f])", re.ASCII)
#: Scripts that don't set words apart by blanks (Thai to Lao, Burmese, Khmer, kana and Han): each two neighbouring characters
#: are a word.  Single ones would not do, as an alphabet's letters are found in order in any text.
UNSPACED = r"\u0e01-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3041-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f"
_UNSPACED = re.compile(f"[{UNSPACED}\U00020000-\U0003ffff]+")
#: First bytes of the characters from U+0800 on, which is where those scripts are: a quick test.
_LONG_LEADS = bytes(range(0xE0, 0xF8))
#: Their marks are blanks.
_MARKS = re.compile("[\u3000-\u3004\u3008-\u3020\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]")


def _pairs(run: re.Match[str]) -> str:
    s = run.group()
    return f" {' '.join(a + b for a, b in zip(s, s[1:])) or s} "


def _blanked(text: str | None) -> bytes:
    if not text:
        return b""
    raw = text.lower().encode()
    if not raw.isascii() and len(raw.translate(None, _LONG_LEADS)) < len(raw) and _UNSPACED.search(text):
        raw = _UNSPACED.sub(_pairs, _MARKS.sub(" ", text)).lower().encode()
    return raw.translate(_BLANKED)


def words_of(text: str | None) -> list[bytes]:
    return _blanked(text).split()


@dataclass
class Words:
    """The words of some texts, one after the other."""

    texts: list[bytes]
    bounds: np.ndarray  # of each text's words
    features: np.ndarray

    def of(self, text: int) -> list[bytes]:
        return self.texts[text].split()


def read_words(texts: list[bytes]) -> Words:
    """Words and hashed features of blanked texts, all at once."""
    raw = b" ".join(texts)
    letter = np.concatenate(([False], np.frombuffer(raw, np.uint8) != 32, [False]))
    edges = np.flatnonzero(letter[1:] != letter[:-1])
    starts, ends = edges[::2], edges[1::2]
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    hashed = piece_hashes(np.frombuffer(raw, np.uint8), starts, ends)
    return Words(texts, np.searchsorted(starts, begin), (hashed & np.uint64(FEATURES - 1)).astype(np.int64))


def read_batches(column: pa.Array) -> Iterator[tuple[int, Words]]:
    """The texts of a column by parts of about ``STEP_BYTES``: number of the first, and their words."""
    texts, size, first = [], 0, 0
    for i, t in enumerate(values(column)):
        texts.append(_blanked(t))
        size += len(texts[-1])
        if size >= STEP_BYTES:
            yield first, read_words(texts)
            texts, size, first = [], 0, i + 1
    if texts:
        yield first, read_words(texts)


def features_of(words: list[bytes]) -> np.ndarray:
    return read_words([b" ".join(words)]).features


def answer_of(text: str) -> list[bytes]:
    """The words of the last sentence; of a single sentence, its last third."""
    parts = [w for w in map(words_of, _SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return parts[-1]
    return parts[0][-max(1, len(parts[0]) // 3) :] if parts else []


def lcs_length(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        m = at.get(w)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def document_frequencies(docs: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Documents with each hashed feature, over all documents, and the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(FEATURES + 1, np.int64)
        for b in batches:
            for _, w in read_batches(b.column(0)):
                text = np.repeat(np.arange(len(w.texts)), np.diff(w.bounds))
                df += np.bincount(np.unique(text * FEATURES + w.features) % FEATURES, minlength=FEATURES + 1)
                df[FEATURES] += len(w.texts)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], ["f", "n"])

    rows = docs.select(text_col).mapInArrow(run, "f int, n bigint").groupBy("f").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(FEATURES + 1, np.int64)
    df[rows["f"].to_numpy()] = rows["n"].to_numpy()
    return df[:FEATURES], int(df[FEATURES])


def inverse_frequencies(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)).astype(np.float32) + np.float32(0.01)


def _summed(parts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sum of ``(f, v binary float32[width])`` rows by ``f``: the features, rising, and a row for each.

    The result is bounded by the features, however many passages there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for b in batches:
            for f, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                x = np.frombuffer(v, np.float32)
                acc[f] = acc[f] + x if f in acc else x
        yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int32()), pa.array([v.tobytes() for v in acc.values()], pa.binary())], ["f", "v"])

    rows = parts.repartition("f").mapInArrow(run, "f int, v binary").toArrow().sort_by("f")
    out = np.frombuffer(b"".join(rows["v"].to_pylist()), np.float32)
    return rows["f"].to_numpy(), out.reshape(len(rows), -1 if len(rows) else 0).astype(np.float64)


def weighted(w: Words, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of TF-IDF vectors of length 1: text, feature and value of all entries, by text."""
    text = np.repeat(np.arange(len(w.texts)), np.diff(w.bounds))
    key, tf = np.unique(text * FEATURES + w.features, return_counts=True)
    text, f = key // FEATURES, key % FEATURES
    x = tf * idf[f].astype(np.float64)
    norm = np.sqrt(np.bincount(text, x * x, len(w.texts)))
    return text, f, x / np.maximum(norm, 1e-12)[text]


def latent_basis(passages: DataFrame, idf: np.ndarray, rank: int = RANK, seed: int = 11) -> np.ndarray:
    """Orthonormal ``FEATURES x r`` right singular vectors of the TF-IDF matrix of ``passages(text, weight float)``.

    Randomised SVD: A'A applied to a random matrix (twice, for one power
    iteration) is summed over the rows in the tasks; only matrices of
    ``rank + OVERSAMPLE`` columns and a row for each feature that the passages
    have reach the driver.
    """
    spark = passages.sparkSession

    def gram_times(at: np.ndarray | None = None, q: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast((at, q.astype(np.float32))) if q is not None else None

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if shared is None:
                q32 = np.random.default_rng(seed).standard_normal((FEATURES, rank + OVERSAMPLE), np.float32)
            else:
                q32 = np.zeros((FEATURES, shared.value[1].shape[1]), np.float32)
                q32[shared.value[0]] = shared.value[1]
            acc, used = np.zeros_like(q32), np.zeros(FEATURES, bool)
            for b in batches:
                weight = b.column(1).to_numpy()
                for first, w in read_batches(b.column(0)):
                    text, f, x = weighted(w, idf)
                    x *= weight[first + text]
                    used[f] = True
                    for lo in range(0, len(f), _STEP_ENTRIES):  # entries, in whole or in part of a text's
                        t, at, v = text[lo : lo + _STEP_ENTRIES], f[lo : lo + _STEP_ENTRIES], x[lo : lo + _STEP_ENTRIES, None].astype(np.float32)
                        y = np.zeros((t[-1] - t[0] + 1, q32.shape[1]), np.float32)
                        np.add.at(y, t - t[0], q32[at] * v)
                        # a text cut by the step: the rest of its row
                        for a, z in ((np.searchsorted(text, t[0]), lo), (lo + len(t), np.searchsorted(text, t[-1], side="right"))):
                            if z > a:
                                y[0 if z == lo else -1] += x[a:z].astype(np.float32) @ q32[f[a:z]]
                        np.add.at(acc, at, y[t - t[0]] * v)
            at = np.flatnonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array([acc[i].tobytes() for i in at], pa.binary())], ["f", "v"])

        return _summed(passages.select("text", "weight").mapInArrow(run, "f int, v binary"))

    at, z = gram_times()
    if not len(at):
        return np.zeros((FEATURES, 0), np.float32)
    q, _ = np.linalg.qr(z)
    _, z = gram_times(at, q)
    # q'A'A q is the small Gram matrix; its leading eigenvectors turn q into singular vectors
    vals, vecs = np.linalg.eigh(q.T @ z)
    top = np.argsort(vals)[::-1][:rank]
    top = top[vals[top] > 1e-6 * max(float(vals.max(initial=0.0)), 1e-300)]
    basis = np.zeros((FEATURES, len(top)), np.float32)
    basis[at] = q @ vecs[:, top]
    return basis


def indexed_passages(words: list[bytes]) -> list[list[bytes]]:
    """An item and, of a long one, its overlapping passages: what is searched for."""
    starts = range(0, len(words) - BLOCK_WORDS, BLOCK_WORDS) if len(words) > PASSAGE_WORDS else ()
    return [words, *(words[i : i + PASSAGE_WORDS] for i in starts)]


def item_passages(items: DataFrame) -> DataFrame:
    """``(text, weight)``: all that is indexed of all ``items(t)``, which the decomposition is fitted on.

    The benchmark is the collection that is searched, for every passage of every
    document; documents take part by their frequencies, which are those of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0).to_pylist():
                part = [b" ".join(p) for p in indexed_passages(words_of(t)) if p]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.binary()).cast(pa.string())], ["text"])

    return items.select("t").mapInArrow(run, "text string").withColumn("weight", F.lit(1.0).cast("float"))


def gram_length(n: int) -> int:
    """Words in a row that are left of ``n``, whichever fifth of them is changed or left out; ``GRAM`` at most."""
    gone = n // 5
    return min(GRAM, -(-(n - gone) // (gone + 1)))


def gram_keys(feats: np.ndarray, size: int) -> np.ndarray:
    """One key for each run of ``size`` features."""
    n = max(0, len(feats) - size + 1)
    keys = np.zeros(n, np.int64)
    for j in range(size):
        keys = keys << 15 | feats[j : j + n]
    return keys


@dataclass
class Grams:
    """The items that have each gram of one length."""

    size: int
    keys: np.ndarray  # sorted
    start: np.ndarray
    item: np.ndarray
    seen: np.ndarray  # a filter: whether a slot has a key

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.int64(0x1E3779B97F4A7C15)) >> np.int64(40) & np.int64(len(self.seen) - 1)

    def hits(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """``(word, item)`` of all grams within the texts of ``w`` that items have."""
        keys = gram_keys(w.features, self.size)
        word = np.flatnonzero(np.take(self.seen, self.slots(keys)))
        at = np.searchsorted(self.keys, keys[word])
        same = self.keys[np.minimum(at, len(self.keys) - 1)] == keys[word]
        same &= np.searchsorted(w.bounds, word, side="right") == np.searchsorted(w.bounds, word + self.size - 1, side="right")
        word, at = word[same], at[same]
        n = self.start[at + 1] - self.start[at]
        return np.repeat(word, n), self.item[np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def grams_of(items: list[list[bytes]], answers: list[list[bytes]]) -> list[Grams]:
    """Grams of all items and of their answers, by length.

    An item or an answer of which 80 % stands in a text without words put in
    between shares one of them with it.  An answer of one word has none: that
    word alone says nothing.
    """
    found: dict[int, set[tuple[int, int]]] = {}
    for k, (item, answer) in enumerate(zip(items, answers)):
        for words in (item, answer):
            size = gram_length(len(words))
            if size > 1 or (words is item and words):
                found.setdefault(size, set()).update((key, k) for key in gram_keys(features_of(words), size).tolist())
    out = []
    for size, pairs in sorted(found.items()):
        key, item = np.array(sorted(pairs), np.int64).T
        keys, start = np.unique(key, return_index=True)
        table = Grams(size, keys, np.append(start, len(key)), item, np.zeros(1 << max(16, min(24, int(8 * len(keys)).bit_length())), bool))
        table.seen[table.slots(keys)] = True
        out.append(table)
    return out


@dataclass
class Index:
    """What a task needs to search one block of items."""

    projection: np.ndarray  # a row of the basis for each feature that it has, already times idf, and a row of zeros
    row: np.ndarray  # of each feature in the projection
    idf2: np.ndarray
    latent: np.ndarray  # r x columns, unit vectors of items and of the passages of long items
    owner: np.ndarray  # item of each column
    floor: np.ndarray  # candidate threshold of each column
    grams: list[Grams]
    ids: list
    words: list[list[bytes]]
    answers: list[list[bytes]]


def build_index(items: list[tuple], basis: np.ndarray, idf: np.ndarray) -> Index:
    items = [(i, t) for i, t in items if words_of(t)]
    texts, answers = [words_of(t) for _, t in items], [answer_of(t) for _, t in items]
    parts, owner = [], []
    for k, words in enumerate(texts):
        parts += (own := indexed_passages(words))
        owner += [k] * len(own)
    latent = np.zeros((basis.shape[1], len(parts)), np.float32)
    floor = np.zeros(len(parts), np.float32)
    for c, words in enumerate(parts):
        _, f, x = weighted(read_words([b" ".join(words)]), idf)
        y = x @ basis[f]
        size = float(np.linalg.norm(y))
        latent[:, c] = y / max(size, 1e-12)
        filled = min(1.0, len(words) / PASSAGE_WORDS)  # share of a passage that the item can make up
        floor[c] = CANDIDATE * size * filled**0.5 if size > 1e-9 else -1.0  # an item outside the basis is always checked
    at = np.flatnonzero(basis.any(axis=1))
    row = np.full(FEATURES, len(at), np.int32)
    row[at] = np.arange(len(at))
    projection = np.vstack([basis[at] * idf[at, None], np.zeros((1, basis.shape[1]))]).astype(np.float32)
    return Index(projection, row, idf**2, latent, np.array(owner, np.int64), floor, grams_of(texts, answers), [i for i, _ in items], texts, answers)


def candidates(index: Index, w: Words) -> Iterator[tuple[int, int, int, float]]:
    """``(text, item, first word of the passage in the text, cosine)`` of all candidate passages, by text."""
    n, items = np.diff(w.bounds), len(index.ids)
    blocks = -(-n // BLOCK_WORDS)
    passages = np.where(blocks > 1, blocks - 1, blocks)
    block0, passage0 = np.cumsum(blocks) - blocks, np.cumsum(passages) - passages
    if not passages.sum():
        return
    text = np.repeat(np.arange(len(n)), passages)
    within = np.arange(len(text)) - passage0[text]
    # a passage is two neighbouring blocks, or the only one of its text
    low, high = block0[text] + within, block0[text] + within + (blocks[text] > 1)
    starts = np.repeat(w.bounds[:-1] - BLOCK_WORDS * block0, blocks) + BLOCK_WORDS * np.arange(blocks.sum())
    mass = np.add.reduceat(np.take(index.idf2, w.features), starts)
    size = np.sqrt(np.maximum(mass[low] + np.where(high > low, mass[high], 0), 1e-12))
    sums = _block_sums(index.projection, np.take(index.row, w.features), starts)
    sums = sums[low] + np.where((high > low)[:, None], sums[high], 0)

    hits = [t.hits(w) for t in index.grams]
    word, shared = (np.concatenate(x) for x in zip(*hits)) if hits else (np.array([], np.int64),) * 2
    at = np.searchsorted(w.bounds, word, side="right") - 1
    forced = (passage0[at] + np.minimum((word - w.bounds[at]) // BLOCK_WORDS, passages[at] - 1)) * items + shared
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, (1 << 22) // max(1, len(index.floor)))
    for lo in range(0, len(sums), step):
        cosine = sums[lo : lo + step] @ index.latent
        cosine /= size[lo : lo + step, None]
        p, c = np.nonzero(cosine >= index.floor)
        found.append(((p + lo) * items + index.owner[c], cosine[p, c]))
    key = np.concatenate([forced, *(k for k, _ in found)])
    value = np.concatenate([np.full(len(forced), -1, np.float32), *(x for _, x in found)])
    key, group = np.unique(key, return_inverse=True)
    best = np.full(len(key), -1, np.float32)
    np.maximum.at(best, group, value)
    for p, k, x in zip((key // items).tolist(), (key % items).tolist(), best.tolist()):
        if x == -1:
            lo, hi = np.searchsorted(index.owner, (k, k + 1))
            x = float((sums[p] @ index.latent[:, lo:hi]).max() / size[p])
        yield int(text[p]), k, int(within[p]) * BLOCK_WORDS, x


def _block_sums(projection: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of the words' rows of the projection (the last of which is zero) between consecutive ``starts``."""
    out = np.zeros((len(starts), projection.shape[1]), np.float32)
    n = np.diff(starts, append=len(rows))
    for lo in range(0, len(starts), _STEP_BLOCKS):
        at, size, part = starts[lo : lo + _STEP_BLOCKS], n[lo : lo + _STEP_BLOCKS], out[lo : lo + _STEP_BLOCKS]
        for j in range(BLOCK_WORDS):
            part += np.take(projection, np.where(j < size, np.take(rows, at + j, mode="clip"), len(projection) - 1), axis=0)
    return out


def verify(index: Index, item: int, words: list[bytes], first: int) -> tuple[float, float]:
    """Shares of the item and of its answer found in order around a candidate passage."""
    goal, answer = index.words[item], index.answers[item]
    reach = len(goal)
    near = words[max(0, first - reach) : first + PASSAGE_WORDS + reach]
    there = set(near)
    if sum(map(there.__contains__, goal)) < PARAPHRASED * len(goal):  # bounds the common subsequence
        return 0.0, 0.0
    known = set(goal)
    near = [w for w in near if w in known]
    share = lcs_length(goal, near) / len(goal)
    if share < PARAPHRASED:
        return share, 0.0
    return share, lcs_length(answer, near) / max(1, len(answer))


def matches(index: Index, w: Words) -> Iterator[tuple[int, int, float, float, float]]:
    """``(text, item, cosine, share, answer share)`` of each item that a text contains, by text and item."""
    if not index.ids:
        return
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    last, words = -1, []
    for t, k, first, cosine in candidates(index, w):
        if best.get((t, k), (0.0,))[:2] == (1.0, 1.0):  # nothing better can follow
            continue
        if t != last:
            last, words = t, w.of(t)
        share, answer = verify(index, k, words, first)
        if share >= COPIED or (share >= PARAPHRASED and answer >= ANSWERED):
            best[t, k] = max(best.get((t, k), (0.0, 0.0, 0.0)), (share, answer, cosine))
    for (t, k), (s, a, c) in sorted(best.items()):
        yield t, k, c, s, a


def _indexes(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str) -> Iterator[Index]:
    df, n = document_frequencies(docs, text_col)
    idf = inverse_frequencies(df, n)
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL").distinct()
    words = F.size(F.split("t", r"\s+")) + F.regexp_count("t", F.lit(f"[{UNSPACED}]"))
    columns = items.agg(F.sum(1 + F.floor(words / BLOCK_WORDS))).first()[0] or 0
    blocks = max(1, -(-columns // ITEM_BLOCK))
    # dealt out anew: two Python steps in one stage would be two workers for each task, and idle workers keep what they loaded
    basis = latent_basis(item_passages(items).repartition(SVD_TASKS * blocks), idf)
    block = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    for b in range(blocks):
        rows = items.where(block == b).collect()  # at most about ITEM_BLOCK passages of items
        yield build_index(sorted(((r["i"], r["t"]) for r in rows), key=lambda x: (x[0] is None, str(x[0]), x[1])), basis, idf)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """``(<id_col>, <item_col>, cosine, lcs_share, answer_share)`` for each item found in a document.

    Every passage of every whole text is compared with every item, by shared word
    n-grams (exactly) and by cosine; candidates are verified where they are found,
    so nothing but matches is shuffled.
    Null and empty texts and items match nothing; null ids and repeated documents are
    searched like others, equal items once; an empty table or benchmark gives an empty result.
    """
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType
    schema = f"id {kind}, item {item_kind.simpleString()}, cosine double, lcs_share double, answer_share double"
    spark, out = docs.sparkSession, None
    for index in _indexes(docs, benchmark, text_col, item_col, item_text):
        shared = spark.sparkContext.broadcast(index)  # FEATURES x RANK and at most about ITEM_BLOCK passages

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids = pa.array(shared.value.ids, to_arrow_type(item_kind))
            for b in batches:
                rows = [(first + t, *m) for first, w in read_batches(b.column(1)) for t, *m in matches(shared.value, w)]
                cols = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(cols[0], pa.int64())), ids.take(pa.array(cols[1], pa.int64())), *(pa.array(c, pa.float64()) for c in cols[2:])],
                    ["id", "item", "cosine", "lcs_share", "answer_share"],
                )

        part = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item is found, unchanged; the search is the same, without a join.

    Null and empty texts are kept, and so are all rows if the benchmark is
    empty; repeated rows go or stay together; other columns may have any names.
    """
    spark, at, kept = docs.sparkSession, docs.columns.index(text_col), docs
    for index in _indexes(docs, benchmark, text_col, item_col, item_text):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for first, w in read_batches(b.column(at)):
                    keep[[first + t for t, *_ in matches(shared.value, w)]] = False
                yield b.filter(pa.array(keep))

        kept = kept.mapInArrow(run, docs.schema)
    return kept


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all items; nulls, repeated rows and empty tables: as ``contaminated``."""
    return contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
