"""SimHash near-duplicates: pigeonhole blocks, then Hamming verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm.common import fresh, row_key, stored, table, values
from tidefold.llm.components import connected_components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: 64 bits in five blocks; two differing bits leave at least three blocks equal.
BLOCKS = (13, 13, 13, 13, 12)
#: A block key shared by more fingerprints than this takes the linear way.
CROWDED = 48
_STEP = 1 << 16

#: Similar texts: five-word shingles at a Jaccard similarity of 0.8 differ in 39 of 256 bits (the angle of the cosine
#: 2 * 0.8 / 1.8), give or take 6 for the random bits; the radius is one such deviation wider.
SIMILAR_SHINGLE = 5
SIMILAR_BITS = 44
WIDE = ("w0", "w1", "w2", "w3")
#: Mean length of a piece.
PIECE_WORDS = 16
#: Such texts differ in some 10 +- 3 bits of the 64-bit fingerprint, unrelated ones in 32 +- 4: pairs beyond this are not looked up.
SCREEN_BITS = 20
#: A piece of more than ``FEW`` fingerprints pairs each of them with its middle and ``CENTRES`` others instead of with all.
FEW, CENTRES = 24, 4


def _words(text: str | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, runs of anything but ASCII white space (``bytes.lower`` and ``bytes.split`` do just that)."""
    return text.encode().lower().split() if text else []


def _shingles(words: list[bytes], shingle: int) -> tuple[bytes, np.ndarray, list[int], np.ndarray]:
    """Joined words, their starts, the ends of all shingles and the shingles' hashes; a shorter text is one shingle."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    stops = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts.tolist(), stops)), np.uint64, len(stops))
    return joined, starts, stops, hashes


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), _STEP):
        bits = np.unpackbits(hashes[i : i + _STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of word shingles, repeats included; zero if there is no word."""
    words = _words(text)
    return _majority(_shingles(words, shingle)[3]) if words else 0


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit words (xor-shifts and odd multipliers)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def wide_print(text: str | None) -> tuple[int, list[int], list[int]]:
    """``(fingerprint, four words of a 256-bit SimHash of five-word shingles, digests of the text's pieces)``.

    The hash of five words is mixed from those of the two three-word shingles
    that make it up.  A piece ends with any three-word shingle whose hash has
    four certain bits clear, every 16 words on average, so that a changed word
    changes its own piece and seldom another.  No word: zeros and no piece.
    """
    words = _words(text)
    if not words:
        return 0, [0] * len(WIDE), []
    joined, starts, stops, three = _shingles(words, SHINGLE)
    five = _mix(three[:-2] * np.uint64(3) + _mix(three[2:])) if len(words) >= SIMILAR_SHINGLE else np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    wide = [_majority(_mix(five + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64)))) for i in range(len(WIDE))]
    cuts = np.flatnonzero((three >> np.uint64(40)) % np.uint64(PIECE_WORDS) == 0).tolist()
    edges = sorted({0, len(joined), *(stops[i] for i in cuts)})
    pieces = {_signed(xxhash.xxh64_intdigest(joined[s:e].strip(), SEED)) for s, e in zip(edges, edges[1:])}
    return _majority(three), wide, sorted(pieces)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _masks() -> list[int]:
    blocks, at = [], 0
    for width in BLOCKS:
        blocks.append(((1 << width) - 1) << at)
        at += width
    return [_signed(sum(c)) for c in combinations(blocks, len(BLOCKS) - MAX_BITS)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(id, rk, fp long)``, one row per input row; ``rk`` is a 128-bit key of id and text, the text itself goes no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [_signed(fingerprint(t, shingle)) for t in values(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fps, pa.int64())], ["id", "rk", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, rk struct<a:bigint,b:bigint>, fp bigint")


def wide_prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, rk, fp, w0..w3, parts array<long>)``: as ``fingerprints``, with what ``similar_links`` needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [wide_print(t) for t in values(batch.column(2))]
            words = [pa.array([_signed(d[1][i]) for d in done], pa.int64()) for i in range(len(WIDE))]
            fps, parts = pa.array([_signed(d[0]) for d in done], pa.int64()), pa.array([d[2] for d in done], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps, *words, parts], ["id", "rk", "fp", *WIDE, "parts"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), row_key(id_col, text_col).alias("rk"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, rk struct<a:bigint,b:bigint>, fp bigint, {', '.join(f'{w} bigint' for w in WIDE)}, parts array<bigint>")


def links(distinct: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the ``fp`` values at two or fewer bits.

    Each fingerprint is put under ten keys (three of its five blocks).  A key
    with few members gives their pairs, verified by Hamming distance.  The
    members of a crowded key are instead put under all values at one bit or
    less; two fingerprints have such a value in common exactly if they differ in
    at most two bits, so a star from the smallest member of each value connects
    the same groups with a number of rows linear in the members.
    """
    keys = distinct.select(
        "fp",
        F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(_masks())])).alias("k"),
    ).select("fp", "k.c", "k.key")
    # a table of its own, so that the rows of a key with very many can be split in the join
    counts = stored(keys.groupBy("c", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    shared = stored(keys.join(counts, ["c", "key"]), "blocks")
    few = shared.where(F.col("n") <= CROWDED)
    pairs = (
        few.select("c", "key", F.col("fp").alias("a"))
        .join(few.select("c", "key", F.col("fp").alias("b")), ["c", "key"])
        .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS))
        .select("a", "b")
    )
    around = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]
    near = shared.where(F.col("n") > CROWDED).select("fp").distinct().select("fp", F.explode(F.array(*around)).alias("z"))
    centre = near.groupBy("z").agg(F.min("fp").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("z", "a")
    stars = (
        near.join(centre, "z")
        .where((F.col("a") < F.col("fp")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("fp"))) <= MAX_BITS))
        .select("a", F.col("fp").alias("b"))
    )
    return pairs.unionByName(stars)


def similar_links(prints: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` between fingerprints of similar texts, from ``wide_prints``.

    The pigeonhole argument once more, on the text: among more pieces than
    changes one stays equal, so texts meet in the pieces that they have in
    common, and the wide fingerprints are compared by Hamming distance.  A piece
    of many texts (a passage of unrelated ones, or a large group of near copies)
    pairs each with the member nearest to the majority of their fingerprints,
    which is the text that a group of near copies surrounds, and with ``CENTRES``
    members chosen by a hash, others for each piece, so that rows stay linear in
    the members.  Links of 0.8 can be missed only where all pieces in common are
    of that kind; those of ``links`` can not.
    """
    pieces = prints.select("fp", F.explode("parts").alias("part")).distinct()
    pieces = stored(pieces, "pieces")
    # counts, majorities and centres are tables of their own, so that the rows of a very frequent piece can be split in the joins
    counts = stored(pieces.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "counts")
    shared = stored(pieces.join(counts, "part"), "shared")
    few, many = shared.where(F.col("n") <= FEW), shared.where(F.col("n") > FEW)
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= SCREEN_BITS
    pairs = few.select("part", F.col("fp").alias("a")).join(few.select("part", F.col("fp").alias("b")), "part").where((F.col("a") < F.col("b")) & close)
    ones = [F.sum(F.shiftright("fp", i).bitwiseAND(F.lit(1))).alias(f"s{i}") for i in range(64)]
    middle = reduce(Column.bitwiseOR, [F.when(2 * F.col(f"s{i}") > F.col("size"), F.lit(_signed(1 << i))).otherwise(F.lit(0)) for i in range(64)])
    majority = stored(many.groupBy("part").agg(F.count(F.lit(1)).alias("size"), *ones).select("part", middle.alias("middle")), "majority")
    chosen = [F.bit_count(F.col("fp").bitwiseXOR(F.col("middle")))] + [F.xxhash64("fp", "part", F.lit(i)) for i in range(CENTRES)]
    firsts = [F.min(F.struct(c.alias("h"), "fp"))["fp"] for c in chosen]
    # the join's rows go out before they are aggregated by the same key: an aggregation on top of a join keeps its keys together
    ranked = stored(many.join(majority, "part").select("part", "fp", "middle"), "ranked")
    centres = stored(ranked.groupBy("part").agg(F.array_distinct(F.array(*firsts)).alias("centres")), "centres")
    stars = (
        many.join(centres, "part")
        .select("fp", F.explode("centres").alias("c"))
        .where("fp <> c")
        .select(F.least("fp", "c").alias("a"), F.greatest("fp", "c").alias("b"))
        .where(close)
    )
    found = pairs.select("a", "b").unionByName(stars).distinct()
    # texts of one fingerprint are linked anyway: one of their wide prints stands for all
    wide = prints.groupBy("fp").agg(F.min(F.struct(*WIDE)).alias("w"))
    both = found.join(wide.select(F.col("fp").alias("a"), F.col("w").alias("x")), "a").join(wide.select(F.col("fp").alias("b"), F.col("w").alias("y")), "b")
    differing = sum((F.bit_count(F.col(f"x.{w}").bitwiseXOR(F.col(f"y.{w}"))) for w in WIDE), F.lit(0))
    return both.where(differing <= SIMILAR_BITS).select("a", "b")


def rooted(prints: DataFrame, similar: bool = False) -> DataFrame:
    """``(fp, root)``: the smallest fingerprint reachable from each distinct one."""
    distinct = stored(prints.select("fp").distinct(), "distinct")
    edges = links(distinct)
    nodes = connected_components(edges.unionByName(similar_links(prints)) if similar else edges)
    return distinct.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(<id_col>, fingerprint, component_id)``, one row per input row.

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` is the smallest
    id reachable over links of at most two differing bits.  Null or empty texts
    have fingerprint zero and are linked like any other; a null id is never the
    smallest (a component of null ids only has a null ``component_id``);
    repeated rows are repeated in the result; no rows give no rows.  Equal
    fingerprints are merged before anything is paired, so copies cost one row.
    """
    prints = stored(fingerprints(docs, id_col, text_col), "prints")
    roots = stored(rooted(prints), "roots")
    low = prints.groupBy("fp").agg(F.min("id").alias("low"))
    lowest = roots.join(low, "fp").groupBy("root").agg(F.min("low").alias("component_id"))
    member = roots.join(lowest, "root").select("fp", "component_id")
    return prints.join(member, "fp").select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        "component_id",
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: bool = False) -> DataFrame:
    """One document of each component stays, with all its columns: the one of the smallest id.

    With ``similar``, texts whose five-word shingles have a similarity of 0.8 or
    more (by the wide fingerprint) are linked too.  Null ids come last; of rows
    with equal id and text one stays; null and empty texts are one group; no
    rows give no rows.
    """
    rk = fresh(docs, "_rk")
    prints = stored((wide_prints if similar else fingerprints)(docs, id_col, text_col), "prints")
    roots = stored(rooted(prints, similar), "roots")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "rk")).alias("first")
    by_print = prints.groupBy("fp").agg(first)  # copies are reduced before they meet
    kept = roots.join(by_print, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.rk").alias(rk))
    out = docs.withColumn(rk, row_key(id_col, text_col)).join(kept, rk, "left_semi")
    return out.dropDuplicates([rk]).select(docs.columns)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their groups; nulls, repeated rows and empty tables: as ``simhash_components``."""
    return simhash_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
