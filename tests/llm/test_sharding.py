import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
from pyspark.sql import functions as F

from tidefold.llm import sharding
from tidefold.llm.sharding import op11_sharding, position, range_shards, shards_of, splitters_of, write_shards


SAME = "the same text " * 10


def checked(rows, shards=16):
    """Slots without gaps; the sizes by shard."""
    slots, sizes = defaultdict(list), Counter()
    for r in rows:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [sizes[s] for s in range(shards)]


def test_position_counts_splitters_at_or_below():
    rnd = random.Random(1)
    splitters = sorted({tuple(rnd.randrange(-3, 3) for _ in range(3)) for _ in range(60)})
    keys = [tuple(rnd.randrange(-4, 4) for _ in range(3)) for _ in range(500)]
    got = position([np.array(c) for c in zip(*splitters)], [np.array(c) for c in zip(*keys)])
    assert got.tolist() == [sum(s <= k for s in splitters) for k in keys]
    assert position([np.zeros(0, np.int64)] * 3, [np.array(c) for c in zip(*keys)]).tolist() == [0] * 500


def test_splitters_keep_groups_whole_unless_one_is_overfull():
    least = -(1 << 63)
    sample = sorted([((g, i, 0), 1.0) for g in range(20) for i in range(3)] + [((50, i, 0), 1.0) for i in range(40)])
    cuts = splitters_of(sample, 5.0)
    assert cuts == sorted(set(cuts))
    assert all(c[1:] == (least, least) for c in cuts if c[0] < 50) and sum(c[0] == 50 for c in cuts) > 5
    assert splitters_of([], 1.0) == []


def test_shards_prefer_edges_of_groups():
    least = -(1 << 63)
    out = shards_of([(1, 5, 0), (2, least, least), (3, 1, 0)], [1000, 5, 1000, 1], [1, 1, 1, 1], 2)
    assert out.shard == [0, 0, 1, 1] and out.offset == [0, 1, 0, 1]
    assert shards_of([], [7], [3], 4).offset == [0]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op11_sharding(spark, sf).collect()
    assert len(rows) == len(docs) == len({r.doc_id for r in rows})
    for r in rows:
        data = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(data) + 1, crc32(data), "bytes", None)
    sizes = checked(rows)
    largest = max(r.size for r in rows)
    assert max(sizes) - min(sizes) <= largest + 0.02 * sum(sizes) / 16


def test_hot_groups_are_divided_and_small_ones_stay_together(spark):
    rows = [(i, f"text {i} " + "x" * (i * 37 % 500)) for i in range(3000)] + [(10_000 + i, SAME) for i in range(4000)]
    rows += [(20_000 + i, f"pair {i // 2} " + "y" * 100) for i in range(1000)] + [(None, None)] * 700 + [(1, "")] * 300
    rows += [(30_000, "word " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS shard", "2 AS slot", "3 AS _k0", "4 AS _size").repartition(7)
    sized = sharding.sized(docs)
    out = range_shards(sized, "text", ["doc_id"], "size").collect()
    assert out[0].asDict().keys() == {"doc_id", "text", "_k0", "_size", "size", "shard", "slot"}
    sizes = checked(out)
    assert Counter((r.doc_id, r.text) for r in out) == Counter(rows)
    mean = sum(sizes) / 16
    assert max(sizes) < 1.02 * mean + 100_001 and sorted(sizes)[-2] < 1.05 * mean
    homes = defaultdict(set)
    for r in out:
        homes[r.text].add(r.shard)
    assert len(homes[SAME]) > 1
    assert sum(len(s) > 1 for t, s in homes.items() if t and t.startswith("pair")) == 0


def test_overfull_ranges_are_divided_again(spark, monkeypatch):
    monkeypatch.setattr(sharding, "OVERSAMPLING", 1)  # so coarse a sample leaves ranges that are too large
    monkeypatch.setattr(sharding, "RANGES_A_SHARD", 32)
    rows = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") % 97 + 1).alias("size"))
    keyed = rows.withColumns({"a": F.xxhash64("k"), "b": F.lit(0).cast("bigint"), "c": F.col("k")})
    plan = sharding.plan_ranges(keyed, ("a", "b", "c"), "size", 16)
    sizes = [r[1] for r in sharding._located(keyed, plan.splitters, ("a", "b", "c"), "r").groupBy("r").agg(F.sum("size")).collect()]
    total = sum(sizes)
    assert len(sizes) > 256 and max(sizes) <= 4 * total / 512
    dealt = checked(sharding._dealt(keyed, plan, ("a", "b", "c")).collect())
    assert max(dealt) - min(dealt) < 0.06 * total / 16


def test_few_rows_and_none(spark):
    docs = spark.createDataFrame([(i, "t" * i) for i in range(5)], "doc_id long, text string")
    assert len(range_shards(sharding.sized(docs), "text", ["doc_id"], "size").collect()) == 5
    assert range_shards(sharding.sized(docs.limit(0)), "text", ["doc_id"], "size").collect() == []


def test_files_hold_their_shard_in_order(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("_size", F.lit("x"))
    back = write_shards(docs, str(tmp_path / "shards"), shards=4)
    assert {p.name for p in (tmp_path / "shards").glob("shard=*")} == {f"shard={i}" for i in range(4)}
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in docs.collect())
    checked(sharding.sized(back).collect(), 4)
