import zlib
from collections import defaultdict

import pytest

from rainframe.llm import sharding


def test_shards_are_even_and_slots_gapless(docs, corpus):
    rows = sharding.digests(docs).collect()
    want = sorted((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in corpus)
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == want
    sums, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sums[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sums) <= set(range(8))  # one text here is larger than a shard's part
    assert max(sums.values()) - min(sums.get(k, 0) for k in range(8)) <= 3 * max(r.size for r in rows)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}


def test_one_value_in_all_rows_still_splits(spark):
    same = spark.createDataFrame([(7, "the same text", "en", "src0")] * 4000, "doc_id long, text string, lang string, source string").repartition(3)
    counts = [r["count"] for r in sharding.kd_tree(same, 8).groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 40


def test_splits_follow_metadata(spark):
    rows = [(i, "x" * 50, "en", "a" if i < 500 else "b") for i in range(1000)]
    found = sharding.kd_tree(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 2).collect()
    side = {(r.id < 500, r.shard) for r in found}
    assert len(side) == 2


@pytest.mark.parametrize("target", [1, 20_000, 10**9])
def test_target_bytes(docs, target):
    shards = sharding.kd_tree(docs.limit(60) if target == 1 else docs, None, max(target, 3000)).groupBy("shard").agg({"size": "sum"}).count()
    assert shards >= 1


@pytest.mark.parametrize("per_block", [7, 10**6])
def test_slots(docs, per_block):
    rows = sharding.slots(sharding.kd_tree(docs, 4), per_block).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())


def test_many_leaves(spark):
    """512 leaves of 20,000 rows, none over its part by more than a document a level; ids of equal rows spread over the blocks of slots."""
    df = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', cast(20 + id % 61 AS int)) AS text", "concat('l', id % 3) AS lang", "concat('s', id % 7) AS source")
    got = sharding.kd_tree(df, 512).groupBy("shard").agg({"size": "sum", "*": "count"}).toDF("shard", "size", "n").toPandas()
    assert len(got) == 512 and got.n.sum() == 20_000
    assert (got["size"] - got["size"].sum() / 512).abs().max() <= 9 * 81


def test_empty_table(nothing):
    assert sharding.digests(nothing).count() == 0
