import zlib

import pytest

from toposcan.llm.sharding import layout, place, shard_documents


def shards(spark, n, tree):
    return {r.id: r.s for r in place(spark.range(n), "id", tree, "s").collect()}


def test_growth_moves_rows_only_into_the_new_shard(spark):
    before = shards(spark, 20_000, layout(16))
    for n in (17, 18, 19):
        after = shards(spark, 20_000, layout(n))
        moved = {k for k in before if before[k] != after[k]}
        assert {after[k] for k in moved} == {n - 1}
        assert abs(len(moved) - 20_000 / n) < 200
        before = after


def test_a_weight_moves_rows_only_across_its_subtree(spark):
    even, heavy = shards(spark, 20_000, layout(16)), shards(spark, 20_000, layout(16, weights={5: 3.0}))
    region = lambda s: s // 8
    rack = lambda s: s // 4
    for k in even:
        if even[k] != heavy[k]:
            assert region(heavy[k]) == region(5)
            assert region(even[k]) != region(5) or rack(heavy[k]) == rack(5)
    share = sum(s == 5 for s in heavy.values()) / 20_000
    assert share == pytest.approx(3 / 18, abs=0.02)
    assert 3 not in set(shards(spark, 2_000, layout(4, weights={3: 0.0})).values())


def test_places_sizes_and_slots(docs):
    long = "é" * 70_000
    rows = [(i, f"t{i}") for i in range(300)] + [(None, "x"), (None, None), (7, "t7"), (1000, long), (1001, "")]
    out = shard_documents(docs(*rows)).collect()
    assert len(out) == len(rows) and {r.law for r in out} == {"key"}
    for r in out:
        assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16)
    for s in range(16):
        own = sorted(r.slot for r in out if r.shard == s)
        assert own == list(range(len(own)))
    sizes = {r.doc_id: (r.size, r.text_crc32) for r in out if r.doc_id is not None}
    assert sizes[1000] == (140_001, zlib.crc32(long.encode())) and sizes[1001] == (1, 0)
    assert shard_documents(docs().limit(0)).count() == 0


def test_slots_over_many_buckets(spark):
    from toposcan.llm.common import numbered

    df = spark.range(5_000).selectExpr("id", "if(id % 3 = 0, id % 5, 0) g")
    out = numbered(df, ["g"], ["id"], "n", per_bucket=100).collect()
    for g in range(5):
        own = sorted(r.n for r in out if r.g == g)
        assert own == list(range(len(own)))
