"""Rendezvous sharding: stability, weights, slots and odd rows."""

import math
import zlib
from collections import Counter

import xxhash

from fixtures import no_docs, odd_docs, odd_rows
from varlex.llm import sharding


def shard_of(spark, keys, weights):
    table = spark.createDataFrame([(k,) for k in keys], "key long")
    return {r["key"]: r["shard"] for r in table.select("key", sharding.rendezvous(table.key, weights).alias("shard")).collect()}


def test_shards_equal_a_plain_version(spark):
    def plain(key, weights):
        best = None
        for shard, weight in enumerate(weights):
            # Spark's hash of (long, int): the first hash seeds the second.
            h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
            h = xxhash.xxh64_intdigest(shard.to_bytes(4, "little"), h)
            unit = ((h >> 11) + 0.5) / 2.0**53
            score = (weight / -math.log(unit), -shard)
            best = max(best, score) if best else score
        return -best[1]

    weights = [1.0, 2.5, 1.0, 0.5]
    found = shard_of(spark, range(300), weights)
    assert found == {k: plain(k, weights) for k in range(300)}


def test_one_more_shard_takes_rows_only_into_itself(spark):
    before, after = (shard_of(spark, range(4000), [1.0] * n) for n in (24, 25))
    moved = {k for k in before if before[k] != after[k]}
    assert {after[k] for k in moved} == {24}
    assert 0.5 / 25 < len(moved) / 4000 < 2 / 25


def test_weights_share_out_the_keys_and_moves_stay_with_the_changed_shard(spark):
    found = shard_of(spark, range(6000), [1.0, 3.0, 2.0])
    counts = Counter(found.values())
    assert abs(counts[1] / 6000 - 0.5) < 0.03 and abs(counts[2] / 6000 - 1 / 3) < 0.03
    changed = shard_of(spark, range(6000), [1.0, 3.0, 4.0])
    assert {changed[k] for k in found if found[k] != changed[k]} == {2}


def test_odd_rows(spark):
    for block_rows in (sharding.BLOCK_ROWS, 1):
        found = sharding.assign_shards(odd_docs(spark), [1.0] * 3, block_rows=block_rows).collect()
        size = lambda t: len((t or "").encode()) + 8
        expected = [(r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in odd_rows()]
        assert sorted(map(str, expected)) == sorted(str(tuple(r)[:3]) for r in found)
        for shard in range(3):
            slots = sorted(r["slot"] for r in found if r["shard"] == shard)
            assert slots == list(range(len(slots)))
        by_key = {}
        for r in found:
            assert r["law"] == "key" and by_key.setdefault(r["doc_id"], r["shard"]) == r["shard"]
            assert r["grown_shard"] in (r["shard"], 3)
    assert sharding.assign_shards(no_docs(spark)).count() == 0


def test_many_repeats_of_one_row_get_their_own_slots(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPEAT", 7)
    table = spark.createDataFrame([(5, "same")] * 100 + [(6, "other")] * 3, "doc_id long, text string")
    found = sharding.assign_shards(table, [1.0]).collect()
    assert sorted(r["slot"] for r in found) == list(range(103))
    assert Counter(r["doc_id"] for r in found) == {5: 100, 6: 3}
