import zlib

import numpy as np
import pytest
from oracle import SF, connect, same

from corvane.llm import sharding as module
from corvane.llm.common import new_path
from corvane.llm.sharding import jump, op12_shard_documents, shard_documents, write_shards


def plain_jump(key, shards):
    """The published loop, with whole numbers of any size."""
    key, b, j = key % 2**64, -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_query_matches_sql(spark):
    same(op12_shard_documents(spark, SF), module.SQL, connect())


def test_jumps_match_the_published_loop():
    keys = np.array([0, 1, 2, -1, -(2**63), 2**63 - 1, 123456789, *range(1000, 1200)], np.int64)
    for shards in (1, 2, 7, 24, 25, 1000, 1 << 20):
        assert jump(keys, shards).tolist() == [plain_jump(int(k), shards) for k in keys]


def test_growth_moves_rows_into_the_new_shard_only():
    keys = np.arange(200_000, dtype=np.int64)
    for shards in (1, 24, 99):
        now, grown = jump(keys, shards), jump(keys, shards + 1)
        assert np.all((now == grown) | (grown == shards))
        assert abs(np.mean(now != grown) - 1 / (shards + 1)) < 0.01
    share = np.bincount(jump(keys, 24)) / len(keys)
    assert share.min() > 0.9 / 24 and share.max() < 1.1 / 24


def check_slots(rows):
    by_shard = {}
    for r in rows:
        by_shard.setdefault(r.shard, []).append(r)
    for own in by_shard.values():
        own.sort(key=lambda r: r.slot)
        assert [r.slot for r in own] == list(range(len(own)))
        order = [(r.row.doc_id is not None, r.row.doc_id or 0, len((r.row.text or "").encode()), zlib.crc32((r.row.text or "").encode())) for r in own]
        assert order == sorted(order)


@pytest.mark.parametrize("partitions", [1, 7])
def test_odd_rows(spark, odd_docs, no_docs, partitions):
    out = shard_documents(odd_docs.repartition(partitions), 3).collect()
    assert sorted(map(repr, (r.row for r in out))) == sorted(map(repr, odd_docs.collect()))
    assert all(r.shard == plain_jump(r.row.doc_id or 0, 3) and r.grown_shard == plain_jump(r.row.doc_id or 0, 4) for r in out)
    check_slots(out)
    assert shard_documents(no_docs).count() == 0


def test_columns_named_as_the_operators_own(spark):
    df = spark.createDataFrame([(1, "a", 5, 6, "x", "y"), (2, None, 5, 6, "x", "y")], "doc_id long, text string, shard long, place long, `row` string, tie string")
    assert sorted(tuple(r.row) for r in shard_documents(df).collect()) == sorted(tuple(r) for r in df.collect())


def test_other_keys(spark):
    df = spark.createDataFrame([("k1", "a"), ("k1", "b"), (None, "c"), ("k2", "")], "url string, text string")
    out = shard_documents(df, 1000, "url").collect()
    assert len({r.shard for r in out if r.row.url == "k1"}) == 1 and len(out) == 4
    with pytest.raises(ValueError):
        shard_documents(df, 0, "url")


def test_a_key_of_most_rows_is_split(spark):
    """Rows of one key are dealt to several tasks and still have slots without gaps."""
    df = spark.range(4000).selectExpr("if(id % 4 = 0, id, 7) AS doc_id", "concat('text ', id % 50) AS text")
    path = new_path(spark, "shards-test")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        write_shards(df, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    laid = spark.read.schema("place long, shard int").parquet(path)
    runs = laid.where(f"shard = {plain_jump(7, 24)}").selectExpr("shiftright(place, 33) AS run").groupBy("run").count().collect()
    assert len(runs) > 1 and max(r["count"] for r in runs) < 2500
    check_slots(shard_documents(df).collect())
