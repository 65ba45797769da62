from collections import Counter

import pytest
from oracle import SF, connect, same
from pyspark.sql import functions as F

from corvane.llm import mixing
from corvane.llm.mixing import mix, mix_positions, period_schedule


def test_query_matches_sql(spark):
    same(mixing.op1_mix_sources(spark, SF), mixing.SQL, connect())


def test_ties_are_broken_as_in_the_sql(spark, tmp_path):
    import duckdb

    rows = [(1, "b", "src0"), (1, "a", "src0"), (1, None, "src0"), (1, "", "src0"), (None, "x", None), (None, "y", None), (7, "c", "src3"), (7, "c", "src3"), (2, "d", "src0")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    same(mixing.op1_mix_sources(spark, str(tmp_path)), mixing.SQL, c)


def test_written_rows_lie_in_mixed_order(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    want = [r.row.doc_id for r in sorted(mix_positions(docs, mixing.WEIGHTS, mixing.REST).collect(), key=lambda r: r.mix_pos)]
    mix(docs, mixing.WEIGHTS, mixing.REST).write.parquet(f"{tmp_path}/m")
    laid = spark.read.parquet(f"{tmp_path}/m").selectExpr("doc_id", "_metadata.file_name AS f", "_metadata.row_index AS i").collect()
    assert [r.doc_id for r in sorted(laid, key=lambda r: (r.f, r.i))] == want and len({r.f for r in laid}) > 1


def test_many_sources(spark):
    rows = [(i, "t", f"s{i % 300}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    weights = {f"s{k}": 1 + k % 7 for k in range(299)}
    out = sorted(mix_positions(docs, weights, 2, block_rows=2).collect(), key=lambda r: r.mix_pos)
    assert [r.mix_pos for r in out] == list(range(3000)) and len({r.pool for r in out}) == 300
    total, done, blocks = sum(weights.values()) + 2, Counter(), set()
    for r in out:  # the shares hold as long as no source is used up
        if (r.pool, r.block) not in blocks and r.slot < 2 * total // 3:
            blocks.add((r.pool, r.block))
            done[r.pool] += 1
            assert abs(done[r.pool] - weights.get(r.pool, 2) * (r.slot + 1) / total) < 1


@pytest.mark.parametrize("weights", [[1], [1, 1], [5, 3, 1], [7, 2, 2, 1], [20, *[4] * 20]])
def test_schedule_keeps_within_one_block(spark, weights):
    slots = sorted(period_schedule(spark, weights).collect())
    period, done = sum(weights), [0] * len(weights)
    assert [r.slot for r in slots] == list(range(period))
    for r in slots:
        assert r.nth == done[r.pool]
        done[r.pool] += 1
        assert all(abs(d - w * (r.slot + 1) / period) < 1 for d, w in zip(done, weights))
    assert done == weights


def test_prefixes_deviate_by_less_than_a_block(spark):
    rows = [(i, "t", "ab"[i % 4 == 0]) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = sorted((r.mix_pos, r.row.source) for r in mix_positions(docs, {"a": 3, "b": 1}, 1, block_rows=10).collect())
    assert [p for p, _ in out] == list(range(4000))
    seen = Counter()
    for n, (_, s) in enumerate(out[:2000], 1):  # both last so long; the unnamed pool is empty
        seen[s] += 1
        assert abs(seen["a"] - n * 3 / 4) < 20


def test_odd_rows(spark, odd_docs, no_docs):
    out = mix_positions(odd_docs, {"src0": 2}, 1, block_rows=2).collect()
    assert sorted(r.mix_pos for r in out) == list(range(odd_docs.count()))
    assert {r.pool for r in out} == {"src0", "*"}
    assert all((r.pool == "src0") == (r.row.source == "src0") for r in out)
    laid = mix(odd_docs, {"src0": 2}, 1)
    assert laid.columns == odd_docs.columns and laid.count() == odd_docs.count()
    assert mix(no_docs, {"src0": 2}, 1).count() == 0
    assert mix_positions(odd_docs, {}, 1).count() == odd_docs.count()


def test_rows_of_one_key_are_dealt_to_many_partitions(spark, tmp_path, monkeypatch):
    """Two thirds of all rows are the same document: still every place is given once, and rows lie in order."""
    rows = [(7, "the same", "a", k) for k in range(4000)] + [(10 + k, "t", "ab"[k % 2], k) for k in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, _metadata long").repartition(5).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        for few in (mixing.MOST_SEGMENTS, 0):
            monkeypatch.setattr(mixing, "MOST_SEGMENTS", few)
            out = mix_positions(docs, {"a": 3, "b": 1}, 1, block_rows=4)
            got = out.withColumn("part", F.spark_partition_id()).collect()
            assert [r.mix_pos for r in got] == list(range(6000))
            assert sorted(r.row["_metadata"] for r in got) == sorted(r[3] for r in rows)
            sizes = Counter(r.part for r in got)
            assert len(sizes) == 9 and max(sizes.values()) < 1.2 * 6000 / 9
            for source in "ab":
                own = [(r.block, r.slot) for r in got if r.row.source == source]
                assert [b for b, _ in own] == [k // 4 for k in range(len(own))] and own == sorted(own)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_whole_rows_are_shuffled_once(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = mix_positions(docs, mixing.WEIGHTS, mixing.REST)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") - plan.count("BroadcastExchange") - plan.count("Exchange hashpartitioning(pool") == 1, plan
    assert plan.count("REPARTITION_BY_NUM") == 1


def test_weights_are_checked(odd_docs):
    for weights, rest in (({"a": 0}, 1), ({"a": -1}, 1), ({"a": 1}, 0)):
        with pytest.raises(ValueError):
            mix_positions(odd_docs, weights, rest)
