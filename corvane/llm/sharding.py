"""Operator 12: shards by jump consistent hashing, written as files that hold each shard's rows in order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, IntegerType, IntegralType, LongType, StructType
from pyspark.sql.window import Window

from corvane.llm.common import bounded_batches, new_path, table, written
from corvane.llm.crc import crc32_sql

SHARDS = 24
LAW = "key"
ROW_BYTES = 8  # counted for each row beside its text
MOST_RUNS = 400_000  # runs of rows up to which their offsets are broadcast
_STEP = 2862933555777941757


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: the last place below shards that its sequence of pseudo-random jumps lands on."""
    out = np.zeros(len(keys), np.int64)
    at, key, jumped = np.arange(len(keys)), keys.astype(np.int64).view(np.uint64), np.zeros(len(keys), np.int64)
    while len(at):
        out[at] = jumped
        with np.errstate(over="ignore"):
            key = key * np.uint64(_STEP) + np.uint64(1)
        jumped = np.floor((jumped + 1) * (2.0**31 / ((key >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        on = jumped < shards
        at, key, jumped = at[on], key[on], jumped[on]
    return out


def stable_key(key: Column, kind: DataType) -> Column:
    """64 bits of a key: whole numbers as they are, anything else hashed; a null is 0."""
    return F.when(key.isNull(), F.lit(0).cast("long")).otherwise(key.cast("long") if isinstance(kind, IntegralType) else F.xxhash64(key.cast("string")))


def shard_of(key: Column, shards: int) -> Column:
    """The shard (int) of a column of 64-bit keys."""
    if shards < 1:
        raise ValueError("there must be a shard")
    return F.arrow_udf(lambda keys: pa.array(jump(keys.to_numpy(zero_copy_only=False), shards), pa.int32()), "int")(key)


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id") -> None:
    """docs as Parquet files below path, one folder for each shard that has rows, as (place, row): the row's place among all and all its columns.

    A row's shard depends on its key and the number of shards alone, so with one
    more shard rows only move into that one. Within a shard rows are in order of
    key (null first), then of the text's size and checksum; rows that are equal
    in these go in any order. Ranges of that order are dealt to tasks, ending in
    the row's number in the scan, so neither a large shard nor a key that repeats
    fills a task; each task adds to few shards. One shuffle of whole rows.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), shard_of(stable_key(F.col(key), docs.schema[key].dataType), shards).alias("shard"), F.col(key).alias("own_key"), F.octet_length(text).alias("size"), F.crc32(text).alias("crc"), F.monotonically_increasing_id().alias("tie"))
    order = ("shard", "own_key", "size", "crc", "tie")
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.select(F.monotonically_increasing_id().alias("place"), "row", "shard").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, row_type: StructType) -> DataFrame:
    """``shard``, ``slot`` and ``row`` of shards that write_shards has written: slots are places in the shard, without gaps from 0.

    A task's rows of one shard are an unbroken run of places. Runs are counted
    first; a sum over the runs of a shard, which are as many as tasks wrote to
    it, gives each its first slot, and no row is shuffled for it.
    """
    rows = spark.read.schema(StructType().add("place", LongType()).add("row", row_type).add("shard", IntegerType())).parquet(path)
    run = F.shiftright("place", 33)
    runs = rows.groupBy("shard", run.alias("run")).agg(F.min("place").alias("least"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts, _ = written(runs.select(F.col("shard").alias("its_shard"), "run", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("least")).alias("shift")), "shard-runs")
    few = starts.count() <= MOST_RUNS
    joined = rows.join(F.broadcast(starts) if few else starts, (F.col("shard") == F.col("its_shard")) & (run == F.col("run")))
    return joined.select("shard", (F.col("place") + F.col("shift")).alias("slot"), "row")


def shard_documents(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """``row`` (every input column), ``shard``, ``slot`` and ``grown_shard`` (the shard if there were one more) of each input row, read from its shard's files.

    The text's size and checksum only order rows of one key. A null key is 0, a
    null text is empty; texts of any length are taken whole; rows that repeat
    have slots of their own; an empty table gives no rows; other columns pass in
    ``row`` whatever their names.
    """
    spark = docs.sparkSession
    path = new_path(spark, "shards")
    write_shards(docs, path, shards, key)
    laid = read_shards(spark, path, docs.schema)
    return laid.withColumn("grown_shard", shard_of(stable_key(F.col("row").getField(key), docs.schema[key].dataType), shards + 1))


def op12_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' shards, with size and checksum of the texts that the shards' files hold."""
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return shard_documents(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit(LAW).alias("law"), "shard", "slot", "grown_shard"
    )


SQL = f"""
    WITH RECURSIVE {crc32_sql("SELECT DISTINCT coalesce(text, '') AS s FROM documents")},
    k AS (SELECT DISTINCT doc_id, (coalesce(doc_id, 0)::HUGEINT + 18446744073709551616) % 18446744073709551616 AS key FROM documents),
    r(doc_id, shards, key, b, j) AS (
        SELECT doc_id, shards, key, -1::BIGINT, 0::BIGINT FROM k, (VALUES ({SHARDS}), ({SHARDS + 1})) n(shards)
        UNION ALL
        SELECT doc_id, shards, next, j, floor((j + 1) * (2147483648::DOUBLE / (next // 8589934592 + 1)::DOUBLE))::BIGINT
        FROM (SELECT *, (key * {_STEP} + 1) % 18446744073709551616 AS next FROM r WHERE j < shards)
    ),
    a AS (SELECT a.doc_id, a.b AS shard, g.b AS grown FROM r a JOIN r g ON a.doc_id IS NOT DISTINCT FROM g.doc_id
          WHERE a.shards = {SHARDS} AND a.j >= a.shards AND g.shards = {SHARDS + 1} AND g.j >= g.shards)
    SELECT d.doc_id, CAST(octet_length(encode(crc.s)) + {ROW_BYTES} AS BIGINT) AS size, CAST(crc.crc AS BIGINT) AS text_crc32, '{LAW}' AS law, CAST(shard AS INTEGER) AS shard,
           row_number() OVER (PARTITION BY shard ORDER BY d.doc_id NULLS FIRST, octet_length(encode(crc.s)), crc.crc) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
    FROM documents d JOIN crc ON crc.s = coalesce(d.text, '') JOIN a ON a.doc_id IS NOT DISTINCT FROM d.doc_id
"""
