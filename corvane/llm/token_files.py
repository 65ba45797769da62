"""Operator 7: token counts of flat, unindexed token files, by a scan for end-of-document ids."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import bounded_batches, dropped, new_path, table, written
from corvane.llm.piece_codec import PieceModel, codec_of, load_model
from corvane.llm.sentencepiece_op import default_model

END_ID = 2  # </s> of the model used here
BLOCK_TOKENS = 1 << 19


def id_bytes(model: PieceModel) -> int:
    """Bytes of an id in token files: 2 for vocabularies that fit them, else 4."""
    return 2 if len(model.pieces) <= 1 << 16 else 4


def write_token_files(docs: DataFrame, path: str, model_path: str, end_id: int = END_ID, folders: tuple[str, ...] = (), order: tuple[str, ...] = ()) -> None:
    """Token files of docs' texts: little-endian ids of id_bytes bytes, each document followed by end_id, and nothing else.

    One file for each of docs' partitions, its rows in their order; with folders
    (columns), one for each of their values in it, its rows by order. A null text
    has no tokens, a text of any length is encoded whole. Spark's text writer
    puts the end id after each row, so any store that Spark knows will do; its
    bytes must be a text of their own.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    loaded = load_model(model_path)
    width = id_bytes(loaded)
    mark = end_id.to_bytes(width, "little")
    if loaded.kinds[end_id] != 3 or max(mark) >= 0x80:
        raise ValueError("the end id must be a control id whose bytes are below 128")
    model = spark.sparkContext.broadcast(loaded)

    def tokens(texts: pa.Array) -> pa.Array:
        codec = codec_of(model.value)
        return pa.array([np.frombuffer(codec.encode(x or ""), np.int32).astype(f"<u{width}").tobytes() for x in texts.to_pylist()], pa.binary())

    rows = docs.select(*folders, *order, F.arrow_udf(tokens, "binary")("text").cast("string").alias("value"))
    if folders:
        rows = rows.sortWithinPartitions(*folders, *order).select(*folders, "value")
    rows.write.partitionBy(*folders).option("lineSep", mark.decode("ascii")).text(path)


def open_anywhere(path: str) -> BinaryIO:
    """A file of a local disk, HDFS, S3, GCS or Azure, to be read at any place."""
    from pyarrow.fs import FileSystem, LocalFileSystem

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    store, inside = FileSystem.from_uri(path.replace("s3a:", "s3:", 1))
    return store.open_input_file(inside)


def _scan(root: str, end_id: int, width: int, step: int, opener: Callable[[str], BinaryIO]):
    """For each block: its tokens and end ids, where the last of those is, and the tokens before each counted from the block's start or the end id before it."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, path = None, None
        for b in batches:
            for name, length, block in zip(*(b.column(c).to_pylist() for c in ("path", "length", "block"))):
                if name != path:
                    if file:
                        file.close()
                    file, path = opener(name), name
                file.seek(block * step)
                data = file.read(min(step, length - block * step))
                if len(data) != min(step, length - block * step):
                    raise ValueError(f"{name} is shorter than it was listed")
                ids = np.frombuffer(data, f"<u{width}")
                gaps = np.diff(np.flatnonzero(ids == end_id), prepend=-1).astype(np.int32) - 1
                file_name = name.removeprefix(f"{root}/") if name.startswith(f"{root}/") else name.rsplit("/", 1)[-1]
                columns = [[file_name], [block], [len(ids)], [len(gaps)], [int(gaps.sum(dtype=np.int64)) + len(gaps)], [gaps]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), *[pa.int64()] * 4, pa.list_(pa.int32())))], ["file", "block", "size", "ends", "until", "gaps"])
        if file:
            file.close()

    return scan


def count_tokens(
    spark: SparkSession, path: str, end_id: int = END_ID, width: int = 2, block_tokens: int = BLOCK_TOKENS, opener: Callable[[str], BinaryIO] = open_anywhere
) -> DataFrame:
    """``file`` (its path below path), ``nth`` (from 0) and ``n_tokens`` of each document in the token files below path.

    Spark lists the files; their blocks, cut whatever lies at their edges, are
    dealt to all tasks, so files may be of any size. Each task reads only its
    blocks, by opener(path) (other stores than open_anywhere's need their own),
    and searches them for the end id by array operations. A prefix scan over the
    blocks of a file stitches documents that cross edges, however many: what a
    block carries in is all tokens since the last end id before it. Only the
    blocks' sizes go through that scan, one row each. The end id
    itself doesn't count. Tokens after a file's last end id are a document of
    their own; documents of no tokens count as such. An empty file has none, an
    empty folder gives no rows. A number of bytes that isn't a multiple of width
    is an error, as is a file that got shorter after it was listed.
    """
    bounded_batches(spark)
    step = width * block_tokens
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").where("length > 0")
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(length - 1) div {step}"))).alias("block"))
    dealt = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "block")
    scan = _scan(_qualified(spark, path), end_id, width, step, opener)
    scanned, scan_path = written(dealt.mapInArrow(scan, "file string, block long, size long, ends long, until long, gaps array<int>"), "token-blocks")
    # Prefix scan: tokens before a block, end ids before it, and where the last of those was.
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sized = scanned.select("file", "block", "size", "ends", "until").withColumn("start", F.coalesce(F.sum("size").over(before), F.lit(0)))
    closed = sized.withColumn("last_end", F.when(F.col("ends") > 0, F.col("start") + F.col("until")))
    carried = closed.select("file", "block", F.coalesce(F.sum("ends").over(before), F.lit(0)).alias("done"), (F.col("start") - F.coalesce(F.max("last_end").over(before), F.lit(0))).alias("carry"))
    placed = scanned.select("file", "block", "gaps").where(F.size("gaps") > 0).join(carried, ["file", "block"])
    docs = placed.select("file", "done", "carry", F.posexplode("gaps").alias("i", "gap")).select(
        "file", (F.col("done") + F.col("i")).alias("nth"), (F.col("gap") + F.when(F.col("i") == 0, F.col("carry")).otherwise(0)).cast("long").alias("n_tokens")
    )
    rest = closed.groupBy("file").agg(F.sum("size").alias("all"), F.sum("ends").alias("nth"), F.max("last_end").alias("closed"))
    tail = rest.select("file", "nth", (F.col("all") - F.coalesce("closed", F.lit(0))).alias("n_tokens")).where("n_tokens > 0")
    counted, _ = written(docs.unionByName(tail), "token-counts")
    dropped(spark, scan_path)
    return counted


def _qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's own readers name it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toString()


def write_placed_tokens(docs: DataFrame, path: str, model_path: str) -> None:
    """Token files of docs, a plain scan of Parquet files: a folder for each split of a file, with its rows in the file's order."""
    meta = docs.metadataColumn("_metadata")
    placed = docs.select(F.col("text"), F.md5(meta["file_path"]).alias("source"), meta["file_block_start"].alias("start"), meta["row_index"].alias("at"))
    write_token_files(placed, path, model_path, folders=("source", "start"), order=("at",))


def document_tokens(docs: DataFrame, model_path: str, opener: Callable[[str], BinaryIO] = open_anywhere) -> DataFrame:
    """``doc_id`` and ``n_tokens`` of each row of docs, which must be a plain scan of Parquet files.

    Writes token files to the shared folder and counts what is in them, reading
    them by opener (see count_tokens). They hold no index; a row is known by its
    file and its number in it: the files' folders name the file and the byte at
    which a split began, splits of a file follow one another, and counts of the
    splits before give the rest. So it doesn't matter how either scan is cut, or
    whether the cluster's size changes between them. That each file has as many
    rows as its token files have documents is checked: a table that changes is an
    error. Null and empty texts have no tokens; rows that repeat are counted
    each; texts of any length are taken whole; an empty table stays empty;
    columns other than doc_id and text aren't looked at, whatever their names.
    """
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_placed_tokens(docs, path, model_path)
    counted = count_tokens(spark, path, width=id_bytes(load_model(model_path)), opener=opener)
    dropped(spark, path)
    return placed_counts(docs, counted)


def placed_counts(docs: DataFrame, counted: DataFrame) -> DataFrame:
    """doc_id and n_tokens of each row of docs, by its place in the files that write_placed_tokens has read."""
    part = r"^source=([0-9a-f]+)/start=(\d+)/"
    named = counted.select("file", "nth", "n_tokens", F.regexp_extract("file", part, 1).alias("source"), F.regexp_extract("file", part, 2).cast("long").alias("start"))
    before = Window.partitionBy("source").orderBy("start", "file").rowsBetween(Window.unboundedPreceding, -1)
    splits = named.groupBy("source", "start", "file").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = named.join(splits.select("file", "before"), "file").select("source", (F.col("before") + F.col("nth")).alias("at"), "n_tokens")
    meta = docs.metadataColumn("_metadata")
    rows = docs.select("doc_id", F.md5(meta["file_path"]).alias("source"), meta["row_index"].alias("at"))
    sizes = [x.groupBy("source").agg(F.count(F.lit(1)).alias(f"n_{i}")) for i, x in enumerate((rows, found))]
    if not sizes[0].join(sizes[1], "source", "full").where(~F.col("n_0").eqNullSafe(F.col("n_1"))).isEmpty():
        raise RuntimeError("the table has changed since its token files were written")
    joined = rows.join(found, ["source", "at"], "left")
    return joined.select("doc_id", F.coalesce("n_tokens", F.raise_error(F.lit("a row has no document in the token files")).cast("long")).alias("n_tokens"))


def op7_token_counts(spark: SparkSession, sf_dir: str, opener: Callable[[str], BinaryIO] = open_anywhere) -> DataFrame:
    return document_tokens(table(spark, sf_dir, "documents"), default_model(), opener)
