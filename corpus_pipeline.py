"""A corpus pipeline over documents: quality, line dedup, near-duplicates, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import dropped, new_path, scratch, table, written
from corvane.llm.jaccard_join import drop_near_duplicates
from corvane.llm.line_dedup import line_dedup
from corvane.llm.mixing import REST, WEIGHTS, mix
from corvane.llm.quality import THRESHOLD, fit_quality, quality_score
from corvane.llm.sentencepiece_op import PieceTokenizer, default_model


GROUPS = 1000  # files whose rows are summed up in one task
MOST_FILES = 400_000  # whose places are broadcast


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold.

    Texts of any length are scored whole. Null and empty texts score 0.5 and go,
    as does everything where no label is known. Rows that repeat share their
    score; all columns pass whatever their names; an empty table stays empty.
    """
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return docs.where(quality_score(spark, model, docs["text"]) >= THRESHOLD)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of repeated three-line windows; documents that lose all their text go.

    Null and empty texts and texts of fewer than three lines stay as they are;
    texts of any length are taken whole. Rows of one doc_id are one document,
    of which none is later. All columns pass whatever their names (n_chars is
    counted again); an empty table stays empty.
    """
    return line_dedup(docs)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id, a null one last.

    Rows that repeat are copies of each other. Texts without words, null and
    empty ones are like nothing and all stay; texts of any length are compared
    whole. All columns pass whatever their names; an empty table stays empty.
    """
    return drop_near_duplicates(docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mix: by file name, then row.

    A null source is one of those not named. Rows that tie (the same doc_id)
    are ordered by text, repeated ones are interchangeable; null, empty and
    very long texts pass whole, as do all columns whatever their names. An
    empty table stays empty.
    """
    return mix(docs, WEIGHTS, REST)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, digests of them and of the text they decode to, and its place in the mix.

    A null text counts as empty, and has no ids; texts of any length are coded
    whole. Rows that repeat are coded each; other columns are left out; an empty
    table stays empty. The place is null if docs isn't a plain read of files.
    """
    codec = PieceTokenizer(spark, default_model())
    coded = _placed(docs).withColumn("coded", codec.both(F.coalesce("text", F.lit("")))).select("doc_id", "source", "mix_pos", "coded.ids", "coded.decoded")
    return coded.select(
        "doc_id",
        "source",
        "mix_pos",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _placed(docs: DataFrame) -> DataFrame:
    """doc_id, source and text with each row's place in the files read, taken in order of their part numbers and names.

    Files have one row each in a table of their sizes; running sums over it are
    made in two steps, by ranges of GROUPS part numbers, so that no task
    meets all files. That table is written and counted: up to MOST_FILES rows
    (some 50 MB) it is broadcast, so that no text is shuffled; beyond that it
    meets the rows in a plain join, with the same result.
    """
    try:
        rows = docs.select("doc_id", "source", "text", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:  # no plain read of files
        return docs.select("doc_id", "source", "text", F.lit(None).cast("long").alias("mix_pos"))
    sizes = docs.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    number = F.expr("coalesce(try_cast(regexp_extract(file, '^part-([0-9]+)', 1) AS BIGINT), 0)")
    grouped = sizes.withColumn("number", number).withColumn("group", F.expr(f"number div {GROUPS}"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)  # one row for each GROUPS files
    firsts = grouped.groupBy("group").agg(F.sum("n").alias("m")).select("group", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("group").orderBy("number", "file").rowsBetween(Window.unboundedPreceding, -1)
    starts = grouped.select("group", "file", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("start")).join(firsts, "group").select("file", (F.col("first") + F.col("start")).alias("start"))
    starts, _ = written(starts, "file-starts")
    if starts.count() <= MOST_FILES:
        starts = F.broadcast(starts)
    return rows.join(starts, "file").select("doc_id", "source", "text", (F.col("start") + F.col("row")).alias("mix_pos"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_repeated_lines),
    ("near_copies", keep_one_of_near_copies),
    ("mix", mix_to_weights),
    ("encode", encode),
]

#: Neither the classifier nor the encoding can be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What a stage and its operators have written is deleted once the next one's result is written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            dropped(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
