"""Operator 10: removal of repeated three-line windows, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import table, written

WINDOW = 3
CHUNK_BITS, LEAST_BITS, MOST_BITS = 15, 20, 29  # powers of two: bits of one bitmap, and of all of them (64 MB at most)


def _windows(docs: DataFrame) -> DataFrame:
    """One row for each run of three lines: the document's key, the first line's number and a 128-bit hash."""
    lines = docs.select(
        F.col("doc_id").alias("id"),
        F.xxhash64("text").alias("twin"),
        F.transform(F.split("text", "\n", -1), lambda x: F.md5(x)).alias("h"),
    ).where(F.size("h") >= WINDOW)
    n = F.size("h") - (WINDOW - 1)
    runs = F.arrays_zip(*(F.slice("h", i + 1, n).alias(f"l{i}") for i in range(WINDOW)))
    each = lines.select("id", "twin", F.posexplode(runs).alias("pos", "run"))
    return each.select("id", "twin", "pos", F.unhex(F.md5(F.concat(*(F.col(f"run.l{i}") for i in range(WINDOW))))).alias("w"))


def _removals(docs: DataFrame) -> DataFrame:
    """For each document that loses lines: its key and the numbers of those lines.

    Windows that occur more than once are written first: Spark splits a join on
    a very common one only where neither side is an aggregate.
    """
    windows = _windows(docs)
    repeated, _ = written(windows.groupBy("w").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where("n > 1").drop("n"), "repeated")
    met = windows.join(repeated, "w")
    # The hash is made anew here: rows dealt by it already would be told apart where they are, and Spark couldn't split the join.
    found = met.select("id", "twin", "pos", F.substring("w", 1, 16).alias("w"), F.coalesce(~F.col("id").eqNullSafe(F.col("first")), F.lit(False)).alias("elsewhere"))
    in_doc = Window.partitionBy("id", "twin", "w").orderBy("pos")
    ranked = found.distinct().repartition("id", "twin").select(  # a row that is there twice adds nothing
        "id", "twin", "pos", "elsewhere", (F.rank().over(in_doc) > 1).alias("later"),
        (F.max("pos").over(in_doc.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) > F.col("pos")).alias("again"),
    )
    covers = lambda which: F.flatten(F.transform(F.collect_set(F.when(which, F.col("pos"))), lambda p: F.array(*(p + i for i in range(WINDOW)))))
    elsewhere, later = F.col("elsewhere"), F.col("later")
    here = F.array_except(covers(~elsewhere & later), covers(~elsewhere & ~later & F.col("again")))
    gone = F.array_union(covers(elsewhere), here)
    return ranked.groupBy("id", "twin").agg(gone.alias("gone")).where(F.size("gone") > 0)


def _marks(removals: DataFrame, place: Column) -> DataFrame:
    """Bitmaps (chunk, bits) of the places of the documents that lose lines."""
    chunk, bit = F.shiftright(place, CHUNK_BITS).alias("chunk"), place.bitwiseAND((1 << CHUNK_BITS) - 1)
    return removals.groupBy(chunk).agg(F.bitmap_construct_agg(bit).alias("bits"))


def _is_marked(place: Column) -> Column:
    """Whether the place's bit is set in its bitmap."""
    byte = F.substring("bits", F.shiftright(place.bitwiseAND((1 << CHUNK_BITS) - 1), 3).cast("int") + 1, F.lit(1))
    value = F.conv(F.hex(byte), 16, 10).cast("int")
    return F.coalesce(value.bitwiseAND(F.pow(F.lit(2), place.bitwiseAND(7)).cast("int")) > 0, F.lit(False))


def mark_repeated_lines(docs: DataFrame) -> DataFrame:
    """``row`` (every input column), ``n_lines``, ``n_removed`` and ``kept_text`` for each input row.

    Lines are what lies between line feeds. A window is three consecutive
    lines, equal where all three are equal exactly; it is repeated if it occurs
    more than once in the table. A line goes if a window that covers it occurs
    in a document of smaller doc_id, or further up in its own text; its first
    occurrence stays, as going back from repeat to repeat ends at a line that
    does. Windows that overlap their own repeats in one text keep their first
    occurrence, but not lines that come from another document. What a document
    loses doesn't depend on later ones, such as copies of it. Texts of fewer
    than three lines have no window and stay as they are, as do empty and null
    ones (0 lines for null). Rows of one doc_id are the same document: none is
    later than another, and a row that is there twice loses what it would lose
    alone, in both places. A null doc_id comes after all others. Texts of any
    length are taken whole; an empty table stays empty, and other columns pass
    in ``row`` whatever their names.

    Only (document, line number, hash) is shuffled to find repetitions, counted
    before the shuffle. A very common window spreads over tasks in the join,
    which Spark splits. Texts that lose lines are shuffled once, to meet their
    removals, and with them the few others that bitmaps of bounded size (16 bits
    for each such document, 64 MB at most) can't tell from them; the rest pass
    by. Beyond some 10^8 such documents the bitmaps let more and more through:
    results stay the same.
    """
    removals, _ = written(_removals(docs), "removals")
    wanted = 16 * max(1, removals.count())
    size = 1 << min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(wanted))))
    place = lambda a, b: F.pmod(F.xxhash64(a, b), F.lit(size))
    marks = _marks(removals, place("id", "twin"))
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), F.xxhash64("text").alias("own_twin"))
    placed = rows.withColumn("place", place("own_id", "own_twin"))
    met = placed.join(F.broadcast(marks), F.shiftright("place", CHUNK_BITS) == F.col("chunk"), "left").select(*rows.columns, _is_marked(F.col("place")).alias("marked"))
    may = met.where("marked").join(removals, F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_twin") == F.col("twin")), "left").select("row", "gone")
    rest = met.where("NOT marked").select("row", F.lit(None).cast("array<int>").alias("gone"))
    cut = may.unionByName(rest).select("row", "gone", F.split("row.text", "\n", -1).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n"))
    return cut.select(
        "row",
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        text.alias("kept_text"),
    )


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with repeated lines taken out of text, all other columns as they were (n_chars is counted again if there is one).

    Rows that had text and lose all of it are left out: everything they said stays in another document. Null and empty
    texts, repeated rows and clashing column names are as in mark_repeated_lines.
    """
    marked = mark_repeated_lines(docs).where((F.col("n_removed") == 0) | (F.length("kept_text") > 0))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}
    return marked.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = mark_repeated_lines(table(spark, sf_dir, "documents"))
    return marked.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.col("kept_text").alias("text"))


SQL = """
    WITH d AS (SELECT DISTINCT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
    e AS (SELECT doc_id, text, lines, unnest(range(1, len(lines) - 1)) AS i FROM d),
    w AS (SELECT doc_id, text, i - 1 AS pos, lines[i] || chr(10) || lines[i + 1] || chr(10) || lines[i + 2] AS w FROM e),
    g AS (SELECT w, min(doc_id) AS f FROM w GROUP BY w HAVING count(*) > 1),
    o AS (SELECT doc_id, text, pos, doc_id IS DISTINCT FROM f AS elsewhere, pos > min(pos) OVER (PARTITION BY doc_id, text, w.w) AS later, pos < max(pos) OVER (PARTITION BY doc_id, text, w.w) AS again
          FROM w JOIN g ON w.w = g.w),
    c AS (SELECT doc_id, text, unnest([pos, pos + 1, pos + 2]) AS p, elsewhere, later AND NOT elsewhere AS here, NOT later AND NOT elsewhere AND again AS first_here FROM o),
    r AS (SELECT doc_id, text, p FROM c GROUP BY doc_id, text, p HAVING bool_or(elsewhere) OR (bool_or(here) AND NOT bool_or(first_here))),
    x AS (SELECT doc_id, text, list(p) AS gone FROM r GROUP BY doc_id, text),
    t AS (SELECT d.doc_id, d.text, gone, string_split(d.text, chr(10)) AS lines FROM documents d LEFT JOIN x ON d.doc_id IS NOT DISTINCT FROM x.doc_id AND d.text = x.text)
    SELECT doc_id, CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed,
           CASE WHEN gone IS NULL THEN text
                ELSE coalesce(array_to_string(list_filter(lines, lambda x, i: NOT list_contains(gone, i - 1)), chr(10)), '') END AS text
    FROM t
"""
