"""Operator 1: interleaving sources to target weights by Pfair scheduling, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import table, written

#: Target weights of the registered query and of the pipeline: the large source is held to a fifth, sources not named share REST.
WEIGHTS = {"src0": 20} | {f"src{i}": 4 for i in range(1, 20)}
REST = 4
BLOCK_ROWS = 64
SEED = "mix-1"
BUCKETS = 4096  # of the order within a source
MOST_SEGMENTS = 1_000_000  # ranges and cuts that are broadcast


def period_schedule(spark: SparkSession, weights: list[int]) -> DataFrame:
    """Earliest-deadline-first over one period of sum(weights) slots: (slot, pool, nth).

    Block j of a pool of weight w may run from slot floor(j * L / w) and must
    have run by slot ceil((j + 1) * L / w), L being the period. nth is the
    block's number within the period. Bounded by the weights given, whatever
    the data; made slot by slot in one task.
    """
    period = sum(weights)

    def step(state: Column, t: Column) -> Column:
        due = F.transform(state["done"], lambda x, p: F.when(
            (x["j"] < x["w"]) & (F.floor(x["j"] * period / x["w"]) <= t), F.struct(F.ceil((x["j"] + 1) * period / x["w"]).alias("deadline"), p.alias("pool"))
        ))
        run = lambda pick: F.struct(
            F.transform(state["done"], lambda x, p: F.struct((x["j"] + (p == pick).cast("long")).alias("j"), x["w"].alias("w"))).alias("done"),
            F.concat(state["out"], F.array(pick)).alias("out"),
        )
        return F.get(F.transform(F.array(F.array_min(due)["pool"]), run), 0)  # so that the pick is made once

    zero = F.struct(
        F.array(*(F.struct(F.lit(0).cast("long").alias("j"), F.lit(x).cast("long").alias("w")) for x in weights)).alias("done"), F.expr("cast(array() as array<int>)").alias("out")
    )
    one = spark.range(1).select(F.aggregate(F.sequence(F.lit(0), F.lit(period - 1)), zero, step, lambda s: s["out"]).alias("out"))
    slots = one.select(F.posexplode("out").alias("slot", "pool"))
    return slots.withColumn("nth", F.row_number().over(Window.partitionBy("pool").orderBy("slot")) - 1)


def _known(docs: DataFrame, pool: Column, seed: str) -> tuple[DataFrame, DataFrame]:
    """docs as a plain scan of files, and of its rows: themselves, pool, bucket and the parts of their key.

    Rows of a pool go by a digest of doc_id, by doc_id, by a digest of text and by
    file and number in it, so no two have the same key and each has the same
    one in every scan, however cut. What is no plain scan is written first.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))

    def keyed(df: DataFrame) -> DataFrame:
        meta = df.metadataColumn("_metadata")
        key = (digest.alias("digest"), F.col("doc_id").alias("id"), F.md5("text").alias("tie"), F.xxhash64(meta["file_path"]).alias("file"), meta["row_index"].alias("at"))
        return df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), pool.alias("pool"), F.conv(F.substring(digest, 1, 3), 16, 10).cast("int").alias("bucket"), *key)

    try:
        return docs, keyed(docs)
    except AnalysisException:
        scan, _ = written(docs, "mix-rows")
        return scan, keyed(scan)


KEY = ("digest", "id", "tie", "file", "at")


def _segments(keyed: DataFrame, counts: DataFrame, totals: list[int], shares: list[int], block_rows: int, parts: int) -> DataFrame:
    """(pool, bucket, start, part, cuts): how many rows of its pool a bucket comes after, the partition of its first row, and where it goes on in others.

    Partitions hold whole rounds of the mix, as many rows each as can be. A
    round's first row of each pool is known by its number; cuts are (number,
    partition, key) of those that lie within a bucket, and only rows of such
    buckets are ranked for them, without their texts.
    """
    spark, total = keyed.sparkSession, sum(totals)
    per_round = [w * block_rows for w in shares]
    rounds = max(-(-n // m) for n, m in zip(totals, per_round))
    pools = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(m).alias("m")) for n, m in zip(totals, per_round)))
    begins = F.aggregate(pools, F.lit(0).cast("long"), lambda a, p: a + F.least(p["n"], F.col("id") * p["m"]))
    firsts = spark.range(rounds).select("id", F.least(F.lit(parts - 1), F.floor(begins * parts / F.lit(total)).cast("int")).alias("part")).groupBy("part").agg(F.min("id").alias("round"))
    each = firsts.select("part", "round", F.posexplode(pools).alias("pool", "p")).select("part", "pool", F.least(F.col("p.n"), F.col("round") * F.col("p.m")).alias("pos"), F.col("p.n").alias("n"))
    starts = counts.select("pool", "bucket", (F.sum("n").over(Window.partitionBy("pool").orderBy("bucket")) - F.col("n")).alias("pos"))
    both = starts.withColumn("part", F.lit(None).cast("int")).unionByName(each.where("pos < n").select("pool", F.lit(None).cast("int").alias("bucket"), "pos", "part"))
    so_far = Window.partitionBy("pool").orderBy("pos").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda c: F.last(c, ignorenulls=True).over(so_far)
    seen, _ = written(both.select("pool", "bucket", "pos", "part", last("part").alias("now"), last("bucket").alias("within"), last(F.when(F.col("bucket").isNotNull(), F.col("pos"))).alias("start")), "mix-cuts")
    buckets = seen.where("bucket IS NOT NULL").select("pool", "bucket", F.col("pos").alias("start"), F.col("now").alias("part"))
    inner = seen.where("part IS NOT NULL AND pos > start").select("pool", F.col("within").alias("bucket"), "start", "pos", "part")
    some = keyed.select("pool", "bucket", *KEY).join(inner.select("pool", "bucket", "start").distinct(), ["pool", "bucket"])
    ranked = some.withColumn("pos", F.col("start") + F.row_number().over(Window.partitionBy("pool", "bucket").orderBy(*KEY)) - 1)
    cuts = ranked.join(inner.drop("start"), ["pool", "bucket", "pos"]).groupBy("pool", "bucket").agg(F.sort_array(F.collect_list(F.struct("pos", "part", F.struct(*KEY).alias("key")))).alias("cuts"))
    return written(buckets.join(cuts, ["pool", "bucket"], "left"), "mix-segments")[0]


def mix_positions(docs: DataFrame, weights: dict[str, int], rest: int, block_rows: int = BLOCK_ROWS, seed: str = SEED) -> DataFrame:
    """``row`` (every input column), ``pool``, ``block``, ``slot`` and ``mix_pos`` (0 to rows - 1) for each input row, laid out in order of mix_pos.

    Rows of a source, in an order drawn from a hash of doc_id, fill blocks of
    block_rows rows; the blocks of all sources are interleaved so that at any
    slot a source has run less than one block more or less than its weight's
    share. Sources not named, and null ones, form one pool '*' of weight rest.
    There may be any number of sources, of any positive integer weights.
    Every row stays: once a source is used up its slots stay empty and the
    others keep their order. Rows that tie in the order (the same doc_id) are
    ordered by an MD5 of text, null first; rows that tie there too are
    interchangeable. Texts of any length pass whole, as do columns whatever
    their names. An empty table gives no rows.

    Whole rows are shuffled once, straight to the partition that their place is
    in. Before that, rows are counted in BUCKETS ranges of each source's order,
    which tells what ranges and partitions have in common; where a partition
    ends within a range, the key of its last row there is looked up (_segments).
    A source that holds a third of all rows, and a doc_id or text that does, is
    dealt to many partitions. In its partition a row's number within its source
    is that of its range's beginning there and its rank; rounds (one period of
    the schedule, sum of weights times block_rows rows at most) lie whole in
    one partition, and begin after as many rows as the sources' totals tell.
    """
    if min([*weights.values(), rest]) < 1:
        raise ValueError("weights must be positive integers")
    spark = docs.sparkSession
    names, shares = [*weights, "*"], [*weights.values(), rest]
    shares = [x // math.gcd(*shares) for x in shares]  # the same schedule in the shortest period
    period, w = sum(shares), F.array(*map(F.lit, shares))
    listed = F.create_map(*(x for i, k in enumerate(weights) for x in (F.lit(k), F.lit(i)))) if weights else None
    pool = F.coalesce(F.try_element_at(listed, F.col("source")), F.lit(len(weights))) if weights else F.lit(0)
    docs, keyed = _known(docs, pool, seed)

    counts, _ = written(keyed.groupBy("pool", "bucket").agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    found = {r.pool: r.n for r in counts.groupBy("pool").agg(F.sum("n").alias("n")).collect()}  # one for each weight given
    totals = [found.get(i, 0) for i in range(len(names))]
    if not sum(totals):
        return keyed.select("row", F.lit("").alias("pool"), *(F.lit(0).cast("long").alias(c) for c in ("block", "slot", "mix_pos"))).limit(0)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    segments = _segments(keyed, counts, totals, shares, block_rows, parts)
    few = segments.agg(F.sum(1 + F.coalesce(F.size("cuts"), F.lit(0)))).first()[0] <= MOST_SEGMENTS
    own = keyed.join(F.broadcast(segments) if few else segments, ["pool", "bucket"])
    passed = F.coalesce(F.size(F.filter("cuts", lambda c: c["key"] <= F.struct(*KEY))), F.lit(0))
    cut = F.get(F.col("cuts"), F.col("passed") - 1)
    dealt = own.withColumn("passed", passed).select(
        "row", "pool", "bucket", *KEY, F.coalesce(cut["pos"], F.col("start")).alias("first"), F.coalesce(cut["part"], F.col("part")).alias("part")
    ).repartitionById(parts, "part")
    in_source = F.col("first") + F.row_number().over(Window.partitionBy("part", "pool", "bucket", "first").orderBy(*KEY)) - 1
    placed = dealt.withColumn("n", in_source).select("row", "pool", "part", F.expr(f"n div {block_rows}").alias("block"), F.expr(f"n % {block_rows}").alias("within"))
    rounds = placed.withColumn("share", F.get(w, F.col("pool"))).withColumns({"round": F.expr("block div share"), "nth": F.expr("cast(block % share as int)")})
    timed = rounds.join(F.broadcast(period_schedule(spark, shares)), ["pool", "nth"])
    begins = F.aggregate(F.transform(F.array(*map(F.lit, totals)), lambda n, p: F.least(n, F.col("round") * F.get(w, p) * block_rows)), F.lit(0).cast("long"), lambda a, n: a + n)
    in_round = Window.partitionBy("part", "round").orderBy("slot", "within")
    ordered = timed.sortWithinPartitions("part", "round", "slot", "within")
    return ordered.withColumn("nth_in_round", F.row_number().over(in_round) - 1).select(
        "row",
        F.get(F.array(*map(F.lit, names)), F.col("pool")).alias("pool"),
        "block",
        (F.col("round") * period + F.col("slot")).alias("slot"),
        (begins + F.col("nth_in_round")).alias("mix_pos"),
    )


def mix(docs: DataFrame, weights: dict[str, int], rest: int, block_rows: int = BLOCK_ROWS, seed: str = SEED) -> DataFrame:
    """docs in mixed order: written out, its files in name order and their rows hold the interleaved sequence of mix_positions."""
    mixed = mix_positions(docs, weights, rest, block_rows, seed)
    return mixed.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows, interleaved; of the text the output holds its digest."""
    mixed = mix_positions(table(spark, sf_dir, "documents"), WEIGHTS, REST)
    return mixed.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "pool", "block", "slot", "mix_pos", F.md5("row.text").alias("text_md5"))


_NAMES, _SHARES = [*WEIGHTS, "*"], [*WEIGHTS.values(), REST]
SQL = f"""
    WITH RECURSIVE conf AS (SELECT {_NAMES} AS names, {_SHARES} AS w, {sum(_SHARES)} AS period),
    s(t, done) AS (
        SELECT 0, {[0] * len(_SHARES)}
        UNION ALL
        SELECT t + 1, list_transform(done, lambda x, i: x + CASE WHEN i = pick THEN 1 ELSE 0 END)
        FROM (
            SELECT t, done, list_sort(list_filter(list_transform(done, lambda x, i:
                CASE WHEN x < w[i] AND (x * period) // w[i] <= t THEN {{'d': ((x + 1) * period + w[i] - 1) // w[i], 'i': i}} END), lambda y: y IS NOT NULL))[1].i AS pick
            FROM s, conf WHERE t < period
        )
    ),
    slots AS (
        SELECT a.t AS slot, a.done AS before, list_position(list_transform(list_zip(a.done, b.done), lambda z: z[1] <> z[2]), true) AS pool
        FROM s a JOIN s b ON b.t = a.t + 1
    ),
    ranked AS (
        SELECT doc_id, source, md5(text) AS text_md5, coalesce(list_position(names[:-2], source), len(names)) AS pool,
               row_number() OVER (PARTITION BY coalesce(list_position(names[:-2], source), len(names))
                                  ORDER BY md5('{SEED}|' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, md5(text) NULLS FIRST) - 1 AS nth
        FROM documents, conf
    ),
    sizes AS (SELECT pool, count(*) AS n FROM ranked GROUP BY pool),
    counted AS (SELECT map_from_entries(list((pool, n))) AS m FROM sizes),
    totals AS (SELECT list_transform(names, lambda x, i: coalesce(m[i], 0)) AS totals FROM conf, counted),
    placed AS (SELECT r.*, nth // {BLOCK_ROWS} AS block, (nth // {BLOCK_ROWS}) // w[pool] AS round, (nth // {BLOCK_ROWS}) % w[pool] AS k FROM ranked r, conf)
    SELECT doc_id, source, names[p.pool] AS pool, block, round * period + slot AS slot,
           CAST(list_sum(list_transform(before, lambda b, i: least(totals[i], (round * w[i] + b) * {BLOCK_ROWS}))) + nth % {BLOCK_ROWS} AS BIGINT) AS mix_pos, text_md5
    FROM placed p JOIN slots x ON p.pool = x.pool AND p.k = x.before[x.pool], conf, totals
"""
