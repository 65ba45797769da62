"""Operator 4: n-gram Jaccard self-join by grouped prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, dropped, table, written
from corvane.llm.components import LocalClasses, components
from corvane.llm.shingles import WORDS, mix, shingle_set

PERCENT = 80
SKETCH_BITS, CHUNK_BITS = 21, 13
LIST_GROUPS = 48  # groups of one shingle up to which their pairs are counted one by one
SIEVE_BITS = 26
TILE_SHINGLES = 1 << 20
BIN_SHINGLES = 1 << 20
_U = np.uint64


def _texts(batch: pa.RecordBatch, column: str) -> Iterator[bytes]:
    for x in batch.column(column):
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def _common_shingles(docs: DataFrame) -> np.ndarray:
    """Document counts of shingles in 2**SKETCH_BITS hash buckets, over all documents.

    A fixed size whatever the data: it only has to tell which shingles are in a
    notable share of the documents, so that prefixes hold the rare ones.
    """
    chunk = 1 << CHUNK_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for b in batches:
            found = [np.zeros(0, np.uint64), *map(shingle_set, _texts(b, "text"))]
            total += np.bincount((np.concatenate(found) >> _U(64 - SKETCH_BITS)).astype(np.int64), minlength=len(total))
        # Held to 16 bits for each task: what is that frequent within one task is among the most frequent anyway.
        parts = np.minimum(total, 0xFFFF).astype(np.uint16).reshape(-1, chunk)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array([p.tobytes() for p in parts], pa.binary())], ["chunk", "counts"])

    def adder(kind: type):
        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            total = np.zeros(chunk, np.int64)
            for x in pdf["counts"]:
                total += np.frombuffer(x, kind)
            return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1].to_numpy(), "counts": [np.minimum(total, 0x7FFFFFFF).astype(np.int32).tobytes()]})

        return add

    schema = "chunk int, counts binary"
    salts = math.isqrt(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))) + 1  # two levels of sums
    parts = docs.select("text").mapInArrow(count, schema).withColumn("salt", F.spark_partition_id() % salts)
    summed = parts.groupBy("chunk", "salt").applyInPandas(adder(np.uint16), schema).groupBy("chunk").applyInPandas(adder(np.int32), schema)
    out = np.zeros((1 << SKETCH_BITS - CHUNK_BITS, chunk), np.int32)
    for r in summed.collect():
        out[r.chunk] = np.frombuffer(r.counts, np.int32)
    return out.ravel()


def prefix_length(n: int) -> int:
    """Rarest shingles of n among which there is one of any set that is similar enough."""
    return n - -(-PERCENT * n // 100) + 1


def _key(*columns: str) -> Column:
    """64 bits by which rows are looked up; what is found is always compared by more than it."""
    return F.xxhash64(*columns)


def _prefix(x: np.ndarray, often: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, sorted; those in equally full buckets go by their hash."""
    if not len(x):
        return x
    f = often[(x >> _U(64 - SKETCH_BITS)).astype(np.int64)]
    return np.sort(x[np.lexsort((x, f))[: prefix_length(len(x))]])


def _profiles(docs: DataFrame, counts: Broadcast) -> DataFrame:
    """(id, key, twin, n, s, t, g, prefix): size, 128-bit digest (s, t) of the shingle set, digest g of size and prefix."""
    digest = _digest

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = counts.value
        for b in batches:
            n, s, t, g, prefixes = [], [], [], [], []
            for raw in _texts(b, "text"):
                x = shingle_set(raw)
                p = _prefix(x, often)
                n.append(len(x))
                s.append(digest(x, 1))
                t.append(digest(x, 2))
                g.append(digest(p, 3 + len(x)))
                prefixes.append(p.view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)], dtype=np.int64).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *prefixes])))
            columns = [b.column("id"), b.column("key"), b.column("twin"), *(pa.array(v, pa.int64()) for v in (n, s, t, g)), listed]
            yield pa.RecordBatch.from_arrays(columns, ["id", "key", "twin", "n", "s", "t", "g", "prefix"])

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(profile, f"id {kind}, key long, twin long, n long, s long, t long, g long, prefix array<long>")


def _digest(x: np.ndarray, seed: int) -> int:
    with np.errstate(over="ignore"):
        return int(mix(np.array([np.sum(mix(x ^ _U(seed * 0x9E3779B97F4A7C15 % (1 << 64)))) + _U(len(x))])).view(np.int64)[0])


def _least_common(small: Column | np.ndarray, large: Column | np.ndarray, ceil=F.ceil) -> Column | np.ndarray:
    """Prefix shingles that sets of these sizes have in common at least, if they link.

    Linked sets have PERCENT / (100 + PERCENT) of their sizes' sum in common,
    and at most one set's part after its prefix of that isn't in both prefixes.
    """
    needed = ceil(PERCENT * (small + large) / (100 + PERCENT))
    return needed - ceil(PERCENT * large / 100) + 1


def _postings(profiles: DataFrame) -> DataFrame:
    """(g, n, token), once each, of the prefix shingles that more than one group has, and of few others.

    All postings are shuffled once, aggregated to the least and greatest group
    of each shingle; a sieve of fixed size then lets the shared ones through.
    """
    lists = profiles.select("g", F.explode("prefix").alias("token")).groupBy("token").agg(F.min("g").alias("low"), F.max("g").alias("high"))
    sieve = profiles.sparkSession.sparkContext.broadcast(_sieve(lists.where("low < high").select("token")))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, each = b.column("prefix").flatten().to_numpy(), np.diff(b.column("prefix").offsets.to_numpy())
            through = _in_sieve(tokens, sieve.value)
            columns = [pa.array(np.repeat(b.column(c).to_numpy(), each)[through]) for c in ("g", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(tokens[through])], ["g", "n", "token"])

    return profiles.select("g", "n", "prefix").mapInArrow(passing, "g long, n long, token long").distinct()


def _candidates(profiles: DataFrame) -> DataFrame:
    """(g, area) of the prefix groups that may link with another group, directly or through others.

    For shingles of up to LIST_GROUPS groups, common shingles are counted for
    each pair of fitting size; each posting gives fewer than LIST_GROUPS rows.
    Longer lists become stars instead, whatever the pairs in them (they are
    filtered within the area, in _verify), and a group's number of such shingles
    is added to its pairs' counts, so none is missed. Postings of long lists never
    meet: a sieve takes them out before the others are gathered by shingle, and
    their join is with a written table, so Spark splits it.
    """
    spark = profiles.sparkSession
    postings, path = written(_postings(profiles), "postings")
    counts = postings.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("g").alias("head")).where("k > 1")
    lists, lists_path = written(counts, "lists")
    sieve = spark.sparkContext.broadcast(_sieve(lists.where(F.col("k") > LIST_GROUPS).select("token")))
    long = F.arrow_udf(lambda tokens: pa.array(_in_sieve(tokens.to_numpy(), sieve.value)), "boolean")
    met, met_path = written(postings.where(long("token")).join(lists, "token"), "long-lists")  # and the few that the sieve can't tell from them
    brief = postings.where(~long("token")).unionByName(met.where(F.col("k") <= LIST_GROUPS).select("g", "n", "token"))
    short = brief.groupBy("token").agg(F.sort_array(F.collect_list(F.struct("n", "g"))).alias("a")).where(F.size("a") > 1)
    fitting = lambda x, i: F.transform(
        F.filter(F.slice("a", i + 2, LIST_GROUPS), lambda y: 100 * x["n"] >= PERCENT * y["n"]),
        lambda y: F.struct(F.least(x["g"], y["g"]).alias("v"), F.greatest(x["g"], y["g"]).alias("u"), x["n"].alias("small"), y["n"].alias("large")),
    )
    pairs = short.select(F.explode(F.flatten(F.transform("a", fitting))).alias("p")).select("p.*").groupBy("u", "v", "small", "large").agg(F.count(F.lit(1)).alias("common"))
    stars = met.where(F.col("k") > LIST_GROUPS).select("g", "head")
    more, more_path = written(stars.groupBy("g").agg(F.count(F.lit(1)).alias("more")), "starred")
    counted = (
        pairs.join(more.select(F.col("g").alias("u"), F.col("more").alias("more_u")), "u", "left")
        .join(more.select(F.col("g").alias("v"), F.col("more").alias("more_v")), "v", "left")
        .withColumn("most", F.col("common") + F.least(F.coalesce("more_u", F.lit(0)), F.coalesce("more_v", F.lit(0))))
    )
    near = counted.where(F.col("most") >= _least_common(F.col("small"), F.col("large"))).select("u", "v")
    areas = components(near.unionByName(stars.where("g <> head").select(F.col("g").alias("u"), F.col("head").alias("v"))))
    dropped(spark, path, lists_path, met_path, more_path)
    return areas.unionByName(areas.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("g"), F.col("root").alias("area"))


def _sieve(keys: DataFrame) -> np.ndarray:
    """A bit for each of 2**SIEVE_BITS ranges that holds one of a column's hashes: of fixed size, and only put before an exact join."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(b.column(0).to_numpy().view(np.uint64) >> _U(64 - SIEVE_BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 13), pa.array(at & 8191)], ["chunk", "bit"])

    def join_bits(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(8192, np.uint8)
        own[pdf["bit"].to_numpy()] = 1
        return pd.DataFrame({"chunk": pdf["chunk"].iloc[:1].to_numpy(), "bits": [np.packbits(own).tobytes()]})

    marks = keys.mapInArrow(mark, "chunk long, bit long").distinct().groupBy("chunk").applyInPandas(join_bits, "chunk long, bits binary")
    out = np.zeros((1 << SIEVE_BITS - 13, 1024), np.uint8)
    for r in marks.collect():
        out[r.chunk] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def _in_sieve(hashes: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    at = (hashes.view(np.uint64) >> _U(64 - SIEVE_BITS)).astype(np.int64)
    return (sieve[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)


def _sets_of(docs: DataFrame, keys: DataFrame, counts: Broadcast) -> DataFrame:
    """(key, s, t, shingles, prefix) for the rows of docs whose key is wanted; only those texts are hashed again, and none is shuffled."""
    wanted, digest = docs.sparkSession.sparkContext.broadcast(_sieve(keys.select("key"))), _digest

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(_in_sieve(b.column("key").to_numpy(), wanted.value)))
            sets = [shingle_set(raw) for raw in _texts(b, "text")]
            digests = [pa.array([digest(x, seed) for x in sets], pa.int64()) for seed in (1, 2)]
            lists = [pa.array([x.view(np.int64) for x in some], pa.list_(pa.int64())) for some in (sets, [_prefix(x, counts.value) for x in sets])]
            yield pa.RecordBatch.from_arrays([b.column("key"), *digests, *lists], ["key", "s", "t", "shingles", "prefix"])

    return docs.select("key", "text").mapInArrow(hashes, "key long, s long, t long, shingles array<long>, prefix array<long>")


class _Index:
    """Sorted tokens of some lists and whose they are."""

    def __init__(self, lists: list[np.ndarray]):
        tokens, owner = np.concatenate([np.zeros(0, np.int64), *lists]), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner, self.size = tokens[order], owner[order], len(lists)

    def common(self, tokens: np.ndarray) -> np.ndarray:
        """How many of tokens each list has."""
        lo, hi = np.searchsorted(self.tokens, tokens, "left"), np.searchsorted(self.tokens, tokens, "right")
        size = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        return np.bincount(self.owner[at], minlength=self.size)


def _groups(part: pd.DataFrame, at: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    """Of the groups (sets of one size and prefix) among some rows: their prefixes, sizes and members."""
    n, prefix, found = part["n"].to_numpy(), part["prefix"].to_numpy(), {}
    for k in at:
        found.setdefault((int(n[k]), prefix[k].tobytes()), []).append(k)
    members = [np.array(m) for m in found.values()]
    return [prefix[m[0]] for m in members], np.array([n[m[0]] for m in members], float), members


def _verify(pdf: pd.DataFrame) -> pd.DataFrame:
    """Exact links among the sets of one bin (areas held whole) or between two tiles of one large area.

    Groups meet first: an index over their prefixes gives the shingles that they
    have in common, and pairs of groups that don't fit in size or have too few go.
    Members of those that are left (of a group, each other too) are compared.
    """
    out: list[tuple[np.ndarray, ...]] = []
    for _, part in pdf.groupby("area", sort=False):
        i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
        tile = part["tile"].to_numpy()
        left = np.flatnonzero(tile == i)
        right = left if i == j else np.flatnonzero(tile == j)
        sets, n = part["shingles"].to_numpy(), part["n"].to_numpy()
        ids, weight = part["node"].to_numpy(), part["copies"].to_numpy()
        if not len(left) or not len(right):
            continue
        prefixes, sizes, members = _groups(part, left)
        others, their_sizes, their_members = (prefixes, sizes, members) if i == j else _groups(part, right)
        by_prefix, whole, place = _Index(others), _Index([sets[k] for k in right]), np.zeros(len(part), np.int64)
        place[right] = np.arange(len(right))
        near, compared, classes = np.zeros(len(part), np.int64), np.zeros(len(part), np.int64), LocalClasses(len(part))
        for prefix, size, own in zip(prefixes, sizes, members):
            small, large = np.minimum(size, their_sizes), np.maximum(size, their_sizes)
            pairs = np.flatnonzero((by_prefix.common(prefix) >= _least_common(small, large, np.ceil)) & (100 * small >= PERCENT * large))
            facing = np.concatenate([np.zeros(0, np.int64), *(their_members[v] for v in pairs)])
            for k in own:
                met = facing[facing != k]
                if not len(met):
                    continue
                compared[k] = len(met)
                both = whole.common(sets[k])[place[met]]
                linked = met[100 * both >= PERCENT * (n[k] + n[met] - both)]
                if len(linked):
                    near[k] += weight[linked].sum()
                    if i != j:
                        near[linked] += weight[k]
                    classes.join(np.append(linked, k))
        # Labels are local positions; the least node of each label is the one that all its members point to.
        low = np.full(len(part), np.iinfo(np.int64).max)
        np.minimum.at(low, classes.label, ids)
        out.append((ids, near, low[classes.label], np.full(len(part), part["tiles"].iloc[0] == 1), compared))
    names = ["node", "near", "root", "whole", "compared"]
    if not out:
        return pd.DataFrame({k: np.zeros(0, bool if k == "whole" else np.int64) for k in names})
    return pd.DataFrame({k: np.concatenate(v) for k, v in zip(names, zip(*out))})


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``n_links`` and ``component_id`` for each input row.

    Words are split at ASCII white space after lower-casing A-Z; a document's
    set is that of its distinct 5-word shingles (fewer words: all of them as
    one; none, or a null text: empty, and linked with nothing). Documents link
    when 100 * common >= 80 * united. n_links counts the other rows linked
    directly; component_id is the smallest doc_id reachable by links, itself
    included. Rows that share doc_id and text count as rows of their own. A
    null doc_id is never the smallest; it is returned where all are null.

    1. Shingles are counted in a sketch of fixed size over all documents, which
       orders them from rare to common; equal sets collapse to one.
    2. Similar sets share shingles of their rarest fifth. Documents with the
       same prefix and size form one group; groups meet on prefix shingles,
       pairs are filtered by size and by how many they share, and connected
       groups make an area. Long lists of a shingle become stars.
    3. Only sets in areas are built again and brought together by area, each
       once, in tiles of bounded size where an area is large. There all pairs of
       groups go through the filter, those of long lists too, and the members of
       pairs that pass are compared exactly. Tiles return link counts and one edge
       for each set.

    Shingles are compared by 64-bit hashes, sets by 128 bits; those that may link
    are numbered, and components are made of these numbers. Texts of any
    length are taken whole; an empty table gives no rows; other columns aren't
    looked at, whatever their names.
    """
    slim, info = _solved(docs)
    rows = slim.where("n > 0").join(info, ["s", "t"]).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "n_links", F.col("first.id").alias("component_id"))
    empty = slim.where("n = 0").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return rows.unionByName(empty)


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that link, directly or through others, with the one of smallest doc_id, which stays.

    All columns stay. Rows of equal doc_id and text are one document; of a
    component's rows with the smallest doc_id one stays. Texts without words,
    empty and null ones all stay. A row is known by its doc_id and 128 bits of
    its text; the rest is as in jaccard_classes.
    """
    slim, info = _solved(docs)
    own = F.struct(F.col("id").isNull().alias("none"), "id", "key", "twin")
    goes, _ = written(slim.where("n > 0").join(info, ["s", "t"]).where(own != F.col("first")).select("id", "key", "twin").distinct(), "going")
    again, _ = written(slim.where("n > 0").groupBy("id", "key", "twin").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("id", "key", "twin"), "repeated")
    # Only rows that may go are shuffled, with their texts; the sieve tells them, and exact joins decide.
    sieve = docs.sparkSession.sparkContext.broadcast(_sieve(goes.select("key").unionByName(again.select("key"))))
    touched = F.arrow_udf(lambda keys: pa.array(_in_sieve(keys.to_numpy(), sieve.value)), "boolean")
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("own_id"), _key("doc_id", "text").alias("own_key"), F.xxhash64("text").alias("own_twin"))
    same = F.col("own_id").eqNullSafe(F.col("id")) & (F.col("own_key") == F.col("key")) & (F.col("own_twin") == F.col("twin"))
    left = keyed.where(touched("own_key")).join(goes, same, "left_anti")
    kept = keyed.where(~touched("own_key")).unionByName(left.join(again, same, "left_anti"))
    if not again.isEmpty():
        kept = kept.unionByName(left.join(again, same, "left_semi").dropDuplicates(["own_id", "own_key", "own_twin"]))
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def _solved(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, key, twin, n, s, t) of each row; (s, t, n_links, first) of each set of one shingle or more, first being its component's row of smallest id."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").alias("id"), _key("doc_id", "text").alias("key"), F.xxhash64("text").alias("twin"), F.col("text"))
    often = spark.sparkContext.broadcast(_common_shingles(rows))
    profiles, profile_path = written(_profiles(rows, often), "profiles")
    slim, _ = written(profiles.select("id", "key", "twin", "n", "s", "t", "g"), "sets")
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key", "twin")).alias("first")
    sets = slim.where("n > 0").groupBy("s", "t").agg(F.max("n").alias("n"), F.max("g").alias("g"), F.count(F.lit(1)).alias("copies"), F.min("key").alias("key"), first)
    # A group of several sets is an area even if no other group is near it.
    crowded = sets.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("g", F.col("g").alias("area"))
    # Tables that are joined on a key of possibly very many rows are written first, so that Spark can split the join.
    areas, areas_path = written(_candidates(profiles).unionByName(crowded).groupBy("g").agg(F.min("area").alias("area")), "areas")
    dropped(spark, profile_path)
    numbered = sets.join(areas, "g").select(F.monotonically_increasing_id().alias("node"), "s", "t", "n", "copies", "key", "area")
    chosen, _ = written(numbered, "area-sets")
    dropped(spark, areas_path)

    size = chosen.groupBy("area").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")).where("k > 1")
    sized, _ = written(size.select("area", "total", F.ceil(F.col("total") / TILE_SHINGLES).alias("tiles")), "area-sizes")
    bins = max(1, (sized.agg(F.sum("total")).first()[0] or 0) // BIN_SHINGLES + 1)
    members = chosen.join(sized.drop("total"), "area").withColumn("tile", F.when(F.col("tiles") > 1, F.pmod(F.xxhash64("node"), "tiles")).otherwise(0))
    built = members.join(_sets_of(rows, chosen, often).dropDuplicates(["key", "s", "t"]), ["key", "s", "t"])
    partner = F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1))
    dealt = built.withColumn("other", partner).withColumns({"i": F.least("tile", "other"), "j": F.greatest("tile", "other")})
    bin_of = F.when(F.col("tiles") > 1, F.col("area")).otherwise(F.pmod(F.xxhash64("area"), F.lit(bins)))
    found = (
        dealt.select(bin_of.alias("bin"), "area", "i", "j", "tile", "tiles", "node", "n", "copies", "shingles", "prefix")
        .groupBy("bin", "i", "j", (F.col("tiles") > 1).alias("tiled"))
        .applyInPandas(_verify, "node long, near long, root long, whole boolean, compared long")
    )
    found, _ = written(found, "verified")
    links = found.groupBy("node").agg(F.sum("near").alias("near"), F.min("root").alias("root"), F.bool_and("whole").alias("whole"))
    across = found.where("NOT whole AND node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
    if across.isEmpty():
        labelled = links.withColumn("label", F.col("root"))
    else:
        tops = components(across).select(F.col("node").alias("own"), F.col("root").alias("top"))
        labelled = links.join(tops, F.col("node") == F.col("own"), "left").withColumn("label", F.when(F.col("whole"), F.col("root")).otherwise(F.coalesce("top", "node")))
    near = labelled.select("node", "near", "label").join(chosen.select("node", "s", "t"), "node").drop("node")
    linked = sets.join(near, ["s", "t"], "left").select("s", "t", "first", (F.col("copies") - 1 + F.coalesce(F.col("near"), F.lit(0))).alias("n_links"), "label")
    linked, _ = written(linked, "set-links")
    # Both sides of this join are written tables, so that Spark can split a large component's sets among tasks.
    least, _ = written(linked.where("label IS NOT NULL").groupBy("label").agg(F.min("first").alias("least")), "least")
    joined = linked.join(least, "label").select("s", "t", "n_links", F.col("least").alias("first"))
    info, _ = written(joined.unionByName(linked.where("label IS NULL").select("s", "t", "n_links", "first")), "classes")
    return slim, info


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


SQL = f"""
    WITH RECURSIVE w AS (
        SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
        FROM documents
    ),
    d AS (
        SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
                            ELSE list_distinct(list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i : i + {WORDS - 1}], ' '))) END AS s
        FROM w
    ),
    x AS (SELECT doc_id, len(s) AS n, unnest(s) AS s FROM d),
    c AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM x a JOIN x b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
    l AS (SELECT a, b FROM c WHERE 100 * k >= {PERCENT} * (na + nb - k)),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
    m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
    SELECT doc_id, len(s) AS n_shingles, coalesce(n_links, 0) AS n_links, least(doc_id, m.least) AS component_id
    FROM d LEFT JOIN n ON n.a = doc_id LEFT JOIN m ON m.a = doc_id
"""
