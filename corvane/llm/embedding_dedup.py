"""Operator 3: near-duplicate embeddings by product quantisation and exact rerank."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import bounded_batches, dropped, table, written
from corvane.llm.components import LocalClasses, components
from corvane.llm.vectors import finite, k_means, matrix, nearest, squares

COSINE = 0.98
LIST_ROWS, MOST_LISTS = 1000, 4096  # rows of a label for each list, as long as lists are fewer than that
LEAST_SAMPLE, FIT_ROWS = 10_000, 20  # vectors that the index is fitted on: so many, or so many for each list
MOST_TILED = 400_000  # lists whose tile counts are broadcast
SUBSPACES, CODEWORDS = 8, 32
TILE = 2048
_EPS = 1e-6


@dataclass(frozen=True)
class Index:
    """Coarse centres and residual codebooks of one vector length."""

    centres: np.ndarray
    codebooks: list[np.ndarray]

    def codes(self, residuals: np.ndarray) -> np.ndarray:
        return np.stack([nearest(r, c) for r, c in zip(self.parts(residuals), self.codebooks)], 1)

    def decoded(self, codes: np.ndarray) -> np.ndarray:
        return np.concatenate([c[codes[:, m]] for m, c in enumerate(self.codebooks)], 1)

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return np.array_split(x, len(self.codebooks), axis=1)

    def probes(self, unit: np.ndarray, reach: float) -> list[np.ndarray]:
        """For each unit vector its own list and, of the others that can hold one within reach of it, those that it has to ask.

        With a its nearest centre, a list c can do so only if the plane halfway
        between a and c is within reach: |y-c|^2 - |y-a|^2 <= 2 * reach * |a-c|.
        That holds from both sides, so of two lists only one asks the other: the
        lesser if their sum is even, else the greater.
        """
        d = squares(unit, self.centres)
        own = d.argmin(1)
        apart = np.sqrt(squares(self.centres, self.centres))
        slack = d - d[np.arange(len(d)), own][:, None] - 2 * reach * apart[own]
        a, c = own[:, None], np.arange(len(self.centres))
        asks = (a == c) | ((a < c) == ((a + c) % 2 == 0))
        return [np.flatnonzero(s) for s in (slack <= _EPS) & asks]


def fit_index(sample: np.ndarray, lists: int) -> Index:
    """From the unit vectors of a bounded sample; any index gives whole results, a good one gives them sooner."""
    centres = k_means(sample, lists)
    residuals = sample - centres[nearest(sample, centres)]
    return Index(centres, [k_means(p, CODEWORDS) for p in np.array_split(residuals, min(SUBSPACES, sample.shape[1]), axis=1)])


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.maximum(np.abs(vectors).max(1, keepdims=True), 1e-300)
    return scaled / np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-300)


def _links(pdf: pd.DataFrame, index: dict[int, Index], cosine: float) -> pd.DataFrame:
    """Links between the queries and the entries of one tile of a list: weights of each node, and its least local root.

    Queries of the list's own are entries too and meet each other both ways;
    pairs with guests are met only here, and count for both.
    """
    dim, home = len(pdf["embedding"].iloc[0]), int(pdf["list"].iloc[0])
    unit, node, copies = _unit(matrix(pdf["embedding"])), pdf["node"].to_numpy(), pdf["copies"].to_numpy()
    entry = np.flatnonzero(pdf["entry"].to_numpy())
    query = np.flatnonzero(~pdf["entry"].to_numpy())
    guest = pdf["guest"].to_numpy()
    reach = np.sqrt(2 - 2 * cosine)
    near, classes = np.zeros(len(pdf), np.int64), LocalClasses(len(pdf))
    # The same node may stand here as a query and as an entry: both are of one class.
    _, first, back = np.unique(node, return_index=True, return_inverse=True)
    for p in np.flatnonzero(first[back] != np.arange(len(node))):
        classes.join(np.array([first[back[p]], p]))
    known = index.get(dim)
    if known is not None:
        residual = unit[entry] - known.centres[home]
        codes = known.codes(residual)
        lost = np.linalg.norm(residual - known.decoded(codes), axis=1)
    for at in range(0, len(query), 256):
        q = query[at : at + 256]
        if known is None:
            close = np.ones((len(q), len(entry)), bool)
        else:
            # Asymmetric distances by table look-up; the entry's coding error bounds how far they are off.
            far = np.zeros((len(q), len(entry)))
            for m, (part, book) in enumerate(zip(known.parts(unit[q] - known.centres[home]), known.codebooks)):
                far += squares(part, book)[:, codes[:, m]]
            close = np.sqrt(far) <= reach + lost + _EPS
        rows, cols = np.nonzero(close)
        linked = np.zeros(close.shape, bool)
        for s in range(0, len(rows), 65536):
            r, c = rows[s : s + 65536], cols[s : s + 65536]
            linked[r, c] = (np.einsum("ij,ij->i", unit[q[r]], unit[entry[c]]) >= cosine) & (node[q[r]] != node[entry[c]])
        near[q] += linked @ copies[entry]
        near[entry] += (copies[q] * guest[q]) @ linked
        for i in np.flatnonzero(linked.any(1)):
            classes.join(np.append(entry[linked[i]], q[i]))
    low = np.full(len(pdf), np.iinfo(np.int64).max)
    np.minimum.at(low, classes.label, node)
    root = low[classes.label]
    return pd.DataFrame({"node": node, "near": near, "root": root})[(near > 0) | (root != node)]


def embedding_classes(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` for each input row.

    Vectors link when their labels are equal and not null, they are equally
    long, and their cosine (double precision) is at least ``cosine``; those
    that are null, empty, zero or hold null or non-finite components link with
    nothing. n_links counts the other rows linked directly; component_id is the
    smallest vec_id reachable, itself included (a null vec_id is never the
    smallest); kept tells whether that is the row's own. Rows that repeat count
    as rows of their own. Other columns aren't looked at, whatever their names;
    an empty table gives no rows.

    Equal vectors of a label (by 128 bits) collapse to one node with a count. An
    index is fitted on a bounded sample; every node is an entry of the list of
    its nearest centre, and of any two lists that can hold vectors near enough
    to each other one's nodes ask the other.
    Look-up distances only rule out entries that the coding error can't bring
    near enough, so no link is lost. Large lists are dealt in tiles of TILE
    queries and TILE entries, straight from where the vectors lie, so no list
    meets in one task; tiles return counts and one edge for each node. Lists
    grow with the largest label up to MOST_LISTS; from some four million vectors
    of a label on, lists grow instead.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    takes_part = F.col("label").isNotNull() & finite("embedding") & F.exists("embedding", lambda x: x != 0)
    # Rows find back to their nodes by digests of label and vector, not by whole vectors.
    twins = (F.xxhash64("label", "embedding").alias("s"), F.xxhash64(F.lit("twin"), "label", "embedding").alias("t"))
    rows = vectors.select("vec_id", "label", "embedding", takes_part.alias("part"), *twins)
    grouped = rows.where("part").groupBy("s", "t").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes, nodes_path = written(grouped.withColumn("node", F.monotonically_increasing_id()), "nodes")

    most = nodes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    lists = int(np.clip(most // LIST_ROWS, 1, MOST_LISTS))
    sample = nodes.orderBy(F.xxhash64("label", "embedding"), "node").limit(max(LEAST_SAMPLE, FIT_ROWS * lists)).select("embedding").toPandas()["embedding"]
    index = {d: fit_index(_unit(matrix(sample[sample.map(len) == d])), lists) for d in sorted(set(map(len, sample)))}
    shared = spark.sparkContext.broadcast(index)
    reach = float(np.sqrt(2 - 2 * cosine)) + _EPS

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, part in pdf.groupby(pdf["embedding"].map(len)):
                part = part.copy()
                if (known := shared.value.get(dim)) is None:
                    part["list"], part["asks"] = 0, [[0]] * len(part)
                else:
                    unit = _unit(matrix(part["embedding"]))
                    part["list"] = nearest(unit, known.centres)
                    part["asks"] = known.probes(unit, reach)
                part["dim"] = dim
                yield part[["node", "label", "embedding", "copies", "dim", "list", "asks"]]

    kind = nodes.schema["embedding"].dataType.simpleString()
    label = nodes.schema["label"].dataType.simpleString()
    placed, placed_path = written(
        nodes.select("node", "label", "embedding", "copies").mapInPandas(place, f"node long, label {label}, embedding {kind}, copies long, dim int, list int, asks array<int>"), "placed"
    )
    key = ["label", "dim", "list"]
    entries = placed.select("node", *key, "embedding", "copies", F.lit(True).alias("entry"), F.lit(False).alias("guest"))
    queries = placed.select("node", "label", "dim", F.explode("asks").alias("asked"), "embedding", "copies", F.lit(False).alias("entry"), "list").select(
        "node", "label", "dim", F.col("asked").alias("list"), "embedding", "copies", "entry", (F.col("asked") != F.col("list")).alias("guest")
    )
    counts = (
        placed.groupBy(*key).agg(F.count(F.lit(1)).alias("e"))
        .join(placed.select("label", "dim", F.explode("asks").alias("list")).groupBy(*key).agg(F.count(F.lit(1)).alias("q")), key)
        .select(*key, F.ceil(F.col("e") / TILE).alias("et"), F.ceil(F.col("q") / TILE).alias("qt"))
    )
    tiles, tiles_path = written(counts, "list-tiles")  # a join with it brings no list together: it is broadcast, or split
    if tiles.count() <= MOST_TILED:
        tiles = F.broadcast(tiles)
    own = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    dealt = entries.join(tiles, key).withColumn("i", own("et")).withColumn("j", every("qt")).unionByName(
        queries.join(tiles, key).withColumn("j", own("qt")).withColumn("i", every("et"))
    )
    found, found_path = written(
        dealt.groupBy(*key, "i", "j").applyInPandas(lambda pdf: _links(pdf, shared.value, cosine), "node long, near long, root long"), "near-vectors"
    )
    links = found.groupBy("node").agg(F.sum("near").alias("near"))
    roots = components(found.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")))
    every_node = (
        nodes.select("node", "least", "copies").join(links, "node", "left").join(roots, "node", "left")
        .select("node", "least", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("root"))
    )
    full, full_path = written(every_node, "vector-roots")
    least, least_path = written(full.groupBy("root").agg(F.min("least").alias("component_id")), "vector-least")
    classes = full.join(least, "root").select("node", "n_links", "component_id")
    of_node, _ = written(nodes.select("s", "t", "node").join(classes, "node").select("s", "t", "n_links", "component_id"), "vector-classes")
    dropped(spark, nodes_path, placed_path, tiles_path, found_path, full_path, least_path)
    linked = rows.where("part").select("vec_id", "s", "t").join(of_node, ["s", "t"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT part").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_classes(table(spark, sf_dir, "embeddings"))


SQL = f"""
    WITH RECURSIVE v AS (
        SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
    ),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= {COSINE}),
    r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a),
    m AS (SELECT a, min(b) AS least FROM r GROUP BY a)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, m.least) AS component_id, vec_id <= coalesce(m.least, vec_id) AS kept
    FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN m ON m.a = e.vec_id
"""
