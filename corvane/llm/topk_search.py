"""Operator 8: exact top-k by integer inner product, with cover trees over queries and data together."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import bounded_batches, dropped, table, written
from corvane.llm.vectors import finite, matrix, nearest, squares

K, SCALE, EVERY = 5, 256, 50
SAMPLE = 4096  # rows that the top level is fitted on, and that first bounds come from
LEAST_NODES, MOST_NODES = 32, 1024  # of the top level, growing with the data in between
LEAST_TILE, DATA_TILE = 1024, 32768  # rows of a tile, growing with the data in between
QUERY_CHUNK = 4096  # queries that a tile answers at a time
LEAF, FAN = 64, 64
ENOUGH = 0.9  # share of a node pair's products left by its children's bounds from which the pair is computed as it is
CELLS = 1 << 21  # products computed at once
_SLACK = 1e-6  # for rounding in angles
_LAST = (1 << 63) - 1
_KEY_BYTES = 48  # of scores as sortable bytes


def scaled(vectors: np.ndarray) -> np.ndarray:
    return np.floor(SCALE * vectors)


def net(points: np.ndarray, most: int, radius: float) -> np.ndarray:
    """Positions of centres, each farther than radius from those before it, until all points are covered or there are most."""
    centres, far = [0], np.sqrt(squares(points, points[:1])[:, 0])
    while len(centres) < most and (at := int(far.argmax())) not in centres and far[at] > radius:
        centres.append(at)
        far = np.minimum(far, np.sqrt(squares(points, points[at : at + 1])[:, 0]))
    return np.array(centres)


@dataclass
class Nodes:
    """What bounds need of some nodes: centre, covering radius, covering angle about the centre, least and greatest norm."""

    centre: np.ndarray
    radius: np.ndarray
    angle: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def __getitem__(self, at: np.ndarray) -> Nodes:
        return Nodes(*(getattr(self, f)[at] for f in ("centre", "radius", "angle", "low", "high")))


def angles(points: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Angles of points to a centre (one, or one for each); zero vectors have none to anything."""
    size = np.linalg.norm(points, axis=-1) * np.linalg.norm(centre, axis=-1)
    return np.where(size > 0, np.arccos(np.clip((points * centre).sum(-1) / np.where(size > 0, size, 1), -1, 1)), 0)


def covering(points: np.ndarray) -> Nodes:
    """One node about the mean of points, which covers them more closely than a member does."""
    norm, centre = np.linalg.norm(points, axis=1), points.mean(0)
    radius = np.sqrt(((points - centre) ** 2).sum(1).max(keepdims=True))
    return Nodes(centre[None], radius, angles(points, centre).max(keepdims=True), norm.min(keepdims=True), norm.max(keepdims=True))


def most_possible(a: Nodes, b: Nodes) -> np.ndarray:
    """No inner product of a member of a node of a with one of a node of b is greater: the lesser of the bounds by radii and by angles."""
    dot, size_a, size_b = a.centre @ b.centre.T, np.linalg.norm(a.centre, axis=1)[:, None], np.linalg.norm(b.centre, axis=1)
    ball = dot + size_a * b.radius + a.radius[:, None] * size_b + a.radius[:, None] * b.radius
    between = np.arccos(np.clip(dot / np.maximum(size_a * size_b, 1e-300), -1, 1))
    close = np.cos(np.clip(between - a.angle[:, None] - b.angle - 3 * _SLACK, 0, np.pi))
    close[(size_a == 0) | (size_b == 0) & np.ones_like(close, bool)] = 1  # a zero centre points nowhere
    cone = np.where(close > 0, a.high[:, None] * b.high, a.low[:, None] * b.low) * close
    return np.minimum(ball, cone) + 1e-9 * a.high[:, None] * b.high


@dataclass
class Tree:
    rows: np.ndarray
    children: list[Tree]
    bounds: Nodes | None  # of the children


def cover_tree(points: np.ndarray, rows: np.ndarray) -> Tree:
    """Nested nets: children of a node are picked half its radius apart, FAN at most; radii and angles are the true ones about their means."""
    own = points[rows]
    radius = float(np.sqrt(squares(own, own[:1]).max()))
    if len(rows) <= LEAF or not radius:
        return Tree(rows, [], None)
    picked = net(own, FAN, radius / 2)
    group = nearest(own, own[picked])
    parts = [rows[np.concatenate([[p], np.setdiff1d(np.flatnonzero(group == i), [p])])] for i, p in enumerate(picked) if (group == i).any()]
    if len(parts) == 1:  # rounding can leave all with one centre
        return Tree(rows, [], None)
    each = [covering(points[p]) for p in parts]
    return Tree(rows, [cover_tree(points, p) for p in parts], Nodes(*(np.concatenate([getattr(n, f) for n in each]) for f in ("centre", "radius", "angle", "low", "high"))))


class Search:
    """The k best rows of d for each of q by score and then id, among those that reach the query's floor. The tree of d may be given."""

    def __init__(self, q: np.ndarray, q_row: np.ndarray, floor: np.ndarray, d: np.ndarray, d_row: np.ndarray, d_id: np.ndarray, k: int, tree: Tree | None = None):
        self.q, self.q_row, self.floor, self.d, self.d_row, self.d_id, self.k = q, q_row, floor, d, d_row, d_id, k
        self.tree = tree or cover_tree(d, np.arange(len(d)))
        self.exact = float(np.linalg.norm(q, axis=1).max()) * float(np.linalg.norm(d, axis=1).max()) < 2**52
        self.worst = floor.astype(float)
        self.found: tuple[np.ndarray, ...] = (np.zeros(0, int), np.zeros(0, int), np.zeros(0))  # query, row of d, score
        self.products = 0

    def run(self) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Positions in q and d and scores of the results."""
        stack = [(cover_tree(self.q, np.arange(len(self.q))), self.tree)]
        while stack:
            a, b = stack.pop()
            some_a, some_b = a.children or [a], b.children or [b]
            if len(some_a) == len(some_b) == 1:
                self._compute(a.rows, b.rows)
                continue
            bound = most_possible(a.bounds or covering(self.q[a.rows]), b.bounds or covering(self.d[b.rows]))
            alive = bound >= np.array([self.worst[x.rows].min() for x in some_a])[:, None]
            work = np.outer([len(x.rows) for x in some_a], [len(x.rows) for x in some_b])
            if np.isfinite(self.worst[a.rows].min()) and work[alive].sum() > ENOUGH * len(a.rows) * len(b.rows):
                self._compute(a.rows, b.rows)
                continue
            left = np.argwhere(alive)
            stack += [(some_a[i], some_b[j]) for i, j in left[np.argsort(bound[alive], kind="stable")]]
        query, row, score = self.found
        return query, row, [int(x) for x in score]

    def _compute(self, a: np.ndarray, b: np.ndarray) -> None:
        self.products += len(a) * len(b)
        if not self.exact:
            return self._compute_wide(a, b)
        for at in range(0, len(a), step := max(1, CELLS // len(b))):
            rows = a[at : at + step]
            s = self.q[rows] @ self.d[b].T
            s[self.q_row[rows][:, None] == self.d_row[b]] = -np.inf
            least = self.worst[rows]
            if len(b) > self.k:
                least = np.maximum(least, np.partition(s, -self.k, axis=1)[:, -self.k])
            i, j = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            self._keep(rows[i], b[j], s[i, j])
        return None

    def _compute_wide(self, a: np.ndarray, b: np.ndarray) -> None:
        """Products beyond 53 bits, as exact integers."""
        d = np.array([[int(x) for x in r] for r in self.d[b]], object)
        for i in a:
            s = d @ np.array([int(x) for x in self.q[i]], object)
            ok = self.d_row[b] != self.q_row[i]
            self._keep(np.full(ok.sum(), i), b[ok], s[ok])

    def _keep(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        met = np.zeros(len(self.q), bool)
        met[query] = True
        again = met[self.found[0]]
        query, row, score = (np.concatenate([f[again], new]) for f, new in zip(self.found, (query, row, score)))
        if score.dtype == object:
            order = np.array(sorted(range(len(score)), key=lambda x: (query[x], -score[x], self.d_id[row[x]], row[x])), int)
        else:
            order = np.lexsort((row, self.d_id[row], -score, query))
        query, row, score = query[order], row[order], score[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        kth = rank == self.k - 1
        self.worst[query[kth]] = np.maximum(self.worst[query[kth]], score[kth].astype(float) * (1 - 1e-12 * np.sign(score[kth].astype(float))) if score.dtype == object else score[kth])
        stays = (rank < self.k) & (score.astype(float) >= self.floor[query])
        self.found = tuple(np.concatenate([f[~again], new[stays]]) for f, new in zip(self.found, (query, row, score)))


def sortable(score: int) -> bytes:
    """Bytes that sort as the integers do."""
    return (score + (1 << 8 * _KEY_BYTES - 1)).to_bytes(_KEY_BYTES, "big")


def _packed(counts: dict[int, int], tile: int) -> dict[int, tuple[int, int]]:
    """For each top node its first tile and number of tiles; small nodes share tiles with their neighbours."""
    out, at, full = {}, -1, tile
    for node, n in sorted(counts.items()):
        if n > tile:
            parts = -(-n // tile)
            out[node], at, full = (at + 1, parts), at + parts, tile
        else:
            if full + n > tile:
                at, full = at + 1, 0
            out[node], full = (at, 1), full + n
    return out


def _runs(tiles: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and last of each unbroken run of tiles, from nodes' first tiles and numbers of them."""
    out: list[tuple[int, int]] = []
    for first, parts in sorted(tiles):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], first + parts - 1))
        else:
            out.append((first, first + parts - 1))
    return out


class Tile:
    """The rows of a tile with their tree, made once, and answers to queries."""

    def __init__(self, parts: list[pd.DataFrame], k: int):
        pdf = pd.concat(parts)
        self.v, self.row, self.id, self.nameless, self.k = scaled(matrix(pdf["embedding"])), *(pdf[c].to_numpy() for c in ("row", "id", "nameless")), k
        self.tree = cover_tree(self.v, np.arange(len(self.v)))

    def answer(self, parts: list[pd.DataFrame]) -> pd.DataFrame:
        pdf = pd.concat(parts)
        q = scaled(matrix(pdf["embedding"], self.v.shape[1]))[:, : self.v.shape[1]]  # what is longer meets zeros
        row, ids = pdf["row"].to_numpy(), pdf["id"].to_numpy()
        i, j, score = Search(q, row, pdf["floor"].to_numpy(), self.v, self.row, self.id, self.k, self.tree).run()
        return pd.DataFrame({
            "query_row": row[i], "query_id": ids[i], "row": self.row[j], "id": self.id[j], "nameless": self.nameless[j],
            "score": np.array([min(max(x, -_LAST - 1), _LAST) for x in score], np.int64), "key": np.array([sortable(x) for x in score], object),
        })


def _answers(k: int):
    """Over frames sorted by tile, a tile's rows before the queries that it is asked."""

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, rows, asked, tile, n = None, [], [], None, 0
        for pdf in frames:
            for at, part in pdf.groupby("dt", sort=False):
                if at != own:
                    if asked and tile:
                        yield tile.answer(asked)
                    own, rows, asked, tile, n = at, [], [], None, 0
                asks = part["asks"].to_numpy()
                if not asks.all():
                    rows.append(part[~asks])
                if asks.any():
                    if tile is None and rows:
                        tile, rows = Tile(rows, k), []
                    asked.append(part[asks])
                    n += len(asked[-1])
                if n >= QUERY_CHUNK and tile:
                    yield tile.answer(asked)
                    asked, n = [], 0
        if asked and tile:
            yield tile.answer(asked)

    return search


def exact_top_k(vectors: DataFrame, k: int = K, every: int = EVERY) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` of each query's k highest scores, ties to the smaller vec_id.

    Components are floor(256 * x) in double precision; a score is their integer
    inner product (a shorter vector is filled up with zeros). Queries are the
    rows whose vec_id is divisible by every, candidates all rows but the
    query's own; a query with fewer candidates gets all. Vectors that are null
    or hold null or non-finite components take no part; an empty one counts as
    zero. Rows that repeat a vec_id are rows of their own, a null one sorts last.

    A score beyond a long's range takes part with its true value and is returned
    as the range's end. Other columns aren't looked at, whatever their names; an
    empty table gives no rows, as does one without queries.

    The top level of the tree is a net of centres from a bounded sample, more of
    them for more rows; every row goes to its nearest centre, and radii, angles
    and norms come from all rows. Each query's kth score within the sample
    bounds its result from below; node pairs whose bounds can't reach a query
    group's worst kth score are dropped, and their rows never meet. Rows are
    dealt once, to tiles of bounded size cut along nodes; only queries, a
    fiftieth of the rows, go to each tile that they may have to meet. A task
    makes a tile's tree once and passes the queries by it in chunks, where both
    sides' trees go on; where bounds leave nearly all of a pair's products they
    are computed at once, in blocks. Without clusters nothing is ruled out, and
    every query meets every tile.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = vectors.where(finite("embedding")).select(
        F.monotonically_increasing_id().alias("row"), F.coalesce("vec_id", F.lit(_LAST).cast("long")).alias("id"), F.col("vec_id").isNull().alias("nameless"), "embedding"
    )  # ids without nulls stay integers in pandas
    rows, rows_path = written(rows, "vectors")
    n = rows.count()
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    sample = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toPandas()
    some = scaled(matrix(sample["embedding"]))
    width = some.shape[1]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tile = int(np.clip(n // (2 * tasks), LEAST_TILE, DATA_TILE))
    picked = some[net(some, int(np.clip(2 * n // tile, LEAST_NODES, MOST_NODES)), 0.0)]
    group = nearest(some, picked)
    centres = np.stack([some[group == i].mean(0) for i in range(len(picked)) if (group == i).any()])
    shared = spark.sparkContext.broadcast((centres, some, sample["row"].to_numpy()))

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, some, some_rows = shared.value
        for pdf in frames:
            v = scaled(matrix(pdf["embedding"], width))
            wide = lambda m: np.pad(m, ((0, 0), (0, v.shape[1] - m.shape[1])))
            far = squares(v, wide(centres))
            pdf["top"] = far.argmin(1)
            pdf["away"] = np.sqrt(far.min(1))
            pdf["angle"] = angles(v, wide(centres)[pdf["top"]])
            pdf["norm"] = np.linalg.norm(v, axis=1)
            pdf["query"] = (pdf["id"] % every == 0) & ~pdf["nameless"]
            pdf["floor"] = -np.inf
            if len(at := np.flatnonzero(pdf["query"])) and len(some) > k:
                s = v[at] @ wide(some).T
                s[pdf["row"].to_numpy()[at][:, None] == some_rows] = -np.inf
                # Less a margin for products that doubles don't hold exactly.
                kth = np.partition(s, -k, axis=1)[:, -k]
                pdf.loc[pdf.index[at], "floor"] = kth - 1e-9 * np.abs(s[np.isfinite(s)]).max(initial=0)
            yield pdf[["row", "id", "nameless", "embedding", "top", "away", "angle", "norm", "query", "floor"]]

    kind = rows.schema["embedding"].dataType.simpleString()
    columns = f"row long, id long, nameless boolean, embedding {kind}, top int, away double, angle double, norm double, query boolean, floor double"
    placed, _ = written(rows.mapInPandas(place, columns), "placed")
    dropped(spark, rows_path)
    of = lambda f, c, which: f(F.when(F.col("query"), F.col(c))) if which == "q" else f(F.col(c))
    stats = placed.groupBy("top").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("query").alias("queries"), of(F.min, "floor", "q").alias("worst"),
        *(of(f, c, w).alias(f"{w}_{name}") for w in "qd" for name, f, c in (("radius", F.max, "away"), ("angle", F.max, "angle"), ("low", F.min, "norm"), ("high", F.max, "norm"))),
    ).orderBy("top").collect()  # at most MOST_NODES rows
    asking = [x for x in stats if x.queries]
    if not asking:
        return spark.createDataFrame([], schema)

    def nodes(which: str, some_stats: list) -> Nodes:
        grown = lambda name, by=1.0 + 1e-9: np.array([x[f"{which}_{name}"] for x in some_stats]) * by
        return Nodes(centres[[x.top for x in some_stats]], grown("radius"), grown("angle"), grown("low", 1 - 1e-9), grown("high"))

    meet = most_possible(nodes("q", asking), nodes("d", stats)) >= np.array([x.worst for x in asking])[:, None]
    d_tiles = _packed({x.top: x.n for x in stats}, tile)
    last = max(first + parts for first, parts in d_tiles.values())
    # For each node: its own tiles, and for one with queries the runs of tiles that these have to meet.
    data_side = [(x.top, *d_tiles[x.top]) for j, x in enumerate(stats) if meet[:, j].any()]
    query_side = [(x.top, _runs(d_tiles[stats[j].top] for j in np.flatnonzero(meet[i]))) for i, x in enumerate(asking)]
    own = F.col("first") + F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    met = F.explode(F.flatten(F.transform("others", lambda r: F.sequence(r["begin"], r["end"]))))
    on_side = lambda df, side, ddl: df.join(F.broadcast(spark.createDataFrame(side, ddl)), "top")
    columns = ("row", "id", "nameless", "embedding", "floor")
    d = on_side(placed, data_side, "top int, first int, parts int").select(*columns, F.lit(False).alias("asks"), own.alias("dt"))
    q = on_side(placed.where("query"), query_side, "top int, others array<struct<begin: int, end: int>>").select(*columns, F.lit(True).alias("asks"), met.alias("dt"))
    parts = min(tasks, last)
    tiled = d.unionByName(q).withColumn("part", F.col("dt") % parts).repartitionById(parts, "part").sortWithinPartitions("dt", "asks").drop("part")
    found = tiled.mapInPandas(_answers(k), "query_row long, query_id long, row long, id long, nameless boolean, score long, key binary")
    order = Window.partitionBy("query_row").orderBy(F.desc("key"), "nameless", "id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(~F.col("nameless"), F.col("id")).alias("vec_id"), "score")


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


SQL = f"""
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % {EVERY} = 0 AND q.vec_id <> c.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
    SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM r WHERE k <= {K}
"""
