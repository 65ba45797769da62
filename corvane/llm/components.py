"""Connected components: of an edge table, by alternating star contractions, and within a task."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import dropped, written


class LocalClasses:
    """Positions of one task joined step by step; smaller classes take the label of the largest."""

    def __init__(self, n: int):
        self.label = np.arange(n)
        self.members: dict[int, np.ndarray] = {}

    def join(self, some: np.ndarray) -> None:
        labels = np.unique(self.label[some])
        if len(labels) > 1:
            own = [self.members.pop(int(x), np.array([x])) for x in labels]
            most = int(np.argmax([len(m) for m in own]))
            for k, m in enumerate(own):
                if k != most:
                    self.label[m] = labels[most]
            self.members[int(labels[most])] = np.concatenate(own)


def _with_least(edges: DataFrame) -> tuple[DataFrame, str]:
    """Each edge (u, v) with the least of u and all v of that u, and the path of the table that holds the least ones.

    That table is written first: a join straight on an aggregate is one that
    Spark never splits, however many edges a node has.
    """
    least, path = written(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m")), "least")
    return edges.join(least, edges["u"] == least["k"]).select("u", "v", "m"), path


def _large_star(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """Larger neighbours of each node go to the least node near it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    met, least = _with_least(both)
    done, path = written(met.where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
    return done, [least, path]


def _small_star(edges: DataFrame) -> tuple[DataFrame, list[str]]:
    """Each node and its smaller neighbours go to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    met, least = _with_least(down)
    near = met.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    done, path = written(near.where("u <> v").distinct(), "edges")
    return done, [least, path]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v: long) that isn't its component's least node, which is the root.

    Loops and repeated edges don't matter. Each round is two aggregations that
    combine before they shuffle and two joins that Spark splits where a node
    has very many edges; what a step leaves is written to the shared folder, so
    the lineage stays short and lost executors cost no more than a step. Stops
    when a round changes nothing.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        large, made = _large_star(now)
        after, (least, after_path) = _small_star(large)
        found = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        dropped(spark, path, least, *made)
        now, path = after, after_path
        if found == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = found
