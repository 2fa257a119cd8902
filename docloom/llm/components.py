"""Connected components of an edge table: by alternating large-star and small-star steps, or in one task where edges are few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import materialise, release

#: Up to so many edges (16 bytes each) one task finds the components; each of the steps would deal them over all partitions.
FEW = 200_000


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u and its neighbours. A node with many edges is a skewed side."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("_u")).drop("_u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_least(down)
    moved = linked.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(linked.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def least_labels(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges in order, and the least node of each one's component."""
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = place[: len(u)], place[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        a, b = a[open_], b[open_]
        np.minimum.at(root, high[open_], low[open_])  # roots are hung on lesser ones
        while (root != (above := root[root])).any():
            root = above
    return nodes, nodes[root]


def _at_once(edges: DataFrame) -> DataFrame:
    """(node, component) of edges that one task holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches]
        if read:
            found = least_labels(*(np.concatenate(c) for c in zip(*read, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["node", "component"])

    return edges.select("u", "v").coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the (u, v) edges; component is the least node.

    Up to FEW edges go to one task. Of more, each step is a few aggregations and joins over the edges,
    written in the shared folder; the number of steps grows with the logarithm of the number of nodes.
    Loops and repeated edges do no harm; an empty table gives an empty one.
    """
    now = materialise(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u != v").distinct(), "edges")
    if now.count() <= FEW:
        out = materialise(_at_once(now), "components")
        release(now)
        return out
    mark = None
    while True:
        star = materialise(_large_star(now), "large-star")
        after = materialise(_small_star(star), "small-star")
        release(now, star)
        now = after
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (row["n"], row["s"]) == mark:
            break
        mark = (row["n"], row["s"])
    roots = now.select(F.col("v").alias("node")).distinct()
    out = materialise(now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component"))), "components")
    release(now)
    return out
