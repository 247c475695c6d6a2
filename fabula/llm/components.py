"""Connected components of a graph in a table of edges.

Each round first replaces the edges of every block of a partition by stars
(a forest with the same components, found with numpy), then, unless that ended
it, does one large-star and one small-star step.  Blocks have at most BLOCK edges,
no matter how many edges a node has; rounds are settled in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import drop, settle

BLOCK = 1 << 20
MOST_ROUNDS = 40


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges a-b, and for each the smallest node that it is connected with."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    parent = np.arange(len(nodes))
    while True:
        pi, pj = parent[i], parent[j]
        apart = pi != pj
        if not apart.any():
            return nodes, nodes[parent]
        i, j, pi, pj = i[apart], j[apart], pi[apart], pj[apart]
        np.minimum.at(parent, np.maximum(pi, pj), np.minimum(pi, pj))
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def stars(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = (np.concatenate([p.column(k).to_numpy() for p in parts]) for k in (0, 1))
        nodes, root = roots(a, b)
        far = nodes != root
        return pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(root[far])], names=["u", "v"])

    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= BLOCK:
            yield stars(held)
            held, size = [], 0
    if size:
        yield stars(held)


def _is_stars(edges: DataFrame) -> bool:
    """Every node has one parent, and no parent has one."""
    marks = edges.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    bad = marks.groupBy("node").agg(F.sum("child").alias("c"), F.max("parent").alias("p")).where("c > 1 or (c > 0 and p > 0)")
    return bad.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """For edges with columns a and b (longs): node and root, the smallest node of its component, for every node with an edge to another."""
    current = settle(edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    for _ in range(MOST_ROUNDS):
        forest = settle(current.mapInArrow(_forest, "u long, v long"), "forest")
        drop(current)
        current = forest
        if _is_stars(current):
            break
        both = current.unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        stepped = settle(small, "stars")
        drop(current)
        current = stepped
    else:
        raise RuntimeError(f"components didn't converge in {MOST_ROUNDS} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(current.select(F.col("v"), F.col("v")).distinct())
