"""Connected components of link tables by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import cut


#: Links a task of a step takes on, about.
TASK_LINKS = 100_000


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of the links a[i] - b[i], within one task."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        p, q = root[left], root[right]
        open_ = p != q
        if not open_.any():
            return nodes, nodes[root]
        left, right, low = left[open_], right[open_], np.minimum(p, q)[open_]
        np.minimum.at(root, p[open_], low)
        np.minimum.at(root, q[open_], low)
        while (step := root[root]).tolist() != root.tolist() if len(root) < 64 else not np.array_equal(step := root[root], root):
            root = step


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b), component being the smallest node. Self links and nulls count for nothing.

    Each step lets every node hand its smallest neighbour to the others; links become stars in a number of steps that grows with
    the logarithm of a component's diameter. Nothing is collected; a star's centre is one skewed join key at most, which has one
    row on the other side and so can be split.
    """
    e = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    e = e.coalesce(max(1, -(-e.count() // TASK_LINKS)))
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen or not state[0]:
            break
        seen = state
        tasks = -(-state[0] // TASK_LINKS)  # fewer links, fewer tasks and files
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).coalesce(tasks).distinct().coalesce(tasks))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
