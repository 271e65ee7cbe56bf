"""Connected components of a graph of links, wholly on the executors.

Edges are first contracted where they lie: each task hangs the vertices of its
own edges (``EDGES_PER_TASK`` at most) on the least vertex of their group, so
a graph that fits one task is done at once. Larger graphs go on with
alternating large-star and small-star steps (Kiveris et al., 2014): each
vertex hangs its larger neighbours on the least vertex it knows, until every
component is a star around its least vertex. The number of rounds grows with
the logarithm of the longest chain. Each step is written to the shared
folder, so lineage stays short; only two counters reach the driver. A vertex
with very many links costs one aggregated row per task, and the joins deal its
links over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm._shared import Scratch, spread_join, tidy

EDGES_PER_TASK = 500_000


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least member of the group of each of n vertices, given edges between them."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)  # also the tree that each end hangs on
        np.minimum.at(new, label[b], low)
        while not np.array_equal(up := new[new], new):
            new = up
        if np.array_equal(new, label):
            return label
        label = new


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parts = list(batches)
    if not parts:
        return
    edges = pd.concat(parts)
    nodes, place = np.unique(np.r_[edges["u"].to_numpy(), edges["v"].to_numpy()], return_inverse=True)
    root = least_labels(len(nodes), place[: len(edges)], place[len(edges) :])
    hung = np.nonzero(root != np.arange(len(nodes)))[0]
    yield pd.DataFrame({"u": nodes[hung], "v": nodes[root[hung]]})


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    around = _both_ways(edges)
    least = around.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return spread_join(around.where("v > u"), least, ["u"], "v", scratch).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """``edges`` with u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = spread_join(edges, least, ["u"], "v", scratch)
    return hung.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc", edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """(node, component) of every vertex of ``edges`` (columns u, v, integers); component is its least vertex.

    Loops and rows with a null end are left out; without edges there are no rows.
    """
    now = scratch.keep(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v"), f"{tag}0")
    state, k = None, 0
    while True:
        n, digest = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (n, digest) == state or not n:
            break
        state, k = (n, digest), k + 1
        tasks = -(-n // edges_per_task)
        dealt = now.coalesce(1) if tasks == 1 else now.repartition(tasks)  # fewer partitions alone wouldn't split a large one
        local = scratch.keep(dealt.mapInPandas(tidy(_contract), "u long, v long"), f"{tag}{k}" if tasks == 1 else f"{tag}{k}local")
        if tasks == 1:
            now = local
        else:
            large = scratch.keep(_large_star(local, scratch), f"{tag}{k}large")
            now = scratch.keep(_small_star(large, scratch), f"{tag}{k}")
            scratch.drop(f"{tag}{k}local")
            scratch.drop(f"{tag}{k}large")
        scratch.drop(f"{tag}{k - 1}")
        if tasks == 1:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
