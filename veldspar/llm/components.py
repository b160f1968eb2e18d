"""Connected components of a graph in DataFrames: chunks contracted by union-find, then star steps.

A task contracts a chunk of at most ``chunk`` edges to a forest: each node's edge to the least node it
reaches there. Where one chunk holds all edges, that is the answer. Otherwise a large-star and a small-star
step replace a node's neighbours' links by links to its least neighbour, and it begins again until nothing
changes; the number of steps grows with the logarithm of the longest path. Sums per node are partial before
the shuffle, and a hub's links are an ordinary (splittable) join. Nothing is collected but a count and a checksum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, enter

CHUNK_EDGES = 1 << 20


def least_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (u, v), ascending, and the least node that each reaches."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while True:
        low, high = np.minimum(least[a], least[b]), np.maximum(least[a], least[b])
        apart = low != high
        if not apart.any():
            return nodes, nodes[least]
        a, b = a[apart], b[apart]
        np.minimum.at(least, high[apart], low[apart])
        while (least != (further := least[least])).any():
            least = further


def _contracted(edges: DataFrame, chunks: int) -> DataFrame:
    def run(batches):
        enter("components")
        held = [(b.column("u").to_numpy(zero_copy_only=False), b.column("v").to_numpy(zero_copy_only=False)) for b in batches]
        nodes, least = least_reached(*map(np.concatenate, zip(*held, strict=True))) if held else (np.zeros(0, np.int64),) * 2
        yield pa.RecordBatch.from_arrays([pa.array(nodes[nodes != least]), pa.array(least[nodes != least])], ["u", "v"])

    dealt = edges.coalesce(1) if chunks == 1 else edges.repartition(chunks)
    return dealt.mapInArrow(run, "u long, v long")


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, chunk: int = CHUNK_EDGES, most: int = 100) -> DataFrame:
    """node, comp (its component's least node) of all nodes of edges (u, v long); an edge from a node to itself is none."""
    edges = durable(edges.where("u <> v").select("u", "v"), "edges")
    last = None
    for _ in range(most):
        chunks = max(1, -(-edges.count() // chunk))
        edges = durable(_contracted(edges, chunks), "edges")
        if chunks == 1:
            break
        edges = durable(_small_star(_large_star(edges)), "edges")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
