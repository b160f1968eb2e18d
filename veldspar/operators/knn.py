"""Nearest neighbours: exact by brute force or by cells, approximate by clusters, and exact by clusters with boxes.

References have ref_id, vector, is_fraud; queries have query_id, vector; both already in the same space.
Results are (query_id, rank, ref_id, dist, is_fraud), nearest first, ties by ref_id.

Queries go to the references, which never move: they are taken in blocks of ``block_bytes``, and each task
keeps a query's k nearest of the rows it meets. Where there is more than one block, a block's result is
written to the shared folder before the next is taken, so the driver holds one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import METRICS
from ..functions.quantize import space_of
from ..storage import written
from . import knn_cells
from .index import Index
from .knn_kernel import DISTANCES, PAIRS, Nearest, box_bound, matrix

#: Bytes of queries that one pass over the references carries.
BLOCK_BYTES = 8 << 20
#: Standard errors by which the recall of a sample of queries must exceed the one that all must reach.
MARGIN = 4


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query. Spark limits each task's share before the shuffle."""
    order = Window.partitionBy("query_id").orderBy("dist", "ref_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "ref_id", "dist", "is_fraud")


def blocks(queries: DataFrame, dims: int, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of the queries in parts of about block_bytes. Queries that fit one part cost one job."""
    rows = max(1, block_bytes // (8 * dims + 24))
    queries = queries.select("query_id", "vector")
    first = queries.limit(rows + 1).toArrow()
    if len(first) <= rows:
        yield first["query_id"].to_numpy(), matrix(first["vector"])
        return
    parts = -(-queries.count() // max(1, rows // 2))
    for p in range(parts):
        part = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == p).toArrow()
        yield part["query_id"].to_numpy(), matrix(part["vector"])


def _each_block(queries: DataFrame, dims: int, block_bytes: int, search: Callable[[np.ndarray, np.ndarray], DataFrame]) -> DataFrame:
    out, waiting = None, None
    for ids, q in blocks(queries, dims, block_bytes):
        if waiting is not None:
            done = written(waiting, "neighbours")
            out = done if out is None else out.unionByName(done)
        waiting = search(ids, q)
    return waiting if out is None else out.unionByName(written(waiting, "neighbours"))


def _scanned(rows: DataFrame, ids: np.ndarray, n_k: int, distance_type: str, met: Callable, at_most: np.ndarray | None = None) -> DataFrame:
    """query_id, ref_id, dist, is_fraud: each task's nearest. met(batch, nearest) shows the rows to the queries they may be near to."""
    whole = distance_type == "bigint"
    n = len(ids)

    def run(batches):
        nearest = Nearest(n, n_k, at_most)
        for b in batches:
            if len(b):
                met(b, nearest)
        query, dist, ref, fraud = nearest.settle()
        yield pa.RecordBatch.from_pydict({"query_id": pa.array(ids[query], pa.int64()), "ref_id": pa.array(ref, pa.int64()), "dist": pa.array(dist.astype(np.int64 if whole else np.float64)), "is_fraud": pa.array(fraud, pa.bool_())})

    return rows.mapInArrow(run, f"query_id long, ref_id long, dist {distance_type}, is_fraud boolean")


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return matrix(b.column("vector")).astype(np.float64), b.column("ref_id").to_numpy(zero_copy_only=False), b.column("is_fraud").to_numpy(zero_copy_only=False)


def brute(refs: DataFrame, queries: DataFrame, dims: int, space: str, k: int = 5, metric: str = "l2", kernel: str = "arrow", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Every query against every reference.

    kernel: arrow takes blocks of rows with NumPy; codegen compiles the distance in the JVM, with the same rows, and
    sends on every pair to the task's limit.
    """
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; one of {', '.join(METRICS)}")
    if kernel not in ("arrow", "codegen"):
        raise ValueError(f"unknown kernel {kernel!r}; arrow or codegen")
    if kernel == "codegen":
        return _each_block(queries, dims, block_bytes, lambda ids, q: _brute_codegen(refs, ids, q, dims, space, k, metric))
    return _each_block(queries, dims, block_bytes, lambda ids, q: _brute_arrow(refs, ids, q, space, k, metric))


def _brute_codegen(refs: DataFrame, ids: np.ndarray, q: np.ndarray, dims: int, space: str, k: int, metric: str) -> DataFrame:
    block = refs.sparkSession.createDataFrame(pa.table({"query_id": pa.array(ids, pa.int64()), "__q": pa.array(list(q), pa.list_(pa.from_numpy_dtype(q.dtype)))}))
    pairs = refs.crossJoin(F.broadcast(block))  # at most block_bytes
    return top_k(pairs.select("query_id", "ref_id", "is_fraud", METRICS[metric](F.col("vector"), F.col("__q"), dims, space).alias("dist")), k)


def _brute_arrow(refs: DataFrame, ids: np.ndarray, q: np.ndarray, space: str, k: int, metric: str) -> DataFrame:
    s = space_of(space)
    distance = DISTANCES[metric]
    kind = s.distance if metric != "cosine" else "double"
    sent = refs.sparkSession.sparkContext.broadcast(q)

    def met(b, nearest):
        q = sent.value
        x, ref, fraud = _columns(b)
        step = max(1, PAIRS // len(x))
        for i in range(0, len(q), step):
            nearest.add(distance(x, q[i : i + step], s.integer), np.arange(i, min(i + step, len(q))), ref, fraud)

    return top_k(_scanned(refs.select("ref_id", "vector", "is_fraud"), ids, k, kind, met), k)


def cells(refs: DataFrame, queries: DataFrame, dims: int, space: str, k: int = 5) -> DataFrame:
    """The rows of ``brute`` under l2, for many queries: each meets the cells that may hold something as near, see knn_cells.

    refs and queries are read more than once; what is costly to derive is written first.
    """
    return top_k(knn_cells.search(refs, queries, dims, space, k), k)


def _ranked(index: Index, queries: DataFrame, most: int) -> DataFrame:
    """query_id, vector, clusters (array<int>), dists (array<long>): the nearest clusters of each query, ties by cluster_id."""
    table = index.table()
    sent = queries.sparkSession.sparkContext.broadcast((table["cluster_id"].to_numpy(), matrix(table["centroid"])))  # at most MAX_CLUSTERS rows
    most = min(most, len(table))

    def run(batches):
        cluster, centroid = sent.value
        for b in batches:
            x = matrix(b.column("vector"))
            ranks, dists = np.empty((len(x), most), np.int32), np.empty((len(x), most), np.int64)
            step = max(1, PAIRS // len(cluster))
            for i in range(0, len(x), step):
                dist = DISTANCES["l2"](x[i : i + step], centroid, True).astype(np.int64)
                order = np.argsort(dist, axis=1, kind="stable")[:, :most]  # clusters stand by id
                ranks[i : i + step], dists[i : i + step] = cluster[order], np.take_along_axis(dist, order, 1)
            cut = pa.array(np.arange(len(x) + 1, dtype=np.int32) * most)
            yield pa.RecordBatch.from_arrays([b.column("query_id"), b.column("vector"), pa.ListArray.from_arrays(cut, pa.array(ranks.ravel())), pa.ListArray.from_arrays(cut, pa.array(dists.ravel()))], ["query_id", "vector", "clusters", "dists"])

    kind = queries.schema["vector"].dataType.simpleString()
    return queries.select("query_id", "vector").mapInArrow(run, f"query_id long, vector {kind}, clusters array<int>, dists array<long>")


def rank_clusters(index: Index, queries: DataFrame) -> DataFrame:
    """query_id, cluster_id, centroid_dist, rn, n, lb: all clusters by distance of their centroids, ties by cluster_id."""
    both = _ranked(index, queries, index.size()).select("query_id", "vector", F.posexplode(F.arrays_zip("clusters", "dists")).alias("at", "c"))
    table = index.table()
    sent = queries.sparkSession.sparkContext.broadcast({c: i for i, c in enumerate(table["cluster_id"].to_pylist())})
    boxes = queries.sparkSession.sparkContext.broadcast((matrix(table["low"]), matrix(table["high"]), table["n"].to_numpy()))

    def run(batches):
        (low, high, n), place = boxes.value, sent.value
        for b in batches:
            at = np.array([place[c] for c in b.column("cluster_id").to_pylist()], np.int64)
            x = matrix(b.column("vector")).astype(np.int64)
            far = np.maximum(np.maximum(low[at] - x, x - high[at]), 0).astype(np.int64)
            yield pa.RecordBatch.from_pydict({**{c: b.column(c) for c in ("query_id", "cluster_id", "centroid_dist", "rn")}, "n": pa.array(n[at].astype(np.int64)), "lb": pa.array((far * far).sum(axis=1) if len(at) else np.zeros(0, np.int64))})

    rows = both.select("query_id", "vector", F.col("c.clusters").alias("cluster_id"), F.col("c.dists").alias("centroid_dist"), (F.col("at") + 1).alias("rn"))
    return rows.mapInArrow(run, "query_id long, cluster_id int, centroid_dist long, rn int, n long, lb long")


def _by_cluster(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """cluster and its rows' vectors, ids, labels."""
    cluster = b.column("cluster_id").to_numpy(zero_copy_only=False)
    x, ref, fraud = _columns(b)
    order = np.argsort(cluster, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], cluster[order][1:] != cluster[order][:-1]]))
    for rows in np.split(order, start[1:]):
        yield int(cluster[rows[0]]), x[rows], ref[rows], fraud[rows]


def _probed(index: Index, ids: np.ndarray, q: np.ndarray, probes: np.ndarray, k: int) -> DataFrame:
    """The nearest of each query among its probed clusters; only the probed clusters' records are read. probes: [query, probe]."""
    flat = probes.ravel()
    order = np.argsort(flat, kind="stable")
    clusters, start = np.unique(flat[order], return_index=True)
    owners = (order // max(1, probes.shape[1])).astype(np.int64)
    sent = index.records.sparkSession.sparkContext.broadcast((q, clusters, np.append(start, len(flat)), owners))

    def met(b, nearest):
        q, clusters, start, owners = sent.value
        for c, x, ref, fraud in _by_cluster(b):
            at = int(np.searchsorted(clusters, c))
            if at < len(clusters) and clusters[at] == c:
                asked, step = owners[start[at] : start[at + 1]], max(1, PAIRS // len(x))
                for i in range(0, len(asked), step):
                    nearest.add(DISTANCES["l2"](x, q[asked[i : i + step]], True), asked[i : i + step], ref, fraud)

    return _scanned(index.of_clusters(clusters.tolist()), ids, k, "bigint", met)


def _probes(index: Index, nprobe: int) -> Callable:
    """A block's nprobe nearest clusters, [query, probe]."""
    spark = index.records.sparkSession

    def of(ids: np.ndarray, q: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.zeros((0, 1), np.int64)
        kind = pa.from_numpy_dtype(q.dtype)
        block = spark.createDataFrame(pa.table({"query_id": pa.array(ids, pa.int64()), "vector": pa.array(list(q), pa.list_(kind))}))
        found = _ranked(index, block, nprobe).select("query_id", "clusters").toArrow()  # a block
        by_id = {i: c for i, c in zip(found["query_id"].to_pylist(), found["clusters"].to_pylist(), strict=True)}
        return np.array([by_id[i] for i in ids.tolist()], np.int64)

    return of


def ivf(index: Index, queries: DataFrame, k: int = 5, nprobe: int = 8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The k nearest among the nprobe clusters with the nearest centroids."""
    probes = _probes(index, nprobe)
    return _each_block(queries, index.dims, block_bytes, lambda ids, q: top_k(_probed(index, ids, q, probes(ids, q), k), k))


def probes_for(index: Index, queries: DataFrame, k: int = 5, least: float = 0.9, sample: int = 1000) -> tuple[int, float]:
    """The fewest clusters that ``ivf`` must read for this recall, and the measured recall with them, against brute force.

    A true neighbour is found just if its cluster is read, so the ranks of the true neighbours' clusters give
    the recall of every nprobe at once. Up to sample queries are measured, those with the least hashes; where there may
    be more, what is measured must exceed least by MARGIN standard errors, so that the recall of all queries reaches it.
    """
    some = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(sample).select("query_id", "vector").persist()
    try:
        measured = some.count()
        true = brute(index.records.select("ref_id", "vector", "is_fraud"), some, index.dims, index.space, k).select("query_id", "ref_id")
        own = true.join(index.records.select("ref_id", "cluster_id"), "ref_id")
        ranks = own.join(rank_clusters(index, some).select("query_id", "cluster_id", "rn"), ["query_id", "cluster_id"])
        found = ranks.groupBy("query_id", "rn").agg(F.count(F.lit(1)).alias("n")).toArrow()  # at most k rows for each of the sample
    finally:
        some.unpersist()
    if not len(found):
        return 1, 1.0
    (_, query), rn, n = np.unique(found["query_id"].to_numpy(), return_inverse=True), found["rn"].to_numpy(), found["n"].to_numpy()
    total = np.bincount(query, weights=n)
    for nprobe in np.unique(rn).tolist():
        got = np.bincount(query, weights=n * (rn <= nprobe))
        recall = got.sum() / total.sum()
        error = np.sqrt(((got - recall * total) ** 2).sum()) / total.sum() if measured == sample else 0.0
        if got.sum() >= least * total.sum() and recall - MARGIN * error >= least:
            return nprobe, float(recall)
    return index.size(), 1.0


def pruned(index: Index, queries: DataFrame, k: int = 5, nprobe: int = 8, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Exact: after nprobe clusters only those whose box may hold something nearer, or as near, are read.

    The k nearest of the probed clusters bound the rest from above; a point of a box is never nearer than the
    box. What was probed is not read again, and a task tightens its bounds as it goes, so nprobe changes only
    the work.
    """
    probes = _probes(index, nprobe)
    return _each_block(queries, index.dims, block_bytes, lambda ids, q: _pruned(index, ids, q, probes(ids, q), k))


def _pruned(index: Index, ids: np.ndarray, q: np.ndarray, probes: np.ndarray, k: int) -> DataFrame:
    spark = index.records.sparkSession
    seed = top_k(_probed(index, ids, q, probes, k), k).toArrow()  # k rows for each query of a block
    order = np.argsort(ids, kind="stable")
    own = order[np.searchsorted(ids, seed["query_id"].to_numpy(), sorter=order)] if len(seed) else np.zeros(0, np.int64)
    kth = np.full(len(ids), np.inf)
    full = seed["rank"].to_numpy() == k
    kth[own[full]] = seed["dist"].to_numpy()[full]
    table = index.table()
    boxes = {c: (lo, hi) for c, lo, hi, n in zip(table["cluster_id"].to_pylist(), matrix(table["low"]), matrix(table["high"]), table["n"].to_pylist(), strict=True) if n}
    sent = spark.sparkContext.broadcast((q, kth, probes, boxes))

    def wanted(batches):
        q, kth, probes, boxes = sent.value
        for b in batches:
            keep = [c for c in b.column("cluster_id").to_pylist() if c in boxes and bool(((box_bound(q, *boxes[c]) <= kth) & ~(probes == c).any(axis=1)).any())]
            yield pa.RecordBatch.from_pydict({"cluster_id": pa.array(keep, pa.int32())})

    rest = [r[0] for r in index.clusters.select("cluster_id").repartition(spark.sparkContext.defaultParallelism).mapInArrow(wanted, "cluster_id int").collect()] if len(ids) else []

    def met(b, nearest):
        q, _, probes, boxes = sent.value
        for c, x, ref, fraud in _by_cluster(b):
            lower = box_bound(q, *boxes[c])
            asked = np.flatnonzero((lower <= nearest.bound) & ~(probes == c).any(axis=1))
            step = max(1, PAIRS // len(x))
            for i in range(0, len(asked), step):
                some = asked[i : i + step]
                some = some[lower[some] <= nearest.bound[some]]
                if len(some):
                    nearest.add(DISTANCES["l2"](x, q[some], True), some, ref, fraud)

    found = spark.createDataFrame(seed.select(["query_id", "ref_id", "dist", "is_fraud"]), "query_id long, ref_id long, dist long, is_fraud boolean")
    return top_k(found.unionByName(_scanned(index.of_clusters(rest), ids, k, "bigint", met, kth)), k)


def search(refs, queries: DataFrame, mode: str = "brute", **settings) -> DataFrame:
    """One door to all modes: brute and cells take references, ivf and pruned take an Index."""
    modes = {"brute": brute, "cells": cells, "ivf": ivf, "pruned": pruned}
    if mode not in modes:
        raise ValueError(f"unknown mode {mode!r}; one of {', '.join(modes)}")
    return modes[mode](refs, queries, **settings)
