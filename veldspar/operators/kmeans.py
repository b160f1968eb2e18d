"""Lloyd's k-means on whole numbers, deterministic: same input, same clusters.

Centroids are few and small (k rows, at most MAX_CLUSTERS), so they live on the driver and travel with the
tasks; points never do. Ties of distance stay with the current cluster, then go to the lowest id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .knn_kernel import matrix

MAX_CLUSTERS = 65_536
#: Distances that are computed at once, so that they stay in a core's cache.
BLOCK = 1 << 17


def initial(points: DataFrame, k: int, seed: int = 0) -> list[list[int]]:
    """min(k, n) different points: those with the least hash of id and seed, ties by id."""
    if not 0 < k <= MAX_CLUSTERS:
        raise ValueError(f"clusters: 1 to {MAX_CLUSTERS}")
    rows = points.orderBy(F.xxhash64("ref_id", F.lit(seed)), "ref_id").limit(k).select("vector").collect()
    return [list(r[0]) for r in rows]


def frame(spark: SparkSession, centroids: list[list[int]]) -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate(centroids)], "cluster_id int, centroid array<int>")


def assign(points: DataFrame, centroids: DataFrame) -> DataFrame:
    """points with cluster_id. points may have current, a cluster that wins ties; centroids: at most MAX_CLUSTERS rows."""
    table = centroids.select("cluster_id", "centroid").toArrow().sort_by("cluster_id")
    if table["cluster_id"].to_pylist() != list(range(len(table))):
        raise ValueError("clusters are numbered from 0")
    return assign_fast(points, table["centroid"].to_pylist())


def assign_fast(points: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """points with cluster_id, over Arrow batches, without a shuffle."""
    c = np.array(centroids, np.float64)
    step = max(1, min(2048, BLOCK // max(1, len(c))))
    has_current = "current" in points.columns

    def run(batches):
        for b in batches:
            x = matrix(b.column("vector")).astype(np.float64)
            table = np.concatenate([-2 * c.T, (c * c).sum(1)[None]]) if len(x) else None
            best = np.empty(len(x), np.int32)
            for i in range(0, len(x), step):
                rows = x[i : i + step]
                dist = np.concatenate([rows, np.ones((len(rows), 1))], axis=1) @ table  # less the row's own square, exact in whole numbers
                own = dist.argmin(axis=1)
                if has_current:
                    now = np.array([-1 if v is None else v for v in b.column("current")[i : i + step].to_pylist()])
                    at = np.arange(len(own))
                    keep = (now >= 0) & (dist[at, np.maximum(now, 0)] == dist[at, own])
                    own = np.where(keep, now, own)
                best[i : i + step] = own
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best)], [*b.schema.names, "cluster_id"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema)
    return points.mapInArrow(run, f"{fields}, cluster_id int")


#: With more dimensions, sums per dimension are rows, as so many columns would not compile into one method.
WIDE = 24


def per_dimension(assigned: DataFrame, dims: int, **sums) -> DataFrame:
    """cluster_id, n, and for each name an array over the dimensions of a function (F.sum, F.min...) of the components."""
    if dims <= WIDE:
        each = [f(F.col("vector")[i].cast("bigint")).alias(f"{name}{i}") for name, f in sums.items() for i in range(dims)]
        found = assigned.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n"), *each)
        return found.select("cluster_id", "n", *[F.array(*[f"{name}{i}" for i in range(dims)]).alias(name) for name in sums])
    rows = assigned.select("cluster_id", F.posexplode("vector").alias("i", "x")).withColumn("x", F.col("x").cast("bigint"))
    found = rows.groupBy("cluster_id", "i").agg(F.count(F.lit(1)).alias("n"), *[f("x").alias(name) for name, f in sums.items()])
    ordered = found.groupBy("cluster_id").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", *sums))).alias("s"))
    return ordered.select("cluster_id", "n", *[F.col(f"s.{name}").alias(name) for name in sums])


def update(assigned: DataFrame, centroids: DataFrame, dims: int, top: int = 127) -> DataFrame:
    """cluster_id, centroid, n: means rounded half up and clamped; an empty cluster keeps its centroid."""
    sums = per_dimension(assigned, dims, total=F.sum)
    mean = F.transform("total", lambda s: F.greatest(F.lit(-top), F.least(F.lit(top), F.floor(s.cast("double") / F.col("n") + 0.5))).cast("int"))
    return centroids.join(sums, "cluster_id", "left").select("cluster_id", F.when(F.col("n") > 0, mean).otherwise(F.col("centroid")).alias("centroid"), F.coalesce("n", F.lit(0)).alias("n"))


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many points changed their cluster."""
    both = before.select("ref_id", F.col("cluster_id").alias("a")).join(after.select("ref_id", F.col("cluster_id").alias("b")), "ref_id")
    return both.agg(F.count_if(F.col("a") != F.col("b")).alias("moved"))


def _sums(points: DataFrame, centroids: list[list[int]], dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """cluster_id, n and [cluster, dimension] totals of the clusters that have points: a row for each cluster leaves a task."""
    k = len(centroids)

    def run(batches):
        n, total = np.zeros(k, np.int64), np.zeros((k, dims))
        for b in batches:
            own, x = b.column("cluster_id").to_numpy(zero_copy_only=False), matrix(b.column("vector"))
            n += np.bincount(own, minlength=k)
            for d in range(dims if len(x) else 0):
                total[:, d] += np.bincount(own, weights=x[:, d], minlength=k)  # whole numbers under 2**53
        at = np.flatnonzero(n)
        cut = pa.array(np.arange(len(at) + 1, dtype=np.int32) * dims)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.ListArray.from_arrays(cut, pa.array(total[at].astype(np.int64).ravel()))], ["cluster_id", "n", "total"])

    parts = assign_fast(points, centroids).select("cluster_id", "vector").mapInArrow(run, "cluster_id int, n long, total array<long>")
    each = parts.select("cluster_id", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster_id", "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).toArrow()  # k rows for each dimension
    found, at = np.unique(each["cluster_id"].to_numpy(), return_inverse=True)
    n, total = np.zeros(len(found), np.int64), np.zeros((len(found), dims), np.int64)
    n[at], total[at, each["i"].to_numpy()] = each["n"].to_numpy(), each["x"].to_numpy()
    return found, n, total


def fit(points: DataFrame, k: int, dims: int, iterations: int = 20, seed: int = 0, start: list[list[int]] | None = None, top: int = 127) -> list[list[int]]:
    """Centroids after up to so many rounds of ``update``, fewer once nothing changes. Each round is one job. start: instead of ``initial``."""
    centroids = initial(points, k, seed) if start is None else [list(c) for c in start]
    if not centroids:
        return []
    points = points.select("ref_id", "vector").persist()
    try:
        for _ in range(iterations):
            found, n, total = _sums(points, centroids, dims)
            new = [list(c) for c in centroids]
            for c, mean in zip(found.tolist(), np.clip(np.floor(total / n[:, None] + 0.5), -top, top).astype(int).tolist(), strict=True):
                new[c] = mean
            if new == centroids:
                break
            centroids = new
    finally:
        points.unpersist()
    return centroids
