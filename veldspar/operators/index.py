"""The clustered index: records laid out by cluster, and a small table of clusters with their boxes."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.quantize import quantized, rescale_centroid, space_of
from ..storage import written
from . import kmeans

VERSION = 2
#: Rows that the fit takes for each cluster, and rows for each folder of records.
PER_CLUSTER, PER_SHARD = 64, 100_000


@dataclass
class Index:
    """records: cluster_id, ref_id, vector, is_fraud; clusters: cluster_id, centroid, n, low, high, first.

    per_shard: clusters in a folder of the records, where they were read from disk.
    """

    records: DataFrame
    clusters: DataFrame
    space: str
    dims: int
    per_shard: int = 0
    _table: list[pa.Table] = field(default_factory=list, repr=False)

    def table(self) -> pa.Table:
        """The clusters, at most MAX_CLUSTERS, by cluster_id; fetched once."""
        if not self._table:
            self._table.append(self.clusters.select("cluster_id", "centroid", "n", "low", "high", "first").toArrow().sort_by("cluster_id").combine_chunks())
        return self._table[0]

    def size(self) -> int:
        return len(self.table())

    def of_clusters(self, ids: list[int]) -> DataFrame:
        """The records of these clusters: only their folders are read, and row groups that may hold them."""
        if len(ids) >= sum(1 for n in self.table()["n"].to_pylist() if n):
            return self.records
        rows = self.records.where(F.col("cluster_id").isin(ids))
        return rows.where(F.col("shard").isin(sorted({i // self.per_shard for i in ids}))) if self.per_shard else rows

    def arranged(self) -> Index:
        """The same with each cluster's records next to each other; a large cluster is split."""
        return replace(self, records=self.records.hint("rebalance", "cluster_id").sortWithinPartitions("cluster_id", "ref_id"))

    def ready(self) -> bool:
        """Whether the tables can be read and hold something."""
        return self.size() > 0 and not self.records.isEmpty()

    def warm(self) -> int:
        """Keep the records in memory; how many they are."""
        self.records.persist()
        return self.records.count()


def directory(assigned: DataFrame, centroids: DataFrame, dims: int) -> DataFrame:
    """Per cluster: centroid, number of records, box, and the place of its first record. Empty clusters have zero boxes."""
    found = kmeans.per_dimension(assigned, dims, low=F.min, high=F.max)
    zeros = F.array_repeat(F.lit(0), dims)
    side = lambda c: F.coalesce(F.col(c).cast("array<int>"), zeros).alias(c)
    out = centroids.join(found, "cluster_id", "left").select("cluster_id", "centroid", F.coalesce("n", F.lit(0)).cast("long").alias("n"), side("low"), side("high"))
    before = Window.orderBy("cluster_id").rowsBetween(Window.unboundedPreceding, -1)  # at most MAX_CLUSTERS rows
    return out.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))


def default_clusters(n: int) -> int:
    """About the square root of the number of records."""
    return max(1, min(round(n**0.5), n, kmeans.MAX_CLUSTERS))


def build(refs: DataFrame, dims: int, space: str = "i16", clusters: int | None = None, iterations: int = 20, seed: int = 0, centroids: list[list[int]] | None = None, per_cluster: int = PER_CLUSTER) -> Index:
    """Index of refs (ref_id, vector array<float>, is_fraud): every row is in it.

    Clusters are found on the i8 scale, whatever the space, and fitted to a sample by hash of about per_cluster rows for
    each cluster (all rows where they are fewer), as where they lie changes the work of a search and not what is right;
    given centroids are used as they are.
    """
    if not space_of(space).integer:
        raise ValueError("an index is kept in i8 or i16")
    if centroids is None:
        small = refs.select("ref_id", quantized(F.col("vector"), dims, "i8").alias("vector"))
        n = refs.count()
        k = clusters or default_clusters(n)
        if n > k * per_cluster:
            small = small.where(F.pmod(F.xxhash64("ref_id", F.lit(seed), F.lit("fit")), F.lit(n)) < k * per_cluster)
        centroids = kmeans.fit(small, k, dims, iterations, seed)
    full = refs.select("ref_id", quantized(F.col("vector"), dims, "i8").alias("vector"), quantized(F.col("vector"), dims, space).alias("own"), "is_fraud")
    assigned = written(kmeans.assign_fast(full, centroids).select("cluster_id", "ref_id", F.col("own").alias("vector"), "is_fraud"), "records")  # assigned once
    table = kmeans.frame(refs.sparkSession, centroids)
    if space == "i16":
        table = table.select("cluster_id", F.transform("centroid", lambda c: rescale_centroid(c).cast("int")).alias("centroid"))
    return Index(assigned, directory(assigned, table, dims), space, dims)


def write(index: Index, path: str, shards: int | None = None, mode: str = "errorifexists") -> None:
    """Records in a folder for each few clusters, sorted there, so that a search reads the folders and row groups it needs.

    shards: folders, about; by default one for each PER_SHARD rows, 16 to 4,096.
    """
    spark = index.records.sparkSession
    shards = shards or max(16, min(4096, sum(index.table()["n"].to_pylist()) // PER_SHARD))
    per = max(1, -(-index.size() // shards))
    laid = index.records.select("cluster_id", "ref_id", "vector", "is_fraud", (F.col("cluster_id") / per).cast("int").alias("shard"))
    laid.hint("rebalance", "shard").sortWithinPartitions("shard", "cluster_id", "ref_id").write.mode(mode).partitionBy("shard").parquet(f"{path}/records")
    spark.createDataFrame(index.table(), index.clusters.schema.simpleString()[7:-1]).coalesce(1).write.mode(mode).parquet(f"{path}/clusters")
    spark.createDataFrame([(VERSION, index.space, index.dims, per)], "version int, space string, dims int, per_shard int").coalesce(1).write.mode(mode).json(f"{path}/meta")


def read(spark: SparkSession, path: str) -> Index:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    if meta.get("version") != VERSION or meta.get("space") not in ("i8", "i16"):
        raise ValueError(f"no index of this version at {path}: {meta}")
    kind = {"i8": "tinyint", "i16": "smallint"}[meta["space"]]
    records = spark.read.schema(f"cluster_id int, ref_id long, vector array<{kind}>, is_fraud boolean, shard int").parquet(f"{path}/records")
    return Index(records, spark.read.parquet(f"{path}/clusters"), meta["space"], meta["dims"], meta["per_shard"])
