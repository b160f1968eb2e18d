"""Scoring of an unbounded sequence of JSON transactions against a resident index.

Each micro-batch is parsed, vectorised, searched and written with its batch id, so a batch that is run
again after a failure replaces its own output: effects are exactly once. Requests are independent; no
state is kept between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import EngineConfig
from ..functions.quantize import quantized
from ..functions.vectorize import parse, vectorize
from ..operators import knn, score
from ..operators.index import Index


def score_bodies(bodies: DataFrame, index: Index, config: EngineConfig | None = None, block_bytes: int = knn.BLOCK_BYTES) -> DataFrame:
    """request, id, reject, fraud_count, fraud_score, approved, body of a batch: request and body (JSON).

    A batch that fits one block of queries reads the clusters it needs; a larger one, which needs nearly all, is searched
    by cells instead of in many passes. Both are exact, with the same rows.
    """
    config = config or EngineConfig()
    most = max(1, block_bytes // (8 * index.dims + 24))
    parsed = parse(bodies.select("request", "body"))
    good = vectorize(parsed.where("reject is null"), ("request",))
    queries = good.select(F.col("request").alias("query_id"), quantized(F.col("vector"), index.dims, index.space).alias("vector"))
    if bodies.limit(most + 1).count() <= most:
        found = knn.pruned(index, queries, config.k, config.nprobe, block_bytes)
    else:
        found = knn.cells(index.records, queries, index.dims, index.space, config.k)
    answers = score.response(score.decide(score.vote(found, queries, config.k), config.threshold))
    return parsed.select("request", "id", "reject").join(answers.withColumnRenamed("query_id", "request"), "request", "left")


def text_source(spark: SparkSession, path: str, per_batch: int = 1) -> DataFrame:
    """JSON lines of new files in a folder."""
    lines = spark.readStream.option("maxFilesPerTrigger", per_batch).text(path)
    return lines.select(F.col("value").alias("body"))


def start(bodies: DataFrame, index: Index, out: str, checkpoint: str, config: EngineConfig | None = None, once: bool = False) -> StreamingQuery:
    """Write scored batches under out as Parquet, a folder for each batch."""
    if not index.ready():
        raise RuntimeError("the index is empty")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.withColumn("request", F.monotonically_increasing_id()).persist()
        try:
            score_bodies(rows, index, config).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
        finally:
            rows.unpersist()

    writer = bodies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
