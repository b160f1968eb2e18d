"""From neighbours to a decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vote(neighbours: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, fraud_count, fraud_score = frauds / k for every query; k stays the divisor if there are fewer."""
    votes = neighbours.groupBy("query_id").agg(F.count_if("is_fraud").cast("int").alias("fraud_count"))
    every = queries.select("query_id").join(votes, "query_id", "left").withColumn("fraud_count", F.coalesce("fraud_count", F.lit(0)))
    return every.withColumn("fraud_score", F.col("fraud_count") / F.lit(float(k)))


def decide(scores: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Adds approved: the score is below the threshold."""
    return scores.withColumn("approved", F.col("fraud_score") < F.lit(float(threshold)))


def response(scores: DataFrame) -> DataFrame:
    """Adds the JSON body of an answer."""
    return scores.withColumn("body", F.to_json(F.struct("approved", "fraud_score")))


def response_table(spark: SparkSession, k: int = 5, threshold: float = 0.6) -> DataFrame:
    """fraud_count, fraud_score, approved, body for each possible number of frauds."""
    counts = spark.range(k + 1).select(F.col("id").cast("int").alias("fraud_count"), (F.col("id") / F.lit(float(k))).alias("fraud_score"))
    return response(decide(counts, threshold))
