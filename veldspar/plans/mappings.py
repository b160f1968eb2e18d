"""Tables that the registered queries derive from the star schema and the embeddings.

The same statements run in Spark and DuckDB but for the functions in DIALECTS: transactions are orders with
their first line, customer and supplier; what earlier orders of the customer tell comes from windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DIMS
from ..functions.quantize import in_batches, quantized
from ..functions.vectorize import vectorize

#: Embeddings of these labels count as fraud.
FRAUD_LABELS = (0, 1, 2)
EMBEDDING_DIMS = 64

DIALECTS = {
    "spark": {"epoch": "unix_seconds(CAST({0} AS TIMESTAMP))", "text": "CAST({0} AS STRING)", "list": "array({0})"},
    "duckdb": {"epoch": "CAST(epoch({0}) AS BIGINT)", "text": "CAST({0} AS VARCHAR)", "list": "[{0}]"},
}


def transactions_sql(dialect: str) -> str:
    """SELECT of one row for each order with a line: the fields of a payload, and is_fraud."""
    d = DIALECTS[dialect]
    epoch, text = d["epoch"].format("o.o_orderdate"), d["text"]
    previous = "PARTITION BY o.o_custkey ORDER BY o.epoch_s, o.o_orderkey"
    known = d["list"].format(", ".join(f"lag(m.merchant, {i}) OVER w" for i in (1, 2, 3)))
    return f"""
WITH line AS (SELECT * FROM (SELECT l.*, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate, l_discount, l_tax, l_returnflag) AS nth FROM lineitem l) x WHERE nth = 1),
o AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(floor(o_totalprice * 2 + 0.5) AS BIGINT) AS cents, {epoch} + (o_orderkey * 7919) % 86400 AS epoch_s FROM orders o),
m AS (SELECT l_orderkey, l_returnflag, s_nationkey, abs(s_acctbal) AS merchant_avg, concat('MERC-', {text.format('l_suppkey')}) AS merchant,
             CASE p_type WHEN 'ECONOMY' THEN '5411' WHEN 'STANDARD' THEN '5812' WHEN 'PROMO' THEN '5912' WHEN 'SMALL' THEN '7995' WHEN 'LARGE' THEN '7801' ELSE '0000' END AS mcc
      FROM line JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey)
SELECT o.o_orderkey AS tx, CAST(o.cents AS DOUBLE) / 100 AS amount, CAST(1 + o.o_orderkey % 12 AS INT) AS installments, o.epoch_s,
       coalesce(floor(CAST(sum(o.cents) OVER ({previous} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS DOUBLE) / count(*) OVER ({previous} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 0.5) / 100, CAST(0 AS DOUBLE)) AS avg_amount,
       CAST(count(*) OVER (PARTITION BY o.o_custkey ORDER BY o.epoch_s RANGE BETWEEN 15552000 PRECEDING AND CURRENT ROW) - 1 AS INT) AS tx_count,
       {known} AS known, m.merchant, m.mcc, m.merchant_avg, o.o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_online, o.o_orderstatus <> 'P' AS card_present,
       CAST((c_nationkey * 41 + m.s_nationkey * 17) % 1200 AS DOUBLE) + CAST(0.5 AS DOUBLE) AS km_home,
       lag(o.epoch_s) OVER w AS last_at, abs(m.s_nationkey - lag(m.s_nationkey) OVER w) * CAST(40 AS DOUBLE) AS last_km, m.l_returnflag = 'R' AS is_fraud
FROM o JOIN customer ON c_custkey = o.o_custkey JOIN m ON m.l_orderkey = o.o_orderkey
WINDOW w AS ({previous})
"""


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("orders", "lineitem", "customer", "supplier", "part")
    return spark.sql(transactions_sql("spark").replace("FROM lineitem l", "FROM {lineitem} l").replace("FROM orders o", "FROM {orders} o").replace("JOIN supplier", "JOIN {supplier}").replace("JOIN part ", "JOIN {part} ").replace("JOIN customer", "JOIN {customer}"), **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def payloads(tx: DataFrame) -> DataFrame:
    """Nested payloads with tx and is_fraud beside them."""
    stamp = lambda c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return tx.select(
        "tx", "is_fraud", F.concat(F.lit("tx-"), F.col("tx").cast("string")).alias("id"), F.struct("amount", "installments", stamp("epoch_s").alias("requested_at")).alias("transaction"),
        F.struct("avg_amount", F.col("tx_count").alias("tx_count_24h"), F.array_compact("known").alias("known_merchants")).alias("customer"),
        F.struct(F.col("merchant").alias("id"), "mcc", F.col("merchant_avg").alias("avg_amount")).alias("merchant"),
        F.struct("is_online", "card_present", F.col("km_home").alias("km_from_home")).alias("terminal"),
        F.when(F.col("last_at").isNotNull(), F.struct(stamp("last_at").alias("timestamp"), F.col("last_km").alias("km_from_current"))).alias("last_transaction"))


def transaction_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_id, vector array<float>, is_fraud of all transactions."""
    return vectorize(payloads(transactions(spark, sf_dir)), ("tx", "is_fraud")).withColumnRenamed("tx", "ref_id")


def transactions_in_space(spark: SparkSession, sf_dir: str, space: str) -> DataFrame:
    """transaction_vectors in an integer space."""
    return in_batches(transaction_vectors(spark, sf_dir), DIMS, space)


def embedding_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("ref_id"), F.transform("embedding", lambda x: x.cast("float")).alias("vector"), F.col("label").isin(*FRAUD_LABELS).alias("is_fraud"))


def in_space(rows: DataFrame, dims: int, space: str) -> DataFrame:
    return rows.select("ref_id", quantized(F.col("vector"), dims, space).alias("vector"), "is_fraud")


def queries_of(rows: DataFrame) -> DataFrame:
    """The stated query set: the rows whose id is divisible by 20, searched against all rows."""
    return rows.where(F.col("ref_id") % 20 == 0).select(F.col("ref_id").alias("query_id"), "vector")
