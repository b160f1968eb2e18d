"""Synthetic transactions by profile, and their labels by exact search.

Every value is a hash of (row, seed, field), so rows are generated in parallel and alike however they are
dealt out. Profiles: with fraud ratio r a row is legit with 1 - r, fraud with 0.9 r, borderline with 0.1 r.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import MCC_RISK
from ..functions.quantize import quantized
from ..functions.vectorize import vectorize
from ..operators import knn, score
from ..storage import written

# Ranges of each profile (legit, fraud, borderline); whole-number ranges leave out the upper end.
RANGES = {
    "amount": ((10.0, 500.0), (2000.0, 10000.0), (400.0, 3000.0)), "installments": ((1, 4), (6, 13), (3, 8)), "hour": ((8, 21), (0, 7), (6, 23)),
    "tx_count": ((1, 6), (8, 21), (4, 12)), "merchant_avg": ((30.0, 500.0), (20.0, 100.0), (50.0, 300.0)), "online": (0.3, 0.8, 0.5),
    "km_home": ((0.0, 50.0), (200.0, 1000.0), (30.0, 400.0)), "minutes": ((30, 720), (1, 10), (5, 120)), "km_last": ((0.0, 20.0), (200.0, 1000.0), (20.0, 300.0)),
    "average": ((0.5, 2.0), (50.0, 300.0), (100.0, 500.0)),
}
LEGIT_MCC, FRAUD_MCC = ("5411", "5812", "5912", "5311"), ("7995", "7801", "7802")
FIRST_DAY, DAYS, NO_HISTORY = "2026-03-10", 18, 0.2
RANDOM_DATES, RANDOM_BACK = ("2026-03-01", "2030-12-28"), 3650


def uniform(field: str, seed: int) -> Column:
    """[0, 1) for each row and field."""
    return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(field)), F.lit(1 << 52)) / float(1 << 52)


def payloads(spark: SparkSession, n: int, fraud_ratio: float = 0.3, seed: int = 42, parts: int | None = None, random_dates: bool = False) -> DataFrame:
    """row, profile (0 legit, 1 fraud, 2 borderline), coin and the payload's columns.

    random_dates: payloads fall on any day of RANDOM_DATES, and a last transaction lies up to RANDOM_BACK days back, to the second.
    """
    u = lambda f: uniform(f, seed)
    by = lambda values: F.when(F.col("profile") == 0, values[0]).when(F.col("profile") == 1, values[1]).otherwise(values[2])
    real = lambda f: F.round(by([a + (b - a) * u(f) for a, b in RANGES[f]]), 2)
    whole = lambda f: by([F.floor(a + (b - a) * u(f)) for a, b in RANGES[f]]).cast("int")
    pick = lambda values, f: F.element_at(F.array(*map(F.lit, values)), F.floor(u(f) * len(values)).cast("int") + 1)
    shop = lambda a, b, f: F.concat(F.lit("MERC-"), F.lpad(F.floor(a + (b - a) * u(f)).cast("string"), 3, "0"))
    rows = spark.range(0, n, 1, parts) if parts else spark.range(n)
    rows = rows.withColumn("profile", F.when(u("profile") < 1 - fraud_ratio, 0).when(u("profile") < 1 - 0.1 * fraud_ratio, 1).otherwise(2)).withColumn("coin", u("coin") < 0.5)
    rows = rows.withColumn("amount", real("amount")).withColumn("known", F.slice(F.array(*[shop(1, 20, f"known{i}") for i in range(5)]), 1, F.floor(2 + 4 * u("n_known")).cast("int")))
    known = F.element_at("known", F.floor(u("merchant") * F.size("known")).cast("int") + 1)
    first, days = (RANDOM_DATES[0], F.datediff(F.lit(RANDOM_DATES[1]).cast("date"), F.lit(RANDOM_DATES[0]).cast("date")) + 1) if random_dates else (FIRST_DAY, F.lit(DAYS))
    rows = rows.withColumn("at", F.expr(f"timestamp'{first} 00:00:00'") + F.make_dt_interval(F.floor(days * u("day")).cast("int"), whole("hour"), F.floor(60 * u("minute")).cast("int"), F.floor(60 * u("second"))))
    rows = rows.withColumn("online", u("online") < by(RANGES["online"]))
    back = F.make_dt_interval(F.lit(0), F.lit(0), whole("minutes"))
    last = F.col("at") - (F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.floor(1 + RANDOM_BACK * 86_400 * u("back"))) if random_dates else back)
    stamp = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    average = F.round(F.when(F.col("profile") == 0, 2 * F.col("amount")).otherwise(by([F.lit(0.0)] + [a + (b - a) * u("average") for a, b in RANGES["average"][1:]])), 2)
    return rows.select(
        F.col("id").alias("row"), "profile", "coin", F.concat(F.lit("tx-"), F.lit(f"{seed}-"), F.col("id").cast("string")).alias("id"),
        F.struct("amount", whole("installments").alias("installments"), stamp(F.col("at")).alias("requested_at")).alias("transaction"),
        F.struct(average.alias("avg_amount"), whole("tx_count").alias("tx_count_24h"), F.col("known").alias("known_merchants")).alias("customer"),
        F.struct(
            F.when(F.col("profile") == 0, known).when(F.col("profile") == 1, shop(50, 100, "shop")).otherwise(F.when(u("new") < 0.5, known).otherwise(shop(30, 60, "shop"))).alias("id"),
            F.when(F.col("profile") == 0, pick(LEGIT_MCC, "mcc")).when(F.col("profile") == 1, pick(FRAUD_MCC, "mcc")).otherwise(pick(tuple(MCC_RISK), "mcc")).alias("mcc"), real("merchant_avg").alias("avg_amount")).alias("merchant"),
        F.struct(F.col("online").alias("is_online"), (~F.col("online") & (u("card") < 0.9)).alias("card_present"), real("km_home").alias("km_from_home")).alias("terminal"),
        F.when(u("history") >= NO_HISTORY, F.struct(stamp(last).alias("timestamp"), real("km_last").alias("km_from_current"))).alias("last_transaction"))


def references(spark: SparkSession, n: int = 200, fraud_ratio: float = 0.3, seed: int = 42, parts: int | None = None) -> DataFrame:
    """ref_id, vector array<float> rounded to four decimals, is_fraud by profile; borderline rows by a coin."""
    rows = vectorize(payloads(spark, n, fraud_ratio, seed, parts), ("row", "profile", "coin"))
    fraud = (F.col("profile") == 1) | (F.col("profile") == 2) & F.col("coin")
    return rows.select(F.col("row").alias("ref_id"), F.transform("vector", lambda v: F.round(v.cast("double"), 4).cast("float")).alias("vector"), fraud.alias("is_fraud"))


def labelled(refs: DataFrame, rows: DataFrame, dims: int = 14, space: str = "f64", k: int = 5, threshold: float = 0.6) -> DataFrame:
    """row, expected_fraud_score, expected_approved of payloads, by exact search among refs."""
    r = refs.select("ref_id", quantized(F.col("vector"), dims, space).alias("vector"), "is_fraud")
    q = vectorize(rows, ("row",)).select(F.col("row").alias("query_id"), quantized(F.col("vector"), dims, space).alias("vector"))
    r, q = written(r, "references"), written(q, "queries")  # read more than once
    found = score.decide(score.vote(knn.cells(r, q, dims, space, k), q, k), threshold)
    return found.select(F.col("query_id").alias("row"), F.col("fraud_score").alias("expected_fraud_score"), F.col("approved").alias("expected_approved"))
