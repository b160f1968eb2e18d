"""The 14 features of a transaction, as one fused projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT_RISK, LIMITS, MCC_RISK
from ..schema import PAYLOAD_STRUCT

NAMES = (
    "amount", "installments", "amount_vs_avg", "hour_of_day", "day_of_week", "minutes_since_last", "km_from_last",
    "km_from_home", "tx_count_24h", "is_online", "card_present", "unknown_merchant", "mcc_risk", "merchant_avg_amount",
)


def clamp(x: Column) -> Column:
    """Into [0, 1] as a float. x must not be null: greatest and least would skip it."""
    return F.greatest(F.lit(0.0).cast("float"), F.least(F.lit(1.0).cast("float"), x.cast("float")))


def _or(x: Column, value) -> Column:
    return F.coalesce(x, F.lit(value))


def timestamp(text: Column) -> Column:
    """ISO-8601 with any offset; null if malformed, also under ANSI."""
    return F.try_to_timestamp(text)


def features(limits: dict = LIMITS, mcc_risk: dict = MCC_RISK, fractional_minutes: bool = False) -> list[Column]:
    """The features in order, each FLOAT. Missing fields count as zero, false, and Monday at midnight."""
    tx, customer, merchant, terminal, last = (F.col(c) for c in ("transaction", "customer", "merchant", "terminal", "last_transaction"))
    at = _or(timestamp(tx["requested_at"]), "1970-01-05 00:00:00").cast("timestamp")
    before = timestamp(last["timestamp"])
    none = last["timestamp"].isNull()
    gap = F.greatest(F.lit(0).cast("long"), F.unix_seconds(at) - _or(F.unix_seconds(before), 0))
    minutes = gap / 60 if fractional_minutes else F.expr("bigint(0)") + (gap - gap % 60) / 60
    amount, average = _or(tx["amount"], 0.0), _or(customer["avg_amount"], 0.0)
    risk = F.create_map(*[F.lit(x).cast(t) for k, v in mcc_risk.items() for x, t in ((k, "string"), (v, "float"))])
    minus_one = F.lit(-1.0).cast("float")
    flag = lambda c: F.when(_or(c, False), 1.0).otherwise(0.0).cast("float")
    return [
        clamp(amount / limits["max_amount"]),
        clamp(_or(tx["installments"], 0) / limits["max_installments"]),
        clamp(F.when(average > 0, F.try_divide(amount, average)).otherwise(0.0) / limits["amount_vs_avg_ratio"]),
        (F.hour(at) / 23).cast("float"),
        (F.weekday(at) / 6).cast("float"),
        F.when(none, minus_one).otherwise(clamp(minutes / limits["max_minutes"])),
        F.when(none, minus_one).otherwise(clamp(_or(last["km_from_current"], 0.0) / limits["max_km"])),
        clamp(_or(terminal["km_from_home"], 0.0) / limits["max_km"]),
        clamp(_or(customer["tx_count_24h"], 0) / limits["max_tx_count_24h"]),
        flag(terminal["is_online"]),
        flag(terminal["card_present"]),
        F.when(_or(F.array_contains(customer["known_merchants"], merchant["id"]), False), 0.0).otherwise(1.0).cast("float"),
        _or(F.element_at(risk, merchant["mcc"]), DEFAULT_RISK).cast("float") if mcc_risk else F.lit(DEFAULT_RISK).cast("float"),
        clamp(_or(merchant["avg_amount"], 0.0) / limits["max_merchant_avg_amount"]),
    ]


def vectorize(payloads: DataFrame, keep: tuple[str, ...] = ("id",), **settings) -> DataFrame:
    """keep and vector array<float> of each payload."""
    return payloads.select(*keep, F.array(*features(**settings)).alias("vector"))


def parse(bodies: DataFrame, body: str = "body") -> DataFrame:
    """The payload's columns of a JSON column, with reject (why a row can't be scored, or null) and incomplete.

    Unknown fields are ignored and of a repeated key the last counts. A body that is no JSON object, a field of
    the wrong kind, a malformed time and an amount that is no finite number are rejected, never guessed.
    """
    schema = PAYLOAD_STRUCT[:-1] + ",_broken:string>"
    p = F.from_json(F.col(body), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
    out = bodies.withColumn("__p", p).select(*bodies.columns, "__p.*")
    time, last = F.col("transaction.requested_at"), F.col("last_transaction.timestamp")
    reject = (
        F.when(F.col(body).isNull() | F.col("_broken").isNotNull() | ~F.startswith(F.ltrim(F.coalesce(F.col(body), F.lit(""))), F.lit("{")), "malformed")
        .when(F.col("transaction.amount").isNull(), "amount")
        .when(F.isnan("transaction.amount") | (F.abs("transaction.amount") == float("inf")), "amount")
        .when(time.isNotNull() & timestamp(time).isNull() | last.isNotNull() & timestamp(last).isNull(), "time")
    )
    required = [time, *(F.col(c) for c in ("transaction.installments", "customer.avg_amount", "customer.tx_count_24h", "customer.known_merchants", "merchant.id", "merchant.mcc", "merchant.avg_amount", "terminal.is_online", "terminal.card_present", "terminal.km_from_home"))]
    incomplete = required[0].isNull()
    for c in required[1:]:
        incomplete = incomplete | c.isNull()
    return out.withColumn("reject", reject).withColumn("incomplete", incomplete).drop("_broken")
