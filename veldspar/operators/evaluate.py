"""Evaluation of decisions and of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the scoring rules.
SCALE, SLOWEST_MS, LATEST_MS, FASTEST_MS = 1000.0, 1000.0, 2000.0, 1.0
LEAST_EPSILON, PENALTY, FAILURE_CUT, CUT = 0.001, 300.0, 0.15, -3000.0
WEIGHTS = {"fp": 1, "fn": 3, "err": 5}


def confusion(decisions: DataFrame) -> DataFrame:
    """decisions: approved, expected_approved; a null approved is an error. Denied fraud is a true positive."""
    said, want = F.col("approved"), F.col("expected_approved")
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    return decisions.agg(n(~said & ~want, "tp"), n(said & want, "tn"), n(~said & want, "fp"), n(said & ~want, "fn"), n(said.isNull(), "err"))


def weighted(counts: DataFrame) -> DataFrame:
    """Adds n, weighted_errors, epsilon, failure_rate."""
    n = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn") + F.col("err")
    e = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0).cast("long"))
    share = lambda x: F.when(F.col("n") > 0, F.try_divide(x.cast("double"), F.col("n"))).otherwise(0.0)
    out = counts.withColumn("n", n).withColumn("weighted_errors", e)
    return out.withColumn("epsilon", share(F.col("weighted_errors"))).withColumn("failure_rate", share(F.col("fp") + F.col("fn") + F.col("err")))


def latency_score(p99: Column) -> Column:
    """0 if nothing answered, a cut if too late, else a logarithm of how fast."""
    return F.when(p99 <= 0, 0.0).when(p99 > LATEST_MS, CUT).otherwise(SCALE * F.log10(SLOWEST_MS / F.greatest(p99, F.lit(FASTEST_MS))))


def detection_score(epsilon: Column, errors: Column, failure_rate: Column) -> Column:
    value = SCALE * F.log10(1 / F.greatest(epsilon, F.lit(LEAST_EPSILON))) - PENALTY * F.log10(1 + errors)
    return F.when(failure_rate > FAILURE_CUT, CUT).otherwise(value)


def scored(runs: DataFrame) -> DataFrame:
    """runs: weighted counts and p99. Adds p99_score, detection_score, final_score and whether either was cut."""
    out = runs.withColumn("p99_score", latency_score(F.col("p99"))).withColumn("p99_cut", F.col("p99") > LATEST_MS)
    out = out.withColumn("detection_score", detection_score(F.col("epsilon"), F.col("weighted_errors"), F.col("failure_rate"))).withColumn("detection_cut", F.col("failure_rate") > FAILURE_CUT)
    return out.withColumn("final_score", F.col("p99_score") + F.col("detection_score"))


def result_document(scored_runs: DataFrame) -> DataFrame:
    """Adds json: the scores rounded to two decimals beside their raw values, rates as numbers."""
    r = lambda c: F.round(c, 2).alias(c)
    breakdown = F.struct(*[F.col(a).alias(b) for a, b in (("fp", "false_positive_detections"), ("fn", "false_negative_detections"), ("tp", "true_positive_detections"), ("tn", "true_negative_detections"), ("err", "http_errors"))])
    raw = F.struct(F.col("p99").alias("p99_ms"), "failure_rate", F.col("epsilon").alias("error_rate_epsilon"), "p99_score", "detection_score", "final_score")
    body = F.struct(breakdown.alias("breakdown"), F.col("weighted_errors").alias("weighted_errors_E"), F.struct(F.round("p99_score", 2).alias("value"), F.col("p99_cut").alias("cut_triggered")).alias("p99_score"), F.struct(F.round("detection_score", 2).alias("value"), F.col("detection_cut").alias("cut_triggered")).alias("detection_score"), r("final_score"), raw.alias("raw"))
    return scored_runs.withColumn("json", F.to_json(F.struct(body.alias("scoring"))))


def aggregate_documents(runs: DataFrame, keys: tuple[str, ...] = ("dtype", "clusters", "nprobe")) -> DataFrame:
    """keys and json: one document for each configuration, medians over its runs, as readers.run_results reads it.

    runs: scored runs with tp, tn, fp, fn, p99, failure_rate. Numbers are numbers, rates too.
    """
    median = lambda c: F.median(c).alias(c)
    found = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.struct(F.median("p99").alias("median"), F.min("p99").alias("min"), F.max("p99").alias("max"), F.sort_array(F.collect_list("p99")).alias("samples")).alias("p99_ms"),
        *map(median, ("tp", "tn", "fp", "fn", "failure_rate", "p99_score", "detection_score", "final_score")), F.bool_or("p99_cut").alias("p99_cut"), F.bool_or("detection_cut").alias("detection_cut"))
    count = lambda c, name: F.round(c).cast("long").alias(name)
    scoring = F.struct(
        F.struct(F.col("p99_score").alias("value"), F.col("p99_cut").alias("cut_triggered")).alias("p99_score"), F.struct(F.col("detection_score").alias("value"), F.col("detection_cut").alias("cut_triggered")).alias("detection_score"), "final_score", "failure_rate",
        F.struct(count("tp", "true_positive_detections"), count("tn", "true_negative_detections"), count("fp", "false_positive_detections"), count("fn", "false_negative_detections")).alias("breakdown"))
    body = F.struct(*[c for c in ("dtype",) if c in keys], "runs", "p99_ms", F.concat(F.round("p99_ms.median", 1).cast("string"), F.lit("ms")).alias("p99"), scoring.alias("scoring"), F.col("final_score").alias("final_score_median"))
    return found.select(*keys, F.to_json(body).alias("json"))


def percentiles(latencies: DataFrame, column: str, keys: tuple[str, ...] = (), exact: bool = True) -> DataFrame:
    """p50, p95, p99: exact with linear interpolation, or approximate within 1/10000 in bounded memory.

    The exact form counts each distinct value, so a group with more than some ten million of them wants the other.
    """
    f = F.percentile if exact else F.percentile_approx
    return latencies.groupBy(*keys).agg(*[f(column, p).cast("double").alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])


def run_summary(runs: DataFrame, keys: tuple[str, ...] = ("dtype", "clusters", "nprobe")) -> DataFrame:
    """runs: p99, final_score, p99_cut, detection_cut. Per configuration: median, least, most, spread, any cut, samples in order."""
    return runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("runs"), F.median("p99").alias("p99_median"), F.min("p99").alias("p99_min"), F.max("p99").alias("p99_max"),
        F.round(F.max("p99") - F.min("p99"), 2).alias("p99_spread"), F.median("final_score").alias("final_score_median"),
        F.bool_or("p99_cut").alias("p99_cut_any"), F.bool_or("detection_cut").alias("detection_cut_any"), F.sort_array(F.collect_list("p99")).alias("p99_samples"))


def best_first(summary: DataFrame, score: str = "final_score_median", keys: tuple[str, ...] = ("dtype", "clusters", "nprobe")) -> DataFrame:
    """Adds place: 1 for the best score, ties by configuration."""
    return summary.withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), *keys)).cast("long"))  # a row for each configuration


def rates(counts: DataFrame) -> DataFrame:
    """Adds precision, recall, f1, fpr; 0 where there is nothing to divide by."""
    safe = lambda a, b: F.when(b > 0, F.try_divide(a.cast("double"), b)).otherwise(0.0)
    out = counts.withColumn("precision", safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe(F.col("tp"), F.col("tp") + F.col("fn")))
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", safe(2 * p * r, p + r)).withColumn("fpr", safe(F.col("fp"), F.col("fp") + F.col("tn")))


def load_profile(stages: DataFrame, start: int = 1) -> DataFrame:
    """stages: stage, duration_s, target. Adds requests of each ramp (whole numbers), and running sums."""
    w = Window.orderBy("stage")  # a row for each stage
    requests = F.expr(f"((coalesce(lag(target) over (order by stage), {int(start)}) + target) * duration_s) div 2").cast("long")
    out = stages.withColumn("requests", requests)
    return out.withColumn("total_requests", F.sum("requests").over(w)).withColumn("total_s", F.sum("duration_s").over(w).cast("long"))


def plateau(windows: DataFrame, tolerance: float = 0.02, keys: tuple[str, ...] = ()) -> DataFrame:
    """windows: step, latency. Adds stable: how many steps in a row changed by no more than the tolerance."""
    w = Window.partitionBy(*keys).orderBy("step")
    before = F.lag("latency").over(w)
    calm = F.coalesce(F.abs(F.try_divide(before - F.col("latency"), before)) <= tolerance, F.lit(False))
    out = windows.withColumn("__calm", calm).withColumn("__part", F.sum(F.when(F.col("__calm"), 0).otherwise(1)).over(w))
    island = Window.partitionBy(*keys, "__part").orderBy("step")
    return out.withColumn("stable", F.sum(F.when(F.col("__calm"), 1).otherwise(0)).over(island).cast("long")).drop("__calm", "__part")


def dataset_stats(labelled: DataFrame) -> DataFrame:
    """labelled: expected_approved, expected_fraud_score. Totals and rates to four decimals."""
    fraud, edge, n = F.count_if(~F.col("expected_approved")), F.count_if(F.col("expected_fraud_score") == F.lit(0.6)), F.count(F.lit(1))
    rate = lambda x: F.round(F.coalesce(F.try_divide(x.cast("double"), n), F.lit(0.0)), 4)
    legit = F.count_if("expected_approved")
    return labelled.agg(n.alias("total"), fraud.alias("fraud_count"), legit.alias("legit_count"), rate(fraud).alias("fraud_rate"), rate(legit).alias("legit_rate"), edge.alias("edge_case_count"), rate(edge).alias("edge_case_rate"))


def parameter_grid(*tables: DataFrame, most: int = 100_000) -> DataFrame:
    """Every combination of the rows of small tables; all but the first may have ``most`` rows together, which is counted."""
    out, rows = tables[0], 1
    for t in tables[1:]:
        rows *= t.limit(most + 1).count()
        if rows > most:
            raise ValueError(f"more than {most} combinations of the tables after the first")
        out = out.crossJoin(F.broadcast(t))
    return out
